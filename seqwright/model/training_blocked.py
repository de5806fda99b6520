"""Training steps when the item table exceeds the size bound (no task holds it whole).

The output layer needs every item's row for every position. Above the bound a step
runs as a sequence of jobs, none of which holds more than one block of item rows:

1. forward: ``scoring.score`` with the blocked path (input vectors joined per row,
   log-sum-exp by tiles) gives each position's state ``h``, ``lse`` and target
   logit; the result is written once;
2. per tile of positions and item blocks (:mod:`seqwright.model.tiles`, one job): the expected
   output row ``E = sum_i p_i O_i`` per position (partial per block) and the dense output-layer
   gradient ``sum_t w_t p_ti h_t`` per item (partial per group of positions);
3. ``dL/dh = w_t (E_t - O_target)`` per position (the target row joined by id), where
   ``w_t`` is the mask times the objective's scale;
4. backward: the step job re-runs the forward fold per window from the joined input
   vectors and back-propagates ``dL/dh``; item input gradients are summed per item
   inside each task; users are updated as in the in-memory step;
5. the partial gradients are summed by ``groupBy`` and applied as in the in-memory step.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqwright.model import scoring
from seqwright.model.tiles import steps, tiled
from seqwright.session import scratch_path

GRAD_SCHEMA = "kind STRING, user BIGINT, seg BIGINT, pos BIGINT, id BIGINT, v ARRAY<DOUBLE>"


def _tile_grad(scale: float, mask_zero: bool, H: int):
    def tile(rows: pd.DataFrame, out: np.ndarray, first: int) -> pd.DataFrame:
        gacc, e = np.zeros_like(out), np.empty((len(rows), H))
        h = np.stack(rows["h"].to_numpy())
        tg = rows["target"].to_numpy().astype(np.int64)
        lse = rows["lse"].to_numpy()
        w = ((tg > 0) if mask_zero else np.ones(len(tg), dtype=bool)).astype(float) * scale
        for a, b in steps(len(rows), len(out)):
            p = np.exp(h[a:b] @ out.T - lse[a:b, None])    # softmax probabilities of this block's items
            e[a:b] = p @ out                               # partial expected output row per position
            gacc += (p * w[a:b, None]).T @ h[a:b]          # dense output-layer gradient, this block
        nz = np.flatnonzero(np.any(gacc != 0.0, axis=1))
        n, k = len(rows), len(nz)
        key = {c: [*rows[c].tolist(), *[None] * k] for c in ("user", "seg", "pos")}
        return pd.DataFrame({"kind": ["e"] * n + ["item"] * k, **{c: pd.array(v, "Int64") for c, v in key.items()},
                             "id": pd.array([None] * n + (nz + first).tolist(), "Int64"),
                             "v": [*e, *(np.concatenate([np.zeros(3 * H), gacc[i]]) for i in nz)]})
    return tile


def train_step_blocked(spark: SparkSession, rows: DataFrame, t, cfg, window_len: int, limit: int,
                       workdir: str | None = None):
    """One step of :func:`seqwright.model.training.train_step` without holding the item table."""
    from seqwright.model.training import STEP_SCHEMA, apply_step, step_frame

    H = cfg.hidden
    rows = rows.select("user", "seg", "pos", "item", "target")
    n_windows = rows.select("user", "seg").distinct().count()
    if n_windows == 0:
        return t, {"loss": 0.0, "n": 0.0, "hits": 0.0, "windows": 0}
    scale = 1.0 / (n_windows * window_len)

    # 1. forward with blocked softmax statistics, written once
    sc = scoring.score(spark, rows, t.user_w, t.item_w, t.shared_w, num_items=cfg.num_items, hidden=H,
                       carry=cfg.carry, reset_gate=cfg.reset_gate, act=cfg.act, split_users=cfg.split_users,
                       piece_windows=cfg.piece_windows, shared_bytes=limit, workdir=workdir)
    sp = scratch_path(spark, "fwd", workdir)
    sc.write.mode("overwrite").parquet(sp)
    sc = spark.read.parquet(sp)

    # 2. expected output rows and output-layer gradients, by tiles of positions and item blocks
    gp = scratch_path(spark, "out_grads", workdir)
    tiled(sc.select("user", "seg", "pos", "target", "h", "lse"), t.item_w, cfg.num_items, H, limit,
          _tile_grad(scale, cfg.mask_zero, H), GRAD_SCHEMA).write.mode("overwrite").parquet(gp)
    g = spark.read.parquet(gp)
    keys = ["user", "seg", "pos"]
    e = g.where(F.col("kind") == "e").groupBy(*keys).agg(F.collect_list("v").alias("_es"))
    e = e.select(*keys, F.aggregate("_es", F.array_repeat(F.lit(0.0), H),
                                    lambda a, x: F.zip_with(a, x, lambda p, q: p + q)).alias("E"))

    # 3. dL/dh per position: w * (E - O_target); input vectors joined by item for the backward job
    w = (F.when(F.col("target") > 0, F.lit(scale)).otherwise(F.lit(0.0)) if cfg.mask_zero else F.lit(scale))
    tv = t.item_w.select(F.col("item").alias("target"), F.col("out").alias("wt"))
    iv = t.item_w.select("item", F.col("gate_in").alias("xg"), F.col("cand_in").alias("xc"))
    back = (sc.select(*keys, "item", "target").join(e, keys).join(tv, "target").join(iv, "item")
            .withColumn("_w", w))
    back = back.withColumn("dh", F.zip_with("E", "wt", lambda a, b: (a - b) * F.col("_w")))
    # target part of the output-layer gradient: -w h summed per target item
    tgt = sc.withColumn("_w", w).select(
        F.lit("item").alias("kind"), F.col("target").alias("id"),
        F.concat(F.array_repeat(F.lit(0.0), 3 * H), F.transform("h", lambda x: -x * F.col("_w"))).alias("v1"))

    # 4. backward job (users updated as in the in-memory step), written
    out = step_frame(spark, back.select(*keys, "item", "target", "xg", "xc", "dh"), t.user_w, t.item_w,
                     t.shared_w, cfg, scale, blocked=True)
    rp = scratch_path(spark, "step", workdir)
    out.write.mode("overwrite").partitionBy("kind").parquet(rp)
    res = spark.read.parquet(rp)

    # 5. all partial gradients and the step statistics in the step-output shape, then apply
    real = (F.col("target") > 0) if cfg.mask_zero else F.lit(True)
    stat = sc.agg(F.sum(F.when(real, F.col("lse") - F.col("tlogit")).otherwise(0.0)).alias("loss"),
                  F.sum(F.when(real, 1.0).otherwise(0.0)).alias("cnt"),
                  F.sum(F.when(real & (F.col("argmax") == F.col("target")), 1.0).otherwise(0.0)).alias("hits"))
    stat = stat.select(F.lit("stat").alias("kind"), F.lit(0).cast("bigint").alias("id"), "loss", "cnt", "hits")
    none = F.lit(None).cast("array<double>")
    outg = g.where(F.col("kind") == "item").select("kind", "id", F.col("v").alias("v1"))
    parts = [res.where(F.col("kind") != "stat"),
             outg.select("kind", "id", "v1", none.alias("v2"), none.alias("v3"), none.alias("v4"),
                         F.lit(None).cast("double").alias("loss"), F.lit(None).cast("double").alias("cnt"),
                         F.lit(None).cast("double").alias("hits")),
             tgt.select("kind", "id", "v1", none.alias("v2"), none.alias("v3"), none.alias("v4"),
                        F.lit(None).cast("double").alias("loss"), F.lit(None).cast("double").alias("cnt"),
                        F.lit(None).cast("double").alias("hits")),
             stat.select("kind", "id", none.alias("v1"), none.alias("v2"), none.alias("v3"), none.alias("v4"),
                         "loss", "cnt", "hits")]
    cols = [c.split(" ")[0] for c in STEP_SCHEMA.split(", ")]
    allp = parts[0].select(*cols)
    for q in parts[1:]:
        allp = allp.unionByName(q.select(*cols))
    ap = scratch_path(spark, "step_all", workdir)
    allp.write.mode("overwrite").partitionBy("kind").parquet(ap)
    new, st = apply_step(spark, spark.read.parquet(ap), t, cfg, workdir)
    st["windows"] = n_windows
    st["objective"] = st["loss"] * scale
    return new, st
