"""Training as synchronous distributed steps.

One step:

1. The batch's windows and the weight rows of the batch's users are unioned, hash
   partitioned by ``user`` (by ``(user, piece)`` when hot users are split) and
   sorted, as for scoring.
2. ``mapInPandas`` runs forward and backward passes over blocks of windows (state
   reset per window, or carried across a user's chunks with the gradient truncated
   at chunk starts). A user whose windows are all in the task is updated there
   (RMSProp); a user split over several tasks sends partial gradients. Item, output
   and bias gradients are partial sums per task.
3. The partial sums are added up by a ``groupBy`` (map-side partial aggregation) and
   applied with array column expressions; users outside the batch keep their rows
   (anti-join).
4. All new tables are written below the step's folder under the checkpoint folder and
   read back, so each step starts from files: lineage stays one step long and a lost
   executor costs at most the current step.

Above the item-table size bound the step runs without holding the item table
(:mod:`seqwright.model.training_blocked`).

The objective is the reference's: masked softmax cross-entropy summed over the
batch and divided by ``windows x window length``.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqwright.functions.math import with_rmsprop
from seqwright.model import cell
from seqwright.model.scoring import sub_batches
from seqwright.model.weights import MAX_SHARED_BYTES, shared_arrays
from seqwright.session import remove_path, scratch_path

STEP_SCHEMA = ("kind STRING, id BIGINT, v1 ARRAY<DOUBLE>, v2 ARRAY<DOUBLE>, v3 ARRAY<DOUBLE>, "
               "v4 ARRAY<DOUBLE>, loss DOUBLE, cnt DOUBLE, hits DOUBLE")


@dataclass
class StepConfig:
    hidden: int
    num_items: int
    lr: float = 0.01
    rho: float = 0.9
    eps: float = 1e-8
    carry: bool = False
    reset_gate: bool = False
    act: str = "tanh"
    mask_zero: bool = True
    update: bool = True      # False: emit raw gradients (A9) and leave weights as they are
    split_users: bool = True   # reset mode: spread a hot user's windows over tasks
    piece_windows: int = 1024  # windows per piece when split_users
    shared_bytes: int | None = None  # item-table bound (MAX_SHARED_BYTES); above it: blocked step
    batch_rows: int | None = None    # rows per piece of an Arrow batch (tests)
    emit_state: bool = False         # carry mode: 'state' rows (user, state, summed loss, positions, hits)


def _union(rows: DataFrame, user_w: DataFrame, piece_windows: int | None = None,
           extra: tuple[str, ...] = (), init_state: DataFrame | None = None) -> DataFrame:
    """Weight rows and event rows in one frame; a weight row carries the user's state at the start (``h0``, null:
    zero). With ``piece_windows`` a user's windows are
    grouped into pieces of that many windows (``wpiece``) and the weight row is replicated
    once per piece the batch touches; only those users' rows are sent."""
    ev = rows.select("user", F.lit(1).alias("kind"), F.col("seg").cast("bigint"), F.col("pos").cast("bigint"),
                     F.col("item").cast("bigint"), F.col("target").cast("bigint"),
                     *[F.lit(None).cast("array<double>").alias(c) for c in ("gate", "cand", "gate_ms", "cand_ms")],
                     *[F.col(c) for c in extra])
    w = user_w.select("user", "gate", "cand", "gate_ms", "cand_ms")
    none = F.lit(None).cast("array<double>")
    ev = ev.withColumn("h0", none)
    if init_state is not None:
        w = w.join(init_state.select("user", F.col("h").alias("h0")), "user", "left")
    else:
        w = w.withColumn("h0", none)
    if piece_windows:
        piece = F.floor(F.col("seg") / piece_windows).cast("bigint")
        ev = ev.withColumn("wpiece", piece)
        pieces = rows.select("user", piece.alias("wpiece")).distinct()
        pieces = pieces.withColumn("npieces", F.count(F.lit(1)).over(Window.partitionBy("user")))
        w = w.join(pieces, "user")
    else:
        ev = ev.withColumn("wpiece", F.lit(0).cast("bigint"))
        w = w.join(rows.select("user").distinct(), "user", "left_semi")
        w = w.withColumn("wpiece", F.lit(0).cast("bigint")).withColumn("npieces", F.lit(1).cast("bigint"))
    ev = ev.withColumn("npieces", F.lit(None).cast("bigint"))
    wt = w.select("user", F.lit(0).alias("kind"), *[F.lit(None).cast("bigint").alias(c)
                                                    for c in ("seg", "pos", "item", "target")],
                  "gate", "cand", "gate_ms", "cand_ms", "h0", "wpiece", F.col("npieces").cast("bigint"),
                  *[none.alias(c) for c in extra])
    return wt.unionByName(ev)


def step_frame(spark: SparkSession, rows: DataFrame, user_w: DataFrame, item_w: DataFrame,
               shared_w: DataFrame, cfg: StepConfig, scale: float, partitions: int | None = None,
               blocked: bool = False, init_state: DataFrame | None = None) -> DataFrame:
    """The per-task output of one step (lazy): updated user rows ('user'), partial item and
    bias gradients ('item', 'bias'), raw user gradients ('user_grad', with update=False) and
    loss statistics ('stat'). With state carry users start from ``init_state`` (user, h), and with
    ``cfg.emit_state`` a 'state' row per user has the state at its last position.

    ``blocked=True``: no task holds the item table; ``rows`` carry the item input vectors
    (``xg``, ``xc``) and dL/dh from the output layer (``dh``) per position, and item input
    gradients are summed per item inside the task ('item' rows, output part zero)."""
    if blocked:
        b = {r["name"]: np.asarray(r["v"], float) for r in shared_w.collect()}
        H = cfg.hidden
        arrays = {"gate_in": np.zeros((0, 2 * H)), "cand_in": np.zeros((0, H)), "out": np.zeros((0, H)),
                  "gate_bias": b["gate_bias"], "cand_bias": b["cand_bias"]}
    else:
        arrays = shared_arrays(item_w, shared_w, cfg.num_items, cfg.hidden, cfg.shared_bytes).arrays()
    bsh = spark.sparkContext.broadcast(arrays)  # plain numpy: no package import on workers
    P = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    split = cfg.split_users and not cfg.carry
    keys = ["user", "wpiece"] if split else ["user"]
    data = _union(rows, user_w, cfg.piece_windows if split else None, ("xg", "xc", "dh") if blocked else (), init_state)
    data = data.repartition(P, *keys).sortWithinPartitions("user", "wpiece", "kind", "seg", "pos")
    return data.mapInPandas(_make_step(bsh, cfg, scale, blocked), STEP_SCHEMA)


def _make_step(bsh, cfg: StepConfig, scale: float, blocked: bool = False):
    H = cfg.hidden
    split = cfg.split_users and not cfg.carry

    def run(batches):
        sh = cell.Shared(**bsh.value)
        acc = {"gate_in": np.zeros_like(sh.gate_in), "cand_in": np.zeros_like(sh.cand_in),
               "out": np.zeros_like(sh.out), "gate_bias": np.zeros_like(sh.gate_bias),
               "cand_bias": np.zeros_like(sh.cand_bias)}
        stats = [0.0, 0.0, 0.0]
        iacc = {}           # blocked: item -> summed input-vector gradient (gate_in ++ cand_in)
        users = {}          # (user, piece) -> [G, C, G_ms, C_ms, gG, gC, touched, npieces]
        order = []          # keys in arrival (= sort) order, not yet emitted
        tally = {}          # key -> [loss, positions, hits] (emit_state)
        carried = {}        # key -> state at the end of its last processed chunk (carry mode)
        pending = None      # rows of the (user, piece, seg) run that may continue in the next batch

        def process(ev: pd.DataFrame):
            if ev.empty:
                return
            u = ev["user"].to_numpy().astype(np.int64)
            p = ev["wpiece"].to_numpy().astype(np.int64)
            s = ev["seg"].to_numpy().astype(np.int64)
            it = ev["item"].to_numpy().astype(np.int64)
            tg = ev["target"].to_numpy().astype(np.int64)
            if blocked:
                xg_rows = np.stack(ev["xg"].to_numpy())
                xc_rows = np.stack(ev["xc"].to_numpy())
                dh_rows = np.stack(ev["dh"].to_numpy())
            starts = np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (p[1:] != p[:-1]) | (s[1:] != s[:-1])])
            ends = np.r_[starts[1:], len(ev)]
            keys = [(int(u[k]), int(p[k])) for k in starts]
            # round = rank of the run within its key (carry mode runs rounds in order)
            rnd = np.zeros(len(starts), dtype=np.int64)
            if cfg.carry:
                for k in range(1, len(starts)):
                    rnd[k] = rnd[k - 1] + 1 if keys[k] == keys[k - 1] else 0
            for r in range(int(rnd.max()) + 1):
                ks = np.flatnonzero(rnd == r)
                T = int((ends[ks] - starts[ks]).max())
                S = len(ks)
                items = np.zeros((S, T), dtype=np.int64)
                targets = np.zeros((S, T), dtype=np.int64)
                mask = np.zeros((S, T), dtype=bool)
                ridx = np.zeros((S, T), dtype=np.int64)
                h0 = np.zeros((S, H))
                for j, k in enumerate(ks):
                    n = ends[k] - starts[k]
                    items[j, :n] = it[starts[k]:ends[k]]
                    targets[j, :n] = tg[starts[k]:ends[k]]
                    mask[j, :n] = True
                    ridx[j, :n] = np.arange(starts[k], ends[k])
                    if cfg.carry and keys[k] in carried:
                        h0[j] = carried[keys[k]]
                G = np.stack([users[keys[k]][0] for k in ks])
                C = np.stack([users[keys[k]][1] for k in ks])
                if blocked:
                    _, hT, cache = cell.forward(h0, G, C, items, mask, sh, cfg.act, cfg.reset_gate, keep=True,
                                                xg=xg_rows[ridx], xc=xc_rows[ridx])
                    dhs = dh_rows[ridx] * mask[..., None]
                    gG, gC, gbg, gbc, DA, DB = cell.backprop(cache, G, C, mask, dhs, cfg.act, cfg.reset_gate)
                    g = cell.Grads(gG, gC, None, None, None, gbg, gbc)
                    acc["gate_bias"] += gbg
                    acc["cand_bias"] += gbc
                    sel = mask.ravel()
                    ids = items.ravel()[sel]
                    vals = np.concatenate([DA.reshape(-1, 2 * H)[sel], DB.reshape(-1, H)[sel]], axis=1)
                    uniq, inv = np.unique(ids, return_inverse=True)
                    part = np.zeros((len(uniq), 3 * H))
                    np.add.at(part, inv, vals)
                    for i, v in zip(uniq.tolist(), part):
                        if i in iacc:
                            iacc[i] += v
                        else:
                            iacc[i] = v
                else:
                    loss, nval, hits, cost, g, hT = cell.loss_and_grads(
                        h0, G, C, items, targets, mask, sh, scale, cfg.act, cfg.reset_gate, cfg.mask_zero)
                    stats[0] += loss
                    stats[1] += nval
                    stats[2] += hits
                    for name in ("out", "gate_bias", "cand_bias"):
                        acc[name] += getattr(g, name)
                    acc["gate_in"][g.items] += g.item_in[:, :2 * H]
                    acc["cand_in"][g.items] += g.item_in[:, 2 * H:]
                for j, k in enumerate(ks):
                    st = users[keys[k]]
                    st[4] += g.G[j]
                    st[5] += g.C[j]
                    st[6] = True
                    if cfg.carry:
                        carried[keys[k]] = hT[j]
                    if cfg.emit_state:
                        seen = tally.setdefault(keys[k], [0.0, 0])
                        seen[0] += 0.0 if blocked else float(cost[j])
                        seen[1] += int(mask[j].sum())

        def emit(upto=None):
            """Emit every open key before ``upto`` (all with None): its events are done."""
            out = []
            while order and (upto is None or order[0] < upto):
                key = order.pop(0)
                G, C, Gm, Cm, gG, gC, touched, npieces = users.pop(key)
                state = carried.pop(key, None)
                if cfg.emit_state and state is not None:
                    out.append(("state", key[0], state, None, None, None, *tally.pop(key, (0.0, 0)), 0.0))
                # a user whose windows are in several pieces (other tasks) sends partial
                # gradients to be summed; every other user is complete here
                if not cfg.update or (split and npieces > 1):
                    if touched:
                        out.append(("user_grad", key[0], gG.ravel(), gC.ravel(), None, None))
                    continue
                if touched:
                    G, Gm = cell.rmsprop(G, gG, Gm, cfg.lr, cfg.rho, cfg.eps)
                    C, Cm = cell.rmsprop(C, gC, Cm, cfg.lr, cfg.rho, cfg.eps)
                out.append(("user", key[0], G.ravel(), C.ravel(), Gm.ravel(), Cm.ravel()))
            return out

        for pdf in sub_batches(batches, cfg.batch_rows):
            if pdf.empty:
                continue
            for row in pdf[pdf["kind"] == 0].itertuples(index=False):
                key = (int(row.user), int(row.wpiece))
                users[key] = [np.asarray(row.gate, float).reshape(H, 2 * H),
                              np.asarray(row.cand, float).reshape(H, H),
                              np.asarray(row.gate_ms, float).reshape(H, 2 * H),
                              np.asarray(row.cand_ms, float).reshape(H, H),
                              np.zeros((H, 2 * H)), np.zeros((H, H)), False, int(row.npieces)]
                if cfg.carry and row.h0 is not None:
                    carried[key] = np.asarray(row.h0, float)
                order.append(key)
            ev = pdf[pdf["kind"] == 1]
            if pending is not None:
                ev = pd.concat([pending, ev], ignore_index=True)
                pending = None
            if ev.empty:
                continue
            last = (int(ev["user"].iloc[-1]), int(ev["wpiece"].iloc[-1]))
            tail = ((ev["user"] == last[0]) & (ev["wpiece"] == last[1])
                    & (ev["seg"] == ev["seg"].iloc[-1]))
            pending = ev[tail]
            process(ev[~tail])
            out = emit(last)
            if out:
                yield _frame(out)
        if pending is not None:
            process(pending)
        out = emit(None)
        # partial sums of the shared gradients of this task
        if blocked:
            for i, v in iacc.items():
                out.append(("item", int(i), np.concatenate([v, np.zeros(H)]), None, None, None))
        else:
            gi = np.concatenate([acc["gate_in"], acc["cand_in"], acc["out"]], axis=1)
            for i in np.flatnonzero(np.any(gi != 0.0, axis=1)):
                out.append(("item", int(i), gi[i], None, None, None))
        out.append(("bias", 0, np.concatenate([acc["gate_bias"], acc["cand_bias"]]), None, None, None))
        out.append(("stat", 0, None, None, None, None, stats[0], stats[1], stats[2]))
        yield _frame(out)
    return run


def _frame(rows):
    def arr(r, i):
        return None if r[i] is None else np.asarray(r[i])
    return pd.DataFrame({
        "kind": [r[0] for r in rows], "id": [r[1] for r in rows],
        "v1": [arr(r, 2) for r in rows], "v2": [arr(r, 3) for r in rows],
        "v3": [arr(r, 4) for r in rows], "v4": [arr(r, 5) for r in rows],
        "loss": [r[6] if len(r) > 6 else None for r in rows],
        "cnt": [r[7] if len(r) > 7 else None for r in rows],
        "hits": [r[8] if len(r) > 8 else None for r in rows]})


def sum_arrays(df: DataFrame, keys, col: str = "v1") -> DataFrame:
    """Element-wise sum of equal-length array partials per key. Rows are dealt out by key as
    arrays; a task adds them as they stream in and holds one array per key of a batch run."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    src = df.select(*keys, col)
    fields = [src.schema[k] for k in keys]

    def add(batches):
        held_key, held = None, None
        for pdf in batches:
            if pdf.empty:
                continue
            m = np.stack(pdf[col].to_numpy())
            k = pdf[keys]
            first = np.flatnonzero(np.r_[True, (k.iloc[1:].to_numpy() != k.iloc[:-1].to_numpy()).any(axis=1)])
            total = np.add.reduceat(m, first, axis=0)
            ids = [tuple(r) for r in k.iloc[first].to_numpy().tolist()]
            if held_key is not None:
                if held_key == ids[0]:
                    total[0] += held
                else:
                    ids, total = [held_key, *ids], np.vstack([held[None], total])
            held_key, held = ids[-1], total[-1].copy()
            if len(ids) > 1:
                yield pd.DataFrame({**{c: [i[j] for i in ids[:-1]] for j, c in enumerate(keys)}, col: list(total[:-1])})
        if held_key is not None:
            yield pd.DataFrame({**{c: [held_key[j]] for j, c in enumerate(keys)}, col: [held]})

    P = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + f", {col} array<double>"
    return src.repartition(P, *keys).sortWithinPartitions(*keys).mapInPandas(add, schema)


@dataclass
class Tables:
    user_w: DataFrame
    item_w: DataFrame
    shared_w: DataFrame


def updated_users(res: DataFrame, user_w: DataFrame, cfg: StepConfig) -> DataFrame:
    """All rows of ``user_w`` after a written step output: rows of users outside the step as they are."""
    H = cfg.hidden
    done = res.where(F.col("kind") == "user").select(
        F.col("id").alias("user"), F.col("v1").alias("gate"), F.col("v2").alias("cand"),
        F.col("v3").alias("gate_ms"), F.col("v4").alias("cand_ms"))
    # Only the batch's users went through the step: users updated in their task come as
    # they are, users spread over several tasks (split_users) send partial gradients that
    # are summed and applied by a join, and every other user keeps its row (anti-join).
    cols = ["user", "gate", "cand", "gate_ms", "cand_ms"]
    changed = done
    if cfg.split_users and not cfg.carry:
        ug = res.where(F.col("kind") == "user_grad").select("id", F.concat("v1", "v2").alias("v1"))
        ug = sum_arrays(ug, "id").select(F.col("id").alias("user"), F.slice("v1", 1, 2 * H * H).alias("g_gate"),
                                         F.slice("v1", 2 * H * H + 1, H * H).alias("g_cand"))
        multi = user_w.join(ug, "user")
        multi = with_rmsprop(multi, "gate", "g_gate", "gate_ms", cfg.lr, cfg.rho, cfg.eps)
        multi = with_rmsprop(multi, "cand", "g_cand", "cand_ms", cfg.lr, cfg.rho, cfg.eps)
        changed = done.unionByName(multi.select(*cols))
    rest = user_w.select(*cols).join(changed.select("user"), "user", "left_anti")
    return rest.unionByName(changed.select(*cols))


def updated_shared(spark: SparkSession, res: DataFrame, t: Tables, cfg: StepConfig) -> tuple[DataFrame, DataFrame, dict]:
    """The item and bias tables after a written step output (lazy), and the step's statistics."""
    H = cfg.hidden
    gi = sum_arrays(res.where(F.col("kind") == "item").select("id", "v1"), "id")
    gi = gi.select(F.col("id").alias("item"), F.slice("v1", 1, 2 * H).alias("g_gate_in"),
                   F.slice("v1", 2 * H + 1, H).alias("g_cand_in"), F.slice("v1", 3 * H + 1, H).alias("g_out"))
    # the summed gradients have one row per item: broadcast only under the item-table bound
    small = (cfg.num_items + 1) * 4 * H * 8 <= (cfg.shared_bytes or MAX_SHARED_BYTES)
    it = t.item_w.join(F.broadcast(gi) if small else gi, "item", "left")
    for name in ("gate_in", "cand_in", "out"):
        it = with_rmsprop(it, name, f"g_{name}", f"{name}_ms", cfg.lr, cfg.rho, cfg.eps)
    item_w = it.select("item", "gate_in", "cand_in", "out", "gate_in_ms", "cand_in_ms", "out_ms")
    # bias partials and loss statistics: one row per task each, summed in one small job
    small_rows = res.where(F.col("kind").isin("bias", "stat")).select("kind", "v1", "loss", "cnt", "hits").collect()
    gbv = [0.0] * (3 * H)
    tot = {"loss": 0.0, "cnt": 0.0, "hits": 0.0}
    for r in small_rows:
        if r["kind"] == "bias" and r["v1"] is not None:
            gbv = [a + b for a, b in zip(gbv, r["v1"])]
        elif r["kind"] == "stat":
            for k in tot:
                tot[k] += r[k] or 0.0
    g_rows = [("gate_bias", gbv[:2 * H]), ("cand_bias", gbv[2 * H:])]
    g_df = spark.createDataFrame(g_rows, "name STRING, g ARRAY<DOUBLE>")
    sw = with_rmsprop(t.shared_w.join(g_df, "name", "left"), "v", "g", "ms", cfg.lr, cfg.rho, cfg.eps)
    return item_w, sw.select("name", "v", "ms"), {"loss": tot["loss"], "n": tot["cnt"], "hits": tot["hits"]}


def apply_step(spark: SparkSession, res: DataFrame, t: Tables, cfg: StepConfig,
               workdir: str | None = None) -> tuple[Tables, dict]:
    """Add up the partial gradients of a written step output and update all tables; returns the
    new tables (written and read back) and the step statistics."""
    up = scratch_path(spark, "user_w", workdir)
    updated_users(res, t.user_w, cfg).write.mode("overwrite").parquet(up)
    user_w = spark.read.parquet(up)
    item_w, shared_w, stat = updated_shared(spark, res, t, cfg)
    ip, sp = scratch_path(spark, "item_w", workdir), scratch_path(spark, "shared_w", workdir)
    item_w.write.mode("overwrite").parquet(ip)
    shared_w.write.mode("overwrite").parquet(sp)
    return Tables(user_w, spark.read.parquet(ip), spark.read.parquet(sp)), stat


def train_step(spark: SparkSession, rows: DataFrame, t: Tables, cfg: StepConfig,
               window_len: int, workdir: str | None = None, n_windows: int | None = None) -> tuple[Tables, dict]:
    """M6: one synchronous step over the windows in ``rows`` (user, seg, pos, item, target).
    Returns the new tables and the step's statistics (summed loss, targets, hits, windows).
    Every table the step writes goes below ``workdir`` (default: the checkpoint folder).
    ``n_windows`` is the number of windows in ``rows``, where the caller has it.
    Above the item-table bound the step runs without holding the table
    (:mod:`seqwright.model.training_blocked`)."""
    limit = cfg.shared_bytes or MAX_SHARED_BYTES
    if (cfg.num_items + 1) * 4 * cfg.hidden * 8 > limit:
        from seqwright.model.training_blocked import train_step_blocked
        return train_step_blocked(spark, rows, t, cfg, window_len, limit, workdir)
    if n_windows is None:
        n_windows = rows.select("user", "seg").distinct().count()
    if n_windows == 0:
        return t, {"loss": 0.0, "n": 0.0, "hits": 0.0, "windows": 0}
    scale = 1.0 / (n_windows * window_len)
    out = step_frame(spark, rows, t.user_w, t.item_w, t.shared_w, cfg, scale)
    path = scratch_path(spark, "step", workdir)
    out.write.mode("overwrite").partitionBy("kind").parquet(path)
    res = spark.read.parquet(path)
    new, st = apply_step(spark, res, t, cfg, workdir)
    st["windows"] = n_windows
    st["objective"] = st["loss"] * scale
    return new, st


def scheduled_lr(step: int, lr0: float, total_steps: int, warmup_steps: int = 0) -> float:
    """F8 for the driver loop (same rule as ``functions.math.lr_schedule``): linear warm-up
    to ``lr0``, then linear decay to 0 at ``total_steps``."""
    if warmup_steps and step < warmup_steps:
        return lr0 * step / warmup_steps
    return lr0 * (1.0 - min(step, total_steps) / total_steps)


def fit(spark: SparkSession, train_windows: DataFrame, valid_rows: DataFrame | None, t: Tables,
        cfg: StepConfig, *, window_len: int, epochs: int, n_batches: int, steps_per_epoch: int | None,
        validation_steps: int | None = None, schedule: tuple[int, int] | None = None,
        seed: int = 0, log_path: str | None = None):
    """Epochs of seeded batches, a validation pass per epoch, a metrics history.

    ``train_windows`` has (user, seg, pos, item, target); batches are drawn per epoch by
    hashing ``(seed, epoch, user, seg)`` (``(seed, epoch, user)`` with state carry, so a
    user's chunks stay together) and visited in a seeded order (O3-O6), at most
    ``steps_per_epoch`` of them; if there are more steps than batches, the epoch goes on with
    further passes, each in an order of its own. ``valid_rows`` are scored after each epoch; with
    ``validation_steps`` only that many seeded validation batches are scored. With state
    carry (``cfg.carry``) validation starts from each user's state at the end of its
    training windows (saved as a table), as one continuous sequence would.
    ``schedule=(total_steps, warmup_steps)`` drives the learning rate from ``cfg.lr`` by
    the global step (F8); the step advances on every update. Each step writes below its
    own folder, and the previous step's folder is removed once the next step is done, so
    storage holds one generation of tables, not one per step. Returns the final tables and
    the path of the metrics history (epoch, step, split, log_loss, accuracy, n, seconds, lr, macro_log_loss). A train row's
    ``log_loss`` is the step's objective, a valid row's the mean over positions; its
    ``macro_log_loss`` is the mean over sequences of cost over length."""
    from dataclasses import replace

    from seqwright.model.scoring import final_states, score
    from seqwright.operators.batching import batch_ids, epoch_order

    log_path = log_path or scratch_path(spark, "fit_log")
    # written once: every step and validation pass starts from files, not from the lineage
    # that derived the windows from the raw interactions
    cols = ["user", "seg", "pos", "item", "target"]
    tp = scratch_path(spark, "train_windows")
    scratch = [tp]   # tables of this fit that nothing needs after it
    train_windows.select(*cols).write.mode("overwrite").parquet(tp)
    train_windows = spark.read.parquet(tp)
    if valid_rows is not None:
        vp = scratch_path(spark, "valid_rows")
        scratch.append(vp)
        valid_rows.select(*cols).write.mode("overwrite").parquet(vp)
        valid_rows = spark.read.parquet(vp)
    log = []
    gstep = 0
    prev_dir = None   # working folder of the step whose tables are current
    for epoch in range(1, epochs + 1):
        # with state carry a batch holds whole users (all their chunks, in order), as the
        # carried state needs; otherwise windows are drawn into batches independently
        bw = batch_ids(train_windows, n_batches, seed, epoch, ("user",) if cfg.carry else ("user", "seg"))
        # the epoch's windows, one folder per batch: a step reads its own batch only, and the
        # batches' window counts come from one pass
        epoch_dir = scratch_path(spark, f"epoch{epoch:04d}")
        bw.repartition("batch_id", "user").write.partitionBy("batch_id").parquet(epoch_dir)
        bw = spark.read.parquet(epoch_dir)
        sizes = {r["batch_id"]: r["n"] for r in bw.select("batch_id", "user", "seg").distinct().groupBy("batch_id").agg(
            F.count(F.lit(1)).alias("n")).collect()}   # n_batches rows
        ids = spark.createDataFrame([(int(b),) for b in sizes], "batch_id BIGINT")
        order = [r["batch_id"] for r in epoch_order(ids, seed, epoch).orderBy("step").collect()]
        if steps_per_epoch is not None:
            again = 1
            while order and len(order) < steps_per_epoch:   # further passes, each in an order of its own
                more = epoch_order(ids, seed, f"{epoch}.{again}").orderBy("step").collect()
                order += [r["batch_id"] for r in more]
                again += 1
            order = order[:steps_per_epoch]
        for step, batch in enumerate(order, 1):
            t0 = time.time()
            gstep += 1
            lr = scheduled_lr(gstep, cfg.lr, *schedule) if schedule else cfg.lr
            rows = bw.where(F.col("batch_id") == batch).drop("batch_id")
            step_dir = scratch_path(spark, f"step{gstep:06d}")
            t, st = train_step(spark, rows, t, replace(cfg, lr=lr), window_len, step_dir, n_windows=sizes[batch])
            if prev_dir is not None:      # superseded: the new tables were read from step_dir
                remove_path(spark, prev_dir)
            prev_dir = step_dir
            log.append((epoch, step, "train", float(st["objective"]),
                        float(st["hits"] / st["n"]) if st["n"] else None, int(st["n"]), time.time() - t0, lr, None))
        remove_path(spark, epoch_dir)
        if valid_rows is not None:
            t0 = time.time()
            vr = valid_rows
            if validation_steps is not None:
                vb = batch_ids(vr, n_batches, seed, epoch, ("user", "seg"))
                keep = epoch_order(vb.select("batch_id").distinct(), seed, epoch).where(
                    F.col("step") <= validation_steps).select("batch_id")
                vr = vb.join(F.broadcast(keep), "batch_id").drop("batch_id")  # <= validation_steps rows
            init = None
            if cfg.carry:
                # validation continues from each user's state at the end of its training data
                tr = score(spark, train_windows, t.user_w, t.item_w, t.shared_w, num_items=cfg.num_items,
                           hidden=cfg.hidden, carry=True, reset_gate=cfg.reset_gate, act=cfg.act,
                           shared_bytes=cfg.shared_bytes)
                sp = scratch_path(spark, "train_state")
                scratch.append(sp)
                final_states(tr).write.mode("overwrite").parquet(sp)
                init = spark.read.parquet(sp)
            sc = score(spark, vr, t.user_w, t.item_w, t.shared_w, num_items=cfg.num_items,
                       hidden=cfg.hidden, carry=cfg.carry, reset_gate=cfg.reset_gate, act=cfg.act,
                       init_state=init, shared_bytes=cfg.shared_bytes, emit_states=False)
            real = F.col("target") > 0
            loss = F.when(real, F.col("lse") - F.col("tlogit"))
            hit = F.when(real, (F.col("argmax") == F.col("target")).cast("double"))
            # per sequence first: cost over length, then the mean over sequences beside the mean
            # over positions
            per = sc.groupBy("user", "seg").agg(F.sum(loss).alias("c"), F.sum(hit).alias("h"), F.count(loss).alias("k"),
                                                F.count(F.lit(1)).alias("len"))
            m = per.agg(F.try_divide(F.sum("c"), F.sum("k")).alias("l"), F.try_divide(F.sum("h"), F.sum("k")).alias("a"),
                        F.sum("k").alias("n"), F.avg(F.coalesce("c", F.lit(0.0)) / F.col("len")).alias("macro")).first()
            log.append((epoch, 0, "valid", m["l"], m["a"], int(m["n"]), time.time() - t0, None, m["macro"]))
    df = spark.createDataFrame(log, "epoch INT, step INT, split STRING, log_loss DOUBLE, accuracy DOUBLE, "
                                    "n BIGINT, seconds DOUBLE, lr DOUBLE, macro_log_loss DOUBLE")
    df.write.mode("overwrite").parquet(log_path)
    for path in scratch:
        remove_path(spark, path)
    return t, log_path
