"""Registered queries of the fits over a bucketed weight store (M4, M6, M10, F9) and their SQL twins."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from seqwright.functions import math as M
from seqwright.model import weights as Wt
from seqwright.operators import batching as B
from seqwright.operators import sequences as S
from seqwright.plans.catalog import N_BATCHES, ORDER_SQL, SEED, WIN_SQL, WINDOW, _hash_sql, query, seq_frame, window_keys
from seqwright.plans.model_catalog import FOLD_SQL, GRAD_SQL, H, _first_batch, _h, _model, _train_setup
from seqwright.session import scratch_path


def _replaced(sql: str, old: str, new: str) -> str:
    if sql.count(old) != 1:
        raise ValueError(f"not once in the SQL: {old}")
    return sql.replace(old, new)


# ---------------------------------------------------------------- M6: all tables of a step
FORMULA_SQL = {"gate_u": "sin(id * 7 + (j // 4) * 3 + (j % 4) * 5) / 2", "cand_u": "sin(id * 7 + (j // 2) * 3 + (j % 2) * 5 + 1) / 2"}


@query("train_step_users", GRAD_SQL + f""",
us AS (SELECT DISTINCT "user" AS id FROM seq),
w AS (SELECT 'gate_u' AS param, id, CAST(unnest(range(0, 8)) AS BIGINT) AS j FROM us
      UNION ALL SELECT 'cand_u', id, CAST(unnest(range(0, 4)) AS BIGINT) FROM us)
SELECT param, id, j, round(CASE WHEN param = 'gate_u' THEN {FORMULA_SQL["gate_u"]} ELSE {FORMULA_SQL["cand_u"]} END
       - 0.01 * coalesce(g, 0) / sqrt(0.1 * coalesce(g, 0) * coalesce(g, 0) + 1e-8), 6) + 0.0 AS w,
       round(0.1 * coalesce(g, 0) * coalesce(g, 0), 9) + 0.0 AS ms
FROM w LEFT JOIN grad USING (param, id, j)""")
def q_train_step_users(spark, sf_dir):
    """M6/M7: the user tables after one RMSProp step through the bucketed store, in long form with their
    accumulators; users without a window keep their weights."""
    from seqwright.model.bucket_fit import bucket_step
    from seqwright.model.store import WeightStore
    train, _, t, cfg = _train_setup(spark, sf_dir)
    rows = _first_batch(train)
    n = rows.select("user", "seg").distinct().count()
    store = WeightStore.create(spark, scratch_path(spark, "weights"), t, 8)
    bucket_step(spark, rows, store, list(range(8)), cfg, 1.0 / (n * WINDOW))
    u = store.users()
    parts = [u.select(F.lit(name).alias("param"), F.col("user").alias("id"), F.posexplode(F.arrays_zip(c, f"{c}_ms")).alias("j", "z"))
             .select("param", "id", F.col("j").cast("bigint").alias("j"), F.col(f"z.{c}").alias("w"), F.col(f"z.{c}_ms").alias("ms"))
             for name, c in (("gate_u", "gate"), ("cand_u", "cand"))]
    out = parts[0].unionByName(parts[1])
    return out.select("param", "id", "j", (F.round("w", 6) + F.lit(0.0)).alias("w"), (F.round("ms", 9) + F.lit(0.0)).alias("ms"))


# ---------------------------------------------------------------- M10/M4: updates after every chunk
# The first chunk of every user as a batch of its own: gradients, RMSProp, and from the states that the old
# weights left a second chunk through the new weights, which are tables now.
_FIRST = _replaced(_replaced(GRAD_SQL, f"WHERE pos <= n // 2 AND ((pos - 1) // {WINDOW} + 1) * {WINDOW} <= n)", f"WHERE pos <= {WINDOW})"),
                   "(SELECT DISTINCT usr, chunk FROM tw)", "(SELECT DISTINCT usr FROM tw)")


def _step_sql(w: str, g: str) -> str:
    return f"{w} - 0.01 * {g} / sqrt(0.1 * {g} * {g} + 1e-8)"


CHUNK_SQL = _FIRST + f""",
uw AS (SELECT usr, [{_step_sql("sin(usr * 7 + (j // 4) * 3 + (j % 4) * 5) / 2", "g[j + 1]")} for j in range(0, 8)] AS g,
              [{_step_sql("sin(usr * 7 + (j // 2) * 3 + (j % 2) * 5 + 1) / 2", "c[j + 1]")} for j in range(0, 4)] AS c FROM ug),
iw AS (SELECT i, [{_step_sql("CASE WHEN j < 4 THEN cos(i * 3 + j * 2) WHEN j < 6 THEN cos(i * 3 + (j - 4) * 2 + 1) ELSE cos(i * 3 + (j - 6) * 2 + 2) END / 2",
                             "g[j + 1]")} for j in range(0, 8)] AS v FROM ig),
bb AS (SELECT [{_step_sql("CASE WHEN j < 4 THEN 1.0 ELSE 0.0 END", "g[j + 1]")} for j in range(0, 6)] AS b FROM bg),
ends AS (SELECT usr, arg_max(h0, t) AS h0, arg_max(h1, t) AS h1 FROM st GROUP BY usr),
tw2 AS (SELECT "user" AS usr, pos - {WINDOW} - 1 AS t, item, target FROM seq WHERE pos > {WINDOW} AND pos <= {2 * WINDOW}),
fw2(usr, t, h0, h1) AS (
  SELECT usr, CAST(-1 AS BIGINT), h0, h1 FROM ends
  UNION ALL
  SELECT usr, t, u0 * h0 + (1 - u0) * c0, u1 * h1 + (1 - u1) * c1 FROM (
    SELECT r.usr, s.t, r.h0, r.h1, 1 / (1 + exp(-(r.h0 * uw.g[3] + r.h1 * uw.g[7] + bb.b[3] + iw.v[3]))) AS u0,
           1 / (1 + exp(-(r.h0 * uw.g[4] + r.h1 * uw.g[8] + bb.b[4] + iw.v[4]))) AS u1,
           tanh(r.h0 * uw.c[1] + r.h1 * uw.c[3] + bb.b[5] + iw.v[5]) AS c0, tanh(r.h0 * uw.c[2] + r.h1 * uw.c[4] + bb.b[6] + iw.v[6]) AS c1
    FROM fw2 r JOIN tw2 s ON s.usr = r.usr AND s.t = r.t + 1 JOIN uw ON uw.usr = r.usr JOIN iw ON iw.i = s.item CROSS JOIN bb)),
lg2 AS (SELECT f.usr, f.t, s.target, iw.i, f.h0 * iw.v[7] + f.h1 * iw.v[8] AS logit
        FROM fw2 f JOIN tw2 s ON s.usr = f.usr AND s.t = f.t CROSS JOIN iw WHERE f.t >= 0),
sm2 AS (SELECT usr, t, target, max(logit) AS mx, arg_max(i, logit) AS am, max(CASE WHEN i = target THEN logit END) AS tl FROM lg2 GROUP BY ALL),
ls2 AS (SELECT sm2.usr, sm2.t, sm2.target, sm2.am, sm2.tl, sm2.mx + ln(sum(exp(logit - sm2.mx))) AS lse
        FROM lg2 JOIN sm2 USING (usr, t) GROUP BY sm2.usr, sm2.t, sm2.target, sm2.mx, sm2.am, sm2.tl),
two AS (SELECT 1 AS step, 0 AS chunk, target, lse, tl, am FROM ls JOIN st USING (usr, chunk, t)
         UNION ALL SELECT 2, 1, target, lse, tl, am FROM ls2)
SELECT 1 AS epoch, step, CAST(chunk AS BIGINT) AS chunk, round(sum(CASE WHEN target > 0 THEN lse - tl ELSE 0 END) * max(scale), 6) AS log_loss,
       round(avg(CASE WHEN target > 0 THEN CASE WHEN am = target THEN 1.0 ELSE 0.0 END END), 6) AS accuracy,
       CAST(count(CASE WHEN target > 0 THEN 1 END) AS BIGINT) AS n FROM two, sca GROUP BY step, chunk"""


@query("fit_chunk_history", CHUNK_SQL)
def q_fit_chunk_history(spark, sf_dir):
    """A session over every user's first two chunks of 16: the weights change after the first chunk, and
    the second one starts from the states the first one left."""
    from seqwright.model.bucket_fit import fit_buckets
    from seqwright.model.training import StepConfig, Tables
    seq = seq_frame(spark, sf_dir)
    num_items = int(seq.agg(F.max("item")).first()[0])
    rows = S.tumbling_windows(seq, WINDOW, tail="keep").where(F.col("chunk") < 2).select(
        "user", F.col("chunk").alias("seg"), "pos", "item", "target")
    t = Tables(Wt.user_weights(seq, H, "formula"), Wt.item_weights(spark, num_items, H, "formula"), Wt.shared_weights(spark, H))
    cfg = StepConfig(hidden=H, num_items=num_items, lr=0.01, carry=True)
    _, log, _ = fit_buckets(spark, rows, None, t, cfg, window_len=WINDOW, epochs=1, n_batches=1, update_every="chunk", n_buckets=8, seed=SEED)
    return spark.read.parquet(log).select("epoch", "step", "chunk", M.round6("log_loss").alias("log_loss"),
                                          M.round6("accuracy").alias("accuracy"), "n")


# ---------------------------------------------------------------- F9: measured progress
PROGRESS_BATCHES, PROGRESS_BUCKETS = 4, 32


@query("fit_progress", WIN_SQL + f""",
b AS (SELECT {_hash_sql("bucket:0", '"user"')} % {PROGRESS_BUCKETS} AS bucket, count(*) AS k FROM win GROUP BY ALL),
g AS (SELECT {_hash_sql(f"{SEED}:1", "bucket")} % {PROGRESS_BATCHES} AS g, sum(k) AS k FROM b GROUP BY ALL),
c AS (SELECT sum(k) OVER (ORDER BY md5(concat_ws(':', '{SEED}', 'order', '1', CAST(g AS VARCHAR))), g) AS seen, sum(k) OVER () AS total FROM g)
SELECT 1 AS epoch, CAST(tenth AS INTEGER) AS tenth, CAST(min(seen) AS BIGINT) AS triplets, CAST(max(total) AS BIGINT) AS total, true AS measured
FROM c, unnest(range(1, 11)) AS t(tenth) WHERE seen * 10 >= tenth * total GROUP BY tenth""")
def q_fit_progress(spark, sf_dir):
    """the report for every tenth of an epoch, written while it runs; seconds and triplets per second
    are measured (``measured`` says that they are there)."""
    from seqwright.model.bucket_fit import fit_buckets
    from seqwright.model.training import StepConfig, Tables
    seq = seq_frame(spark, sf_dir)
    num_items = int(seq.agg(F.max("item")).first()[0])
    rows = S.tumbling_windows(seq, WINDOW).select("user", F.col("chunk").alias("seg"), "pos", "item", "target")
    t = Tables(Wt.user_weights(seq, H, "formula"), Wt.item_weights(spark, num_items, H, "formula"), Wt.shared_weights(spark, H))
    _, _, progress = fit_buckets(spark, rows, None, t, StepConfig(hidden=H, num_items=num_items, lr=0.01), window_len=WINDOW, epochs=1,
                                 n_batches=PROGRESS_BATCHES, n_buckets=PROGRESS_BUCKETS, seed=SEED)
    measured = (F.col("seconds") > 0) & (F.abs(F.col("wps") * F.col("seconds") - F.col("triplets")) < 1e-3)
    return spark.read.parquet(progress).select("epoch", "tenth", "triplets", "total", measured.alias("measured"))


# ---------------------------------------------------------------- J1/M1: scoring without an exchange
@query("score_states_bucketed", FOLD_SQL + """
SELECT "user", pos, round(h0, 6) AS h0, round(h1, 6) AS h1, round(lse, 6) AS lse, argmax FROM sc""")
def q_score_states_bucketed(spark, sf_dir):
    """States from a merge join of sequences and user weights that are bucketed alike."""
    from seqwright.model import scoring_bucketed as SB
    seq, num_items, uw, iw, sw = _model(spark, sf_dir)
    rows = seq.select("user", F.lit(0).alias("seg"), "pos", "item", "target", "n")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sc = SB.score_bucketed(spark, SB.bucketed_sequences(rows, n, piece=16), SB.bucketed_users(uw, n), iw, sw, num_items=num_items, hidden=H)
    return sc.select("user", "pos", *_h(), M.round6("lse").alias("lse"), "argmax")


# ---------------------------------------------------------------- S4/O7: passes as a stream
@query("stream_passes", ORDER_SQL + """
SELECT o.epoch, o.step, o.batch_id, b."user", b.chunk FROM ord o JOIN bat b USING (batch_id)""")
def q_stream_passes(spark, sf_dir):
    """Two passes over the stored batches, handed out step by step by a stream, with a stop after the first
    three steps or so and a restart from its checkpoint."""
    from seqwright.streaming import passes
    rows = B.batch_ids(window_keys(spark, sf_dir), N_BATCHES, SEED, 1)
    path, out, mark = (scratch_path(spark, n) for n in ("batches", "passes", "passes-checkpoint"))
    passes.store_batches(rows, path)
    seen = []
    write = passes.write_steps(out)

    def some(df, epoch, step):
        write(df, epoch, step)
        seen.append(step)

    first = passes.start_passes(spark, path, some, mark, seed=SEED, epochs=2)
    while len(seen) < 3 and first.isActive:
        time.sleep(0.05)
    first.stop()
    again = passes.start_passes(spark, path, write, mark, seed=SEED, epochs=2)
    try:
        again.processAllAvailable()
    finally:
        again.stop()
    back = spark.read.schema("user BIGINT, chunk BIGINT, batch_id BIGINT, epoch INT, step BIGINT").parquet(out)
    return back.select("epoch", "step", "batch_id", "user", "chunk")


# ---------------------------------------------------------------- M4: a relay of segments
@query("carry_state_relay", FOLD_SQL + """
SELECT "user", pos, round(h0, 6) AS h0, round(h1, 6) AS h1 FROM sc""")
def q_carry_state_relay(spark, sf_dir):
    """M4: users above 40 positions in segments of 40, each job starting from the states the job before saved."""
    from seqwright.model.relay import score_relay
    seq, num_items, uw, iw, sw = _model(spark, sf_dir)
    rows = seq.select("user", F.lit(0).alias("seg"), "pos", "item", "target", "n")
    return score_relay(spark, rows, uw, iw, sw, segment=40, num_items=num_items, hidden=H).select("user", "pos", *_h())
