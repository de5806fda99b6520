"""Registered queries of the functions, metrics and model jobs (F1-F8, P7, A3-A8, J1, J2,
M1-M5, M7, M9) and their SQL twins.

Model queries use H = 2 and the ``formula`` initialiser so that DuckDB can
reproduce every state with a recursive CTE over ``(user, pos)``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from seqwright.functions import math as M
from seqwright.functions import metrics as X
from seqwright.model import scoring
from seqwright.model import weights as Wt
from seqwright.operators import batching as B
from seqwright.operators import lookup as L
from seqwright.operators import sequences as S
from seqwright.plans.catalog import (CHUNK, EV_SQL, N_BATCHES, ORDER_SQL, SEED, SEQ_SQL, WINDOW, _epoch_orders, query, seq_frame,
                                     window_frame, window_keys)
from seqwright.sources.tables import table

H = 2

# ---------------------------------------------------------------- SQL of the cell (H = 2)


def _gate_pre(h0: str, h1: str, usr: str, item: str, c: int) -> str:
    return (f"({h0} * sin({usr} * 7 + {c} * 5) / 2 + {h1} * sin({usr} * 7 + 3 + {c} * 5) / 2"
            f" + 1 + cos({item} * 3 + {c} * 2) / 2)")


def _cand_pre(h0: str, h1: str, usr: str, item: str, k: int) -> str:
    return (f"({h0} * sin({usr} * 7 + {k} * 5 + 1) / 2 + {h1} * sin({usr} * 7 + 3 + {k} * 5 + 1) / 2"
            f" + cos({item} * 3 + {k} * 2 + 1) / 2)")


def _step_sql(src: str, join: str, keys: str, reset_gate: bool = False, act: str = "tanh") -> str:
    """One recursive step: new state from the previous one (``r``) and the event (``s``).
    With ``reset_gate`` the candidate sees the state scaled by the reset gate."""
    u0 = f"1 / (1 + exp(-{_gate_pre('r.h0', 'r.h1', 'r.usr', 's.item', 2)}))"
    u1 = f"1 / (1 + exp(-{_gate_pre('r.h0', 'r.h1', 'r.usr', 's.item', 3)}))"
    h0, h1 = "r.h0", "r.h1"
    if reset_gate:
        r0 = f"1 / (1 + exp(-{_gate_pre('r.h0', 'r.h1', 'r.usr', 's.item', 0)}))"
        r1 = f"1 / (1 + exp(-{_gate_pre('r.h0', 'r.h1', 'r.usr', 's.item', 1)}))"
        h0, h1 = f"(r.h0 * {r0})", f"(r.h1 * {r1})"
    wrap = {"tanh": "tanh({})", "relu": "greatest({}, 0)", "sigmoid": "1 / (1 + exp(-{}))"}[act]
    c0 = wrap.format(_cand_pre(h0, h1, 'r.usr', 's.item', 0))
    c1 = wrap.format(_cand_pre(h0, h1, 'r.usr', 's.item', 1))
    return (f"SELECT {keys}, u0 * h0 + (1 - u0) * c0 AS h0, u1 * h1 + (1 - u1) * c1 AS h1 FROM ("
            f"SELECT {', '.join('r.usr' if k == 'usr' else 's.' + k for k in keys.split(', '))}, r.h0, r.h1, "
            f"{u0} AS u0, {u1} AS u1, {c0} AS c0, {c1} AS c1 FROM {src} {join})")


FOLD_SQL = SEQ_SQL.replace("WITH ev AS", "WITH RECURSIVE ev AS", 1) + """,
rec(usr, pos, h0, h1) AS (
  SELECT DISTINCT "user", CAST(0 AS BIGINT), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM seq
  UNION ALL
  """ + _step_sql("rec r", 'JOIN seq s ON s."user" = r.usr AND s.pos = r.pos + 1', "usr, pos") + """),
st AS (SELECT r.usr, r.pos, r.h0, r.h1, s.item, s.target, s.n FROM rec r
       JOIN seq s ON s."user" = r.usr AND s.pos = r.pos),
items AS (SELECT CAST(range AS BIGINT) AS item FROM range(0, (SELECT max(item) FROM ev) + 1)),
lg AS (SELECT st.usr, st.pos, items.item,
              st.h0 * cos(items.item * 3 + 2) / 2 + st.h1 * cos(items.item * 3 + 4) / 2 AS logit
       FROM st, items),
ag AS (SELECT usr, pos, max(logit) AS mx, arg_max(item, logit) AS am FROM lg GROUP BY ALL),
sm AS (SELECT lg.usr, lg.pos, ag.mx + ln(sum(exp(lg.logit - ag.mx))) AS lse FROM lg JOIN ag USING (usr, pos)
       GROUP BY lg.usr, lg.pos, ag.mx),
sc AS (SELECT st.usr AS "user", st.pos, st.n, st.target, st.h0, st.h1, sm.lse, lg.logit AS tlogit,
              ag.am AS argmax, ag.mx AS maxlogit, sm.lse - lg.logit AS loss,
              CASE WHEN st.target > 0 THEN sm.lse - lg.logit ELSE 0 END AS masked,
              CASE WHEN ag.am = st.target THEN 1 ELSE 0 END AS hit,
              CASE WHEN st.pos <= st.n // 2 THEN 'train' ELSE 'valid' END AS split
       FROM st JOIN sm USING (usr, pos) JOIN ag USING (usr, pos)
       JOIN lg ON lg.usr = st.usr AND lg.pos = st.pos AND lg.item = st.target)"""


def _model(spark, sf_dir):
    seq = seq_frame(spark, sf_dir)
    num_items = int(seq.agg(F.max("item")).first()[0])
    uw = Wt.user_weights(seq, H, "formula")
    iw = Wt.item_weights(spark, num_items, H, "formula")
    sw = Wt.shared_weights(spark, H)
    return seq, num_items, uw, iw, sw


def _scored(spark, sf_dir, states=False, **kw):
    """The scored positions of the whole sequences (``h`` only with ``states=True``)."""
    seq, num_items, uw, iw, sw = _model(spark, sf_dir)
    rows = seq.select("user", F.lit(0).alias("seg"), "pos", "item", "target", "n")
    sc = scoring.score(spark, rows, uw, iw, sw, num_items=num_items, hidden=H, emit_states=states, **kw)
    sc = sc.withColumn("split", F.when(F.col("pos") <= F.floor(F.col("n") / 2), "train").otherwise("valid"))
    return X.with_loss(sc)


def _h():
    return [M.round6(F.col("h")[0]).alias("h0"), M.round6(F.col("h")[1]).alias("h1")]


# ---------------------------------------------------------------- M1-M5
@query("score_states", FOLD_SQL + """
SELECT "user", pos, round(h0, 6) AS h0, round(h1, 6) AS h1 FROM sc""")
def q_score_states(spark, sf_dir):
    """M1: fold the cell over each user's ordered items (state carried over the whole sequence)."""
    return _scored(spark, sf_dir, states=True).select("user", "pos", *_h())


@query("score_states_blocked", FOLD_SQL + """
SELECT "user", pos, round(h0, 6) AS h0, round(h1, 6) AS h1, round(lse, 6) AS lse, round(tlogit, 6) AS tlogit,
       argmax FROM sc""")
def q_score_states_blocked(spark, sf_dir):
    """M1/M2 above the item-table bound: input vectors joined, output rows in blocks of 16."""
    sc = _scored(spark, sf_dir, states=True, shared_bytes=8 * H * 16)
    return sc.select("user", "pos", *_h(), M.round6("lse").alias("lse"), M.round6("tlogit").alias("tlogit"), "argmax")


@query("next_item_logits", FOLD_SQL + """
SELECT "user", pos, target, round(lse, 6) AS lse, round(tlogit, 6) AS tlogit, argmax,
       round(maxlogit, 6) AS maxlogit FROM sc""")
def q_next_item_logits(spark, sf_dir):
    """Item logits per position, reduced to log-sum-exp, target logit and arg-max."""
    sc = _scored(spark, sf_dir)
    return sc.select("user", "pos", "target", M.round6("lse").alias("lse"), M.round6("tlogit").alias("tlogit"),
                     "argmax", M.round6("maxlogit").alias("maxlogit"))


@query("masked_loss", FOLD_SQL + """
SELECT "user", pos, target, round(masked, 6) AS masked_loss FROM sc""")
def q_masked_loss(spark, sf_dir):
    """Loss times sign(target): padding targets (0) cost nothing."""
    return _scored(spark, sf_dir).select("user", "pos", "target", M.round6("masked").alias("masked_loss"))


@query("sequence_loss", FOLD_SQL + f"""
SELECT "user", CAST((pos - 1) // {CHUNK} AS BIGINT) AS chunk, round(sum(masked), 6) AS cost,
       CAST(count(*) AS INTEGER) AS seq_len FROM sc GROUP BY ALL""")
def q_sequence_loss(spark, sf_dir):
    """A3: masked loss summed per sequence chunk of 64, with the chunk's true length."""
    sc = _scored(spark, sf_dir).withColumn("chunk", F.floor((F.col("pos") - 1) / CHUNK).cast("bigint"))
    return X.sequence_loss(sc).select("user", "chunk", M.round6("cost").alias("cost"), "seq_len")


@query("sequence_error", FOLD_SQL + """
SELECT "user", round(sum(masked) / count(*), 6) AS error FROM sc GROUP BY ALL""")
def q_sequence_error(spark, sf_dir):
    """A4: sum of chunk costs over sum of chunk lengths, per user."""
    sc = _scored(spark, sf_dir).withColumn("chunk", F.floor((F.col("pos") - 1) / CHUNK).cast("bigint"))
    return X.sequence_error(X.sequence_loss(sc)).select("user", M.round6("error").alias("error"))


@query("evaluate_log_loss", FOLD_SQL + """
SELECT "user", split, round(sum(masked) / count(*), 6) AS log_loss FROM sc GROUP BY ALL""")
def q_evaluate_log_loss(spark, sf_dir):
    """M3: train and valid log-loss per user with shared weights; valid continues the train state."""
    sc = _scored(spark, sf_dir)
    e = X.sequence_error(X.sequence_loss(sc, ("user", "split")), ("user", "split"))
    return e.select("user", "split", M.round6("error").alias("log_loss"))


@query("epoch_log_loss", FOLD_SQL + """
SELECT split, round(avg(e), 6) AS log_loss FROM
  (SELECT "user", split, sum(masked) / count(*) AS e FROM sc GROUP BY ALL) GROUP BY split""")
def q_epoch_log_loss(spark, sf_dir):
    """A5: macro mean of the per-user errors, per split."""
    sc = _scored(spark, sf_dir)
    e = X.sequence_error(X.sequence_loss(sc, ("user", "split")), ("user", "split"))
    return X.macro_mean(e, ["split"]).select("split", M.round6("log_loss").alias("log_loss"))


@query("mean_loss", FOLD_SQL + f""",
ch AS (SELECT *, (pos - 1) // {CHUNK} AS chunk FROM sc)
SELECT split, round(avg(CASE WHEN target > 0 THEN loss END), 6) AS mean_loss,
       round(sum(masked) / (count(DISTINCT ("user", chunk)) * {CHUNK}), 6) AS objective FROM ch GROUP BY split""")
def q_mean_loss(spark, sf_dir):
    """Position-level mean loss and the masked objective over padded chunks, per split."""
    sc = _scored(spark, sf_dir).withColumn("chunk", F.floor((F.col("pos") - 1) / CHUNK))
    m = X.mean_loss(sc, ["split"], window_len=CHUNK)
    return m.select("split", M.round6("mean_loss").alias("mean_loss"), M.round6("objective").alias("objective"))


@query("next_item_accuracy", FOLD_SQL + """
SELECT split, round(avg(CASE WHEN target > 0 THEN hit END), 6) AS accuracy,
       CAST(count(CASE WHEN target > 0 THEN 1 END) AS BIGINT) AS n FROM sc GROUP BY split""")
def q_next_item_accuracy(spark, sf_dir):
    """Arg-max of the logits equals the next item, per split."""
    a = X.accuracy(_scored(spark, sf_dir), ["split"])
    return a.select("split", M.round6("accuracy").alias("accuracy"), "n")


@query("running_metrics", FOLD_SQL + f""",
ps AS (SELECT CAST(CAST('0x' || substr(md5(concat_ws(':', '{SEED}', '1', CAST("user" AS VARCHAR),
                   CAST((pos - 1) // {CHUNK} AS VARCHAR))), 1, 8) AS BIGINT) % {N_BATCHES} + 1 AS BIGINT) AS step,
              sum(masked) AS l, count(*) AS c,
              sum(CASE WHEN target > 0 THEN hit ELSE 0 END) AS h,
              sum(CASE WHEN target > 0 THEN 1 ELSE 0 END) AS k FROM sc GROUP BY ALL)
SELECT step, round(l / c, 6) AS step_loss, round(h / k, 6) AS step_accuracy,
       round(sum(l) OVER w / sum(c) OVER w, 6) AS running_loss,
       round(sum(h) OVER w / sum(k) OVER w, 6) AS running_accuracy
FROM ps WINDOW w AS (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def q_running_metrics(spark, sf_dir):
    """Per-step metrics (reset each step) and running metrics (never reset). Chunks of 64
    positions are drawn into 8 seeded batches; step = batch id + 1, so the running window
    covers at most ``n_batches`` rows."""
    sc = _scored(spark, sf_dir).withColumn("chunk", F.floor((F.col("pos") - 1) / CHUNK).cast("bigint"))
    sc = B.batch_ids(sc, N_BATCHES, SEED, 1, ("user", "chunk")).withColumn(
        "step", (F.col("batch_id") + 1).cast("bigint"))
    real = F.col("target") > 0
    ps = sc.groupBy("step").agg(F.sum("masked").alias("l"), F.count(F.lit(1)).alias("c"),
                                F.sum(F.when(real, F.col("hit")).otherwise(0)).alias("h"),
                                F.sum(F.when(real, 1).otherwise(0)).alias("k"))
    r = X.running(ps, "step", {"loss": ("l", "c"), "accuracy": ("h", "k")})
    return r.select("step", M.round6(F.col("l") / F.col("c")).alias("step_loss"),
                    M.round6(F.col("h") / F.col("k")).alias("step_accuracy"),
                    M.round6("running_loss").alias("running_loss"),
                    M.round6("running_accuracy").alias("running_accuracy"))


@query("carry_state", FOLD_SQL + """
SELECT "user", pos, round(h0, 6) AS h0, round(h1, 6) AS h1 FROM sc WHERE split = 'valid'""")
def q_carry_state(spark, sf_dir):
    """M4: fold the train half, save the final states, resume the valid half from them; equals
    the full fold."""
    from seqwright.session import scratch_path
    seq, num_items, uw, iw, sw = _model(spark, sf_dir)
    rows = S.temporal_split(seq, train_frac=0.5).select("user", F.lit(0).alias("seg"), "pos", "item",
                                                        "target", "split")
    kw = dict(num_items=num_items, hidden=H)
    # the split sequences are written once; both folds read them
    rp = scratch_path(spark, "split_rows")
    rows.write.mode("overwrite").parquet(rp)
    rows = spark.read.parquet(rp)
    tr = scoring.score(spark, rows.where(F.col("split") == "train"), uw, iw, sw, **kw)
    # the resume point is a saved table: (user, h) after the last training position
    sp = scratch_path(spark, "train_state")
    scoring.final_states(tr).write.mode("overwrite").parquet(sp)
    state = spark.read.parquet(sp)
    va = scoring.score(spark, rows.where(F.col("split") == "valid"), uw, iw, sw, init_state=state, **kw)
    return va.select("user", "pos", *_h())


WFOLD_SQL = SEQ_SQL.replace("WITH ev AS", "WITH RECURSIVE ev AS", 1) + f""",
win AS (SELECT "user", CAST((pos - 1) // {WINDOW} AS BIGINT) AS chunk, CAST((pos - 1) % {WINDOW} AS BIGINT) AS t,
               item, target FROM seq WHERE ((pos - 1) // {WINDOW} + 1) * {WINDOW} <= n),
rec(usr, chunk, t, h0, h1) AS (
  SELECT DISTINCT "user", chunk, CAST(-1 AS BIGINT), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM win
  UNION ALL
  """ + _step_sql("rec r", 'JOIN win s ON s."user" = r.usr AND s.chunk = r.chunk AND s.t = r.t + 1',
                  "usr, chunk, t") + ")"


@query("score_windows", WFOLD_SQL + """
SELECT usr AS "user", chunk, t, round(h0, 6) AS h0, round(h1, 6) AS h1 FROM rec WHERE t >= 0""")
def q_score_windows(spark, sf_dir):
    """M5: state reset to zero at every window of 16; windows of one user may be scored by
    different tasks (weights replicated per window)."""
    seq, num_items, uw, iw, sw = _model(spark, sf_dir)
    win = S.tumbling_windows(seq, WINDOW).select("user", F.col("chunk").alias("seg"), "t",
                                                 F.col("t").alias("pos"), "item", "target")
    sc = scoring.score(spark, win, uw, iw, sw, num_items=num_items, hidden=H, carry=False, split_users=True)
    return sc.select("user", F.col("seg").alias("chunk"), F.col("pos").alias("t"), *_h())


# ---------------------------------------------------------------- J1, J2
GRID_U = "(SELECT CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c FROM range(2) a(r), range({w}) b(c))"


@query("lookup_user_weights", SEQ_SQL + f""",
wk AS (SELECT "user", count(DISTINCT (pos - 1) // {WINDOW}) AS nw FROM seq
       WHERE ((pos - 1) // {WINDOW} + 1) * {WINDOW} <= n GROUP BY ALL)
SELECT "user", CAST(nw AS BIGINT) AS n_windows,
  round((SELECT sum(sin(wk."user" * 7 + g.r * 3 + g.c * 5) / 2) FROM {GRID_U.format(w=4)} g), 6) AS gate_sum,
  round((SELECT sum(sin(wk."user" * 7 + g.r * 3 + g.c * 5 + 1) / 2) FROM {GRID_U.format(w=2)} g), 6) AS cand_sum
FROM wk""")
def q_lookup_user_weights(spark, sf_dir):
    """Per-user recurrence weights fetched by user id (shuffle join, never broadcast)."""
    wk = window_keys(spark, sf_dir).groupBy("user").agg(F.count(F.lit(1)).cast("bigint").alias("n_windows"))
    uw = Wt.user_weights(wk, H, "formula")
    j = L.lookup_user_weights(wk, uw)
    tot = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return j.select("user", "n_windows", M.round6(tot(F.col("gate"))).alias("gate_sum"),
                    M.round6(tot(F.col("cand"))).alias("cand_sum"))


@query("lookup_item_weights", SEQ_SQL + """
SELECT "user", pos, item,
  round((SELECT sum(cos(item * 3 + c * 2) / 2) FROM range(4) a(c)), 6) AS gate_in_sum,
  round((SELECT sum(cos(item * 3 + c * 2 + 1) / 2) FROM range(2) a(c)), 6) AS cand_in_sum,
  round((SELECT sum(cos(item * 3 + c * 2 + 2) / 2) FROM range(2) a(c)), 6) AS out_sum
FROM seq""")
def q_lookup_item_weights(spark, sf_dir):
    """Per-item input vectors fetched by item id (broadcast under the size bound)."""
    seq = seq_frame(spark, sf_dir)
    num_items = int(seq.agg(F.max("item")).first()[0])
    iw = Wt.item_weights(spark, num_items, H, "formula")
    j = L.lookup_item_weights(seq, iw, num_items, H)
    tot = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return j.select("user", "pos", "item", M.round6(tot(F.col("gate_in"))).alias("gate_in_sum"),
                    M.round6(tot(F.col("cand_in"))).alias("cand_in_sum"),
                    M.round6(tot(F.col("out"))).alias("out_sum"))


# ---------------------------------------------------------------- F1-F8 on the given tables
@query("scalar_math", """
SELECT event_id, round(1 / (1 + exp(-value / 10)), 6) AS sigmoid, round(tanh(value / 10), 6) AS tanh,
       CAST(sign(value - 25) AS DOUBLE) AS sign FROM events""")
def q_scalar_math(spark, sf_dir):
    """Sigmoid, tanh and sign on event values."""
    ev = table(spark, sf_dir, "events")
    v = F.col("value")
    return ev.select("event_id", M.round6(M.sigmoid(v / 10)).alias("sigmoid"), M.round6(M.tanh(v / 10)).alias("tanh"),
                     M.sign(v - 25).cast("double").alias("sign"))


EMB_SQL = """WITH x AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v,
                  unnest(range(1, len(embedding) + 1)) AS j FROM embeddings),
m AS (SELECT vec_id, max(v) AS mx, arg_max(j, v) - 1 AS am FROM x GROUP BY vec_id),
z AS (SELECT vec_id, m.mx + ln(sum(exp(v - m.mx))) AS lse FROM x JOIN m USING (vec_id) GROUP BY vec_id, m.mx)"""


@query("softmax_loss", EMB_SQL + """
SELECT x.vec_id, x.label, round(z.lse - x.v, 6) AS loss, CAST(m.am AS BIGINT) AS argmax
FROM x JOIN z USING (vec_id) JOIN m USING (vec_id) WHERE x.j = x.label + 1""")
def q_softmax_loss(spark, sf_dir):
    """stable softmax cross-entropy of each embedding read as logits, and its arg-max."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label",
                                                 F.col("embedding").cast("array<double>").alias("l"))
    return e.select("vec_id", "label", M.round6(M.softmax_xent("l", "label")).alias("loss"),
                    M.argmax("l").alias("argmax"))


@query("dot_product", """
SELECT vec_id, round(sum(v * sin(j)), 6) AS dot FROM
  (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(1, len(embedding) + 1)) AS j
   FROM embeddings) GROUP BY vec_id""")
def q_dot_product(spark, sf_dir):
    """dot product of each embedding with the vector sin(1..64)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("l"))
    w = F.transform(F.sequence(F.lit(1), F.size("l")), lambda j: F.sin(j))
    return e.select("vec_id", M.round6(M.dot("l", w)).alias("dot"))


@query("array_shapes", SEQ_SQL + f""",
win AS (SELECT "user", CAST((pos - 1) // {WINDOW} AS BIGINT) AS chunk, CAST((pos - 1) % {WINDOW} AS BIGINT) AS t,
               item, target FROM seq WHERE ((pos - 1) // {WINDOW} + 1) * {WINDOW} <= n)
SELECT "user", chunk, CAST(count(*) AS INTEGER) AS len,
       CAST(max(CASE WHEN t = 0 THEN item END) AS BIGINT) AS first_item,
       CAST(max(CASE WHEN t = {WINDOW - 1} THEN item END) AS BIGINT) AS last_item,
       CAST(sum(CASE WHEN t BETWEEN 4 AND 7 THEN item ELSE 0 END) AS BIGINT) AS mid_sum,
       CAST(2 * count(*) AS INTEGER) AS flat_len,
       CAST(sum(item) + sum(target) AS BIGINT) AS flat_sum
FROM win GROUP BY ALL""")
def q_array_shapes(spark, sf_dir):
    """array slice, concat, flatten and reshape on window arrays."""
    arr = S.window_arrays(window_frame(spark, sf_dir))
    flat = F.flatten(F.array("item_list", "target_list"))
    tot = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return arr.select("user", "chunk", F.size("item_list").alias("len"),
                      F.element_at("item_list", 1).alias("first_item"),
                      F.element_at("item_list", -1).alias("last_item"),
                      tot(F.slice("item_list", 5, 4)).alias("mid_sum"),
                      F.size(flat).alias("flat_len"), tot(flat).alias("flat_sum"))


@query("lr_schedule", ORDER_SQL + """,
nb AS (SELECT max(step) AS nb FROM ord),
gs AS (SELECT epoch, step, batch_id, CAST((epoch - 1) * nb + step AS BIGINT) AS global_step, nb FROM ord, nb)
SELECT epoch, step, global_step,
       round(CASE WHEN global_step < nb // 2 THEN 0.01 * global_step / (nb // 2)
                  ELSE 0.01 * (1 - least(global_step, 2 * nb) / (2 * nb)) END, 6) AS lr
FROM gs""")
def q_lr_schedule(spark, sf_dir):
    """F8: warm-up then linear decay over the steps of two epochs of the batch plan."""
    orders = _epoch_orders(spark, sf_dir, 2)
    nb = int(orders.agg(F.max("step")).first()[0])
    gs = orders.withColumn("global_step", ((F.col("epoch") - 1) * nb + F.col("step")).cast("bigint"))
    return gs.select("epoch", "step", "global_step",
                     M.round6(M.lr_schedule("global_step", 0.01, 2 * nb, nb // 2)).alias("lr"))


# ---------------------------------------------------------------- M7 on the embeddings
@query("rmsprop_update", EMB_SQL + """,
g AS (SELECT x.vec_id, x.j, x.v, exp(x.v - z.lse) - CASE WHEN x.j = x.label + 1 THEN 1 ELSE 0 END AS g
      FROM x JOIN z USING (vec_id)),
u AS (SELECT vec_id, j, v, g, 0.9 * 0 + (1 - 0.9) * g * g AS ms FROM g)
SELECT vec_id, CAST(j - 1 AS BIGINT) AS j, round(v - 0.01 * g / sqrt(ms + 1e-8), 6) AS w, round(ms, 6) AS ms FROM u""")
def q_rmsprop_update(spark, sf_dir):
    """M7/M8: one RMSProp step (lr 0.01, rho 0.9, eps 1e-8, accumulators reset to 0) on the
    embeddings read as logit parameters, with the softmax cross-entropy gradient."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label",
                                                 F.col("embedding").cast("array<double>").alias("w"))
    e = M.with_softmax(e, "w", "p")
    e = e.withColumn("g", F.transform("p", lambda x, j: x - F.when(j == F.col("label"), 1.0).otherwise(0.0)))
    e = e.withColumn("ms", F.array_repeat(F.lit(0.0), F.size("w")))
    e = M.with_rmsprop(e, "w", "g", "ms", 0.01, 0.9, 1e-8)
    out = e.select("vec_id", F.posexplode(F.arrays_zip(F.col("w").alias("w"), F.col("ms").alias("ms"))).alias("j", "z"))
    return out.select("vec_id", F.col("j").cast("bigint").alias("j"), M.round6("z.w").alias("w"),
                      M.round6("z.ms").alias("ms"))


# ---------------------------------------------------------------- training (rows-only checks)
def _train_setup(spark, sf_dir, hidden=H, init="formula"):
    from seqwright.model.training import StepConfig, Tables  # noqa: F401
    seq = seq_frame(spark, sf_dir)
    num_items = int(seq.agg(F.max("item")).first()[0])
    split = S.temporal_split(seq, train_frac=0.5)
    train = S.tumbling_windows(split.where(F.col("split") == "train"), WINDOW).select(
        "user", F.col("chunk").alias("seg"), "pos", "item", "target")
    valid = split.where(F.col("split") == "valid").select("user", F.lit(0).alias("seg"), "pos", "item", "target")
    t = Tables(Wt.user_weights(seq, hidden, init), Wt.item_weights(spark, num_items, hidden, init),
               Wt.shared_weights(spark, hidden))
    return train, valid, t, StepConfig(hidden=hidden, num_items=num_items, lr=0.01)


# Back-propagation through the windows of the train half, H = 2, formula weights, one batch:
# forward states, softmax of every position, then the recursion from the last step to the first.
_U = [f"1 / (1 + exp(-{_gate_pre('r.h0', 'r.h1', 'r.usr', 's.item', c)}))" for c in (2, 3)]
_C = [f"tanh({_cand_pre('r.h0', 'r.h1', 'r.usr', 's.item', k)})" for k in (0, 1)]
GRAD_SQL = SEQ_SQL.replace("WITH ev AS", "WITH RECURSIVE ev AS", 1) + f""",
tw AS (SELECT "user" AS usr, (pos - 1) // {WINDOW} AS chunk, (pos - 1) % {WINDOW} AS t, item, target FROM seq
       WHERE pos <= n // 2 AND ((pos - 1) // {WINDOW} + 1) * {WINDOW} <= n),
sca AS (SELECT 1.0 / (count(*) * {WINDOW}) AS scale FROM (SELECT DISTINCT usr, chunk FROM tw)),
fw(usr, chunk, t, p0, p1, u0, u1, c0, c1, h0, h1) AS (
  SELECT DISTINCT usr, chunk, CAST(-1 AS BIGINT), 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE,
         0.0::DOUBLE, 0.0::DOUBLE FROM tw
  UNION ALL
  SELECT usr, chunk, t, p0, p1, u0, u1, c0, c1, u0 * p0 + (1 - u0) * c0, u1 * p1 + (1 - u1) * c1 FROM (
    SELECT r.usr, r.chunk, s.t, r.h0 AS p0, r.h1 AS p1, {_U[0]} AS u0, {_U[1]} AS u1, {_C[0]} AS c0, {_C[1]} AS c1
    FROM fw r JOIN tw s ON s.usr = r.usr AND s.chunk = r.chunk AND s.t = r.t + 1)),
st AS (SELECT fw.*, tw.item, tw.target FROM fw JOIN tw USING (usr, chunk, t)),
items AS (SELECT CAST(range AS BIGINT) AS i, cos(range * 3 + 2) / 2 AS o0, cos(range * 3 + 4) / 2 AS o1
          FROM range(0, (SELECT max(item) FROM ev) + 1)),
lg AS (SELECT usr, chunk, t, h0, h1, target, i, o0, o1, h0 * o0 + h1 * o1 AS logit FROM st, items),
sm AS (SELECT usr, chunk, t, max(logit) AS mx, arg_max(i, logit) AS am,
              max(CASE WHEN i = target THEN logit END) AS tl FROM lg GROUP BY ALL),
ls AS (SELECT sm.usr, sm.chunk, sm.t, sm.am, sm.tl, sm.mx + ln(sum(exp(logit - sm.mx))) AS lse
       FROM lg JOIN sm USING (usr, chunk, t) GROUP BY sm.usr, sm.chunk, sm.t, sm.mx, sm.am, sm.tl),
dl AS (SELECT lg.*, CASE WHEN target > 0 THEN (exp(logit - lse) - CASE WHEN i = target THEN 1 ELSE 0 END) * scale ELSE 0 END AS d
       FROM lg JOIN ls USING (usr, chunk, t), sca),
dh AS (SELECT usr, chunk, t, sum(d * o0) AS d0, sum(d * o1) AS d1 FROM dl GROUP BY ALL),
gout AS (SELECT i, sum(d * h0) AS g0, sum(d * h1) AS g1 FROM dl GROUP BY i),
fd AS (SELECT st.*, dh.d0, dh.d1 FROM st JOIN dh USING (usr, chunk, t)),
bw(usr, chunk, t, n0, n1, a0, a1, b0, b1) AS (
  SELECT usr, chunk, max(t) + 1, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM fd GROUP BY usr, chunk
  UNION ALL
  SELECT usr, chunk, t,
    e0 * u0 + sin(usr * 7 + 1) / 2 * b0 + sin(usr * 7 + 6) / 2 * b1 + sin(usr * 7 + 10) / 2 * a0 + sin(usr * 7 + 15) / 2 * a1,
    e1 * u1 + sin(usr * 7 + 4) / 2 * b0 + sin(usr * 7 + 9) / 2 * b1 + sin(usr * 7 + 13) / 2 * a0 + sin(usr * 7 + 18) / 2 * a1,
    a0, a1, b0, b1 FROM (
    SELECT usr, chunk, t, e0, e1, u0, u1, e0 * (p0 - c0) * u0 * (1 - u0) AS a0, e1 * (p1 - c1) * u1 * (1 - u1) AS a1,
           e0 * (1 - u0) * (1 - c0 * c0) AS b0, e1 * (1 - u1) * (1 - c1 * c1) AS b1 FROM (
      SELECT s.*, s.d0 + r.n0 AS e0, s.d1 + r.n1 AS e1
      FROM bw r JOIN fd s ON s.usr = r.usr AND s.chunk = r.chunk AND s.t = r.t - 1))),
pg AS (SELECT fd.usr, fd.item, fd.p0, fd.p1, bw.a0, bw.a1, bw.b0, bw.b1 FROM fd JOIN bw USING (usr, chunk, t)),
ug AS (SELECT usr, [0, 0, sum(p0 * a0), sum(p0 * a1), 0, 0, sum(p1 * a0), sum(p1 * a1)] AS g,
              [sum(p0 * b0), sum(p0 * b1), sum(p1 * b0), sum(p1 * b1)] AS c FROM pg GROUP BY usr),
ig AS (SELECT gout.i, [0, 0, coalesce(sum(a0), 0), coalesce(sum(a1), 0), coalesce(sum(b0), 0), coalesce(sum(b1), 0), g0, g1] AS g
       FROM gout LEFT JOIN pg ON pg.item = gout.i GROUP BY gout.i, g0, g1),
bg AS (SELECT [0, 0, sum(a0), sum(a1), sum(b0), sum(b1)] AS g FROM pg),
grad AS (
  SELECT 'gate_u' AS param, usr AS id, CAST(unnest(range(0, 8)) AS BIGINT) AS j, unnest(g) AS g FROM ug
  UNION ALL SELECT 'cand_u', usr, CAST(unnest(range(0, 4)) AS BIGINT), unnest(c) FROM ug
  UNION ALL SELECT 'item', i, CAST(unnest(range(0, 8)) AS BIGINT), unnest(g) FROM ig
  UNION ALL SELECT 'bias', CAST(0 AS BIGINT), CAST(unnest(range(0, 6)) AS BIGINT), unnest(g) FROM bg)"""


def _first_batch(train, epoch=1, n_batches=1, seed=SEED):
    """The step's batch: with one batch per epoch (full-batch step) it holds every window."""
    from seqwright.operators.batching import batch_ids
    bw = batch_ids(train, n_batches, seed, epoch, ("user", "seg"))
    return bw.where(F.col("batch_id") == 0).drop("batch_id")


@query("gradient_sum", GRAD_SQL + """
SELECT param, id, j, round(g, 9) + 0.0 AS g FROM grad""")
def q_gradient_sum(spark, sf_dir):
    """Gradient of the objective over all training windows (one full batch), per-task
    partial sums added up by a groupBy; long form (param, id, j, g)."""
    from seqwright.model.training import step_frame, sum_arrays
    from seqwright.session import scratch_path
    train, _, t, cfg = _train_setup(spark, sf_dir)
    cfg.update = False
    rows = _first_batch(train)
    n = rows.select("user", "seg").distinct().count()
    path = scratch_path(spark, "grads")
    step_frame(spark, rows, t.user_w, t.item_w, t.shared_w, cfg, 1.0 / (n * WINDOW)).write.mode(
        "overwrite").parquet(path)
    res = spark.read.parquet(path)
    ug = res.where(F.col("kind") == "user_grad")
    parts = [ug.select(F.lit("gate_u").alias("param"), "id", F.posexplode("v1").alias("j", "g")),
             ug.select(F.lit("cand_u").alias("param"), "id", F.posexplode("v2").alias("j", "g"))]
    for kind, name in (("item", "item"), ("bias", "bias")):
        s = sum_arrays(res.where(F.col("kind") == kind).select("id", "v1"), "id")
        parts.append(s.select(F.lit(name).alias("param"), "id", F.posexplode("v1").alias("j", "g")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("param", "id", F.col("j").cast("bigint").alias("j"), (F.round("g", 9) + F.lit(0.0)).alias("g"))


@query("train_step", GRAD_SQL + """,
wt AS (SELECT param, id, j, g, CASE WHEN param = 'item' THEN CASE WHEN j < 4 THEN cos(id * 3 + j * 2) / 2
         WHEN j < 6 THEN cos(id * 3 + (j - 4) * 2 + 1) / 2 ELSE cos(id * 3 + (j - 6) * 2 + 2) / 2 END
         WHEN j < 4 THEN 1 ELSE 0 END AS w FROM grad WHERE param IN ('item', 'bias'))
SELECT CASE WHEN param = 'item' THEN 'item' WHEN j < 4 THEN 'gate_bias' ELSE 'cand_bias' END AS param, id,
       CASE WHEN param = 'bias' AND j >= 4 THEN j - 4 ELSE j END AS j,
       round(w - 0.01 * g / sqrt(0.1 * g * g + 1e-8), 6) + 0.0 AS w FROM wt""")
def q_train_step(spark, sf_dir):
    """M6/M7/M8: one RMSProp step (accumulators reset to 0) over all training windows (one
    full batch); the updated item and bias tables in long form (param, id, j, w)."""
    from seqwright.model.training import train_step
    train, _, t, cfg = _train_setup(spark, sf_dir)
    new, _ = train_step(spark, _first_batch(train), t, cfg, WINDOW)
    it = new.item_w.select(F.lit("item").alias("param"), F.col("item").alias("id"),
                           F.posexplode(F.concat("gate_in", "cand_in", "out")).alias("j", "w"))
    sh = new.shared_w.select(F.col("name").alias("param"), F.lit(0).cast("bigint").alias("id"),
                             F.posexplode("v").alias("j", "w"))
    return it.unionByName(sh).select("param", "id", F.col("j").cast("bigint").alias("j"),
                                     (F.round("w", 6) + F.lit(0.0)).alias("w"))


@query("fit_first_step", GRAD_SQL + """
SELECT 1 AS epoch, 1 AS step, 'train' AS split, round(sum(CASE WHEN target > 0 THEN lse - tl ELSE 0 END) * max(scale), 6) AS log_loss,
       round(avg(CASE WHEN target > 0 THEN CASE WHEN am = target THEN 1.0 ELSE 0.0 END END), 6) AS accuracy,
       CAST(count(CASE WHEN target > 0 THEN 1 END) AS BIGINT) AS n, CAST(0.01 AS DOUBLE) AS lr
FROM ls JOIN st USING (usr, chunk, t), sca""")
def q_fit_first_step(spark, sf_dir):
    """The history of a fit of one step over all training windows from formula weights."""
    from seqwright.model.training import fit
    train, _, t, cfg = _train_setup(spark, sf_dir)
    _, log_path = fit(spark, train, None, t, cfg, window_len=WINDOW, epochs=1, n_batches=1, steps_per_epoch=1, seed=SEED)
    return spark.read.parquet(log_path).select("epoch", "step", "split", M.round6("log_loss").alias("log_loss"),
                                               M.round6("accuracy").alias("accuracy"), "n", "lr")


def _normal_sql(param: str, ids: str, width: int) -> str:
    """Long-form seeded normals of one table, as ``weights.hashed_normals`` draws them (H = 4)."""
    return (f"SELECT '{param}' AS param, id, j, md5(concat_ws(':', '{SEED}', '{param}', CAST(id AS VARCHAR), CAST(j AS VARCHAR))) AS h"
            f" FROM ({ids}), (SELECT CAST(range AS BIGINT) AS j FROM range({width}))")


INIT_SQL = EV_SQL + f""",
us AS (SELECT DISTINCT "user" AS id FROM ev), it AS (SELECT CAST(unnest(range(0, (SELECT max(item) FROM ev) + 1)) AS BIGINT) AS id),
h AS ({_normal_sql('gate', 'SELECT id FROM us', 32)} UNION ALL {_normal_sql('cand', 'SELECT id FROM us', 16)}
  UNION ALL {_normal_sql('gate_in', 'SELECT id FROM it', 8)} UNION ALL {_normal_sql('cand_in', 'SELECT id FROM it', 4)}
  UNION ALL {_normal_sql('out', 'SELECT id FROM it', 4)})
SELECT param, id, j, round(sqrt(-2 * ln((CAST('0x' || substr(h, 1, 13) AS BIGINT) + 1) / 4503599627370496.0::DOUBLE))
       * cos(2 * pi() * (CAST('0x' || substr(h, 14, 13) AS BIGINT) / 4503599627370496.0::DOUBLE)) / 2, 6) + 0.0 AS w FROM h"""


@query("init_weights", INIT_SQL)
def q_init_weights(spark, sf_dir):
    """M9: seeded N(0, 1/sqrt(H)) initial weights (H = 4) of every user and item, in long form."""
    seq = seq_frame(spark, sf_dir)
    num_items = int(seq.agg(F.max("item")).first()[0])
    uw = Wt.user_weights(seq, 4, "hashed", seed=SEED)
    iw = Wt.item_weights(spark, num_items, 4, "hashed", seed=SEED)
    parts = [df.select(F.lit(c).alias("param"), F.col(i).alias("id"), F.posexplode(c).alias("j", "w"))
             for df, i, cols in ((uw, "user", ("gate", "cand")), (iw, "item", ("gate_in", "cand_in", "out"))) for c in cols]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("param", "id", F.col("j").cast("bigint").alias("j"), (F.round("w", 6) + F.lit(0.0)).alias("w"))


def _fit(spark, sf_dir):
    from seqwright.model.training import fit
    train, valid, t, cfg = _train_setup(spark, sf_dir)
    _, log_path = fit(spark, train, valid, t, cfg, window_len=WINDOW, epochs=2, n_batches=2,
                      steps_per_epoch=None, schedule=(4, 1), seed=SEED)
    return spark.read.parquet(log_path)


@query("fit_history")
def q_fit_history(spark, sf_dir):
    """Two epochs, each over all training windows in two seeded batches (learning rate
    warmed up and decayed over the four steps), a validation pass per epoch; the metrics
    history."""
    return _fit(spark, sf_dir)


@query("progress_report", ORDER_SQL + f""",
s AS (SELECT CAST(o.epoch * 1000 + o.step AS BIGINT) AS gstep, CAST(count(*) * {WINDOW} AS BIGINT) AS n,
             count(*) * {WINDOW} / 2000.0::DOUBLE + 0.5 AS seconds
      FROM ord o JOIN bat b USING (batch_id) GROUP BY o.epoch, o.step)
SELECT gstep, n, CAST(sum(n) OVER w AS BIGINT) AS triplets, round(sum(seconds) OVER w, 6) AS elapsed,
       round(sum(n) OVER w / sum(seconds) OVER w, 6) AS wps
FROM s WINDOW w AS (ORDER BY gstep ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def q_progress_report(spark, sf_dir):
    """triplets per second over the steps of two epochs, cumulative; the steps' windows are the
    data's, their seconds a fixed function of the windows, so that the report can be checked."""
    n = F.col("n_windows") * WINDOW
    steps = _epoch_orders(spark, sf_dir).select(
        (F.col("epoch") * 1000 + F.col("step")).alias("gstep"), n.alias("n"), (n / F.lit(2000.0) + F.lit(0.5)).alias("seconds"))
    p = X.progress(steps, "gstep")
    return p.select("gstep", "n", "triplets", M.round6("elapsed").alias("elapsed"), M.round6("wps").alias("wps"))


@query("fit_carry_history")
def q_fit_carry_history(spark, sf_dir):
    """M4/M10 session style: each user's train half in padded chunks of 64 with state carried across
    them (W4, truncated back-propagation), validation on the valid half starting from the
    saved final training states (J3)."""
    from seqwright.model.training import StepConfig, Tables, fit
    seq = seq_frame(spark, sf_dir)
    num_items = int(seq.agg(F.max("item")).first()[0])
    split = S.temporal_split(seq, train_frac=0.5)
    tr = split.where(F.col("split") == "train")
    va = split.where(F.col("split") == "valid").withColumn("pos", F.col("pos") - F.floor(F.col("n") / 2))
    va = va.withColumn("n", F.col("n") - F.floor(F.col("n") / 2))
    cols = ["user", F.col("chunk").alias("seg"), "pos", "item", "target"]
    train = S.tumbling_windows(tr, CHUNK, tail="keep").select(*cols)
    valid = S.tumbling_windows(va, CHUNK, tail="keep").select(*cols)
    t = Tables(Wt.user_weights(seq, H, "normal", seed=SEED), Wt.item_weights(spark, num_items, H, "normal", SEED),
               Wt.shared_weights(spark, H))
    cfg = StepConfig(hidden=H, num_items=num_items, lr=0.01, carry=True)
    _, log_path = fit(spark, train, valid, t, cfg, window_len=CHUNK, epochs=2, n_batches=2,
                      steps_per_epoch=None, seed=SEED)
    return spark.read.parquet(log_path)


@query("score_states_reset", SEQ_SQL.replace("WITH ev AS", "WITH RECURSIVE ev AS", 1) + """,
rec(usr, pos, h0, h1) AS (
  SELECT DISTINCT "user", CAST(0 AS BIGINT), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM seq
  UNION ALL
  """ + _step_sql("rec r", 'JOIN seq s ON s."user" = r.usr AND s.pos = r.pos + 1', "usr, pos", reset_gate=True)
    + """)
SELECT usr AS "user", pos, round(h0, 6) AS h0, round(h1, 6) AS h1 FROM rec WHERE pos > 0""")
def q_score_states_reset(spark, sf_dir):
    """M1 with the textbook cell (D1, ``reset_gate=True``): the candidate sees ``r * h``."""
    return _scored(spark, sf_dir, states=True, reset_gate=True).select("user", "pos", *_h())


@query("score_states_relu", SEQ_SQL.replace("WITH ev AS", "WITH RECURSIVE ev AS", 1) + """,
rec(usr, pos, h0, h1) AS (
  SELECT DISTINCT "user", CAST(0 AS BIGINT), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM seq
  UNION ALL
  """ + _step_sql("rec r", 'JOIN seq s ON s."user" = r.usr AND s.pos = r.pos + 1', "usr, pos", act="relu")
    + """)
SELECT usr AS "user", pos, round(h0, 6) AS h0, round(h1, 6) AS h1 FROM rec WHERE pos > 0""")
def q_score_states_relu(spark, sf_dir):
    """M1 with a replaced cell activation (the reference's pluggable activation): relu."""
    return _scored(spark, sf_dir, states=True, act="relu").select("user", "pos", *_h())


@query("score_states_sigmoid", SEQ_SQL.replace("WITH ev AS", "WITH RECURSIVE ev AS", 1) + """,
rec(usr, pos, h0, h1) AS (
  SELECT DISTINCT "user", CAST(0 AS BIGINT), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM seq
  UNION ALL
  """ + _step_sql("rec r", 'JOIN seq s ON s."user" = r.usr AND s.pos = r.pos + 1', "usr, pos", act="sigmoid")
    + """)
SELECT usr AS "user", pos, round(h0, 6) AS h0, round(h1, 6) AS h1 FROM rec WHERE pos > 0""")
def q_score_states_sigmoid(spark, sf_dir):
    """M1 with a replaced cell activation (the reference's pluggable activation): sigmoid."""
    return _scored(spark, sf_dir, states=True, act="sigmoid").select("user", "pos", *_h())
