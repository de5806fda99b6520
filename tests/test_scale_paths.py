"""Joins without exchange, tiles, stable sorts of hot values, resumable passes."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqwright.model import scoring_bucketed as SB
from seqwright.model import tiles
from seqwright.model.scoring import final_states, item_logits, score
from seqwright.operators import batching as B
from seqwright.operators import transforms as T
from seqwright.streaming import passes

from test_training import _setup


# ---------------------------------------------------------------- J1 / M1
def test_bucketed_scoring_has_no_exchange_and_the_same_states(spark):
    H = 3
    rows, t, num_items = _setup(spark, H)
    kw = dict(num_items=num_items, hidden=H)
    s, u = SB.bucketed_sequences(rows, 4, piece=10), SB.bucketed_users(t.user_w, 4)
    b = SB.score_bucketed(spark, s, u, t.item_w, t.shared_w, **kw)
    plan = b._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan, plan
    cols = ["user", "seg", "pos", "item", "target", "h", "lse", "argmax"]
    a = score(spark, rows, t.user_w, t.item_w, t.shared_w, carry=True, **kw)
    assert sorted(map(tuple, a.select(*cols).collect())) == sorted(map(tuple, b.select(*cols).collect()))
    # from saved states, and users without weights
    init = final_states(a).where("user % 2 = 0")
    few = SB.bucketed_users(t.user_w.where("user % 3 > 0"), 4)
    x = score(spark, rows, t.user_w.where("user % 3 > 0"), t.item_w, t.shared_w, carry=True, init_state=init, **kw)
    y = SB.score_bucketed(spark, s, few, t.item_w, t.shared_w, init_state=init, **kw)
    assert sorted(map(tuple, x.select(*cols).collect())) == sorted(map(tuple, y.select(*cols).collect()))


# ---------------------------------------------------------------- M2 in tiles
def test_tiles_of_many_groups_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(tiles, "GROUP", 100)
    H = 3
    rows, t, num_items = _setup(spark, H)
    kw = dict(num_items=num_items, hidden=H, carry=True)
    rows = rows.withColumn("target", F.when(F.col("pos") % 7 == 0, F.lit(num_items + 5)).otherwise(F.col("target")))  # no output row
    items = t.item_w.where("item != 3")   # an id without a row
    cols = ["user", "seg", "pos", "target", "lse", "tlogit", "argmax", "maxlogit"]
    a = {tuple(r)[:3]: tuple(r)[3:] for r in score(spark, rows, t.user_w, items, t.shared_w, **kw).select(*cols).collect()}
    b = {tuple(r)[:3]: tuple(r)[3:] for r in score(spark, rows, t.user_w, items, t.shared_w, shared_bytes=8 * H * 9, **kw).select(*cols).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k][0] == b[k][0] and a[k][3] == b[k][3] and (a[k][2] is None) == (b[k][2] is None)
        np.testing.assert_allclose([x or 0 for x in a[k]], [x or 0 for x in b[k]], atol=1e-10)
    sc = score(spark, rows, t.user_w, t.item_w, t.shared_w, **kw)
    whole = {(r["user"], r["seg"], r["pos"]): r["logits"] for r in item_logits(spark, sc, t.item_w, num_items, H).collect()}
    parts = {}
    for r in item_logits(spark, sc, t.item_w, num_items, H, shared_bytes=8 * H * 9).collect():
        parts.setdefault((r["user"], r["seg"], r["pos"]), []).append((r["first_item"], r["logits"]))
    assert whole.keys() == parts.keys()
    for k, v in parts.items():
        np.testing.assert_allclose([x for _, p in sorted(v) for x in p], whole[k], atol=1e-12)


# ---------------------------------------------------------------- O1
@pytest.mark.parametrize("ascending", [True, False])
def test_a_hot_sort_value_spans_partitions(spark, ascending):
    df = spark.range(0, 40_000, 1, 6).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.lit(7)).alias("v"), F.lit("x").alias("_nr"), "id")
    out = T.sort_by(df, "v", ascending)
    assert out.columns == df.columns
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")   # the range partitions as they were cut
    try:
        got = out.withColumn("p", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = sorted(df.collect(), key=lambda r: r["v"], reverse=not ascending)   # Python's sort is stable, reversed or not
    assert [(r["v"], r["id"]) for r in got] == [(r["v"], r["id"]) for r in want]
    sizes = np.bincount([r["p"] for r in got])
    sizes = sizes[sizes > 0]
    assert len(sizes) >= 6 and sizes.max() <= 2 * np.median(sizes), sizes


# ---------------------------------------------------------------- S4 / O7
def test_passes_stop_and_go_on_without_loss_or_repeats(spark, tmp_path):
    rows = spark.range(60).select((F.col("id") % 4).alias("batch_id"), "id")
    passes.store_batches(rows, str(tmp_path / "data"))
    seen, mark = [], str(tmp_path / "mark")

    def each(df, epoch, step):
        seen.append((epoch, step, tuple(sorted(r["id"] for r in df.collect()))))

    q = passes.start_passes(spark, str(tmp_path / "data"), each, mark, seed=5)   # endless
    while len(seen) < 6:
        assert q.isActive, q.exception()
        time.sleep(0.05)
    q.stop()
    stopped = len(seen)
    q = passes.start_passes(spark, str(tmp_path / "data"), each, mark, seed=5, epochs=4)
    q.processAllAvailable()
    q.stop()
    assert stopped < 16
    order = {(r["epoch"], r["step"]): r["batch_id"] for r in B.epoch_orders(rows.select("batch_id").distinct(), 5, 4).collect()}
    want = [(e, s, tuple(i for i in range(60) if i % 4 == order[e, s])) for e in range(1, 5) for s in range(1, 5)]
    # the step that the stop interrupted may come again, as it was
    assert list(dict.fromkeys(seen)) == want and len(seen) <= len(want) + 1
    seen.clear()
    q = passes.start_passes(spark, str(tmp_path / "data"), each, str(tmp_path / "m2"), seed=5, epochs=2, steps_per_epoch=3, steps_per_trigger=4)
    q.processAllAvailable()
    q.stop()
    assert [x[:2] for x in seen] == [(e, s) for e in (1, 2) for s in (1, 2, 3)]


# ---------------------------------------------------------------- M4
@pytest.mark.parametrize("segment", [25, 1000])
def test_a_relay_of_segments_equals_one_fold(spark, segment):
    from seqwright.model.relay import score_relay

    H = 3
    rows, t, num_items = _setup(spark, H)
    rows = rows.where("user > 3 or pos <= 10 or (user = 3 and pos > 30)")   # short users, and one that starts late
    kw = dict(num_items=num_items, hidden=H)
    init = spark.createDataFrame([(2, [0.1, 0.2, 0.3]), (5, [0.3, 0.2, 0.1])], "user BIGINT, h ARRAY<DOUBLE>")
    cols = ["user", "seg", "pos", "item", "target", "h", "lse", "argmax"]
    for state in (init,) if segment < 1000 else (None, init):
        a = score(spark, rows, t.user_w, t.item_w, t.shared_w, init_state=state, **kw).select(*cols).collect()
        b = score_relay(spark, rows, t.user_w, t.item_w, t.shared_w, segment=segment, init_state=state, **kw).select(*cols).collect()
        assert sorted(map(tuple, a)) == sorted(map(tuple, b))
