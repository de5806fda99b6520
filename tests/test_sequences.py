"""Sequence operators: skew path equals the plain window, invariants of windows and splits."""

from pyspark.sql import functions as F

from seqwright.operators import sequences as S
from seqwright.sources.tables import events_interactions

from conftest import SF01


def _hot_events(spark):
    ev = events_interactions(spark, SF01)
    # one user holds a third of all rows
    return ev.withColumn("user", F.when(F.col("event_id") % 3 == 0, F.lit(1).cast("bigint")).otherwise(F.col("user")))


def test_hot_key_segments_give_the_same_positions(spark):
    ev = _hot_events(spark)
    cols = ["user", "event_id", "pos", "n", "next_item"]
    plain = sorted(S.positions(ev, detect_skew=False).select(*cols).collect())
    split = S.positions(ev, hot_rows=400, seg_rows=150)
    assert "_seg" not in split.columns
    got = sorted(split.select(*cols).collect())
    assert got == plain
    hot = [r for r in got if r["user"] == 1]
    assert len(hot) > 3000 and max(r["pos"] for r in hot) == len(hot)


def test_bursty_hot_key_is_split_into_bounded_segments(spark):
    """90% of the hot user's events are squeezed into the first 5% of the time span: with
    equal time slices most rows would share one segment; merged fine buckets keep segments
    near seg_rows."""
    ev = _hot_events(spark)
    t0 = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    burst = F.when((F.col("user") == 1) & (F.col("event_id") % 10 != 0),
                   F.timestamp_micros(t0 + F.floor((us - t0) / 20).cast("bigint"))).otherwise(
        F.col("ts").cast("timestamp"))
    ev = ev.withColumn("ts", burst)
    cols = ["user", "event_id", "pos", "n", "next_item"]
    plain = sorted(S.positions(ev, detect_skew=False).select(*cols).collect())
    got = S.positions(ev, hot_rows=400, seg_rows=150)
    assert sorted(got.select(*cols).collect()) == plain
    sizes = (S.positions(ev, hot_rows=400, seg_rows=150, keep_segments=True)
             .where(F.col("user") == 1).groupBy("_seg").count().collect())
    n_hot = sum(r["count"] for r in sizes)
    assert len(sizes) >= n_hot // 150 - 1
    assert max(r["count"] for r in sizes) <= 2 * 150


def test_hot_key_with_one_timestamp_splits_by_tiebreak(spark):
    """Every event of the hot user carries the same timestamp: the tie-break orders them and
    the segments still stay near seg_rows."""
    ev = _hot_events(spark)
    ev = ev.withColumn("ts", F.when(F.col("user") == 1, F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"))
                       .otherwise(F.col("ts")))
    cols = ["user", "event_id", "pos", "n", "next_item"]
    plain = sorted(S.positions(ev, detect_skew=False).select(*cols).collect())
    seg = S.positions(ev, hot_rows=400, seg_rows=150, keep_segments=True)
    assert sorted(seg.select(*cols).collect()) == plain
    sizes = [r["count"] for r in seg.where(F.col("user") == 1).groupBy("_seg").count().collect()]
    assert len(sizes) >= sum(sizes) // 150 - 1 and max(sizes) <= 2 * 150


def test_hot_key_plan_groups_by_segment(spark):
    ev = _hot_events(spark)
    plan = S.positions(ev, hot_rows=400, seg_rows=150)._jdf.queryExecution().executedPlan().toString()
    assert "_seg" in plan and "BroadcastHashJoin" in plan


def test_window_invariants(spark):
    seq = S.next_item(events_interactions(spark, SF01))
    full = S.tumbling_windows(seq, 16, tail="drop")
    per_user = full.groupBy("user").agg(F.countDistinct("chunk").alias("w"), F.max("n").alias("n")).collect()
    assert all(r["w"] == r["n"] // 16 for r in per_user)
    keep = S.tumbling_windows(seq, 64, tail="keep")
    lens = keep.groupBy("user", "chunk").agg(F.max("seq_len").alias("l"), F.count("*").alias("c")).collect()
    assert all(r["l"] == r["c"] for r in lens)
    assert sum(r["l"] for r in lens) == seq.count()


def test_sliding_equals_tumbling_when_shift_is_size(spark):
    seq = S.next_item(events_interactions(spark, SF01))
    a = S.sliding_windows(seq, 16, 16, 1).select("user", F.col("window_id").alias("chunk"), "t", "item")
    b = S.tumbling_windows(seq, 16).select("user", "chunk", "t", "item")
    assert sorted(a.collect()) == sorted(b.collect())


def test_temporal_split_train_precedes_valid(spark):
    seq = S.temporal_split(S.next_item(events_interactions(spark, SF01)), train_frac=0.5)
    r = seq.groupBy("user").agg(F.max(F.when(F.col("split") == "train", F.col("ts"))).alias("a"),
                                F.min(F.when(F.col("split") == "valid", F.col("ts"))).alias("b")).collect()
    assert all(x["a"] < x["b"] for x in r)


def test_batch_slots_with_large_batches_split(spark):
    """A batch is a hot key at scale: ranking inside segmented batches equals the plain rank."""
    from seqwright.operators import batching as B
    seq = S.next_item(events_interactions(spark, SF01))
    keys = S.tumbling_windows(seq, 16).select("user", "chunk").distinct()
    cols = ["user", "chunk", "batch_id", "slot"]
    plain = sorted(B.shuffled_examples(keys, 4, 7, 1, detect_skew=False).select(*cols).collect())
    split = sorted(B.shuffled_examples(keys, 4, 7, 1, hot_rows=50, seg_rows=20).select(*cols).collect())
    assert split == plain
    sizes = {}
    for r in plain:
        sizes[r["batch_id"]] = sizes.get(r["batch_id"], 0) + 1
    assert all(max(r["slot"] for r in plain if r["batch_id"] == b) == n for b, n in sizes.items())


def test_sequence_plan_has_one_exchange_and_a_pruned_scan(spark):
    """next_item / count_windows: one hash exchange on user serves row_number, count and lead;
    the scan reads only the four columns used."""
    import re
    for df in (S.next_item(events_interactions(spark, SF01), detect_skew=False),
               S.tumbling_windows(S.next_item(events_interactions(spark, SF01), detect_skew=False), 16)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Exchange hashpartitioning\(user", plan)) == 1, plan
        assert plan.count("Exchange") == 1
        schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
        assert sorted(c.split(":")[0] for c in schema.split(",")) == ["event_id", "props", "ts", "user_id"]


def test_sliding_windows_match_brute_force_including_gaps(spark):
    """Every (size, shift, stride), gaps included (shift > span), against a direct listing."""
    seq = S.next_item(events_interactions(spark, SF01)).where(F.col("user") <= 20)
    by_user = {}
    for r in seq.select("user", "pos", "item", "n").collect():
        by_user.setdefault(r["user"], {})[r["pos"]] = r["item"]
    for size, shift, stride in ((8, 4, 2), (3, 10, 1), (4, 4, 3), (5, 1, 1)):
        got = sorted(tuple(r) for r in S.sliding_windows(seq, size, shift, stride).select(
            "user", "window_id", "t", "item").collect())
        exp = []
        span = (size - 1) * stride + 1
        for u, items in by_user.items():
            n = len(items)
            w = 0
            while w * shift + span <= n:
                for t in range(size):
                    exp.append((u, w, t, items[w * shift + t * stride + 1]))
                w += 1
        assert got == sorted(exp), (size, shift, stride)


def test_lookup_broadcasts_only_under_the_bound(spark):
    from seqwright.model import weights as W
    from seqwright.operators import lookup as L
    seq = S.next_item(events_interactions(spark, SF01), detect_skew=False)
    iw = W.item_weights(spark, 100, 2, "formula")
    small = L.lookup(seq, iw, "item", est_rows=101, row_bytes=64)
    big = L.lookup(seq, iw, "item", est_rows=10 ** 9, row_bytes=64)
    ps = small._jdf.queryExecution().executedPlan().toString()
    pb = big._jdf.queryExecution().optimizedPlan().toString()
    assert "BroadcastHashJoin" in ps
    assert "broadcast" not in pb.lower() or "strategy=broadcast" not in pb
    cols = ["user", "pos", "item", "gate_in"]
    assert sorted(map(tuple, small.select(*cols).collect())) == sorted(map(tuple, big.select(*cols).collect()))
