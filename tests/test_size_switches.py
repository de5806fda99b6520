"""Paths that run above a size give the same rows as the plain ones, also for awkward input."""

import pytest
from pyspark.sql import functions as F

from seqwright.model import weights as Wt
from seqwright.model.scoring import item_logits, score
from seqwright.operators import sequences as S
from seqwright.session import require_shared_dir


def both_ways(df, order, key="user"):
    cols = [key, *order, "pos", "n", "next_item"]
    plain = S.positions(df, key, order, detect_skew=False).select(*cols)
    hot = S.positions(df, key, order, hot_rows=5, seg_rows=4).select(*cols)
    return [sorted(map(repr, x.collect())) for x in (plain, hot)]


def frame(spark, rows, schema="user bigint, o string, item bigint"):
    return spark.createDataFrame(rows, schema)


def test_null_items_keep_null_labels(spark):
    a, b = both_ways(frame(spark, [(1, f"{i:03d}", None if i in (4, 9) else i) for i in range(12)]), ["o"])
    assert a == b and sum("next_item=None" in x for x in a) == 2


def test_close_order_values_above_2_to_53(spark):
    a, b = both_ways(frame(spark, [(1, (1 << 60) + i, i) for i in range(64)], "user bigint, o bigint, item bigint"), ["o"])
    assert a == b


def test_text_order_and_null_key(spark):
    a, b = both_ways(frame(spark, [(None if i % 2 else 7, f"2024-01-{i:02d}", i) for i in range(40)]), ["o"])
    assert a == b


def test_null_order_values_and_ties(spark):
    rows = [(1, None if i < 9 else "same", i, i) for i in range(30)]
    a, b = both_ways(spark.createDataFrame(rows, "user bigint, o string, p int, item bigint"), ["o", "p"])
    assert a == b


def test_one_outlier_does_not_join_the_other_rows(spark):
    rows = [(1, i, i) for i in range(2990)] + [(1, 10 ** 15 + i, i) for i in range(10)]
    df = spark.createDataFrame(rows, "user bigint, o bigint, item bigint")
    seg = S.positions(df, "user", ["o"], hot_rows=400, seg_rows=150, keep_segments=True)
    assert seg.groupBy("_seg").count().agg(F.max("count")).first()[0] <= 450
    assert S.collect_sequences(df, ["o"], ["user"], ["item"], segment_len=1000).count() == 3


def test_unknown_ids_mean_the_same_on_both_scoring_paths(spark):
    H, n = 2, 6
    rows = spark.createDataFrame([(1, 0, 1, 3, 99), (1, 0, 2, 99, 4), (1, 0, 3, 2, 0), (5, 0, 1, 1, 2)],
                                 "user bigint, seg bigint, pos bigint, item bigint, target bigint")
    uw = Wt.user_weights(rows.where("user = 1"), H, "formula")   # user 5 has no weights
    iw, sw = Wt.item_weights(spark, n, H, "formula"), Wt.shared_weights(spark, H)
    got = []
    for limit in (None, 8 * H * 3):
        sc = score(spark, rows, uw, iw, sw, num_items=n, hidden=H, shared_bytes=limit)
        got.append(sorted((r.user, r.pos, [round(x, 9) for x in r.h], round(r.lse, 9), r.tlogit and round(r.tlogit, 9), r.argmax)
                          for r in sc.collect()))
    assert got[0] == got[1] and len(got[0]) == 4
    assert [x[4] for x in got[0]][0] is None


def test_full_logits_in_blocks(spark):
    H, n = 2, 6
    rows = spark.createDataFrame([(1, 0, p, 1 + p % 5, 1) for p in range(1, 9)],
                                 "user bigint, seg bigint, pos bigint, item bigint, target bigint")
    uw, iw, sw = Wt.user_weights(rows, H, "formula"), Wt.item_weights(spark, n, H, "formula"), Wt.shared_weights(spark, H)
    sc = score(spark, rows, uw, iw, sw, num_items=n, hidden=H)
    whole = {r.pos: list(r.logits) for r in item_logits(spark, sc, iw, n, H).collect()}
    parts = {}
    for r in sorted(item_logits(spark, sc, iw, n, H, shared_bytes=8 * H * 3).collect(), key=lambda r: r.first_item):
        parts.setdefault(r.pos, []).extend(r.logits)
    assert parts.keys() == whole.keys() and all(parts[p] == pytest.approx(whole[p], abs=1e-12) for p in whole)


def test_a_cluster_needs_the_shared_folder():
    require_shared_dir("local[8]")
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            require_shared_dir(master)


def test_tfrecord_append_overwrite_and_missing_path(spark, tmp_path):
    from seqwright.sources.tfrecord import read_tfrecord, write_tfrecord
    path, schema = str(tmp_path / "t"), "user BIGINT, item_list ARRAY<FLOAT>, name STRING, empty ARRAY<BIGINT>"
    one = spark.createDataFrame([(1, [1.0, 2.0], "a", [])], schema)
    write_tfrecord(one, path)
    write_tfrecord(one.withColumn("user", F.lit(2).cast("bigint")), path, mode="append")
    got = sorted(map(tuple, read_tfrecord(spark, path, schema).collect()))
    assert got == [(1, [1.0, 2.0], "a", []), (2, [1.0, 2.0], "a", [])]
    write_tfrecord(one, path)
    assert read_tfrecord(spark, path, schema).count() == 1
    with pytest.raises(Exception, match="no TFRecord file"):
        read_tfrecord(spark, str(tmp_path / "none"), schema).count()


def test_an_epoch_repeats_passes_until_its_steps_are_done(spark):
    from seqwright.model.training import StepConfig, Tables, fit
    rows = spark.createDataFrame([(u, 0, p, 1 + (u + p) % 4, 1 + (u + p + 1) % 4) for u in range(1, 5) for p in range(1, 5)],
                                 "user bigint, seg bigint, pos bigint, item bigint, target bigint")
    t = Tables(Wt.user_weights(rows, 2, "formula"), Wt.item_weights(spark, 4, 2, "formula"), Wt.shared_weights(spark, 2))
    _, log = fit(spark, rows, rows, t, StepConfig(hidden=2, num_items=4, lr=0.01), window_len=4, epochs=1, n_batches=1,
                 steps_per_epoch=3)
    got = spark.read.parquet(log).orderBy("split", "step").collect()
    assert [(r.split, r.step) for r in got] == [("train", 1), ("train", 2), ("train", 3), ("valid", 0)]
    assert got[0].log_loss > got[2].log_loss and abs(got[3].macro_log_loss - got[3].log_loss) < 1e-9
