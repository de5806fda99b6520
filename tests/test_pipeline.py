"""Declarative pipeline: the reference's config shapes (CSV -> Cast -> CollectList -> TFRecord,
CSV -> Select -> CSV with SortBy), run on the given events table."""

import os

from pyspark.sql import functions as F

from seqwright.plans.pipeline import build_pipeline, run_pipeline
from seqwright.sources import files
from seqwright.sources.tables import events_interactions
from seqwright.sources.tfrecord import read_tfrecord

from conftest import SF001


def _events_csv(spark, tmp_path):
    ev = events_interactions(spark, SF001).select(
        "user", "item", F.unix_micros(F.col("ts").cast("timestamp")).alias("date"), "event_id")
    p = str(tmp_path / "events_csv")
    files.write_csv(ev, p)
    return ev, p


def test_cast_collect_to_tfrecord(spark, tmp_path):
    ev, src = _events_csv(spark, tmp_path)
    out = str(tmp_path / "train_data")
    spec = {
        "input": {"sources": [{"type": "Csv", "csv_path": src, "name": "events", "label": "events",
                               "delimiter": ",", "header": True}]},
        "transformations": [
            {"type": "Cast", "col": c, "castedCol": c, "fromType": "string", "toType": "float"}
            for c in ("user", "item", "date")] + [
            {"type": "Cast", "col": "event_id", "toType": "bigint"},
            {"type": "CollectList", "orderBy": ["date"], "groupBy": ["user"], "cols": ["item", "user"],
             "tiebreak": ["event_id"]}],
        "output": [{"type": "TFRecord", "name": "train_data", "path": out,
                    "features": ["user_list", "item_list"]}],
    }
    run_pipeline(spark, spec)
    assert os.path.exists(os.path.join(out, "_SUCCESS"))
    back = read_tfrecord(spark, out)
    assert back.columns == ["user_list", "item_list"]
    got = sorted((int(r["user_list"][0]), [int(x) for x in r["item_list"]]) for r in back.collect())
    exp = ev.groupBy("user").agg(F.sort_array(F.collect_list(F.struct("date", "event_id", "item"))).alias("s"))
    exp = sorted((r["user"], [x["item"] for x in r["s"]]) for r in exp.collect())
    assert got == exp


def test_select_then_sorted_csv_output(spark, tmp_path):
    _, src = _events_csv(spark, tmp_path)
    out = str(tmp_path / "sorted")
    spec = {"input": {"sources": [{"type": "Csv", "csv_path": src, "label": "events"}]},
            "transformations": [{"type": "Select", "cols": ["date", "item"]}],
            "output": [{"type": "Csv", "name": "test", "path": out,
                        "transformations": [{"type": "SortBy", "column": "date"}]}]}
    frames = build_pipeline(spark, spec)
    assert frames["test"].columns == ["date", "item"]
    run_pipeline(spark, spec)
    parts = sorted(f for f in os.listdir(out) if f.startswith("part-"))
    dates = []
    for f in parts:
        with open(os.path.join(out, f)) as fh:
            dates += [int(line.split(",")[0]) for line in fh.read().splitlines()[1:]]
    assert len(dates) == events_interactions(spark, SF001).count()
    assert dates == sorted(dates)


def test_strict_cast_raises_and_try_cast_nulls(spark):
    from seqwright.operators.transforms import cast
    df = spark.createDataFrame([("1",), ("x",)], "v STRING")
    assert [r["v"] for r in cast(df, "v", "bigint").collect()] == [1, None]
    import pytest
    with pytest.raises(Exception):
        cast(df, "v", "bigint", strict=True).collect()


def test_triplet_source_to_parquet_output(spark, tmp_path):
    ev = events_interactions(spark, SF001).select("user", "item", F.col("event_id").alias("date"))
    src = str(tmp_path / "triplets")
    files.write_triplets(ev, src)
    out = str(tmp_path / "out")
    run_pipeline(spark, {"input": {"sources": [{"type": "Triplets", "path": src, "label": "t"}]},
                         "transformations": [{"type": "Select", "cols": ["user", "date", "item"]}],
                         "output": [{"type": "Parquet", "name": "o", "path": out}]})
    back = spark.read.parquet(out)
    assert back.columns == ["user", "date", "item"]
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, ev.select("user", "date", "item").collect()))
