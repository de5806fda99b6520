"""Mapping of the given tables onto the interaction model ``(user, item, date)``.

Ids start at 1: 0 is reserved for padding and "no next item".
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events_interactions(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """``events`` as interactions: user = user_id + 1, item = props.k + 1, ordered by
    ``(ts, event_id)``. Columns: user, item, ts, event_id and ``more`` of the table."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        (F.col("user_id") + 1).cast("bigint").alias("user"),
        (F.get_json_object("props", "$.k").cast("bigint") + 1).alias("item"),
        F.col("ts"),
        F.col("event_id"), *more,
    )
