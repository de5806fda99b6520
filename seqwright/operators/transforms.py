"""Declarative table transforms of the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqwright.operators.sequences import collect_sequences


def select(df: DataFrame, cols) -> DataFrame:
    """Keep the named columns, in the given order."""
    return df.select(*cols)


def cast(df: DataFrame, col: str, to_type: str, casted_col: str | None = None, *,
         strict: bool = False, from_type: str | None = None) -> DataFrame:
    """Cast ``col`` into ``casted_col`` (the same column by default).

    Malformed input becomes NULL (``try_cast``); ``strict=True`` raises instead (ANSI
    ``cast``). ``from_type`` is informational, as in the reference."""
    c = F.col(col)
    c = c.cast(to_type) if strict else c.try_cast(to_type)
    return df.withColumn(casted_col or col, c)


def sort_by(df: DataFrame, column, ascending: bool = True) -> DataFrame:
    """O1: global sort (range-partitioned exchange, then a sort inside each partition), stable: rows with
    equal values keep their order. The row's number is the last sort column, so the range cuts, which Spark
    takes from a sample of the sort columns, can fall between equal values: a value that most rows have spreads
    over as many partitions as its rows need."""
    cols = [column] if isinstance(column, str) else list(column)
    nr = "_nr"
    while nr in df.columns:
        nr = f"_{nr}"
    by = [F.col(c).asc() if ascending else F.col(c).desc() for c in cols]
    return df.withColumn(nr, F.monotonically_increasing_id()).sort(*by, nr).drop(nr)


def collect_list(df: DataFrame, order_by, group_by, cols, **kw) -> DataFrame:
    """A1: ordered collect of several columns per group (``<col>_list``)."""
    return collect_sequences(df, order_by, group_by, cols, **kw)


def dataset_stats(df: DataFrame, user: str = "user", item: str = "item") -> DataFrame:
    """A2: vocabulary sizes (largest ids: they size id-indexed weight tables) and triplet count."""
    return df.agg(F.max(user).cast("bigint").alias("num_users"),
                  F.max(item).cast("bigint").alias("num_items"),
                  F.count(F.lit(1)).cast("bigint").alias("num_triplets"))


TRANSFORMS = {
    "Select": lambda df, s: select(df, s["cols"]),
    "Cast": lambda df, s: cast(df, s["col"], s["toType"], s.get("castedCol"),
                               strict=s.get("strict", False), from_type=s.get("fromType")),
    "SortBy": lambda df, s: sort_by(df, s["column"], s.get("ascending", True)),
    "CollectList": lambda df, s: collect_list(df, s["orderBy"], s["groupBy"], s["cols"],
                                              segment_len=s.get("segmentLen"),
                                              tiebreak=s.get("tiebreak")),
}


def apply_transform(df: DataFrame, spec: dict) -> DataFrame:
    kind = spec["type"]
    if kind not in TRANSFORMS:
        raise ValueError(f"unknown transformation {kind!r}")
    return TRANSFORMS[kind](df, spec)
