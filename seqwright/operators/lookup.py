"""Id lookups as joins (J1-J3), with a checked broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest side table (estimated bytes) that is broadcast instead of shuffled.
BROADCAST_BYTES = 64 * 1024 * 1024


def lookup(df: DataFrame, table: DataFrame, key, *, est_rows: int | None = None,
           row_bytes: int | None = None, how: str = "inner") -> DataFrame:
    """Equi-join ``df`` with an id-indexed ``table``.

    The side is broadcast only when ``est_rows * row_bytes`` (a bound the caller knows, e.g.
    ``num_items + 1`` rows of ``8 * width`` bytes) is under ``BROADCAST_BYTES``; otherwise both
    sides shuffle on the key and AQE splits a skewed key."""
    if est_rows is not None and row_bytes is not None and est_rows * row_bytes <= BROADCAST_BYTES:
        table = F.broadcast(table)
    return df.join(table, key, how)


def lookup_user_weights(df: DataFrame, user_weights: DataFrame) -> DataFrame:
    """Per-user recurrence weights. Never broadcast (3*H*H values per user)."""
    return df.join(user_weights, "user")


def lookup_item_weights(df: DataFrame, item_weights: DataFrame, num_items: int, hidden: int) -> DataFrame:
    """Per-item input vectors; broadcast under the size limit."""
    return lookup(df, item_weights, "item", est_rows=num_items + 1, row_bytes=8 * 4 * hidden + 64)


def train_valid_pairs(split: DataFrame, col: str = "item", segment_len: int | None = None) -> DataFrame:
    """The train and valid sequences of the users that have both, so the state can carry from
    one into the other. ``split`` is a positioned frame with a ``split`` column
    (:func:`~seqwright.operators.sequences.temporal_split`); the result has one row per user,
    split and segment with ``start``, ``n`` and ``<col>_list``. The parts of a user are paired on
    the collected rows, which are few, in one pass over the events."""
    from pyspark.sql import Window

    from seqwright.operators.sequences import collect_sequences

    seqs = collect_sequences(split, ["pos"], ["user", "split"], [col], segment_len=segment_len)
    both = Window.partitionBy("user")
    seqs = seqs.withColumn("_a", F.min("split").over(both)).withColumn("_b", F.max("split").over(both))
    return seqs.where((F.col("_a") == "train") & (F.col("_b") == "valid")).drop("_a", "_b")
