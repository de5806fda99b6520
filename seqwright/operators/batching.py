"""Seeded, reproducible order and batching.

Every random choice is a hash of ``seed:epoch:key`` so that a rerun (or a retried
task) gives the same batches, and no global single-partition sort is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded_hash(seed: int, epoch, *keys) -> Column:
    """First 8 hex digits of ``md5(seed:epoch:key...)`` as a non-negative BIGINT."""
    parts = [F.lit(str(seed)), epoch if isinstance(epoch, Column) else F.lit(str(epoch))]
    parts += [F.col(k) if isinstance(k, str) else k for k in keys]
    h = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")


def batch_ids(windows: DataFrame, n_batches: int, seed: int, epoch=0, keys=("user", "chunk")) -> DataFrame:
    """``batch_id`` in ``[0, n_batches)``; batch sizes are approximately equal."""
    return windows.withColumn("batch_id", (seeded_hash(seed, epoch, *keys) % n_batches).cast("bigint"))


def shuffled_examples(windows: DataFrame, n_batches: int, seed: int, epoch=0,
                      keys=("user", "chunk"), **position_kw) -> DataFrame:
    """O3+O4: batches plus a shuffled rank (``slot``, 1-based) inside each batch: windows are
    ordered by a seeded hash (two 32-bit halves, then the key). A batch holds about
    ``1/n_batches`` of all windows, so the rank is computed by the skew-aware
    :func:`~seqwright.operators.sequences.positions`, which splits large batches into
    bounded segments instead of ranking a whole batch in one task."""
    from seqwright.operators.sequences import positions
    b = batch_ids(windows, n_batches, seed, epoch, keys)
    h = F.md5(F.concat_ws(":", F.lit(f"{seed}:{epoch}:slot"), *[F.col(k).cast("string") for k in keys]))
    b = (b.withColumn("_h1", F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint"))
         .withColumn("_h2", F.conv(F.substring(h, 9, 8), 16, 10).cast("bigint")))
    out = positions(b, "batch_id", ["_h1", "_h2", *keys], [], pos_col="slot", n_col="_bn", **position_kw)
    return out.drop("_h1", "_h2", "_bn")


def epoch_order(batches: DataFrame, seed: int, epoch) -> DataFrame:
    """A permutation of the batch ids of one epoch (``step``, 1-based). ``batches`` holds
    one row per batch id (at most ``n_batches`` rows), so the global rank is cheap."""
    h = F.md5(F.concat_ws(":", F.lit(f"{seed}:order"), F.lit(str(epoch)), F.col("batch_id").cast("string")))
    w = Window.orderBy(h, "batch_id")
    return batches.select("batch_id").distinct().withColumn("step", F.row_number().over(w).cast("bigint"))


def epoch_orders(batches: DataFrame, seed: int, epochs: int) -> DataFrame:
    """O5 for epochs ``1..epochs`` at once: ``batches`` (one row per ``batch_id``, other columns kept)
    with ``epoch`` and ``step``."""
    b = batches.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))).withColumn("epoch", F.col("epoch").cast("int"))
    h = F.md5(F.concat_ws(":", F.lit(f"{seed}:order"), F.col("epoch").cast("string"), F.col("batch_id").cast("string")))
    w = Window.partitionBy("epoch").orderBy(h, "batch_id")
    return b.withColumn("step", F.row_number().over(w).cast("bigint"))


def epoch_steps(order: DataFrame, max_steps: int) -> DataFrame:
    """Only the first ``max_steps`` batches of an epoch are drawn."""
    return order.where(F.col("step") <= max_steps)


def repeat_epochs(df: DataFrame, epochs: int, col: str = "epoch") -> DataFrame:
    """``epochs`` passes over the data, as an ``epoch`` column (1-based)."""
    return df.withColumn(col, F.explode(F.sequence(F.lit(1), F.lit(epochs)))).withColumn(col, F.col(col).cast("int"))
