"""Loss and quality metrics over scored positions.

A scored frame has ``user, seg, pos, target, lse, tlogit, argmax`` (see
``seqwright.model.scoring``); ``loss = lse - tlogit`` is the softmax cross-entropy
of the next item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_loss(scored: DataFrame, mask_zero: bool = True) -> DataFrame:
    """``loss`` and ``masked`` (= loss * sign(target)); ``hit`` = arg-max equals target."""
    loss = F.col("lse") - F.col("tlogit")
    masked = F.when(F.col("target") > 0, loss).otherwise(F.lit(0.0)) if mask_zero else loss
    return (scored.withColumn("loss", loss).withColumn("masked", masked)
            .withColumn("hit", (F.col("argmax") == F.col("target")).cast("int")))


def sequence_loss(scored: DataFrame, keys=("user", "chunk")) -> DataFrame:
    """A3: summed masked loss and true length per sequence chunk."""
    return scored.groupBy(*keys).agg(F.sum("masked").alias("cost"),
                                     F.count(F.lit(1)).cast("int").alias("seq_len"))


def sequence_error(chunk_loss: DataFrame, keys=("user",)) -> DataFrame:
    """A4: cost over length across the chunks of a sequence; 0/0 gives NULL (the NaN)."""
    return chunk_loss.groupBy(*keys).agg(
        F.try_divide(F.sum("cost"), F.sum("seq_len").cast("double")).alias("error"))


def macro_mean(errors: DataFrame, keys=(), col="error") -> DataFrame:
    """A5: mean over sequences, skipping undefined ones (nanmean)."""
    return errors.groupBy(*keys).agg(F.avg(col).alias("log_loss"))


def mean_loss(scored: DataFrame, keys=(), *, window_len: int, seq=("user", "chunk")) -> DataFrame:
    """Position-level mean of the loss over real targets, and the training objective: the
    masked sum over ``windows * window_len`` positions, the padding of short windows included."""
    w = scored.groupBy(*dict.fromkeys([*keys, *seq])).agg(
        F.sum(F.when(F.col("target") > 0, F.col("loss"))).alias("_l"),
        F.count(F.when(F.col("target") > 0, F.lit(1))).alias("_k"), F.sum("masked").alias("_m"))
    return w.groupBy(*keys).agg(
        F.try_divide(F.sum("_l"), F.sum("_k")).alias("mean_loss"),
        (F.sum("_m") / (F.count(F.lit(1)) * F.lit(window_len))).alias("objective"))


def accuracy(scored: DataFrame, keys=()) -> DataFrame:
    """Sparse categorical accuracy over real targets."""
    real = F.col("target") > 0
    return scored.groupBy(*keys).agg(
        F.avg(F.when(real, F.col("hit"))).alias("accuracy"),
        F.count(F.when(real, F.lit(1))).cast("bigint").alias("n"))


def running(per_step: DataFrame, order: str, sums: dict[str, tuple[str, str]], partition=()) -> DataFrame:
    """Cumulative metrics over steps (never reset) next to the per-step values (reset).
    ``sums`` maps an output name to (numerator sum column, denominator sum column); the
    per-step table has one row per step, so the running window is small."""
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = per_step
    for name, (num, den) in sums.items():
        out = out.withColumn(f"running_{name}", F.sum(num).over(w) / F.sum(den).over(w))
    return out


def progress(per_batch: DataFrame, order: str = "step") -> DataFrame:
    """cumulative triplets over cumulative seconds (the reference's "wps")."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (per_batch.withColumn("triplets", F.sum("n").over(w))
            .withColumn("elapsed", F.sum("seconds").over(w))
            .withColumn("wps", F.col("triplets") / F.col("elapsed")))
