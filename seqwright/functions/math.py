"""Column-expression math (F1-F8): all JVM-side, inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sigmoid(x) -> Column:
    """F1."""
    return 1.0 / (1.0 + F.exp(-_c(x)))


def tanh(x) -> Column:
    """the default cell activation."""
    return F.tanh(_c(x))


def sign(x) -> Column:
    """used as the target mask (1 for a real next item, 0 for padding)."""
    return F.signum(_c(x))


def logsumexp(logits) -> Column:
    """Stable ``log(sum(exp(l)))``: shift by the largest logit first."""
    lg = _c(logits)
    m = F.array_max(lg)
    return F.log(F.aggregate(lg, F.lit(0.0), lambda a, x: a + F.exp(x - m))) + m


def softmax_xent(logits, target) -> Column:
    """sparse softmax cross-entropy from logits; ``target`` is a 0-based index."""
    lg = _c(logits)
    return logsumexp(lg) - F.element_at(lg, _c(target).cast("int") + 1)


def argmax(logits) -> Column:
    """0-based index of the largest value (first one on ties)."""
    lg = _c(logits)
    return (F.array_position(lg, F.array_max(lg)) - 1).cast("bigint")


def dot(a, b) -> Column:
    """dot product of two equal-length arrays."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def with_softmax(df, logits: str, out: str):
    """Softmax of an array column, in two projections so the normaliser is computed once
    per row rather than once per element."""
    df = df.withColumn("_mx", F.array_max(logits))
    df = df.withColumn("_lse", F.log(F.aggregate(F.col(logits), F.lit(0.0),
                                                 lambda a, x: a + F.exp(x - F.col("_mx")))) + F.col("_mx"))
    return df.withColumn(out, F.transform(F.col(logits), lambda x: F.exp(x - F.col("_lse")))).drop("_mx", "_lse")


def lr_schedule(step, lr0: float, total_steps: int, warmup_steps: int = 0) -> Column:
    """F8: linear warm-up to ``lr0`` over ``warmup_steps``, then linear decay to 0 at
    ``total_steps``: ``lr0*(1 - min(step, N)/N)``."""
    s = _c(step).cast("double")
    decay = F.lit(lr0) * (1.0 - F.least(s, F.lit(float(total_steps))) / float(total_steps))
    if not warmup_steps:
        return decay
    return F.when(s < warmup_steps, F.lit(lr0) * s / float(warmup_steps)).otherwise(decay)


def with_rmsprop(df, w: str, g: str, ms: str, lr: float, rho: float = 0.9, eps: float = 1e-8,
                 out_w: str | None = None, out_ms: str | None = None):
    """M7 on array columns: ``ms = rho*ms + (1-rho)*g^2``, ``w -= lr*g/sqrt(ms+eps)``.
    A NULL gradient (a row the batch did not touch) leaves ``w`` and ``ms`` unchanged, as a
    sparse update does. Each array is computed in its own projection (no re-evaluation)."""
    out_w, out_ms = out_w or w, out_ms or ms
    df = df.withColumn("_ms_new", F.when(F.col(g).isNull(), F.col(ms)).otherwise(
        F.zip_with(F.col(ms), F.col(g), lambda m, x: F.lit(rho) * m + F.lit(1.0 - rho) * x * x)))
    step = F.transform(F.arrays_zip(F.col(w).alias("w"), F.col(g).alias("g"), F.col("_ms_new").alias("m")),
                       lambda e: e["w"] - F.lit(lr) * e["g"] / F.sqrt(e["m"] + F.lit(eps)))
    df = df.withColumn("_w_new", F.when(F.col(g).isNull(), F.col(w)).otherwise(step))
    return df.withColumn(out_w, F.col("_w_new")).withColumn(out_ms, F.col("_ms_new")).drop("_w_new", "_ms_new")


def round6(x) -> Column:
    return F.round(_c(x), 6)
