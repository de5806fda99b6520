"""State carry of very long sequences as a relay of jobs (M4).

A user's fold is sequential, so one task holds a user from start to end in
:func:`seqwright.model.scoring.score`, and a user with a third of all rows bounds the whole stage. Here users above
``segment`` positions are cut into segments of that many: job k scores the k-th segments of all long users at once
from the states that job k-1 saved, and saves its own. No task runs longer than a segment, a lost executor costs at
most one, and a run can be taken up again from the last saved states. All other users are scored in one job.

The chain of a user stays as long as the user is: what the relay bounds is the task, not the sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqwright.model.scoring import final_states, score
from seqwright.session import scratch_path

SEGMENT = 1 << 20
MAX_BROADCAST = 1_000_000   # long users that may be broadcast (at most rows / segment of them)


def score_relay(spark: SparkSession, rows: DataFrame, user_w: DataFrame, item_w: DataFrame, shared_w: DataFrame, *,
                segment: int = SEGMENT, init_state: DataFrame | None = None, **kw) -> DataFrame:
    """As ``score`` with state carry. ``pos`` is a user's position, from 1; ``init_state`` (user, h) starts users from
    saved states."""
    kw = dict(kw, carry=True)
    sizes = rows.groupBy("user").agg(F.max("pos").alias("_last")).where(F.col("_last") > segment)
    path = scratch_path(spark, "long-users")
    sizes.write.parquet(path)
    sizes = spark.read.parquet(path)
    top = sizes.agg(F.max("_last").alias("last"), F.count(F.lit(1)).alias("n")).first()
    if not top["n"]:
        return score(spark, rows, user_w, item_w, shared_w, init_state=init_state, **kw)
    long_ = sizes.select("user")
    long_ = F.broadcast(long_) if top["n"] <= MAX_BROADCAST else long_
    out = score(spark, rows.join(long_, "user", "left_anti"), user_w, item_w, shared_w, init_state=init_state, **kw)
    # the long users' rows once, a folder per segment
    path = scratch_path(spark, "segments")
    cut = rows.join(long_, "user", "left_semi").withColumn("_segment", F.floor((F.col("pos") - 1) / segment).cast("int"))
    cut.write.partitionBy("_segment").parquet(path)
    cut, state = spark.read.parquet(path), init_state
    for k in range(-(-int(top["last"]) // segment)):
        part = score(spark, cut.where(F.col("_segment") == k).drop("_segment"), user_w, item_w, shared_w, init_state=state,
                     **dict(kw, emit_states=True))
        path = scratch_path(spark, f"relay-{k}")
        part.write.parquet(path)
        part = spark.read.parquet(path)
        now = final_states(part)
        if state is not None:   # a user without rows in this segment keeps its state
            now = now.unionByName(state.select("user", "h").join(now.select("user"), "user", "left_anti"))
        path = scratch_path(spark, "relay-state")
        now.write.parquet(path)
        state = spark.read.parquet(path)
        out = out.unionByName(part)
    return out
