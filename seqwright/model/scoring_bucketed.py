"""Scoring without an exchange (J1, M1): sequences and user weights in tables that are bucketed alike.

The windows of a user are grouped into array rows of at most ``PIECE`` positions (the user's positions 1.. in
order) and written bucketed by ``user``; so is the weight table. Spark's sort-merge join of two tables with the
same buckets needs no shuffle, and the fold reads the joined rows: nothing moves between tasks, however often the
sequences are scored. The wide weight row is joined to a user's first piece only (the other pieces follow in the same
task after a local sort), so it is neither repeated nor carried through the sort more than once.

A user is in one bucket, so one task folds a user from start to end, as state carry needs; the task holds an Arrow
batch at a time. Use :func:`seqwright.model.scoring.score` with ``carry=False`` where windows are independent: it
spreads a hot user over tasks.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqwright.model.scoring import SCORE_SCHEMA, _make_fold
from seqwright.model.weights import MAX_SHARED_BYTES, shared_arrays
from seqwright.session import scratch_path

PIECE = 4096


def _table(df: DataFrame, name: str, n: int, path: str | None, order: list[str]) -> str:
    """``df`` as a table of n buckets by user; returns its name in the session's catalog. Rows come to a bucket in one
    task, so a bucket is one file."""
    spark = df.sparkSession
    name = f"{name}_{uuid.uuid4().hex}"
    out = df.repartition(n, "user").write.bucketBy(n, "user").sortBy(*order)
    out.option("path", path or scratch_path(spark, name)).saveAsTable(name)
    return name


def bucketed_users(user_w: DataFrame, n: int, path: str | None = None) -> str:
    """The weight table (user, gate, cand) in n buckets."""
    return _table(user_w.select("user", "gate", "cand"), "user_weights", n, path, ["user"])


def bucketed_sequences(rows: DataFrame, n: int, path: str | None = None, piece: int = PIECE) -> str:
    """Rows (user, seg, pos, item, target[, n]) as array rows in n buckets; ``pos`` is a user's position, from 1."""
    count = F.col("n").cast("bigint") if "n" in rows.columns else F.lit(None).cast("bigint")
    r = rows.select("user", F.floor((F.col("pos") - 1) / piece).cast("bigint").alias("piece"),
                    F.struct(F.col("seg").cast("bigint").alias("seg"), F.col("pos").cast("bigint").alias("pos"),
                             F.col("item").cast("bigint").alias("item"), F.col("target").cast("bigint").alias("target"),
                             count.alias("n")).alias("e"))
    r = r.groupBy("user", "piece").agg(F.sort_array(F.collect_list("e")).alias("e"))
    cols = [F.col(f"e.{c}").alias(c) for c in ("seg", "pos", "item", "target", "n")]
    return _table(r.select("user", "piece", (F.col("piece") == 0).alias("first"), *cols), "sequences", n, path, ["user", "piece"])


def _rows(batches):
    """Joined rows as the weight and event rows that the fold reads."""
    for pdf in batches:
        if pdf.empty:
            continue
        own = pdf["first"].to_numpy(bool) & pdf["gate"].notna().to_numpy()
        weights = pd.DataFrame({"user": pdf["user"].to_numpy()[own], "kind": 0, "gate": pdf["gate"][own].to_list(),
                                "cand": pdf["cand"][own].to_list(), "h0": pdf["h0"][own].to_list()})
        size = pdf["pos"].map(len).to_numpy()
        flat = {c: np.concatenate(pdf[c].to_list()) for c in ("seg", "pos", "item", "target", "n")}
        events = pd.DataFrame({"user": np.repeat(pdf["user"].to_numpy(), size), "kind": 1, **flat, "gate": None, "cand": None, "h0": None})
        yield pd.concat([weights, events], ignore_index=True) if len(weights) else events


def score_bucketed(spark: SparkSession, sequences: str, users: str, item_w: DataFrame, shared_w: DataFrame, *, num_items: int,
                   hidden: int, reset_gate: bool = False, act: str = "tanh", init_state: DataFrame | None = None,
                   shared_bytes: int | None = None, emit_states: bool = True) -> DataFrame:
    """As :func:`seqwright.model.scoring.score` with state carry, over tables of :func:`bucketed_sequences` and
    :func:`bucketed_users` with the same number of buckets. ``init_state`` (user, h) costs the exchange of that table.
    The item table must fit its bound."""
    limit = shared_bytes or MAX_SHARED_BYTES
    bsh = spark.sparkContext.broadcast(shared_arrays(item_w, shared_w, num_items, hidden, limit).arrays())
    s, u = spark.table(sequences).alias("s"), spark.table(users)
    if init_state is not None:
        u = u.join(init_state.select("user", F.col("h").alias("h0")).hint("merge"), "user", "left")
    else:
        u = u.withColumn("h0", F.lit(None).cast("array<double>"))
    u = u.hint("merge").alias("u")
    j = s.join(u, (F.col("s.user") == F.col("u.user")) & F.col("s.first"), "left")
    j = j.select("s.user", "s.piece", "s.first", "s.seg", "s.pos", "s.item", "s.target", "s.n", "u.gate", "u.cand", "u.h0")
    j = j.sortWithinPartitions("user", "piece")
    fold = _make_fold(bsh, hidden, True, reset_gate, act, states=emit_states)
    return j.mapInPandas(lambda batches: fold(_rows(batches)), SCORE_SCHEMA)
