"""Fits over a bucketed weight store (M4, M6, M10, F9): batches of whole users, a step at a time.

A batch is a group of user buckets (:mod:`seqwright.model.store`), drawn anew for every epoch by a hash of
(seed, epoch, bucket), so a step reads and writes its batch's buckets only. Two ways to update:

* ``update_every="chunk"``: the session of a recurrent model. All sequences of a batch are at the same chunk;
  a step runs chunk k from the states that chunk k-1 left, updates the weights, and hands its states
  on. The gradient stops at chunk starts. The objective divides by all sequences of the batch, those that
  have ended included (they are its padding). The next step's states are a table of the step before.
* ``update_every="batch"``: one step over all windows of the batch.

After its training steps a batch's users are validated with the weights of that moment, starting from their
last training states. Steps, batches and a report for every tenth of an epoch's positions go to a history and a
progress table as the run gets there, so a run that dies leaves what it did. A run that is started again on
its store goes on after the last finished step; the draw of batches depends on the seed only.
"""

from __future__ import annotations

import hashlib
import time
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqwright.model.scoring import score
from seqwright.model.store import WeightStore, bucket_of
from seqwright.model.training import StepConfig, Tables, scheduled_lr, step_frame, updated_shared, updated_users
from seqwright.session import remove_path, scratch_path

HISTORY = ("epoch INT, step INT, chunk BIGINT, split STRING, log_loss DOUBLE, accuracy DOUBLE, n BIGINT, seconds DOUBLE, lr DOUBLE, "
           "macro_log_loss DOUBLE")
PROGRESS = "epoch INT, tenth INT, triplets BIGINT, total BIGINT, log_loss DOUBLE, seconds DOUBLE, wps DOUBLE"
ROWS = ["user", "seg", "pos", "item", "target"]


def batches_of(n_buckets: int, n_batches: int, seed: int, epoch: int) -> list[list[int]]:
    """The buckets of each batch of an epoch, in the order they are visited (SQL gives the same from MD5)."""
    def draw(*parts) -> int:
        return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)

    groups: dict[int, list[int]] = {}
    for b in range(n_buckets):
        groups.setdefault(draw(seed, epoch, b) % n_batches, []).append(b)
    order = sorted(groups, key=lambda g: (hashlib.md5(f"{seed}:order:{epoch}:{g}".encode()).hexdigest(), g))
    return [groups[g] for g in order]


def _by_bucket(spark: SparkSession, rows: DataFrame, n: int, name: str) -> tuple[DataFrame, str]:
    """The rows as a table with a folder per bucket: a batch reads its own."""
    path = scratch_path(spark, name)
    rows.select(*ROWS).withColumn("bucket", bucket_of(n)).repartition("bucket", "user").write.partitionBy("bucket").parquet(path)
    return spark.read.parquet(path), path


def bucket_step(spark: SparkSession, rows: DataFrame, store: WeightStore, buckets: list[int], cfg: StepConfig, scale: float,
                state: DataFrame | None = None, place: dict | None = None) -> dict:
    """One training step of a batch of buckets, committed to the store. ``state`` are the users' states at its start;
    with ``cfg.emit_state`` the states at its end become the store's. Returns loss, n, hits and, from the states,
    ``per_user``: a table (user, cost, size)."""
    t = store.tables(buckets)
    out = step_frame(spark, rows, t.user_w, t.item_w, t.shared_w, cfg, scale, init_state=state)
    path = scratch_path(spark, "bucket-step")
    out.write.partitionBy("kind").parquet(path)
    res = spark.read.parquet(path)
    users = updated_users(res, t.user_w, cfg)
    item, shared, st = updated_shared(spark, res, t, cfg)
    after = None
    if cfg.emit_state:
        own = res.where(F.col("kind") == "state")
        after = own.select(F.col("id").alias("user"), F.col("v1").alias("h"))
        st["per_user"] = own.select(F.col("id").alias("user"), F.col("loss").alias("cost"), F.col("cnt").alias("size"))
        if state is not None:   # users whose sequence has ended keep their state
            after = after.unionByName(state.select("user", "h").join(after.select("user"), "user", "left_anti"))
    store.commit(users, buckets, item, shared, after, place)
    st["path"] = path
    return st


def _append(spark: SparkSession, path: str, schema: str, *rows: tuple) -> None:
    spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(path)


def _logged(spark: SparkSession, path: str, epoch: int, step: int) -> bool:
    """Whether the history has this step's validation."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return False
    log = spark.read.schema(HISTORY).parquet(path)
    return bool(log.where((F.col("epoch") == epoch) & (F.col("step") == step) & (F.col("split") == "valid")).limit(1).count())


def _errors(per_user: list[DataFrame]) -> tuple[float, int]:
    """(sum over sequences of cost / length, number of sequences with a length) over the chunks of a batch."""
    both = per_user[0]
    for p in per_user[1:]:
        both = both.unionByName(p)
    e = both.groupBy("user").agg(F.try_divide(F.sum("cost"), F.sum("size")).alias("e"))
    r = e.agg(F.coalesce(F.sum("e"), F.lit(0.0)).alias("s"), F.count("e").alias("k")).first()
    return float(r["s"]), int(r["k"])


def fit_buckets(spark: SparkSession, train_rows: DataFrame, valid_rows: DataFrame | None, t: Tables | None, cfg: StepConfig, *,
                window_len: int, epochs: int, n_batches: int, update_every: str = "batch", n_buckets: int | None = None,
                schedule: tuple[int, int] | None = None, seed: int = 0, log_path: str | None = None,
                store_path: str | None = None, max_steps: int | None = None):
    """Fit from the tables ``t`` (or, with None, from the store at ``store_path``, after its last finished step).
    ``max_steps`` stops the run after so many further steps. Returns (store, history path, progress path)."""
    if update_every not in ("chunk", "batch"):
        raise ValueError("update_every must be 'chunk' or 'batch'")
    if update_every == "chunk" and not cfg.carry:
        raise ValueError("updates per chunk need state carry")
    if t is not None:
        store_path = store_path or scratch_path(spark, "weights")
        store = WeightStore.create(spark, store_path, t, n_buckets or 8 * n_batches)
    else:
        store = WeightStore.open(spark, store_path)
    n = store.n_buckets
    log_path = log_path or scratch_path(spark, "fit-log")
    progress_path = f"{log_path.rstrip('/')}-progress"
    done = tuple((store.manifest.get("place") or {}).get("at", (0, 0, 0)))   # (epoch, batch, step in the batch) of the last step
    train, tp = _by_bucket(spark, train_rows, n, "train-buckets")
    scratch = [tp]
    valid = None
    if valid_rows is not None:
        valid, vp = _by_bucket(spark, valid_rows, n, "valid-buckets")
        scratch.append(vp)
    per_bucket = {r["bucket"]: r["k"] for r in train.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).collect()}   # n rows
    if valid is not None:
        for r in valid.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).collect():
            per_bucket[r["bucket"]] = per_bucket.get(r["bucket"], 0) + r["k"]
    total = sum(per_bucket.values())
    run = replace(cfg, emit_state=cfg.carry)
    steps = 0
    for epoch in range(1, epochs + 1):
        start, seen, tenth = time.time(), 0, 1
        errors = [0.0, 0]
        for number, buckets in enumerate(batches_of(n, n_batches, seed, epoch), 1):
            rows = train.where(F.col("bucket").isin(buckets)).drop("bucket")
            shape = rows.groupBy("user").agg(F.count_distinct("seg").alias("w")).agg(
                F.count(F.lit(1)).alias("users"), F.sum("w").alias("windows")).first()
            if not shape["users"]:
                continue
            if update_every == "chunk":
                # one number per chunk of the longest sequence, the steps this batch takes
                chunks = sorted(r["seg"] for r in rows.select("seg").distinct().collect())
                scale = 1.0 / (shape["users"] * window_len)
            else:
                chunks, scale = [None], 1.0 / (shape["windows"] * window_len)
            state, per_user, paths = None, [], []
            ran = False
            for k, chunk in enumerate(chunks, 1):
                if (epoch, number, k) <= done:
                    state = store.states() if (epoch, number, k) == done else None
                    continue
                t0 = time.time()
                lr = scheduled_lr(store.step + 1, cfg.lr, *schedule) if schedule else cfg.lr
                part = rows if chunk is None else rows.where(F.col("seg") == chunk)
                st = bucket_step(spark, part, store, buckets, replace(run, lr=lr), scale, state, {"at": [epoch, number, k]})
                state = store.states()
                paths.append(st["path"])
                if "per_user" in st:
                    per_user.append(st["per_user"])
                accuracy = float(st["hits"] / st["n"]) if st["n"] else None
                _append(spark, log_path, HISTORY, (epoch, store.step, chunk, "train", float(st["loss"] * scale), accuracy, int(st["n"]),
                                                   time.time() - t0, lr, None))
                steps, ran = steps + 1, True
                if max_steps is not None and steps >= max_steps:
                    break
            if per_user:
                s, c = _errors(per_user)
                errors = [errors[0] + s, errors[1] + c]
            stopped = max_steps is not None and steps >= max_steps
            if not ran and (epoch, number) == done[:2] and valid is not None:
                # the run before may have ended between the last step of a batch and its validation
                ran = not _logged(spark, log_path, epoch, store.step)
            if valid is not None and ran and not stopped:
                t0 = time.time()
                now = store.tables(buckets)
                sc = score(spark, valid.where(F.col("bucket").isin(buckets)).drop("bucket"), now.user_w, now.item_w, now.shared_w,
                           num_items=cfg.num_items, hidden=cfg.hidden, carry=cfg.carry, reset_gate=cfg.reset_gate, act=cfg.act,
                           init_state=state, shared_bytes=cfg.shared_bytes, emit_states=False)
                real = F.col("target") > 0
                loss = F.when(real, F.col("lse") - F.col("tlogit"))
                per = sc.groupBy("user").agg(F.sum(loss).alias("c"), F.sum(F.when(real, (F.col("argmax") == F.col("target")).cast("double")))
                                             .alias("h"), F.count(loss).alias("k"), F.count(F.lit(1)).alias("len"))
                m = per.agg(F.try_divide(F.sum("c"), F.sum("k")).alias("l"), F.try_divide(F.sum("h"), F.sum("k")).alias("a"),
                            F.sum("k").alias("n"), F.avg(F.coalesce("c", F.lit(0.0)) / F.col("len")).alias("macro")).first()
                _append(spark, log_path, HISTORY, (epoch, store.step, None, "valid", m["l"], m["a"], int(m["n"] or 0), time.time() - t0,
                                                   None, m["macro"]))
            for p in paths:
                remove_path(spark, p)
            if stopped:
                break
            # a report for every tenth of the epoch's positions that this batch reached
            seen += sum(per_bucket.get(b, 0) for b in buckets)
            reports = []
            while tenth <= 10 and seen * 10 >= tenth * total:
                spent = time.time() - start
                reports.append((epoch, tenth, seen, total, errors[0] / errors[1] if errors[1] else None, spent, seen / spent))
                tenth += 1
            if reports and ran:
                _append(spark, progress_path, PROGRESS, *reports)
        else:
            continue
        break
    for p in scratch:
        remove_path(spark, p)
    return store, log_path, progress_path
