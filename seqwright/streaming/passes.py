"""Endless or counted passes over a stored table, resumable at every step.

The stream does not carry the data: its source (a Python data source) gives one small row a step, (epoch, step,
batch_id), in the seeded batch order of every epoch, and its offset is the last (epoch, step). Spark's checkpoint
keeps the offset, so a run that stops goes on with the step it had not finished. The data lies in a table
with a folder per batch; the step's handler reads that folder through Spark, whatever file system it is on.

A step that was under way when a run died is handed out again, the same one: handlers that write must write by
(epoch, step), as :func:`write_steps` does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

STEPS = "epoch INT, step BIGINT, batch_id BIGINT"
FORMAT = "seqwright_passes"


def batch_order(batches: list[int], seed: int, epoch: int) -> list[int]:
    """An epoch's order of the batches, as ``operators.batching.epoch_order`` gives it."""
    return sorted(batches, key=lambda b: (hashlib.md5(f"{seed}:order:{epoch}:{b}".encode()).hexdigest(), b))


class _Steps(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.batches = [int(x) for x in options["batches"].split(",") if x]
        self.seed = int(options["seed"])
        self.epochs = int(options.get("epochs", "0")) or None
        self.limit = int(options.get("steps_per_epoch", "0")) or None
        self.at_once = int(options.get("steps_per_trigger", "1"))

    def _epoch(self, epoch: int) -> list[int]:
        order = batch_order(self.batches, self.seed, epoch)
        return order[:self.limit] if self.limit else order

    def _after(self, at: dict):
        """The steps after an offset, without end if the passes have none."""
        epoch, step = at["epoch"], at["step"]
        while self.batches and (self.epochs is None or epoch <= self.epochs):
            for i, b in enumerate(self._epoch(epoch), 1):
                if i > step:
                    yield epoch, i, b
            epoch, step = epoch + 1, 0

    def initialOffset(self) -> dict:
        return {"epoch": 1, "step": 0}

    def read(self, start: dict):
        rows = [r for r, _ in zip(self._after(start), range(self.at_once))]
        return iter(rows), {"epoch": rows[-1][0], "step": rows[-1][1]} if rows else start

    def readBetweenOffsets(self, start: dict, end: dict):
        if start == end:
            return iter(())
        rows = []
        for r in self._after(start):
            rows.append(r)
            if (r[0], r[1]) == (end["epoch"], end["step"]):
                break
        return iter(rows)

    def commit(self, end: dict) -> None:
        pass


class PassesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return STEPS

    def simpleStreamReader(self, schema):
        return _Steps(self.options)


def store_batches(rows: DataFrame, path: str) -> None:
    """Rows with ``batch_id`` as a table with a folder per batch."""
    rows.repartition("batch_id").write.partitionBy("batch_id").parquet(path)


def start_passes(spark: SparkSession, path: str, each: Callable[[DataFrame, int, int], None], checkpoint: str, *, seed: int,
                 epochs: int | None = None, steps_per_epoch: int | None = None, steps_per_trigger: int = 1):
    """Starts the passes over the batches stored at ``path``: ``each(rows, epoch, step)`` runs for every step, in order.
    Without ``epochs`` they never end. Returns the StreamingQuery."""
    spark.dataSource.register(PassesSource)
    data = spark.read.parquet(path)
    batches = sorted(r["batch_id"] for r in data.select("batch_id").distinct().collect())   # one number a batch
    src = spark.readStream.format(FORMAT).option("batches", ",".join(map(str, batches))).option("seed", seed)
    src = src.option("epochs", epochs or 0).option("steps_per_epoch", steps_per_epoch or 0).option("steps_per_trigger", steps_per_trigger)

    def run(steps: DataFrame, _: int) -> None:
        for r in steps.orderBy("epoch", "step").collect():   # steps_per_trigger rows
            rows = data.where(F.col("batch_id") == r["batch_id"])
            each(rows.withColumn("epoch", F.lit(r["epoch"]).cast("int")).withColumn("step", F.lit(r["step"]).cast("bigint")),
                 r["epoch"], r["step"])

    return src.load().writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()


def write_steps(path: str) -> Callable[[DataFrame, int, int], None]:
    """A handler that writes every step to a folder of its own; a step that comes again replaces itself."""
    def each(rows: DataFrame, epoch: int, step: int) -> None:
        rows.drop("epoch", "step").write.mode("overwrite").parquet(f"{path.rstrip('/')}/epoch={epoch}/step={step}")
    return each
