"""Weight tables that a training run rewrites in part (M6).

User weights are by far the largest table (3 H^2 values and as many accumulators a user). The store keeps
them in hash buckets of ``user``, one folder a bucket and generation, and a step writes only the buckets of
its batch: copy on write, the other buckets stay where they are. Item and bias tables are written whole.

A generation is a folder of its own, so nothing is overwritten. A step becomes visible by its manifest, one
small file that names for every bucket the generation that holds it; it is written under another name and
then renamed. A run that dies anywhere before that leaves the manifest of the step before, and with it exactly
the tables of that step: :meth:`WeightStore.open` goes on from there. Generations that neither the last manifest
nor the one before it names are removed after each step.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqwright.operators.batching import seeded_hash

USERS = "user BIGINT, gate ARRAY<DOUBLE>, cand ARRAY<DOUBLE>, gate_ms ARRAY<DOUBLE>, cand_ms ARRAY<DOUBLE>"
STATES = "user BIGINT, h ARRAY<DOUBLE>"


def bucket_of(n_buckets: int, user: str = "user") -> Column:
    """The bucket of a user: any engine with MD5 gives the same one."""
    return (seeded_hash("bucket", 0, user) % n_buckets).cast("int")


class _Files:
    """The few file operations of the driver, on whatever file system the store lies."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.root = path.rstrip("/")
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, name: str) -> list[str]:
        p = self.path(name)
        return [s.getPath().getName() for s in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self.path(name)).getLength()

    def write(self, name: str, text: str) -> None:
        """The whole file or nothing."""
        part = self.path(f"_{uuid.uuid4().hex}")
        out = self.fs.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        self.fs.mkdirs(self.path(name).getParent())
        if not self.fs.rename(part, self.path(name)):
            raise OSError(f"cannot write {self.root}/{name}")

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class WeightStore:
    """The tables of a training run at its last finished step, below one folder."""

    def __init__(self, spark: SparkSession, path: str, manifest: dict):
        self.spark, self.root, self.manifest = spark, path.rstrip("/"), manifest
        self.files = _Files(spark, path)

    # ------------------------------------------------------------ opening
    @classmethod
    def create(cls, spark: SparkSession, path: str, t, n_buckets: int) -> WeightStore:
        """A store with the tables ``t`` as step 0."""
        store = cls(spark, path, {"step": -1, "n_buckets": n_buckets, "users": {}, "item": None, "shared": None, "state": None})
        gen = store._generation(0)
        users = t.user_w.select("user", "gate", "cand", "gate_ms", "cand_ms")
        store._write_users(users, gen, n_buckets)
        t.item_w.write.parquet(f"{store.root}/{gen}/item")
        t.shared_w.write.parquet(f"{store.root}/{gen}/shared")
        held = [n.removeprefix("bucket=") for n in store.files.names(f"{gen}/users") if n.startswith("bucket=")]
        store._publish({"step": 0, "n_buckets": n_buckets, "users": {b: gen for b in held}, "item": gen, "shared": gen, "state": None})
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> WeightStore:
        """The store as its last finished step left it."""
        files = _Files(spark, path)
        steps = sorted(n for n in files.names("manifest") if n.endswith(".json"))
        if not steps:
            raise FileNotFoundError(f"no finished step below {path}")
        return cls(spark, path, json.loads(files.read(f"manifest/{steps[-1]}")))

    # ------------------------------------------------------------ reading
    @property
    def step(self) -> int:
        return self.manifest["step"]

    @property
    def n_buckets(self) -> int:
        return self.manifest["n_buckets"]

    def users(self, buckets=None) -> DataFrame:
        """The user table, or only some buckets of it: no file of another bucket is opened."""
        held = self.manifest["users"]
        names = [str(b) for b in buckets] if buckets is not None else list(held)
        paths = [f"{self.root}/{held[b]}/users/bucket={b}" for b in names if b in held]
        if not paths:
            return self.spark.createDataFrame([], USERS)
        return self.spark.read.schema(USERS).parquet(*paths)

    def states(self) -> DataFrame | None:
        """States (user, h) that the last step saved, None if it saved none."""
        gen = self.manifest["state"]
        return self.spark.read.schema(STATES).parquet(f"{self.root}/{gen}/state") if gen else None

    def tables(self, buckets=None):
        from seqwright.model.training import Tables

        m = self.manifest
        return Tables(self.users(buckets), self.spark.read.parquet(f"{self.root}/{m['item']}/item"),
                      self.spark.read.parquet(f"{self.root}/{m['shared']}/shared"))

    def written_bytes(self) -> int:
        """Bytes of user weights that the last step wrote."""
        gen = self.manifest.get("last")
        return self.files.size(f"{gen}/users") if gen else 0

    # ------------------------------------------------------------ writing
    def _generation(self, step: int) -> str:
        return f"gen-{step:08d}-{uuid.uuid4().hex[:8]}"

    def _write_users(self, users: DataFrame, gen: str, n: int) -> None:
        b = users.withColumn("bucket", bucket_of(self.n_buckets))
        b.repartition(n, "bucket").write.partitionBy("bucket").parquet(f"{self.root}/{gen}/users")

    def commit(self, users: DataFrame, buckets, item: DataFrame, shared: DataFrame, state: DataFrame | None = None,
               place: dict | None = None) -> str:
        """One step's tables: all users of ``buckets``, the item and bias tables, and states for the next step to
        start from. ``place`` says where in the run the step stands. Returns the generation."""
        m = self.manifest
        gen = self._generation(m["step"] + 1)
        names = [str(b) for b in buckets]
        self._write_users(users, gen, len(names))
        item.write.parquet(f"{self.root}/{gen}/item")
        shared.write.parquet(f"{self.root}/{gen}/shared")
        if state is not None:
            state.select("user", "h").write.parquet(f"{self.root}/{gen}/state")
        held = m["users"] | {b: gen for b in names if b in m["users"]}
        self._publish({"step": m["step"] + 1, "n_buckets": m["n_buckets"], "users": held, "item": gen, "shared": gen,
                       "state": gen if state is not None else None, "place": place, "last": gen})
        return gen

    def _publish(self, manifest: dict) -> None:
        self.files.write(f"manifest/{manifest['step']:08d}.json", json.dumps(manifest))
        before, self.manifest = self.manifest, manifest
        used = {g for m in (before, manifest) for g in (*m["users"].values(), m["state"], m["item"], m["shared"])}
        for g in self.files.names(""):
            if g.startswith("gen-") and g not in used:
                self.files.remove(g)
        for n in sorted(self.files.names("manifest"))[:-2]:
            self.files.remove(f"manifest/{n}")
