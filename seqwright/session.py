"""Session helpers: configuration defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", partitions: int = 8, app: str = "seqwright",
                  extra: dict | None = None) -> SparkSession:
    """Local session for tests and the benchmark; clusters bring their own session."""
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(partitions)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    The setting is read from the session (or SparkContext adopts it at start) and points at
    storage that driver and executors share. Only a local master may leave it unset: then a
    temporary folder is made, since driver and tasks are one process. Any other master is
    refused, because executors would write to their own disks."""
    sc = spark.sparkContext
    d = (spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
         or sc.getCheckpointDir())
    if not d:
        require_shared_dir(sc.master)
        d = tempfile.mkdtemp(prefix="seqwright-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def require_shared_dir(master: str) -> None:
    """Raise unless ``master`` runs everything in this process."""
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir is not set and the master is {master!r}: set it to a folder "
                         "that the driver and all executors share")


def scratch_path(spark: SparkSession, name: str, under: str | None = None) -> str:
    """A fresh path below the checkpoint folder (or below ``under``, itself a scratch path)
    for a written intermediate table. Only the name is made: whoever writes the table creates
    the folder through Spark, on whatever file system the checkpoint folder is."""
    base = (under or checkpoint_dir(spark)).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder this library wrote (superseded step tables), on whatever file
    system the checkpoint folder lives (Hadoop FileSystem API)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def ensure_utc(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
