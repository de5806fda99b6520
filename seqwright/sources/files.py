"""File sources and sinks.

All readers take an explicit schema: no inference pass over the data, and the
scan only materialises the columns a later projection asks for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TRIPLET_SCHEMA = "user BIGINT, item BIGINT, date BIGINT"
# Text timestamps keep microseconds (the default CSV format stops at milliseconds).
TS_FORMATS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
              "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def read_csv(spark: SparkSession, path: str, schema: str | None = None, *, header: bool = True,
             delimiter: str = ",") -> DataFrame:
    """CSV scan (S1/S2). Without a schema every column arrives as a string, as in the
    reference; the header supplies the names."""
    r = spark.read.option("header", header).option("sep", delimiter).options(**TS_FORMATS)
    if schema is not None:
        r = r.schema(schema)
    else:
        r = r.option("inferSchema", False)
    return r.csv(path)


def read_triplets(spark: SparkSession, path: str) -> DataFrame:
    """Space-separated, headerless ``user item date`` text (S3)."""
    return spark.read.schema(TRIPLET_SCHEMA).option("sep", " ").option("header", False).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet scan (S4): vectorised column batches; filters and projections push down."""
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str, *, header: bool = True, delimiter: str = ",",
              mode: str = "overwrite") -> None:
    """CSV sink (S8). One part file per partition; a sorted frame keeps its order across
    part files because range partitions are numbered in key order."""
    df.write.mode(mode).option("header", header).option("sep", delimiter).options(**TS_FORMATS).csv(path)


def write_triplets(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.select("user", "item", "date").write.mode(mode).option("sep", " ").option("header", False).csv(path)


def write_parquet(df: DataFrame, path: str, *, partition_by: list[str] | None = None,
                  mode: str = "overwrite") -> None:
    """Parquet sink (S7): the sequence store. ``partition_by=['split']`` lets readers prune."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
