"""Shared pieces of the training-data operators: word splitting, shared scratch tables, sizes."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqwright.session import remove_path, scratch_path

#: The separators of a word: space, tab, line feed, vertical tab, form feed, carriage return.
SEPARATORS = " \t\n\u000b\f\r"
SEPARATOR_RUN = "[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text in order; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SEPARATORS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SEPARATOR_RUN))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def md5_number(*parts: Column | str) -> Column:
    """The first 13 hexadecimal digits of an MD5 over ':'-joined parts, as a BIGINT (below 2^52).
    SQL engines that have MD5 give the same number."""
    cols = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("~")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *cols)), 1, 13), 16, 10).cast("bigint")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that ``spark.checkpoint.dir`` names. Only local sessions
    without that setting get a temporary folder; a cluster session without it is refused."""
    return scratch_path(spark, name)


#: Paths of the tables :func:`written` made, as long as a :func:`scratch` block is open.
_MADE: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Removes the tables that were written inside the block when it ends: whatever is read after it must have been
    written by then, to a path the block does not know."""
    _MADE.append([])
    try:
        yield
    finally:
        for path in _MADE.pop():
            remove_path(spark, path)


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """The frame as a table written to the shared folder and read back: lineage ends here."""
    path = shared_path(df.sparkSession, name)
    if _MADE:
        _MADE[-1].append(path)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that do not clash with those of ``df`` (case-insensitively)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out
