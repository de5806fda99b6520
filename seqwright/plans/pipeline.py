"""Declarative pipeline (S9, S10): sources -> ordered transformations -> outputs.

A spec is a plain dict with the shape of the reference's configuration files::

    {"input": {"sources": [{"type": "Csv", "csv_path": ..., "label": "events",
                            "delimiter": ",", "header": True}]},
     "transformations": [{"type": "Cast", "col": "user", "toType": "bigint"}, ...],
     "output": [{"type": "Csv", "name": "test", "path": ...,
                 "transformations": [{"type": "SortBy", "column": "timestamp"}]}]}

Each source becomes a temp view named by its label; the transformations fold over
the first source with ``DataFrame.transform``; each output applies its own
transformations and writes. Everything stays one lazy plan per output, so
Catalyst prunes the scan to the columns the outputs use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqwright.operators.transforms import apply_transform
from seqwright.sources import files


def load_source(spark: SparkSession, src: dict) -> DataFrame:
    kind = src["type"]
    if kind == "Csv":
        return files.read_csv(spark, src["csv_path"], src.get("schema"),
                              header=src.get("header", True), delimiter=src.get("delimiter", ","))
    if kind == "Triplets":
        return files.read_triplets(spark, src["path"])
    if kind == "Parquet":
        return files.read_parquet(spark, src["path"])
    if kind == "TFRecord":
        from seqwright.sources.tfrecord import read_tfrecord
        return read_tfrecord(spark, src["path"], src.get("schema"), features=src.get("features", ["user_list", "item_list"]))
    if kind == "Table":
        return spark.table(src["table"])
    raise ValueError(f"unknown source type {kind!r}")


def apply_all(df: DataFrame, transformations: list[dict]) -> DataFrame:
    for t in transformations or []:
        df = df.transform(lambda d, t=t: apply_transform(d, t))
    return df


def write_output(df: DataFrame, out: dict) -> None:
    kind = out["type"]
    path = out["path"]
    if kind == "Csv":
        files.write_csv(df, path, header=out.get("header", True), delimiter=out.get("delimiter", ","))
    elif kind == "Parquet":
        files.write_parquet(df, path, partition_by=out.get("partitionBy"))
    elif kind == "TFRecord":
        from seqwright.sources.tfrecord import write_tfrecord
        write_tfrecord(df, path, out.get("features"))
    else:
        raise ValueError(f"unknown output type {kind!r}")


def build_pipeline(spark: SparkSession, spec: dict) -> dict[str, DataFrame]:
    """The lazy output frames of a spec, by output name (nothing is written)."""
    sources = spec["input"]["sources"]
    frames = []
    for src in sources:
        df = load_source(spark, src)
        df.createOrReplaceTempView(src.get("label", src.get("name", "source")))
        frames.append(df)
    main = apply_all(frames[0], spec.get("transformations", []))
    return {o.get("name", f"out{i}"): apply_all(main, o.get("transformations", []))
            for i, o in enumerate(spec.get("output", []))}


def run_pipeline(spark: SparkSession, spec: dict) -> dict[str, DataFrame]:
    """Build and write every output; returns the written frames by output name."""
    outs = build_pipeline(spark, spec)
    for o, df in zip(spec.get("output", []), outs.values()):
        write_output(df, o)
    return outs
