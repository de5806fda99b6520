"""The declarative pipeline driven by a file stream.

The reference's sources are static files read in passes; here the same spec can
run as a Structured Streaming query over a folder that receives new files. Row
transforms (Select, Cast) run on the stream. A single Parquet or CSV output without
its own transforms goes to Spark's streaming file sink (exactly-once through the
checkpoint); other outputs are written per micro-batch by ``foreachBatch`` with
their own transforms (e.g. SortBy within the micro-batch) and writer. Either way the
query's checkpoint makes it restartable after a failure. CollectList needs
whole groups and is refused on a stream: run it on the stored output in batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqwright.operators.transforms import apply_transform
from seqwright.plans.pipeline import apply_all, write_output

STREAMABLE = {"Select", "Cast"}


def read_stream(spark: SparkSession, src: dict, schema: str) -> DataFrame:
    kind = src["type"]
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", src.get("maxFilesPerTrigger", 1000))
    if src.get("glob"):
        r = r.option("pathGlobFilter", src["glob"])
    if kind == "Csv":
        from seqwright.sources.files import TS_FORMATS
        return (r.option("header", src.get("header", True)).option("sep", src.get("delimiter", ","))
                .options(**TS_FORMATS).csv(src["csv_path"]))
    if kind == "Parquet":
        return r.parquet(src["path"])
    raise ValueError(f"source type {kind!r} cannot be streamed")


def start_stream(spark: SparkSession, spec: dict, schema: str, checkpoint: str, *,
                 available_now: bool = True, processing_time: str | None = None):
    """Start the spec's first source as a stream; returns the StreamingQuery."""
    for t in spec.get("transformations", []):
        if t["type"] not in STREAMABLE:
            raise ValueError(f"{t['type']} needs whole groups; run it in batch on the output")
    df = read_stream(spark, spec["input"]["sources"][0], schema)
    for t in spec.get("transformations", []):
        df = apply_transform(df, t)
    outputs = spec.get("output", [])
    native = len(outputs) == 1 and not outputs[0].get("transformations") and outputs[0]["type"] in ("Parquet", "Csv")
    if native:
        # Spark's own streaming file sink: exactly-once through the checkpoint, no Python callback
        o = outputs[0]
        w = df.writeStream.format("parquet" if o["type"] == "Parquet" else "csv").option("path", o["path"])
        if o["type"] == "Csv":
            from seqwright.sources.files import TS_FORMATS
            w = w.option("header", o.get("header", True)).option("sep", o.get("delimiter", ",")).options(**TS_FORMATS)
        w = w.option("checkpointLocation", checkpoint).outputMode("append")
    else:
        def each(batch: DataFrame, batch_id: int) -> None:
            for o in outputs:
                part = dict(o)
                part["path"] = f"{o['path'].rstrip('/')}/batch={batch_id}"
                write_output(apply_all(batch, o.get("transformations", [])), part)

        w = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()
