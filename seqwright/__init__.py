"""seqwright: sequential next-item recommendation as Spark DataFrame jobs.

Layers:
  sources    readers / writers (CSV, triplet text, Parquet sequence store, TFRecord)
  operators  declarative transforms, per-user sequence operators, batching, lookups
  functions  column-expression math (sigmoid, softmax loss, arg-max, schedules) and metrics
  model      the collaborative gated recurrent cell: weight tables, scoring and training jobs
  plans      the declarative pipeline (sources -> ordered transforms -> outputs)
  streaming  the same pipeline driven by a file stream
"""

__all__ = ["session"]
