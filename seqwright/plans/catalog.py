"""Registered queries (one per operator of the inventory) and their SQL twins.

Every query reads the given tables (``events`` for interactions, ``embeddings``
for logits) and returns long-form scalar columns; every computed column is cast
and aliased identically on both sides. Floats are rounded to 6 digits on both
sides. Queries that write (sinks, stores) use a fresh folder below the session's
``spark.checkpoint.dir``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqwright.operators import batching as B
from seqwright.operators import lookup as L
from seqwright.operators import sequences as S
from seqwright.operators import transforms as T
from seqwright.plans.pipeline import run_pipeline
from seqwright.session import ensure_utc, scratch_path
from seqwright.sources import files
from seqwright.sources.tables import events_interactions, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_utc(spark)
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return run
    return deco


# ---------------------------------------------------------------- shared pieces
WINDOW = 16          # window size on events (554 full windows at sf0.01)
CHUNK = 64           # padded chunk size
SEED = 42
N_BATCHES = 8

EV_SQL = """WITH ev AS (
  SELECT CAST(user_id + 1 AS BIGINT) AS "user",
         CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) + 1 AS item,
         ts, event_id
  FROM events)"""

SEQ_SQL = EV_SQL + """,
seq AS (
  SELECT "user", item, ts, event_id,
         CAST(row_number() OVER (PARTITION BY "user" ORDER BY ts, event_id) AS BIGINT) AS pos,
         CAST(count(*) OVER (PARTITION BY "user") AS BIGINT) AS n,
         CAST(lead(item, 1, 0) OVER (PARTITION BY "user" ORDER BY ts, event_id) AS BIGINT) AS target
  FROM ev)"""

WIN_SQL = SEQ_SQL + f""",
win AS (
  SELECT "user", CAST((pos - 1) // {WINDOW} AS BIGINT) AS chunk, CAST((pos - 1) % {WINDOW} AS BIGINT) AS t,
         item, target, pos, n
  FROM seq WHERE ((pos - 1) // {WINDOW} + 1) * {WINDOW} <= n)"""


def _hash_sql(prefix: str, *cols: str) -> str:
    """DuckDB twin of ``batching.seeded_hash``."""
    parts = ", ".join([f"'{p}'" for p in prefix.split(":")] + [f"CAST({c} AS VARCHAR)" for c in cols])
    return f"CAST('0x' || substr(md5(concat_ws(':', {parts})), 1, 8) AS BIGINT)"


def seq_frame(spark, sf_dir, **kw):
    return S.next_item(events_interactions(spark, sf_dir), **kw)


def window_frame(spark, sf_dir, size=WINDOW):
    return S.tumbling_windows(seq_frame(spark, sf_dir), size, tail="drop")


def window_keys(spark, sf_dir):
    """One row per window: its first row."""
    return window_frame(spark, sf_dir).where(F.col("t") == 0).select("user", "chunk")


# ---------------------------------------------------------------- 2.1 sources / sinks
@query("scan_csv", EV_SQL + """
SELECT "user", item, CAST(epoch_us(ev.ts) AS BIGINT) AS date, event_type FROM ev JOIN events USING (event_id)""")
def q_scan_csv(spark, sf_dir):
    """A table written as CSV with a header comes back as strings; Cast restores types."""
    ev = events_interactions(spark, sf_dir, "event_type")
    out = ev.select("user", "item", F.unix_micros(F.col("ts").cast("timestamp")).alias("date"), "event_type")
    path = scratch_path(spark, "scan_csv")
    files.write_csv(out, path)
    back = files.read_csv(spark, path)
    for c in ("user", "item", "date"):
        back = T.cast(back, c, "bigint")
    return back.select("user", "item", "date", "event_type")


@query("scan_triplets", EV_SQL + """
SELECT "user", item, CAST(epoch_us(ts) AS BIGINT) AS date FROM ev""")
def q_scan_triplets(spark, sf_dir):
    """S3: headerless, space-separated ``user item date`` text."""
    ev = events_interactions(spark, sf_dir).select("user", "item", F.unix_micros(F.col("ts").cast("timestamp")).alias("date"))
    path = scratch_path(spark, "triplets")
    files.write_triplets(ev, path)
    return files.read_triplets(spark, path)


STORE_SQL = SEQ_SQL + """
SELECT "user", CAST((pos - 1) // 4096 AS BIGINT) AS segment, CAST(count(*) AS BIGINT) AS n_items,
       string_agg(CAST(item AS VARCHAR), ',' ORDER BY pos) AS items
FROM seq GROUP BY ALL"""


def _seq_summary(seqs: DataFrame) -> DataFrame:
    return seqs.select("user", "segment", F.size("item_list").cast("bigint").alias("n_items"),
                       F.array_join(F.col("item_list").cast("array<string>"), ",").alias("items"))


@query("collect_sequences", STORE_SQL)
def q_collect_sequences(spark, sf_dir):
    """A1: ordered, aligned per-user lists (segments of at most 4096 rows)."""
    ev = events_interactions(spark, sf_dir)
    return _seq_summary(S.collect_sequences(ev, ["ts"], ["user"], ["item", "user"], tiebreak=["event_id"]))


@query("scan_sequences", STORE_SQL)
def q_scan_sequences(spark, sf_dir):
    """The sequence store is written as Parquet and scanned back in column batches."""
    ev = events_interactions(spark, sf_dir)
    seqs = S.collect_sequences(ev, ["ts"], ["user"], ["item", "user"], tiebreak=["event_id"])
    path = scratch_path(spark, "sequences")
    files.write_parquet(seqs, path)
    return _seq_summary(files.read_parquet(spark, path))


@query("sequence_store", SEQ_SQL + """
SELECT "user", 'valid' AS split, CAST((pos - n // 2 - 1) // 4096 AS BIGINT) AS segment,
       CAST(count(*) AS BIGINT) AS n_items, string_agg(CAST(item AS VARCHAR), ',' ORDER BY pos) AS items
FROM seq WHERE pos > n // 2 GROUP BY ALL""")
def q_sequence_store(spark, sf_dir):
    """train/valid sequences stored partitioned by split; reading one split prunes the other."""
    seq = S.temporal_split(seq_frame(spark, sf_dir), train_frac=0.5)
    seqs = S.collect_sequences(seq, ["pos"], ["user", "split"], ["item"])
    path = scratch_path(spark, "store")
    files.write_parquet(seqs, path, partition_by=["split"])
    back = files.read_parquet(spark, path).where(F.col("split") == "valid")
    return back.select("user", "split", "segment", F.size("item_list").cast("bigint").alias("n_items"),
                       F.array_join(F.col("item_list").cast("array<string>"), ",").alias("items"))


def _ranked_read(spark, path, schema: str) -> DataFrame:
    """Read written CSV parts back with their global rank in file order: part files are
    numbered in partition order and lines keep their order inside a file. Ranks come from a
    per-file line number plus per-file offsets (one row per file), never a global window."""
    df = files.read_csv(spark, path, schema).withColumn("_f", F.col("_metadata.file_path")) \
        .withColumn("_m", F.monotonically_increasing_id())
    from pyspark.sql import Window
    df = df.withColumn("_l", F.row_number().over(Window.partitionBy("_f").orderBy("_m")))
    # part files in the order of their numbers (as text, part-100000 would come before part-99999)
    counts = df.groupBy("_f").agg(F.count(F.lit(1)).alias("_c"))
    number = F.regexp_extract("_f", "part-([0-9]+)", 1).cast("bigint")
    counts = counts.withColumn("_off", F.coalesce(F.sum("_c").over(
        Window.orderBy(number, "_f").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = df.join(counts.select("_f", "_off"), "_f")  # one row per written file
    return out.withColumn("rank", (F.col("_off") + F.col("_l")).cast("bigint")).drop("_f", "_m", "_l", "_off")


SORTED_SQL = """
SELECT CAST(row_number() OVER (ORDER BY ts) AS BIGINT) AS rank, ts, event_type FROM events"""


@query("csv_sink_sorted", SORTED_SQL)
def q_csv_sink_sorted(spark, sf_dir):
    """S8 + O1: Select, then a CSV output with its own SortBy; the rank is read back from the files."""
    ev = table(spark, sf_dir, "events")
    out = T.sort_by(T.select(ev, ["ts", "event_type"]), "ts")
    path = scratch_path(spark, "csv_sorted")
    files.write_csv(out, path)
    return _ranked_read(spark, path, "ts TIMESTAMP, event_type STRING").select("rank", "ts", "event_type")


@query("sort_by", SORTED_SQL)
def q_sort_by(spark, sf_dir):
    """O1: global sort, range partitioned; order checked from the written parts."""
    ev = table(spark, sf_dir, "events").select("ts", "event_type")
    path = scratch_path(spark, "sort_by")
    files.write_csv(T.sort_by(ev, "ts"), path)
    return _ranked_read(spark, path, "ts TIMESTAMP, event_type STRING").select("rank", "ts", "event_type")


def _events_as_text_csv(spark, sf_dir) -> str:
    """The events table as an all-text CSV file with a header, as the reference's sources."""
    ev = events_interactions(spark, sf_dir, "event_type")
    ev = ev.select("user", "item", F.unix_micros(F.col("ts").cast("timestamp")).alias("date"),
                   F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"),
                   F.col("event_type").alias("event"))
    path = scratch_path(spark, "events_csv")
    files.write_csv(ev, path)
    return path


@query("pipeline_sequences", STORE_SQL)
def q_pipeline_sequences(spark, sf_dir):
    """S9/S10 + P2 + A1: Csv source -> Cast x3 -> CollectList(orderBy date, groupBy user) -> Parquet."""
    src = _events_as_text_csv(spark, sf_dir)
    out = scratch_path(spark, "pipeline_seq")
    spec = {
        "input": {"sources": [{"type": "Csv", "csv_path": src, "name": "events", "label": "events",
                               "delimiter": ",", "header": True}]},
        "transformations": [
            {"type": "Cast", "col": "user", "castedCol": "user", "fromType": "string", "toType": "bigint"},
            {"type": "Cast", "col": "item", "castedCol": "item", "fromType": "string", "toType": "bigint"},
            {"type": "Cast", "col": "date", "castedCol": "date", "fromType": "string", "toType": "bigint"},
            {"type": "CollectList", "orderBy": ["date"], "groupBy": ["user"], "cols": ["item", "user"]},
        ],
        "output": [{"type": "Parquet", "name": "train_data", "path": out}],
    }
    run_pipeline(spark, spec)
    return _seq_summary(files.read_parquet(spark, out))


@query("pipeline_select_sort", """
SELECT CAST(row_number() OVER (ORDER BY ts) AS BIGINT) AS rank,
       strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS "timestamp", event_type AS event FROM events""")
def q_pipeline_select_sort(spark, sf_dir):
    """S2/S8/S10 + P1 + O1: Csv -> Select[timestamp, event] -> Csv output with SortBy timestamp."""
    src = _events_as_text_csv(spark, sf_dir)
    out = scratch_path(spark, "pipeline_sort")
    spec = {
        "input": {"sources": [{"type": "Csv", "csv_path": src, "name": "events", "label": "events",
                               "delimiter": ","}]},
        "transformations": [{"type": "Select", "cols": ["timestamp", "event"]}],
        "output": [{"type": "Csv", "name": "test", "path": out,
                    "transformations": [{"type": "SortBy", "column": "timestamp"}]}],
    }
    run_pipeline(spark, spec)
    return _ranked_read(spark, out, "timestamp STRING, event STRING").select("rank", "timestamp", "event")


# ---------------------------------------------------------------- 2.2 projections
@query("select_cols", "SELECT event_id, ts, event_type FROM events")
def q_select_cols(spark, sf_dir):
    """Keep named columns in order (the scan reads only these)."""
    return T.select(table(spark, sf_dir, "events"), ["event_id", "ts", "event_type"])


@query("cast_cols", """
SELECT event_id, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) AS k,
       TRY_CAST(event_type AS BIGINT) AS event_type, CAST(event_id AS VARCHAR) AS event_id_str,
       CAST(user_id AS DOUBLE) AS user_id
FROM events""")
def q_cast_cols(spark, sf_dir):
    """Cast into new or same columns; malformed text becomes NULL."""
    ev = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    ev = T.cast(ev, "k", "bigint")
    ev = T.cast(ev, "event_type", "bigint")
    ev = T.cast(ev, "event_id", "string", "event_id_str")
    ev = T.cast(ev, "user_id", "double")
    return ev.select("event_id", "k", "event_type", "event_id_str", "user_id")


# ---------------------------------------------------------------- 2.4 aggregations
@query("dataset_stats", EV_SQL + """
SELECT CAST(max("user") AS BIGINT) AS num_users, CAST(max(item) AS BIGINT) AS num_items,
       CAST(count(*) AS BIGINT) AS num_triplets FROM ev""")
def q_dataset_stats(spark, sf_dir):
    """A2: vocabulary sizes and triplet count."""
    return T.dataset_stats(events_interactions(spark, sf_dir))


# ---------------------------------------------------------------- 2.5 sequence operators
@query("next_item", SEQ_SQL + """
SELECT "user", pos, item, target, n FROM seq""")
def q_next_item(spark, sf_dir):
    """Next-item label per position (0 after the last)."""
    return seq_frame(spark, sf_dir).select("user", "pos", "item", "target", "n")


@query("count_windows", WIN_SQL + """
SELECT "user", chunk, t, item, target FROM win""")
def q_count_windows(spark, sf_dir):
    """Tumbling windows of 16 with their label windows; incomplete ones dropped."""
    return window_frame(spark, sf_dir).select("user", "chunk", "t", "item", "target")


@query("sliding_windows", SEQ_SQL + """,
cand AS (SELECT s.*, CAST(w.w AS BIGINT) AS window_id
         FROM seq s, LATERAL (SELECT unnest(range(0, (s.pos - 1) // 4 + 1)) AS w) w)
SELECT "user", window_id, CAST((pos - 1 - window_id * 4) // 2 AS BIGINT) AS t, item, target
FROM cand
WHERE pos - 1 - window_id * 4 < 15 AND (pos - 1 - window_id * 4) % 2 = 0
  AND window_id * 4 + 15 <= n""")
def q_sliding_windows(spark, sf_dir):
    """W2 general: size 8, shift 4, stride 2 (span 15); incomplete windows dropped."""
    return S.sliding_windows(seq_frame(spark, sf_dir), 8, 4, 2).select("user", "window_id", "t", "item", "target")


@query("padded_chunks", SEQ_SQL + f""",
ch AS (SELECT "user", CAST((pos - 1) // {CHUNK} AS BIGINT) AS chunk, CAST(count(*) AS INTEGER) AS seq_len
       FROM seq GROUP BY ALL),
grid AS (SELECT ch.*, CAST(r.t AS BIGINT) AS t FROM ch, range({CHUNK}) r(t))
SELECT g."user", g.chunk, g.t, g.seq_len, CAST(coalesce(s.item, 0) AS BIGINT) AS item,
       CAST(coalesce(s.target, 0) AS BIGINT) AS target
FROM grid g LEFT JOIN seq s ON s."user" = g."user" AND s.pos = g.chunk * {CHUNK} + g.t + 1""")
def q_padded_chunks(spark, sf_dir):
    """Chunks of 64 keep their tail, zero padded, with the true length."""
    rows = S.tumbling_windows(seq_frame(spark, sf_dir), CHUNK, tail="keep")
    arr = rows.groupBy("user", "chunk", "seq_len").agg(
        F.sort_array(F.collect_list(F.struct("t", "item", "target"))).alias("_s"))
    pad = F.array_repeat(F.lit(0).cast("bigint"), F.lit(CHUNK) - F.col("seq_len"))
    arr = arr.select("user", "chunk", "seq_len",
                     F.concat(F.col("_s.item"), pad).alias("item_list"),
                     F.concat(F.col("_s.target"), pad).alias("target_list"))
    return S.unnest_windows(arr, ("user", "chunk", "seq_len"), ("item", "target")).select(
        "user", "chunk", "t", "seq_len", "item", "target")


@query("temporal_split", SEQ_SQL + """
SELECT "user", pos, item, CASE WHEN pos <= n // 2 THEN 'train' ELSE 'valid' END AS split FROM seq""")
def q_temporal_split(spark, sf_dir):
    """The first half of each user's events train, the rest validate."""
    return S.temporal_split(seq_frame(spark, sf_dir), train_frac=0.5).select("user", "pos", "item", "split")


@query("truncate_last", SEQ_SQL + """
SELECT "user", CAST(pos - greatest(n - 32, 0) AS BIGINT) AS pos, item, CAST(least(n, 32) AS BIGINT) AS n
FROM seq WHERE pos > n - 32""")
def q_truncate_last(spark, sf_dir):
    """O2: keep the last 32 events of each user."""
    return S.truncate(seq_frame(spark, sf_dir), 32).select("user", "pos", "item", "n")


@query("truncate_first", SEQ_SQL + """
SELECT "user", pos, item, CAST(least(n, 32) AS BIGINT) AS n FROM seq WHERE pos <= 32""")
def q_truncate_first(spark, sf_dir):
    """O2 (keep_first): keep the first 32 events of each user."""
    return S.truncate(seq_frame(spark, sf_dir), 32, keep_first=True).select("user", "pos", "item", "n")


@query("unnest_windows", WIN_SQL + """
SELECT "user", chunk, t, item, target FROM win""")
def q_unnest_windows(spark, sf_dir):
    """Windows collected into arrays, then unbatched back to rows."""
    arr = S.window_arrays(window_frame(spark, sf_dir))
    return S.unnest_windows(arr).select("user", "chunk", "t", "item", "target")


@query("pair_features", WIN_SQL + """
SELECT "user", chunk, t, "user" AS f_user, item AS f_item FROM win""")
def q_pair_features(spark, sf_dir):
    """Stack user and item lists into one [n, 2] feature per window."""
    arr = S.pair_features(S.window_arrays(window_frame(spark, sf_dir)))
    out = arr.select("user", "chunk", F.posexplode("features").alias("t", "f"))
    return out.select("user", "chunk", F.col("t").cast("bigint").alias("t"),
                      F.col("f.user").alias("f_user"), F.col("f.item").alias("f_item"))


BATCH_SQL = WIN_SQL + f""",
wk AS (SELECT DISTINCT "user", chunk FROM win),
bat AS (SELECT "user", chunk, CAST({_hash_sql(f'{SEED}:1', '"user"', 'chunk')} % {N_BATCHES} AS BIGINT) AS batch_id,
               md5(concat_ws(':', '{SEED}:1:slot', CAST("user" AS VARCHAR), CAST(chunk AS VARCHAR))) AS h
        FROM wk),
slots AS (SELECT "user", chunk, batch_id,
                 CAST(row_number() OVER (PARTITION BY batch_id ORDER BY
                      CAST('0x' || substr(h, 1, 8) AS BIGINT), CAST('0x' || substr(h, 9, 8) AS BIGINT),
                      "user", chunk) AS BIGINT) AS slot
          FROM bat)"""


@query("flat_labels", BATCH_SQL + f"""
SELECT s.batch_id, CAST((s.slot - 1) * {WINDOW} + w.t AS BIGINT) AS flat_idx, CAST(w.target AS INTEGER) AS label
FROM slots s JOIN win w USING ("user", chunk)""")
def q_flat_labels(spark, sf_dir):
    """Labels of each batch flattened in window order, as int."""
    arr = S.window_arrays(window_frame(spark, sf_dir))
    b = B.shuffled_examples(arr, N_BATCHES, SEED, 1)
    return S.flat_labels(b, WINDOW)


# ---------------------------------------------------------------- 2.3 joins
@query("train_valid_pairs", SEQ_SQL + """,
sp AS (SELECT *, CASE WHEN pos <= n // 2 THEN 'train' ELSE 'valid' END AS split FROM seq),
u AS (SELECT "user" FROM sp GROUP BY "user" HAVING count(DISTINCT split) = 2)
SELECT "user", split, CAST(count(*) AS BIGINT) AS n_items, string_agg(CAST(item AS VARCHAR), ',' ORDER BY pos) AS items
FROM sp WHERE "user" IN (SELECT "user" FROM u) GROUP BY ALL""")
def q_train_valid_pairs(spark, sf_dir):
    """Per-user train and valid sequences paired on the user."""
    p = L.train_valid_pairs(S.temporal_split(seq_frame(spark, sf_dir), train_frac=0.5))
    return p.select("user", "split", F.size("item_list").cast("bigint").alias("n_items"),
                    F.array_join(F.col("item_list").cast("array<string>"), ",").alias("items"))


# ---------------------------------------------------------------- 2.6 order and batching
@query("batch_ids", BATCH_SQL + """
SELECT "user", chunk, batch_id FROM bat""")
def q_batch_ids(spark, sf_dir):
    """Seeded batch id per window (8 batches, epoch 1)."""
    return B.batch_ids(window_keys(spark, sf_dir), N_BATCHES, SEED, 1).select("user", "chunk", "batch_id")


@query("shuffled_examples", BATCH_SQL + """
SELECT "user", chunk, batch_id, slot FROM slots""")
def q_shuffled_examples(spark, sf_dir):
    """O3: seeded shuffle of the windows inside each batch (rank = slot)."""
    return B.shuffled_examples(window_keys(spark, sf_dir), N_BATCHES, SEED, 1).select(
        "user", "chunk", "batch_id", "slot")


ORDER_SQL = BATCH_SQL + f""",
ord AS (SELECT e.epoch, b.batch_id,
               CAST(row_number() OVER (PARTITION BY e.epoch ORDER BY
                    md5(concat_ws(':', '{SEED}', 'order', CAST(e.epoch AS VARCHAR), CAST(b.batch_id AS VARCHAR))),
                    b.batch_id) AS BIGINT) AS step
        FROM (SELECT DISTINCT batch_id FROM bat) b, (SELECT CAST(unnest(range(1, 3)) AS INTEGER) AS epoch) e)"""


def _epoch_orders(spark, sf_dir, epochs=2):
    """Two epochs' orders of the batches with their window counts: one pass over the windows."""
    batches = B.batch_ids(window_keys(spark, sf_dir), N_BATCHES, SEED, 1).groupBy("batch_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_windows"))
    return B.epoch_orders(batches, SEED, epochs)


@query("epoch_order", ORDER_SQL + """
SELECT epoch, step, batch_id FROM ord""")
def q_epoch_order(spark, sf_dir):
    """A seeded permutation of the batches per epoch (2 epochs)."""
    return _epoch_orders(spark, sf_dir).select("epoch", "step", "batch_id")


@query("epoch_steps", ORDER_SQL + """
SELECT o.epoch, o.step, o.batch_id, CAST(count(*) AS BIGINT) AS n_windows
FROM ord o JOIN bat b USING (batch_id) WHERE o.step <= 3 GROUP BY ALL""")
def q_epoch_steps(spark, sf_dir):
    """Each epoch stops after 3 batches; the windows drawn per step."""
    return B.epoch_steps(_epoch_orders(spark, sf_dir), 3).select("epoch", "step", "batch_id", "n_windows")


@query("repeat_epochs", WIN_SQL + f""",
wk AS (SELECT DISTINCT "user", chunk FROM win),
rep AS (SELECT wk.*, CAST(e AS INTEGER) AS epoch FROM wk, range(1, 4) r(e))
SELECT epoch, "user", chunk,
       CAST(CAST('0x' || substr(md5(concat_ws(':', '{SEED}', CAST(epoch AS VARCHAR), CAST("user" AS VARCHAR),
            CAST(chunk AS VARCHAR))), 1, 8) AS BIGINT) % {N_BATCHES} AS BIGINT) AS batch_id
FROM rep""")
def q_repeat_epochs(spark, sf_dir):
    """Three passes over the windows, batches re-drawn per epoch."""
    rep = B.repeat_epochs(window_keys(spark, sf_dir), 3)
    return B.batch_ids(rep, N_BATCHES, SEED, F.col("epoch"), ("user", "chunk")).select(
        "epoch", "user", "chunk", "batch_id")


@query("tfrecord_roundtrip", SEQ_SQL + """
SELECT "user", CAST((pos - 1) // 4096 AS BIGINT) AS segment, CAST((pos - 1) % 4096 AS BIGINT) AS t,
       CAST(item AS BIGINT) AS item FROM seq""")
def q_tfrecord_roundtrip(spark, sf_dir):
    """Sequences written as TFRecord Example files (float lists, as the reference's
    output) and read back by the tfrecord data source; long form after the round trip."""
    from seqwright.sources.tfrecord import read_tfrecord, write_tfrecord
    ev = events_interactions(spark, sf_dir)
    seqs = S.collect_sequences(ev, ["ts"], ["user"], ["item", "user"], tiebreak=["event_id"])
    seqs = seqs.select("user", "segment", F.col("item_list").cast("array<float>").alias("item_list"),
                       F.col("user_list").cast("array<float>").alias("user_list"))
    path = scratch_path(spark, "tfrecord")
    write_tfrecord(seqs, path)
    back = read_tfrecord(spark, path, "user BIGINT, segment BIGINT, item_list ARRAY<FLOAT>, user_list ARRAY<FLOAT>")
    out = back.select("user", "segment", F.posexplode("item_list").alias("t", "item"))
    return out.select("user", "segment", F.col("t").cast("bigint").alias("t"), F.col("item").cast("bigint").alias("item"))


@query("tfrecord_append", SEQ_SQL + """
SELECT "user", CAST(count(*) AS BIGINT) AS n_items, string_agg(CAST(item AS VARCHAR), ',' ORDER BY pos) AS items
FROM seq GROUP BY "user" """)
def q_tfrecord_append(spark, sf_dir):
    """Two appends to one path keep each other's records."""
    from seqwright.sources.tfrecord import read_tfrecord, write_tfrecord
    seqs = _user_sequences(spark, sf_dir)
    path = scratch_path(spark, "tfrecord_append")
    write_tfrecord(seqs.where(F.col("user") % 2 == 0), path, mode="append")
    write_tfrecord(seqs.where(F.col("user") % 2 == 1), path, mode="append")
    return _items_by_user(read_tfrecord(spark, path, "user BIGINT, item_list ARRAY<FLOAT>"))


@query("pipeline_tfrecord_source", SEQ_SQL + """
SELECT "user", CAST(count(*) AS BIGINT) AS n_items, string_agg(CAST(item AS VARCHAR), ',' ORDER BY pos) AS items
FROM seq GROUP BY "user" """)
def q_pipeline_tfrecord_source(spark, sf_dir):
    """A pipeline whose source is a TFRecord path."""
    from seqwright.sources.tfrecord import write_tfrecord
    src, out = scratch_path(spark, "tfrecord_source"), scratch_path(spark, "tfrecord_out")
    write_tfrecord(_user_sequences(spark, sf_dir), src)
    run_pipeline(spark, {
        "input": {"sources": [{"type": "TFRecord", "path": src, "schema": "user BIGINT, item_list ARRAY<FLOAT>"}]},
        "transformations": [{"type": "Select", "cols": ["user", "item_list"]}],
        "output": [{"type": "Parquet", "name": "sequences", "path": out}]})
    return _items_by_user(files.read_parquet(spark, out))


def _user_sequences(spark, sf_dir):
    ev = events_interactions(spark, sf_dir)
    return S.collect_sequences(ev, ["ts"], ["user"], ["item"], tiebreak=["event_id"], segment_len=1 << 20).select(
        "user", F.col("item_list").cast("array<float>").alias("item_list"))


def _items_by_user(df):
    return df.select("user", F.size("item_list").cast("bigint").alias("n_items"), F.array_join(
        F.col("item_list").cast("array<bigint>").cast("array<string>"), ",").alias("items"))


# ---------------------------------------------------------------- the paths above a size, at tiny sizes
@query("next_item_hot", SEQ_SQL + """
SELECT "user", pos, item, target, n FROM seq""")
def q_next_item_hot(spark, sf_dir):
    """W1/W3 on the hot-key path: every user of more than 20 events is cut into segments of 8."""
    return seq_frame(spark, sf_dir, hot_rows=20, seg_rows=8).select("user", "pos", "item", "target", "n")


@query("collect_sequences_segmented", SEQ_SQL + """
SELECT "user", CAST((pos - 1) // 16 AS BIGINT) AS segment, CAST(min(pos) AS BIGINT) AS start, max(n) AS n,
       string_agg(CAST(item AS VARCHAR), ',' ORDER BY pos) AS items,
       nullif(arg_max(target, pos), 0) AS item_next
FROM seq GROUP BY ALL""")
def q_collect_sequences_segmented(spark, sf_dir):
    """A1 in segments of 16: each knows its place and the item that follows it."""
    ev = events_interactions(spark, sf_dir)
    s = S.collect_sequences(ev, ["ts"], ["user"], ["item"], tiebreak=["event_id"], segment_len=16)
    return s.select("user", "segment", "start", "n", F.array_join(F.col("item_list").cast("array<string>"), ",").alias("items"),
                    "item_next")


@query("stream_pipeline", """
SELECT event_id, CAST(user_id + 1 AS BIGINT) AS "user", event_type FROM events""")
def q_stream_pipeline(spark, sf_dir):
    """S10 on a stream: the events file as a streaming source, Select + Cast per micro-batch,
    Parquet output per batch (restartable from the query checkpoint); the output read back."""
    from seqwright.streaming.pipeline import start_stream
    out = scratch_path(spark, "stream_out")
    spec = {
        "input": {"sources": [{"type": "Parquet", "path": sf_dir, "glob": "events.parquet"}]},
        "transformations": [{"type": "Select", "cols": ["event_id", "user_id", "event_type"]},
                            {"type": "Cast", "col": "user_id", "castedCol": "user", "toType": "bigint"}],
        "output": [{"type": "Parquet", "name": "events", "path": out}],
    }
    schema = table(spark, sf_dir, "events").schema.simpleString()[len("struct<"):-1].replace(":", " ")
    q = start_stream(spark, spec, schema, scratch_path(spark, "stream_ckpt"))
    q.awaitTermination()
    back = files.read_parquet(spark, out)
    return back.select("event_id", (F.col("user") + 1).cast("bigint").alias("user"), "event_type")
