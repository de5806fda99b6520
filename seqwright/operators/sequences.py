"""Per-user sequence operators.

Everything here derives from one operator, :func:`positions`, which numbers the
rows of each key in order (``pos``, 1-based), counts them (``n``) and fetches the
next value (``lead``). All other operators are row-level expressions over
``pos``/``n`` or aggregations over bounded groups ``(user, chunk)``, so no
operator needs a whole user in one task except where the model itself is
sequential (the recurrent fold).

Skew. ``Window.partitionBy(user)`` sends every row of a user to one task. A key
holding a third of the data would then run in one task. :func:`positions`
therefore finds keys above ``hot_rows`` rows (one partial aggregation) and splits
each into segments of about ``seg_rows`` rows. Segment boundaries are order values
(the struct of the order columns, whatever their types) taken from a hashed sample
of the key's rows, so they follow the rows' ranks: bursts, outliers and close
values split like any others. Rows are numbered inside ``(key, segment)`` and get
offsets from a small segment table. Keys below the threshold keep the plain
one-exchange window; both ways give the same rows, also for NULL keys, NULL items
and equal timestamps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqwright.session import checkpoint_dir

# Keys with more rows than this are split into segments (rows per segment ~ SEG_ROWS).
HOT_ROWS = 4_000_000
SEG_ROWS = 1_000_000
# Most rows a broadcast side table may hold (boundaries of hot keys); above it the joins shuffle.
MAX_BROADCAST_ROWS = 2_000_000
# Sampled order values per segment of a hot key.
SAMPLE = 32


def _as_list(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def _hot_keys(df: DataFrame, keys: list[str], hot_rows: int) -> DataFrame | None:
    """(keys, _n) of the keys above ``hot_rows`` rows, or None. The answer "none" is kept for
    frames with the same plan, so operators on one input look once; a stale answer costs
    time, never rows."""
    spark = df.sparkSession
    known = _NO_HOT.setdefault(spark.sparkContext.applicationId, set())
    mark = (df.semanticHash(), tuple(keys), hot_rows)
    if mark in known:
        return None
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    if not hot.limit(1).count():
        known.add(mark)
        return None
    checkpoint_dir(spark)
    return hot.checkpoint(eager=True)  # read by the sample, the boundaries and the join


_NO_HOT: dict[str, set] = {}


def _on_keys(left: DataFrame, right: DataFrame, keys: list[str], more=None, how: str = "left") -> DataFrame:
    """Null-safe join on ``keys``; the right side's key columns are dropped."""
    r = right.toDF(*[f"_k_{c}" if c in keys else c for c in right.columns])
    cond = more
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*[f"_k_{k}" for k in keys])


def positions(df: DataFrame, key="user", order: Sequence[str] = ("ts", "event_id"),
              lead_cols: Sequence[str] = ("item",), *, pos_col: str = "pos", n_col: str = "n",
              lead_default=0, hot_rows: int | None = None, seg_rows: int | None = None,
              detect_skew: bool = True, keep_segments: bool = False) -> DataFrame:
    """Adds ``pos`` (1-based rank of the row within its key, by ``order``), ``n`` (rows of
    the key) and ``next_<c>`` for each ``c`` in ``lead_cols`` (``lead_default`` after the last
    row; a NULL in the next row stays NULL). ``order`` must be unique within a key for a
    deterministic result; its columns may have any orderable type, NULLs come first."""
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    seg_rows = SEG_ROWS if seg_rows is None else seg_rows
    keys = _as_list(key)
    order = _as_list(order)
    lead_cols = _as_list(lead_cols)
    ordc = [F.col(c) for c in order]
    hot = _hot_keys(df, keys, hot_rows) if detect_skew else None

    if hot is None:
        w = Window.partitionBy(*keys).orderBy(*ordc)
        wall = Window.partitionBy(*keys)
        out = df.withColumn(pos_col, F.row_number().over(w).cast("bigint"))
        out = out.withColumn(n_col, F.count(F.lit(1)).over(wall).cast("bigint"))
        for c in lead_cols:
            out = out.withColumn(f"next_{c}", F.lead(c, 1, lead_default).over(w))
        return out

    # --- hot keys present: boundaries are order values sampled by rank, SAMPLE for a segment
    rank = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    nseg = F.ceil(F.col("_n") / F.lit(seg_rows))
    segs_total = hot.agg(F.sum(nseg)).first()[0]
    small = segs_total * SAMPLE <= MAX_BROADCAST_ROWS  # size of the boundary table, checked
    hint = F.broadcast if small else (lambda d: d)
    drawn = _on_keys(df, hint(hot.withColumn("_nseg", nseg)), keys, how="inner")
    share = F.least(F.lit(1.0), F.col("_nseg") * SAMPLE / F.col("_n"))
    drawn = drawn.where(F.pmod(F.xxhash64(*order, *keys), F.lit(1 << 20)) < share * (1 << 20))
    cuts = drawn.groupBy(*keys, "_n", "_nseg").agg(F.array_sort(F.collect_list(rank)).alias("_s"))
    # every SAMPLE-th sampled value opens a segment
    cuts = cuts.withColumn("_cuts", F.expr(f"filter(_s, (x, i) -> i % {SAMPLE} = {SAMPLE - 1})")).drop("_s", "_nseg")
    cuts = _on_keys(hot, cuts.drop("_n"), keys).withColumn("_hot", F.lit(True))
    checkpoint_dir(df.sparkSession)
    cuts = cuts.checkpoint(eager=True)
    tagged = _on_keys(df, hint(cuts), keys).withColumn("_o", rank)
    # binary search: the number of boundaries at or below the row's order value
    steps = max(1, int(segs_total * SAMPLE + 1).bit_length())
    find = F.expr(f"""aggregate(sequence(1, {steps}), named_struct('lo', 0, 'hi', size(_cuts)),
        (a, i) -> if(a.lo < a.hi,
            if(get(_cuts, (a.lo + a.hi) div 2) <= _o,
               named_struct('lo', cast((a.lo + a.hi) div 2 as int) + 1, 'hi', a.hi),
               named_struct('lo', a.lo, 'hi', cast((a.lo + a.hi) div 2 as int))), a), a -> a.lo)""")
    tagged = tagged.withColumn("_seg", F.when(F.size("_cuts") > 0, find).otherwise(F.lit(0)).cast("bigint")) \
        .drop("_cuts", "_o")
    w = Window.partitionBy(*keys, "_seg").orderBy(*ordc)
    wall = Window.partitionBy(*keys, "_seg")
    local = tagged.withColumn("_lpos", F.row_number().over(w)).withColumn(
        "_lcnt", F.count(F.lit(1)).over(wall))
    # a struct says that there is a next row, whatever its value
    vals = F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(lead_cols)], F.lit(1).alias("row"))
    local = local.withColumn("_lnext", F.lead(vals, 1).over(w))

    # segment table of the hot keys: rows, first values, offsets, next segment's first values
    segs = (tagged.where(F.col("_hot")).groupBy(*keys, "_seg")
            .agg(F.count(F.lit(1)).alias("_c"), F.min_by(vals, rank).alias("_first")))
    ws = Window.partitionBy(*keys).orderBy("_seg")
    segs = segs.withColumn(
        "_off", F.coalesce(F.sum("_c").over(ws.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    segs = segs.withColumn("_snext", F.lead("_first").over(ws)).drop("_first", "_c").withColumnRenamed("_seg", "_ss")
    out = _on_keys(local, hint(segs), keys, F.col("_seg") == F.col("_ss")).drop("_ss")
    out = out.withColumn(pos_col, (F.col("_lpos") + F.coalesce(F.col("_off"), F.lit(0))).cast("bigint"))
    out = out.withColumn(n_col, F.coalesce(F.col("_n"), F.col("_lcnt")).cast("bigint"))
    nxt = F.coalesce("_lnext", "_snext")
    for i, c in enumerate(lead_cols):
        out = out.withColumn(f"next_{c}", F.when(nxt.isNull(), F.lit(lead_default)).otherwise(nxt[f"v{i}"]))
    drop = ["_n", "_hot", "_lpos", "_lcnt", "_off", "_lnext", "_snext"] + ([] if keep_segments else ["_seg"])
    return out.drop(*drop)


def next_item(df: DataFrame, key="user", order=("ts", "event_id"), item="item", **kw) -> DataFrame:
    """The label of a position is the next item of the same user, 0 after the last."""
    out = positions(df, key, order, [item], **kw)
    return out.withColumnRenamed(f"next_{item}", "target")


def tumbling_windows(seq: DataFrame, size: int, *, tail: str = "drop") -> DataFrame:
    """W2 (shift == size) / W3 / W4 over a positioned frame (``pos``, ``n``).

    Adds ``chunk`` (0-based), ``t`` (0-based offset in the chunk) and ``seq_len`` (true length
    of the chunk). ``tail='drop'`` removes incomplete chunks (P6, drop_remainder);
    ``tail='keep'`` keeps them with their true length (padded chunks, W4)."""
    if size < 1:
        raise ValueError("size must be at least 1")
    out = (seq.withColumn("chunk", F.floor((F.col("pos") - 1) / size).cast("bigint"))
           .withColumn("t", ((F.col("pos") - 1) % size).cast("bigint"))
           .withColumn("seq_len", F.least(F.lit(size), F.col("n") - F.col("chunk") * size).cast("int")))
    if tail == "drop":
        out = out.where((F.col("chunk") + 1) * size <= F.col("n"))
    elif tail != "keep":
        raise ValueError("tail must be 'drop' or 'keep'")
    return out


def sliding_windows(seq: DataFrame, size: int, shift: int, stride: int = 1) -> DataFrame:
    """W2 in general: windows start every ``shift`` rows and take ``size`` rows ``stride`` apart;
    incomplete windows are dropped. Each row is emitted once per window that contains it
    (at most ``ceil(span / shift)`` times) with ``window_id`` and offset ``t``; no per-user
    array is built, so a long sequence never becomes one value."""
    if min(size, shift, stride) < 1:
        raise ValueError("size, shift and stride must be at least 1")
    span = (size - 1) * stride + 1
    q = F.col("pos") - 1
    lo = F.greatest(F.lit(0), F.ceil((q - span + 1) / F.lit(shift))).cast("bigint")
    hi = F.floor(q / F.lit(shift)).cast("bigint")
    # rows between windows (shift > span) belong to none: an empty list, not a reversed range
    cand = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))
    out = seq.withColumn("window_id", F.explode(cand))
    start = F.col("window_id") * shift
    out = out.where(((q - start) % stride == 0) & (start + span <= F.col("n")))
    return out.withColumn("t", ((q - start) / stride).cast("bigint"))


def window_arrays(rows: DataFrame, group=("user", "chunk"), cols=("item", "target")) -> DataFrame:
    """Collect the rows of each bounded window into aligned arrays ordered by ``t``."""
    g = _as_list(group)
    cols = _as_list(cols)
    s = F.sort_array(F.collect_list(F.struct("t", *cols)))
    out = rows.groupBy(*g).agg(s.alias("_s"))
    return out.select(*g, *[F.col(f"_s.{c}").alias(f"{c}_list") for c in cols])


def temporal_split(seq: DataFrame, *, train_len: int | None = None,
                   train_frac: float | None = None) -> DataFrame:
    """The first rows of each user train, the rest validate (``split`` column). Either a
    fixed number of rows (``train_len``) or a fraction of the user's rows."""
    if (train_len is None) == (train_frac is None):
        raise ValueError("give exactly one of train_len, train_frac")
    if train_frac is not None and not 0.0 <= train_frac <= 1.0:
        raise ValueError("train_frac must be within [0, 1]")
    k = F.lit(train_len) if train_len is not None else F.floor(F.col("n") * F.lit(train_frac))
    return seq.withColumn("split", F.when(F.col("pos") <= k, F.lit("train")).otherwise(F.lit("valid")))


def truncate(seq: DataFrame, size: int, *, keep_first: bool = False) -> DataFrame:
    """O2: keep ``size`` rows per user, the last ones by default, the first with
    ``keep_first``; ``pos`` and ``n`` are renumbered."""
    if size < 1:
        raise ValueError("size must be at least 1")
    if keep_first:
        out = seq.where(F.col("pos") <= size)
        return out.withColumn("n", F.least(F.col("n"), F.lit(size)).cast("bigint"))
    drop = F.greatest(F.col("n") - size, F.lit(0))
    out = seq.where(F.col("pos") > drop)
    return (out.withColumn("pos", (F.col("pos") - drop).cast("bigint"))
            .withColumn("n", F.least(F.col("n"), F.lit(size)).cast("bigint")))


def pair_features(windows: DataFrame) -> DataFrame:
    """The ``[n, 2]`` feature of each window as aligned ``(user, item)`` pairs."""
    return windows.withColumn("features", F.arrays_zip(
        F.transform("item_list", lambda _: F.col("user")).alias("user"), F.col("item_list").alias("item")))


def flat_labels(batched: DataFrame, size: int) -> DataFrame:
    """Labels of a batch flattened in window order and cast to int.

    ``batched`` has ``batch_id``, ``slot`` (rank of the window in its batch, 1-based) and
    ``target_list``; the output has one row per label with its flat index."""
    out = batched.select("batch_id", "slot", F.posexplode("target_list").alias("t", "label"))
    return out.select("batch_id", ((F.col("slot") - 1) * size + F.col("t")).cast("bigint").alias("flat_idx"),
                      F.col("label").cast("int").alias("label"))


SEGMENT_LEN = 4096


def collect_sequences(df: DataFrame, order_by, group_by, cols, *, segment_len: int | None = None,
                      tiebreak=None) -> DataFrame:
    """A1 (CollectList): ordered, aligned ``<col>_list`` arrays per group.

    A group is cut into segments of ``segment_len`` rows so a list never grows without bound;
    groups no longer than that give one row as in the reference. Nothing is lost at a seam:
    besides ``segment`` (0-based) a row has ``start`` (position of its first element, from 1),
    ``n`` (rows of the group) and ``<col>_next``, the value that follows its last element in the
    group (NULL after the group's last), so labels and windows across segments are the
    group's own."""
    segment_len = SEGMENT_LEN if segment_len is None else segment_len
    if segment_len < 1:
        raise ValueError("segment_len must be at least 1")
    g = _as_list(group_by)
    order = _as_list(order_by) + (_as_list(tiebreak) if tiebreak else [])
    cols = _as_list(cols)
    p = positions(df, g, order, cols, pos_col="_pos", n_col="_n", lead_default=None)
    p = p.withColumn("segment", F.floor((F.col("_pos") - 1) / segment_len).cast("bigint"))
    s = F.sort_array(F.collect_list(F.struct(F.col("_pos"), *[F.col(c).alias(f"_c_{c}") for c in cols])))
    nexts = [F.max_by(F.col(f"next_{c}"), F.col("_pos")).alias(f"{c}_next") for c in cols]
    out = p.groupBy(*g, "segment").agg(s.alias("_s"), F.min("_pos").alias("start"), F.max("_n").alias("n"), *nexts)
    return out.select(*g, "segment", "start", "n", *[F.col(f"_s._c_{c}").alias(f"{c}_list") for c in cols],
                      *[f"{c}_next" for c in cols])


def unnest_windows(windows: DataFrame, group=("user", "chunk"), cols=("item", "target")) -> DataFrame:
    """Window arrays back to one row per element (``t`` = offset)."""
    g = _as_list(group)
    cols = _as_list(cols)
    z = F.arrays_zip(*[F.col(f"{c}_list").alias(c) for c in cols])
    out = windows.select(*g, F.posexplode(z).alias("t", "_z"))
    return out.select(*g, F.col("t").cast("bigint").alias("t"), *[F.col(f"_z.{c}").alias(c) for c in cols])
