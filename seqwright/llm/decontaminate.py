"""Benchmark decontamination by template windows (native: DataFrame and SQL functions only).

``canonical`` turns a text into template tokens: numbers become ``<num>``, a unit after a number
``<unit>``, a capitalised word inside a sentence ``<name>`` (not one all in capitals); the rest is lower-cased words
without punctuation. A second, wide form has ``<name>`` for every capitalised word wherever it stands (also
McDonald), but not for ``NO_NAMES``, which open sentences. Both forms have the same tokens by position, and a
window may match by either; neither depends on the text around, so a copy always has its item's windows. The marked form keeps each value (``<num=12>``), token by token beside it.

Benchmark items and documents are cut into windows of ``WINDOW`` template tokens (an item with
fewer is one window of its own length, and documents get windows of that length too). Windows
meet in a hash join on 64 bits, first by hashes alone; the texts that share a window are then
read again with their slots' values. The benchmark side is broadcast only when it has at most
``BROADCAST_WINDOWS`` windows; beyond that Spark picks the join.

A re-parameterised question has the item's template with other values. Along one alignment
(document position minus item position) the values of the slots must map one to one: the same
number stands for the same number everywhere. Windows of an alignment that fails this, and
windows with fewer than half literal tokens, count only where their values are equal too.
A document is contaminated by an item if windows that count make up ``MIN_SHARE`` of the item's.

Defined cases: null and blank texts have no window and match nothing. Repeated rows give the
same result once. Extra columns are ignored by ``matches`` and kept by ``clean``. An empty
benchmark matches nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqwright.llm.common import fresh, written

WINDOW = 8
MIN_SHARE = 0.3
BROADCAST_WINDOWS = 1_000_000

# Units that may follow a number.
UNITS = ("kg g mg lb lbs oz km m cm mm mi mile miles ft feet foot inch inches yard yards hour hours hr hrs minute minutes "
         "min second seconds sec day days week weeks month months year years dollar dollars cent cents euro euros usd eur "
         "percent liter liters litre litres ml pound pounds ton tons degree degrees mph kmh watt watts").split()

# Words that are capitalised at the start of a sentence only.
NO_NAMES = ("The An This That These Those There Here He She It They We You His Her Its Their Our Your My Each Every All Both Some "
            "Any No None Many Most Few Several Another One Two Three Four Five Six Seven Eight Nine Ten How What When Where Which "
            "Who Whose Whom Why If Then Else So But And Or Nor Yet For From In On At By To Of Off With Without Into Over Under "
            "Between Before After During Until While Since Because Although Though Once As Is Are Was Were Do Does Did Has Have "
            "Had Can Could Should Would Shall Must Not Only Also Now Later Next Last First Second Third Finally Suppose Given Let "
            "Find Calculate Determine Assume Yes Question Answer Mr Mrs Ms Dr").split()


#: Marks before a capitalised word: a name of the first form, a name of the wide form.
_NAME, _WIDE = "\u0001", "\u0002"


def noted(text: Column) -> Column:
    """Both forms in one pass over the text: tokens separated by single spaces, numbers and units with their
    values, names still words, with a mark for each form that takes them as a name."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), f"[<>={_NAME}{_WIDE}]+", " ")
    t = F.regexp_replace(t, "(?<=[\\p{Ll},;:]\\s)\\p{Lu}\\p{Ll}++(?!\\p{L})", f"{_NAME}$0")
    wide = (f"(?<!\\p{{L}})(?=\\p{{Lu}})(?!(?:{'|'.join(NO_NAMES)})(?!\\p{{L}}))"
            "(?=[\\p{L}&&[^\\p{Ll}]]++\\p{Ll})\\p{L}++")
    t = F.regexp_replace(t, wide, f"{_WIDE}$0")
    t = F.regexp_replace(t, "[0-9]++(?:[.,][0-9]++)*+", " <num=$0> ")
    t = F.regexp_replace(t, f"(?i)(?<=> {{1,2}})({'|'.join(UNITS)})(?![\\p{{L}}\\p{{N}}])", "<unit=$1>")
    # single spaces stay as they are: to match each of them would cost more than all the rest
    t = F.regexp_replace(t, f"[^\\p{{L}}\\p{{N}}<>=., {_NAME}{_WIDE}]++|(?<![0-9])[.,]++|[.,]++(?![0-9])", " ")
    return F.btrim(F.regexp_replace(F.lower(t), " {2,}", " "))


def _named(t: Column, wide: bool, name: str) -> Column:
    """One form of a noted text, its names replaced."""
    if wide:
        return F.replace(F.regexp_replace(t, f"{_NAME}?{_WIDE}([^ ]++)", name), F.lit(_NAME), F.lit(""))
    return F.replace(F.regexp_replace(t, f"{_NAME}{_WIDE}?([^ ]++)", name), F.lit(_WIDE), F.lit(""))


def marked(text: Column, wide: bool = False) -> Column:
    """The template with values, tokens separated by single spaces."""
    return _named(noted(text), wide, "<name=$1>")


def template(marked_text: Column) -> Column:
    return F.regexp_replace(marked_text, "=[^> ]*+>", ">")


def _tokens(col: Column) -> Column:
    return F.when(col == "", F.array().cast("array<string>")).otherwise(F.split(col, " "))


def _token_arrays(df: DataFrame, keys: list[str], text: str, values: bool) -> DataFrame:
    """A row per form: ``keys``, wide, _w (template tokens), _n, and with ``values`` _v (marked tokens, null if the
    text has no slot). The text is noted once for both forms. The outer form of explode here and below, since Spark
    would derive a filter from the plain one and repeat the expressions of all columns inside it."""
    d = df.select(*keys, noted(F.col(text)).alias("_t"))
    d = d.select(*keys, "_t", template(F.col("_t")).alias("_u"))
    one = [F.struct(F.lit(w).alias("wide"), _named(F.col("_u"), w, "<name>").alias("c"),
                    *([_named(F.col("_t"), w, "<name=$1>").alias("m")] if values else [])) for w in (False, True)]
    d = d.select(*keys, F.explode_outer(F.array(*one)).alias("_f"))
    d = d.select(*keys, F.col("_f.wide").alias("wide"), _tokens(F.col("_f.c")).alias("_w"),
                 *([F.when(F.instr("_f.c", "<") > 0, _tokens(F.col("_f.m"))).alias("_v")] if values else []))
    return d.withColumn("_n", F.size("_w"))


def _hashed(d: DataFrame, k: int, fits: str) -> DataFrame:
    """Adds _x{k}: the hashes of all windows of ``k`` tokens, null where ``fits`` fails. For a power of two
    a window's hash is made of those of its halves; tokens are taken by position, since slice()
    would copy the whole array for every window."""
    if k & (k - 1):
        at = ", ".join(f"get(_w, i + {x})" for x in range(k))
        return d.withColumn(f"_x{k}", F.expr(f"if({fits}, transform(sequence(0, _n - {k}), i -> xxhash64({at})), null)"))
    half, now = 1, "_w"
    while half < k // 2:
        name = f"_h{half}"
        if name not in d.columns:
            d = d.withColumn(name, F.expr(f"transform({now}, (x, i) -> xxhash64(x, get({now}, i + {half})))"))
        half, now = half * 2, name
    pair = f"xxhash64(get({now}, i), get({now}, i + {half}))" if k > 1 else "xxhash64(get(_w, i))"
    return d.withColumn(f"_x{k}", F.expr(f"if({fits}, transform(sequence(0, _n - {k}), i -> {pair}), null)"))


def _exploded(d: DataFrame, keys: list[str], lengths: list[int], vals: bool) -> DataFrame:
    """A row per window: ``keys``, wide, pos, len, h, and the marked window with ``vals``."""
    lists = []
    for k in lengths:
        text = ", ".join(f"get(_v, i + {x})" for x in range(k))
        value = f", 'vals', if(_v is null, null, concat_ws(' ', {text}))" if vals else ""
        lists.append(f"coalesce(transform(_x{k}, (x, i) -> named_struct('pos', i, 'len', {k}, 'h', x{value})), array())")
    windows_ = lists[0] if len(lists) == 1 else f"concat({', '.join(lists)})"
    d = d.select(*keys, "wide", F.explode_outer(F.expr(windows_)).alias("_x")).where("_x is not null")
    out = [*keys, "wide", "_x.pos", "_x.len", "_x.h"]
    return d.select(*out, *([F.when(F.instr("_x.vals", "<") > 0, F.col("_x.vals")).alias("vals")] if vals else []))


def window_hashes(df: DataFrame, keys: list[str], text: str, lengths: list[int]) -> DataFrame:
    """One row per window and form: ``keys``, wide, len, h; one scan for all forms and lengths."""
    d = _token_arrays(df, keys, text, False)
    for k in lengths:
        d = _hashed(d, k, f"_n >= {k}")
    if len(lengths) == 1:   # the hashes themselves, no struct around each
        return d.select(*keys, "wide", F.lit(lengths[0]).alias("len"), F.explode_outer(f"_x{lengths[0]}").alias("h")).where("h is not null")
    return _exploded(d, keys, lengths, False).drop("pos")


def windows(df: DataFrame, keys: list[str], text: str, lengths: list[int], short_whole: bool) -> DataFrame:
    """As ``window_hashes``, with vals (the marked window, null if it has no slot). ``short_whole``: a
    text below the first length is one window."""
    every = sorted({*lengths, *(range(1, max(lengths)) if short_whole else ())})
    d = _token_arrays(df, keys, text, True)
    for k in every:
        d = _hashed(d, k, f"_n >= {k}" if k in lengths else f"_n = {k}")
    return _exploded(d, keys, every, True)


def matches(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
            item_text: str = "text", *, window: int = WINDOW, min_share: float = MIN_SHARE) -> DataFrame:
    """Contaminated pairs: doc_id, text_hash, item_id, n_windows (of the item), n_matched, share,
    reparameterised (a slot's value differs from the item's)."""
    items = bench.select(F.col(item_id).alias("item_id"), F.xxhash64(F.col(item_text)).alias("item_hash"),
                         F.col(item_text).alias("t")).dropDuplicates(["item_id", "item_hash"])
    b = written(windows(items, ["item_id", "item_hash"], "t", [window], True), "benchmark-windows")
    lengths = [r[0] for r in b.select("len").distinct().collect()]  # at most `window` numbers
    size = b.where("not wide").groupBy("item_id", "item_hash").agg(F.count(F.lit(1)).alias("n_windows"))
    b = b.select("item_id", "item_hash", F.col("pos").alias("item_pos"), F.col("len").alias("item_len"),
                 F.col("h").alias("item_h"), F.col("vals").alias("item_vals"), F.col("wide").alias("item_wide"))
    if b.count() <= BROADCAST_WINDOWS:
        b, size = F.broadcast(b), F.broadcast(size)
    src = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("t"))
    at = (F.col("h") == F.col("item_h")) & (F.col("len") == F.col("item_len")) & (F.col("wide") == F.col("item_wide"))
    lengths = lengths or [window]
    # first the texts that share any window, by hashes alone; only those are looked at again with values
    some = window_hashes(src, ["doc_id", "text_hash"], "t", lengths).join(b, at).select(
        F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")).distinct()
    some = written(some, "benchmark-candidates")
    if some.count() <= BROADCAST_WINDOWS:
        some = F.broadcast(some)
    src = src.join(some, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_t")), "left_semi")
    pair = ["doc_id", "text_hash", "item_id", "item_hash"]
    every = windows(src, ["doc_id", "text_hash"], "t", lengths, False)
    n_slots = F.expr("size(filter(split(vals, ' '), x -> startswith(x, '<')))")
    poor = F.col("vals").isNotNull() & ((F.col("len") - n_slots) * 2 < F.col("len"))
    every = every.withColumn("poor", poor)
    same = F.col("vals").isNull() | (F.col("vals") == F.col("item_vals"))
    # windows of mostly slots meet any others of their length: they count only where their values are equal
    hit = every.join(b, at & (~F.col("poor") | (F.col("vals") == F.col("item_vals"))))
    hit = written(hit.withColumn("shift", F.col("pos") - F.col("item_pos")), "benchmark-hits")   # read several times below
    free = hit.where(same)  # equal values need no further check
    other = hit.where(~same)
    # along an alignment that has windows to check, the poor ones say which values stand for each other as well: they
    # are looked up by their place in the item
    lines = written(other.select(*pair, "shift", "wide").distinct(), "benchmark-alignments")
    ln = lines.toDF(*[f"_{c}" for c in (*pair, "shift", "wide")])
    slotted = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_hash") == F.col("_text_hash")) & (F.col("wide") == F.col("_wide"))
    loose = every.where("poor").join(ln, slotted)
    loose = loose.join(b, F.col("item_id").eqNullSafe(F.col("_item_id")) & (F.col("item_hash") == F.col("_item_hash"))
                       & (F.col("item_pos") == F.col("pos") - F.col("_shift")) & at)
    checked = hit.where("vals is not null").select(*pair, "shift", "wide", "vals", "item_vals").unionByName(
        loose.select(*pair, F.col("_shift").alias("shift"), "wide", "vals", "item_vals"))
    # slot pairs (item value, document value) of a window: tokens that are marked
    pairs = F.expr("filter(zip_with(split(item_vals, ' '), split(vals, ' '), (x, y) -> named_struct('i', x, 'd', y)),"
                   " p -> startswith(p.i, '<'))")
    slots = checked.select(*pair, "shift", "wide", F.explode(pairs).alias("p"))
    slots = slots.groupBy(*pair, "shift", "wide").agg(F.count_distinct("p").alias("n"), F.count_distinct("p.i").alias("ni"),
                                                      F.count_distinct("p.d").alias("nd"))
    bad = slots.where("n != ni or n != nd").select(*[F.col(c).alias(f"_{c}") for c in (*pair, "shift", "wide")])
    cond = (F.col("shift") == F.col("_shift")) & (F.col("wide") == F.col("_wide"))
    for c in pair:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_{c}"))
    good = free.withColumn("changed", F.lit(False)).unionByName(
        other.join(bad, cond, "left_anti").withColumn("changed", F.lit(True)))
    per = good.groupBy(*pair, "item_pos").agg(F.bool_and("changed").alias("changed")) \
        .groupBy(*pair).agg(F.count(F.lit(1)).alias("n_matched"), F.bool_or("changed").alias("reparameterised"))
    size = size.select(F.col("item_id").alias("_i"), F.col("item_hash").alias("_h"), "n_windows")
    per = per.join(size, F.col("item_id").eqNullSafe(F.col("_i")) & (F.col("item_hash") == F.col("_h")))
    share = F.col("n_matched") / F.col("n_windows")
    return per.where(share >= min_share).select("doc_id", "text_hash", "item_id", "n_windows", "n_matched",
                                                share.alias("share"), "reparameterised")


def clean(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that no benchmark item contaminates, with the input's columns."""
    i, h = fresh(docs, "_i", "_h")
    found = matches(docs, bench, doc_id, text, **options).select(F.col("doc_id").alias(i), F.col("text_hash").alias(h)).distinct()
    found = written(found, "contaminated")
    return docs.join(found, F.col(doc_id).eqNullSafe(F.col(i)) & (F.xxhash64(F.col(text)) == F.col(h)), "left_anti")
