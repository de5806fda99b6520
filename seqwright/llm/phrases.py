"""Phrase collocations by Toivonen's sampling method, with exact counts.

1. A hashed sample of the documents (one in ``SAMPLE_EVERY``) proposes phrases: all those whose count in the
   sample reaches a lowered share of the threshold.
2. One pass over all documents counts the proposed phrases and their negative border: the phrases that are
   not proposed while both parts that lack one end word are. The border is not listed: an occurrence belongs to
   the proposal or its border exactly if its first and its last n-1 words are proposed (single words always do).
3. Border failures, frequent phrases nobody proposed, make further phrases possible. An expansion pass counts
   the occurrences whose two parts are known to be frequent and that no earlier pass counted, again and
   again until a pass finds nothing new that could be extended. Every part of a frequent phrase is frequent, so
   the set is then whole, whatever the sample held; there are at most as many passes as words in a phrase.
4. These counts go by 64-bit hashes, which can only add up too much. A last pass counts the frequent phrases by
   their text.

Known phrases travel as a Bloom filter of at most ``FILTER_BITS`` bits. A false hit only has a phrase counted that
need not be, and is the same in every task and pass. Tasks add up their occurrences before they send them, as
sorted arrays of hashes and counts by hash range, so a word of a third of all occurrences is one entry of a task.
The number of hash ranges follows the text.

Defined cases: a null text is empty, a null language ``und``; rows that repeat count each time. Ties of the
ranking end with the phrase's bytes. Texts above ``LONG`` bytes are worked off in parts that overlap by the
words a phrase may reach beyond, so a part's size bounds a task. Empty tables give no rows; extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqwright.llm import textnp as T
from seqwright.llm.common import written

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2_000
CONTAINED = 100            # percent of a phrase's count that a longer one must have to drop it
SAMPLE_EVERY = 16
LOWERED = 0.6              # of the threshold's share that a phrase must have in the sample
FILTER_BITS = 1 << 29      # of a filter, at most (64 MB)
BITS_PER_KEY = 16
RANGE_TEXT = 4 << 20       # bytes of text per hash range
FLUSH = 3_000_000          # occurrences a task holds before it adds them up and sends them
FLUSH_PHRASES = 500_000    # distinct phrases with their text that a task holds
LONG = 1 << 20

U = np.uint64
PIECE_END = np.zeros(256, bool)
PIECE_END[list(b".,;:!?\n\x0b\x0c\r")] = True
SEPARATOR = PIECE_END.copy()
SEPARATOR[[0x20, 0x09]] = True
LINK = U(0x9FB21C651E98DF25)


# ---------------------------------------------------------------- occurrences in a task
def parts(batch: pa.RecordBatch, reach: int):
    """(first row, end row, bytes, offsets, own) of the batch's texts; words that start at ``own`` or later belong to
    the next part and stand here for the phrases that reach into them (at most ``reach`` words)."""
    for lo, hi, data, offs in T.slices(batch, 0):
        if hi - lo > 1 or len(data) <= LONG:
            yield lo, hi, data, offs, len(data)
            continue
        seps = np.flatnonzero(SEPARATOR[data])
        ends = seps[np.diff(seps, prepend=-1) > 1]   # separators right after a word
        a = 0
        while a < len(data):
            k = np.searchsorted(seps, a + LONG)
            b = int(seps[k]) if k < len(seps) else len(data)
            k = np.searchsorted(ends, b, "right") + reach - 1
            e = int(ends[k]) if k < len(ends) else len(data)
            yield lo, hi, data[a:e], np.array([0, e - a]), b - a
            a = b


def words(data: np.ndarray, offs: np.ndarray, own: int):
    """(lower-cased bytes, start, end, row, piece, number of own words): pieces are equal for words of one piece."""
    low = T.LOWER[data]
    ok = ~SEPARATOR[low]
    first, last = ok.copy(), ok.copy()
    if len(low):
        first[1:] &= ~ok[:-1]
        last[:-1] &= ~ok[1:]
        edge = offs[(offs > 0) & (offs < len(low))]
        first[edge] = ok[edge]
        last[edge - 1] = ok[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(offs, start, "right") - 1
    piece = np.cumsum(PIECE_END[low])[start] + row if len(start) else row
    return low, start, end, row, piece, int(np.searchsorted(start, own))


def has(filt, h: np.ndarray) -> np.ndarray:
    """Whether the filter (range bits, bits of a range, bytes) may hold each hash."""
    if filt is None:
        return np.ones(len(h), bool)
    top, inner, data = filt
    base = (h >> U(64 - top)) << U(inner) if top else np.zeros(len(h), U)
    mask = U((1 << inner) - 1)
    hit = np.ones(len(h), bool)
    for x in (h & mask, (h >> U(inner)) & mask):
        at = base + x
        hit &= (data[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & np.uint8(1) == 1
    return hit


def occurrences(w: np.ndarray, lang: np.ndarray, piece: np.ndarray, own: int, longest: int, filters: list):
    """For n = 1, 2, ..: (positions, hashes) of the n-word phrases of the last filter and its border that no
    earlier filter has in its own or its border. No filter at all takes every phrase."""
    n_words = len(w)
    now = T.mix(w ^ T.mix(lang))                       # hash of the phrase of n words from each position
    inside = [has(f, now) for f in filters]            # its first n words are a known phrase
    yield (np.arange(own), now[:own]) if len(filters) < 2 else (np.zeros(0, np.int64), now[:0])
    at = np.arange(n_words)
    for n in range(2, longest + 1):
        if n_words < n:
            return
        fits = piece[:n_words - n + 1] == piece[n - 1:]
        taken = [fits & m[:n_words - n + 1] & m[1:n_words - n + 2] for m in inside] or [fits]
        at = np.flatnonzero(np.logical_or.reduce(taken))
        h = T.mix(now[at] * LINK + w[at + n - 1] + U(n))
        nxt = np.zeros(n_words, U)
        nxt[at] = h
        now = nxt
        new = taken[-1][at] & (at < own)
        for t in taken[:-1]:
            new &= ~t[at]
        yield at[new], h[new]
        inside = []
        for f, t in zip(filters, taken):
            m = np.zeros(n_words, bool)
            m[at] = t[at] & has(f, h)
            inside.append(m)


def _lang_hashes(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return batch.column(column).to_numpy(zero_copy_only=False).astype(np.int64).view(U)


COUNTS = "n int, part int, hashes binary, counts binary"


def _count(spread, longest: int, bits: int):
    """Counted hashes of the phrases that the broadcast filters ask for, by n and hash range."""

    def run(batches):
        filters = spread.value
        held, size = [[] for _ in range(longest)], 0

        def packed():
            for n, xs in enumerate(held, 1):
                if not xs:
                    continue
                h, c = np.unique(np.concatenate(xs), return_counts=True)
                xs.clear()
                part = (h >> U(64 - bits)).astype(np.int32) if bits else np.zeros(len(h), np.int32)
                cut = np.flatnonzero(np.diff(part, prepend=-1))
                ends = [*cut[1:].tolist(), len(h)]
                c = c.astype(np.uint32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(cut), n, np.int32)), pa.array(part[cut]),
                    pa.array([h[a:e].tobytes() for a, e in zip(cut.tolist(), ends)], pa.binary()),
                    pa.array([c[a:e].tobytes() for a, e in zip(cut.tolist(), ends)], pa.binary())],
                    names=["n", "part", "hashes", "counts"])

        for b in batches:
            langs = _lang_hashes(b, 1)
            for lo, hi, data, offs, own in parts(b, longest - 1):
                low, start, end, row, piece, mine = words(data, offs, own)
                w = T.span_hash(T.prefix_hash(low), start, end)
                for n, (_, h) in enumerate(occurrences(w, langs[lo:hi][row], piece, mine, longest, filters)):
                    if len(h):
                        held[n].append(h)
                        size += len(h)
                if size >= FLUSH:
                    yield from packed()
                    size = 0
        yield from packed()

    return run


def _heavy(at_least: int):
    """The hashes of each (n, range) whose counts add up to enough; rows come sorted by n and range."""

    def run(batches):
        key, hs, cs = None, [], []

        def done():
            h, c = np.concatenate(hs), np.concatenate(cs)
            order = np.argsort(h, kind="stable")
            h, c = h[order], c[order]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            keep = h[first][np.add.reduceat(c, first) >= at_least]
            if len(keep):
                yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()),
                                                  pa.array([len(keep)], pa.int64()), pa.array([keep.tobytes()], pa.binary())],
                                                 names=["n", "part", "size", "hashes"])

        for b in batches:
            for n, part, h, c in zip(*(x.to_pylist() for x in b.columns)):
                if (n, part) != key:
                    if key is not None:
                        yield from done()
                    key, hs, cs = (n, part), [], []
                hs.append(np.frombuffer(h, U))
                cs.append(np.frombuffer(c, np.uint32).astype(np.int64))
        if key is not None:
            yield from done()

    return run


def frequent(src: DataFrame, filters: list, at_least: int, longest: int, bits: int) -> DataFrame:
    """(n, part, size, hashes) of the phrases of one pass that occur often enough, written."""
    spread = src.sparkSession.sparkContext.broadcast(filters)
    counts = src.select("text", "lang_hash").mapInArrow(_count(spread, longest, bits), COUNTS)
    counts = counts.repartition("n", "part").sortWithinPartitions("n", "part")
    return written(counts.mapInArrow(_heavy(at_least), "n int, part int, size bigint, hashes binary"), "frequent-phrases")


# ---------------------------------------------------------------- filters
def _bitmaps(top: int, inner: int, bits: int):
    """The bits of each range of hashes; rows come sorted by range."""

    def run(batches):
        seg, data = None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([seg], pa.int32()), pa.array([data.tobytes()], pa.binary())], names=["seg", "data"])

        for b in batches:
            for s, raw in zip(*(x.to_pylist() for x in b.columns)):
                if s != seg:
                    if seg is not None:
                        yield done()
                    seg, data = s, np.zeros(max(1, (1 << inner) >> 3), np.uint8)
                h = np.frombuffer(raw, U)
                mask = U((1 << inner) - 1)
                for x in (h & mask, (h >> U(inner)) & mask):
                    np.bitwise_or.at(data, (x >> U(3)).astype(np.int64), np.uint8(1) << (x & U(7)).astype(np.uint8))
        if seg is not None:
            yield done()

    return run


def filter_of(known: DataFrame, bits: int):
    """The Bloom filter of all hashes of ``known``: its size is bounded, its bits are made in tasks by
    hash range and only put side by side here."""
    size = known.agg(F.sum("size")).first()[0] or 0
    top = min(bits, 8)
    total = max(64, min(FILTER_BITS, 1 << (max(1, size) * BITS_PER_KEY - 1).bit_length()))
    inner = max(6, total.bit_length() - 1 - top)
    seg = F.shiftright("part", bits - top)
    segs = known.select(seg.alias("seg"), "hashes").repartition("seg").sortWithinPartitions("seg")
    each = max(1, (1 << inner) >> 3)
    data = np.zeros(each << top, np.uint8)
    for r in segs.mapInArrow(_bitmaps(top, inner, bits), "seg int, data binary").collect():   # FILTER_BITS in all
        data[r["seg"] * each:(r["seg"] + 1) * each] = np.frombuffer(r["data"], np.uint8)
    return top, inner, data


def _missing(spread):
    """Number of hashes of each row that the filter does not have."""

    def run(batches):
        filt = spread.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int((~has(filt, np.frombuffer(h, U))).sum()) for h in b.column(0).to_pylist()],
                                                       pa.int64())], names=["missing"])

    return run


def closed_set(src: DataFrame, min_count: int, longest: int, sample_every: int, bits: int):
    """The filter of all frequent phrases of the whole table, and the number of expansion passes it took.
    ``src`` has text, lang_hash and sampled."""
    spark = src.sparkSession
    lowered = max(1, int(min_count / sample_every * LOWERED))
    proposed = frequent(src.where("sampled"), [], lowered, longest, bits)
    filters = [filter_of(proposed, bits)]
    known = None
    passes = 0
    while True:
        got = frequent(src, filters, min_count, longest, bits)
        known = got if known is None else known.unionByName(got)
        # phrases that a filter lacks and that may be extended
        spread = spark.sparkContext.broadcast(filters[-1])
        open_ = got.where(F.col("n") < longest).select("hashes").mapInArrow(_missing(spread), "missing bigint")
        if not (open_.agg(F.sum("missing")).first()[0] or 0):
            return filter_of(known, bits), passes
        filters.append(filter_of(known, bits))
        passes += 1


# ---------------------------------------------------------------- exact counts
EXACT = "lang string, n int, phrase string, c bigint"
EXACT_ROWS = pa.schema([("lang", pa.string()), ("n", pa.int32()), ("phrase", pa.binary()), ("c", pa.int64())])
TOTALS = -1                # the range of the languages' numbers of words


def _exact(spread, longest: int, bits: int):
    """Counts of the known phrases by their text, one row per hash range and task, and of all words (n = 0) of
    each language."""

    def run(batches):
        filt = spread.value
        known = np.zeros(0, U)            # hashes, sorted
        slot = np.zeros(0, np.int64)      # place in texts of each known hash
        counts, texts, totals = np.zeros(0, np.int64), [], {}

        def rows(part, phrases, c):
            cols = list(zip(*phrases))
            body = pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()),
                                               pa.array(cols[2], pa.binary()), pa.array(c, pa.int64())], schema=EXACT_ROWS)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([body.serialize().to_pybytes()], pa.binary())],
                                              names=["part", "body"])

        def flushed():
            part = (known >> U(64 - bits)).astype(np.int64)
            cut = np.flatnonzero(np.diff(part, prepend=-1, append=-2))
            for lo, hi in zip(cut[:-1], cut[1:]):
                at = slot[lo:hi]
                yield rows(int(part[lo]), [texts[i] for i in at.tolist()], counts[at])

        for b in batches:
            langs, names = _lang_hashes(b, 1), b.column(2)
            for lo, hi, data, offs, own in parts(b, longest - 1):
                low, start, end, row, piece, mine = words(data, offs, own)
                per_row = np.bincount(row[:mine], minlength=hi - lo)
                for r in np.flatnonzero(per_row).tolist():
                    name = names[lo + r].as_py()
                    totals[name] = totals.get(name, 0) + int(per_row[r])
                w = T.span_hash(T.prefix_hash(low), start, end)
                raw = None
                for n, (at, h) in enumerate(occurrences(w, langs[lo:hi][row], piece, mine, longest, [filt]), 1):
                    keep = has(filt, h)
                    u, first, c = np.unique(h[keep], return_index=True, return_counts=True)
                    if not len(u):
                        continue
                    i = np.searchsorted(known, u)
                    new = np.ones(len(u), bool)
                    new[i < len(known)] = known[i[i < len(known)]] != u[i < len(known)]
                    if new.any():
                        raw = raw or low.tobytes()
                        for p in at[keep][first[new]].tolist():
                            words_ = [raw[x:y] for x, y in zip(start[p:p + n].tolist(), end[p:p + n].tolist())]
                            texts.append((names[lo + int(row[p])].as_py(), n, b" ".join(words_)))
                        known = np.insert(known, i[new], u[new])
                        slot = np.insert(slot, i[new], np.arange(len(counts), len(texts)))
                        counts = np.concatenate([counts, np.zeros(len(texts) - len(counts), np.int64)])
                        i = np.searchsorted(known, u)
                    counts[slot[i]] += c
                if len(texts) >= FLUSH_PHRASES:
                    yield from flushed()
                    known, slot, counts, texts = known[:0], slot[:0], counts[:0], []
        yield from flushed()
        if totals:
            yield rows(TOTALS, [(lang, 0, b"") for lang in totals], list(totals.values()))

    return run


def _added(at_least: int):
    """The phrases of each hash range by their text, with all their tasks' counts; rows come sorted by range."""

    def run(batches):
        part, held = None, []

        def done():
            t = pa.Table.from_batches(held).group_by(["lang", "n", "phrase"], use_threads=False).aggregate([("c", "sum")])
            t = t.filter(pa.compute.greater_equal(t.column("c_sum"), 0 if part == TOTALS else at_least))
            t = t.set_column(t.schema.get_field_index("phrase"), "phrase", t.column("phrase").cast(pa.string()))
            for b in t.select(["lang", "n", "phrase", "c_sum"]).rename_columns(["lang", "n", "phrase", "c"]).combine_chunks().to_batches():
                yield b

        for b in batches:
            for p, body in zip(*(x.to_pylist() for x in b.columns)):
                if p != part:
                    if held:
                        yield from done()
                    part, held = p, []
                held.append(pa.ipc.read_record_batch(pa.py_buffer(body), EXACT_ROWS))
        if held:
            yield from done()

    return run


def counted(df: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", *, min_count: int = MIN_COUNT,
            max_words: int = MAX_WORDS, sample_every: int = SAMPLE_EVERY) -> DataFrame:
    """(lang, n, phrase, c) of every phrase of up to ``max_words`` words that occurs ``min_count`` times, exactly,
    and per language a row with n = 0 and the number of its words; written."""
    name = F.coalesce(F.col(lang).cast("string"), F.lit("und"))
    src = df.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.xxhash64(name).alias("lang_hash"), name.alias("lang"),
                    (F.pmod(F.xxhash64(id_col, text), F.lit(sample_every)) == 0).alias("sampled"))
    size = src.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    bits = max(4, (size // RANGE_TEXT).bit_length())
    filt, _ = closed_set(src, min_count, max_words, sample_every, bits)
    spread = src.sparkSession.sparkContext.broadcast(filt)
    exact = src.select("text", "lang_hash", "lang").mapInArrow(_exact(spread, max_words, bits), "part int, body binary")
    exact = exact.repartition("part").sortWithinPartitions("part").mapInArrow(_added(min_count), EXACT)
    return written(exact, "phrase-counts")


def collocations(df: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", *, min_count: int = MIN_COUNT,
                 max_words: int = MAX_WORDS, top: int | None = TOP, contained: int = CONTAINED,
                 sample_every: int = SAMPLE_EVERY) -> DataFrame:
    """Each language's first ``top`` phrases (all of them without one) of 2 to ``max_words`` words by their weakest
    cut: lang, rank, phrase, a (count), l, r (counts of the cut's parts), n (words of the language), score. Phrases
    inside a longer one that occurs ``contained`` percent as often are dropped."""
    c = counted(df, id_col, text, lang, min_count=min_count, max_words=max_words, sample_every=sample_every)
    total = c.where("n = 0").select("lang", F.col("c").alias("total"))
    known = c.where("n > 0").select("lang", "phrase", "c")
    cand = c.where("n > 1").withColumnRenamed("c", "a")

    # the two phrases that lack an end word: if any longer phrase drops one, the one a word longer does
    ends = F.array(F.expr("substring_index(phrase, ' ', n - 1)"), F.expr("substring_index(phrase, ' ', 1 - n)"))
    inner = cand.where("n > 2").select("lang", F.explode(ends).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    dec = lambda x: F.col(x).cast("decimal(19,0)")
    left = cand.join(inner, ["lang", "phrase"], "left")
    left = left.where(F.col("longer").isNull() | (dec("longer") * 100 < dec("a") * contained)).drop("longer")

    cuts = left.withColumn("k", F.explode(F.expr("sequence(1, n - 1)")))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring_index(phrase, ' ', k - n)"))
    for part, count in (("first", "l"), ("rest", "r")):
        side = known.select("lang", F.col("phrase").alias(part), F.col("c").alias(count))
        cuts = cuts.join(side, ["lang", part])
    cuts = cuts.join(total, "lang").withColumn("up", dec("a") * dec("total") * F.lit(1000).cast("decimal(4,0)"))
    cuts = cuts.withColumn("down", dec("l") * dec("r")).withColumn("score", F.expr("up div down"))
    best = cuts.groupBy("lang", "phrase", "a", "total").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    order = Window.partitionBy("lang").orderBy(F.col("b.score").desc(), F.col("a").desc(), F.col("phrase"))
    best = best.withColumn("rank", F.row_number().over(order).cast("bigint"))
    if top is not None:
        best = best.where(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "b.l", "b.r", F.col("total").alias("n"), "b.score")
