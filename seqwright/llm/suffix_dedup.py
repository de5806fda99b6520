"""Exact removal of repeated byte strings of ``LENGTH`` or more with a sampled suffix array.

A byte goes if a 400-byte string that covers it starts at two or more places of the corpus.

1. ``anchors``: of the 64-byte grams in each 400-byte window, the one with the least hash (the
   leftmost on ties) is the window's anchor. Equal windows have their anchor at the same place,
   so it is enough to compare windows at anchors. An anchor's context is what its windows can
   reach: up to 336 bytes before it and 400 from it on, cut at the text's ends. There is one
   anchor for about 170 bytes; it travels as hashes (gram, 128 bits of context), not as text.
2. Contexts that occur twice or more repeat as a whole; they are counted with a map-side
   aggregation, so thousands of copies meet as one row. Grams with one context need no more.
3. The different contexts of a shared gram are sparse suffixes. Splitters from a sample range
   partition them by their leading bytes (the part from the anchor on, then the part before
   it read backwards). Each bucket is sorted by a multikey sort, eight bytes at a time within
   ties, and neighbours are compared, also across bucket boundaries. The same is done in the
   other direction. The longest match to the right (with its match to the left) and the
   longest to the left (with its match to the right) settle a context, if both matches have 400
   bytes, or if even the longest two together have less.
4. The rest are settled exactly: the windows of the contexts of their gram are hashed (128 bits)
   where they lie, counted with a map-side aggregation, and the repeated ones join back.
5. Covered spans join back to the anchors and are merged for each text.

Grams, contexts and windows are found by hashes of 64 and 128 bits. A colliding gram only costs
comparisons; windows and contexts rely on 128 bits.

Texts are worked off in slices of ``PIECE`` bytes; a longer text is cut into pieces that overlap by the
reach of a context, and each anchor belongs to the piece in which it stands, so memory does not follow
the length of a text (beyond its own bytes).

Defined cases: null and empty texts have 0 bytes and the hash of nothing. Rows with the same id
and text get the same result (and repeat each other). Extra columns are ignored. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqwright.llm import textnp as T
from seqwright.llm.common import written

LENGTH = 400
GRAM = 64
BUCKET_ROWS = 20_000
MAX_BUCKETS = 4096
SAMPLE = 20
UNIT_ROWS = 100_000
WINDOWS = 250_000   # window hashes a task makes at a time
PIECE = 256 << 10   # bytes of text whose grams a task holds at a time

U = np.uint64
BASE2 = U(0xC2B2AE3D27D4EB4F)
BASE2_INVERSE = U(pow(int(BASE2), -1, 1 << 64))


def _prefix2(data):
    out = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(7)) * T.powers(BASE2, len(data)), out=out[1:])
    return out


def _span2(prefix, start, end):
    h = (prefix[end] - prefix[start]) * T.powers(BASE2_INVERSE, len(prefix))[start]
    return T.mix(h + (end - start).astype(U) * U(0x9FB21C651E98DF25))


def anchors(data: np.ndarray, offs: np.ndarray, length: int, gram: int):
    """(row, position, left, right, gram hash, context hash 1 and 2) of every anchor in a slice."""
    w = length - gram + 1
    n = len(data) - gram + 1
    size = np.diff(offs)
    rows = np.flatnonzero(size >= length)
    none = np.zeros(0, np.int64)
    if not len(rows):
        return none, none, none, none, none.astype(U), none.astype(U), none.astype(U)
    p1 = T.prefix_hash(data)
    at = np.arange(n)
    g = T.span_hash(p1, at, at + gram)
    packed = (g & U(0xFFFFFFFF00000000)) | at.astype(U)
    m = -(-n // w) * w
    full = np.full(m, ~U(0))
    full[:n] = packed
    grid = full.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = (np.minimum(back[:n - w + 1], ahead[w - 1:n]) & U(0xFFFFFFFF)).astype(np.int64)
    # windows that lie in one text
    ok = np.zeros(len(data) + 1, np.int32)
    np.add.at(ok, offs[rows], 1)
    np.add.at(ok, offs[rows + 1] - length + 1, -1)
    ok = np.cumsum(ok)[:n - w + 1] > 0
    a = least[ok]
    a = a[np.flatnonzero(np.diff(a, prepend=-1))]
    row = np.searchsorted(offs, a, "right") - 1
    left = np.minimum(a - offs[row], length - gram)
    right = np.minimum(offs[row + 1] - a, length)
    extent = left.astype(U) * U(1 << 20) + right.astype(U)
    c1 = T.mix(T.span_hash(p1, a - left, a + right) ^ extent * T.BASE)
    c2 = T.mix(_span2(_prefix2(data), a - left, a + right) ^ extent * BASE2)
    return row, a, left, right, g[a], c1, c2


def anchor_pieces(data: np.ndarray, offs: np.ndarray, length: int, gram: int):
    """(bytes, their place in the slice, and what ``anchors`` gives of them): a slice as it is, a longer text in
    pieces with ``length - gram`` bytes before and ``length - 1`` after them, so that every window that may
    have its anchor in a piece, and the anchor's whole context, lie in the bytes."""
    if len(data) <= PIECE:
        yield data, 0, *anchors(data, offs, length, gram)
        return
    for a in range(0, len(data), PIECE):
        lo, hi = max(0, a - (length - gram)), min(len(data), a + PIECE + length - 1)
        got = anchors(data[lo:hi], np.array([0, hi - lo]), length, gram)
        own = (got[1] + lo >= a) & (got[1] + lo < a + PIECE)
        yield data[lo:hi], lo, *(x[own] for x in got)


def text_keys(data: np.ndarray, offs: np.ndarray, ids: pa.Array) -> np.ndarray:
    """A 64-bit key of each row's id and text; a text above ``PIECE`` bytes, alone in its slice, by a running hash."""
    i = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U)
    null = np.asarray(ids.is_null()).astype(U)
    if len(data) > PIECE:
        own = np.frombuffer(hashlib.blake2b(np.ascontiguousarray(data), digest_size=8).digest(), U)
    else:
        own = T.span_hash(T.prefix_hash(data), offs[:-1], offs[1:])
    return T.mix(own ^ T.mix(i + null * U(0x632BE59BD9B4E019)))


def i64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


ANCHORS = "text_key bigint, at int, l int, r int, gram bigint, c1 bigint, c2 bigint"


def anchor_table(src: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches):
        for b in batches:
            for lo, hi, data, offs in T.slices(b, 1, PIECE):
                key = text_keys(data, offs, b.column(0).slice(lo, hi - lo))
                for _, place, row, a, left, right, g, c1, c2 in anchor_pieces(data, offs, length, gram):
                    if len(a):
                        i32 = lambda x: pa.array(x.astype(np.int32))
                        yield pa.RecordBatch.from_arrays(
                            [i64(key[row]), i32(a + place - offs[row]), i32(left), i32(right), i64(g), i64(c1), i64(c2)],
                            names=["text_key", "at", "l", "r", "gram", "c1", "c2"])

    return src.mapInArrow(run, ANCHORS)


# ---------------------------------------------------------------- filters that stay small
MAX_BITS = 1 << 28


def bit_filter(keys: DataFrame, col: str) -> tuple[np.ndarray, int]:
    """A bit set over 64-bit keys, 16 bits a key and at most 32 MB; joins drop what else passes."""
    n = keys.count()
    bits = min(MAX_BITS, 1 << max(16, int(n * 16).bit_length()))
    at = keys.select((F.col(col).bitwiseAND(F.lit(bits - 1))).alias("p"))
    at = at.select(F.expr("cast(p div 64 as int)").alias("w"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("m"))
    words = np.zeros(bits // 64, np.int64)
    for b in at.groupBy("w").agg(F.bit_or("m").alias("m")).toArrow().to_batches():
        words[b.column(0).to_numpy()] = b.column(1).to_numpy()
    return words, bits


def in_filter(words: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    p = (keys & U(bits - 1)).astype(np.int64)
    return (words[p // 64] >> (p % 64)) & 1 == 1


def context_bytes(src: DataFrame, wanted: DataFrame, texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(gram, c1, c2, ahead, back) of the wanted contexts: the bytes from the anchor on, and those
    before it read backwards."""
    sc = src.sparkSession.sparkContext
    by_text, text_bits = bit_filter(texts, "text_key")
    by_context, context_bits = bit_filter(wanted, "c1")
    sent = sc.broadcast((by_text, by_context))

    def run(batches):
        by_text, by_context = sent.value
        for b in batches:
            for lo, hi, data, offs in T.slices(b, 1, PIECE):
                key = text_keys(data, offs, b.column(0).slice(lo, hi - lo))
                need = in_filter(by_text, text_bits, key)
                if not need.any():
                    continue
                size = np.diff(offs) * need
                part = np.concatenate([data[offs[i]:offs[i + 1]] for i in np.flatnonzero(need)])
                offs = np.concatenate([[0], np.cumsum(size)])
                for piece, _, _, a, left, right, g, c1, c2 in anchor_pieces(part, offs, length, gram):
                    keep = np.flatnonzero(in_filter(by_context, context_bits, c1))
                    _, one = np.unique(c1[keep], return_index=True)
                    keep = keep[one]
                    if not len(keep):
                        continue
                    raw = piece.tobytes()
                    ahead = [raw[x:x + r] for x, r in zip(a[keep].tolist(), right[keep].tolist())]
                    back = [raw[x - y:x][::-1] for x, y in zip(a[keep].tolist(), left[keep].tolist())]
                    yield pa.RecordBatch.from_arrays([i64(g[keep]), i64(c1[keep]), i64(c2[keep]), pa.array(ahead, pa.binary()),
                                                      pa.array(back, pa.binary())], names=["gram", "c1", "c2", "ahead", "back"])

    got = src.mapInArrow(run, "gram bigint, c1 bigint, c2 bigint, ahead binary, back binary")
    return got.join(wanted.select("c1", "c2"), ["c1", "c2"], "left_semi").dropDuplicates(["c1", "c2"]) \
        .select("gram", "c1", "c2", "ahead", "back")


# ---------------------------------------------------------------- the suffix sort
def grid(values: list[bytes], width: int) -> np.ndarray:
    """(n, width) bytes, zero-padded."""
    return np.array(values, dtype=f"S{width}").view(np.uint8).reshape(len(values), width)


def multikey_order(keys: np.ndarray) -> np.ndarray:
    """Order of the rows of an (n, width) byte grid: sort by eight bytes, then only inside ties by
    the next eight, and so on."""
    n, width = keys.shape
    pad = -width % 8
    cols = np.ascontiguousarray(np.pad(keys, ((0, 0), (0, pad)))).view(">u8").astype(U)
    order = np.arange(n)
    lo, hi = np.array([0]), np.array([n])  # tied ranges of `order`
    for c in range(cols.shape[1]):
        size = hi - lo
        lo, size = lo[size > 1], size[size > 1]
        if not len(lo):
            break
        group = np.repeat(np.arange(len(lo)), size)
        at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
        rows = order[at]
        value = cols[rows, c]
        by = np.lexsort((value, group))
        order[at] = rows[by]
        value = value[by]
        new = np.ones(len(at), bool)
        new[1:] = (value[1:] != value[:-1]) | (group[1:] != group[:-1])
        lo = at[new]
        first = np.flatnonzero(new)
        hi = lo + np.diff(first, append=len(at))
    return order


def common_prefix(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    differ = x != y
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), x.shape[1])
    return np.minimum(first, np.minimum(nx, ny))


def neighbours(contexts: DataFrame, major: str, minor: str, wide: int, narrow: int) -> DataFrame:
    """(c1, c2, best, other): the longest common prefix of ``major`` with any context of the same
    gram, and the common prefix of ``minor`` with that neighbour. Contexts are sorted by gram first:
    else one of another gram could stand between two of the same."""
    spark = contexts.sparkSession
    wide_key = 8 + wide + narrow

    def sort_keys(t):
        """(n, 8 + wide + narrow) bytes: the gram's hash, ``major`` and ``minor``."""
        gram = np.ascontiguousarray(t.column("gram").to_numpy()).astype(">i8").view(np.uint8).reshape(-1, 8)
        return np.hstack([gram, grid(t.column(major).to_pylist(), wide), grid(t.column(minor).to_pylist(), narrow)])

    n = contexts.count()
    buckets = max(1, min(MAX_BUCKETS, -(-n // BUCKET_ROWS)))
    share = min(1.0, SAMPLE * buckets / max(n, 1) * 1.2)
    sample = contexts.sample(False, share, 7).select("gram", major, minor).toArrow() if buckets > 1 else None
    if sample is not None and sample.num_rows:
        s = np.sort(sort_keys(sample).view(f"S{wide_key}").ravel())
        splitters = s[np.linspace(0, len(s) - 1, buckets + 1).astype(int)[1:-1]]
    else:
        splitters = np.zeros(0, f"S{wide_key}")
    sent = spark.sparkContext.broadcast(splitters)

    def deal(batches):
        cuts = sent.value
        for b in batches:
            if b.num_rows:
                k = sort_keys(b).view(f"S{wide_key}").ravel()
                yield b.append_column("bucket", pa.array(np.searchsorted(cuts, k, "right").astype(np.int32)))

    def compare(t, order):
        """Neighbour matches in sorted order: per row (best, other)."""
        t = t.take(pa.array(order))
        a, b = t.column(major).to_pylist(), t.column(minor).to_pylist()
        ga, gb = grid(a, wide), grid(b, narrow)
        na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
        gram = t.column("gram").to_numpy()
        same = gram[1:] == gram[:-1]
        p = np.where(same, common_prefix(ga[1:], ga[:-1], na[1:], na[:-1]), -1)
        q = np.where(same, common_prefix(gb[1:], gb[:-1], nb[1:], nb[:-1]), -1)
        best = np.full(len(a), -1)
        other = np.full(len(a), -1)
        for side, (x, y) in ((slice(1, None), (p, q)), (slice(None, -1), (p, q))):
            up = (x > best[side]) | (x == best[side]) & (y > other[side])
            best[side] = np.where(up, x, best[side])
            other[side] = np.where(up, y, other[side])
        return t, best, other

    def out(t, best, other, edge):
        n = len(best)
        none = pa.nulls(n, pa.binary())
        cols = [t.column("gram"), t.column("c1"), t.column("c2"), pa.array(best.astype(np.int32)),
                pa.array(other.astype(np.int32))]
        cols += [t.column(major), t.column(minor)] if edge else [none, none]
        return pa.Table.from_arrays(cols + [pa.array(np.full(n, edge))],
                                    names=["gram", "c1", "c2", "best", "other", "ahead", "back", "edge"]).combine_chunks()

    def sort_bucket(batches):
        for t in T.runs(batches, "bucket"):
            bucket = t.column("bucket").to_numpy()
            cut = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
            for lo, hi in zip(cut[:-1], cut[1:]):
                part = t.slice(lo, hi - lo)
                part, best, other = compare(part, multikey_order(sort_keys(part)))
                yield from out(part, best, other, False).to_batches()
                ends = [0, hi - lo - 1] if hi - lo > 1 else [0]
                yield from out(part.take(pa.array(ends)), best[ends], other[ends], True).to_batches()

    dealt = contexts.mapInArrow(deal, "gram bigint, c1 bigint, c2 bigint, ahead binary, back binary, bucket int")
    got = dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(
        sort_bucket, "gram bigint, c1 bigint, c2 bigint, best int, other int, ahead binary, back binary, edge boolean")
    got = written(got, "suffix-neighbours")
    inner = got.where("not edge").select("c1", "c2", "best", "other")
    if buckets == 1:
        return inner
    # the first and last suffix of every bucket (at most 2 a bucket, bounded) are compared once more
    ends = got.where("edge").select("gram", "c1", "c2", F.col("ahead").alias(major), F.col("back").alias(minor)).toArrow()
    ends = ends.combine_chunks()
    if not ends.num_rows:
        return inner
    ends, best, other = compare(ends, multikey_order(sort_keys(ends)))
    edge = out(ends, best, other, False).select(["c1", "c2", "best", "other"])
    edge = spark.createDataFrame(edge)
    top = F.max(F.struct("best", "other"))
    return inner.unionByName(edge).groupBy("c1", "c2").agg(top.alias("t")).select("c1", "c2", "t.best", "t.other")


def _window_hashes(ahead, back, first, last, length: int):
    """(row, j, hash 1, hash 2) of the windows that start j = first[row]..last[row] bytes before the
    anchor."""
    row, j, h1, h2 = [], [], [], []
    step = max(1, PIECE // (2 * length))
    for lo in range(0, len(ahead), step):
        text = [y[::-1] + x for x, y in zip(ahead[lo:lo + step], back[lo:lo + step])]
        left = np.array([len(y) for y in back[lo:lo + step]])
        size = np.array([len(x) for x in text])
        data = np.frombuffer(b"".join(text), np.uint8)
        n = np.maximum(0, last[lo:lo + step] - first[lo:lo + step] + 1)
        r = np.repeat(np.arange(len(text)), n)
        k = np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n) + first[lo:lo + step][r]
        s = (np.cumsum(size) - size)[r] + left[r] - k
        row.append(r + lo)
        j.append(k)
        h1.append(T.span_hash(T.prefix_hash(data), s, s + length))
        h2.append(_span2(_prefix2(data), s, s + length))
    return tuple(np.concatenate(x) for x in (row, j, h1, h2))


WINDOW_KEYS = "k1 bigint, k2 bigint"


def exact_windows(contexts: DataFrame, length: int) -> DataFrame:
    """(c1, c2, cl, cr): how far the repeated windows of each open context reach before and after its
    anchor. Only windows within a context's longest matches (``l2`` before, ``r1`` after the anchor)
    can repeat; they are hashed where the context lies (128 bits, with gram and position) and counted
    by Spark with a map-side aggregation, so no task holds a gram. Windows of contexts that are not
    open only count, and travel only if they pass a filter over those of the open ones."""
    spark = contexts.sparkSession
    work = contexts.where(f"l2 + r1 >= {length}").select("gram", "c1", "c2", "ahead", "back", "l2", "r1", "open")

    def hashed(batches):
        step = max(1, min(UNIT_ROWS, WINDOWS // length))
        for b in batches:
            for lo in range(0, b.num_rows, step):
                t = b.slice(lo, step)
                ahead, back = t.column("ahead").to_pylist(), t.column("back").to_pylist()
                lowest = np.maximum(length - np.minimum(t.column("r1").to_numpy(), [len(x) for x in ahead]), 0)
                highest = np.minimum(t.column("l2").to_numpy(), [len(x) for x in back])
                row, j, h1, h2 = _window_hashes(ahead, back, lowest, highest, length)
                if len(row):
                    gram = t.column("gram").to_numpy().view(U)[row]
                    yield t, row, j, T.mix(h1 ^ T.mix(gram * U(length + 1) + j.astype(U))), h2

    def of_open(batches):
        for t, row, j, k1, k2 in hashed(batches):
            c1, c2 = (t.column(c).to_numpy()[row] for c in ("c1", "c2"))
            yield pa.RecordBatch.from_arrays([i64(k1), i64(k2), pa.array(j.astype(np.int32)), i64(c1), i64(c2)],
                                             names=["k1", "k2", "j", "c1", "c2"])

    # written, so that the join has a plain shuffle on both sides and a window of many contexts can be split
    mine = written(work.where("open").mapInArrow(of_open, f"{WINDOW_KEYS}, j int, c1 bigint, c2 bigint"), "open-windows")
    words, bits = bit_filter(mine, "k1")
    sent = spark.sparkContext.broadcast(words)

    def of_others(batches):
        for _, _, _, k1, k2 in hashed(batches):
            keep = in_filter(sent.value, bits, k1)
            yield pa.RecordBatch.from_arrays([i64(k1[keep]), i64(k2[keep])], names=["k1", "k2"])

    every = mine.select("k1", "k2").unionByName(work.where("not open").mapInArrow(of_others, WINDOW_KEYS))
    twice = written(every.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k1", "k2"),
                    "repeated-windows")
    return mine.join(twice, ["k1", "k2"]).groupBy("c1", "c2").agg(
        F.max("j").alias("cl"), (F.lit(length) - F.min("j")).alias("cr"))


# ---------------------------------------------------------------- the operator
def repeated_spans(src: DataFrame, length: int, gram: int) -> DataFrame:
    """(text_key, spans): array of (lo, hi) byte ranges of each text that repeat, unmerged."""
    found = written(anchor_table(src, length, gram), "anchors")
    # written, so that the join has a plain shuffle on both sides and a hot gram can be split
    grams = written(found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "grams")
    shared = written(found.join(grams, "gram"), "shared-anchors")
    contexts = written(shared.groupBy("gram", "c1", "c2").agg(
        F.count(F.lit(1)).alias("n"), F.min("l").alias("l"), F.min("r").alias("r")), "contexts")
    several = written(contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("gram"), "grams")
    wanted = written(contexts.join(several, "gram").select("gram", "c1", "c2", "n"), "wanted")
    texts = shared.join(wanted.select("c1", "c2"), ["c1", "c2"], "left_semi").select("text_key").distinct()
    parts = int(src.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    suffixes = written(context_bytes(src, wanted, texts, length, gram).repartition(parts, "c1"), "suffixes")
    before = length - gram
    ahead = neighbours(suffixes, "ahead", "back", length, before) \
        .select("c1", "c2", F.col("best").alias("r1"), F.col("other").alias("l1"))
    back = neighbours(suffixes, "back", "ahead", before, length) \
        .select("c1", "c2", F.col("best").alias("l2"), F.col("other").alias("r2"))
    # a byte 0 sorts like the end of a context: such contexts are settled exactly
    nul = (F.instr(F.hex("ahead"), "00") > 0) | (F.instr(F.hex("back"), "00") > 0)
    both = suffixes.select("gram", "c1", "c2", nul.alias("nul")).join(ahead, ["c1", "c2"]).join(back, ["c1", "c2"])
    open_ = F.col("nul") | (F.col("l2") + F.col("r1") >= length) & (
        (F.col("l1") + F.col("r1") < length) | (F.col("l2") + F.col("r2") < length))
    both = written(both.withColumn("open", open_), "settled")
    # grams with an open context; zero bytes make the neighbours' matches too short to bound anything
    grams = written(both.groupBy("gram").agg(F.max("open").alias("any_open"), F.max("nul").alias("any_nul"))
                    .where("any_open").select("gram", "any_nul"), "open-grams")
    bounds = [F.when(F.col("any_nul"), most).otherwise(F.col(c)).alias(c) for c, most in (("l2", F.lit(before)), ("r1", F.lit(length)))]
    settled = both.where(f"not open and l1 + r1 >= {length} and l2 + r2 >= {length}") \
        .select("c1", "c2", F.col("l2").alias("cl"), F.col("r1").alias("cr"))
    rest = both.join(grams, "gram").select("c1", "c2", "open", *bounds).where(f"l2 + r1 >= {length}")
    exact = exact_windows(suffixes.join(rest, ["c1", "c2"]), length)
    whole = contexts.where("n > 1").select("c1", "c2", F.col("l").alias("cl"), F.col("r").alias("cr"))
    cover = written(whole.unionByName(settled).unionByName(exact).groupBy("c1", "c2").agg(
        F.max("cl").alias("cl"), F.max("cr").alias("cr")), "cover")
    spans = shared.select("text_key", "at", "c1", "c2").join(cover, ["c1", "c2"])
    spans = spans.select("text_key", (F.col("at") - F.col("cl")).alias("lo"), (F.col("at") + F.col("cr")).alias("hi"))
    return spans.distinct().groupBy("text_key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


RESULT = "text_key bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_text binary"


def merged(spans: np.ndarray) -> np.ndarray:
    """Sorted disjoint runs of (lo, hi) ranges; ranges that touch become one run."""
    s = spans[np.argsort(spans[:, 0], kind="stable")]
    top = np.maximum.accumulate(s[:, 1])
    new = np.ones(len(s), bool)
    new[1:] = s[1:, 0] > top[:-1]
    first = np.flatnonzero(new)
    return np.stack([s[first, 0], top[np.append(first[1:], len(s)) - 1]], axis=1)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text", *, length: int = LENGTH,
                   gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text, the bytes left,
    if ``with_text``; null where nothing was removed)."""
    src = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    spans = written(repeated_spans(src, length, gram), "spans")
    words, bits = bit_filter(spans, "text_key")
    sent = src.sparkSession.sparkContext.broadcast(words)

    def base(batches):
        for b in batches:
            for lo, hi, data, offs in T.slices(b, 1, PIECE):
                ids = b.column(0).slice(lo, hi - lo)
                raw = memoryview(np.ascontiguousarray(data))
                sha = [hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(offs[:-1].tolist(), offs[1:].tolist())]
                yield pa.RecordBatch.from_arrays([ids, i64(text_keys(data, offs, ids)), pa.array(np.diff(offs)), pa.array(sha)],
                                                 names=["doc_id", "text_key", "n_bytes", "sha"])

    def chosen(batches):
        has = sent.value
        for b in batches:
            for lo, hi, data, offs in T.slices(b, 1, PIECE):
                key = text_keys(data, offs, b.column(0).slice(lo, hi - lo))
                keep = np.flatnonzero(in_filter(has, bits, key))
                if len(keep):
                    raw = memoryview(np.ascontiguousarray(data))
                    yield pa.RecordBatch.from_arrays([i64(key[keep]), pa.array([raw[offs[i]:offs[i + 1]] for i in keep], pa.binary())],
                                                     names=["text_key", "raw"])

    def cut(batches):
        for b in batches:
            out = []
            for key, raw, sp in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                m = merged(np.array([(x["lo"], x["hi"]) for x in sp]))
                at, left = 0, []
                for lo, hi in m.tolist():
                    left.append(raw[at:lo])
                    at = hi
                left = b"".join([*left, raw[at:]])
                out.append((key, int((m[:, 1] - m[:, 0]).sum()), len(m), hashlib.sha256(left).hexdigest(),
                            left if with_text else None))
            if out:
                cols = list(zip(*out))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                                 names=["text_key", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    raw = src.mapInArrow(chosen, "text_key bigint, raw binary").join(spans, "text_key").dropDuplicates(["text_key"])
    changed = raw.select("text_key", "raw", "spans").mapInArrow(cut, RESULT)
    out = src.mapInArrow(base, "doc_id bigint, text_key bigint, n_bytes bigint, sha string").join(changed, "text_key", "left")
    zero = F.lit(0).cast("bigint")
    cols = ["doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"),
            F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256")]
    return out.select(*cols, *(["kept_text"] if with_text else []))
