"""LM scoring with a log-frequency Bloom filter of quantised n-gram counts.

Training texts are those whose crc32(id as text) mod 7 is not 2. Every task counts the words and
word pairs it reads and sends them packed, by hash bucket (6 bytes a pair, 12 bytes a word), so
a bucket's task adds up whole counts without a row per n-gram. It turns them into its segment
of the filter: an n-gram counted c is inserted with every level 1..1 + floor(log_1.5 c). The
segments are broadcast; a count is read by probing level 1, 2, ... until a miss.

The model interpolates pairs with words (Dirichlet prior ``MU``):
``P(w|v) = (c(vw) + MU * P(w)) / (c(v) + MU)`` with ``P(w) = (c(w) + 1) / (N + V + 1)``, the counts as
probed. Texts are scored from their start mark to their end.

``base_score`` needs exact counts. Words counted at least N / 2^23 times are at most 2^23, a bound
that holds for any corpus; they are broadcast with their counts. The others, the rare words
of each text, meet their counts in a shuffle by hash bucket.

The filter's size is known before it is sent (10 bits an insertion). Above ``MAX_FILTER`` bytes
it is sent in rounds: word segments always, pair segments as many as fit; each round scores the
positions whose pair falls into its segments, and the rounds add up.

Defined cases: a null or blank text has one token, the end. Rows with the same id and text get
the same result. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqwright.llm import textnp as T
from seqwright.llm.common import written
from seqwright.llm.suffix_dedup import i64, text_keys

FOLDS, HELD = 7, 2
LOG_BASE = 1.5
BITS, PROBES = 10, 6
MU = 100.0
HEAVY = 1 << 23
MAX_FILTER = 512 << 20
FLUSH = 4_000_000

U = np.uint64
END = U(0x454E44204D41524B)
START = U(0x5354415254204D4B)


def held_out(ids: pa.Array) -> np.ndarray:
    """crc32(id as text) mod 7 == 2; null ids count as the text 'null'."""
    return np.array([zlib.crc32(b"null" if i is None else str(i).encode()) % FOLDS == HELD for i in ids.to_pylist()], bool)


def tokens(data: np.ndarray, offs: np.ndarray):
    """(token hashes with an end for each row, tokens per row, hash of the token before each)."""
    h, counts = T.word_hashes(data, offs)
    total = counts + 1
    last = np.cumsum(total) - 1
    tok = np.empty(len(h) + len(counts), U)
    is_end = np.zeros(len(tok), bool)
    is_end[last] = True
    tok[is_end] = END
    tok[~is_end] = h
    before = np.empty(len(tok), U)
    before[1:] = tok[:-1]
    before[last - counts] = START
    return tok, total, before


def pair_hash(before: np.ndarray, tok: np.ndarray) -> np.ndarray:
    return T.mix(T.mix(before + U(0x9E3779B97F4A7C15)) * U(3) + tok)


def add_up(keys: np.ndarray, n: np.ndarray | None = None):
    """Distinct keys, sorted, and their total counts."""
    if n is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


# ---------------------------------------------------------------- packed counts
PACKED = "kind int, bucket int, keys binary, counts binary"


def packed(kind: int, keys: np.ndarray, n: np.ndarray, shift: int):
    """One row per bucket (top bits of the key). Pairs keep the next 48 bits of their key."""
    bucket = (keys >> U(shift)).astype(np.int64)
    edge = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    out = []
    for lo, hi in zip(edge[:-1], edge[1:]):
        k = keys[lo:hi]
        if kind == 2:
            k = np.ascontiguousarray(((k << U(64 - shift)) >> U(16))).view(np.uint8).reshape(-1, 8)[:, :6]
            c = np.minimum(n[lo:hi], 255).astype(np.uint8)
            big = np.flatnonzero(n[lo:hi] >= 255)  # then 255, and the count behind
            c = c.tobytes() + n[lo:hi][big].astype(np.int64).tobytes()
        else:
            c = n[lo:hi].astype(np.int64).tobytes() if n[lo:hi].max() >= 1 << 32 else n[lo:hi].astype(np.uint32).tobytes()
        out.append((kind, int(bucket[lo]), k.tobytes(), c))
    if out:
        cols = list(zip(*out))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()),
                                          pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())],
                                         names=["kind", "bucket", "keys", "counts"])


def unpacked(kind: int, keys: bytes, counts: bytes):
    if kind == 2:
        raw = np.frombuffer(keys, np.uint8).reshape(-1, 6)
        k = np.zeros((len(raw), 8), np.uint8)
        k[:, :6] = raw
        n = np.frombuffer(counts, np.uint8, len(raw)).astype(np.int64)
        big = np.flatnonzero(n == 255)
        n[big] = np.frombuffer(counts, np.int64, len(big), len(raw))
        return k.view(U).ravel(), n
    k = np.frombuffer(keys, U)
    wide = len(counts) == 8 * len(k)
    return k, np.frombuffer(counts, np.int64 if wide else np.uint32).astype(np.int64)


def count_ngrams(src: DataFrame, shift: int) -> DataFrame:
    def run(batches):
        words, pairs, held = [], [], 0

        def flush():
            for kind, parts in ((1, words), (2, pairs)):
                if parts:
                    k, n = add_up(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                    yield from packed(kind, k, n, shift)

        for b in batches:
            train = ~held_out(b.column(0))
            for lo, hi, data, offs in T.slices(b, 1):
                tok, total, before = tokens(data, offs)
                use = np.repeat(train[lo:hi], total)
                tok, before = tok[use], before[use]
                words.append(add_up(tok))
                pairs.append(add_up(pair_hash(before, tok)))
                held += len(words[-1][0]) + len(pairs[-1][0])
                if held > FLUSH:
                    yield from flush()
                    words, pairs, held = [], [], 0
        yield from flush()

    return src.mapInArrow(run, PACKED)


# ---------------------------------------------------------------- the filter
def levels_of(n: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(n) / math.log(LOG_BASE) + 1e-9).astype(np.int64)


def count_of(level: np.ndarray) -> np.ndarray:
    """The middle of the counts that a level stands for (level 0: 0, level 1: 1)."""
    return np.where(level == 0, 0.0, np.maximum(1.0, (LOG_BASE ** (level - 1.0) + LOG_BASE ** level - 1) / 2))


def _positions(keys: np.ndarray, level, bits: np.ndarray | int):
    a = T.mix(keys ^ (level * np.array(0x9E3779B97F4A7C15, U)))
    b = T.mix(a) | U(1)
    for i in range(PROBES):
        yield a % bits
        a = a + b


def segment(keys: np.ndarray, n: np.ndarray) -> tuple[bytes, int]:
    """Filter bits of one bucket's n-grams, and the number of insertions."""
    top = levels_of(n)
    total = int(top.sum())
    bits = max(64, -(-total * BITS // 64) * 64)
    flags = np.zeros(bits, bool)
    for level in range(1, int(top.max(initial=0)) + 1):
        for p in _positions(keys[top >= level], U(level), U(bits)):
            flags[p.astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").tobytes(), total


SEGMENTS = "kind int, bucket int, n_keys bigint, n_total bigint, bits binary, keys binary, counts binary"


def segments(counts: DataFrame) -> DataFrame:
    """Per kind and bucket: distinct keys, total count, filter bits; for words also the exact table."""

    def run(t: pa.Table) -> pa.Table:
        kind = t.column("kind")[0].as_py()
        parts = [unpacked(kind, k, c) for k, c in zip(t.column("keys").to_pylist(), t.column("counts").to_pylist())]
        k, n = add_up(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        bits, _ = segment(k, n)
        exact = (k.tobytes(), n.tobytes()) if kind == 1 else (None, None)
        return pa.table({"kind": pa.array([kind], pa.int32()), "bucket": pa.array([t.column("bucket")[0].as_py()], pa.int32()),
                         "n_keys": [len(k)], "n_total": [int(n.sum())], "bits": pa.array([bits], pa.binary()),
                         "keys": pa.array([exact[0]], pa.binary()), "counts": pa.array([exact[1]], pa.binary())})

    return counts.groupBy("kind", "bucket").applyInArrow(run, SEGMENTS)


class Filter:
    """Segments of one kind laid end to end; a bucket without one holds nothing."""

    def __init__(self, rows, buckets: int, shift: int):
        self.shift = shift
        self.start, self.size = np.zeros(buckets, np.int64), np.zeros(buckets, U)
        at, parts = 0, []
        for bucket, bits in rows:
            self.start[bucket], self.size[bucket] = at * 8, len(bits) * 8
            parts.append(bits)
            at += len(bits)
        self.bits = np.frombuffer(b"".join(parts) or b"\0", np.uint8)

    def arrays(self):
        """What a broadcast carries: workers need not have this package."""
        return self.shift, self.start, self.size, self.bits

    @classmethod
    def of(cls, arrays):
        f = cls.__new__(cls)
        f.shift, f.start, f.size, f.bits = arrays
        return f

    def counts(self, keys: np.ndarray, kind: int) -> np.ndarray:
        """Counts by repeated membership probes: level 1, 2, ... until a level is missing."""
        bucket = (keys >> U(self.shift)).astype(np.int64)
        start, size = self.start[bucket], self.size[bucket]
        if kind == 2:
            keys = (keys << U(64 - self.shift)) >> U(16)
        level = np.zeros(len(keys), np.int64)
        live = np.flatnonzero(size > 0)
        step = 0
        while len(live):
            step += 1
            ok = live
            a = T.mix(keys[ok] ^ U(step * 0x9E3779B97F4A7C15 % (1 << 64)))
            b = T.mix(a) | U(1)
            for _ in range(PROBES):
                p = start[ok] + (a % size[ok]).astype(np.int64)
                hit = (self.bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
                ok, a, b = ok[hit], a[hit], b[hit]
                a = a + b
            level[ok] = step
            live = ok
        return count_of(level)


# ---------------------------------------------------------------- scoring
SCORED = "text_key bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double"


def scored_round(src: DataFrame, sent, n_train: int, vocab: int, rounds: int, number: int) -> DataFrame:
    """Per row the score of the positions whose pair's bucket is one of this round's; in the first round
    also the frequent words' part of the base score."""
    first = number == 0

    def run(batches):
        words, pairs, keys, counts, n_starts = sent.value
        words, pairs = Filter.of(words), Filter.of(pairs)
        for b in batches:
            held = held_out(b.column(0))
            for lo, hi, data, offs in T.slices(b, 1):
                ids = b.column(0).slice(lo, hi - lo)
                tok, total, before = tokens(data, offs)
                row = np.repeat(np.arange(hi - lo), total)
                uniq, at = np.unique(tok, return_inverse=True)
                cw = words.counts(uniq, 1)
                pw = ((cw + 1) / (n_train + vocab + 1))[at]
                pair = pair_hash(before, tok)
                mine = np.flatnonzero((pair >> U(pairs.shift)) % U(rounds) == U(number))
                up, pat = np.unique(pair[mine], return_inverse=True)
                cvw = pairs.counts(up, 2)[pat]
                # the context's count is that of the token before; the start mark's is the number of texts
                ctx = np.empty(len(tok))
                ctx[1:] = cw[at[:-1]]
                ctx[np.cumsum(total) - total] = n_starts
                ctx = ctx[mine]
                p = (np.minimum(cvw, ctx) + MU * pw[mine]) / (ctx + MU)
                score = np.bincount(row[mine], np.log10(p), hi - lo)
                known, base = np.zeros(hi - lo, np.int64), np.zeros(hi - lo)
                if first and len(keys):
                    i = np.minimum(np.searchsorted(keys, uniq), len(keys) - 1)
                    c = np.where(keys[i] == uniq, counts[i], 0)[at]
                    known = np.bincount(row[c > 0], minlength=hi - lo)
                    base = np.bincount(row, np.log10(c + 1.0), hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [i64(text_keys(data, offs, ids)), ids, pa.array(held[lo:hi]), pa.array(total.astype(np.int64)),
                     pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)],
                    names=["text_key", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"])

    return src.mapInArrow(run, SCORED)


def rare_words(src: DataFrame, heavy, shift: int) -> DataFrame:
    """Occurrences of words that are not frequent, packed by bucket: (bucket, texts, keys)."""

    def run(batches):
        keys = heavy.value[2]
        held, n = [], 0

        def flush():
            if held:
                k, t = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
                bucket = (k >> U(shift)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                k, t, bucket = k[order], t[order], bucket[order]
                edge = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
                if len(edge) > 1:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(bucket[edge[:-1]].astype(np.int32)),
                         pa.array([t[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])], pa.binary()),
                         pa.array([k[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])], pa.binary())],
                        names=["bucket", "texts", "keys"])

        for b in batches:
            for lo, hi, data, offs in T.slices(b, 1):
                text = text_keys(data, offs, b.column(0).slice(lo, hi - lo))
                tok, total, _ = tokens(data, offs)
                uniq, at = np.unique(tok, return_inverse=True)
                rare = np.ones(len(uniq), bool)
                if len(keys):
                    rare = keys[np.minimum(np.searchsorted(keys, uniq), len(keys) - 1)] != uniq
                use = rare[at]
                held.append((tok[use], np.repeat(text, total)[use]))
                n += int(use.sum())
                if n > FLUSH:
                    yield from flush()
                    held, n = [], 0
        yield from flush()

    return src.mapInArrow(run, "bucket int, texts binary, keys binary")


def rare_scores(rare: DataFrame, exact: DataFrame) -> DataFrame:
    """(text_key, known, base): what a bucket's words add to each text."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"text_key": pa.array([], pa.int64()), "known": pa.array([], pa.int64()), "base": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        vk = np.concatenate([np.frombuffer(x, U) for x in right.column("keys").to_pylist()])
        vn = np.concatenate([np.frombuffer(x, np.int64) for x in right.column("counts").to_pylist()])
        k = np.concatenate([np.frombuffer(x, U) for x in left.column("keys").to_pylist()])
        t = np.concatenate([np.frombuffer(x, U) for x in left.column("texts").to_pylist()])
        i = np.minimum(np.searchsorted(vk, k), len(vk) - 1)
        c = np.where(vk[i] == k, vn[i], 0)
        t, c = t[c > 0], c[c > 0]
        uniq, at = np.unique(t, return_inverse=True)
        if not len(uniq):
            return empty
        return pa.table({"text_key": i64(uniq), "known": pa.array(np.bincount(at).astype(np.int64)),
                         "base": pa.array(np.bincount(at, np.log10(c + 1.0)))})

    got = rare.groupBy("bucket").cogroup(exact.groupBy("bucket")).applyInArrow(
        run, "text_key bigint, known bigint, base double")
    return got.groupBy("text_key").agg(F.sum("known").alias("known"), F.sum("base").alias("rare_base"))


def score(df: DataFrame, id_col: str = "doc_id", text: str = "text", *, max_filter: int = MAX_FILTER) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = df.sparkSession
    src = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    # buckets follow the input's size (its scan partitions), between 64 and 16,384
    buckets = 1 << min(14, max(6, int(src.rdd.getNumPartitions()).bit_length()))
    shift = 64 - (buckets.bit_length() - 1)
    table = written(segments(count_ngrams(src, shift)), "lm-segments")
    size = {r[0]: r[1:] for r in table.groupBy("kind").agg(F.sum("n_keys"), F.sum("n_total"), F.sum(F.octet_length("bits"))).collect()}
    vocab, n_train, word_bytes = size.get(1, (0, 0, 0))
    pair_bytes = size.get(2, (0, 0, 0))[2]
    floor = max(1, math.ceil(n_train / HEAVY))

    def heavy(t):
        for b in t:
            for keys, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                k, n = np.frombuffer(keys, U), np.frombuffer(counts, np.int64)
                top = (n >= floor) | (k == END)
                yield pa.RecordBatch.from_arrays([i64(k[top]), pa.array(n[top])], names=["k", "n"])

    top = table.where("kind = 1").select("keys", "counts").mapInArrow(heavy, "k bigint, n bigint").toArrow()
    hk, hn = top.column(0).to_numpy().view(U), top.column(1).to_numpy()
    order = np.argsort(hk)
    hk, hn = hk[order], hn[order]
    # a start mark begins every training text, an end closes it: the count of END
    n_starts = float(hn[hk == END].sum())
    if word_bytes > max_filter:
        raise ValueError(f"the words' filter has {word_bytes} bytes, over max_filter; raise it with the workers' memory")
    rounds = max(1, math.ceil(pair_bytes / max(1, max_filter - word_bytes)))
    words = Filter([(r[0], bytes(r[1])) for r in table.where("kind = 1").select("bucket", "bits").toLocalIterator()], buckets, shift)
    out, sent = None, None
    for i in range(rounds):
        rows = table.where((F.col("kind") == 2) & (F.col("bucket") % rounds == i)).select("bucket", "bits")
        pairs = Filter([(r[0], bytes(r[1])) for r in rows.toLocalIterator()], buckets, shift)
        now = spark.sparkContext.broadcast((words.arrays(), pairs.arrays(), hk, hn, n_starts))
        part = scored_round(src, now, n_train, vocab, rounds, i)
        part = written(part, "lm-round")  # scored once, and one round's filter at a time
        out = part if out is None else out.unionByName(part)
        sent = sent or now
    small = spark.sparkContext.broadcast((None, None, hk))
    rare = rare_scores(rare_words(src, small, shift), table.where("kind = 1").select("bucket", "keys", "counts"))
    if rounds > 1:
        out = out.groupBy("text_key", "doc_id", "held_out", "n_tokens").agg(
            F.sum("n_known").alias("n_known"), F.sum("base").alias("base"), F.sum("score").alias("score"),
            (F.count(F.lit(1)) / rounds).cast("int").alias("copies"))
        out = out.withColumn("n_known", (F.col("n_known") / F.col("copies")).cast("bigint")) \
            .withColumn("base", F.col("base") / F.col("copies")).withColumn("score", F.col("score") / F.col("copies")) \
            .withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "copy")
    # rows that share id and text send their rare words several times: divide by their number
    out = out.join(rare, "text_key", "left")
    copies = out.groupBy("text_key").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    out = out.join(copies, "text_key", "left")
    c = F.coalesce("copies", F.lit(1))
    scale = F.lit(math.log10(n_train + vocab + 1))
    return out.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0)) / c).cast("bigint").alias("n_known"),
        F.lit(n_train).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) / c - F.col("n_tokens") * scale).alias("base_score"), "score")
