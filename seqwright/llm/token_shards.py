"""Training-order materialisation: token sequences in a permuted order, as fixed-stride shards.

Texts are tokenised with a byte-level BPE vocabulary (a file named by a parameter), an end id
follows each text, and the ids are cut into sequences of ``SEQ_LEN`` (the last one is filled up
with end ids). Sequences are numbered 0..N-1 in input order. A keyed Feistel network over the
next even power of two, walked until the value is below N, permutes the numbers: the result is
the sequence's global slot, and slot // per_shard its shard. Neither a sort nor a table of the
permutation is needed, and any slot can be computed, or inverted, on its own.

Records go to the task that owns their shard (a partition id computed from the slot, an exact
range partition), are put in slot order there and written by Spark's own writer, so commits and
retries are Spark's. A record is SEQ_LEN little-endian 16-bit ids and one byte 0x0A; all
have the same length, and the record of slot s starts at (s % per_shard) * stride of shard
s // per_shard. A reader can start at any slot and read on; a job that stops resumes there.

Numbers need the count of sequences before each input partition. A first pass counts them with
a checksum of the partition's texts; the second pass compares the checksum before it uses them.

Defined cases: a null text has no ids and one sequence (its end id). Rows that repeat are
sequences of their own. Extra columns are ignored; an empty table writes no shard.
"""

from __future__ import annotations

import binascii
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqwright.llm import textnp as T
from seqwright.llm.common import shared_path, written

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
END_ID = 50256
SEQ_LEN = 512
SHARD_BYTES = 16 << 20
SEED = 20
ROUNDS = 6
STRIDE = 2 * SEQ_LEN + 1
CACHE_BYTES = 32 << 20   # of encoded pieces a worker keeps
FLUSH_BYTES = 4 << 20   # of records a task holds before it sends them
SLICE_BYTES = 256 << 10  # of text encoded at a time

# Fixed value: the split pattern that the vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

U = np.uint64


class Encoder:
    """Ids of texts by their pieces. The pattern never joins a space with what stands before it, so a
    text without double spaces is the sum of its pieces, each from one space up to the next. Every
    distinct piece a task meets is encoded once; its ids stay in one array, found by a hash table
    (open addressing) of 64-bit piece hashes. Beyond ``CACHE_BYTES`` the less used half of the pieces goes."""

    def __init__(self, vocabulary: bytes):
        import tiktoken

        words = vocabulary.split()
        ranks = dict(zip(map(binascii.a2b_base64, words[::2]), map(int, words[1::2])))
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.length = np.zeros(END_ID + 1, np.int64)  # bytes of each id
        self.length[list(ranks.values())] = list(map(len, ranks))
        self.n = 0  # pieces held: the first entries of the next four
        self.keys, self.uses = np.zeros(1 << 12, U), np.zeros(1 << 12, np.int64)
        self.at, self.size = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)
        self.ids, self.used = np.zeros(1 << 16, "<u2"), 0
        self.table = np.full(1 << 13, -1, np.int32)  # the number of a piece, at its hash or the next free entry after it

    def held_bytes(self) -> int:
        return sum(x.nbytes for x in (self.keys, self.at, self.size, self.uses, self.ids, self.table))

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each piece, -1 for one that is not held."""
        mask = len(self.table) - 1
        slot = (keys & U(mask)).astype(np.int64)
        out = self.table[slot]
        far = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(far):
            slot[far] = (slot[far] + 1) & mask
            out[far] = self.table[slot[far]]
            far = far[(out[far] >= 0) & (self.keys[out[far]] != keys[far])]
        return out

    def _enter(self, number: np.ndarray) -> None:
        """Enters pieces into the table; those that want one entry go on to the next, all but one."""
        mask = len(self.table) - 1
        slot = (self.keys[number] & U(mask)).astype(np.int64)
        while len(number):
            free = self.table[slot] < 0
            self.table[slot[free]] = number[free]
            left = self.table[slot] != number
            number, slot = number[left], (slot[left] + 1) & mask

    def _shrink(self) -> None:
        """Drops pieces, least used first, until half of the bytes are left; uses count half from here on."""
        order = np.argsort(-self.uses[:self.n], kind="stable")
        each = 40 + 2 * self.size[order].astype(np.int64)  # up to four table entries a piece
        keep = np.sort(order[:int(np.searchsorted(np.cumsum(each), CACHE_BYTES // 2))])
        size = self.size[keep].astype(np.int64)
        at = np.cumsum(size) - size
        ids = self.ids[np.repeat(self.at[keep] - at, size) + np.arange(int(size.sum()))]
        self.keys, self.at, self.size, self.uses = self.keys[keep], at.astype(np.int32), size.astype(np.int32), self.uses[keep] // 2
        self.ids, self.used, self.n = ids, len(ids), len(keep)
        self.table = np.full(1 << max(13, (2 * self.n).bit_length()), -1, np.int32)
        self._enter(np.arange(self.n, dtype=np.int32))

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        """Adds new keys. Pieces that start with a space are encoded in one call: no id reaches
        over a space, so the ids' byte lengths tell where each piece ends."""
        led = np.array([p[:1] == b" " for p in pieces], bool)
        size = np.zeros(len(pieces), np.int64)
        at = np.zeros(len(pieces), np.int64)
        one = [p for p, x in zip(pieces, led.tolist()) if x]
        parts = [np.array(self.encode(b"".join(one).decode()), "<u2")]
        cut = np.searchsorted(np.cumsum(self.length[parts[0]]), np.cumsum(list(map(len, one))), "right")
        size[led] = np.diff(cut, prepend=0)
        at[led] = cut - size[led]
        n = len(parts[0])
        for i in np.flatnonzero(~led).tolist():
            parts.append(np.array(self.encode(pieces[i].decode()), "<u2"))
            at[i], size[i] = n, len(parts[-1])
            n += len(parts[-1])
        if self.used + n > len(self.ids):
            self.ids = np.concatenate([self.ids[:self.used], np.zeros(n + (self.used + n) // 4, "<u2")])
        self.ids[self.used:self.used + n] = np.concatenate(parts)
        self.used += n
        m = self.n + len(keys)
        if m > len(self.keys):
            for name in ("keys", "at", "size", "uses"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old[:self.n], np.zeros(m + m // 4 - self.n, old.dtype)]))
        mine = np.arange(self.n, m, dtype=np.int32)
        self.keys[mine], self.at[mine], self.size[mine], self.uses[mine] = keys, at + self.used - n, size, 0
        self.n = m
        if 2 * m > len(self.table):
            self.table = np.full(1 << (2 * m).bit_length(), -1, np.int32)
            mine = np.arange(m, dtype=np.int32)
        self._enter(mine)

    def slice(self, data: np.ndarray, offs: np.ndarray, only_counts: bool = False):
        """(ids of all rows one after another, number of ids per row); no ids with ``only_counts``."""
        n = len(offs) - 1
        space = data == 32
        start = space.copy()
        start[offs[:-1][offs[:-1] < len(data)]] = True
        start = np.flatnonzero(start)
        end = np.append(start[1:], len(data))
        row_piece = np.searchsorted(start, offs)
        keys = T.span_hash(T.prefix_hash(data), start, end)
        if self.held_bytes() > CACHE_BYTES:
            self._shrink()
        i = self._find(keys)
        raw = data.tobytes()
        new = np.flatnonzero(i < 0)
        if len(new):
            learnt, first = np.unique(keys[new], return_index=True)
            f = new[first]
            self._learn(learnt, [raw[x:y] for x, y in zip(start[f].tolist(), end[f].tolist())])
            i[new] = self._find(keys[new])
        np.add.at(self.uses, i, 1)
        each = self.size[i].astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(each)])
        counts = upto[row_piece[1:]] - upto[row_piece[:-1]]
        # rows with double spaces are encoded whole
        both = np.flatnonzero(space[:-1] & space[1:])
        twice = np.unique(np.searchsorted(offs, both, "right") - 1).tolist()
        whole = {r: np.array(self.encode(raw[offs[r]:offs[r + 1]].decode()), "<u2") for r in twice}
        ids = None
        if not only_counts:
            at = self.at[i] - upto[:-1]
            ids = self.ids[np.repeat(at, each) + np.arange(upto[-1])]
            if whole:
                parts = np.split(ids, upto[row_piece[1:-1]])
                ids = np.concatenate([whole.get(r, x) for r, x in enumerate(parts)])
        if whole:
            counts = counts.copy()
            for r, x in whole.items():
                counts[r] = len(x)
        return ids, counts


# ---------------------------------------------------------------- the permutation
def _round(half: np.ndarray, key: int, r: int, mask: U) -> np.ndarray:
    return T.mix(half + U((key * 0x9E3779B97F4A7C15 + r * 0xC2B2AE3D27D4EB4F) % (1 << 64))) & mask


def _feistel(x: np.ndarray, bits: int, key: int, back: bool) -> np.ndarray:
    mask = U((1 << bits) - 1)
    a, b = x >> U(bits), x & mask
    for r in (range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)):
        if back:
            a, b = b ^ _round(a, key, r, mask), a
        else:
            a, b = b, a ^ _round(b, key, r, mask)
    return a << U(bits) | b


def permute(x: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """A keyed permutation of 0..n-1 (its inverse with ``back``); values at or above n walk on."""
    bits = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    out = _feistel(np.asarray(x, U), bits, key, back)
    while True:
        far = np.flatnonzero(out >= U(n))
        if not len(far):
            return out
        out[far] = _feistel(out[far], bits, key, back)


# ---------------------------------------------------------------- passes
class Checksum:
    """Of the texts of a partition in order, however they come in slices."""

    def __init__(self):
        self.text = self.size = 0

    def add(self, data: np.ndarray, offs: np.ndarray) -> int:
        self.text = zlib.crc32(data, self.text)
        self.size = zlib.crc32(np.diff(offs).astype(np.int64), self.size)
        return self.text << 31 ^ self.size


def count_sequences(src: DataFrame, vocabulary) -> DataFrame:
    """(split, ord, doc_id, n_tokens, n_seqs, crc): crc is of all texts of the split up to this slice."""

    def run(batches):
        enc, split, ord_, sums = Encoder(vocabulary.value), TaskContext.get().partitionId(), 0, Checksum()
        for b in batches:
            for lo, hi, data, offs in T.slices(b, 1, SLICE_BYTES):
                crc = sums.add(data, offs)
                n = enc.slice(data, offs, only_counts=True)[1] + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), split, np.int32)), pa.array(np.arange(ord_, ord_ + len(n))), b.column(0).slice(lo, hi - lo),
                     pa.array(n), pa.array(-(-n // SEQ_LEN)), pa.array(np.full(len(n), crc, np.int64))],
                    names=["split", "ord", "doc_id", "n_tokens", "n_seqs", "crc"])
                ord_ += len(n)

    return src.mapInArrow(run, "split int, ord bigint, doc_id bigint, n_tokens bigint, n_seqs bigint, crc bigint")


def sequences(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(sequences, SEQ_LEN): every row's ids, its end id and end ids to fill its last sequence."""
    seqs = -(-(counts + 1) // SEQ_LEN)
    out = np.full(int(seqs.sum()) * SEQ_LEN, END_ID, "<u2")
    at = (np.cumsum(seqs) - seqs) * SEQ_LEN
    out[np.arange(len(ids)) + np.repeat(at - (np.cumsum(counts) - counts), counts)] = ids
    return out.reshape(-1, SEQ_LEN)


def deal(src: DataFrame, vocabulary, starts, n: int, per_shard: int, key: int) -> DataFrame:
    """(shard, slots, records): a task's records of one shard in one row, compressed."""

    def run(batches):
        enc, split = Encoder(vocabulary.value), TaskContext.get().partitionId()
        at, expected = starts.value.get(split, (0, 0))
        sums, crc, held, size = Checksum(), 0, [], 0

        def packed(first: int):
            raw = np.concatenate(held)
            slots = permute(np.arange(first, first + len(raw)), n, key).astype(np.int64)
            shard = slots // per_shard
            order = np.argsort(slots)
            cut = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1))
            pack = zstandard.ZstdCompressor(level=1)
            for lo, hi in zip(cut[:-1], cut[1:]):
                i = order[lo:hi]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(shard[i[0]])], pa.int32()), pa.array([slots[i].tobytes()], pa.binary()),
                     pa.array([pack.compress(raw[i].tobytes())], pa.binary())], names=["shard", "slots", "records"])

        for b in batches:
            for _, _, data, offs in T.slices(b, 1, SLICE_BYTES):
                crc = sums.add(data, offs)
                held.append(sequences(*enc.slice(data, offs)))
                size += len(held[-1])
                if size * 2 * SEQ_LEN > FLUSH_BYTES:
                    yield from packed(at)
                    at, held, size = at + size, [], 0
        if size:
            yield from packed(at)
        if crc != expected:
            raise RuntimeError(f"input partition {split} changed between the passes")

    return src.mapInArrow(run, "shard int, slots binary, records binary")


def in_order(dealt: DataFrame, shards: int) -> DataFrame:
    """Each shard's records in slot order, as the raw bytes of one string column."""

    def run(batches):
        rows = [(a, s, r) for b in batches for a, s, r in zip(*(c.to_pylist() for c in b.columns))]
        unpack = zstandard.ZstdDecompressor()
        for shard in sorted({r[0] for r in rows}):
            mine = [r for r in rows if r[0] == shard]
            slots = np.concatenate([np.frombuffer(s, np.int64) for _, s, _ in mine])
            recs = np.concatenate([np.frombuffer(unpack.decompress(r), "<u2").reshape(-1, SEQ_LEN) for *_, r in mine])
            order = np.argsort(slots)
            flat = np.ascontiguousarray(recs[order]).view(np.uint8)
            for s in range(0, len(flat), 4096):
                part = flat[s:s + 4096]
                fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * SEQ_LEN), len(part), [None, pa.py_buffer(part.tobytes())])
                yield pa.RecordBatch.from_arrays([fixed.cast(pa.binary())], names=["record"])

    one = dealt.repartitionById(shards, F.col("shard")) if shards > 1 else dealt.repartition(1)
    return one.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))


def write_shards(df: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", *, vocabulary: str = VOCABULARY,
                 shard_bytes: int = SHARD_BYTES, seed: int = SEED) -> tuple[DataFrame, int, int]:
    """Writes the shards below ``path``. Returns (index, N, records per shard); the index has
    doc_id, part, slot, shard, record, n_tokens of every sequence."""
    spark = df.sparkSession
    with open(vocabulary, "rb") as f:  # the tokenizer's file is on the driver; tasks get its bytes
        vocab = spark.sparkContext.broadcast(f.read())
    src = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    counts = written(count_sequences(src, vocab), "sequence-counts")
    per = counts.groupBy("split").agg(F.sum("n_seqs").alias("n"), F.max_by("crc", "ord").alias("crc")).orderBy("split").collect()
    starts, n = {}, 0  # one entry per input partition
    for r in per:
        starts[r["split"]] = (n, r["crc"])
        n += r["n"]
    per_shard = max(1, shard_bytes // STRIDE)
    if n:
        shards = -(-n // per_shard)
        dealt = deal(src, vocab, spark.sparkContext.broadcast(starts), n, per_shard, seed)
        in_order(dealt, shards).write.text(path)
    first = spark.createDataFrame([(k, v[0]) for k, v in starts.items()], "split int, first bigint")
    index = counts.join(F.broadcast(first), "split")
    from pyspark.sql import Window

    upto = F.coalesce(F.sum("n_seqs").over(Window.partitionBy("split").orderBy("ord").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    index = index.withColumn("first", F.col("first") + upto)

    def slots(batches):
        for b in batches:
            d, tok, m, f = (b.column(i) for i in range(4))
            m = m.to_numpy()
            row = np.repeat(np.arange(len(m)), m)
            part = np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)
            slot = permute(f.to_numpy()[row] + part, n, seed).astype(np.int64) if len(row) else np.zeros(0, np.int64)
            left = tok.to_numpy()[row] - part * SEQ_LEN
            yield pa.RecordBatch.from_arrays(
                [d.take(pa.array(row)), pa.array(part), pa.array(slot), pa.array((slot // per_shard).astype(np.int32)),
                 pa.array(slot % per_shard), pa.array(np.minimum(left, SEQ_LEN))],
                names=["doc_id", "part", "slot", "shard", "record", "n_tokens"])

    index = index.select("doc_id", "n_tokens", "n_seqs", "first").mapInArrow(
        slots, "doc_id bigint, part bigint, slot bigint, shard int, record bigint, n_tokens bigint")
    return index, n, per_shard


def read_shards(spark: SparkSession, path: str, per_shard: int, from_slot: int = 0) -> DataFrame:
    """(slot, ids) of the written records from a slot on, one task per shard file; shards before it
    are not opened."""
    files = spark.read.format("binaryFile").load(path)
    shard = F.regexp_extract("path", "part-([0-9]+)", 1).cast("int")
    files = files.withColumn("shard", shard).where(F.col("shard") >= from_slot // per_shard).select("shard", "content")

    def run(batches):
        for b in batches:
            for shard, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                recs = np.frombuffer(raw, np.uint8).reshape(-1, STRIDE)
                for s in range(0, len(recs), 4096):
                    part = np.ascontiguousarray(recs[s:s + 4096, :-1])
                    slot = shard * per_shard + np.arange(s, s + len(part))
                    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * SEQ_LEN), len(part), [None, pa.py_buffer(part.tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(slot), fixed.cast(pa.binary())], names=["slot", "ids"])

    return files.mapInArrow(run, "slot bigint, ids binary").where(F.col("slot") >= from_slot)


def materialised(df: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Shards written below the shared folder, then per sequence: doc_id, part, slot, shard, record,
    n_tokens, and sha256 of the ids as read back from the shard."""
    spark = df.sparkSession
    path = shared_path(spark, "token-shards")
    index, n, per_shard = write_shards(df, path, id_col, text, **options)
    if not n:
        return index.withColumn("sha256", F.lit(None).cast("string"))
    digest = read_shards(spark, path, per_shard).select(F.col("slot").alias("_slot"), F.sha2("ids", 256).alias("sha256"))
    return index.join(digest, F.col("slot") == F.col("_slot")).drop("_slot")


