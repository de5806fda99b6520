"""TFRecord files of ``tf.train.Example`` records as a Spark data source.

Registered as the Python data source ``tfrecord``. Reading cuts files into splits of ``splitBytes``: a split finds
its first record by the checksum that every record's length carries (and confirms it by the data's), so a large
file is read by many tasks and needs no index. Writing encodes whole Arrow columns and produces one part file per
task; the commit publishes the write's files by renaming one manifest, which readers follow, so an overwrite shows
the old files or the new ones, never a mixture. Paths are file-system paths that every executor can open (a shared
mount on a cluster); other schemes can be read, one task per file, through Spark's own file reader.

Public formats implemented here:

* record framing: ``uint64 length | uint32 masked_crc(length) | data | uint32 masked_crc(data)``,
  little endian, CRC-32C (Castagnoli), ``masked = ((crc >> 15 | crc << 17) + 0xa282ead8) mod 2^32``;
* ``Example``: field 1 ``Features``; ``Features``: field 1 map<string, Feature>;
  ``Feature``: oneof 1 ``BytesList``, 2 ``FloatList``, 3 ``Int64List`` (each: field 1,
  repeated, numbers packed).

Array columns of float/double become FloatList, integer arrays and integers become
Int64List, strings BytesList. A feature missing from a record reads as an empty
list (NULL for a scalar column).
"""

from __future__ import annotations

import glob
import json
import os
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType, StringType, StructType

# ---------------------------------------------------------------- CRC-32C and framing


def _crc_tables():
    poly = 0x82F63B78  # CRC-32C, reflected
    t0 = []
    for i in range(256):
        c = i
        for _ in range(8):
            c = (c >> 1) ^ poly if c & 1 else c >> 1
        t0.append(c)
    tables = [t0]
    for _ in range(7):
        prev = tables[-1]
        tables.append([t0[c & 0xFF] ^ (c >> 8) for c in prev])
    return tables


_TABLES = _crc_tables()
_TABLE = _TABLES[0]
_NP_TABLES = [np.array(t, dtype=np.uint32) for t in _TABLES]


def crc32c(data: bytes) -> int:
    c = 0xFFFFFFFF
    t = _TABLE
    for b in data:
        c = t[(c ^ b) & 0xFF] ^ (c >> 8)
    return c ^ 0xFFFFFFFF


def crc32c_many(chunks: list[bytes]) -> np.ndarray:
    """CRC-32C of many byte strings at once: one state per string in a numpy array, advanced
    eight bytes per step (slicing-by-8) for every string still that long, then the tails."""
    R = len(chunks)
    if R == 0:
        return np.zeros(0, dtype=np.uint32)
    lens = np.fromiter((len(x) for x in chunks), dtype=np.int64, count=R)
    order = np.argsort(-lens, kind="stable")
    ls = lens[order]
    width = int((ls[0] + 7) // 8 * 8)
    buf = np.zeros((R, max(width, 8)), dtype=np.uint8)
    for j, i in enumerate(order):
        x = chunks[i]
        buf[j, :len(x)] = np.frombuffer(x, np.uint8)
    words = buf.view("<u4")
    c = np.full(R, 0xFFFFFFFF, dtype=np.uint32)
    t0, t1, t2, t3, t4, t5, t6, t7 = _NP_TABLES
    neg = -ls
    for w in range(width // 8):
        k = int(np.searchsorted(neg, -(8 * w + 8), side="right"))   # strings with >= 8w+8 bytes
        if k == 0:
            break
        a = words[:k, 2 * w] ^ c[:k]
        b = words[:k, 2 * w + 1]
        c[:k] = (t7[a & 0xFF] ^ t6[(a >> 8) & 0xFF] ^ t5[(a >> 16) & 0xFF] ^ t4[a >> 24]
                 ^ t3[b & 0xFF] ^ t2[(b >> 8) & 0xFF] ^ t1[(b >> 16) & 0xFF] ^ t0[b >> 24])
    start = (ls // 8) * 8
    for i in range(int((ls - start).max())):
        idx = np.flatnonzero(start + i < ls)
        cc = c[idx]
        c[idx] = t0[(cc ^ buf[idx, start[idx] + i]) & 0xFF] ^ (cc >> 8)
    out = np.empty(R, dtype=np.uint32)
    out[order] = c ^ np.uint32(0xFFFFFFFF)
    return out


def _mask(c):
    c = np.asarray(c, dtype=np.uint64)
    return ((((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF).astype(np.uint32)


def masked_crc(data: bytes) -> int:
    return int(_mask(crc32c(data)))


def frame(record: bytes) -> bytes:
    n = struct.pack("<Q", len(record))
    return n + struct.pack("<I", masked_crc(n)) + record + struct.pack("<I", masked_crc(record))


def crc32c_ragged(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """CRC-32C of the byte strings data[off[i]:off[i + 1]], eight bytes of every string a step, where they lie."""
    size = np.diff(off)
    order = np.argsort(-size, kind="stable")
    at, left = off[:-1][order], size[order]
    c = np.full(len(size), 0xFFFFFFFF, np.uint32)
    t0, t1, t2, t3, t4, t5, t6, t7 = _NP_TABLES
    neg = -left
    words = int(left[0] // 8) if len(left) else 0
    for w in range(words):
        k = int(np.searchsorted(neg, -(8 * w + 8), side="right"))   # strings with that many bytes
        s = at[:k] + 8 * w
        x = c[:k]
        c[:k] = (t7[data[s] ^ (x & 0xFF)] ^ t6[data[s + 1] ^ ((x >> 8) & 0xFF)] ^ t5[data[s + 2] ^ ((x >> 16) & 0xFF)]
                 ^ t4[data[s + 3] ^ (x >> 24)] ^ t3[data[s + 4]] ^ t2[data[s + 5]] ^ t1[data[s + 6]] ^ t0[data[s + 7]])
    done = left // 8 * 8
    for i in range(7):
        rest = np.flatnonzero(done + i < left)
        x = c[rest]
        c[rest] = t0[(x ^ data[at[rest] + done[rest] + i]) & 0xFF] ^ (x >> 8)
    out = np.empty(len(size), np.uint32)
    out[order] = c ^ np.uint32(0xFFFFFFFF)
    return out


def frame_many(records: list[bytes]) -> bytes:
    """Frame a batch of records; their checksums are computed together."""
    heads = [struct.pack("<Q", len(r)) for r in records]
    mh = _mask(crc32c_many(heads))
    md = _mask(crc32c_many(records))
    return b"".join(h + struct.pack("<I", int(a)) + r + struct.pack("<I", int(b))
                    for h, a, r, b in zip(heads, mh, records, md))


SYNC = 1 << 16


def _sync(f, start: int, end: int, size: int) -> int | None:
    """Where the first record at or after ``start`` begins, None if none does before ``end``: the first place whose
    eight length bytes have the checksum behind them, and whose data have theirs."""
    t0, t1, t2, t3, t4, t5, t6, t7 = _NP_TABLES
    while start < end:
        f.seek(start)
        b = np.frombuffer(f.read(SYNC + 11), np.uint8)
        n = min(len(b) - 11, end - start)
        if n <= 0:
            return None
        at = [b[i:i + n] for i in range(12)]
        c = (t7[at[0] ^ np.uint8(0xFF)] ^ t6[at[1] ^ np.uint8(0xFF)] ^ t5[at[2] ^ np.uint8(0xFF)] ^ t4[at[3] ^ np.uint8(0xFF)]
             ^ t3[at[4]] ^ t2[at[5]] ^ t1[at[6]] ^ t0[at[7]]) ^ np.uint32(0xFFFFFFFF)
        there = sum(at[8 + i].astype(np.uint32) << np.uint32(8 * i) for i in range(4))
        for i in np.flatnonzero(_mask(c) == there).tolist():
            length = struct.unpack("<Q", b[i:i + 8].tobytes())[0]
            if start + i + 16 + length > size:
                continue
            f.seek(start + i + 12)
            data = f.read(length)
            if masked_crc_fast(data) == struct.unpack("<I", f.read(4))[0]:
                return start + i
        start += n
    return None


def masked_crc_fast(data: bytes) -> int:
    return int(_mask(crc32c_ragged(np.frombuffer(data, np.uint8), np.array([0, len(data)])))[0])


def _read_framed(path: str, start: int = 0, end: int | None = None):
    """Yield (length bytes, length crc, data, data crc) of each record that begins in [start, end)."""
    size = os.path.getsize(path)
    end = size if end is None else end
    with open(path, "rb") as f:
        if start:
            start = _sync(f, start, end, size)
            if start is None:
                return
            f.seek(start)
        while f.tell() < end:
            head = f.read(12)
            if not head:
                return
            if len(head) < 12:
                raise ValueError(f"{path}: truncated record header")
            n = struct.unpack("<Q", head[:8])[0]
            data = f.read(n)
            tail = f.read(4)
            if len(data) < n or len(tail) < 4:
                raise ValueError(f"{path}: truncated record")
            yield head[:8], struct.unpack("<I", head[8:])[0], data, struct.unpack("<I", tail)[0]


def read_records(path: str, check: bool = True, batch: int = 1024, start: int = 0, end: int | None = None):
    """The records of one file (that begin in [start, end)); checksums are verified a batch of records at a time."""
    pending = []

    def verify(items):
        if check:
            ok_h = _mask(crc32c_many([x[0] for x in items])) == np.array([x[1] for x in items], dtype=np.uint32)
            ok_d = _mask(crc32c_many([x[2] for x in items])) == np.array([x[3] for x in items], dtype=np.uint32)
            if not ok_h.all():
                raise ValueError(f"{path}: bad length checksum")
            if not ok_d.all():
                raise ValueError(f"{path}: bad data checksum")
        return [x[2] for x in items]

    for rec in _read_framed(path, start, end):
        pending.append(rec)
        if len(pending) >= batch:
            yield from verify(pending)
            pending = []
    if pending:
        yield from verify(pending)

# ---------------------------------------------------------------- protobuf (the three messages used)


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while True:
        b = n & 0x7F
        n >>= 7
        if n:
            out.append(b | 0x80)
        else:
            out.append(b)
            return bytes(out)


def _read_varint(buf: bytes, i: int):
    shift = result = 0
    while True:
        b = buf[i]
        i += 1
        result |= (b & 0x7F) << shift
        if not b & 0x80:
            return result, i
        shift += 7


def _field(num: int, payload: bytes) -> bytes:
    return _varint((num << 3) | 2) + _varint(len(payload)) + payload


def encode_example(features: dict) -> bytes:
    """``features``: name -> ('float', floats) | ('int64', ints) | ('bytes', [bytes])."""
    entries = b""
    for name, (kind, values) in features.items():
        if kind == "float":
            lst = _field(1, np.asarray(values, dtype="<f4").tobytes()) if len(values) else b""
            feat = _field(2, lst)
        elif kind == "int64":
            lst = _field(1, b"".join(_varint(int(v)) for v in values)) if len(values) else b""
            feat = _field(3, lst)
        else:
            feat = _field(1, b"".join(_field(1, v) for v in values))
        entries += _field(1, _field(1, name.encode()) + _field(2, feat))
    return _field(1, entries)


class Ragged:
    """Byte strings one after another: bytes and offsets."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off = data, off

    @property
    def size(self) -> np.ndarray:
        return np.diff(self.off)

    @classmethod
    def same(cls, value: bytes, n: int) -> Ragged:
        return cls(np.tile(np.frombuffer(value, np.uint8), n), np.arange(n + 1) * len(value))

    @classmethod
    def varints(cls, values: np.ndarray) -> Ragged:
        v = np.asarray(values).astype(np.int64).view(np.uint64)
        size = np.ones(len(v), np.int64)
        for k in range(1, 10):
            size += v >= np.uint64(1 << 7 * k)
        shift = np.arange(10, dtype=np.uint64) * np.uint64(7)
        grid = ((v[:, None] >> shift) & np.uint64(0x7F)).astype(np.uint8)
        k = np.arange(10)
        grid |= np.where(k < size[:, None] - 1, np.uint8(0x80), np.uint8(0))
        return cls(grid[k < size[:, None]], np.concatenate([[0], np.cumsum(size)]))

    @classmethod
    def fixed(cls, values: np.ndarray) -> Ragged:
        """The little-endian bytes of an array of numbers, one string a number."""
        width = values.dtype.itemsize
        return cls(np.ascontiguousarray(values).view(np.uint8).ravel(), np.arange(len(values) + 1) * width)

    @classmethod
    def joined(cls, *parts: Ragged) -> Ragged:
        """The parts' strings put together, row by row."""
        size = sum(p.size for p in parts)
        off = np.concatenate([[0], np.cumsum(size)])
        out = np.empty(int(off[-1]), np.uint8)
        to = off[:-1].copy()
        for p in parts:
            out[np.repeat(to - p.off[:-1], p.size) + np.arange(p.off[0], p.off[-1])] = p.data[p.off[0]:p.off[-1]]
            to += p.size
        return cls(out, off)

    def grouped(self, off: np.ndarray) -> Ragged:
        """Runs of strings as one each: ``off`` counts strings."""
        return Ragged(self.data, self.off[off])

    def field(self, number: int) -> Ragged:
        """Each string as a length-delimited protobuf field."""
        n = len(self.off) - 1
        return Ragged.joined(Ragged.same(bytes([number << 3 | 2]), n), Ragged.varints(self.size), self)


def _lists(col: pa.Array):
    """(values, offsets) of a list column, or of a scalar column as lists of one; nulls are empty lists."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_list(col.type) or pa.types.is_large_list(col.type):
        size = np.asarray(col.value_lengths().fill_null(0)).astype(np.int64)
        return col.flatten(), np.concatenate([[0], np.cumsum(size)])
    return col.drop_null(), np.concatenate([[0], np.cumsum(np.asarray(col.is_valid()).astype(np.int64))])


def encode_columns(batch: pa.RecordBatch, kinds: list[tuple[str, str]]) -> Ragged:
    """The rows of a batch as Example messages, column by column; ``kinds`` has (name, 'float' | 'int64' | 'bytes')."""
    n = batch.num_rows
    entries = []
    for i, (name, kind) in enumerate(kinds):
        values, off = _lists(batch.column(i))
        if kind == "bytes":
            values = values.cast(pa.large_binary()).fill_null(b"")
            at = np.frombuffer(values.buffers()[1], np.int64)[values.offset:values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
            raw = values.buffers()[2] if len(values) else None
            data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
            feature = Ragged(data, at).field(1).grouped(off).field(1)
        else:
            number = values.fill_null(0).to_numpy(zero_copy_only=False)
            flat = Ragged.fixed(number.astype("<f4")) if kind == "float" else Ragged.varints(number)
            feature = flat.grouped(off).field(1)
            if (off[1:] == off[:-1]).any():   # an empty list has no packed field
                size = np.where(off[1:] > off[:-1], feature.size, 0)
                keep = np.repeat(size > 0, feature.size)
                feature = Ragged(feature.data[keep], np.concatenate([[0], np.cumsum(size)]))
            feature = feature.field(2 if kind == "float" else 3)
        entries.append(Ragged.joined(Ragged.same(_field(1, name.encode()), n), feature.field(2)).field(1))
    return Ragged.joined(*entries).field(1) if entries else Ragged.same(_field(1, b""), n)


def frame_columns(records: Ragged) -> bytes:
    """The records with their lengths and checksums, one after another."""
    length = records.size.astype("<u8")
    head = Ragged.fixed(length)
    return Ragged.joined(head, Ragged.fixed(_mask(crc32c_ragged(head.data, head.off))), records,
                         Ragged.fixed(_mask(crc32c_ragged(records.data, records.off)))).data.tobytes()


def _messages(buf: bytes):
    """Yield (field number, wire type, value) of one message."""
    i = 0
    while i < len(buf):
        key, i = _read_varint(buf, i)
        num, wt = key >> 3, key & 7
        if wt == 2:
            n, i = _read_varint(buf, i)
            yield num, wt, buf[i:i + n]
            i += n
        elif wt == 0:
            v, i = _read_varint(buf, i)
            yield num, wt, v
        elif wt == 5:
            yield num, wt, buf[i:i + 4]
            i += 4
        elif wt == 1:
            yield num, wt, buf[i:i + 8]
            i += 8
        else:
            raise ValueError(f"unsupported wire type {wt}")


def decode_example(buf: bytes, arrays: bool = False) -> dict:
    """Features by name as (kind, values); with ``arrays`` packed floats stay numpy arrays."""
    out = {}
    for num, _, features in _messages(buf):
        if num != 1:
            continue
        for fnum, _, entry in _messages(features):
            if fnum != 1:
                continue
            name, feat = None, b""
            for k, _, v in _messages(entry):
                if k == 1:
                    name = v.decode()
                elif k == 2:
                    feat = v
            for kind, _, lst in _messages(feat):
                vals = []
                for _, wt, v in _messages(lst):
                    if kind == 2 and wt == 2 and arrays:
                        got = np.frombuffer(v, dtype="<f4")
                        vals = [np.concatenate([*vals, got])] if vals else [got]
                    elif kind == 2:
                        vals.extend(np.frombuffer(v, dtype="<f4").tolist() if wt == 2 else
                                    [struct.unpack("<f", v)[0]])
                    elif kind == 3:
                        if wt == 2:
                            j = 0
                            while j < len(v):
                                x, j = _read_varint(v, j)
                                vals.append(x - (1 << 64) if x >= 1 << 63 else x)
                        else:
                            vals.append(v - (1 << 64) if v >= 1 << 63 else v)
                    else:
                        vals.append(v)
                if arrays and kind == 2 and len(vals) == 1 and isinstance(vals[0], np.ndarray):
                    vals = vals[0]
                out[name] = ("float" if kind == 2 else "int64" if kind == 3 else "bytes", vals)
    return out

# ---------------------------------------------------------------- the data source


def _kind(dt) -> str:
    base = dt.elementType if isinstance(dt, ArrayType) else dt
    if isinstance(base, (FloatType, DoubleType)):
        return "float"
    if isinstance(base, (LongType, IntegerType)):
        return "int64"
    if isinstance(base, StringType):
        return "bytes"
    raise TypeError(f"unsupported TFRecord column type {dt}")


def _local(path: str) -> str:
    """The path on the shared mount; other schemes are refused."""
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    if "://" in path:
        raise ValueError(f"tfrecord reads and writes a mounted file system, not {path!r}")
    return path


MANIFEST = "_manifest.json"


def _files(path: str) -> list[str]:
    """The files of a path: those its manifest names, or all of a folder that has none."""
    if os.path.isdir(path):
        try:
            with open(os.path.join(path, MANIFEST)) as f:
                return [os.path.join(path, n) for n in json.load(f)["files"]]
        except FileNotFoundError:
            pass
        return sorted(f for f in glob.glob(os.path.join(path, "*")) if not os.path.basename(f).startswith(("_", ".")))
    return sorted(glob.glob(path))


class _FilePartition(InputPartition):
    def __init__(self, path, start, end):
        super().__init__((path, start))
        self.path, self.start, self.end = path, start, end


BATCH = 1024
SPLIT_BYTES = 64 << 20


def _arrow_batch(records: list[dict], fields) -> pa.RecordBatch:
    cols = []
    for name, dt, kind in fields:
        vals = [r.get(name, (None, []))[1] for r in records]
        if not isinstance(dt, ArrayType):
            vals = [(v[0] if len(v) else None) for v in vals]
            cols.append(pa.array([v.decode() if isinstance(v, bytes) else v for v in vals], kind))
        elif isinstance(dt.elementType, StringType):
            cols.append(pa.array([[x.decode() for x in v] for v in vals], kind))
        else:
            flat = [np.asarray(v, kind.value_type.to_pandas_dtype()) for v in vals]
            offsets = np.concatenate([[0], np.cumsum([len(v) for v in flat])]).astype(np.int32)
            values = pa.array(np.concatenate(flat), kind.value_type)
            cols.append(pa.ListArray.from_arrays(pa.array(offsets), values).cast(kind))
    return pa.RecordBatch.from_arrays(cols, names=[f[0] for f in fields])


class TFRecordReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.path = _local(options["path"])
        self.schema = schema
        self.check = options.get("verifyChecksums", "true").lower() == "true"
        self.split = int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self):
        files = _files(self.path)
        if not files and not os.path.isdir(self.path):
            raise FileNotFoundError(f"no TFRecord file at {self.path}")
        out = []
        for f in files:
            size = os.path.getsize(f)
            out += [_FilePartition(f, a, min(size, a + self.split)) for a in range(0, size, self.split)]
        return out

    def read(self, partition):
        """Arrow record batches of up to ``BATCH`` records."""
        if not isinstance(partition, _FilePartition):
            return  # an empty folder has no partition
        fields = [(f.name, f.dataType, to_arrow_type(f.dataType)) for f in self.schema.fields]
        batch = []
        for rec in read_records(partition.path, self.check, start=partition.start, end=partition.end):
            batch.append(decode_example(rec, arrays=True))
            if len(batch) == BATCH:
                yield _arrow_batch(batch, fields)
                batch = []
        if batch:
            yield _arrow_batch(batch, fields)


class _Done(WriterCommitMessage):
    def __init__(self, file):
        self.file = file


class TFRecordWriter(DataSourceArrowWriter):
    def __init__(self, options, schema: StructType, overwrite: bool):
        self.path = _local(options["path"])
        self.schema = schema
        self.overwrite = overwrite
        self.job = uuid.uuid4().hex  # in the name of every file this write makes

    def write(self, iterator):
        from pyspark import TaskContext
        ctx = TaskContext.get()
        pid = ctx.partitionId() if ctx else 0
        os.makedirs(self.path, exist_ok=True)
        kinds = [(f.name, _kind(f.dataType)) for f in self.schema.fields]
        name = os.path.join(self.path, f"part-{pid:05d}-{self.job}-{uuid.uuid4().hex}.tfrecord")
        tmp = name + ".inprogress"
        with open(tmp, "wb") as f:
            for batch in iterator:
                for a in range(0, batch.num_rows, BATCH):
                    f.write(frame_columns(encode_columns(batch.slice(a, BATCH), kinds)))
        os.replace(tmp, name)
        return _Done(name)

    def commit(self, messages):
        """Publishes exactly the files of the committed task attempts (a failed, retried or speculative attempt may
        have left another one) by renaming the manifest that readers follow; what it does not name goes
        afterwards. Until the rename the folder reads as before this write."""
        os.makedirs(self.path, exist_ok=True)
        before = [] if self.overwrite else [os.path.basename(f) for f in _files(self.path) if self.job not in os.path.basename(f)]
        keep = sorted({*before, *(os.path.basename(m.file) for m in messages if m is not None)})
        part = os.path.join(self.path, f".manifest-{self.job}")
        with open(part, "w") as f:
            json.dump({"files": keep}, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, os.path.join(self.path, MANIFEST))
        for f in glob.glob(os.path.join(self.path, "part-*")):
            name = os.path.basename(f)
            if (self.overwrite or self.job in name) and name not in keep:
                os.remove(f)
        open(os.path.join(self.path, "_SUCCESS"), "w").close()

    def abort(self, messages):
        for f in glob.glob(os.path.join(self.path, f"part-*-{self.job}-*")):
            os.remove(f)


class TFRecordDataSource(DataSource):
    @classmethod
    def name(cls):
        return "tfrecord"

    def schema(self):
        return self.options.get("schema", "user_list ARRAY<FLOAT>, item_list ARRAY<FLOAT>")

    def reader(self, schema):
        return TFRecordReader(self.options, schema)

    def writer(self, schema, overwrite):
        return TFRecordWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TFRecordDataSource)


def _is_mounted(path: str) -> bool:
    return path.startswith("file:") or "://" not in path


def read_tfrecord(spark: SparkSession, path: str, schema: str | None = None, features=None, split_bytes: int | None = None) -> DataFrame:
    """Read Example records; ``schema`` (DDL) names the features and their types, by
    default the reference's two float lists. Files on a mounted file system are read in splits; any other
    scheme that Spark opens goes through its binary file reader, one task per file."""
    if schema is None:
        schema = ", ".join(f"{f} ARRAY<FLOAT>" for f in (features or ("user_list", "item_list")))
    if not _is_mounted(path):
        return decoded(spark.read.format("binaryFile").load(path).select("path", "content"), schema)
    register(spark)
    r = spark.read.format("tfrecord").schema(schema).option("schema", schema)
    if split_bytes:
        r = r.option("splitBytes", split_bytes)
    return r.load(path)


def decoded(files: DataFrame, schema: str) -> DataFrame:
    """The records of whole files (path, content); names that begin with ``_`` or ``.`` are not data."""
    files = files.where(~F.element_at(F.split("path", "/"), -1).rlike("^[_.]"))
    fields = [(f.name, f.dataType, to_arrow_type(f.dataType)) for f in StructType.fromDDL(schema).fields]

    def run(batches):
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at, held = 0, []
                while at < len(raw):
                    n = struct.unpack_from("<Q", raw, at)[0] if at + 12 <= len(raw) else len(raw)
                    data = raw[at + 12:at + 12 + n]
                    if at + 16 + n > len(raw):
                        raise ValueError(f"{name}: truncated record")
                    if (masked_crc_fast(raw[at:at + 8]), masked_crc_fast(data)) != (struct.unpack_from("<I", raw, at + 8)[0],
                                                                                   struct.unpack_from("<I", raw, at + 12 + n)[0]):
                        raise ValueError(f"{name}: bad checksum")
                    held.append(decode_example(data, arrays=True))
                    at += 16 + n
                    if len(held) == BATCH:
                        yield _arrow_batch(held, fields)
                        held = []
                if held:
                    yield _arrow_batch(held, fields)

    return files.mapInArrow(run, schema)


def write_tfrecord(df: DataFrame, path: str, features=None, mode: str = "overwrite") -> None:
    """One part file of Example records per partition."""
    register(df.sparkSession)
    if features:
        df = df.select(*features)
    df.write.format("tfrecord").mode(mode).save(path)
