"""WARC archives of captured pages and one globally ordered index of their captures.

Writing. Every capture becomes one record of its own gzip member. Captures with equal payloads of
at least ``min_bytes`` bytes are one response (smallest id) and revisits of it, which carry headers
only. Which captures repeat is decided on narrow rows of SHA-1 and length; the pages themselves
meet the answer by a join on the digest, in which payloads that very many captures share come from a
broadcast (at most ``MAX_HOT`` of them) and their captures are spread. Spark's own text writer writes
the bytes, so commits and retries are Spark's; its line separator is an empty gzip member, which a
reader of concatenated members passes over.

Reading. Archives are read whole, one file at a time (``ARCHIVE_BYTES`` of payload on average), and
member by member; a response's payload is hashed again and must have the digest of its header.

Index. What a task reads is sorted by (URL key, timestamp, id) in runs of at most ``RUN_ROWS``
captures and written. Splitters from a bounded sample of full keys cut the key space, so the captures
of one URL may span ranges. Runs go to the ranges as blocks of sorted captures; a range merges its
runs with a loser tree that takes blocks as they come in the order of their first keys and holds one
open block a run. More than ``FAN_IN`` runs are merged in groups first, in as many passes as it takes.

Defined cases: a null payload is empty; a null URL has the key ``-``, one without ``://`` is a key as it
stands; rows that repeat an id and payload are captures of their own, all of them responses if that
id is the smallest; without any id in a group of equal payloads all are responses, else captures
without an id revisit it. Empty tables give no archive and no rows. Very long payloads are records
like any other (a task holds one at a time beside its file). Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from datetime import datetime, timedelta, timezone

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqwright.llm.common import shared_path, written

ARCHIVE_BYTES = 32 << 20   # of payload in an archive, on average
MAX_HOT = 100_000          # payloads whose captures find their response by a broadcast
HOT_ROWS = 10_000          # captures of a payload from which on it is one of them, at least
RUN_ROWS = 100_000         # captures in a sorted run, at most
BLOCK_ROWS = 2_048         # captures in a block of a run, at most
RANGE_ROWS = 500_000       # captures in a range, about
FAN_IN = 256               # runs merged at a time
SAMPLE_PER_RANGE = 64      # sampled keys per range (their number is bounded by MAX_SAMPLE)
MAX_SAMPLE = 200_000
EMPTY_MEMBER = zlib.compress(b"", 9, 31)
#: Capture times where the table has none: this instant plus the id (modulo 10**9) in seconds.
FIRST_CAPTURE = datetime(2020, 1, 1, tzinfo=timezone.utc)

CAPTURE = ("page_id bigint, url_key string, ts string, payload_bytes bigint, payload_digest string, record_type string, "
           "refers_to bigint, file string, at bigint, size bigint")
RECORD = "page_id bigint, url string, ts string, record_type string, refers_to bigint, payload_digest string, payload binary"


# ---------------------------------------------------------------- single records
_UNSAFE = re.compile("[^!-~]+")


def _escaped(text: str) -> str:
    """Printable ASCII without blanks: everything else as %XX of its UTF-8 bytes."""
    return _UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "surrogatepass")), text)


def url_key(url: str | None) -> str:
    """Sortable key of a URL: host labels reversed, then path and query; scheme, ``www.``, user, default
    port and fragment do not count."""
    if url is None:
        return "-"
    scheme, found, rest = url.partition("://")
    if not found:
        return _escaped(url) or "-"
    m = re.match(r"([^/?#]*)([^#]*)", rest, re.S)
    host, path = m[1].rsplit("@", 1)[-1].lower(), m[2]
    name, colon, port = host.partition(":")
    name = name.removeprefix("www.")
    if port in ("", {"http": "80", "https": "443"}.get(scheme.lower())):
        colon = port = ""
    if not path.startswith("/"):
        path = "/" + path
    return _escaped(f"{','.join(reversed(name.split('.')))}{colon}{port}){path}")


def capture_time(page_id: int | None) -> str:
    return (FIRST_CAPTURE + timedelta(seconds=(page_id or 0) % 10**9)).strftime("%Y%m%d%H%M%S")


def _urn(page_id) -> str:
    return "<urn:page:none>" if page_id is None else f"<urn:page:{page_id}>"


def encode_record(page_id, url, ts: str, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """One gzip member with the whole record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    when = f"{ts[:4]}-{ts[4:6]}-{ts[6:8]}T{ts[8:10]}:{ts[10:12]}:{ts[12:14]}Z"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}",
            f"WARC-Date: {when}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_escaped(url)}")
    if revisit:
        head += [f"WARC-Refers-To: {_urn(refers_to)}",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def members(raw: bytes):
    """(offset, size, content) of every non-empty gzip member."""
    view, at = memoryview(raw), 0
    while at < len(raw):
        unpack, end, out = zlib.decompressobj(31), at, []
        while not unpack.eof:
            if end >= len(raw):
                raise ValueError(f"archive ends within the member at {at}")
            step = view[end:end + 65536]
            out.append(unpack.decompress(step))
            end += len(step)
        end -= len(unpack.unused_data)
        content = b"".join(out)
        if content:
            yield at, end - at, content
        at = end


def _id_of(urn: str | None):
    if urn is None or urn == "<urn:page:none>":
        return None
    return int(urn[len("<urn:page:"):-1])


def decode_record(content: bytes) -> dict:
    """Headers and payload of one record; a response whose payload has not the digest it names is refused."""
    cut = content.index(b"\r\n\r\n")
    lines = content[:cut].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = dict(x.split(": ", 1) for x in lines[1:])
    block = content[cut + 4:cut + 4 + int(head["Content-Length"])]
    if len(content) != cut + 8 + len(block):
        raise ValueError(f"record {head['WARC-Record-ID']}: length differs from its header")
    cut = block.index(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in block[:cut].decode().split("\r\n")[1:])["Content-Length"])
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = None
    if head["WARC-Type"] == "response":
        payload = block[cut + 4:]
        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"record {head['WARC-Record-ID']}: payload differs from its digest")
    return {"page_id": _id_of(head["WARC-Record-ID"]), "url": head.get("WARC-Target-URI"),
            "ts": re.sub("[^0-9]", "", head["WARC-Date"]), "record_type": head["WARC-Type"],
            "refers_to": _id_of(head.get("WARC-Refers-To")), "payload_digest": digest, "payload_bytes": size, "payload": payload}


# ---------------------------------------------------------------- writing
def _resolved(src: DataFrame, min_bytes: int):
    """``src`` (page_id, url, ts, html) with ``_sha`` and ``_first`` (a struct with the response's id where the
    capture's payload occurs more than once), and the mean payload size."""
    sha = src.withColumn("_sha", F.sha1(F.col("html")))
    groups = sha.groupBy("_sha", F.length(F.col("html").cast("binary")).cast("bigint").alias("bytes")).agg(
        F.count(F.lit(1)).alias("n"), F.min("page_id").alias("id"))
    groups = written(groups, "payloads")
    total = groups.agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("bytes")).alias("bytes")).first()
    rows = total["rows"] or 0
    shared = groups.where((F.col("n") > 1) & (F.col("bytes") >= min_bytes))
    limit = max(HOT_ROWS, rows // MAX_HOT)   # at most MAX_HOT payloads have more captures
    is_hot = F.col("n") > limit
    n = shared.agg(F.count_if(is_hot).alias("hot"), F.count_if(~is_hot).alias("rest")).first()
    first = F.struct(F.col("id").alias("id")).alias("_first")
    out = sha
    if n["hot"]:
        hot = shared.where(is_hot).select(F.col("_sha").alias("_h"), F.struct("id").alias("_hot"))
        out = out.join(F.broadcast(hot), F.col("_sha") == F.col("_h"), "left").drop("_h")
        # the hot captures are known; in the next join each stands alone
        out = out.withColumn("_key", F.when(F.col("_hot").isNull(), F.col("_sha")).otherwise(
            F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))))
    else:
        out = out.withColumn("_hot", F.lit(None).cast("struct<id:bigint>")).withColumn("_key", F.col("_sha"))
    if n["rest"]:
        rest = shared.where(~is_hot).select(F.col("_sha").alias("_k"), first)
        rest = F.broadcast(rest) if n["rest"] <= MAX_HOT else rest.hint("merge")
        out = out.join(rest, F.col("_key") == F.col("_k"), "left").drop("_k")
    else:
        out = out.withColumn("_first", F.lit(None).cast("struct<id:bigint>"))
    return out.withColumn("_first", F.coalesce("_hot", "_first")).drop("_hot", "_key"), (total["bytes"] or 0) / max(1, rows)


def _records(batches):
    for b in batches:
        out = []
        for page_id, url, ts, html, sha, first, repeats in zip(*(c.to_pylist() for c in b.columns)):
            digest = base64.b32encode(bytes.fromhex(sha)).decode()
            revisit = repeats and first is not None and first != page_id
            out.append(encode_record(page_id, url, ts or capture_time(page_id), html, digest, first, revisit))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", payload: str = "html",
                   time: str | None = None, *, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Archives of all captures below ``path``. ``time`` names a timestamp column; without it, or where it is
    null, capture times follow the ids (:data:`FIRST_CAPTURE`)."""
    ts = F.date_format(F.col(time).cast("timestamp"), "yyyyMMddHHmmss") if time else F.lit(None).cast("string")
    src = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), ts.alias("ts"),
                       F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("html"))
    rows, mean = _resolved(src, min_bytes)
    rows = rows.select("page_id", "url", "ts", "html", "_sha", F.col("_first.id"), F.col("_first").isNotNull())
    out = rows.mapInArrow(_records, "record binary").select(F.col("record").cast("string").alias("value"))
    out.write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").option(
        "maxRecordsPerFile", max(1, int(archive_bytes / max(mean, 1.0)))).text(path)


# ---------------------------------------------------------------- reading
def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives; revisits have no payload of their own."""
    names = [f.split(" ")[0] for f in RECORD.split(", ")]

    def run(batches):
        for b in batches:
            for raw in b.column(1):
                held, size = [], 0
                for _, _, content in members(raw.as_py()):
                    held.append(decode_record(content))
                    size += len(content)
                    if size > 8 << 20:
                        yield _batch(held, names, RECORD_TYPES)
                        held, size = [], 0
                if held:
                    yield _batch(held, names, RECORD_TYPES)

    return _archives(spark, path).mapInArrow(run, RECORD)


def replayed(spark: SparkSession, path: str) -> DataFrame:
    """Every capture with its payload: revisits take that of the response they refer to. Responses that
    many captures share are few and joined by id and digest; Spark splits a hot one (skew join)."""
    rec = read_archives(spark, path)
    got = rec.where(F.col("record_type") == "response").groupBy(
        F.col("page_id").alias("_id"), F.col("payload_digest").alias("_d")).agg(F.first("payload").alias("_p"))
    back = rec.join(got, (F.col("refers_to") == F.col("_id")) & (F.col("payload_digest") == F.col("_d")), "left")
    return back.select("page_id", "url", "ts", "record_type", "refers_to", "payload_digest",
                       F.coalesce("payload", "_p").alias("payload"))


_PA = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
RECORD_TYPES = [_PA[f.split(" ")[1]] for f in RECORD.split(", ")]
CAPTURE_NAMES = [f.split(" ")[0] for f in CAPTURE.split(", ")]
CAPTURE_TYPES = [_PA[f.split(" ")[1]] for f in CAPTURE.split(", ")]


def _batch(rows: list[dict], names, types) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names=list(names))


# ---------------------------------------------------------------- sorted runs
def sort_key(key: str, ts: str, page_id) -> bytes:
    """Bytes that order captures by URL key, timestamp and id (null last)."""
    return f"{key} {ts} {'~' if page_id is None else format(page_id + (1 << 63), '020d')}".encode()


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """Sorted runs of the archives' captures: run, key and the capture's columns, in key order within a run."""

    def run(batches):
        task, runs, held = TaskContext.get().partitionId(), 0, []

        def flush():
            held.sort(key=lambda r: r["key"])
            for s in range(0, len(held), 8192):
                yield _batch(held[s:s + 8192], ["run", "key", *CAPTURE_NAMES], [pa.int64(), pa.binary(), *CAPTURE_TYPES])

        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1)):
                for at, size, content in members(raw.as_py()):
                    r = decode_record(content)
                    del r["payload"]
                    k = url_key(r["url"])
                    held.append({**r, "run": (task << 24) + runs, "key": sort_key(k, r["ts"], r["page_id"]), "url_key": k,
                                 "file": name, "at": at, "size": size})
                    if len(held) >= RUN_ROWS:
                        yield from flush()
                        runs, held = runs + 1, []
        if held:
            yield from flush()

    return _archives(spark, path).mapInArrow(run, f"run bigint, key binary, {CAPTURE}")


# ---------------------------------------------------------------- the merge
class LoserTree:
    """Merges runs of (sorted keys, batch) blocks. Inner nodes hold the loser of the match below them, the
    root the winner; taking a record replays one path. The winner's records up to the best loser on its path
    leave together."""

    END = (1, b"")

    def __init__(self):
        self.leaf: dict[int, int] = {}      # run -> leaf
        self.blocks: list[list] = []        # per leaf: open blocks (keys, batch, position)
        self.tree: list[int] = []

    def _head(self, i: int):
        b = self.blocks[i]
        return (0, b[0][0][b[0][2]]) if b else self.END

    def _build(self) -> None:
        n = len(self.blocks)
        win = [0] * n + list(range(n))
        self.tree = [0] * max(1, n)
        for node in range(n - 1, 0, -1):
            a, b = win[2 * node], win[2 * node + 1]
            first = a if (self._head(a), a) <= (self._head(b), b) else b
            win[node], self.tree[node] = first, a + b - first
        self.tree[0] = win[1] if n > 1 else 0

    def _replay(self, i: int) -> None:
        node, best = (i + len(self.blocks)) // 2, i
        while node:
            other = self.tree[node]
            if (self._head(other), other) < (self._head(best), best):
                self.tree[node], best = best, other
            node //= 2
        self.tree[0] = best

    def add(self, run: int, keys: list, batch) -> None:
        """The next block of a run; its first key is at or above that of every block added before."""
        if run in self.leaf:
            i = self.leaf[run]
            self.blocks[i].append([keys, batch, 0])
            if len(self.blocks[i]) == 1:   # the leaf had run dry: its head was the greatest of all
                self._build()
        else:
            self.leaf[run] = len(self.blocks)
            self.blocks.append([[keys, batch, 0]])
            self._build()

    def drain(self, limit: bytes | None):
        """(batch, start, count) of all records below ``limit`` (all of them without one), in order."""
        while self.blocks:
            i = self.tree[0]
            head = self._head(i)
            if head == self.END or (limit is not None and head[1] >= limit):
                return
            keys, batch, at = self.blocks[i][0]
            node, rival = (i + len(self.blocks)) // 2, self.END
            while node:
                rival = min(rival, self._head(self.tree[node]))
                node //= 2
            end = len(keys) if rival == self.END else max(at + 1, bisect_right(keys, rival[1], at))
            if limit is not None:
                end = min(end, max(at + 1, bisect_left(keys, limit, at)))
            yield batch, at, end - at
            if end == len(keys):
                self.blocks[i].pop(0)
            else:
                self.blocks[i][0][2] = end
            self._replay(i)


ROW_SCHEMA = pa.schema([("key", pa.binary()), *zip(CAPTURE_NAMES, CAPTURE_TYPES)])
BLOCK = "range int, grp bigint, run bigint, first binary, body binary"


def _blocks(splitters: list[bytes], groups: int):
    """Blocks of the runs' captures: cut where the run or the range changes and at ``BLOCK_ROWS``."""

    def run(batches):
        import numpy as np

        for b in batches:
            runs = b.column(0).to_numpy()
            keys = b.column(1).to_pylist()
            part = np.array([bisect_right(splitters, k) for k in keys], np.int32)
            rows = pa.RecordBatch.from_arrays(b.columns[1:], schema=ROW_SCHEMA)
            cut = np.flatnonzero((runs[1:] != runs[:-1]) | (part[1:] != part[:-1])) + 1
            out = []
            for a, e in zip([0, *cut.tolist()], [*cut.tolist(), len(keys)]):
                for s in range(a, e, BLOCK_ROWS):
                    body = rows.slice(s, min(e, s + BLOCK_ROWS) - s).serialize().to_pybytes()
                    out.append((int(part[s]), zlib.crc32(b"%d" % runs[s]) % groups, int(runs[s]), keys[s], body))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(
                    zip(*out), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
                    names=["range", "grp", "run", "first", "body"])

    return run


def _merge(batches):
    """Merged captures of each (range, group) of blocks, which come sorted by range, group and first key."""
    at, tree, out, held = None, None, [], 0

    def taken(parts, run):
        t = pa.Table.from_batches(parts).combine_chunks()
        for b in t.to_batches():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, at[0], np.int32)),
                                              pa.array(np.full(b.num_rows, run, np.int64)), *b.columns],
                                             names=["range", "run", *ROW_SCHEMA.names])

    def pull(limit):
        nonlocal out, held
        for batch, start, count in tree.drain(limit):
            out.append(batch.slice(start, count))
            held += count
            if held >= 8192:
                yield from taken(out, at[1])
                out, held = [], 0

    def finish():
        nonlocal out, held
        yield from pull(None)
        if out:
            yield from taken(out, at[1])
            out, held = [], 0

    for b in batches:
        for part, grp, run, first, body in zip(*(c.to_pylist() for c in b.columns)):
            if (part, grp) != at:
                if at is not None:
                    yield from finish()
                at, tree = (part, grp), LoserTree()
            yield from pull(first)
            batch = pa.ipc.read_record_batch(pa.py_buffer(body), ROW_SCHEMA)
            tree.add(run, batch.column(0).to_pylist(), batch)
    if at is not None:
        yield from finish()


def merged_index(runs: DataFrame, fan_in: int | None = None, range_rows: int | None = None) -> DataFrame:
    """All captures of the (written) runs in the order of URL key, timestamp and id: partition ``range``
    of the result holds the captures of one key range, in order."""
    fan_in = fan_in or FAN_IN
    size = runs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("run").alias("runs")).first()
    ranges = max(1, -(-size["n"] // (range_rows or RANGE_ROWS)))
    splitters: list[bytes] = []
    if ranges > 1:
        want = min(MAX_SAMPLE, SAMPLE_PER_RANGE * ranges)   # the bound of what the driver gets
        share = min(1.0, 2.0 * want / size["n"])
        drawn = runs.select("key").where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30)))
        keys = sorted(bytes(r["key"]) for r in drawn.limit(4 * want).collect())
        splitters = sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)} if keys else set())
    n_runs, out = size["runs"], runs
    while True:
        groups = -(-n_runs // fan_in) if n_runs > fan_in else 1
        dealt = out.select("run", "key", *CAPTURE_NAMES).mapInArrow(_blocks(splitters, groups), BLOCK)
        dealt = dealt.repartitionById(len(splitters) + 1, F.col("range")) if splitters else dealt.repartition(1)
        out = dealt.sortWithinPartitions("range", "grp", "first").mapInArrow(_merge, f"range int, run bigint, key binary, {CAPTURE}")
        if groups == 1:
            return out.select("range", *CAPTURE_NAMES)
        out, n_runs = written(out, "merged-runs"), groups


def capture_index(spark: SparkSession, path: str, **options) -> DataFrame:
    """The captures of all archives below ``path`` in global order, written to the shared folder: range, page_id,
    url_key, ts, payload_bytes, payload_digest, record_type, refers_to and where the record lies (file, at,
    size)."""
    runs = written(capture_runs(spark, path), "capture-runs")
    return written(merged_index(runs, **options), "captures")


def archived(pages: DataFrame, **options) -> DataFrame:
    """Archives of all pages in the shared folder, read back through their merged index."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archives(pages, path, **options)
    return capture_index(spark, path)
