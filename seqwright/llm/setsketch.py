"""Near-duplicate groups by SetSketch: sketch, band, estimate by likelihood, verify on full sets.

1. ``sketches``: each text's set of distinct ``k``-word shingles (64-bit hashes) gives ``M``
   registers. A register holds ``floor(1 - log_b x)`` of the smallest exponential value that
   any shingle has there (16 bits, truncated at 0). A shingle's values come in rising order
   with a register order of its own, so most shingles stop after a few. Registers merge by
   maximum and agree with probability close to the Jaccard similarity J.
2. Texts with the same shingle set are one node, known by a 128-bit fingerprint of the set.
3. ``BANDS`` bands of ``ROWS`` registers give bucket keys. Two sets with J = 0.8 share no bucket
   with probability (1 - 0.8**4)**40 < 1e-9.
4. In each bucket the similarity of the members is estimated from their registers by maximum
   likelihood, given the set sizes. Pairs at ``LOOSE`` or more (0.8 less more than five
   standard errors) are connected; connected nodes form families.
5. In each family the full sets are intersected; only ``100 * |A & B| >= 80 * |A | B|`` links.
   Linked components give the groups.

Buckets and families of any size are worked off in blocks of ``BLOCK`` nodes: a unit of work
holds two blocks, and gives at most one edge per node, never all pairs. Nothing is capped.

Defined cases: null and blank texts have an empty set and stand alone. Rows that share an id
are grouped by their own texts; a row without an id is never the one that is kept. Extra columns are ignored here. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqwright.llm import textnp as T
from seqwright.llm.common import fresh, written

M = 163          # registers; a prime, so that every step size visits all of them
ROWS, BANDS = 4, 40
B = 1.02         # base of the registers
A = 20.0         # rate of the exponential values
LOOSE = 0.6
BLOCK = 1024
BLOCK_BYTES = 32 << 20

U = np.uint64


# ---------------------------------------------------------------- sketching
def registers(h: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """(n_rows, M) uint16 registers of the sets given as (hash, row)."""
    least = np.full(n_rows * M, np.inf)
    live = np.arange(len(h))
    seed = T.mix(h ^ U(0x5851F42D4C957F2D))
    c = (seed % U(M)).astype(np.int64)
    d = (T.mix(seed) % U(M - 1)).astype(np.int64) + 1
    t = np.zeros(len(h))
    for j in range(M):
        u = ((T.mix(seed[live] + U((j + 1) * int(T.BASE) % (1 << 64))) >> U(11)).astype(np.float64) + 0.5) * 2.0 ** -53
        v = t[live] - np.log(u) / (A * (M - j))
        t[live] = v
        np.minimum.at(least, row[live] * M + (c[live] + j * d[live]) % M, v)
        if j < 8 or j % 4 == 3:
            most = least.reshape(n_rows, M).max(axis=1)
            live = live[v < most[row[live]]]
            if not len(live):
                break
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(least) / np.log(B))
    return np.clip(k, 0, 65535).astype(np.uint16).reshape(n_rows, M)


def fingerprints(h: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """(n_rows, 2) uint64: the same for equal sets, whatever the order."""
    out = np.zeros((n_rows, 2), U)
    for i, salt in enumerate((0xA24BAED4963EE407, 0x9FB21C651E98DF25)):
        total = np.zeros(len(h) + 1, U)
        np.cumsum(T.mix(h ^ U(salt)), out=total[1:])
        edge = np.searchsorted(row, np.arange(n_rows + 1))
        out[:, i] = T.mix(total[edge[1:]] - total[edge[:-1]])
    return out


def binary_rows(a: np.ndarray) -> pa.Array:
    """Each row of a 2-D array as binary."""
    a = np.ascontiguousarray(a)
    width = a.shape[1] * a.itemsize
    flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(a), [None, pa.py_buffer(a.tobytes())])
    return flat.cast(pa.binary())


def from_binary(col, dtype, width: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    col = col.cast(pa.binary(width * np.dtype(dtype).itemsize))
    raw = np.frombuffer(col.buffers()[1], np.uint8)
    size = width * np.dtype(dtype).itemsize
    return raw[col.offset * size:(col.offset + len(col)) * size].view(dtype).reshape(len(col), width)


SKETCH = "doc_id bigint, n_shingles bigint, node binary, regs binary"


def sketches(df: DataFrame, id_col: str, text: str, k: int) -> DataFrame:
    """(doc_id, n_shingles, node, regs); node and regs are null for empty sets."""

    def run(batches):
        for b in batches:
            for lo, hi, data, offs in T.slices(b, 1):
                h, counts = T.word_hashes(data, offs)
                s, r = T.shingles(h, counts, k)
                n = np.bincount(r, minlength=hi - lo)
                none = pa.array(n == 0)
                node = pa.compute.if_else(none, None, binary_rows(fingerprints(s, r, hi - lo)))
                regs = pa.compute.if_else(none, None, binary_rows(registers(s, r, hi - lo)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int64)), node, regs],
                                                 names=["doc_id", "n_shingles", "node", "regs"])

    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SKETCH)


# ---------------------------------------------------------------- likelihood
def estimate(more: np.ndarray, less: np.ndarray, same: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood J from the numbers of registers that are larger, smaller and equal in
    the first sketch, given both set sizes (a bisection on the concave log-likelihood)."""
    u = na / (na + nb)
    v = 1 - u
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)

    def value(j):
        x, y = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        return more * np.log(x + tiny) + less * np.log(y + tiny) + same * np.log(np.maximum(1 - x - y, tiny))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(30):
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        up = value(a) < value(b)
        lo, hi = np.where(up, a, lo), np.where(up, hi, b)
    return (lo + hi) / 2


# ---------------------------------------------------------------- small graphs inside a task
def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index connected to each of n nodes."""
    root = np.arange(n)
    while True:
        before = root
        m = np.minimum(root[a], root[b])
        root = root.copy()
        np.minimum.at(root, a, m)
        np.minimum.at(root, b, m)
        root = root[root]
        if (root == before).all():
            return root


def edges_out(nodes, root: np.ndarray) -> pa.RecordBatch:
    keep = np.flatnonzero(root != np.arange(len(root)))
    return pa.RecordBatch.from_arrays([nodes.take(pa.array(keep)), nodes.take(pa.array(root[keep]))], names=["a", "b"])


EDGES = "a binary, b binary"


def units(df: DataFrame, key: str, blocks: str, node: str = "node") -> DataFrame:
    """Rows of a group cut into ``blocks`` blocks; each row goes to the units (its block, any block).
    Adds unit (string key of the work unit), blk and paired (the unit holds two different blocks)."""
    df = df.withColumn("blk", F.expr(f"cast(pmod(xxhash64({node}), {blocks}) as int)"))
    df = df.withColumn("other", F.explode(F.expr(f"sequence(0, cast({blocks} as int) - 1)")))
    return df.withColumn("unit", F.concat_ws(":", key, F.least("blk", "other"), F.greatest("blk", "other"))) \
        .withColumn("paired", F.col("blk") != F.col("other")).drop("other")


def band_rows(nodes: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            regs = from_binary(b.column(1), np.uint16, M).astype(U)
            out = []
            for k in range(BANDS):
                x = np.full(b.num_rows, k + 1, U) * U(0x9E3779B97F4A7C15)
                for r in range(ROWS):
                    x = T.mix(x ^ (regs[:, k * ROWS + r] + U(1)) * T.BASE)
                out.append(x)
            keys = np.concatenate(out).view(np.int64)
            take = pa.array(np.tile(np.arange(b.num_rows), BANDS))
            band = np.repeat(np.arange(BANDS, dtype=np.int32), b.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(band), b.column(0).take(take)],
                                             names=["key", "band", "node"])

    return nodes.select("node", "regs").mapInArrow(run, "key bigint, band int, node binary")


def bucket_edges(nodes: DataFrame) -> DataFrame:
    """(a, b): each node of a bucket and the least node that its likely-similar pairs connect it to."""
    rows = band_rows(nodes)
    # written, so that the join has a plain shuffle on both sides and a hot bucket can be split
    shared = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
    members = rows.join(shared, "key")
    members = members.withColumn("blocks", F.ceil(F.col("size") / BLOCK))
    work = units(members, "key", "blocks").join(nodes.select("node", "n_shingles", "regs"), "node")

    def run(batches):
        for t in T.runs(batches, "unit"):
            unit = t.column("unit").combine_chunks().dictionary_encode().indices.to_numpy()
            regs = from_binary(t.column("regs"), np.uint16, M)
            n = t.column("n_shingles").to_numpy().astype(np.float64)
            band, blk = t.column("band").to_numpy(), t.column("blk").to_numpy()
            paired = t.column("paired").combine_chunks().to_numpy(zero_copy_only=False)
            got_a, got_b = [], []
            first = np.arange(len(unit))
            step = 0
            while len(first):
                step += 1
                first = first[first + step < len(unit)]
                first = first[unit[first] == unit[first + step]]
                todo = first[~paired[first] | (blk[first] != blk[first + step])]
                # sizes alone rule out pairs whose smaller set has less than LOOSE of the larger one
                small, large = np.minimum(n[todo], n[todo + step]), np.maximum(n[todo], n[todo + step])
                todo = todo[small >= LOOSE * large]
                for s in range(0, len(todo), 8192):
                    i = todo[s:s + 8192]
                    same = regs[i] == regs[i + step]
                    hit = same[:, :ROWS * BANDS].reshape(len(i), BANDS, ROWS).all(axis=2).argmax(axis=1) == band[i]
                    d0 = same.sum(axis=1)
                    hit &= d0 >= M * (LOOSE - 0.1)
                    i, d0 = i[hit], d0[hit]
                    if not len(i):
                        continue
                    more = (regs[i] > regs[i + step]).sum(axis=1)
                    j = estimate(more, M - d0 - more, d0, n[i], n[i + step])
                    i = i[j >= LOOSE]
                    got_a.append(i)
                    got_b.append(i + step)
            if got_a:
                yield edges_out(t.column("node").combine_chunks(),
                                local_roots(len(unit), np.concatenate(got_a), np.concatenate(got_b)))

    work = work.select("unit", "band", "blk", "paired", "node", "n_shingles", "regs")
    parts = int(work.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return work.repartition(parts, "unit").sortWithinPartitions("unit").mapInArrow(run, EDGES).distinct()


# ---------------------------------------------------------------- components
def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): the least node connected to each node that has an edge, by alternating
    large-star and small-star rounds over a written edge table (a logarithmic number)."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                  .where("a != b").distinct(), name)
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b") \
            .unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        small = small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        now = written(small, name)
        got = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(got) == state:
            break
        state = tuple(got)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


# ---------------------------------------------------------------- verification on full sets
def _bit_filter(ids: DataFrame, col: str):
    """A bit set over hashed ids, at most 2**27 bits (16 MB); extra rows it lets through are
    dropped by the join that follows."""
    n = ids.count()
    bits = 1 << min(27, max(16, int(n * 16).bit_length()))
    at = ids.select(F.pmod(F.xxhash64(col), F.lit(bits)).alias("p")).select(
        F.expr("cast(p div 64 as int)").alias("w"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("m"))
    words = np.zeros(bits // 64, np.int64)
    for b in at.groupBy("w").agg(F.bit_or("m").alias("m")).toArrow().to_batches():
        words[b.column(0).to_numpy()] = b.column(1).to_numpy()
    return words, bits


def full_sets(df: DataFrame, id_col: str, text: str, k: int, wanted: DataFrame) -> DataFrame:
    """(node, hashes) for the nodes in ``wanted`` (node, rep): only the representatives' texts are
    shingled again; the corpus itself is not shuffled."""
    words, bits = _bit_filter(wanted, "rep")
    sent = df.sparkSession.sparkContext.broadcast(words)
    src = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"),
                    F.pmod(F.xxhash64(F.col(id_col).cast("bigint")), F.lit(bits)).alias("p"))

    def run(batches):
        has = sent.value
        for b in batches:
            p = b.column(2).to_numpy()
            b = b.filter(pa.array((has[p // 64] >> (p % 64)) & 1 == 1))
            for lo, hi, data, offs in T.slices(b, 1):
                h, counts = T.word_hashes(data, offs)
                s, r = T.shingles(h, counts, k)
                edge = np.searchsorted(r, np.arange(hi - lo + 1))
                sets = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [
                    None, pa.py_buffer((edge * 8).astype(np.int64).tobytes()), pa.py_buffer(s.tobytes())])
                yield pa.RecordBatch.from_arrays([binary_rows(fingerprints(s, r, hi - lo)), sets.cast(pa.binary())],
                                                 names=["node", "hashes"])

    got = src.mapInArrow(run, "node binary, hashes binary")
    return got.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def link_matrix(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Boolean matrix of ``100 * |A & B| >= percent * |A | B|`` by counting shared shingles."""
    n = np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), n)
    values, inverse, freq = np.unique(every, return_inverse=True, return_counts=True)
    # shingles that one set alone has cannot be shared; the rest get dense columns, some at a time
    column = np.cumsum(freq > 1) - 1
    shared = freq[inverse] > 1
    owner, inverse = owner[shared], column[inverse[shared]]
    order = np.argsort(inverse, kind="stable")
    owner, inverse = owner[order], inverse[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    total = int((freq > 1).sum())
    width = max(64, (16 << 20) // (4 * len(sets)))
    for s in range(0, total, width):
        lo, hi = np.searchsorted(inverse, [s, s + width])
        part = np.zeros((len(sets), min(width, total - s)), np.float32)
        part[owner[lo:hi], inverse[lo:hi] - s] = 1
        both += part @ part.T
    both = both.astype(np.int64)
    union = n[:, None] + n[None, :] - both
    return 100 * both >= percent * union


def verified_edges(family: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) edges that connect what full-set links connect. family: (node, root, n_shingles)."""
    size = family.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.sum("n_shingles").alias("mass"))
    size = size.withColumn("blocks", F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("mass") * 8 / BLOCK_BYTES)))
    work = units(family.join(size, "root").withColumn("key", F.hex("root")), "key", "blocks")
    work = work.select("unit", "blk", "paired", "node").join(sets, "node")

    def run(batches):
        for t in T.runs(batches, "unit"):
            unit = t.column("unit").combine_chunks().dictionary_encode().indices.to_numpy()
            node = t.column("node").combine_chunks()
            blk = t.column("blk").to_numpy()
            paired = t.column("paired").combine_chunks().to_numpy(zero_copy_only=False)
            hashes = t.column("hashes")
            edge = np.flatnonzero(np.diff(unit, prepend=-1, append=-1))
            for lo, hi in zip(edge[:-1], edge[1:]):
                if hi - lo < 2:
                    continue
                link = link_matrix([np.frombuffer(hashes[i].as_py(), U) for i in range(lo, hi)], percent)
                if paired[lo]:
                    link &= blk[lo:hi, None] != blk[None, lo:hi]
                a, b = np.nonzero(np.triu(link, 1))
                if len(a):
                    yield edges_out(node.slice(lo, hi - lo), local_roots(hi - lo, a, b))

    parts = int(work.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return work.repartition(parts, "unit").sortWithinPartitions("unit").mapInArrow(run, EDGES).distinct()


# ---------------------------------------------------------------- the operator
def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", *, k: int = 5,
                    percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least doc_id of its group), kept."""
    if percent < 80:
        raise ValueError("the bands are laid out for similarities of 0.8 or more")
    rows = written(sketches(df, id_col, text, k), "sketches")
    nodes = written(rows.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs")), "nodes")
    family = components(bucket_edges(nodes), "families")
    family = written(family.join(nodes.select("node", "rep", "n_shingles"), "node"), "families")
    sets = full_sets(df, id_col, text, k, family.select("node", "rep"))
    linked = components(verified_edges(family, sets, percent), "links")
    linked = linked.join(nodes.select("node", "rep"), "node")
    least = written(linked.groupBy("root").agg(F.min("rep").alias("component_id")), "groups")
    linked = linked.join(least, "root").select("node", F.col("component_id").alias("_c"))
    rep = nodes.select("node", F.col("rep").alias("_r")).join(linked, "node", "left")
    rep = written(rep.select("node", F.coalesce("_c", "_r").alias("component_id")), "groups")
    out = rows.select("doc_id", "n_shingles", "node").join(rep, "node", "left")
    c = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", c.alias("component_id"), F.coalesce(F.col("doc_id") == c, F.lit(False)).alias("kept"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Exactly one row of each group, with the input's columns: the least by id (null last), then by hashes of the
    text and of the whole row, so reruns agree. Rows that share an id but not a group are documents of their own,
    rows without an id as well; rows that are equal in every column stay as one."""
    row, name, other = fresh(df, "_row", "_kept_row", "_other")
    # rows go by a hash of id and text, so that null and shared ids stand for themselves
    null = F.concat(F.col(id_col).isNull().cast("string"), F.col(text).isNull().cast("string"))
    src = df.withColumn(row, F.xxhash64(null, F.col(id_col), F.col(text)))
    n = written(near_duplicates(src, row, text, **options), "near-duplicates")
    ids = src.select(F.col(row).alias("doc_id"), F.col(id_col).alias("id")).distinct()
    least = F.struct(F.col("id").isNull(), "id", "doc_id")
    # distinct rows by now: a group of copies is pre-aggregated by its rows' partitions before it meets
    kept = n.select("doc_id", "component_id").distinct().join(ids, "doc_id").groupBy("component_id").agg(F.min_by("doc_id", least).alias(name))
    kept = written(kept.select(name), "kept-rows")
    out = src.join(kept, F.col(row) == F.col(name), "left_semi")
    twice = n.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias(other))
    twice = written(twice, "repeated-rows")
    if not twice.limit(1).count():
        return out.drop(row)
    same = F.col(row) == F.col(other)
    again = out.join(twice, same, "left_semi")
    one = again.groupBy(row).agg(F.min_by(F.struct(*df.columns), F.xxhash64(*df.columns)).alias("r")).select("r.*")
    return out.join(twice, same, "left_anti").drop(row).unionByName(one)
