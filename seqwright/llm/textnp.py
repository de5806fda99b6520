"""Vectorised word and shingle hashing over Arrow text columns, for use inside tasks.

A slice of rows is one byte array with row offsets; words never cross rows. Slices hold
``SLICE_BYTES`` of text (or one longer text), so temporary arrays stay small whatever the
Arrow batch holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = U(pow(int(BASE), -1, 1 << 64))
_SEP = np.zeros(256, bool)
_SEP[[32, 9, 10, 11, 12, 13]] = True
NOT_SEP = ~_SEP
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64; grown as needed and kept by the worker."""
    got = _powers.get(int(base))
    if got is None or len(got) < n:
        a = np.full(max(n, SLICE_BYTES + 2), base, U)
        a[0] = 1
        got = _powers[int(base)] = np.cumprod(a)
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def slices(batch: pa.RecordBatch, column: int, max_bytes: int = SLICE_BYTES):
    """(first row, end row, bytes, offsets) of consecutive rows; null texts are empty."""
    col = batch.column(column)
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if not len(col):
        return
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = int(np.searchsorted(offs, offs[lo] + max_bytes, "right")) - 1
        hi = min(max(hi, lo + 1), len(col))
        yield lo, hi, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[e] - P[s] = sum of (byte + 1) * BASE**position over [s, e)."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * powers(BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, the same wherever the span stands."""
    h = (prefix[end] - prefix[start]) * powers(BASE_INVERSE, len(prefix))[start]
    return mix(h + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def word_spans(data: np.ndarray, offs: np.ndarray):
    """(start, end, words per row) of the words ``[^\\x20\\x09-\\x0D]+`` of every row."""
    ok = NOT_SEP[data]
    first = ok.copy()
    last = ok.copy()
    if len(data):
        first[1:] &= ~ok[:-1]
        last[:-1] &= ~ok[1:]
        edge = offs[(offs > 0) & (offs < len(data))]
        first[edge] = ok[edge]
        last[edge - 1] = ok[edge - 1]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    return start, end, np.diff(np.searchsorted(start, offs))


def word_hashes(data: np.ndarray, offs: np.ndarray):
    """(hash of each lower-cased word, words per row)."""
    low = LOWER[data]
    start, end, counts = word_spans(low, offs)
    return span_hash(prefix_hash(low), start, end), counts


def shingles(h: np.ndarray, counts: np.ndarray, k: int):
    """Distinct k-word shingles of each row as (hashes, row of each), sorted by row and hash. A row
    of fewer than k words has its whole sequence as one shingle; a row without words has none."""
    n = len(h)
    row = np.repeat(np.arange(len(counts)), counts)
    odd = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0xD6E8FEB86659FD93),
           U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53), U(0x2545F4914F6CDD1D), U(0xA0761D6478BD642F)]
    odd = [odd[i % 8] + U(2 * (i // 8)) for i in range(k)]
    if n >= k:
        s = np.zeros(n - k + 1, U)
        for i in range(k):
            s += mix(h[i:n - k + 1 + i] + U(i)) * odd[i]
        ok = row[:n - k + 1] == row[k - 1:]
        s, r = mix(s[ok]), row[:n - k + 1][ok]
    else:
        s, r = np.zeros(0, U), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        at = np.cumsum(counts) - counts
        whole = np.zeros(len(short), U)
        for i in range(k - 1):
            has = counts[short] > i
            whole[has] += mix(h[at[short][has] + i] + U(i)) * odd[i]
        s = np.concatenate([s, mix(whole + counts[short].astype(U) * U(0x632BE59BD9B4E019))])
        r = np.concatenate([r, short])
    order = np.lexsort((s, r))
    s, r = s[order], r[order]
    if len(s):
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
        s, r = s[keep], r[keep]
    return s, r


def runs(batches, key: str):
    """Re-batch Arrow batches that are sorted by ``key`` so that no run of equal keys is cut."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        if held is not None:
            t = pa.concat_tables([held, t])
        k = t.column(key)
        last = k[-1].as_py()
        same = np.asarray(pa.compute.not_equal(k, last).combine_chunks()).astype(bool)
        cut = int(np.flatnonzero(same)[-1]) + 1 if same.any() else 0
        held = t.slice(cut)
        if cut:
            yield t.slice(0, cut).combine_chunks()
    if held is not None and held.num_rows:
        yield held.combine_chunks()
