"""Weight tables of the model (M8, M9).

    user_weights   (user, gate[H*2H], cand[H*H], gate_ms, cand_ms)     one row per user
    item_weights   (item, gate_in[2H], cand_in[H], out[H], *_ms)       one row per item id 0..I
    shared_weights (name, v, ms)                                        gate_bias[2H], cand_bias[H]

Matrices are stored row-major (``gate[r*2H + c]``). ``*_ms`` are the RMSProp
accumulators, zero at the start (the reference resets them before training).

Two initialisers over ids the data provides: ``formula`` (fixed trigonometric values
as column expressions, used by the SQL oracles) and ``normal`` (N(0, 1/sqrt(H)) drawn
with numpy inside the tasks from a generator seeded by (seed, table, id), so a retried
task or a rerun draws the same numbers whatever the partitioning).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqwright.model.cell import Shared

# Largest item table (bytes) every task may hold whole.
MAX_SHARED_BYTES = 256 * 1024 * 1024

# Fixed values of the ``formula`` initialiser (shared with the SQL oracles):
#   gate[u][r][c]  = sin(7u + 3r + 5c) / 2          cand[u][r][c]  = sin(7u + 3r + 5c + 1) / 2
#   gate_in[i][c]  = cos(3i + 2c) / 2               cand_in[i][c]  = cos(3i + 2c + 1) / 2
#   out[i][r]      = cos(3i + 2r + 2) / 2           gate bias = 1, candidate bias = 0


def _formula_user(u: Column, width: int, cols: int, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)),
                       lambda j: F.sin(u * 7 + F.floor(j / cols) * 3 + (j % cols) * 5 + k) / 2)


def _formula_item(i: Column, width: int, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.cos(i * 3 + j * 2 + k) / 2)


def _zeros(width: int, ms: float = 0.0) -> Column:
    return F.array_repeat(F.lit(float(ms)), width)


# Stream numbers of the seeded generators, one per table.
_TABLE_IDS = {"user": 1, "item": 2}


def _seeded_normals(seed: int, table: str, key: str, widths: list[tuple[str, int]], std: float):
    """mapInPandas body: per row, a generator seeded by (seed, table, id) draws the arrays."""
    tid = _TABLE_IDS[table]

    def run(batches):
        import numpy as np
        import pandas as pd
        # a few rows at a time: a drawn row may be much wider than its id
        step = max(1, (32 << 20) // (8 * sum(w for _, w in widths)))
        for pdf in batches:
            for a in range(0, len(pdf), step):
                ids = pdf[key].to_numpy()[a:a + step]
                cols = {name: [] for name, _ in widths}
                for i in ids:
                    rng = np.random.default_rng([seed, tid, int(i)])
                    for name, w in widths:
                        cols[name].append(rng.normal(0.0, std, w))
                yield pd.DataFrame({key: ids, **cols})
    return run


def hashed_normals(seed: int, param: str, key: Column, width: int, std: float) -> Column:
    """Seeded normals as a SQL expression: two 52-bit numbers of an MD5 over (seed, param, id, j) through
    the Box-Muller transform. Any engine with MD5 draws the same values."""
    def draw(j):
        h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(param), key.cast("string"), j.cast("string")))
        a, b = (F.conv(F.substring(h, at, 13), 16, 10).cast("double") for at in (1, 14))
        u = (a + 1.0) / float(1 << 52)
        return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2 * math.pi) * (b / float(1 << 52))) * F.lit(std)
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), draw)


def user_weights(users: DataFrame, hidden: int, init: str = "normal", seed: int = 0,
                 ms: float = 0.0) -> DataFrame:
    """One row per distinct ``user`` of ``users``; ``ms`` is where the RMSProp accumulators start
    (0 after a reset; 1 where a run keeps the optimiser's own start)."""
    H = hidden
    u = F.col("user")
    ids = users.select("user").distinct()
    if init == "formula":
        out = ids.select("user", _formula_user(u, H * 2 * H, 2 * H, 0).alias("gate"),
                         _formula_user(u, H * H, H, 1).alias("cand"))
    elif init == "hashed":
        out = ids.select("user", *[hashed_normals(seed, c, u, w, 1.0 / math.sqrt(H)).alias(c)
                                   for c, w in (("gate", 2 * H * H), ("cand", H * H))])
    elif init == "normal":
        out = ids.mapInPandas(_seeded_normals(seed, "user", "user", [("gate", H * 2 * H), ("cand", H * H)],
                                              1.0 / math.sqrt(H)),
                              "user BIGINT, gate ARRAY<DOUBLE>, cand ARRAY<DOUBLE>")
    else:
        raise ValueError(init)
    return out.select("user", "gate", "cand", _zeros(H * 2 * H, ms).alias("gate_ms"),
                      _zeros(H * H, ms).alias("cand_ms"))


def item_weights(spark: SparkSession, num_items: int, hidden: int, init: str = "normal",
                 seed: int = 0, ms: float = 0.0) -> DataFrame:
    """One row per item id ``0..num_items`` (``num_items`` = the largest id in the data)."""
    H = hidden
    items = spark.range(0, num_items + 1).withColumnRenamed("id", "item")
    i = F.col("item")
    if init == "formula":
        out = items.select("item", _formula_item(i, 2 * H, 0).alias("gate_in"),
                           _formula_item(i, H, 1).alias("cand_in"), _formula_item(i, H, 2).alias("out"))
    elif init == "hashed":
        out = items.select("item", *[hashed_normals(seed, c, i, w, 1.0 / math.sqrt(H)).alias(c)
                                     for c, w in (("gate_in", 2 * H), ("cand_in", H), ("out", H))])
    elif init == "normal":
        out = items.mapInPandas(
            _seeded_normals(seed, "item", "item", [("gate_in", 2 * H), ("cand_in", H), ("out", H)],
                            1.0 / math.sqrt(H)),
            "item BIGINT, gate_in ARRAY<DOUBLE>, cand_in ARRAY<DOUBLE>, out ARRAY<DOUBLE>")
    else:
        raise ValueError(init)
    return out.select("item", "gate_in", "cand_in", "out", _zeros(2 * H, ms).alias("gate_in_ms"),
                      _zeros(H, ms).alias("cand_in_ms"), _zeros(H, ms).alias("out_ms"))


def shared_weights(spark: SparkSession, hidden: int, ms: float = 0.0) -> DataFrame:
    H = hidden
    rows = [("gate_bias", [1.0] * (2 * H), [float(ms)] * (2 * H)), ("cand_bias", [0.0] * H, [float(ms)] * H)]
    return spark.createDataFrame(rows, "name STRING, v ARRAY<DOUBLE>, ms ARRAY<DOUBLE>")


def shared_arrays(item_w: DataFrame, shared_w: DataFrame, num_items: int, hidden: int,
                  limit: int | None = None) -> Shared:
    """Item vectors and biases as arrays every task holds. The size is checked first:
    ``(num_items + 1) * 4H`` doubles must stay under ``limit`` (``MAX_SHARED_BYTES``)."""
    H = hidden
    limit = limit or MAX_SHARED_BYTES
    size = (num_items + 1) * 4 * H * 8
    if size > limit:
        raise ValueError(f"item table of {size} bytes exceeds the {limit}-byte bound")
    rows = item_w.select("item", "gate_in", "cand_in", "out").collect()
    gi = np.zeros((num_items + 1, 2 * H))
    ci = np.zeros((num_items + 1, H))
    oo = np.zeros((num_items + 1, H))
    for r in rows:
        gi[r["item"]] = r["gate_in"]
        ci[r["item"]] = r["cand_in"]
        oo[r["item"]] = r["out"]
    b = {r["name"]: np.asarray(r["v"], dtype=float) for r in shared_w.collect()}
    return Shared(gi, ci, oo, b["gate_bias"], b["cand_bias"])
