"""Positions times items in tiles (M2 above the item-table bound).

The output layer meets every position with every item. Neither side fits a task, so both are cut: positions
into ``groups`` of about ``GROUP`` rows by a hash of their key, item rows into blocks of at most ``limit`` bytes. One
job deals every position to each item block and every item block to each group, and a task holds one group and one
block. What a tile gives is a partial result (largest logit, log-sum-exp, sums), which later aggregations
merge. Positions move once for each item block, items once for each group.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP = 1 << 16        # positions in a tile, about
CELLS = 1 << 22        # positions x items of a numpy block inside a tile


def tiled(positions: DataFrame, item_w: DataFrame, num_items: int, hidden: int, limit: int,
          fn: Callable[[pd.DataFrame, np.ndarray, int], pd.DataFrame], schema: str) -> DataFrame:
    """``fn(rows, out, first)`` for every tile: the positions of a group and the output rows of the items ``first`` ..
    (zeros for an id without a row). ``positions`` (user, seg, pos, h, ..) is a written table."""
    per_block = max(1, limit // (8 * hidden))
    blocks = -(-(num_items + 1) // per_block)
    groups = max(1, -(-positions.count() // GROUP))
    at = F.pmod(F.xxhash64("user", "seg", "pos"), F.lit(groups)).cast("int")
    left = positions.withColumn("_group", at).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = item_w.where((F.col("item") >= 0) & (F.col("item") <= num_items)).select(
        "item", "out", F.floor(F.col("item") / per_block).cast("int").alias("_block"))
    right = right.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def tile(key, rows: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({n: [] for n in names})
        first = int(key[1]) * per_block
        out = np.zeros((min(num_items + 1, first + per_block) - first, hidden))
        if len(items):
            out[items["item"].to_numpy() - first] = np.stack(items["out"].to_numpy())
        return fn(rows, out, first)

    return left.groupBy("_group", "_block").cogroup(right.groupBy("_group", "_block")).applyInPandas(tile, schema)


def steps(n_positions: int, n_items: int):
    """Ranges of positions whose logits are held at a time."""
    step = max(1, CELLS // max(1, n_items))
    return ((a, min(n_positions, a + step)) for a in range(0, n_positions, step))
