"""URL filter: longest-prefix rules, then a Bloom filter cascade over the corpus's URL keys.

A URL's key is host + path. ``keys`` lists every distinct key of the corpus (the complete key
universe) with whether a block list names it. The cascade encodes that set exactly: level 1
holds the listed keys, level 2 the unlisted keys that level 1 lets through, level 3 the listed
keys that level 2 lets through, and so on until a level has no false positive. A key is listed
if the first level that does not hold it is an even one (or none is and the depth is odd). For
every key of the universe this is exact, and needs no join: pages are only probed.

Its size follows the number of listed keys (about 1.44 log2(universe / listed) + 4 bits each).
Before anything is broadcast the size is computed from the counts; above ``max_bytes`` the keys
are split by hash into as many groups as needed, each with a cascade of its own that fits, and
the pages are probed group by group.

Defined cases: a null URL or one without '://' has an empty host and path, fits no rule and is
allowed. Rows are judged one by one (repeats keep their number); extra columns are ignored; an
empty table gives no rows; with no listed key every page without a rule is allowed.
"""

from __future__ import annotations

import math
from dataclasses import astuple, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from seqwright.llm.common import ascii_lower, written
from seqwright.llm.textnp import mix

U = np.uint64
MAX_BYTES = 64 << 20


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (UrlRule("allow", "org", "/"), UrlRule("block", "example.org", "/es/"), UrlRule("block", "example.org", "/en/1"),
         UrlRule("allow", "com", "/fr/"), UrlRule("block", "com", "/de/"))

#: A host is on the block list if one of its labels has one of these words between dots and dashes.
LISTED_WORDS = ("spam", "pills", "bets", "adult", "ads", "casino")


def host_of(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    return F.when(F.instr(u, "://") == 0, "").otherwise(
        ascii_lower(F.regexp_extract(u, "(?s)^.*?://([^/?#]*)", 1)))


def path_of(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    return F.when(F.instr(u, "://") == 0, "").otherwise(F.regexp_extract(u, "(?s)^.*?://[^/?#]*([^?#]*)", 1))


def best_rule(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """struct(length, rule, verdict) of the longest rule that fits, else null."""
    fits = []
    for r in rules:
        ok = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        fits.append(F.when(ok, F.struct(F.lit(len(r.name)).alias("length"), F.lit(r.name).alias("rule"),
                                        F.lit(r.verdict).alias("verdict"))))
    return F.array_max(F.array(*fits))


# ---------------------------------------------------------------- the cascade
@dataclass(frozen=True)
class Level:
    bits: np.ndarray  # 64-bit words
    size: int         # bits in use
    probes: int
    salt: int

    def positions(self, h1: np.ndarray, h2: np.ndarray):
        a, b = mix(h1 ^ U(self.salt)), mix(h2 ^ U(self.salt)) | U(1)
        for i in range(self.probes):
            yield ((a + U(i) * b) % U(self.size)).astype(np.int64)

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.ones(len(h1), bool)
        for p in self.positions(h1, h2):
            out &= (self.bits[p >> 6] >> (p & 63).astype(U)) & U(1) == 1
        return out


def in_cascade(levels: list[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether each key is listed; exact for the keys the cascade was built over."""
    listed = np.zeros(len(h1), bool)
    live = np.arange(len(h1))
    for depth, level in enumerate(levels, 1):
        held = level.holds(h1[live], h2[live])
        live = live[held]
        listed[live] = depth % 2 == 1
        if not len(live):
            break
    # a key that level d held and level d + 1 did not is of the kind that level d encodes
    return listed


def level_shape(n: int, others: int, first: bool) -> tuple[int, int]:
    """(bits, probes): the first level aims at as many false positives as half of what it holds."""
    rate = min(0.5, n / max(others, 1) / 2) if first else 0.5
    probes = max(1, round(-math.log2(rate)))
    return max(64, math.ceil(n * probes / math.log(2))), probes


def build_cascade(keys: DataFrame, max_levels: int = 64) -> list[Level]:
    """keys: (h1, h2, listed), distinct. Every level's bits are set by tasks and joined by bit_or."""
    levels: list[Level] = []
    inside, outside = keys.where("listed"), keys.where("not listed")
    n = inside.count()
    while n:
        if len(levels) == max_levels:
            raise RuntimeError("keys of different kinds share both hashes")
        others = outside.count()
        size, probes = level_shape(n, others, not levels)
        shape = Level(np.zeros(0, U), size, probes, 0x9E3779B97F4A7C15 * (len(levels) + 1) % (1 << 64))
        bits = np.zeros(-(-size // 64), U)
        for b in _bit_words(inside, shape).toArrow().to_batches():
            bits[b.column(0).to_numpy()] = b.column(1).to_numpy().view(U)
        levels.append(Level(bits, size, probes, shape.salt))
        through = written(_held(outside, levels[-1]), "cascade-level")
        inside, outside = through, inside
        n = inside.count()
    return levels


def _bit_words(keys: DataFrame, level: Level) -> DataFrame:
    def run(batches):
        for b in batches:
            h1, h2 = b.column(0).to_numpy().view(U), b.column(1).to_numpy().view(U)
            for p in level.positions(h1, h2):
                yield pa.RecordBatch.from_arrays([pa.array(p >> 6), pa.array((U(1) << (p & 63).astype(U)).view(np.int64))],
                                                 names=["word", "mask"])

    return keys.select("h1", "h2").mapInArrow(run, "word bigint, mask bigint").groupBy("word").agg(F.bit_or("mask").alias("mask"))


def _held(keys: DataFrame, level: Level) -> DataFrame:
    sent = keys.sparkSession.sparkContext.broadcast(astuple(level))   # plain: workers need not have this package

    def run(batches):
        here = Level(*sent.value)
        for b in batches:
            h1, h2 = b.column(0).to_numpy().view(U), b.column(1).to_numpy().view(U)
            yield b.filter(pa.array(here.holds(h1, h2)))

    return keys.select("h1", "h2", "listed").mapInArrow(run, "h1 bigint, h2 bigint, listed boolean")


def listed_key(host: Column, words: tuple[str, ...]) -> Column:
    return host.rlike(f"(^|[.-])({'|'.join(words)})([.-]|$)")


def hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key, F.lit(1)), F.xxhash64(F.lit(2), key)


def listed_udf(sent):
    @F.pandas_udf(BooleanType())
    def is_listed(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(in_cascade([Level(*x) for x in sent.value], a.to_numpy().view(U), b.to_numpy().view(U)))

    return is_listed


def judge(pages: DataFrame, id_col: str = "page_id", url: str = "url", *, rules: tuple[UrlRule, ...] = RULES,
          listed_words: tuple[str, ...] = LISTED_WORDS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict (allow or block)."""
    src = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    h1, h2 = hashes(F.concat("host", "path"))
    src = src.withColumn("h1", h1).withColumn("h2", h2)
    keys = src.groupBy("h1", "h2").agg(F.bool_or(listed_key(F.col("host"), listed_words)).alias("listed"))
    keys = written(keys, "url-keys")
    n, listed = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("listed").cast("long")), F.lit(0))).first()
    size = level_shape(max(listed, 1), n - listed, True)[0] / 8 + listed  # level 1, and the rest generously
    groups = max(1, math.ceil(size / max_bytes))
    out = None
    for g in range(groups):
        mine = F.pmod(F.col("h2"), F.lit(groups)) == g
        levels = build_cascade(keys.where(mine))
        probe = listed_udf(src.sparkSession.sparkContext.broadcast([astuple(x) for x in levels]))
        part = (src if groups == 1 else src.where(mine)).withColumn("listed", probe("h1", "h2"))
        out = part if out is None else out.unionByName(part)
    best = best_rule(F.col("host"), F.col("path"), rules)
    out = out.withColumn("best", best)
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(
        F.col("best.verdict"), F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))
