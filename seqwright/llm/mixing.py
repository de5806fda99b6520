"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (native).

Each document gets a seeded key; ``blocks`` (a parameter) key ranges per source are the units
of the draw. A source's target is water-filled from the weights (``targets``); it takes whole
passes over its blocks and then blocks in a seeded permuted order until its words are reached.
The block quotas of all sources are split over the output shards by a binary tree
(``split_quotas``): at each node the blocks that go left are drawn without replacement, one
urn draw per block, so the counts are multivariate hypergeometric and sum up exactly. A
shard's blocks of a source are a run of that source's permuted blocks, so shards are disjoint;
inside a shard rows are ordered by a seeded key.

Everything is DataFrame or SQL expressions. The text is read once; only (id, source, size,
key) rows are kept. Tables by block or source have at most ``blocks`` x sources rows. A hot
source spreads over its blocks. The cut falls inside one block of a source; only that block's
rows are numbered one by one, a 1/``blocks`` part of the source.

Defined cases: a null or blank text has size 0 and ``taken`` 0. A null source is a source of
its own, last in order. Rows that are equal in id, source and size are treated alike (both
count). Extra columns are carried by ``mixed``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqwright.llm.common import SEPARATORS, fresh, md5_number, written

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BLOCKS = 1024
SHARDS = 16
PIECE_WORDS = 1 << 23   # words of a shard in one output partition, about


def n_words(text: Column) -> Column:
    """Number of words of a text (null: 0): each word with the separators after it becomes one
    character."""
    t = F.ltrim(F.coalesce(text, F.lit("")), F.lit(SEPARATORS))
    return F.char_length(F.regexp_replace(t, "[^\\x20\\x09-\\x0D]++[\\x20\\x09-\\x0D]*+", "x")).cast("bigint")


def sized(df: DataFrame, id_col: str, text: str, source: str, seed: int, blocks: int) -> DataFrame:
    """(doc_id, source, size, key, block), one row per document, written once."""
    key = md5_number(str(seed), F.col(id_col))
    out = df.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"),
                    key.alias("key"))
    return written(out.withColumn("block", (F.col("key") % blocks).cast("int")), "mix-sizes")


def targets(block_table: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """(source, ord, source_size, target): weights repeat over the sources in code-point order,
    null last. Windows run over one row per source."""
    per = block_table.groupBy("source").agg(F.sum("words").alias("source_size"))
    one = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("ord", F.row_number().over(one) - 1)
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("ord") % len(weights) + 1).cast("int"))
    per = per.withColumn("w", w.cast("bigint")).withColumn("cap", F.col("source_size") * max_epochs)
    # water filling: by rising cap per weight, a source is capped if the level without it reaches its cap
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("ord"))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
                         .cast("double") / F.sum("w").over(after).cast("double"))
    per = per.withColumn("capped", F.col("level") * F.col("w") >= F.col("cap"))
    # the level of the first source that is not capped holds for all after it
    level = F.max_by(F.when(~F.col("capped"), F.col("level")), F.when(~F.col("capped"), -F.col("cap") / F.col("w"))) \
        .over(everything)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(
        F.least(F.col("cap").cast("double"), level * F.col("w")))
    return per.select("source", "ord", "source_size", target.alias("target"))


def block_plan(block_table: DataFrame, target_table: DataFrame, seed: int) -> DataFrame:
    """(source, ord, block, words, rank, n_blocks, passes, extra): ``passes`` whole copies of the
    block, and of one more copy the first ``extra`` words."""
    b = block_table.join(target_table, block_table.source.eqNullSafe(target_table.source)).drop(target_table.source)
    per = Window.partitionBy("ord")
    order = per.orderBy(md5_number(str(seed), "block", F.col("ord"), F.col("block")), "block")
    before = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    passes = F.when(F.col("source_size") > 0, F.floor(F.round("target").cast("bigint") / F.col("source_size")))
    passes = F.coalesce(passes, F.lit(0)).cast("bigint")
    rest = F.round("target").cast("bigint") - passes * F.col("source_size")
    return b.select("source", "ord", "block", "words", (F.row_number().over(order) - 1).alias("rank"),
                    F.count(F.lit(1)).over(per).alias("n_blocks"), passes.alias("passes"),
                    F.greatest(F.lit(0), F.least(F.col("words"), rest - before)).alias("extra"))


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """From (ord, quota) the quota of each shard: (ord, ends), where ``ends[i]`` is where shard i's
    run of the source's draws ends. ``shards`` is a power of two; one row per tree node."""
    if shards & (shards - 1) or shards < 1:
        raise ValueError("shards must be a power of two")
    nodes = quotas.agg(F.array_sort(F.collect_list(F.struct("ord", "quota"))).alias("q")) \
        .select(F.lit(0).alias("node"), F.expr("transform(q, x -> x.quota)").alias("q"),
                F.expr("transform(q, x -> x.ord)").alias("ords"))
    level, width = 0, 1
    while width < shards:
        # For each source in turn and each of its blocks: it goes left with the chance (places left)/(blocks left).
        nodes = nodes.withColumn("total", F.expr("aggregate(q, 0L, (a, x) -> a + x)")).withColumn("f", F.expr(f"""
            aggregate(sequence(0, size(q) - 1),
              named_struct('need', total div 2, 'rest', total, 'lefts', cast(array() as array<bigint>)),
              (a, s) -> aggregate(
                if(q[s] > 0, sequence(1L, q[s]), cast(array() as array<bigint>)),
                named_struct('need', a.need, 'rest', a.rest, 'left', 0L),
                (b, i) -> named_struct(
                  'need', b.need - if(pmod(xxhash64({seed}, {level}, node, s, i), 1000000007L) * b.rest < b.need * 1000000007L, 1L, 0L),
                  'rest', b.rest - 1L,
                  'left', b.left + if(pmod(xxhash64({seed}, {level}, node, s, i), 1000000007L) * b.rest < b.need * 1000000007L, 1L, 0L)),
                b -> named_struct('need', b.need, 'rest', b.rest, 'lefts', concat(a.lefts, array(b.left)))))"""))
        nodes = nodes.select("ords", F.explode(F.expr(
            "array(named_struct('node', node * 2, 'q', f.lefts),"
            " named_struct('node', node * 2 + 1, 'q', zip_with(q, f.lefts, (x, y) -> x - y)))")).alias("n"))
        nodes = nodes.select("ords", "n.node", "n.q")
        level, width = level + 1, width * 2
    leaf = nodes.select(F.col("node").alias("shard"), F.explode(F.arrays_zip("ords", "q")).alias("z")) \
        .select("shard", F.col("z.ords").alias("ord"), F.col("z.q").alias("quota"))
    run = Window.partitionBy("ord").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    leaf = leaf.withColumn("end", F.sum("quota").over(run))
    return leaf.groupBy("ord").agg(F.expr("transform(array_sort(collect_list(struct(shard, end))), x -> x.end)").alias("ends"))


def draws(plan: DataFrame, shards: int, seed: int) -> DataFrame:
    """One row per drawn block copy: (source, block, words, take, shard). ``take`` is below
    ``words`` for the block that holds a source's cut."""
    each = plan.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("passes")))) \
        .withColumn("take", F.when(F.col("copy") < F.col("passes"), F.col("words")).otherwise(F.col("extra")))
    each = each.where((F.col("take") > 0) & (F.col("words") > 0))
    quotas = each.groupBy("ord").agg(F.count(F.lit(1)).alias("quota"))
    ends = split_quotas(quotas, shards, seed)
    run = Window.partitionBy("ord").orderBy("copy", "rank")
    each = each.withColumn("d", F.row_number().over(run) - 1).join(ends, "ord")
    return each.withColumn("shard", F.expr("size(filter(ends, e -> e <= d))")) \
        .select("source", "ord", "block", "copy", "words", "take", "shard")


def _planned(sizes, weights, max_epochs, shards, seed):
    block_table = sizes.groupBy("source", "block").agg(F.sum("size").alias("words"))
    block_table = written(block_table, "mix-blocks")
    target_table = written(targets(block_table, weights, max_epochs), "mix-targets")
    return target_table, written(draws(block_plan(block_table, target_table, seed), shards, seed), "mix-draws")


def _by_block(drawn: DataFrame) -> DataFrame:
    """Per drawn block (_s, _b): ``drawn``, its copies in order, and ``cut``, the words taken of the
    last copy if it is the block that holds the source's cut."""
    return drawn.groupBy("source", "block").agg(
        F.array_sort(F.collect_list(F.struct("copy", "shard", "take"))).alias("drawn"),
        F.max(F.when(F.col("take") < F.col("words"), F.col("take"))).alias("cut")) \
        .withColumnRenamed("source", "_s").withColumnRenamed("block", "_b")


def _cut_rows(sizes: DataFrame, per_block: DataFrame) -> DataFrame:
    """Rows of blocks that hold a cut, with ``last``, the words taken in the last copy."""
    d = sizes.join(per_block.where("cut is not null"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")))
    order = Window.partitionBy("source", "block").orderBy("key", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, -1)
    left = F.col("cut") - F.coalesce(F.sum("size").over(order), F.lit(0))
    return d.withColumn("last", F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), left)))


def mix(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", *,
        weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, blocks: int = BLOCKS,
        shards: int = SHARDS, seed: int = 17) -> DataFrame:
    """Per document: doc_id, source, size, key, source_size, target, taken (words the mix takes,
    repeats counted) and ``parts``, an array of (shard, copy, words) with one entry per draw.

    Every source's taken words are its target to the word (rounded): the last document drawn
    of a source is taken up to the cut.
    """
    sizes = sized(df, id_col, text, source, seed, blocks)
    target_table, drawn = _planned(sizes, weights, max_epochs, shards, seed)
    per_block = _by_block(drawn)
    d = sizes.join(per_block, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")), "left")
    # only rows of blocks with a cut are numbered; the others skip the window
    whole = d.where(F.col("cut").isNull()).withColumn("last", F.lit(None).cast("bigint"))
    d = whole.unionByName(_cut_rows(sizes, per_block)).drop("_s", "_b")
    n = F.size("drawn")
    copies = F.when(F.col("drawn").isNull(), 0).when(F.col("cut").isNull(), n).otherwise(n - 1).cast("bigint")
    d = d.withColumn("taken", copies * F.col("size") + F.coalesce(F.col("last"), F.lit(0)))
    # the cut copy is the block's last draw
    parts = F.expr("""transform(coalesce(drawn, array()), (x, i) -> named_struct('shard', x.shard, 'copy', x.copy,
        'words', if(cut is not null and i = size(drawn) - 1, last, size)))""")
    d = d.withColumn("parts", F.filter(parts, lambda x: x["words"] > 0)).drop("drawn", "cut", "last")
    t = target_table.withColumnRenamed("source", "_s").select("_s", "source_size", "target")
    t = F.broadcast(t) if t.count() <= 100_000 else t
    return d.join(t, F.col("source").eqNullSafe(F.col("_s"))) \
        .select("doc_id", "source", "size", "key", "source_size", "target", "taken", "parts")


def mixed(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", *,
          weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, blocks: int = BLOCKS,
          shards: int = SHARDS, seed: int = 17) -> DataFrame:
    """The mixture's rows: each document once per draw that takes words of it, with the input's
    columns plus ``shard``, in each shard ordered by a seeded key. A shard takes as many partitions, ranges
    of that key, as its words need. The document that holds a
    source's cut is given whole (documents are never cut here); blank documents are not given.

    The texts move once, to their shards: the block table (at most ``blocks`` rows a source)
    comes to them, and only rows of blocks with a cut are looked up one by one.
    """
    sizes = sized(df, id_col, text, source, seed, blocks)
    target_table, drawn = _planned(sizes, weights, max_epochs, shards, seed)
    words = target_table.agg(F.sum("target")).first()[0] or 0
    cut = max(0, int(words / (shards * PIECE_WORDS))).bit_length()   # bits of the key that number a shard's partitions
    per_block = written(_by_block(drawn), "mix-by-block")
    chosen = _cut_rows(sizes, per_block).where("last > 0").select("doc_id", "source", "size").distinct()
    # names that the input does not have: every column of it is carried along
    shard, key, copies, bs, bb, bd, bc, ci, cs, cz, place, part_id = fresh(
        df, "shard", "_key", "_copies", "_bs", "_bb", "_drawn", "_cut", "_ci", "_cs", "_cz", "_place", "_part")
    per_block = per_block.toDF(bs, bb, bd, bc)
    chosen = chosen.toDF(ci, cs, cz)
    d = df.withColumn(key, md5_number(str(seed), F.col(id_col))).where(n_words(F.col(text)) > 0)
    small = F.broadcast(per_block) if per_block.count() <= 200_000 else per_block
    d = d.join(small, F.col(source).eqNullSafe(F.col(bs)) & ((F.col(key) % blocks) == F.col(bb)))
    whole = d.where(F.col(bc).isNull()).withColumn(copies, F.col(bd))
    part = d.where(F.col(bc).isNotNull()).join(
        chosen, F.col(id_col).eqNullSafe(F.col(ci)) & F.col(source).eqNullSafe(F.col(cs))
        & (n_words(F.col(text)) == F.col(cz)), "left")
    part = part.withColumn(copies, F.when(F.col(cz).isNotNull(), F.col(bd)).otherwise(
        F.expr(f"slice({bd}, 1, size({bd}) - 1)")))
    keep = [*df.columns, key, copies]
    out = whole.select(*keep).unionByName(part.select(*keep)).withColumn(copies, F.explode(copies))
    out = out.withColumn(shard, F.col(copies)["shard"]).withColumn(place, F.xxhash64(key, F.col(copies)["copy"]))
    piece = F.shiftright(place, 64 - cut) + (1 << cut >> 1) if cut else F.lit(0)   # in the order of the key
    out = out.withColumn(part_id, (F.col(shard) * (1 << cut) + piece).cast("int"))
    return out.repartitionById(shards << cut, F.col(part_id)).sortWithinPartitions(shard, place, key) \
        .select(*df.columns, shard)
