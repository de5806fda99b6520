"""License scan: a trained paragraph classifier confirmed by templates (native).

Paragraphs are blocks of lines between blank lines, joined without their comment marks, so wrapped
notices are whole; a line of a block is also a paragraph of its own. They become word 1- and 2-grams, hashed into ``FEATURES`` indices and weighted by
1 / sqrt(number of grams). A multinomial logistic regression (``pyspark.ml``) over the license
families and ``none`` is fitted on a bounded sample of labelled rows: the templates below with
their halves, alone and beside ordinary sentences, and paragraphs of at most ``SAMPLE`` documents
(chosen by hash) without a license word, labelled ``none``. A fifth of the rows is held out to
calibrate: the temperature with the least log-loss scales the logits.

Scoring reads all documents. Its main path is DataFrame expressions: grams join the weight
table (``FEATURES`` rows, a fixed bound), sums give the logits of a paragraph. A paragraph whose
calibrated probability of ``none`` is below one half is a license paragraph. It is confirmed if
the likeliest family has at least ``SURE`` and the paragraph holds at least ``CONTAINED`` of the
2-grams of one of its templates; otherwise its family is ``unknown``.

A block stands for its lines (at its first line) if it is confirmed for a family that none of its
lines is confirmed for, or if no line is a license paragraph; else its lines are given.

Only paragraphs with a license word (``ANCHOR``) are license paragraphs by definition, and every
template has one; that test comes first.

Defined cases: null and blank texts have no paragraphs. Repeated rows are scanned each. Extra
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqwright.llm.common import written

FEATURES = 2048
SAMPLE = 200
SURE = 0.5
CONTAINED = 0.6
TEMPERATURES = tuple(0.05 * 1.25 ** i for i in range(20))

# Words that mark license paragraphs.
ANCHOR = (r"(?i)(licen[cs]|copyright|\(c\) ?[12]|all rights reserved|permission is hereby|redistribution and use|"
          r"without warrant|public domain|\bgpl|\bcc[ -]by\b|\bcc0\b|creative commons|mozilla public|permission to use)")

# A word of each alternative of ANCHOR, which a line break cannot cut.
ANCHOR_WORD = r"(?i)(licen[cs]|copyright|\(c\)|rights|permission|redistribution|warrant|public|\bgpl|\bcc|creative|mozilla)"

# Comment marks around a line.
MARKS = r"(?i)^(?:[\s/*#;%!<>|-]|(?:dnl|rem)\s)+|[\s/*#<>|-]+$"

# Sentences of well-known license notices, by family.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on "
        "an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License version 2 as published by the Free Software Foundation.",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation.",
    ),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.",),
    "BSD": (
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    ),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, Version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC0": (
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ),
    "Proprietary": ("Copyright. All rights reserved.", "All rights reserved. No part of this work may be reproduced without written "
                    "permission of the copyright holder."),
}

# Sentences with license words that are no license.
OTHER = (
    "The driver showed the officer a licence and drove on.",
    "They applied for a fishing license last summer and waited for weeks.",
    "A license is a document that grants permission.",
    "The court discussed whether copyright lasts too long.",
    "He got permission to use the kitchen in the evening.",
    "Her licence to practise medicine was renewed in spring.",
    "The new law changes how copyright works in schools.",
    "Pubs need a licence to sell drinks after ten.",
    "The map has been in the public domain for a century.",
    "You buy a license for each seat and renew it every year.",
)
NONE = "none"
FAMILIES = (*TEMPLATES, NONE)


def tokens(text: Column) -> Column:
    t = F.btrim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def grams(w: str) -> Column:
    """Word 1- and 2-grams of a token array column."""
    return F.expr(f"concat({w}, {pairs_sql(w)})")


def pairs_sql(w: str) -> str:
    return (f"if(size({w}) < 2, cast(array() as array<string>),"
            f" transform(sequence(1, size({w}) - 1), i -> concat_ws(' ', get({w}, i - 1), get({w}, i))))")


def index_of(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(FEATURES)).cast("int")


def _literal_rows(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    one = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows])
    return spark.range(1).select(F.inline(one))


def templates(spark: SparkSession) -> DataFrame:
    """(family, template): one row per template sentence."""
    return _literal_rows(spark, [(f, t) for f, ts in TEMPLATES.items() for t in ts], ["family", "template"])


def labelled(docs: DataFrame, text: str, sample: int) -> DataFrame:
    """(par, label, held): the training rows; at most ``sample`` documents are read for ``none``."""
    spark = docs.sparkSession
    some = docs.select(F.col(text).alias("t")).where("t is not null").orderBy(F.xxhash64("t"), "t").limit(sample)
    plain = some.select(F.explode(F.split("t", "\n")).alias("par")).where(~F.col("par").rlike(ANCHOR) & (F.btrim("par") != ""))
    plain = plain.select(F.array_join(F.slice(F.split("par", " +"), 1, 40), " ").alias("par")).distinct()
    plain = written(plain.orderBy(F.xxhash64("par"), "par").limit(4 * sample), "license-plain")
    other = _literal_rows(spark, [(x,) for x in OTHER], ["par"])
    none = plain.unionByName(other).withColumn("label", F.lit(NONE))
    t = templates(spark)
    w = F.split("template", " ")
    half = t.where(F.size(w) >= 12).select("family", F.explode(F.array(
        F.array_join(F.slice(w, 1, (F.size(w) / 2).cast("int")), " "),
        F.array_join(F.slice(w, (F.size(w) / 2).cast("int") + 1, F.size(w)), " "))).alias("template"))
    t = t.unionByName(half)
    # beside ordinary sentences: a template with one of 8 plain paragraphs before or after it
    beside = plain.withColumn("k", F.pmod(F.xxhash64("par"), F.lit(8)).cast("int")).groupBy("k").agg(F.min("par").alias("p"))
    mixed = t.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7)))).join(F.broadcast(beside), "k")
    mixed = mixed.select("family", F.when(F.col("k") % 2 == 0, F.concat_ws(" ", "template", "p")).otherwise(
        F.concat_ws(" ", "p", "template")).alias("template"))
    full = t.unionByName(t).unionByName(mixed).select(F.col("template").alias("par"), F.col("family").alias("label"))
    rows = full.unionByName(none)
    return written(rows.withColumn("held", F.pmod(F.xxhash64("par", F.lit(3)), F.lit(5)) == 0), "license-rows")


@dataclass(frozen=True)
class Model:
    weights: list[list[float]]  # one row per feature, one number per family
    bias: list[float]
    temperature: float


def vectors(rows: DataFrame) -> DataFrame:
    """Training rows with a sparse feature vector."""
    from pyspark.ml.feature import CountVectorizerModel

    d = rows.withColumn("w", tokens(F.col("par"))).withColumn("g", grams("w"))
    d = d.where(F.size("g") > 0).withColumn("terms", F.transform("g", lambda x: index_of(x).cast("string")))
    # the vocabulary is the list of indices, so a term's position is its index
    cv = CountVectorizerModel.from_vocabulary([str(i) for i in range(FEATURES)], "terms", "counts")
    return cv.transform(d)


def train(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Model:
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import Normalizer

    rows = labelled(docs, text, sample)
    label = F.array_position(F.array(*[F.lit(f) for f in FAMILIES]), F.col("label")) - 1
    data = vectors(rows).withColumn("y", label.cast("double")).select("counts", "y", "held", "par")
    # counts scaled by their sum's square root, as in scoring, come close to unit length
    data = Normalizer(inputCol="counts", outputCol="x", p=2.0).transform(data).coalesce(4)
    fit = LogisticRegression(featuresCol="x", labelCol="y", family="multinomial", regParam=1e-3, maxIter=60).fit(
        data.where("not held"))
    matrix, bias = fit.coefficientMatrix.toArray(), fit.interceptVector.toArray()
    have = matrix.shape[0]  # families whose rows are all held out have no row
    weights = [[float(matrix[k][j]) if k < have else 0.0 for k in range(len(FAMILIES))] for j in range(FEATURES)]
    offsets = [float(bias[k]) if k < have else -30.0 for k in range(len(FAMILIES))]
    model = Model(weights, offsets, 1.0)
    held = logits(rows.where("held").select("par", F.col("label")).withColumn("key", F.monotonically_increasing_id()), model, ["key", "label"])
    y = F.array_position(F.array(*[F.lit(f) for f in FAMILIES]), F.col("label")).cast("int")
    losses = [F.avg(-F.log(F.greatest(F.element_at(softmax("z", t), y), F.lit(1e-12)))).alias(f"t{i}") for i, t in enumerate(TEMPERATURES)]
    got = held.agg(*losses).first()
    best = min(range(len(TEMPERATURES)), key=lambda i: got[i] if got[i] is not None else 0.0)
    return Model(weights, offsets, TEMPERATURES[best])


def softmax(z: str, temperature: float) -> Column:
    e = F.transform(z, lambda v: F.exp((v - F.array_max(z)) / temperature))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, x: a + x))


def logits(pars: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """``keys`` and z (one logit per family) of paragraphs (``par``)."""
    spark = pars.sparkSession
    schema = "idx int, " + ", ".join(f"w{k} double" for k in range(len(FAMILIES)))
    table = F.broadcast(spark.createDataFrame([(j, *row) for j, row in enumerate(model.weights)], schema))  # FEATURES rows
    d = pars.withColumn("_w", tokens(F.col("par"))).withColumn("_g", grams("_w"))
    # counts of a paragraph's indices, scaled to unit length like the training vectors
    d = d.select(*keys, F.explode_outer(F.transform("_g", index_of)).alias("idx"))
    d = d.groupBy(*keys, "idx").agg(F.count("idx").alias("n")).join(table, "idx", "left")
    agg = [F.sum(F.col("n") * F.col(f"w{k}")).alias(f"s{k}") for k in range(len(FAMILIES))]
    d = d.groupBy(*keys).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"), *agg)
    z = [F.coalesce(F.col(f"s{k}") / F.col("norm"), F.lit(0.0)) + F.lit(model.bias[k]) for k in range(len(FAMILIES))]
    return d.select(*keys, F.array(*z).alias("z"))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", *, model: Model | None = None) -> DataFrame:
    """One row per license paragraph: doc_id, paragraph (its first line's number from 0), family,
    predicted, probability, similarity, confirmed."""
    model = model or train(docs, text)
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("t")).where(F.col("t").rlike(ANCHOR_WORD))
    d = d.select("doc_id", F.monotonically_increasing_id().alias("r"), F.split("t", "\n").alias("lines"))
    d = d.withColumn("s", F.transform("lines", lambda x: F.when(x.rlike("[\\p{L}\\p{N}]"), F.regexp_replace(x, MARKS, "")).otherwise("")))
    # a block runs from a line after a blank one to a line before a blank one
    edge = "filter(sequence(0, size(s) - 1), i -> get(s, i) != '' and coalesce(get(s, i {}), '') = '')"
    d = d.withColumn("b", F.expr(f"zip_with({edge.format('- 1')}, {edge.format('+ 1')}, (x, y) -> named_struct("
                                 "'first', x, 'block', array_join(slice(s, x + 1, y - x + 1), ' '), 'lines', slice(lines, x + 1, y - x + 1)))"))
    d = d.select("doc_id", "r", F.inline("b")).where(F.col("block").rlike(ANCHOR))
    one = F.transform("lines", lambda x, i: F.struct((F.col("first") + i).alias("paragraph"), x.alias("par"), F.lit(False).alias("whole")))
    block = F.array(F.struct(F.col("first").alias("paragraph"), F.col("block").alias("par"), F.lit(True).alias("whole")))
    d = d.select("doc_id", "r", "first", F.inline(F.concat(F.filter(one, lambda x: x["par"].rlike(ANCHOR)),
                                                           F.when(F.size("lines") > 1, block).otherwise(F.array_except(block, block)))))
    # a paragraph goes by 16 bytes of hash from here on, its text is not repeated beside every word
    d = written(d.withColumn("key", F.unhex(F.md5("par"))), "license-paragraphs")
    # repeated notices are classified once
    once = written(d.groupBy("key").agg(F.first("par").alias("par")), "license-texts")
    z = logits(once, model, ["key"])
    p = z.withColumn("p", softmax("z", model.temperature)).select("key", "p")
    none = len(FAMILIES)
    best = F.array_max(F.slice("p", 1, none - 1))
    p = p.select("key", best.alias("probability"), F.element_at("p", none).alias("p_none"),
                 F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), F.array_position("p", best).cast("int")).alias("predicted"))
    p = p.where("p_none < 0.5").join(once, "key")
    t = templates(spark).withColumn("w", tokens(F.col("template"))).select(
        F.col("family").alias("predicted"), F.expr(f"array_distinct({pairs_sql('w')})").alias("tg"))
    p = p.withColumn("w", tokens(F.col("par"))).withColumn("pg", F.expr(pairs_sql("w")))
    p = p.join(F.broadcast(t), "predicted").withColumn("s", F.size(F.array_intersect("pg", "tg")) / F.size("tg"))
    p = p.groupBy("key", "predicted", "probability").agg(F.max("s").alias("similarity"))
    sure = (F.col("probability") >= SURE) & (F.col("similarity") >= CONTAINED)
    p = p.withColumn("confirmed", sure).withColumn("family", F.when(sure, F.col("predicted")).otherwise("unknown"))
    # a block or its lines
    of_block = Window.partitionBy("r", "first")
    d = d.join(p, "key").withColumn("of_lines", F.collect_set(F.when(~F.col("whole") & F.col("confirmed"), F.col("predicted"))).over(of_block))
    d = d.withColumn("n_lines", F.count(F.when(~F.col("whole"), True)).over(of_block))
    stands = F.col("whole") & F.when(F.col("confirmed"), ~F.array_contains("of_lines", F.col("predicted"))).otherwise(F.col("n_lines") == 0)
    d = d.withColumn("stands", stands).withColumn("settled", F.max("stands").over(of_block))
    d = d.where(F.col("stands") | ~F.col("whole") & (F.col("confirmed") | ~F.col("settled")))
    return d.select("doc_id", F.col("paragraph").cast("bigint").alias("paragraph"), "family", "predicted",
                    F.round("probability", 4).alias("probability"), F.round("similarity", 4).alias("similarity"),
                    "confirmed")
