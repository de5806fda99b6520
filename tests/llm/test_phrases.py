"""Collocations against plain counting, with samples that hold everything, a part or nothing."""

import re
from collections import Counter

import numpy as np
import pytest

from seqwright.llm import phrases as P

SCHEMA = "doc_id bigint, text string, lang string, n string, phrase int, a int, score string"


def brute(rows, min_count, contained=100, top=None):
    out = []
    langs = {}
    for _, text, lang, *_ in rows:
        f, total = langs.setdefault("und" if lang is None else lang, (Counter(), Counter()))
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            total["n"] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[tuple(w[i:i + k])] += 1
    for lang, (f, total) in langs.items():
        cand = {p: c for p, c in f.items() if len(p) > 1 and c >= min_count}
        found = []
        for p, a in cand.items():
            longer = [q for q in cand if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))]
            if any(100 * cand[q] >= contained * a for q in longer):
                continue
            cuts = [(1000 * a * total["n"] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total["n"], -s))
    return sorted(out)


def texts():
    rng = np.random.default_rng(3)
    vocab = ["the", "of", "New", "new", "york", "is", "big", "é", "日本", "a b", "x\x00y"]
    out = [None, "", " \t\n.,;", "one", "a.b", "New York is big. new\tyork  is big\nNew York; is big " * 3]
    for i in range(60):
        words = [vocab[int(j)] for j in rng.zipf(1.6, 40) % len(vocab)]
        marks = rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\r\n"], 40)
        out.append("".join(w + m for w, m in zip(words, marks)))
    out.append(("the big new york " * 500) + "." + "of the " * 300)
    return [(i, t, [None, "en", "fr"][i % 3], "x", 1, 2, "y") for i, t in enumerate(out)]


@pytest.mark.parametrize("min_count,every,long_", [(4, 2, None), (4, 1, 64), (3, 10**9, None), (4, 3, 200)])
def test_equals_plain_counting(spark, monkeypatch, min_count, every, long_):
    if long_:
        monkeypatch.setattr(P, "LONG", long_)
    rows = texts()
    rows.append(rows[5])
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in P.collocations(df, min_count=min_count, sample_every=every, top=None).collect())
    assert got == brute(rows, min_count) and got
    got = sorted(tuple(r) for r in P.collocations(df, min_count=min_count, sample_every=every, top=7, contained=60).collect())
    assert got == brute(rows, min_count, 60, 7)


def test_border_failures_are_expanded_until_closed(spark):
    """Without any sampled row nothing is proposed: only words are counted at first, and each pass adds a word."""
    rows = texts()
    from pyspark.sql import functions as F

    src = spark.createDataFrame(rows, SCHEMA).select(
        F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("lang").alias("lang_hash"), F.lit(False).alias("sampled"))
    _, passes = P.closed_set(src, 4, 5, 16, 4)
    assert 3 <= passes <= 4
    _, passes = P.closed_set(src.withColumn("sampled", F.lit(True)), 4, 5, 1, 4)
    assert passes == 0


def test_small_flushes_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(P, "FLUSH", 50)
    monkeypatch.setattr(P, "FLUSH_PHRASES", 5)
    monkeypatch.setattr(P, "RANGE_TEXT", 100)
    rows = texts()
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(tuple(r) for r in P.collocations(df, min_count=4, sample_every=2).collect()) == brute(rows, 4, top=2000)
    assert P.collocations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_scores_beyond_64_bits(spark):
    """1000 * a * n passes 2**63: the division must be exact all the same."""
    big = 3_000_000_000_000_001
    c = spark.createDataFrame([("en", 0, "", 5 * big), ("en", 1, "x", big), ("en", 1, "y", big), ("en", 2, "x y", big - 7)],
                              "lang string, n int, phrase string, c bigint")
    import unittest.mock as m

    with m.patch.object(P, "counted", lambda *a, **k: c):
        r = P.collocations(c).collect()[0]
    assert r.score == 1000 * (big - 7) * 5 * big // (big * big)
