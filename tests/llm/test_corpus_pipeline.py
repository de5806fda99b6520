"""The corpus pipeline, stage by stage against brute force over the given documents, and as a whole."""

import hashlib
import math
import os
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as P
from seqwright.llm import quality_rules, token_shards
from seqwright.llm.common import table, written

from conftest import SF001

WORD = re.compile("[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of every stage, each written and read as the pipeline does."""
    docs, out = table(spark, SF001, "documents"), []
    for name, stage in P.STAGES:
        after = written(stage(spark, docs, SF001), "test-stage")
        out.append((name, docs, after))
        docs = after
    return out


def texts(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


def test_stages_are_the_five_in_order(stages):
    assert [s[0] for s in stages] == ["quality rules", "near-duplicates", "benchmark decontamination", "source mix", "token shards"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns


def test_quality(stages):
    _, before, after = stages[0]
    want = set()
    for i, t in texts(before).items():
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        seen = Counter(zip(w, w[1:], w[2:]))
        rep = {p for k in range(len(w) - 2) if seen[w[k], w[k + 1], w[k + 2]] > 1 for p in (k, k + 1, k + 2)}
        stop = {x for x in w if x.lower() in quality_rules.STOP_WORDS and x in (x.lower(), x.capitalize())}
        n = len(w)
        if n >= 50 and 100 * len(rep) <= 50 * n and 2 * n <= sum(map(len, w)) <= 15 * n and len(re.findall(r"[#*$%&|<>]", t)) <= 0.25 * n \
                and stop and len(lines) - len(set(lines)) <= 0.5 * len(lines) and n >= 1.5 * len(lines):
            want.add(i)
    assert set(texts(after)) == want and len(want) > 50


def test_one_document_of_each_group_stays(stages):
    _, before, after = stages[1]
    sets = {}
    for i, t in texts(before).items():
        w = WORD.findall(lower(t))
        sets[i] = frozenset(tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4)))
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    assert sorted(texts(after)) == sorted({find(i) for i in ids})
    assert len({find(i) for i in ids}) < len(ids)


def test_benchmark_documents_go_and_clean_ones_stay(spark, stages):
    _, before, after = stages[2]
    items = [re.findall(r"[^\W_]+", (r.text or "").lower()) for r in table(spark, SF001, "benchmark").collect()]
    grams = {tuple(w[j:j + 3]) for w in items for j in range(len(w) - 2)}
    kept = set(texts(after))
    gone = 0
    for i, t in texts(before).items():
        w = re.findall(r"[^\W_]+", t.lower())
        joined = " " + " ".join(w) + " "
        if any(len(x) >= 8 and " " + " ".join(x) + " " in joined for x in items):
            assert i not in kept, i
            gone += 1
        elif not any(tuple(w[j:j + 3]) in grams for j in range(len(w) - 2)):
            assert i in kept, i
    assert gone


def test_mixture_meets_its_targets(stages):
    _, before, after = stages[3]
    size = lambda t: len(WORD.findall(t or ""))
    words, source = {}, {}
    for r in before.select("doc_id", "text", "source").collect():
        words[r.doc_id], source[r.doc_id] = size(r.text), r.source
    per = Counter()
    for i, n in words.items():
        per[source[i]] += n
    names = sorted(per, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, rest = {}, set(names), sum(per.values())
    while left:   # water filling, plainly
        level = rest / sum(weight[s] for s in left)
        full = {s for s in left if level * weight[s] >= 3 * per[s]}
        for s in full or left:
            target[s] = 3 * per[s] if full else level * weight[s]
        rest -= sum(target[s] for s in full)
        left -= full or left
    took, copies = Counter(), Counter()
    for r in after.select("doc_id", "text", "source").collect():
        took[r.source] += size(r.text)
        copies[r.doc_id] += 1
    assert max(copies.values()) <= 3 and set(copies) <= set(words)
    longest = max(words.values())
    for s in names:   # the document with the cut is given whole
        assert 0 <= took[s] - round(target[s]) <= longest or math.isclose(took[s], target[s], abs_tol=1), (s, took[s], target[s])


def test_shards_hold_every_sequence_in_the_permuted_order(stages):
    _, before, after = stages[4]
    enc = token_shards.Encoder(open(token_shards.VOCABULARY, "rb").read())
    want = Counter()
    for r in before.select("doc_id", "text").collect():
        ids = [*enc.encode(r.text or ""), token_shards.END_ID]
        for k in range(0, len(ids), 512):
            part = ids[k:k + 512]
            raw = np.array(part + [token_shards.END_ID] * (512 - len(part)), "<u2").tobytes()
            want[r.doc_id, k // 512, len(part), hashlib.sha256(raw).hexdigest()] += 1
    rows = after.collect()
    assert Counter((r.doc_id, r.part, r.n_tokens, r.sha256) for r in rows) == want
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert [r.slot for r in rows] != sorted(r.slot for r in rows) or len(rows) < 3


def test_run_gives_the_last_stage_and_keeps_no_stage_table(spark, stages):
    base = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(base))
    got = P.run(spark, SF001)
    cols = ["doc_id", "part", "slot", "n_tokens", "sha256"]
    assert got.count() == stages[-1][2].count()
    assert Counter((r.doc_id, r.part, r.n_tokens, r.sha256) for r in got.select(*cols).collect()) == Counter(
        (r.doc_id, r.part, r.n_tokens, r.sha256) for r in stages[-1][2].select(*cols).collect())
    left = {n.rsplit("-", 1)[0] for n in set(os.listdir(base)) - before}
    assert left <= {"token-shards", "stage-token-shards"}, left
