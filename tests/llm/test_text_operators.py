"""The training-data operators against brute force on small fixtures, with the awkward inputs:
nulls, blank and long texts, repeated rows, empty tables and clashing extra columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqwright.llm import (decontaminate, html_text, licenses, lm_scoring, mixing, quality_rules, setsketch, suffix_dedup,
                           token_shards, url_filter)
from seqwright.llm import textnp as T

WORD = re.compile("[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, source string, size string, cut int, n_words string, _s int"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def prose(seed, n):
    rng = np.random.default_rng(seed)
    words = ["the", "of", "and", "to", *("".join(rng.choice(list("abcdefgh"), 4)) for _ in range(200))]
    return " ".join(words[int(i)] for i in rng.integers(0, len(words), n))


def texts():
    base = prose(1, 220)
    w = base.split(" ")
    out = [None, "", " \t\n ", "one", "two words", base, base, base.upper(), base + " tail", " ".join(w[:200]), " ".join(w[10:]),
           prose(2, 300), prose(3, 60) + " " + base[:450] + " " + prose(4, 40), "x " * 700, "a\nb\na\n\n a\nb", "é ü # * 1,5 " * 30,
           prose(5, 3000), "\x00" * 900, "z\x0bz\x0cz\u00a0z"]
    edited = list(w)
    for i in (3, 77, 150):
        edited[i] = "changed"
    return [*out, " ".join(edited)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"src{i % 3}" if i % 7 else None, "x", 1, "y", 2) for i, t in enumerate(texts())]
    rows.append(rows[5])  # a repeated row
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


# ---------------------------------------------------------------- 5
def test_quality_features_and_verdicts(docs, empty):
    got = by_id(quality_rules.verdicts(docs.select("doc_id", "text", "source")))
    for i, t in enumerate(texts()):
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        seen = Counter(zip(w, w[1:], w[2:]))
        rep = {p for k in range(len(w) - 2) if seen[w[k], w[k + 1], w[k + 2]] > 1 for p in (k, k + 1, k + 2)}
        for r in got[i]:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
                len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep)), i
            assert r.base_failed == (len(w) < 50 or 100 * len(rep) > 50 * len(w))
            assert not (r.base_failed and r.kept)
    assert [r.kept for r in got[5]] == [True, True]
    kept = quality_rules.keep_good(docs)  # columns that clash with the features stay as they are
    assert kept.columns == docs.columns and {5, 8, 11} <= {r.doc_id for r in kept.collect()}
    assert quality_rules.verdicts(empty).count() == 0


# ---------------------------------------------------------------- 4
def groups(k):
    sets = {}
    for i, t in enumerate(texts()):
        w = WORD.findall(lower(t or ""))
        sets[i] = frozenset(tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    root[a] = root[b] = min(root[a], root[b])
    return sets, root


@pytest.mark.parametrize("block", [1024, 2])
def test_near_duplicate_groups(docs, monkeypatch, block):
    monkeypatch.setattr(setsketch, "BLOCK", block)
    sets, root = groups(4)
    got = by_id(setsketch.near_duplicates(docs, k=4))
    assert {i: (r[0].n_shingles, r[0].component_id, r[0].kept) for i, r in got.items()} == {
        i: (len(sets[i]), root[i], root[i] == i) for i in sets}
    assert len(got[5]) == 2


def test_near_duplicates_keep_one(docs, empty):
    kept = setsketch.keep_one(docs, k=5)
    _, root = groups(5)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r for r in root.values()})
    assert setsketch.near_duplicates(empty).count() == 0


def test_registers_estimate_the_similarity():
    rng = np.random.default_rng(5)
    h = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    sets = [h[:1000], h[100:1100], h[500:1500], h[2000:3000]]
    row = np.repeat(np.arange(4), 1000)
    regs = setsketch.registers(np.concatenate(sets), row, 4).astype(int)
    for i, j in ((1, 900 / 1100), (2, 500 / 1500), (3, 0.0)):
        more, less = (regs[0] > regs[i]).sum(), (regs[0] < regs[i]).sum()
        got = setsketch.estimate(*(np.array([float(x)]) for x in (more, less, setsketch.M - more - less, 1000, 1000)))
        assert abs(got[0] - j) < 0.12


# ---------------------------------------------------------------- 3
@pytest.mark.parametrize("bucket_rows,unit_rows", [(20_000, 100_000), (2, 1)])
def test_repeated_strings(docs, monkeypatch, bucket_rows, unit_rows):
    monkeypatch.setattr(suffix_dedup, "BUCKET_ROWS", bucket_rows)
    monkeypatch.setattr(suffix_dedup, "UNIT_ROWS", unit_rows)
    all_texts = [(t or "").encode() for t in texts()]
    seen = Counter(t[p:p + 400] for t in [*all_texts, all_texts[5]] for p in range(len(t) - 399))
    got = by_id(suffix_dedup.remove_repeats(docs))
    for i, t in enumerate(all_texts):
        cover = np.zeros(len(t) + 1, int)
        for p in range(len(t) - 399):
            if seen[t[p:p + 400]] > 1:
                cover[p] += 1
                cover[p + 400] -= 1
        gone = np.cumsum(cover)[:len(t)] > 0
        left = bytes(np.frombuffer(t, np.uint8)[~gone])
        for r in got[i]:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (
                len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(left).hexdigest()), i


def test_repeated_windows_of_a_hot_gram(spark, monkeypatch):
    """Truncated copies of one passage: their contexts share a gram, and no call may hold all of them."""
    whole = suffix_dedup._window_hashes

    def few(ahead, back, *rest):
        assert len(ahead) <= 4, "the contexts of a gram were brought together"
        return whole(ahead, back, *rest)

    monkeypatch.setattr(suffix_dedup, "_window_hashes", few)
    monkeypatch.setattr(suffix_dedup, "UNIT_ROWS", 4)
    rng = np.random.default_rng(8)
    passage = prose(20, 300)[:900]
    all_texts = [prose(100 + i, 90) + " " + passage[a:a + int(rng.integers(300, 600))] + " " + prose(200 + i, 90)
                 for i, a in enumerate(rng.integers(0, 400, 60))]
    seen = Counter(t[p:p + 400] for t in all_texts for p in range(len(t) - 399))
    want = {i: len({x for p in range(len(t) - 399) if seen[t[p:p + 400]] > 1 for x in range(p, p + 400)})
            for i, t in enumerate(all_texts)}
    got = suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(all_texts)), "doc_id bigint, text string").repartition(1))
    assert {r.doc_id: r.n_removed for r in got.collect()} == want


def test_neighbours_of_a_gram_meet_over_other_grams(spark, monkeypatch):
    """Read backwards, a context of another gram may sort between two of the same; those are neighbours all the same."""
    rows = [(1, 1, 1, b"gram1aaaa", b"mnopA"), (-2, 2, 2, b"gram2bbbb", b"mnopB"), (1, 3, 3, b"gram1aacc", b"mnopC"),
            (-2, 4, 4, b"gram2bbdd", b"mnoqD"), (3, 5, 5, b"gram3", b"mnopB")]
    d = spark.createDataFrame(rows, "gram bigint, c1 bigint, c2 bigint, ahead binary, back binary").repartition(1)
    for bucket_rows in (100, 1):
        monkeypatch.setattr(suffix_dedup, "BUCKET_ROWS", bucket_rows)
        got = suffix_dedup.neighbours(d, "back", "ahead", 5, 9).collect()
        assert {r.c1: (r.best, r.other) for r in got} == {1: (4, 7), 3: (4, 7), 2: (3, 7), 4: (3, 7), 5: (-1, -1)}


def test_planted_passages_go_by_bytes_not_words(spark):
    """A passage of over 50 words that two documents share goes whole from 400 bytes on and stays below; ``n_bytes`` is
    the input's length either way."""
    rows, want = [], {}
    for i, (size, letter) in enumerate([(399, "a"), (400, "a"), (401, "a"), (900, "a"), (399, "é"), (400, "é")]):
        passage = prose(400 + i, 300).replace("a", letter).encode()[:size].decode(errors="ignore")
        passage += "q" * (size - len(passage.encode()))
        assert len(WORD.findall(passage)) > 50 and len(passage.encode()) == size
        for k, (a, b) in enumerate(("<>", "[]")):
            head, tail = prose(500 + 2 * i + k, 90) + a, b + prose(600 + 2 * i + k, 90)
            rows.append((2 * i + k, head + passage + tail))
            left = head + tail if size >= 400 else rows[-1][1]
            gone = size if size >= 400 else 0
            want[2 * i + k] = (len(rows[-1][1].encode()), gone, min(gone, 1), hashlib.sha256(left.encode()).hexdigest())
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()} == want


def test_repeated_strings_of_nothing(empty):
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_multikey_order_sorts_bytes():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 3, (500, 21)).astype(np.uint8)
    keys[100:200] = keys[:100]
    rows = [bytes(r) for r in keys]
    assert [rows[i] for i in suffix_dedup.multikey_order(keys)] == sorted(rows)


# ---------------------------------------------------------------- 1
@pytest.mark.parametrize("heavy,max_filter", [(1 << 23, 512 << 20), (20, 6000)])
def test_lm_scores(docs, monkeypatch, heavy, max_filter):
    """Base scores are exact, also when rare words meet their counts in the shuffle and the pairs'
    filter is sent in rounds; model scores are near those with exact counts."""
    monkeypatch.setattr(lm_scoring, "HEAVY", heavy)
    toks = {i: [*WORD.findall(lower(t or "")), None] for i, t in enumerate(texts())}
    rows = [*toks, 5]
    c, pairs, starts = Counter(), Counter(), 0
    for i in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(toks[i])
            pairs.update(zip([0, *toks[i]], toks[i]))
            starts += 1
    n, v = sum(c.values()), len(c)
    got = by_id(lm_scoring.score(docs, max_filter=max_filter))
    assert len(got[5]) == 2
    for i, w in toks.items():
        for r in got[i]:
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (
                zlib.crc32(str(i).encode()) % 7 == 2, len(w), sum(c[x] > 0 for x in w), n)
            assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
            mu = lm_scoring.MU
            exact = sum(math.log10((pairs[a, b] + mu * (c[b] + 1) / (n + v + 1)) / ((c[a] if a != 0 else starts) + mu))
                        for a, b in zip([0, *w], w))
            assert abs(r.score - exact) < 0.06 * abs(exact) + 0.2


def test_lm_scores_of_nothing(empty):
    assert lm_scoring.score(empty).count() == 0


def test_quantised_counts_come_back_from_the_filter():
    keys = T.mix(np.arange(5000, dtype=np.uint64) + np.uint64(9))
    n = np.where(np.arange(5000) % 10 == 0, 1000, 1 + np.arange(5000) % 3)
    bits, _ = lm_scoring.segment(keys, n)
    f = lm_scoring.Filter([(0, bits)], 1, 63)
    f.shift = 63
    f.start, f.size = np.zeros(2, np.int64), np.full(2, len(bits) * 8, np.uint64)
    got = f.counts(keys, 1)
    want = lm_scoring.count_of(lm_scoring.levels_of(n))
    assert (got >= want).all() and (got == want).mean() > 0.97
    assert (f.counts(T.mix(np.arange(20_000, dtype=np.uint64) << np.uint64(40)), 1) == 0).mean() > 0.97


# ---------------------------------------------------------------- 9
def test_decontamination(spark, docs, empty):
    bench = spark.createDataFrame([
        (1, "Every morning Anna walks 12 miles to the old mill and buys 3 loaves of fresh bread for 12 friends."),
        (2, None), (3, ""), (4, "Short item here."), (5, "A quite different question about rivers and the towns that stand on them.")],
        "item_id bigint, text string")
    rows = [
        (100, "noise before it. Every morning Anna walks 12 miles to the old mill and buys 3 loaves of fresh bread for 12 friends. after"),
        (101, "noise before. Every morning Bert walks 40 miles to the old mill and buys 9 loaves of fresh bread for 40 friends, after"),
        (102, "Every morning Bert walks 40 miles to the old mill and buys 40 loaves of fresh bread for 8 friends, after"),
        (103, "every evening she sails to the new harbour and sells fish"), (104, None), (105, ""),
        (106, "he read: short ITEM here, and left"), (107, "12 12 12 12 12 12 12 12 12 12 12 12 12 12"), (100, rows_text())]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("_i", F.lit(1))
    got = {(r.doc_id, r.item_id): r for r in decontaminate.matches(d, bench).collect()}
    assert (100, 1) in got and not got[100, 1].reparameterised and got[100, 1].share == 1
    assert (101, 1) in got and got[101, 1].reparameterised
    assert (106, 4) in got
    assert {k[0] for k in got} <= {100, 101, 102, 106}
    if (102, 1) in got:  # its slots do not map one to one: no re-parameterised window counts
        assert not got[102, 1].reparameterised
    left = decontaminate.clean(d, bench)
    assert left.columns == d.columns
    ids = [r.doc_id for r in left.collect()]
    assert ids.count(100) == 1 and {103, 104, 105, 107} <= set(ids) and not {101, 106} & set(ids)
    assert decontaminate.matches(d, bench.limit(0)).count() == 0
    assert decontaminate.matches(empty, bench).count() == 0


def test_decontamination_of_renamed_sentence_starts(spark):
    one = "Anna has 3 apples. Anna eats 1 apple. Anna buys 5 apples. How many apples has Anna?"
    two = '"McDonald grows 7 pears," says Mr. Miller. "Miller sells 2 pears to McDonald." How many pears are left?'
    bench = spark.createDataFrame([(1, one), (2, two)], "item_id bigint, text string")
    renamed = {"Anna": "Bob", "3": "8", "1": "2", "5": "9"}
    other = {"McDonald": "Smith", "Miller": "MacArthur", "7": "6", "2": "4"}
    first = re.sub(r"Anna|\d", lambda m: renamed[m[0]], one)
    second = re.sub(r"McDonald|Miller|\d", lambda m: other[m[0]], two)
    noise = "Bob came. The end. Bob left. The old apples. How are you? How nice. "
    rows = [(1, one), (2, first), (3, noise + first + " " + noise), (4, noise + one + " Anna slept."), (5, second),
            (6, first.replace("Bob buys", "Carl buys").replace("has Bob", "has Dora")),  # one name for three: no renaming
            (7, "Bob likes pears. How many pears does Bob like?")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.reparameterised for r in decontaminate.matches(d, bench).collect()}
    assert got == {(1, 1): False, (2, 1): True, (3, 1): True, (4, 1): False, (5, 2): True}
    assert sorted(r.doc_id for r in decontaminate.clean(d, bench).collect()) == [6, 7]


def rows_text():
    return "the same id but another text that has nothing to do with the benchmark at all"


# ---------------------------------------------------------------- 8
def test_mix_reaches_targets(docs, empty):
    got = [r for rows in by_id(mixing.mix(docs, shards=4)).values() for r in rows]
    per = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        assert sum(p["words"] for p in r.parts) == r.taken
        per.setdefault(r.source, []).append(r)
    total = sum(r.size for r in got)
    assert abs(sum(rows[0].target for rows in per.values()) - total) < 1e-6 * total
    for rows in per.values():
        assert sum(r.size for r in rows) == rows[0].source_size
        assert sum(r.taken for r in rows) == round(rows[0].target)
    assert sorted(map(tuple, mixing.mix(docs, shards=4).select("doc_id", "taken").collect())) == sorted((r.doc_id, r.taken) for r in got)
    mixed = mixing.mixed(docs, shards=4)
    assert mixed.columns == [*docs.columns, "shard"]
    want = Counter({})
    for r in got:
        want[r.doc_id] += len(r.parts)
    counts = Counter(r.doc_id for r in mixed.collect())
    assert all(counts[i] == n for i, n in want.items() if i != 5)
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_split_tree_keeps_every_quota(spark):
    quotas = spark.createDataFrame([(0, 100), (1, 7), (2, 53)], "ord int, quota bigint")
    ends = {r["ord"]: r["ends"] for r in mixing.split_quotas(quotas, 8, 1).collect()}
    assert {k: v[-1] for k, v in ends.items()} == {0: 100, 1: 7, 2: 53}
    sizes = [sum(np.diff([0, *v])[i] for v in ends.values()) for i in range(8)]
    assert sum(sizes) == 160 and max(sizes) - min(sizes) <= 1


# ---------------------------------------------------------------- 7
def test_token_shards_round_trip(spark, docs, empty, tmp_path):
    path = str(tmp_path / "shards")
    index, n, per_shard = token_shards.write_shards(docs, path, shard_bytes=10 * token_shards.STRIDE)
    rows = index.collect()
    assert sorted(r.slot for r in rows) == list(range(n)) and per_shard == 10
    enc = token_shards.Encoder(open(token_shards.VOCABULARY, "rb").read())
    ids = {r["slot"]: np.frombuffer(r["ids"], "<u2") for r in token_shards.read_shards(spark, path, per_shard).collect()}
    texts_ = dict(enumerate(texts()))
    for r in rows:
        whole = [*enc.encode(texts_[r.doc_id] or ""), token_shards.END_ID]
        part = whole[r.part * 512:(r.part + 1) * 512]
        assert r.n_tokens == len(part) and ids[r.slot].tolist() == part + [token_shards.END_ID] * (512 - len(part))
    later = token_shards.read_shards(spark, path, per_shard, from_slot=n - 3).collect()
    assert sorted(r["slot"] for r in later) == [n - 3, n - 2, n - 1]
    assert token_shards.materialised(empty).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 1000, 4097])
def test_permutation_is_one_to_one_and_inverts(n):
    x = np.arange(n)
    y = token_shards.permute(x, n, 11)
    assert sorted(y.tolist()) == list(range(n))
    assert (token_shards.permute(y, n, 11, back=True) == x.astype(np.uint64)).all()


def test_pieces_give_the_same_ids_as_whole_texts():
    enc = token_shards.Encoder(open(token_shards.VOCABULARY, "rb").read())
    rows = [*(t or "" for t in texts()), "it's  a b", "a \nb\n c", " lead", "trail ", "a\u00a0 b", "x\t y 's 12,5", " ", "  ", "", "a"]
    raw = [t.encode() for t in rows]
    offs = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    ids, counts = enc.slice(np.frombuffer(b"".join(raw), np.uint8), offs)
    for t, got in zip(rows, np.split(ids, np.cumsum(counts)[:-1])):
        assert got.tolist() == enc.encode(t), t
    assert (enc.slice(np.frombuffer(b"".join(raw), np.uint8), offs, only_counts=True)[1] == counts).all()


def test_null_ids_do_not_break_any_operator(spark):
    rows = [(None, prose(8, 90), None), (None, None, "s"), (3, prose(8, 90), "s")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    bench = spark.createDataFrame([(None, prose(8, 90)[:200]), (1, None)], "item_id bigint, text string")
    for got in (quality_rules.verdicts(d), setsketch.near_duplicates(d), suffix_dedup.remove_repeats(d), lm_scoring.score(d),
                mixing.mix(d), token_shards.materialised(d)):
        assert got.count() == 3
    assert decontaminate.matches(d, bench).count() == 2
    assert decontaminate.clean(d, bench).count() == 1
    assert setsketch.keep_one(d).count() == 2  # the text under its id, and the row without a text
    assert licenses.scan(d).count() == 0


# ---------------------------------------------------------------- 6
def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://a.org/x", "https://EXAMPLE.org/es/1?q", "http://m.example.org/en/19#a", "http://x.com/fr/",
            "http://x.com/de/1", "http://spam-farm.net/a", "http://spam-farm.net/a", "ftp://host.net", "http://h.net/a://b/c", "http://aorg/x",
            *(f"http://h{i}.net/{i}" for i in range(400)), *(f"http://bets{'.' if i % 2 else 'x'}h{i}.net/{i}" for i in range(60))]
    d = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id bigint, url string, host int")
    for max_bytes in (64 << 20, 40):
        for r in url_filter.judge(d, max_bytes=max_bytes).collect():
            u = urls[r.page_id] or ""
            rest = u.split("://", 1)[1] if "://" in u else ""
            host = lower(re.match("[^/?#]*", rest)[0])
            path = re.match("[^/?#]*([^?#]*)", rest)[1]
            fits = [x for x in url_filter.RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
            best = max(fits, key=lambda x: len(x.name), default=None)
            listed = bool(re.search(f"(^|[.-])({'|'.join(url_filter.LISTED_WORDS)})([.-]|$)", host))
            want = (host, path, best and best.name, best.verdict if best else "block" if listed else "allow")
            assert (r.host, r.path, r.rule, r.verdict) == want
    assert url_filter.judge(d.limit(0)).count() == 0


# ---------------------------------------------------------------- 10
def test_license_scan(spark, docs, empty):
    notices = {200: ("Some text.\nReleased under the MIT License.", "MIT"), 201: ("Licensed under CC BY-NC 4.0.", "CC-BY-NC"),
               202: ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
               203: ("x\ny\nLicensed under the Apache License, Version 2.0.", "Apache-2.0")}
    plain = {300: "The driver showed the officer a licence and drove on.", 301: None, 302: "", 303: "nothing of the kind " * 50}
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame(
        [(i, t) for i, (t, _) in notices.items()] + list(plain.items()), "doc_id bigint, text string"))
    got = {r.doc_id: r for r in licenses.scan(d).collect()}
    assert {i: got[i].family for i in notices} == {i: f for i, (_, f) in notices.items()}
    assert got[200].paragraph == 1 and got[203].paragraph == 2
    assert not [i for i in plain if i in got and got[i].confirmed]
    assert licenses.scan(empty).count() == 0
    assert all(re.search(licenses.ANCHOR[4:], t, re.I) for ts in licenses.TEMPLATES.values() for t in ts)


def test_license_scan_of_wrapped_notices(spark, docs):
    mit = ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation "
           "files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, "
           "modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, subject to the following conditions:")
    bsd = ("Redistribution\nand use in source and binary forms, with or without\nmodification, are permitted provided that the following "
           "conditions are met:")
    gpl = ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as "
           "published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.")
    notices = {400: (f"A title\n\n{mit}\n\nThe end", "MIT", 2),
               401: ("/*\n * A tool.\n *\n" + "\n".join(f" * {x}" for x in bsd.split("\n")) + "\n */\nint x;", "BSD", 3),
               402: ("\n".join(f"# {x}" for x in gpl.split("\n")) + "\r\n#\r\n\r\nimport os", "GPL-3.0", 0),
               403: ("dnl " + bsd.replace("\n", "\ndnl "), "BSD", 0)}
    d = spark.createDataFrame([(i, t) for i, (t, *_) in notices.items()], "doc_id bigint, text string")
    got = [(r.doc_id, r.family, r.paragraph) for r in licenses.scan(d, model=licenses.train(docs)).collect()]
    assert sorted(got) == [(i, f, n) for i, (_, f, n) in notices.items()]


# ---------------------------------------------------------------- 2
@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("<p>a<p>b", "a\n\nb"), ("<ul><li>x<li>y<ol start=3><li>k<li>l</ol></ul>z", "- x\n- y\n  3. k\n  4. l\n\nz"),
    ("<table><tr><th>n<td>two<tr><td>three<td>4</table>", "n     | two\nthree | 4"),
    ("a<script>x<p></script><style>y</style><!-- c --><div hidden>no</div><span style='display: none'>no</span>b", "ab"),
    ("<pre>a\n  b</pre>c", "a\n  b\n\nc"), ("f&amp;g&nbsp;<br>h  \n i", "f&g\u00a0\nh i"), ("<b>x<i>y</b>z</i> <p", "xyz <p"),
    ("<details><summary>s</summary>gone</details><details open><summary>t</summary>here</details>", "s\nt\nhere"),
    ("<div>" * 3000 + "deep", "deep"), ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a | b\n  | c")])
def test_html_text(page, text):
    assert html_text.to_text(page)[0] == text


@pytest.mark.parametrize("page,text", [
    ("<table><td>a</table>", "a"), ("<table><tbody><td>a<td>b<tr><td>c</table>", "a | b\nc"),
    *[(f"<table><{t}><tr><td>a<td>b<tr><td>c</{t}></table>z", "a | b\nc\n\nz") for t in ("form", "font", "a", "center", "div", "tbody><form")],
    ("x<table>in<tr>row<td>a</td>after<b>bold</b></tr><p>par</table>", "xinrowafterbold\n\npar\n\na"),
    ("<table style='display:none'>seen<tr><td>no</table>", "seen"), ("<table><colgroup><col>t<tr><td>a</table>", "t\n\na"),
    ("<table><tr><td>a<table><tr><td>b</table>c</table>", "a\n\nb\n\nc"), ("<table><tr><td>a<tr><table><td>b</table>", "a\n\nb"),
    ("<table><caption>t<tr><td>a<input type=hidden value=n></table>", "t\n\na"),
    ("a<textarea>\nb &amp;\n  c</textarea>d", "a\nb &\n  c\nd"), ("<xmp>a <b>\n c</xmp>d", "a <b>\n c\n\nd"),
    ("a<select><option>b<option selected>c</select>d", "a c d"), ("a<select><option disabled>b<option>c<option>e</select>d", "a c d"),
    ("<select multiple><option>a<optgroup label=g><option label=l>b</select>", "a l"), ("<select><option>a<input value=b>c", "a b c"),
    ("<math><semantics><mi>x</mi><mo>=</mo><mn>1</mn><annotation>tex</annotation></semantics></math>", "x=1"),
    ("a<svg>no<title>no</title><defs><text>no</text></defs><g><text>b<tspan>c</tspan></text><path/></g></svg>d", "a bc d"),
    ("<map><area>a</map>", "a")])
def test_html_text_in_tables_and_controls(page, text):
    assert html_text.to_text(page)[0] == text


def test_html_extract(spark):
    d = spark.createDataFrame([(1, "<p>a", 3), (1, "<p>a", 3), (2, None, 4)], "page_id bigint, html string, text int")
    assert sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract(d).collect()) == [(1, "a", 1), (1, "a", 1), (2, "", 0)]
    assert html_text.extract(d.limit(0)).count() == 0


def test_keep_one_keeps_exactly_one_row_of_each_group(spark):
    a, b = prose(8, 90), prose(9, 90)
    near = a.replace(a.split(" ")[50], "changed", 1)
    rows = [(5, a, "x"), (5, b, "x"), (None, a, "y"), (None, prose(10, 70), "z"), (7, near, "x"), (7, near, "w"), (8, b, "x"), (8, b, "x"), (None, None, "q")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, _row string")
    for part in (1, 3):
        got = sorted(map(str, setsketch.keep_one(d.repartition(part)).collect()))
        assert got == sorted(map(str, (spark.createDataFrame([rows[0], rows[1], rows[3], rows[8]], d.schema).collect())))
    two = d.where("doc_id = 7")  # rows that share id and text: one, the same on every run
    assert len({str(setsketch.keep_one(two.repartition(n)).collect()) for n in (1, 2, 3)}) == 1


def test_encoder_holds_a_bounded_cache(monkeypatch):
    monkeypatch.setattr(token_shards, "CACHE_BYTES", 1 << 18)
    enc = token_shards.Encoder(open(token_shards.VOCABULARY, "rb").read())
    rng = np.random.default_rng(0)
    for _ in range(30):
        t = " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(2000)) + " the of and"
        raw = np.frombuffer(t.encode(), np.uint8)
        ids, counts = enc.slice(raw, np.array([0, len(raw)]))
        assert ids.tolist() == enc.encode(t) and counts.tolist() == [len(ids)]
        assert enc.held_bytes() < 4 << 18


def test_encoder_finds_known_pieces_without_sorting(monkeypatch):
    enc = token_shards.Encoder(open(token_shards.VOCABULARY, "rb").read())
    t = prose(50, 3000)
    raw = np.frombuffer(t.encode(), np.uint8)
    first = enc.slice(raw, np.array([0, len(raw)]))[0]

    unique = np.unique

    def few(x, *args, **kwargs):
        assert len(x) < 100, "the pieces of a slice were sorted"
        return unique(x, *args, **kwargs)

    monkeypatch.setattr(np, "unique", few)
    assert enc.slice(raw, np.array([0, len(raw)]))[0].tolist() == first.tolist() == enc.encode(t)


def test_encoder_finds_pieces_whose_hashes_share_a_table_entry():
    enc = token_shards.Encoder(open(token_shards.VOCABULARY, "rb").read())
    low = np.array([(1 << 64) - 1, 5, 7], np.uint64) & np.uint64((1 << 30) - 1)
    keys = (np.arange(6000, dtype=np.uint64) << np.uint64(30)) | low[np.arange(6000) % 3]
    pieces = [b" w%d" % i for i in range(6000)]
    for lo in (0, 20, 300):
        hi = {0: 20, 20: 300, 300: 600}[lo]
        enc._learn(keys[lo:hi], pieces[lo:hi])
        i = enc._find(keys)
        assert (i[:hi] >= 0).all() and (i[hi:] < 0).all()
        for k in range(hi):
            assert enc.ids[enc.at[i[k]]:][:enc.size[i[k]]].tolist() == enc.encode(pieces[k].decode())


def test_unknown_words_cost_what_the_model_says_in_empty_buckets(spark):
    """One short training text: most buckets hold no pair, and every token of another text has its probability."""
    ids = {r: next(i for i in range(100) if (zlib.crc32(str(i).encode()) % 7 == 2) == r) for r in (True, False)}
    d = spark.createDataFrame([(ids[False], "one two"), (ids[True], "a b c d e f g h")], "doc_id bigint, text string").repartition(2)
    r = next(x for x in lm_scoring.score(d).collect() if x.held_out)
    p = 1 / (3 + 3 + 1)   # of a word that is not known; 3 tokens, 3 different ones
    want = 7 * math.log10(p) + math.log10(lm_scoring.MU * p / (1 + lm_scoring.MU)) + math.log10(2 / 7)
    assert abs(r.score - want) < 1e-6


def test_workers_need_not_have_the_package(tmp_path):
    """LM scores and the URL filter from a folder where only the driver finds the package."""
    import os
    import subprocess
    import sys

    from conftest import ROOT, SF001

    script = tmp_path / "run.py"
    script.write_text(f"""
import sys
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as E
from seqwright.session import build_session
spark = build_session("local[2]", 2, extra={{"spark.checkpoint.dir": {str(tmp_path / "shared")!r}}})
for q in ("op1_lm_scores", "op6_url_filter"):
    assert E.queries()[q](spark, {SF001!r}).count() > 0
""")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]


@pytest.mark.parametrize("piece", [300, 1000, 5000])
def test_long_texts_in_pieces_give_the_same_spans(spark, docs, monkeypatch, piece):
    """Texts above a piece's size are cut into overlapping pieces: same removals, whatever the size."""
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = sorted(map(tuple, suffix_dedup.remove_repeats(docs).select(*cols).collect()), key=str)
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    assert sorted(map(tuple, suffix_dedup.remove_repeats(docs).select(*cols).collect()), key=str) == want


def test_slices_of_a_long_text_have_the_anchors_of_the_whole(monkeypatch):
    rng = np.random.default_rng(4)
    for data in (rng.integers(97, 123, 9000).astype(np.uint8), np.zeros(5000, np.uint8), np.tile(rng.integers(97, 123, 50).astype(np.uint8), 100)):
        offs = np.array([0, len(data)])
        whole = suffix_dedup.anchors(data, offs, 400, 64)
        monkeypatch.setattr(suffix_dedup, "PIECE", 700)
        parts = list(suffix_dedup.anchor_pieces(data, offs, 400, 64))
        monkeypatch.undo()
        got = [np.concatenate([p[i] + (p[1] if i == 3 else 0) for p in parts]) for i in range(2, 9)]
        for a, b in zip(whole, got):
            assert a.tolist() == b.tolist()
