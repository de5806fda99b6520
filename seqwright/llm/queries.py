"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqwright.llm import (conversations, decontaminate, html_text, licenses, lm_scoring, mixing, phrases, quality_rules, setsketch,
                           suffix_dedup, token_shards, url_filter, warc)
from seqwright.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def _sql_list(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


# ---------------------------------------------------------------- 5 quality rules
QUALITY_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w,
        list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM w, unnest(range(1, len(w) - 1)) AS u(i)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM win) WHERE c >= 2),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY r),
f AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
        len(list_distinct(list_filter(w, lambda x: list_contains({_sql_list(
            x for y in quality_rules.STOP_WORDS for x in (y, y.capitalize()))}, x)))) AS n_stop
      FROM w LEFT JOIN cov USING (r)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND word_chars BETWEEN 2 * n_words AND 15 * n_words AND n_symbols <= 0.25 * n_words
    AND n_stop >= 1 AND n_dup_lines <= 0.5 * n_lines AND n_words >= 1.5 * n_lines AS kept
FROM v"""


@query("op5_quality_rules", QUALITY_SQL)
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules over every whole text."""
    v = quality_rules.verdicts(table(spark, sf_dir, "documents", "doc_id", "text"))
    return v.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", "kept")


# ---------------------------------------------------------------- 8 mixing sources to target weights
def _md5_sql(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 13) AS BIGINT)"


MIX_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    {_md5_sql("'17'", "coalesce(CAST(doc_id AS VARCHAR), '~')")} AS key FROM documents),
b AS (SELECT source, key % {mixing.BLOCKS} AS block, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY ALL),
p AS (SELECT source, CAST(sum(words) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS ord
      FROM b GROUP BY source),
q AS (SELECT *, CASE ord % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS cap FROM p),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, ord
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
        / CAST(sum(w) OVER (ORDER BY cap / w, ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM q),
c AS (SELECT *, level * w >= cap AS capped FROM l),
t AS (SELECT source, ord, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE),
        w * (SELECT arg_min(level, cap / w) FROM c WHERE NOT capped)) END AS target FROM c),
k AS (SELECT b.*, t.ord, t.source_size, t.target, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size
        ELSE 0 END AS passes, sum(words) OVER (PARTITION BY t.ord ORDER BY
        {_md5_sql("'17'", "'block'", "CAST(t.ord AS VARCHAR)", "CAST(block AS VARCHAR)")}, block
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
      FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, greatest(0, least(words, CAST(round(target) AS BIGINT) - passes * source_size - coalesce(before, 0))) AS extra FROM k),
n AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.passes, e.extra, coalesce(sum(size) OVER (
        PARTITION BY e.ord, e.block ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source AND d.key % {mixing.BLOCKS} = e.block)
SELECT doc_id, size, source_size, target,
  CAST(passes * size + greatest(0, least(size, extra - upto)) AS BIGINT) AS taken FROM n"""


@query("op8_source_mix", MIX_SQL)
def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by source weights 5, 2, 1."""
    m = mixing.mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return m.select("doc_id", "size", "source_size", F.col("target"), "taken")


# ---------------------------------------------------------------- 4 MinHash near-dedup
@query("op4_near_duplicates")
def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents with similar 4-word shingle sets."""
    return setsketch.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), k=4)


# ---------------------------------------------------------------- 3 suffix-array dedup
@query("op3_repeated_strings")
def op3_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removal of every byte covered by a 400-byte string that occurs elsewhere."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))


# ---------------------------------------------------------------- 6 URL filters
def _rules_sql() -> str:
    return ", ".join(
        f"CASE WHEN (host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}') "
        f"THEN {{'n': {len(r.name)}, 'rule': '{r.name}', 'verdict': '{r.verdict}'}} END" for r in url_filter.RULES)


URL_SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r AS (SELECT *, list_max(list_filter([{_rules_sql()}], lambda x: x IS NOT NULL)) AS best FROM h)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, CASE WHEN regexp_matches(host,
  '(^|[.-])({"|".join(url_filter.LISTED_WORDS)})([.-]|$)') THEN 'block' ELSE 'allow' END) AS verdict FROM r"""


@query("op6_url_filter", URL_SQL)
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's URL."""
    return url_filter.judge(table(spark, sf_dir, "pages", "page_id", "url"))


# ---------------------------------------------------------------- 1 LM scoring
@query("op1_lm_scores")
def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of every document."""
    return lm_scoring.score(table(spark, sf_dir, "documents", "doc_id", "text"))


# ---------------------------------------------------------------- 9 benchmark decontamination
@query("op9_benchmark_leaks")
def op9_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item or a re-parameterised one: one row per pair."""
    m = decontaminate.matches(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return m.select("doc_id", "item_id", "n_windows", "n_matched", "share", "reparameterised")


# ---------------------------------------------------------------- 7 token-ID / binary output
@query("op7_token_shards")
def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence of the documents with its slot, shard and the digest of its record."""
    return token_shards.materialised(table(spark, sf_dir, "documents", "doc_id", "text"))


# ---------------------------------------------------------------- 2 HTML extraction
@query("op2_html_text")
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page, laid out."""
    return html_text.extract(table(spark, sf_dir, "pages", "page_id", "html"))


# ---------------------------------------------------------------- 10 license scans
@query("op10_license_scan")
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License paragraphs of every document with their family."""
    return licenses.scan(table(spark, sf_dir, "documents", "doc_id", "text"))


# ---------------------------------------------------------------- 11 WARC
WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, (i // 4) * 5 + 1, 5) AS BIGINT)
    >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1) for i in range(32)], '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM g"""


@query("op11_warc", WARC_SQL)
def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back through their merged index."""
    index = warc.archived(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# ---------------------------------------------------------------- 12 conversation structure repair
REPAIR_SQL = r"""
WITH RECURSIVE tab AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
        ORDER BY i) AS t FROM range(256) r(i)),
d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce([4294967295] || list_transform(
        string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM conversations, tab),
e AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM d WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, left(role, 1) AS ini,
        lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS nxt FROM e),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
        WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM o),
k AS (SELECT *, fault NOT IN ('b', 'd') AS ok, CASE fault WHEN 't' THEN 1 ELSE 0 END AS late FROM f),
n AS (SELECT conv_id, count(*) AS n, count_if(fault = 'b') AS blank, count_if(fault = 'd') AS duplicate, count_if(fault = 't') AS truncated,
        count_if(nxt IS NOT NULL AND ini || nxt NOT IN ('su', 'ua', 'au')) AS illegal,
        coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM k GROUP BY conv_id),
rec(conv_id, i, v) AS (
  SELECT conv_id, n + 1, [{'c': 0, 'a': ''}, {'c': 4, 'a': 'II'}, {'c': 2, 'a': 'I'}, {'c': 0, 'a': ''}] FROM n
  UNION ALL
  SELECT conv_id, i, [list_min([b[1], {'c': b[3].c + 2, 'a': 'I' || b[3].a}, {'c': b[4].c + 4, 'a': 'II' || b[4].a}]),
      list_min([b[2], {'c': b[3].c + 2, 'a': 'I' || b[3].a}, {'c': b[4].c + 4, 'a': 'II' || b[4].a}]),
      list_min([b[3], {'c': b[4].c + 2, 'a': 'I' || b[4].a}]), list_min([b[4], {'c': b[3].c + 2, 'a': 'I' || b[3].a}])] FROM (
    SELECT r.conv_id, k.i, [list_min(list_filter([{'c': r.v[q].c + 3, 'a': 'D' || r.v[q].a},
        CASE WHEN k.ok AND q = 1 AND k.ini = 's' THEN {'c': r.v[2].c + k.late, 'a': 'K' || r.v[2].a} END,
        CASE WHEN k.ok AND q <> 3 AND k.ini = 'u' THEN {'c': r.v[3].c + k.late, 'a': 'K' || r.v[3].a} END,
        CASE WHEN k.ok AND q = 3 AND k.ini = 'a' THEN {'c': r.v[4].c + k.late, 'a': 'K' || r.v[4].a} END,
        CASE WHEN k.ok AND q <> 3 THEN {'c': r.v[3].c + k.late + 2, 'a': 'R' || r.v[3].a} END,
        CASE WHEN k.ok AND q = 3 THEN {'c': r.v[4].c + k.late + 2, 'a': 'R' || r.v[4].a} END], lambda x: x IS NOT NULL)) for q in [1, 2, 3, 4]] AS b
    FROM rec r JOIN k ON k.conv_id IS NOT DISTINCT FROM r.conv_id AND k.i = r.i - 1)),
best AS (SELECT conv_id, v[1].c AS cost, v[1].a AS audit FROM rec WHERE i = 1),
x AS (SELECT conv_id, j, audit[j] AS letter, len(regexp_replace(audit[:j], 'I', '', 'g')) AS i, len(regexp_replace(audit[:j], 'D', '', 'g')) AS nth,
        regexp_matches(audit, '^D*K') AS kept FROM best, unnest(range(1, len(audit) + 1)) AS u(j)),
y AS (SELECT x.*, k.role, k.text, k.ini, max(CASE WHEN nth = 1 AND letter = 'K' AND k.ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY x.conv_id) AS s
      FROM x LEFT JOIN k ON k.conv_id IS NOT DISTINCT FROM x.conv_id AND k.i = x.i),
z AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role ELSE CASE WHEN (nth - s) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' ||
        CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS lines FROM y WHERE letter <> 'D' GROUP BY conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id"""


@query("op12_conversation_repair", REPAIR_SQL)
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every damaged conversation."""
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return conversations.repaired(conversations.damaged(rows))


# ---------------------------------------------------------------- 13 phrase collocations
PHRASE_SQL = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM w, unnest(range(1, 6)) AS a(k), unnest(range(1, len(w) - k + 2)) AS b(i)),
f AS (SELECT lang, k, phrase, count(*) AS c FROM g GROUP BY ALL),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
h AS (SELECT * FROM f WHERE c >= 100),
x AS (SELECT h.lang, h.k, h.phrase, h.c AS a, j, array_to_string(string_split(h.phrase, ' ')[:j], ' ') AS s1,
        array_to_string(string_split(h.phrase, ' ')[j + 1:], ' ') AS s2 FROM h, unnest(range(1, k)) AS u(j) WHERE h.k > 1),
s AS (SELECT x.*, l.c AS l, r.c AS r, t.n, CAST((1000::HUGEINT * a * t.n) // (l.c::HUGEINT * r.c) AS BIGINT) AS score
      FROM x JOIN h l ON l.lang = x.lang AND l.phrase = s1 JOIN h r ON r.lang = x.lang AND r.phrase = s2 JOIN t ON t.lang = x.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
d AS (SELECT DISTINCT q.lang, q.phrase FROM h q JOIN (SELECT lang, c, unnest([array_to_string(string_split(phrase, ' ')[1:k - 1], ' '),
        array_to_string(string_split(phrase, ' ')[2:k], ' ')]) AS inside FROM h WHERE k > 2) y
      ON y.lang = q.lang AND y.inside = q.phrase AND 100 * y.c >= 100 * q.c),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b ANTI JOIN d USING (lang, phrase))
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, score FROM o WHERE rank <= 2000"""


@query("op13_collocations", PHRASE_SQL)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2,000 collocations of 2 to 5 words."""
    return phrases.collocations(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
