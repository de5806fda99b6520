"""Quality rules: a threshold table compiled into one Spark projection (native, no user functions).

``features`` derives word, symbol, stop-word and line counts of every text with array and
string functions, map-only (no shuffle). ``RULES`` is the threshold table; ``verdicts``
compiles it into one projection: the failed rules and ``kept``. ``n_stop_words`` counts the
distinct stop words a text has.

Defined cases: a null or blank text has no words and fails the length rule. Ratios with an
empty denominator count as 0. Repeated rows are judged one by one (nothing is joined), and
extra columns of the input are carried along; a clashing name gets underscores in front.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqwright.llm.common import fresh, words

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that it for on with as are this by be "
    "le la les de des du et en un une que qui pour dans est "
    "der die das und ist von zu den nicht mit ein eine "
    "el los las y por con para del se una al"
).split()


@dataclass(frozen=True)
class Rule:
    """A text passes if ``low <= feature / per <= high``."""

    name: str
    feature: str
    per: str | None = None
    low: float | None = None
    high: float | None = None


#: The threshold table. The first two rows are the base rules.
BASE_RULES = (
    Rule("few_words", "n_words", low=50),
    Rule("repeated_windows", "n_repeat_words", "n_words", high=0.5),
)
RULES = BASE_RULES + (
    Rule("word_length", "word_chars", "n_words", low=2, high=15),
    Rule("symbol_ratio", "n_symbols", "n_words", high=0.25),
    Rule("stop_words", "n_stop_words", low=1),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=0.5),
    Rule("line_length", "n_words", "n_lines", low=1.5),
)

FEATURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_repeat_words")


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` plus the feature columns (long). Map-only: chained projections, no shuffle.

    A 3-word window gets a number: its hash with the lowest bits replaced by its position.
    Sorted, windows with equal hash parts stand side by side; only those are compared as
    strings, so hash collisions cannot change ``n_repeat_words``.
    """
    names = dict(zip(FEATURES, fresh(df, *FEATURES)))
    w, n, bits, keys, near, lines, t = fresh(df, "_w", "_n", "_bits", "_keys", "_near", "_lines", "_t")
    out = df.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn(w, words(F.col(t))).withColumn(
        lines, F.filter(F.split(F.col(t), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    out = out.withColumn(n, F.size(w))
    # positions take `bits` bits of a window's key, the rest is hash: 24 bits serve 16.7 million words
    out = out.withColumn(bits, F.when(F.col(n) < (1 << 24), F.lit(24)).otherwise(F.lit(31)))
    out = out.withColumn(keys, F.expr(
        f"CASE WHEN {n} < 4 THEN cast(array() as array<bigint>) ELSE sort_array(transform(sequence(0, {n} - 3), i -> "
        f"shiftleft(shiftright(xxhash64(get({w}, i), get({w}, i + 1), get({w}, i + 2)), {bits}), {bits}) | i)) END"))
    # windows whose neighbour in the sorted keys has the same hash part, as (string, position)
    out = out.withColumn(near, F.expr(
        f"transform(filter({keys}, (x, j) -> shiftright(x, {bits}) <=> shiftright(get({keys}, j - 1), {bits})"
        f" OR shiftright(x, {bits}) <=> shiftright(get({keys}, j + 1), {bits})),"
        f" x -> cast(x & (shiftleft(1L, {bits}) - 1) as int))"))
    out = out.withColumn(near, F.expr(
        f"array_sort(transform({near}, p -> named_struct('s', concat_ws(' ', get({w}, p), get({w}, p + 1), get({w}, p + 2)), 'p', p)))"))
    stop = ", ".join(f"'{x}'" for y in STOP_WORDS for x in (y, y.capitalize()))
    count = {
        "n_words": F.col(n),
        "word_chars": F.char_length(F.array_join(w, "")),
        "n_symbols": F.char_length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_stop_words": F.expr(f"size(array_intersect({w}, array({stop})))"),
        "n_repeat_words": F.expr(
            f"size(array_distinct(flatten(transform(filter({near}, (x, j) -> x.s <=> get({near}, j - 1).s"
            f" OR x.s <=> get({near}, j + 1).s), x -> array(x.p, x.p + 1, x.p + 2)))))"),
    }
    # a generator of one row keeps filters on the features above it: pushed below, each would
    # repeat the expressions it is made of
    row = F.struct(*[count[f].cast("bigint").alias(names[f]) for f in FEATURES])
    return out.select(*df.columns, F.inline(F.array(row)))


def passes(rule: Rule, cols: dict[str, str] | None = None) -> Column:
    """The rule as a boolean expression. Ratios are compared without a division."""
    c = lambda f: F.col((cols or {}).get(f, f)).cast("double")
    per = c(rule.per) if rule.per else F.lit(1.0)
    tests = [c(rule.feature) >= rule.low * per] if rule.low is not None else []
    tests += [c(rule.feature) <= rule.high * per] if rule.high is not None else []
    out = tests[0]
    for x in tests[1:]:
        out = out & x
    return out


def verdicts(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` plus features, ``base_failed``, ``failed`` (names of the failed rules) and ``kept``,
    all rules compiled into one projection."""
    cols = dict(zip(FEATURES, fresh(df, *FEATURES)))
    base, failed, kept = fresh(df, "base_failed", "failed", "kept")
    feats = features(df, text)
    ok = F.lit(True)
    for r in rules:
        ok = ok & passes(r, cols)
    base_ok = F.lit(True)
    for r in BASE_RULES:
        base_ok = base_ok & passes(r, cols)
    names = F.filter(F.array(*[F.when(~passes(r, cols), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    return feats.select("*", (~base_ok).alias(base), names.alias(failed), (base_ok & ok).alias(kept))


def keep_good(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text passes every rule, with the input's columns."""
    kept = fresh(df, "base_failed", "failed", "kept")[2]
    return verdicts(df, text).where(F.col(kept)).select(*df.columns)
