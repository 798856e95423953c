"""Quality rules as a short-circuit cascade (operator 2).

Every rule rejects documents by counts of their text.  On a sample each rule is
run alone: its time is its cost, the share that it rejects its selectivity.
Rules are then tried in falling order of rejection per cost, in one CASE, and a
document's later rules aren't computed once one has rejected it.  A document is
kept if no rule rejects it, whatever the order, so the estimates change the
time and never the result.

Only DataFrame functions are used; every row is judged alone, without a
shuffle.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_WORDS = 20
WINDOW = 8
MAX_REPEATED_PERCENT = 30
SAMPLE_ROWS = 2_000

_SPACE = r"\x20\x09-\x0D"


def _dropped(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are among ``chars``."""
    return F.char_length(text) - F.char_length(F.translate(text, chars, ""))


def repeat_words(words: Column, width: int = WINDOW) -> Column:
    """Words that stand in a window of ``width`` words found twice or more, the first time included.

    Windows are compared by a 64-bit hash of the hashes of their words.  Only
    texts in which a hash comes again go on to sort (hash, position), mark
    the positions whose neighbour has the same hash, and measure what the
    marked windows cover.
    """
    hashes = F.transform(words, lambda x: F.xxhash64(x))
    windows = _let(hashes, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (width - 1)),
                                                 lambda i: F.xxhash64(F.slice(h, i, width))))

    def covered(w: Column) -> Column:
        ordered = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        same = lambda s, e, j: F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))
        marked = _let(ordered, lambda s: F.filter(s, lambda e, i: same(s, e, i - 1) | same(s, e, i + 1)))
        at = F.array_sort(F.transform(marked, lambda e: e["p"]))
        lengths = _let(at, lambda p: F.transform(
            p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width)))))
        return F.aggregate(lengths, F.lit(0), lambda a, b: a + b)

    counted = _let(windows, lambda w: F.when(F.size(w) > F.size(F.array_distinct(w)), covered(w)).otherwise(F.lit(0)))
    return F.when(F.size(words) > width, counted).otherwise(F.lit(0))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: the lambda of a one-element array."""
    return F.element_at(F.transform(F.array(value), body), 1)


def metrics(text: Column, words: Column) -> dict[str, Column]:
    """Counts of a text (null: counts as empty); ``words`` are its words."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{_SPACE}]"))
    stutter = rf"(?<![^{_SPACE}])([^{_SPACE}]++)[{_SPACE}]++(?=\1(?![^{_SPACE}]))"
    return {
        "n_words": F.size(words),
        "word_chars": F.char_length(F.translate(text, common.SPACE_CHARS, "")),
        "n_symbols": _dropped(text, "#*$%&|<>"),
        "n_lines": F.size(lines),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": repeat_words(words),
        "n_upper": F.regexp_count(text, F.lit(r"\p{Lu}")),
        "n_letter_words": F.regexp_count(text, F.lit(rf"\p{{L}}[^{_SPACE}]*")),
        "n_marks": _dropped(text, "!?"),
        "n_stutter": F.regexp_count(text, F.lit(stutter)),
    }


@dataclass(frozen=True)
class Rule:
    """``reject`` makes the condition from the metrics; whole numbers only."""

    name: str
    reject: Callable[[dict[str, Column]], Column]


RULES = (
    Rule("few_words", lambda m: m["n_words"] < MIN_WORDS),
    Rule("repeated_words", lambda m: 100 * m["n_repeat_words"] > MAX_REPEATED_PERCENT * m["n_words"]),
    Rule("symbols", lambda m: 10 * m["n_symbols"] > m["n_words"]),
    Rule("word_length", lambda m: (m["word_chars"] < 3 * m["n_words"]) | (m["word_chars"] > 12 * m["n_words"])),
    Rule("duplicate_lines", lambda m: 2 * m["n_dup_lines"] > m["n_lines"]),
    Rule("upper_case", lambda m: 10 * m["n_upper"] > 3 * m["word_chars"]),
    Rule("letters", lambda m: 10 * m["n_letter_words"] < 7 * m["n_words"]),
    Rule("marks", lambda m: 10 * m["n_marks"] > 3 * m["n_words"]),
    Rule("stutter", lambda m: 5 * m["n_stutter"] > m["n_words"]),
)


def _with_words(docs: DataFrame, text_col: str) -> tuple[DataFrame, Column, Column]:
    """``docs`` with two more columns under free names, the text (null: empty) and its words."""
    text, words = common.fresh(docs, "_text"), common.fresh(docs, "_words")
    rows = (docs.withColumn(text, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
            .withColumn(words, F.regexp_extract_all(text, F.lit(common.WORD_PATTERN), F.lit(0))))
    return rows, F.col(text), F.col(words)


def cascade(rules: Sequence[Rule], values: dict[str, Column]) -> Column:
    """The name of the first rule that rejects, null if none does; later rules aren't evaluated."""
    verdict = F
    for rule in rules:
        verdict = verdict.when(rule.reject(values), F.lit(rule.name))
    return verdict.otherwise(F.lit(None)) if rules else F.lit(None).cast("string")


def ranked(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES,
           sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """``rules`` in falling order of rejection per cost: (rule, seconds, share rejected) on a sample.

    The sample is about ``sample_rows`` rows from the whole table.  It only
    sets the order; what is kept doesn't depend on it.  The driver gets one count and one
    time per rule.  Rules on which the sample tells nothing (an empty table)
    stay in the given order.
    """
    spark, total = docs.sparkSession, docs.count()
    if not total:
        return [(r, 0.0, 0.0) for r in rules]
    sample = docs.select(F.col(text_col).alias("text")).sample(min(1.0, sample_rows / total), seed=7)
    sample = common.land(spark, sample.coalesce(8), "quality-sample")
    rows, text, words = _with_words(sample, "text")
    values, found = metrics(text, words), []
    for rule in rules:
        judged = rows.agg(F.count("*").alias("n"), F.count_if(rule.reject(values)).alias("bad"))
        for _ in range(2):  # the first run also compiles
            began = time.perf_counter()
            row = judged.collect()[0]
            seconds = time.perf_counter() - began
        found.append((rule, seconds, row["bad"] / max(1, row["n"])))
    return sorted(found, key=lambda x: -x[2] / x[1])


def quality_filter(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES,
                   order: Sequence[Rule] | None = None) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their own columns.

    Null and empty texts count as texts without words and are rejected.
    Equal rows share their verdict.  An empty table stays empty.
    """
    order = order or [r for r, _, _ in ranked(docs, text_col, rules)]
    rows, text, words = _with_words(docs, text_col)
    return rows.where(cascade(order, metrics(text, words)).isNull()).select(*docs.columns)


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   rules: Sequence[Rule] = RULES, order: Sequence[Rule] | None = None) -> DataFrame:
    """Per row of ``docs``: its id, five counts, base_failed and kept.

    The five counts are computed for every row, as they are asked for; the
    rules on other metrics run in the cascade only while no rule has rejected.
    """
    order = order or [r for r, _, _ in ranked(docs, text_col, rules)]
    told = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows, text, words = _with_words(docs.select(F.col(id_col), F.col(text_col)), text_col)
    lazy = metrics(text, words)
    rows = rows.select(id_col, text, words, *[lazy[c].cast("long").alias(c) for c in told])
    failed = ((F.col("n_words") < MIN_WORDS)
              | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")))
    values = lazy | {c: F.col(c) for c in told}
    return rows.select(id_col, *told, failed.alias("base_failed"),
                       (~failed & cascade(order, values).isNull()).alias("kept"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(common.table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT k, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM t),
p AS (SELECT k, unnest(range(1, len(words) - 6)) AS i, words FROM w WHERE len(words) >= 8),
g AS (SELECT k, i, count(*) OVER (PARTITION BY k, words[i:i + 7]) AS n FROM p),
r AS (
  SELECT k, sum(least(8, coalesce(nxt - i, 8))) AS n_repeat_words
  FROM (SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS nxt FROM g WHERE n > 1) GROUP BY k),
u AS (SELECT k, unnest(range(2, len(words) + 1)) AS i, words FROM w),
s AS (SELECT k, count(*) FILTER (words[i] = words[i - 1]) AS n_stutter FROM u GROUP BY k),
m AS (
  SELECT w.doc_id, len(words) AS n_words,
         length(array_to_string(words, '')) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(regexp_extract_all(text, '\p{Lu}')) AS n_upper,
         len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) AS n_letter_words,
         len(regexp_extract_all(text, '[!?]')) AS n_marks, coalesce(n_stutter, 0) AS n_stutter
  FROM w LEFT JOIN r USING (k) LEFT JOIN s USING (k))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words
            OR word_chars < 3 * n_words OR word_chars > 12 * n_words OR 2 * n_dup_lines > n_lines
            OR 10 * n_upper > 3 * word_chars OR 10 * n_letter_words < 7 * n_words
            OR 10 * n_marks > 3 * n_words OR 5 * n_stutter > n_words) AS kept
FROM m
"""
