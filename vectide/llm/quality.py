"""Quality rules as a short-circuit cascade, in SQL expressions only."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import BLANKS, drop, let, save, words

SYMBOLS = "#*$%&|<>"
WINDOW = 3
#: Rows on which costs and selectivities are estimated.
SAMPLE_ROWS = 2000
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(w: Column) -> Column:
    """Words in a window of three that is found twice or more in the array, each word counted once."""
    starts = F.slice(w, 1, F.greatest(F.size(w) - (WINDOW - 1), F.lit(0)))
    hashes = F.transform(starts, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    def count(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        again = let(placed, lambda s: F.filter(s, lambda x, k: same(s, x, k - 1) | same(s, x, k + 1)))
        places = F.sort_array(F.transform(again, lambda x: x["i"]))
        covered = let(places, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered)

    return let(hashes, count)


def _lines(text: Column) -> Column:
    """The lines of a text that have a word."""
    blank = lambda x: F.trim(F.translate(x, BLANKS, " " * len(BLANKS)))
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: blank(x) != "")


def stats(text: Column, w: Column) -> Column:
    """Struct of the base counts of a text whose words are w, and of its number of lines with a word."""
    whole = F.coalesce(text, F.lit(""))
    lines = let(_lines(text), lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    return let(
        lines,
        lambda x: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(whole, " " + BLANKS, "")).cast("long").alias("word_chars"),
            (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (x["n"] - x["d"]).cast("long").alias("n_dup_lines"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
            x["n"].cast("long").alias("n_lines"),
        ),
    )


@dataclass(frozen=True)
class Rule:
    """reject(text, words, stats) is true for a text to be rejected; it must not be null."""

    name: str
    reject: Callable[[Column, Column, Column], Column]


#: Rules behind the base rules. A text meets them only if none before it has rejected it.
RULES = (
    Rule("symbols", lambda t, w, s: s["n_symbols"] * 5 > s["n_words"]),
    Rule("word_length", lambda t, w, s: (s["word_chars"] < 2 * s["n_words"]) | (s["word_chars"] > 14 * s["n_words"])),
    Rule("dup_lines", lambda t, w, s: s["n_dup_lines"] * 2 > s["n_lines"]),
    Rule("capitals", lambda t, w, s: F.length(F.regexp_replace(t, r"\p{Lu}+", "")) * 2 < F.length(t)),
    Rule("variety", lambda t, w, s: F.size(F.array_distinct(w)) * 50 < s["n_words"]),
    Rule("letters", lambda t, w, s: F.length(F.regexp_replace(t, r"\p{L}+", "")) * 2 > F.length(t)),
)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (s["n_repeat_words"] * 100 > s["n_words"] * 50)


def order_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS, seed: int = 7) -> list[tuple[Rule, float, float]]:
    """(rule, share rejected, seconds on the sample), best rejection per cost first; ties keep the given order.

    Texts that the base rules reject are not part of the sample: they never reach these rules. An empty table keeps the order.
    """
    n = docs.count()
    if not n:
        return [(r, 0.0, 0.0) for r in rules]
    part = docs.select(F.col(text).alias("t")).sample(min(1.0, rows / n), seed)
    both = let(words(F.col("t")), lambda w: F.struct(w.alias("w"), stats(F.col("t"), w).alias("s")))
    part = save(part.select("t", both.alias("b")).select("t", "b.w", "b.s"), "sample")
    part = part.where(~base_failed(F.col("s")))
    took = []
    for r in rules:
        test = r.reject(F.col("t"), F.col("w"), F.col("s"))
        part.agg(F.count_if(test), F.count("*")).first()  # compiled and read before it is timed
        began = time.perf_counter()
        hit, of = part.agg(F.count_if(test), F.count("*")).first()
        took.append((r, hit / max(of, 1), time.perf_counter() - began))
    drop(part)
    return sorted(took, key=lambda x: -x[1] / max(x[2], 1e-6))


def judge(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """docs with a struct column `quality`: the base counts, base_failed, kept and failed_rule (null if kept).

    rules: in the order in which they are tried; None orders RULES by order_rules(). The order decides which rule is named in
    failed_rule, never what is kept. Null and empty texts have no words and fail the base rules. One pass over the rows, no shuffle.
    """
    if rules is None:
        rules = [r for r, _, _ in order_rules(docs, text)]
    t = F.coalesce(F.col(text), F.lit(""))

    def verdict(w: Column, s: Column) -> Column:
        failed = F.when(base_failed(s), F.lit("base"))
        for r in rules:
            failed = failed.when(r.reject(t, w, s), F.lit(r.name))
        return let(
            failed,
            lambda f: F.struct(*(s[c].alias(c) for c in STATS), base_failed(s).alias("base_failed"), f.isNull().alias("kept"), f.alias("failed_rule")),
        )

    return docs.withColumn("quality", let(words(t), lambda w: let(stats(t, w), lambda s: verdict(w, s))))


#: The same in SQL for DuckDB.
ORACLE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split(translate(coalesce(text, ''), chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '     '), ' '), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(translate(x, chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '     ')) <> '') AS l
  FROM documents
), win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), dup AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS r FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY doc_id
), s AS (
  SELECT d.doc_id, t, w, CAST(len(w) AS BIGINT) AS n_words, CAST(length(translate(t, ' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines
  FROM d LEFT JOIN rep USING (doc_id)
), f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols * 5 > n_words OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR n_dup_lines * 2 > n_lines
            OR length(regexp_replace(t, '\p{{Lu}}+', '', 'g')) * 2 < length(t) OR len(list_distinct(w)) * 50 < n_words
            OR length(regexp_replace(t, '\p{{L}}+', '', 'g')) * 2 > length(t)) AS kept
FROM f
"""
