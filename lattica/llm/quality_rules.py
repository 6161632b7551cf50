"""Operator 5: quality rules as one Spark projection compiled from a table of thresholds; no user functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import WORD_GAP, free_prefix, let, null_as

#: Frequent words of English, German, French and Spanish.
STOP_WORDS = "a and are as at be by for from in is it of on or that the this to was with auf das dem den der des die ein eine für ist mit nicht sich und von zu au avec dans de du en et la le les pour que qui sur un une al con del el es las los no por se su y".split()

#: The verdict's rules: a measure, and the least and the most of it that is good; None: no such limit.
RULES: list[tuple[str, float | None, float | None]] = [
    ("words", 50, None),
    ("mean_word_chars", 2.0, 14.0),
    ("symbols_per_word", None, 0.2),
    ("exclamations_per_word", None, 0.4),
    ("bars_and_bullets_per_word", None, 0.2),
    ("stop_word_share", 0.02, None),
    ("repeated_word_share", None, 0.5),
    ("duplicate_line_share", None, 0.6),
]


def without(text: Column, chars: str) -> Column:
    """The number of code points of a text that are among chars."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice: windows are sorted by hash, so equal ones are neighbours."""

    def covered(places: Column) -> Column:
        step = lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - p, F.lit(3)))
        return F.aggregate(F.transform(places, step), F.lit(0).cast("long"), lambda a, x: a + x)

    def twice(windows: Column) -> Column:
        same = lambda w, k: (F.get(windows, k + 1)["h"] == w["h"]) | ((k > 0) & (F.get(windows, F.greatest(k - 1, F.lit(0)))["h"] == w["h"]))
        found = F.filter(windows, lambda w, k: F.coalesce(same(w, k), F.lit(False)))
        return let(F.sort_array(F.transform(found, lambda w: w["i"])), covered)

    hashed = lambda ws: F.transform(F.slice(ws, F.lit(1), F.greatest(F.size(ws) - 2, F.lit(0))), lambda w, i: F.struct(F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)).alias("h"), i.alias("i")))
    return let(words, lambda ws: let(F.sort_array(hashed(ws)), twice))


def compiled(rules: list[tuple[str, float | None, float | None]], measures: dict[str, Column]) -> Column:
    """The table as one condition."""
    verdict = F.lit(True)
    for name, least, most in rules:
        if least is not None:
            verdict = verdict & (measures[name] >= least)
        if most is not None:
            verdict = verdict & (measures[name] <= most)
    return F.coalesce(verdict, F.lit(False))


def quality_rules(docs: DataFrame, rules: list[tuple[str, float | None, float | None]] = RULES, keep_columns: bool = False) -> DataFrame:
    """Counts and verdict of every text; keep_columns: beside the columns of docs, with the verdict as the last one, rule_kept.

    Every row gives one row. A null or empty text has no words and fails. A null id stays null; repeated rows stay; a
    measure at its limit is good; an empty table gives no rows. A very long text is read whole, its words as one array of
    a row. Extra columns are not read, or kept as they are; names that clash get another prefix.
    """
    p = free_prefix(docs.columns, "rule_")
    text = null_as(F.col("text").cast("string"))
    own = [F.col(c) for c in docs.columns] if keep_columns else [F.col("doc_id").cast("long").alias("doc_id")]
    # Two projections: what the second names often, the first works out once.
    first = docs.select(*own, text.alias(f"{p}text"), F.array_remove(F.split(text, WORD_GAP), "").alias(f"{p}words"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias(f"{p}lines"))
    words, lines = F.col(f"{p}words"), F.col(f"{p}lines")
    stop_count = F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS)))
    second = first.select(
        *([F.col(c) for c in docs.columns] if keep_columns else ["doc_id"]),
        F.size(words).cast("long").alias(f"{p}n_words"),
        F.length(F.translate(F.col(f"{p}text"), " \t\n\x0b\x0c\r", "")).cast("long").alias(f"{p}word_chars"),
        without(F.col(f"{p}text"), "#*$%&|<>").alias(f"{p}n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias(f"{p}n_dup_lines"),
        repeated_words(words).cast("long").alias(f"{p}n_repeat_words"),
        F.size(lines).alias(f"{p}n_lines"),
        stop_count.alias(f"{p}n_stops"),
        without(F.col(f"{p}text"), "!").alias(f"{p}n_exclaim"),
        without(F.col(f"{p}text"), "|•·").alias(f"{p}n_bars"),
    )
    n = F.greatest(F.col(f"{p}n_words"), F.lit(1))
    measures = {
        "words": F.col(f"{p}n_words"),
        "mean_word_chars": F.col(f"{p}word_chars") / n,
        "symbols_per_word": F.col(f"{p}n_symbols") / n,
        "exclamations_per_word": F.col(f"{p}n_exclaim") / n,
        "bars_and_bullets_per_word": F.col(f"{p}n_bars") / n,
        "stop_word_share": F.col(f"{p}n_stops") / n,
        "repeated_word_share": F.col(f"{p}n_repeat_words") / n,
        "duplicate_line_share": F.col(f"{p}n_dup_lines") / F.greatest(F.col(f"{p}n_lines"), F.lit(1)),
    }
    failed = (F.col(f"{p}n_words") < 50) | (F.col(f"{p}n_repeat_words") * 100 > F.col(f"{p}n_words") * 50)
    kept = ~failed & compiled(rules, measures)
    if keep_columns:
        return second.select(*docs.columns, kept.alias(f"{p}kept"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return second.select("doc_id", *(F.col(f"{p}{x}").alias(x) for x in names), failed.alias("base_failed"), kept.alias("kept"))


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)
SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
win AS (
  SELECT r, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n >= 2),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, i + unnest([0, 1, 2]) AS p FROM rep) GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
         len(l) AS n_lines, len(list_filter(w, lambda x: lower(x) IN ({_STOP_SQL}))) AS n_stops,
         length(text) - length(translate(text, '!', '')) AS n_exclaim,
         length(text) - length(translate(text, '|•·', '')) AS n_bars,
         greatest(len(w), 1) AS n
  FROM d LEFT JOIN cov USING (r)),
f AS (SELECT *, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words >= 50 AND word_chars / n BETWEEN 2.0 AND 14.0 AND n_symbols / n <= 0.2
       AND n_exclaim / n <= 0.4 AND n_bars / n <= 0.2 AND n_stops / n >= 0.02 AND n_repeat_words / n <= 0.5
       AND n_dup_lines / greatest(n_lines, 1) <= 0.6 AS kept
FROM f
"""
