"""Quality rules: a threshold table compiled into one Spark projection.

Each rule bounds a ratio of two counts of the text: length, symbol, stop-word and line
ratios. The table becomes column expressions only; no user function is evaluated.

Words are runs of characters other than space and U+0009 to U+000D. A window is five
words in a row; repeated words are the words in windows that the text holds twice or
more, the first of them included. Windows are compared by a 64-bit hash, and equal
hashes by their words.

Defined results: a null or empty text has no words and fails; a text of any length is
read whole, in one row of one task; repeated rows are judged each for itself; an empty
table gives an empty table; other columns are not read, and `passing` returns them.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import documents, only

WINDOW = 5
GAP = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]"

# Frequent function words, lower case as running text has them.
STOP_WORDS = {
    "en": "the of and to in a is that for it was on with as be by this are from at or an not which he you",
    "de": "der die das und in den von zu mit ist des im für nicht ein eine dem auf sich es auch als an",
    "fr": "le la les de des et un une du en est que qui dans pour par sur au pas ne elle il",
    "es": "el la los las de del y en que un una por con para es se su al lo no como",
}


class Rule(NamedTuple):
    """low <= numerator / denominator <= high; a missing bound does not bind."""

    name: str
    numerator: str
    denominator: str
    low: float | None
    high: float | None


RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.1),
    Rule("stop_word_share", "n_stop_words", "n_words", 0.03, None),
    Rule("duplicate_line_share", "n_dup_lines", "n_lines", None, 0.5),
)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, also where body uses it in a loop."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, hashes: Column) -> Column:
    """Words of `words` that lie in a window found twice or more."""

    def covered(places: Column) -> Column:
        step = F.transform(places, lambda p, k: F.least(F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(step, F.lit(0), lambda total, x: total + x)

    def twins(ordered: Column) -> Column:
        words_at = lambda s: F.slice(words, s["i"] + 1, WINDOW)
        same = lambda s, o: F.coalesce((o["h"] == s["h"]) & (words_at(o) == words_at(s)), F.lit(False))
        hit = lambda s, k: same(s, F.get(ordered, k - 1)) | same(s, F.get(ordered, k + 1))
        found = F.filter(F.transform(ordered, lambda s, k: F.when(hit(s, k), s["i"])), lambda p: p.isNotNull())
        return let(F.sort_array(found), covered)

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    some = F.size(F.array_distinct(hashes)) < F.size(hashes)
    return F.when(some, let(ordered, twins)).otherwise(F.lit(0))


def measures(docs: DataFrame) -> DataFrame:
    """The counts that rules refer to, one row per document."""
    stop = sorted({w for words in STOP_WORDS.values() for w in words.split()})
    text = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("t"))
    split = text.select(
        "doc_id",
        "t",
        F.array_remove(F.split("t", GAP), "").alias("words"),
        F.filter(F.split("t", "\n"), lambda line: line.rlike(WORD)).alias("lines"),
    )
    hashed = split.withColumn("codes", F.transform("words", lambda w: F.xxhash64(w)))
    last = F.size("words") - WINDOW
    window = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(F.col("codes"), i + j) for j in range(WINDOW)]))
    windows = hashed.withColumn("hashes", F.when(last >= 0, window).otherwise(F.array().cast("array<bigint>")))
    return windows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words"), F.col("hashes")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("words", lambda w: w.isin(stop))).cast("long").alias("n_stop_words"),
    )


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """True where every rule holds; an empty denominator makes the ratio 0."""
    verdict = F.lit(True)
    for rule in rules:
        value = F.coalesce(F.try_divide(F.col(rule.numerator), F.col(rule.denominator)), F.lit(0.0))
        if rule.low is not None:
            verdict &= value >= rule.low
        if rule.high is not None:
            verdict &= value <= rule.high
    return verdict


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measures with base_failed and kept."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measures(docs).withColumn("base_failed", failed).withColumn("kept", ~failed & compiled(rules))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir))


def _sql(rules: tuple[Rule, ...] = RULES) -> str:
    stop = ", ".join(f"'{w}'" for w in sorted({w for words in STOP_WORDS.values() for w in words.split()}))
    bounds = []
    for r in rules:
        ratio = f"coalesce({r.numerator} / nullif({r.denominator}, 0), 0)"
        bounds += [f"{ratio} >= {r.low}"] * (r.low is not None) + [f"{ratio} <= {r.high}"] * (r.high is not None)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, ws FROM w),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, list_slice(ws, i, i + 4)) AS c FROM win),
cov AS (SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS n FROM rep WHERE c > 1),
r AS (SELECT doc_id, sum(n) AS n FROM cov GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(len(ls) AS BIGINT) AS n_lines,
             CAST(len(list_filter(ws, lambda x: x IN ({stop}))) AS BIGINT) AS n_stop_words
      FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND {" AND ".join(bounds)} AS kept FROM b"""


QUERIES = {"op2_quality_rules": op2_quality_rules}
ORACLE = {"op2_quality_rules": _sql()}
