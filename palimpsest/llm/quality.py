"""Quality rules: a table of thresholds compiled into one Spark projection.

Every measure is a built-in expression over the whole text; nothing is exploded, so the
plan is one scan and no shuffle, however long or repetitive a text is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import WHITE, WHITE_RUN, let

#: The white space and the symbols of the contract.
WHITE_ONE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to a in is that for it as was with be by on are this an "
    "le la les de des du et un une en que qui dans pour sur par au "
    "der die das und den von zu mit ist ein eine im auf dem "
    "el los las y del se por con una su al lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """A ratio of two measures and the closed range that passes. 0/0 counts as 0."""

    name: str
    over: str
    under: str
    low: float | None = None
    high: float | None = None


#: Length, symbols, stop words, lines.
RULES = (
    Rule("mean_word_chars", "word_chars", "n_words", low=2.5, high=12.0),
    Rule("symbols_per_word", "n_symbols", "n_words", high=0.1),
    Rule("stop_word_share", "n_stop_words", "n_words", low=0.02),
    Rule("duplicate_line_share", "n_dup_lines", "n_lines", high=0.3),
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def words_of(text: Column) -> Column:
    """The words of a text as an array; of null or white space, none."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, WHITE_RUN))


def repeated_words(words: Column) -> Column:
    """How many words lie in 3-word windows that the text has twice or more.

    Windows are sorted with their places, equal neighbours give the places of repeated
    windows, and the gaps between those places say how many words they cover.
    """
    n = F.size(words)
    windows = F.arrays_zip(
        F.slice(words, 1, n - 2), F.slice(words, 2, n - 2), F.slice(words, 3, n - 2), F.sequence(F.lit(0), n - 3)
    )

    def places(by_window: Column) -> Column:
        def twins(k: Column) -> Column:
            x, y = by_window[k - 1], by_window[k]
            return (x["0"] == y["0"]) & (x["1"] == y["1"]) & (x["2"] == y["2"])

        found = F.filter(F.sequence(F.lit(1), F.size(by_window) - 1), twins)
        both = F.flatten(F.transform(found, lambda k: F.array(by_window[k - 1]["3"], by_window[k]["3"])))
        return F.sort_array(F.array_distinct(both))

    def covered(at: Column) -> Column:
        gaps = F.zip_with(at, F.slice(at, 2, F.size(at)), lambda x, y: F.least(F.lit(3), F.coalesce(y - x, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)

    found = let(let(F.sort_array(windows), places), lambda at: F.when(F.size(at) == 0, F.lit(0)).otherwise(covered(at)))
    return F.when(n < 4, F.lit(0)).otherwise(found)


def _ratio(rule: Rule) -> Column:
    return F.when(F.col(rule.under) == 0, F.lit(0.0)).otherwise(F.col(rule.over) / F.col(rule.under))


def verdict(rules: tuple[Rule, ...]) -> Column:
    """True where every rule of the table passes."""
    passed = F.lit(True)
    for rule in rules:
        if rule.low is not None:
            passed = passed & (_ratio(rule) >= F.lit(rule.low))
        if rule.high is not None:
            passed = passed & (_ratio(rule) <= F.lit(rule.high))
    return passed


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Measures and verdicts of all rows of ``docs``.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept`` and then ``n_stop_words, n_lines``. Null and empty texts have no words and
    fail the base rule; repeated rows are judged one by one; an empty table gives no rows;
    other columns are not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        words_of(F.col(text)).alias("words"),
        F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        (F.char_length(body) - F.regexp_count(body, F.lit(WHITE_ONE))).alias("word_chars"),
        F.regexp_count(body, F.lit(SYMBOLS)).alias("n_symbols"),
    )
    counted = base.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.col("word_chars").cast("long"),
        F.col("n_symbols").cast("long"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"), "n_stop_words", "n_lines",
    )
