"""Quality rules: a table of thresholds compiled into one projection of built-in expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.shared import WORD, words_expr
from caseloom.session import cut_lineage

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it was with as on be by at "
    "le la les de des et en un une du que est pour dans "
    "der die das und zu den von mit ist nicht ein eine "
    "el los las y del por con para se es"
).split()
#: Letters by case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What may surround a stop word.
AROUND = ".,;:!?()[]{}<>\"'`*_-"
#: The characters counted as symbols.
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words")


@dataclass(frozen=True)
class Rule:
    """A document fails if ``metric`` lies below ``low`` or above ``high``; ``min_words`` exempts shorter ones."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


#: Base rules of every document, as exact integer comparisons, then the threshold table.
BASE = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"
RULES = (
    Rule("word_length", "word_chars / n_words", 2.0, 14.0),
    Rule("symbols", "n_symbols / n_words", None, 0.3),
    Rule("stop_words", "n_stop_words / n_words", 0.03, None, 50),
    Rule("dup_lines", "n_dup_lines / n_lines", None, 0.3),
)


def plain(word: Column) -> Column:
    """A word as the stop words are written: A-Z in lower case, without punctuation around it."""
    return F.btrim(F.translate(word, UPPER, LOWER), F.lit(AROUND))


def measures(docs: DataFrame) -> DataFrame:
    """Counts of every document beside its columns; existing columns of these names are replaced, others stay."""
    old, docs = docs.columns, docs.select(F.struct("*").alias("_row"), "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumns(
        {
            "_words": words_expr(F.col("text")),
            "_lines": F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD)),
            "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
            "word_chars": F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]", "")).cast("long"),
        }
    )
    windows = F.when(
        F.size("_words") >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_words", i, WINDOW))),
    ).otherwise(F.array().cast("array<bigint>"))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_stop_words": F.size(F.filter("_words", lambda w: F.array_contains(stop, plain(w)))).cast("long"),
            "_windows": windows,
        }
    )
    # Sorted (hash, place) pairs put equal windows side by side; only texts with a repeat pay for the sort.
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    out = out.withColumn(
        "_sorted",
        F.when(repeats, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    ).drop("_windows")
    twice = F.filter(
        "_sorted",
        lambda s, j: ((j > 0) & (F.get("_sorted", j - 1)["h"] == s["h"])) | (F.get("_sorted", j + 1)["h"] == s["h"]),
    )
    out = out.withColumn("_at", F.sort_array(F.transform(twice, lambda s: s["i"]))).drop("_sorted")
    fresh = F.transform("_at", lambda p, j: F.when(j == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), p - F.get("_at", j - 1))))
    covered = F.aggregate(fresh, F.lit(0), lambda a, x: a + x)
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return out.select(*[F.col("_row")[c].alias(c) for c in old if c.lower() not in COUNTS], *COUNTS)


def compiled(rules: tuple[Rule, ...]) -> list[Column]:
    """The table as columns: the name of each broken rule, else null."""
    out = []
    for r in rules:
        value = F.expr(f"CASE WHEN n_words > 0 THEN {r.metric} ELSE 0 END")
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (value < r.low)
        if r.high is not None:
            bad = bad | (value > r.high)
        out.append(F.when((F.col("n_words") >= r.min_words) & bad, F.lit(r.name)))
    return out


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Documents with their counts, ``base_failed``, ``failed_rules`` and ``kept``.

    Null and empty texts have no words and fail.  Rows are independent: repeated rows get equal verdicts, an
    empty table stays empty, other columns pass through.
    """
    judged = measures(docs).withColumns(
        {"base_failed": F.expr(BASE), "failed_rules": F.array_compact(F.array(*compiled(rules)))}
    )
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with their own columns.

    The judged rows are written before they are filtered: over a filter the optimizer derives constraints from
    every combination of the columns in the projection, which takes it forever.
    """
    judged = quality(docs.select(F.struct("*").alias("_row"), "text"), rules)
    return cut_lineage(judged.select("_row", "kept")).filter("kept").select("_row.*")
