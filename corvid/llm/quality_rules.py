"""Quality rules: a table of thresholds compiled into one projection.

Measures and verdicts are Spark SQL expressions; nothing runs in Python.
Repeated word windows are found inside the row by sorting the hashes of the
windows, so the work is n log n in the words of a text and no shuffle is
needed.

Nulls and texts without words have zero counts and fail the base rules.
Ratios with a zero denominator are 0. Each row is judged alone: ties, repeated
rows and empty tables need no care; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"

#: Function words of the languages at hand, kept short: running text in any of
#: them is made of these to a tenth and more.
STOP_WORDS = tuple(
    "the of and to in is that for it on with as was be by are this from at or an have not der die und das von zu mit den ist nicht ein eine im auf für "
    "dem des sich auch de la le les et des en un une du que qui est dans pour par sur pas au plus el los las y del se por con una su para es al lo como".split()
)


@dataclass(frozen=True)
class Rule:
    """A text fails if ``measure`` is below ``least`` or above ``most``."""

    measure: str
    least: float | None = None
    most: float | None = None


#: The verdict's thresholds; all must hold.
RULES = (
    Rule("n_words", least=50),
    Rule("mean_word_length", least=2.0, most=12.0),
    Rule("symbol_word_ratio", most=0.1),
    Rule("stop_word_ratio", least=0.06),
    Rule("upper_ratio", most=0.5),
    Rule("dup_line_ratio", most=0.5),
    Rule("bar_line_ratio", most=0.5),
    Rule("repeat_word_ratio", most=0.5),
)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """How many words lie in three-word windows that occur twice or more."""

    def marked(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def safe(s: Column) -> Column:
            # a sentinel before and after keeps the neighbours' positions valid
            edge = F.struct(F.lit(None).cast("long").alias("h"), F.lit(-1).alias("i"))
            padded = F.concat(F.array(edge), s, F.array(edge))
            return _let(padded, lambda p: F.filter(s, lambda e, k: F.get(p, k)["h"].eqNullSafe(e["h"]) | F.get(p, k + 2)["h"].eqNullSafe(e["h"])))

        return _let(pairs, safe)

    def union(starts: Column) -> Column:
        total = F.aggregate(
            starts,
            F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")),
        )
        return total["n"]

    hashes = F.when(
        F.size(words) >= 3,
        F.zip_with(
            F.slice(words, 1, F.size(words) - 2),
            F.arrays_zip(F.slice(words, 2, F.size(words) - 2).alias("b"), F.slice(words, 3, F.size(words) - 2).alias("c")),
            lambda a, bc: F.xxhash64(a, bc["b"], bc["c"]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    return _let(hashes, lambda h: _let(marked(h), lambda m: union(F.sort_array(F.transform(m, lambda e: e["i"])))))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and all measures, one row for each row of ``docs``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    split = base.select("doc_id", "text", words.alias("words"), F.filter(F.split("text", "\n"), lambda x: F.translate(x, " \t\n\x0b\x0c\r", "") != "").alias("lines"))
    count = lambda column: F.size(column).cast("long")
    counts = split.select(
        "doc_id",
        count("words").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        count("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("lines", lambda x: x.contains(" | "))).cast("long").alias("n_bar_lines"),
        _repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.length(F.regexp_replace("text", r"[^A-ZÀ-ÖØ-Þ]", "")).cast("long").alias("n_upper"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return counts.select(
        "*",
        ratio("word_chars", "n_words").alias("mean_word_length"),
        ratio("n_symbols", "n_words").alias("symbol_word_ratio"),
        ratio("n_stop_words", "n_words").alias("stop_word_ratio"),
        ratio("n_upper", "word_chars").alias("upper_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        ratio("n_bar_lines", "n_lines").alias("bar_line_ratio"),
        ratio("n_repeat_words", "n_words").alias("repeat_word_ratio"),
    )


def verdict(rules: tuple[Rule, ...]) -> Column:
    """The table of thresholds as one boolean expression."""
    out = F.lit(True)
    for rule in rules:
        value = F.col(rule.measure)
        if rule.least is not None:
            out = out & (value >= F.lit(rule.least))
        if rule.most is not None:
            out = out & (value <= F.lit(rule.most))
    return out


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measures with ``base_failed`` and ``kept``."""
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return measures(docs).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))
