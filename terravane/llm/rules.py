"""Quality rules: a threshold table compiled into one projection.

Each rule names a measure and the range that a good text keeps to.  Measures and
verdict are built-in Spark expressions only: no user functions, no shuffle.
Words are maximal runs of characters other than ``\\x20`` and ``\\x09-\\x0D``.

Null texts count as having no words: every measure is 0, and the base verdict
(fewer than 50 words) fails.  A null id stays null.  Texts of any length are
measured whole; windows and lines that occur equally often have no order, so there
are no ties.  Repeated rows give repeated results and an empty table gives none;
other columns are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: common short words of the corpus languages (fixed values)
STOP_WORDS = ["the", "and", "of", "to", "in", "is", "a", "that", "de", "la", "le", "et", "les", "un", "en", "der", "die", "und", "das", "ist", "von", "el", "que", "y", "los", "se"]
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

#: measure, lowest and highest good value (None: open)
THRESHOLDS: list[tuple[str, float | None, float | None]] = [
    ("mean_word_chars", 2.0, 14.0),
    ("symbol_share", None, 0.10),
    ("stop_word_share", 0.01, None),
    ("dup_line_share", None, 0.30),
    ("repeat_word_share", None, 0.50),
    ("upper_share", None, 0.50),
]


def _pairs(array: Column, same: str) -> Column:
    """Neighbours in a sorted array that are equal, as the later one."""
    n = F.size(array)
    return F.zip_with(F.slice(array, 1, n - 1), F.slice(array, 2, n - 1), lambda a, b: F.when(a[same] == b[same], b) if same else F.when(a == b, b))


def measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of measures for each document."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = df.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    trimmed = F.trim(F.col("text"), F.lit(BLANKS))
    base = base.select("doc_id", "text", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\x09-\\x0D]+")).alias("w"))
    # one hash for each 3-word window, and the sorted hashes, to see which repeat
    n = F.size("w")
    triples = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.xxhash64(F.get(F.col("w"), i - 1), F.get(F.col("w"), i), F.get(F.col("w"), i + 1))))
    base = base.select("doc_id", "text", "w", triples.alias("g"))
    base = base.select("doc_id", "text", "w", "g", F.sort_array("g").alias("s"))
    repeats = F.when(F.size("s") < 2, F.lit(False)).otherwise(F.exists(_pairs(F.col("s"), ""), lambda x: x.isNotNull()))
    base = base.select("doc_id", "text", "w", "g", repeats.alias("repeats"))
    # only where something repeats: windows with their places, sorted by hash
    placed = F.when(F.col("repeats"), F.array_sort(F.transform("g", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    base = base.select("doc_id", "text", "w", placed.alias("p"))
    m = F.size("p")
    later = F.zip_with(F.slice("p", 1, m - 1), F.slice("p", 2, m - 1), lambda a, b: F.when(a["h"] == b["h"], b["i"]))
    earlier = F.zip_with(F.slice("p", 1, m - 1), F.slice("p", 2, m - 1), lambda a, b: F.when(a["h"] == b["h"], a["i"]))
    at = F.when(F.col("p").isNotNull(), F.sort_array(F.array_union(F.array_compact(later), F.array_compact(earlier))))
    base = base.select("doc_id", "text", "w", at.alias("at"))
    k = F.size("at")
    # windows of three words that start at sorted places cover 3 words, or the gap to the next start if that is less
    gaps = F.zip_with(F.slice("at", 1, k - 1), F.slice("at", 2, k - 1), lambda a, b: F.least(b - a, F.lit(3)))
    covered = F.when(F.col("at").isNull(), F.lit(0)).otherwise(F.lit(3) + F.aggregate(gaps, F.lit(0), lambda x, y: x + y))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x, F.lit(BLANKS))) > 0)
    base = base.select("doc_id", "text", "w", covered.cast("long").alias("n_repeat_words"), lines.alias("l"))
    joined = F.array_join("w", "")
    return base.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(joined).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("l").cast("long").alias("n_lines"),
        F.size(F.filter("w", lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        (F.length(joined) - F.length(F.regexp_replace(joined, "[A-Z]", ""))).cast("long").alias("n_upper"),
    )


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", thresholds: list[tuple[str, float | None, float | None]] = THRESHOLDS) -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` of each row."""
    m = measures(df, id_col, text_col)
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    shares = {
        "mean_word_chars": F.col("word_chars") / words,
        "symbol_share": F.col("n_symbols") / chars,
        "stop_word_share": F.col("n_stop_words") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_word_share": F.col("n_repeat_words") / words,
        "upper_share": F.col("n_upper") / chars,
    }
    good = F.lit(True)
    for name, low, high in thresholds:
        good = good & ((shares[name] >= low) if low is not None else F.lit(True)) & ((shares[name] <= high) if high is not None else F.lit(True))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return m.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & good).alias("kept"))
