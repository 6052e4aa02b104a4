r"""Quality rules, lines first, with DataFrame functions only.

Every line is judged by punctuation, navigation and boilerplate rules; lines
that fail are taken out; a document that loses more than ``MAX_LOST`` of its
characters this way is rejected, beside the base rules on the whole text
(fewer than ``MIN_WORDS`` words, or over ``MAX_REPEAT_PCT`` percent of words
in 5-word windows that come twice).

Words are runs of ``[^\x20\x09-\x0D]``. A window is held as a 64-bit hash of
its words' hashes; sorting (hash, position) within a row finds the windows
that come twice, so no row leaves its task.

Defined cases: null or empty text has no words and fails the base rule; rows
are independent, so null or repeated ids keep one row each; an empty table
gives no rows; other columns pass through (``__*`` names are the operator's).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fixed, read_table

WINDOW = 5
MIN_WORDS, MAX_REPEAT_PCT, MAX_LOST = 10, 20, 0.5
WHITE = " \t\n\x0b\x0c\r"
# Fixed values of the line rules.
MENU = r"^\W*(?:home|menu|login|log in|sign in|sign up|next|previous|back|top|share|search)\W*$"
SEPARATORS, MIN_SEPARATORS, MENU_CHARS = "|»›>", 4, 24
BOILERPLATE = ("all rights reserved", "terms of use", "terms of service", "privacy policy", "accept cookies", "accept all cookies", "use of cookies",
    "copyright (c)", "copyright ©", "lorem ipsum", "subscribe to our", "enable javascript", "javascript is disabled")
SYMBOLS, SHOUTS = "#*$%&|<>", "!?"
LETTER_SHARE, SYMBOL_SHARE, SHOUT_SHARE = 0.5, 0.1, 0.1


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _has(text: Column, phrases) -> Column:
    found = F.lit(False)
    for phrase in phrases:
        found = found | text.contains(phrase)
    return found


def _line_fails(row: Column, may: Column) -> Column:
    """Punctuation (few letters, many symbols, marks of emphasis), navigation,
    boilerplate. ``may``: which of them the document as a whole can show, so
    that a line is not searched for what its text does not hold."""
    line, solid = row["line"], row["solid"]
    letters = F.length(F.regexp_replace(line, r"[\x00-\x40\x5B-\x60\x7B-\x7F]", ""))
    count = lambda chars: F.length(line) - F.length(_without(line, chars))
    return (
        (may["symbols"] & (count(SYMBOLS) > SYMBOL_SHARE * solid))
        | (may["shouts"] & (count(SHOUTS) > SHOUT_SHARE * solid))
        | (may["separators"] & (count(SEPARATORS) >= MIN_SEPARATORS))
        | (may["boilerplate"] & _has(F.lower(line), BOILERPLATE))
        | ((F.length(line) <= MENU_CHARS) & F.lower(line).rlike(MENU))
        | (letters < LETTER_SHARE * solid)
    )


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts, base_failed, kept and ``clean_text`` added."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = fixed(docs, {
        "__words": F.transform(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w)),
        "__lines": F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), F.length(_without(x, WHITE)).alias("solid"))),
        "n_symbols": F.when(_has(text, SYMBOLS), F.length(text) - F.length(_without(text, SYMBOLS))).otherwise(0).cast("long"),
        "__may": F.struct(
            _has(text, SYMBOLS).alias("symbols"), _has(text, SHOUTS).alias("shouts"), _has(text, SEPARATORS).alias("separators"),
            _has(F.lower(text), ("reserved", "terms of", "privacy", "cookies", "copyright", "lorem", "subscribe", "javascript")).alias("boilerplate")),
    })
    words = F.col("__words")
    at = lambda i, k: F.get(words, i + k)
    n_windows = F.size(words) - (WINDOW - 1)
    out = fixed(out, {"__windows": F.when(n_windows > 0,
        F.transform(F.slice(words, F.lit(1), F.greatest(n_windows, F.lit(1))),
            lambda w, i: F.xxhash64(w, *(at(i, k) for k in range(1, WINDOW))))).otherwise(F.array().cast("array<bigint>"))})
    # only rows in which some window comes twice sort theirs
    twice = F.size(F.array_distinct("__windows")) < F.size("__windows")
    out = fixed(out, {"__sorted": F.when(twice, F.array_sort(F.transform("__windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))))})
    s = F.col("__sorted")
    near = lambda i: F.coalesce(F.get(s, i)["w"], F.lit(None))
    starts = F.array_sort(F.transform(F.filter(s, lambda x,
        i: F.coalesce((x["w"] == near(i - 1)) & (i > 0), F.lit(False)) | F.coalesce(x["w"] == near(i + 1), F.lit(False))), lambda x: x["i"]))
    out = fixed(out, {"__starts": starts})
    covered = F.aggregate(
        F.col("__starts"), F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(i - a["last"], F.lit(WINDOW))).alias("n"), i.alias("last")))["n"]
    full = F.transform(F.filter("__lines", lambda x: x["solid"] > 0), lambda x: x["line"])
    solid = lambda lines: F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + x["solid"])
    out = fixed(out, {
        "n_words": F.size(words).cast("long"),
        "word_chars": solid(F.col("__lines")),
        "n_dup_lines": (F.size(full) - F.size(F.array_distinct(full))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        "__good": F.filter("__lines", lambda x: ~_line_fails(x, F.col("__may"))),
    })
    out = out.withColumn("clean_text", F.array_join(F.transform("__good", lambda x: x["line"]), "\n"))
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words")))
    lost = F.col("word_chars") - solid(F.col("__good"))
    out = out.withColumn("kept", ~F.col("base_failed") & (lost <= MAX_LOST * F.col("word_chars")))
    return out.drop("__words", "__lines", "__windows", "__sorted", "__starts", "__may", "__good")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = measure(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
