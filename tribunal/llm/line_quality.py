"""Line-first text cleaning: drop bad lines, then reject documents that lose too much."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: The characters between words, and those counted as symbols.
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Phrases of page furniture, in lower case.
BOILERPLATE = (
    "accept cookies", "all rights reserved", "cookie policy", "enable javascript", "javascript is disabled",
    "lorem ipsum", "privacy policy", "sign up for our newsletter", "subscribe to our newsletter", "terms of service",
    "terms of use", "use of cookies", "use cookies",
)
_SEPARATORS = "|»›•·"
_BLANK = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules and the share of a text that may be lost.

    A line fails if it is short and ends without punctuation, has too many
    separators, symbols or exclamation marks for its words, or holds a
    boilerplate phrase.
    """

    short_words: int = 4
    separator_percent: int = 20
    symbol_percent: int = 30
    exclamation_percent: int = 30
    lost_percent: int = 30


def _class(characters: str) -> str:
    """Characters as a pattern; none of them is special inside brackets."""
    return f"[{characters}]"


def _count(column: Column, characters: str) -> Column:
    return F.length(column) - F.length(F.regexp_replace(column, _class(characters), ""))


def _word_chars(column: Column) -> Column:
    return F.length(F.regexp_replace(column, _BLANK, ""))


def _plain(line: Column) -> Column:
    return F.rtrim(F.regexp_replace(line, r"[\x09-\x0D]", " "))


def line_fails(plain: Column, lowered: Column, rules: LineRules) -> Column:
    """Whether a line with at least one word, blanks as spaces and none at its end, is removed.

    Words are counted only for lines with a character that some rule counts.
    """
    ended = plain.rlike(r"""[.!?:;…。！？]["'”’»)\]]*$""")
    enough = plain.rlike(rf"^ *[^ ]+(?: +[^ ]+){{{rules.short_words - 1}}}") if rules.short_words > 0 else F.lit(True)
    n_words = F.size(F.array_remove(F.split(plain, " "), ""))
    counted = (
        (100 * _count(plain, _SEPARATORS) >= rules.separator_percent * n_words + 100)
        | (100 * _count(plain, SYMBOLS) > 3 * rules.symbol_percent * n_words)
        | (100 * _count(plain, "!") > 2 * rules.exclamation_percent * n_words + 200)
    )
    phrases = reduce(lambda a, b: a | b, [lowered.contains(p) for p in BOILERPLATE])
    return (~enough & ~ended) | (plain.rlike(_class(_SEPARATORS + SYMBOLS + "!")) & counted) | phrases


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def clean_text(text: Column, rules: LineRules) -> Column:
    """The lines that pass; lines without a word stay."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    # Each step hands its result on, as nothing is shared inside one lambda.
    plain = F.transform(lines, lambda x: F.struct(x.alias("line"), _plain(x).alias("plain")))
    lowered = F.transform(plain, lambda x: F.struct(
        x["line"].alias("line"), x["plain"].alias("plain"), F.lower(x["plain"]).alias("lowered")))
    passed = F.filter(lowered, lambda x: (x["plain"] == "") | ~line_fails(x["plain"], x["lowered"], rules))
    return F.array_join(F.transform(passed, lambda x: x["line"]), "\n")


def _window_codes(words: Column) -> Column:
    """A code for each window of five words, from the words' codes."""
    return F.transform(F.slice(words, 1, F.greatest(F.size(words) - 4, F.lit(0))),
                       lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, 5)]))


def quality_columns(
    docs: DataFrame, key: str = "doc_id", text: str = "text", rules: LineRules = LineRules()
) -> DataFrame:
    """Per row: doc_id, counts of the whole text, base_failed, lost and total characters, cleaned text and kept.

    Null text counts as empty.  Rows are judged one by one: repeated rows and
    null keys stay, other columns are not read, an empty table gives no rows.
    A text without words has nothing to lose and fails by its word count.
    """
    body = F.coalesce(F.col("_text"), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text")).withColumns({
        "_words": F.array_remove(F.split(body, _BLANK), ""),
        "_lines": F.filter(F.split(body, "\n", -1), _has_word),
        "word_chars": _word_chars(body).cast("long"),
        "n_symbols": _count(body, SYMBOLS).cast("long"),
        "clean": clean_text(F.col("_text"), rules),
    })
    rows = rows.withColumns({
        "n_words": F.size("_words").cast("long"),
        "_words": F.transform("_words", lambda w: F.xxhash64(w)),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "lost_chars": (F.col("word_chars") - _word_chars(F.col("clean"))).cast("long"),
    }).drop("_lines").withColumn("_codes", _window_codes(F.col("_words"))).drop("_words")
    # Only texts with a repeated window have their windows sorted.  The row number is never below 0; it keeps a filter on
    # the result from being moved below this step, where it would do the step again for each window.
    repeats = (F.size("_codes") > F.size(F.array_distinct("_codes"))) & (
        F.monotonically_increasing_id() >= 0)
    rows = rows.withColumn("_sorted", F.when(repeats, F.array_sort(
        F.transform("_codes", lambda c, i: F.struct(c.alias("code"), i.alias("at")))))).drop("_codes")
    neighbour = lambda i: F.get(F.col("_sorted"), i)["code"]
    found = F.filter("_sorted", lambda e, i: F.coalesce(neighbour(i - 1) == e["code"], F.lit(False))
                     | F.coalesce(neighbour(i + 1) == e["code"], F.lit(False)))
    rows = rows.withColumn("_at", F.array_sort(F.transform(found, lambda e: e["at"]))).drop("_sorted")
    covered = F.aggregate(
        "_at", F.struct(F.lit(0).alias("words"), F.lit(-5).alias("last")),
        lambda acc, p: F.struct((acc["words"] + F.least(F.lit(5), p - acc["last"])).alias("words"), p.alias("last")),
        lambda acc: acc["words"])
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_at")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    lost = 100 * F.col("lost_chars") > rules.lost_percent * F.col("word_chars")
    return rows.withColumn("kept", ~F.col("base_failed") & ~lost)


def keep_good(
    docs: DataFrame, text: str = "text", length: str | None = None, rules: LineRules = LineRules()
) -> DataFrame:
    """Documents that pass, with the lines that pass; ``length`` names a column of text lengths to renew.

    Columns stay as they are otherwise.
    """
    rows = docs.withColumn("llm_row", F.struct(*[F.col(c) for c in docs.columns]))
    judged = quality_columns(rows, "llm_row", text, rules)
    kept = judged.where("kept").select("doc_id", "clean")
    out = []
    for c in docs.columns:
        if c == text:
            out.append(F.col("clean").alias(c))
        elif c == length:
            out.append(F.length("clean").cast(dict(docs.dtypes)[c]).alias(c))
        else:
            out.append(F.col("doc_id")[c].alias(c))
    return kept.select(*out)
