"""Line-first cleaning, in DataFrame functions only.

Every line with a word is judged by itself; a document that loses more than ``MAX_LOST`` of its characters
with the failing lines is rejected.  A line fails when

* punctuation: it has four words or more, and more symbols of ``LINE_SYMBOLS`` than ``MAX_SYMBOLS`` a word or a ! or ? for every two,
* navigation: it holds three or more of ``SEPARATORS``, or it is up to ten words without closing punctuation that begin with a menu
  word of the fixed list,
* boilerplate: it holds a phrase of the fixed list,
* repetition: of at least eight words, fewer than a third are different.

The base figures are counted over the whole text in the row itself: windows of three words get a hash whose
low bits are replaced by the window's place, one sort of these numbers brings equal windows together, so no
text is exploded or shuffled.  Rows are independent.  Null and texts without words have no words and fail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BASE_SYMBOLS = "#*$%&|<>"
LINE_SYMBOLS = "#*$%&|<>{}~^=_\\"
SEPARATORS = "|>»•·"

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
MAX_LOST = 0.5
MAX_SYMBOLS = 0.3

# Phrases of boilerplate and menu words.
BOILERPLATE = (
    "all rights reserved|terms of (use|service)|privacy policy|cookie (policy|settings)|we use cookies|accept (all )?cookies|"
    "enable javascript|javascript is (disabled|required)|lorem ipsum|subscribe to our newsletter|sign up for our newsletter|"
    "powered by|click here to"
)
MENU = "home|menu|login|log in|sign in|sign up|register|contact|about us|search|share|next|previous|sitemap|back to top|skip to content"


def words_of(text: str | Column) -> Column:
    """The words of a text; null has none.  One blank as the delimiter needs no regular expression."""
    blanks = F.coalesce(text, F.lit(""))
    for white in "\t\n\x0b\x0c\r":
        blanks = F.replace(blanks, F.lit(white), F.lit(" "))
    return F.array_remove(F.split(blanks, " "), "")


def _low_bits(n: Column) -> Column:
    """A mask of as many bits as a number below ``n`` needs."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.ceil(F.log2(n + F.lit(1))).cast("int")) - 1


def window_hashes(words: Column, n: Column) -> Column:
    """Hashes of the ``n`` windows of three words."""
    three = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    return F.when(n >= 1, F.transform(F.sequence(F.lit(0), n - 1), three))


def _count(line: Column, characters: str) -> Column:
    inside = "".join("\\" + c for c in characters)
    return F.regexp_count(line, F.lit(f"[{inside}]"))


def _with_base(df: DataFrame, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("r_words", words_of(text)).withColumn("r_lines", F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("r_n", F.size("r_words").cast("long"))
    n = (F.col("r_n") - 2).cast("int")
    df = df.withColumn("r_low", _low_bits(F.greatest(n, F.lit(1))))
    df = df.withColumn("r_hash", window_hashes(F.col("r_words"), n))
    placed = F.transform("r_hash", lambda x, i: x.bitwiseAND(F.bitwise_not(F.col("r_low"))).bitwiseOR(i.cast("long")))
    # Most texts repeat no window and end here.
    df = df.withColumn("r_marks", F.when(F.size(F.array_distinct("r_hash")) < n, F.sort_array(placed)))
    marks, low = F.col("r_marks"), F.col("r_low")
    same = lambda a, b: (a.bitwiseXOR(b)).bitwiseAND(F.bitwise_not(low)) == 0
    twice = F.filter(
        marks,
        lambda x, j: F.coalesce(same(x, F.get(marks, j + 1)), F.lit(False)) | F.coalesce(same(x, F.get(marks, j - 1)), F.lit(False)),
    )
    df = df.withColumn("r_places", F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(low))))
    places = F.col("r_places")
    steps = F.transform(places, lambda p, j: F.least(F.lit(3).cast("long"), F.coalesce(F.get(places, j + 1) - p, F.lit(3).cast("long"))))
    repeats = F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda t, x: t + x), F.lit(0).cast("long"))
    return (
        df.withColumn("r_repeat", repeats)
        .withColumn("r_chars", F.length(F.array_join("r_words", "")).cast("long"))
        .withColumn("r_symbols", _count(whole, BASE_SYMBOLS).cast("long"))
        .withColumn("r_dup", (F.size("r_lines") - F.size(F.array_distinct("r_lines"))).cast("long"))
    )


def line_fault(line: Column) -> Column:
    """Why a line fails: punctuation, navigation, boilerplate, repetition; null if it passes."""

    def fault(words: Column) -> Column:
        n, low = F.size(words), F.lower(line)
        return (
            F.when(_count(line, SEPARATORS) >= 3, "navigation")
            .when((n >= 4) & ((_count(line, LINE_SYMBOLS) > n * MAX_SYMBOLS) | (_count(line, "!?") * 2 >= n)), "punctuation")
            .when((n <= 10) & ~line.rlike(r"[.!?…:;\"')\]][\x20\x09-\x0D]*$") & low.rlike(rf"^\W*({MENU})\b"), "navigation")
            .when(low.rlike(BOILERPLATE), "boilerplate")
            .when((n >= 8) & (F.size(F.array_distinct(words)) * 3 < n), "repetition")
        )

    return F.get(F.transform(F.array(words_of(line)), fault), F.lit(0))  # the words of a line are split once


RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_share", "kept")


def rule_figures(docs: DataFrame, text: str = "text", names: tuple[str, ...] = RESULT) -> DataFrame:
    """``docs`` with the base figures, the share of characters in failing lines and the verdict, under ``names``."""
    inner = docs.select(F.struct("*").alias("r_row"), F.col(text).alias("r_text"))
    df = _with_base(inner, "r_text")
    size = lambda lines: F.aggregate(lines, F.lit(0).cast("long"), lambda t, x: t + F.length(x))
    failing = F.filter("r_lines", lambda x: line_fault(x).isNotNull())
    df = df.withColumn("r_total", size(F.col("r_lines"))).withColumn("r_lost", size(failing))
    failed = (F.col("r_n") < MIN_WORDS) | (F.lit(100) * F.col("r_repeat") > MAX_REPEATED_PERCENT * F.col("r_n"))
    share = F.when(F.col("r_total") > 0, F.col("r_lost") / F.col("r_total")).otherwise(F.lit(1.0))
    columns = [F.col("r_n"), F.col("r_chars"), F.col("r_symbols"), F.col("r_dup"), F.col("r_repeat"), failed, share, ~failed & (share <= MAX_LOST)]
    return df.select("r_row.*", *(c.alias(n) for c, n in zip(columns, names)))


def clean_text(text: str | Column) -> Column:
    """The text without its failing lines; null stays null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: line_fault(x).isNull()), "\n")


def rules_query(docs: DataFrame) -> DataFrame:
    return rule_figures(docs.select("doc_id", "text")).drop("text")
