"""Removal of lines similar to an earlier line: an exact set-similarity join in DataFrame functions only.

A line is the set of its words.  Lines of equal sets form a class, placed at its first line.  A line goes if
its set stands at an earlier place, or if an earlier line's set has a Jaccard similarity of ``SIMILAR`` or
more; lines are judged on the input, whether or not the earlier one is removed itself.

Words are ordered by rarity: occurrences are counted over all documents in ``COUNTERS`` hashed counters, a
table of fixed size, and equal counts are ordered by hash.  Two similar sets share a word of their prefixes
in this order (prefix filter); a shared word at two positions bounds the overlap (positional filter), so do
the sizes (length filter) and parity bits (a bit that differs is a word not shared; 64 of them tell nothing of lines
of 150 words and little inside
a family of copies of 70, so lines of ``WIDE`` words have 256).  What is left is verified on the words themselves.  The positional filter holds for the first word two lines share: all
words before it, of either line, are not shared.

A prefix word does not give all pairs of its lines.  First every line is compared with the earliest line of each of
its prefix words; lines found similar are settled, so a family of near copies costs one pair for each member and word.
Then the lines still open are compared with the earlier lines of their prefix words.  Words of at least
``2**((HOT - 1) / 2)`` occurrences (by their counter) are hot: their lines meet in classes of length only, each line in two.

Earlier means smaller document id, then smaller line number; rows that share an id but not the text are
ordered by a hash of the text at equal line numbers.  Identical rows count once and share their result.
Null texts have no lines, empty lines and lines without words are never removed; a null id comes first.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from creditloom.llm.common import free_names, row_key
from creditloom.llm.rules import words_of
from creditloom.llm.scratch import Tables

SIMILAR = 0.8
COUNTERS = 2**18
#: Sets of fewer words are similar to equal sets only.
LEAST_WORDS = 4
#: The rank from which a word is hot: 256 occurrences.
HOT = 17
#: Lines of so many words have ``SIGNS`` columns of 64 parity bits, shorter ones use the first.
WIDE = 40
SIGNS = 4
#: Prefix words are joined and pairs are verified in so many parts, one after the other, so that only the rows of one part are on disk.
PARTS = 4


def word_ranks(docs: DataFrame, text: str = "text") -> list[int]:
    """One rank per counter, higher for more occurrences; the sums of at most ``COUNTERS`` counters reach the driver."""
    words = docs.select(F.explode(words_of(F.col(text))).alias("word"))
    counts = words.groupBy(F.xxhash64("word").bitwiseAND(F.lit(COUNTERS - 1)).cast("int").alias("c")).count()
    ranks = [1] * COUNTERS
    for c, rank in counts.select("c", F.least(F.lit(126), 1 + F.floor(2 * F.log2(F.col("count") + 0.0))).cast("int")).collect():
        ranks[c] = rank
    return ranks


def word_codes(words: Column, ranks: list[int]) -> Column:
    """The set of words as sorted numbers: rank in the upper bits, hash in the lower ones."""
    # Constant folding makes this an array in the plan.
    table = F.split(F.lit(",".join(map(str, ranks))), ",").cast("array<tinyint>")

    def code(h: Column) -> Column:
        rank = F.get(table, h.bitwiseAND(F.lit(COUNTERS - 1)).cast("int"))
        return F.call_function("shiftleft", rank.cast("long"), F.lit(56)).bitwiseOR(F.shiftrightunsigned(h, 8))

    return F.sort_array(F.transform(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))), code))


def _parities(codes: Column, n: Column) -> list[Column]:
    """The parity columns b0, b1, ...; together (by exclusive or) they are the 64 parity bits of all words."""

    def bits(mine) -> Column:
        bit = lambda x: F.call_function("shiftleft", mine(x), x.bitwiseAND(F.lit(63)).cast("int"))
        return F.aggregate(codes, F.lit(0).cast("long"), lambda t, x: t.bitwiseXOR(bit(x)))

    own = [bits(lambda x, i=i: (F.shiftrightunsigned(x, 6).bitwiseAND(F.lit(SIGNS - 1)) == i).cast("long")) for i in range(SIGNS)]
    short = [bits(lambda x: F.lit(1).cast("long")), *[F.lit(0).cast("long")] * (SIGNS - 1)]
    return [F.when(n >= WIDE, w).when(n >= LEAST_WORDS, s).alias(f"b{i}") for i, (w, s) in enumerate(zip(own, short))]


BITS = [f"b{i}" for i in range(SIGNS)]


def line_table(docs: DataFrame, ranks: list[int], id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line: its place, class (c1, c2), number of different words (0: no line to judge), parity bits and prefix."""
    lines = docs.select(*row_key(id_column, text), F.posexplode(F.split(text, "\n")).alias("line", "content"))
    # No filter on the codes here: it would be pushed below them and code every line twice.
    coded = lines.withColumn("codes", word_codes(words_of(F.col("content")), ranks))
    n = F.size("codes")
    return coded.select(
        "k_id",
        "line",
        "k_text",
        F.xxhash64("codes").alias("c1"),
        F.xxhash64(F.lit(1), "codes").alias("c2"),
        n.alias("n"),
        *_parities(F.col("codes"), n),
        F.when(n >= LEAST_WORDS, F.slice("codes", F.lit(1), n - F.ceil(SIMILAR * n - 1e-9).cast("int") + 1)).alias("prefix"),
    )


def _may_be_similar(nx: Column, ny: Column, px: Column, py: Column) -> Column:
    """Length, positional and bit filters for two lines of nx and ny words with bits b0x, ... and b0y, ..."""
    unlike = nx + ny - 2 * F.ceil(SIMILAR / (1 + SIMILAR) * (nx + ny) - 1e-9)
    near_sizes = F.least(nx, ny) >= SIMILAR * F.greatest(nx, ny) - 1e-9
    differ = [F.col(b + "x").bitwiseXOR(F.col(b + "y")) for b in BITS]
    wide = reduce(Column.__add__, (F.bit_count(d) for d in differ))
    folded = F.bit_count(reduce(Column.bitwiseXOR, differ))
    return near_sizes & (px + py <= unlike) & (F.when((nx >= WIDE) & (ny >= WIDE), wide).otherwise(folded) <= unlike)


def _prefix_words(classes: DataFrame, part: int) -> DataFrame:
    named = classes.filter(F.col("n") >= LEAST_WORDS)
    words = named.select("*", F.posexplode("prefix").alias("p", "word")).drop("prefix").filter(F.col("word").bitwiseAND(F.lit(PARTS - 1)) == part)
    return words.withColumn("hot", F.shiftrightunsigned("word", 56) >= HOT)


def _with_heads(classes: DataFrame, tables: Tables, part: int) -> DataFrame:
    """Pairs (cx, cy) of a line and the earliest line of one of its prefix words (of this part) that may be similar."""
    words = _prefix_words(classes, part)
    place = F.struct("k_id", "line", "k_text")
    heads = words.groupBy("word").agg(F.min(F.struct(place.alias("at"), "c1", *BITS, "n", "p")).alias("h"), F.count("*").alias("m")).filter("m > 1")
    bits = [F.col(f"h.{b}").alias(b + "x") for b in BITS]
    heads = tables.write(heads.select("word", F.col("h.at").alias("ax"), F.col("h.c1").alias("cx"), *bits, F.col("h.n").alias("nx"), F.col("h.p").alias("px")), "heads")
    bits = [F.col(b).alias(b + "y") for b in BITS]
    met = words.select("word", place.alias("ay"), F.col("c1").alias("cy"), *bits, "n", "p").join(heads, "word")
    near = _may_be_similar(F.col("nx"), F.col("n"), F.col("px"), F.col("p"))
    return met.filter((F.col("ax") < F.col("ay")) & near).select("cx", "cy").distinct()


def _all_open(classes: DataFrame, part: int) -> DataFrame:
    """Pairs (cx, cy) of lines that share a prefix word (of this part) and may be similar, if the later one is not ``settled``."""
    words = _prefix_words(classes, part)
    # Sizes of similar lines lie in the same class or in neighbouring ones: a line is in its own and in the next.
    size_class = F.floor(F.log("n") / F.lit(-math.log(SIMILAR - 1e-6))).cast("int")
    sizes = F.when(F.col("hot"), F.array(size_class, size_class + 1)).otherwise(F.array(F.lit(0)))
    left = F.call_function("shiftleft", F.col("n").cast("long"), F.lit(32))
    packed = left.bitwiseOR(F.col("p").cast("long") * 2 + F.when(F.col("settled"), 0).otherwise(1))
    postings = words.select("word", F.explode(sizes).alias("size"), "k_id", "c1", *BITS, packed.alias("packed"))
    short = {"k_id": "k", "c1": "c", "packed": "p"}
    x, y = (postings.select("word", "size", *(F.col(c).alias(short.get(c, c) + side) for c in ("k_id", "c1", *BITS, "packed"))) for side in "xy")
    n, p = (lambda v: F.shiftrightunsigned(v, 32)), (lambda v: F.shiftrightunsigned(F.col(v).bitwiseAND(F.lit(2**32 - 1)), 1))
    near = _may_be_similar(n("px"), n("py"), p("px"), p("py"))
    is_open = lambda v: F.col(v).bitwiseAND(F.lit(1)) == 1
    # Inside one document the order is left to the verification.
    one = (F.col("kx") == F.col("ky")) & (F.col("cx") < F.col("cy")) & (is_open("px") | is_open("py"))
    ordered = one | ((F.col("kx") < F.col("ky")) & is_open("py"))
    return x.join(y, ["word", "size"]).filter(ordered & near).select("cx", "cy").distinct()


def _in_parts(make: Callable[[int], DataFrame], tables: Tables) -> DataFrame:
    """The pairs of all parts, each once, as the table ``pairs``."""
    found = []
    for part in range(PARTS):
        found.append(tables.write(make(part), f"pairs{part}"))
        if "heads" in tables.paths:
            tables.drop("heads")
    out = tables.write(reduce(DataFrame.unionByName, found).distinct(), "pairs")
    tables.drop(*(f"pairs{part}" for part in range(PARTS)))
    return out


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_column: str, text: str, tables: Tables, name: str) -> DataFrame:
    """c1 of the later class of each pair (cx, cy) that is similar in its words, as a table of this name."""
    asked = pairs.select(F.explode(F.array("cx", "cy")).alias("c1")).distinct()
    asked = classes.select("c1", "k_id", "k_text", "line").join(asked, "c1")
    wanted = tables.write(asked.groupBy("k_id", "k_text").agg(F.collect_list(F.struct("line", "c1")).alias("wanted")), "wanted")
    keyed = docs.select(*row_key(id_column, text), F.col(text).alias("content"))
    found = keyed.join(wanted, ["k_id", "k_text"]).select("k_id", "k_text", F.split("content", "\n").alias("content"), F.explode("wanted").alias("w"))
    place = F.struct("k_id", "w.line", "k_text").alias("at")
    sets = found.select("w.c1", place, F.get("content", F.col("w.line")).alias("text"))
    sets = sets.dropDuplicates(["c1"]).withColumn("size", F.size(F.array_distinct(words_of("text"))))
    sets = tables.write(sets, "sets")
    tables.drop("wanted")
    x, y = (sets.select(*(F.col(c).alias(c[0] + side) for c in ("c1", "at", "text", "size"))) for side in "xy")
    # Texts travel as they are, an array of words takes several times their room.
    both = F.size(F.array_intersect(words_of("tx"), words_of("ty")))
    similar = (1 + SIMILAR) * both >= SIMILAR * (F.col("sx") + F.col("sy")) - 1e-9
    later = F.when(F.col("ax") > F.col("ay"), F.col("cx")).otherwise(F.col("cy"))
    found = []
    for i in range(PARTS):
        mine = F.col("cy").bitwiseAND(F.lit(PARTS - 1)) == i
        met = pairs.filter(mine).join(x, "cx").join(y.filter(mine), "cy").filter(similar)
        found.append(tables.write(met.select(later.alias("c1")).distinct(), f"{name}{i}"))
    tables.drop("sets")
    out = tables.write(reduce(DataFrame.unionByName, found).distinct(), name)
    tables.drop(*(f"{name}{i}" for i in range(PARTS)))
    return out


def repeated_lines(docs: DataFrame, tables: Tables, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """k_id, k_text and line of every line to remove, with whether an equal set or only a similar one came before.

    The result reads tables that ``tables`` still holds; all others are dropped as soon as they are read.
    """
    lines = tables.write(line_table(docs, word_ranks(docs, text), id_column, text), "lines").filter("n > 0")
    first = F.min(F.struct("k_id", "line", "k_text")).alias("f")
    kept = F.first(F.struct("n", *BITS, "prefix")).alias("s")
    grouped = lines.groupBy("c1", "c2").agg(first, kept, F.count("*").alias("m"))
    classes = tables.write(grouped.select("c1", "c2", "m", "f.*", "s.*"), "classes")
    places = tables.write(lines.select("k_id", "k_text", "line", "c1", "c2"), "places")
    tables.drop("lines")
    pairs = _in_parts(lambda part: _with_heads(classes, tables, part), tables)
    settled = _verified(pairs, classes, docs, id_column, text, tables, "settled")
    tables.drop("pairs")
    marked = classes.join(settled.select("c1", F.lit(True).alias("settled")), "c1", "left")
    pairs = _in_parts(lambda part: _all_open(marked, part), tables)
    more = _verified(pairs, classes, docs, id_column, text, tables, "more")
    tables.drop("pairs")
    similar = settled.unionByName(more).distinct()
    marked = classes.select("c1", "c2", "m", F.struct("k_id", "line", "k_text").alias("f"))
    marked = marked.join(similar.withColumn("similar", F.lit(True)), "c1", "left").filter("m > 1 or similar").drop("m")
    marked = tables.write(marked, "marked")
    tables.drop("classes", "settled", "more")
    equal = F.struct("k_id", "line", "k_text") > F.col("f")
    judged = places.join(marked, ["c1", "c2"]).filter(equal | F.coalesce("similar", F.lit(False)))
    return judged.select("k_id", "k_text", "line", equal.alias("equal")).distinct()


def _removed_lines(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """k_id, k_text and the sorted numbers of the lines to remove, for each row that has any."""
    tables = Tables(docs.sparkSession)
    gone = repeated_lines(docs, tables, id_column, text)
    per_row = tables.write(gone.groupBy("k_id", "k_text").agg(F.sort_array(F.collect_list("line")).alias("removed")), "removed")
    tables.drop("places", "marked")
    return per_row


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> tuple[DataFrame, list[str]]:
    """``docs`` with the numbers (from 0) of the lines to remove, null for none; and the column's name."""
    a, b, name = free_names(docs, ["k_id", "k_text", "removed_lines"])
    per_row = _removed_lines(docs.select(id_column, text), id_column, text)
    keys = row_key(id_column, text)
    out = docs.select("*", keys[0].alias(a), keys[1].alias(b)).join(per_row.toDF(a, b, name), [a, b], "left")
    return out.drop(a, b), [name]


def without_lines(text: str, removed: str) -> Column:
    kept = F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(removed, i))
    return F.when(F.col(removed).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))


def lines_query(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the removed line numbers (from 0) of every row."""
    per_row = _removed_lines(docs.select("doc_id", "text"), "doc_id", "text")
    rows = docs.select("doc_id", *row_key("doc_id", "text"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    n = F.coalesce(F.size("removed"), F.lit(0))
    return rows.join(per_row, ["k_id", "k_text"], "left").select(
        "doc_id",
        F.when(F.col("n_lines") < 0, 0).otherwise(F.col("n_lines")).alias("n_lines"),
        F.when(n < 0, 0).otherwise(n).cast("long").alias("n_removed"),
        F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed_lines"),
    )
