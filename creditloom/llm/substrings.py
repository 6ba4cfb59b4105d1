"""Removal of repeated passages by winnowing: equal runs of windows by hash, the rest window by window.

Every text is cut into factors: stretches of consecutive windows of ``size`` words that share their
anchor, the least hash among the runs of ``ANCHOR`` words of a window.  Equal windows have the same anchor
at the same place, so a repeated passage is cut alike wherever it stands, and every window lies in one
factor.  The index holds each distinct factor at its earliest place, the reference block.

* A factor equal to a reference block is a duplicate span as a whole.
* A reference block whose anchor heads other blocks as well may share windows with them near the factor
  borders; its windows are compared one by one.
* A block that is alone with its anchor has no repeated window.

Factors repeated inside a task are settled there, so a passage that a third of all documents hold reaches
the shuffle once per task.  Anchors that stay frequent (found by counting hashed anchors, a table of fixed
size) are dealt by anchor and factor together and their blocks always have their windows compared, which is
the same result by more work.  Factors and windows are told apart by two 64-bit hashes.

Earlier means smaller document id, then earlier start; rows that share an id but not the text are ordered by
a hash of the text at equal starts.  Identical rows count once and share their result.  Null and empty
texts have no words and lose none; a null id comes first; a text of under ``size`` words stays whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from creditloom.llm.common import U64, WHITE, RangeHash, free_names, mix, row_key, slices, utf8, word_hashes, word_spans
from creditloom.llm.scratch import materialize

SIZE = 20
ANCHOR = 6
#: Factors that a task gathers before it settles repeats among them.
GATHER = 1_000_000
ANCHOR_CLASSES = 65_536

_ROOM = 28
_PLACE = U64(2**_ROOM - 1)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` consecutive ones."""
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[: len(values) - (width - have)], values[width - have :]) if have < width else values


def factors(column: pa.Array, size: int = SIZE, anchor: int = ANCHOR):
    """Row, start, windows, anchor hash and factor hash of every factor of the texts of a column."""
    raw, borders = utf8(column)
    starts, ends, first = word_spans(raw, borders)
    n = len(starts)
    if n < size:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    hashes = RangeHash(word_hashes(raw, starts, ends))
    at = np.arange(n - anchor + 1)
    grams = hashes(at, at + anchor)
    marked = (grams >> U64(_ROOM) << U64(_ROOM)) | (_PLACE - at.astype(np.uint64))
    least = sliding_min(marked, size - anchor + 1)
    step = np.zeros(n + 1, np.int64)
    long = np.diff(first) >= size
    np.add.at(step, first[:-1][long], 1)
    np.add.at(step, first[1:][long] - size + 1, -1)
    window = np.flatnonzero(np.cumsum(step)[:n] > 0)
    if not len(window):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    place = (_PLACE - (least[window] & _PLACE)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    start, count, place = window[new], np.diff(np.append(new, len(window))), place[new]
    whole = mix(hashes(start, start + count + size - 1) ^ mix((place - start + 1).astype(np.uint64)))
    row = np.searchsorted(first, start, "right") - 1
    return row, start - first[row], count, grams[place], whole


_FACTOR = "a long, h long, k_id long, k_text long, start int, windows int, settled boolean"


def _parse(batches):
    parts: list[tuple] = []
    held = 0
    for batch in batches:
        for part in slices(batch, "text"):
            row, start, count, a, h = factors(part.column(2))
            ids, texts = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False)
            parts.append((a, h, ids[row], texts[row], start.astype(np.int32), count.astype(np.int32)))
            held += len(row)
            if held >= GATHER:
                yield from _settle(parts)
                parts, held = [], 0
    if held:
        yield from _settle(parts)


def _settle(parts: list[tuple]):
    """Mark factors that stand earlier among those at hand."""
    a, h, ids, texts, start, count = (np.concatenate(x) for x in zip(*parts))
    both = mix(a ^ (h * U64(0xC2B2AE3D27D4EB4F)))
    order = np.lexsort((texts, start, ids, both))
    same = np.concatenate([[False], both[order][1:] == both[order][:-1]])
    settled = np.zeros(len(a), bool)
    settled[order] = same
    # An identical row is no earlier place.
    lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(a))))
    x, y = order, order[lead]
    settled[order] &= (ids[x] != ids[y]) | (texts[x] != texts[y]) | (start[x] != start[y])
    cols = [a.view(np.int64), h.view(np.int64), ids, texts, start, count, settled]
    for i in range(0, len(a), 100_000):
        yield pa.RecordBatch.from_arrays(
            [pa.array(c[i : i + 100_000]) for c in cols], names=["a", "h", "k_id", "k_text", "start", "windows", "settled"]
        )


def _compare_windows(batches):
    """Hashes of the windows of the blocks to be compared."""
    for batch in batches:
        for part in slices(batch, "text"):
            raw, borders = utf8(part.column(2))
            starts, ends, first = word_spans(raw, borders)
            words = word_hashes(raw, starts, ends)
            one, two = RangeHash(words), RangeHash(mix(words ^ U64(0xA0761D6478BD642F)))
            blocks = part.column(3)
            counts = np.diff(blocks.offsets.to_numpy())
            flat = blocks.flatten()
            begin, n = flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(part.num_rows), counts)
            total = int(n.sum())
            inner = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
            row, local = np.repeat(row, n), np.repeat(begin, n) + inner
            at = first[row] + local
            ids, texts = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False)
            cols = [one(at, at + SIZE).view(np.int64), two(at, at + SIZE).view(np.int64), ids[row], texts[row], local.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["v", "w", "k_id", "k_text", "start"])


def duplicate_spans(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """k_id, k_text and the (start, windows) of all duplicate spans of each row that has some."""
    keyed = docs.select(*row_key(id_column, text), F.col(text).alias("text"))
    found = materialize(keyed.mapInArrow(_parse, _FACTOR), "factors")
    apart = found.filter("not settled").drop("settled")
    anchor_class = F.pmod("a", F.lit(ANCHOR_CLASSES))
    sizes = apart.groupBy(anchor_class.alias("s_class")).count().collect()  # at most ANCHOR_CLASSES rows
    limit = 200 + 8 * sum(r["count"] for r in sizes) // ANCHOR_CLASSES
    frequent = found.sparkSession.createDataFrame([(r.s_class,) for r in sizes if r["count"] > limit], "s_class long")
    dealt = (
        apart.withColumn("s_key", anchor_class)
        .join(F.broadcast(frequent), F.col("s_key") == F.col("s_class"), "left")
        .withColumn("salt", F.when(F.col("s_class").isNotNull(), F.xxhash64("h")).otherwise(F.lit(0)))
        .drop("s_key", "s_class")
        .repartition("a", "salt")
    )
    group = Window.partitionBy("a", "salt")
    place = group.orderBy("h", "k_id", "start", "k_text")
    same_block = F.col("b_before.h") == F.col("h")
    same_place = F.col("b_before") == F.struct("h", "k_id", "start", "k_text")  # of an identical row
    block = (
        dealt.withColumn("b_before", F.lag(F.struct("h", "k_id", "start", "k_text")).over(place))
        .withColumn("b_more", F.min("h").over(group) != F.max("h").over(group))
        .withColumn("repeat", F.coalesce(same_block & ~same_place, F.lit(False)))
        .filter(F.col("repeat") | F.col("b_more") | (F.col("salt") != 0))
        .select("k_id", "k_text", "start", "windows", "repeat")
    )
    spans = materialize(
        found.filter("settled")
        .select("k_id", "k_text", "start", "windows", F.lit(True).alias("repeat"))
        .unionByName(block),
        "spans",
    )
    to_compare = (
        spans.filter("not repeat").distinct().groupBy("k_id", "k_text").agg(F.collect_list(F.struct("start", "windows")).alias("blocks"))
    )
    windows = materialize(
        keyed.dropDuplicates(["k_id", "k_text"])
        .join(to_compare, ["k_id", "k_text"])
        .select("k_id", "k_text", "text", "blocks")
        .mapInArrow(_compare_windows, "v long, w long, k_id long, k_text long, start int"),
        "windows",
    )
    order = F.struct("k_id", "start", "k_text")
    earliest = windows.groupBy("v", "w").agg(F.min(order).alias("e"), F.count("*").alias("e_n")).filter("e_n > 1")
    later = windows.join(earliest.drop("e_n"), ["v", "w"]).filter(order > F.col("e"))
    every = spans.filter("repeat").select("k_id", "k_text", "start", "windows").unionByName(
        later.select("k_id", "k_text", "start", F.lit(1).alias("windows"))
    )
    return every.groupBy("k_id", "k_text").agg(F.collect_list(F.struct("start", "windows")).alias("spans"))


def removed_words(n: int, starts: np.ndarray, windows: np.ndarray, size: int = SIZE) -> np.ndarray:
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, np.minimum(starts + windows + size - 1, n), -1)
    return np.cumsum(marks)[:n] > 0


def dedup(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> tuple[DataFrame, list[str]]:
    """``docs`` with n_words, n_removed and the kept words joined by spaces; and the names the columns got."""
    a, b, s = free_names(docs, ["k_id", "k_text", "spans"])
    n_words, n_removed, kept = free_names(docs, ["n_words", "n_removed", "kept_text"])
    spans = duplicate_spans(docs, id_column, text).toDF(a, b, s)
    keys = row_key(id_column, text)
    joined = docs.select("*", keys[0].alias(a), keys[1].alias(b)).join(spans, [a, b], "left").drop(a, b)
    new_fields = [(n_words, T.LongType()), (n_removed, T.LongType()), (kept, T.StringType())]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, kind) for n, kind in new_fields)])
    at, spans_at = docs.columns.index(text), len(docs.columns)

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                n, gone, texts = [], [], []
                for value, found in zip(part.column(at), part.column(spans_at)):
                    words = (value.as_py() or "").encode().split()
                    n.append(len(words))
                    if found.is_valid:
                        flat = found.values
                        out = removed_words(len(words), flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy().astype(np.int64))
                        words = [w for w, x in zip(words, out.tolist()) if not x]
                    gone.append(n[-1] - len(words))
                    texts.append(b" ".join(words).decode())
                new = [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns[:spans_at], *new], names=[*part.schema.names[:spans_at], n_words, n_removed, kept])

    return joined.mapInArrow(run, schema), [n_words, n_removed, kept]


def dedup_query(docs: DataFrame) -> DataFrame:
    out, (n, gone, kept) = dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col(n).alias("n_words"), F.col(gone).alias("n_removed"), F.sha2(kept, 256).alias("kept_sha256"))


assert sorted(WHITE) == sorted(b" \t\n\x0b\x0c\r")  # what bytes.split() takes as white space
