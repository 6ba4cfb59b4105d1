"""Phrases of words that stand together more often than chance, mined with stripes.

Each prefix keys a stripe, an associative counter of the words that follow it.  A pass over the texts makes the
stripes of all frequent prefixes of one length, summed up in the task before they are shuffled; equal keys are
merged elementwise, and one merged stripe gives three things: its extensions (the entries frequent enough are the
phrases one word longer, and their counts the totals of the next prefixes), the total of a group in the stripe of its
empty prefix, and the largest extension, which subsumes the prefix if it is as frequent.  The empty prefix counts single words, so there
are ``longest`` passes.

A phrase is frequent only if both its parts without the last and without the first word are.  The passes know the
frequent phrases of the length before as bits at their hashes, a table of at most 2**30 bits that is sized from
their number; a hash that is set by chance makes a needless entry, no wrong count.  Beyond some 10**9 frequent
phrases of one length the table fills up and leaves out less, with the same result.  Words and phrases are counted exactly:
in a task by dictionary codes and numbered pairs, in the merge by their text.

Stripes travel in buckets, one for about ``BUCKET_WORDS`` words of the whole corpus: a row holds those stripes of a task
that fall into one bucket.  A stripe has its bucket by the hash of its prefix; that of a prefix that makes up 1 / ``HOT`` of
all words or more is dealt over ``SHARDS`` buckets by its next words, that of the empty prefix over all.  By
their share there are at most ``HOT`` such prefixes.  A task sends an entry once for each ``CHUNK`` bytes of text, however
often it occurs there.  The merge reads sorted rows and holds one bucket at a time.

A group is a value of the group column, null is ``und``.  Null and empty texts have no words.  Repeated ids and
rows count each; an empty table gives no phrases.  Phrases are ranked by score, count and UTF-8 bytes, so there are no ties.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from creditloom.llm.common import U64, delimiter_table, mix, slices, utf8, word_hashes, word_spans
from creditloom.llm.periods import numbered, word_array
from creditloom.llm.scratch import materialize

LEAST = 100
LONGEST = 5
TOP = 2000

#: Bytes of text whose stripes are summed up in a task before they are sent.
CHUNK = 12_000_000
#: A prefix with this share of all words has its stripe dealt over several buckets.
HOT = 256
SHARDS = 64
#: Words of the corpus to a bucket, and the buckets there are at least.
BUCKET_WORDS = 2**18
LEAST_BUCKETS = 1024
#: Bits for each frequent phrase, and the bounds of the table as powers of two.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 20, 30

BLANKS, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
_CUTS, _BREAKS = delimiter_table(BLANKS + BREAKS), delimiter_table(BREAKS)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

#: Stripes on their way: prefixes by lines, their next words by lines and spaces, and 32-bit counts.
_STRIPE = "lang string, bucket int, prefixes string, nexts string, counts binary"
_KEYS = ["lang", "bucket"]
_MERGED = "lang string, prefix string, total bigint, nexts array<string>, counts array<bigint>, hashes array<bigint>"
_SALTS = 64


def gram_hashes(group: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """Hashes of phrases from the hashes of their group and of their words in order."""
    h = group
    for w in words:
        h = mix(h * U64(0x9E3779B97F4A7C15) + w)
    return h


def text_hashes(texts: pa.Array) -> np.ndarray:
    raw, borders = utf8(texts)
    return word_hashes(raw, borders[:-1], borders[1:])


class Bits:
    """Bits at the hashes of frequent phrases."""

    def __init__(self, table: np.ndarray, power: int):
        self.table, self.power = table, power

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> U64(64 - self.power)
        return (self.table[at >> U64(6)] >> (at & U64(63))) & U64(1) > 0


def bits_of(level: DataFrame) -> Bits:
    """The table for the entries of a level; bits are set in Spark and at most 2**MOST_BITS of them fetched."""
    h = level.select(F.explode("hashes").alias("h"))
    count = h.count()
    power = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(BITS_EACH * max(count, 1)))))
    at = F.shiftrightunsigned("h", 64 - power)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    found = h.groupBy(F.shiftrightunsigned(at, 6).alias("block")).agg(F.bit_or(bit).alias("bits")).toArrow()
    table = np.zeros(2 ** (power - 6), np.uint64)
    table[found.column("block").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return Bits(table, power)


def chunk_stripes(groups: pa.Array, texts: pa.Array, k: int, bits: Bits | None, hot: set[tuple[str, str]], buckets: int) -> pa.RecordBatch | None:
    """The stripes of all frequent prefixes of ``k`` words in some texts, summed up."""
    raw, borders = utf8(texts)
    raw = _LOWER[raw]
    starts, ends, first = word_spans(raw, borders, _CUTS)
    n = len(starts)
    if n == 0:
        return None
    row = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(first))
    breaks = np.cumsum(_BREAKS[raw], dtype=np.int32)[starts] if len(raw) < 2**31 else np.cumsum(_BREAKS[raw])[starts]
    # left: how many words a piece has from each word on.
    begins = np.r_[np.flatnonzero((np.diff(breaks) != 0) | (np.diff(row) != 0)) + 1, n]
    left = np.repeat(begins, np.diff(np.r_[0, begins])) - np.arange(n)
    coded = word_array(raw, starts, ends).dictionary_encode()
    del raw, starts, ends, breaks, begins
    code, words = coded.indices.to_numpy(), coded.dictionary
    named = groups.cast(pa.large_string()).fill_null("und").dictionary_encode()
    group = named.indices.to_numpy()[row]
    word_hash = text_hashes(words)
    size = len(words)
    if k == 0:
        at = np.arange(n)
    else:
        whole = np.flatnonzero(left >= k)
        hashes = gram_hashes(text_hashes(named.dictionary)[group[whole]], [word_hash[code[whole + j]] for j in range(k)])
        frequent = np.zeros(n + 1, bool)
        frequent[whole] = bits(hashes)
        del whole, hashes
        at = np.flatnonzero(frequent[:-1] & frequent[1:] & (left > k))
    if len(at) == 0:
        return None
    del left
    prefix = numbered(group[at])
    for j in range(k):
        prefix = numbered(prefix * size + code[at + j])
    sample = np.zeros(prefix.max() + 1, np.int64)
    sample[prefix] = at
    entry, counts = np.unique(prefix * size + code[at + k], return_counts=True)
    del prefix, at
    owner, word = entry // size, entry % size
    sample_group = named.dictionary.take(pa.array(group[sample]))
    columns = [words.take(pa.array(code[sample + j])) for j in range(k)]
    text = pc.binary_join_element_wise(*columns, pa.scalar(" ", pa.large_string())) if k else pa.array([""] * len(sample), pa.large_string())
    # A hot stripe is dealt out by its next words.
    bucket = text_hashes(text)[owner]
    if k == 0:
        bucket = word_hash[word]
    elif hot:
        dealt = np.array([x in hot for x in zip(sample_group.to_pylist(), text.to_pylist())])[owner]
        bucket[dealt] += word_hash[word[dealt]] % U64(SHARDS)
    bucket = (bucket % U64(buckets)).astype(np.int64)
    lang = group[sample][owner]
    order = np.lexsort((owner, bucket, lang))
    owner, word, bucket, lang, counts = owner[order], word[order], bucket[order], lang[order], counts[order].astype(np.int32)
    new_row = np.r_[True, (np.diff(bucket) != 0) | (np.diff(lang) != 0)]
    new_stripe = np.flatnonzero(new_row | np.r_[True, np.diff(owner) != 0])
    rows = np.flatnonzero(new_row)
    stripes = np.r_[np.flatnonzero(new_row[new_stripe]), len(new_stripe)]
    keys = [named.dictionary.take(pa.array(lang[rows])), pa.array(bucket[rows], pa.int32())]
    nexts = _joined(words.take(pa.array(word)), np.r_[new_stripe, len(word)], " ")
    places = pa.py_buffer((np.r_[rows, len(word)] * counts.itemsize).astype(np.int32))
    numbers = pa.Array.from_buffers(pa.binary(), len(rows), [None, places, pa.py_buffer(counts)])
    lines = [_joined(text.take(pa.array(owner[new_stripe])), stripes, "\n"), _joined(nexts, stripes, "\n")]
    return pa.RecordBatch.from_arrays([keys[0].cast(pa.string()), keys[1], *(x.cast(pa.string()) for x in lines), numbers], names=[*_KEYS, "prefixes", "nexts", "counts"])


def _joined(texts: pa.Array, borders: np.ndarray, by: str) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(borders, pa.int32()), texts), pa.scalar(by, texts.type))


def unpacked(table: pa.Table) -> pa.Table:
    """One row per stripe: lang, bucket, prefix, next words and 64-bit counts."""
    table = table.combine_chunks()
    column = lambda name: table.column(name).combine_chunks()
    prefixes, stripes = pc.split_pattern(column("prefixes"), "\n"), pc.split_pattern(column("nexts"), "\n")
    nexts = pc.split_pattern(stripes.flatten(), " ")
    raw = column("counts")
    borders = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
    counts = np.frombuffer(raw.buffers()[2], np.int32, (borders[-1] - borders[0]) // 4, borders[0]).astype(np.int64)
    sizes = pc.list_value_length(nexts).to_numpy()
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(counts))
    keys = table.select(_KEYS).take(pc.list_parent_indices(prefixes))
    return pa.table([*keys.columns, prefixes.flatten(), nexts, lists], names=[*_KEYS, "prefix", "nexts", "counts"])


def merge_stripes(table: pa.Table) -> pa.Table:
    """Stripes of one bucket, which stand together, merged prefix by prefix: counters are added word by word."""
    table = table.combine_chunks()
    changed = np.zeros(len(table), bool)
    for name in _KEYS:
        key = table.column(name)
        changed[1:] |= pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)
    coded = table.column("prefix").combine_chunks().dictionary_encode()
    group = numbered(np.cumsum(changed) * len(coded.dictionary) + coded.indices.to_numpy())
    nexts, counts = table.column("nexts").combine_chunks(), table.column("counts").combine_chunks()
    coded = nexts.flatten().dictionary_encode()
    size = len(coded.dictionary)
    entry = np.repeat(group, pc.list_value_length(nexts).to_numpy()) * size + coded.indices.to_numpy()
    order = np.argsort(entry, kind="stable")
    entry = entry[order]
    begins = np.flatnonzero(np.r_[True, np.diff(entry) != 0])
    summed = np.add.reduceat(counts.flatten().to_numpy()[order], begins)
    owner, word = entry[begins] // size, entry[begins] % size
    heads = np.flatnonzero(np.r_[True, np.diff(np.maximum.accumulate(group)) > 0])  # groups are numbered as they come
    offsets = pa.array(np.searchsorted(owner, np.arange(len(heads) + 1)), pa.int32())
    merged = [pa.ListArray.from_arrays(offsets, coded.dictionary.take(pa.array(word))), pa.ListArray.from_arrays(offsets, pa.array(summed, pa.int64()))]
    return pa.table([*table.select([*_KEYS, "prefix"]).take(pa.array(heads)).columns, *merged], names=table.schema.names)


def frequent_entries(merged: pa.Table, k: int, least: int) -> pa.RecordBatch:
    """Totals of merged stripes and their entries of at least ``least``, with the hashes of the longer phrases."""
    merged = merged.combine_chunks()
    nexts, counts = merged.column("nexts").combine_chunks(), merged.column("counts").combine_chunks()
    values = counts.flatten().to_numpy()
    borders = np.r_[0, np.cumsum(pc.list_value_length(counts).to_numpy())]
    total = np.diff(np.r_[0, np.cumsum(values)][borders])
    enough = values >= least
    offsets = pa.array(np.r_[0, np.cumsum(enough)][borders], pa.int32())
    words = nexts.flatten().filter(pa.array(enough))
    owner = np.repeat(np.arange(len(merged)), np.diff(borders))[enough]
    hashes = np.zeros(0, np.uint64)
    if len(owner):
        parts = [text_hashes(merged.column("lang").combine_chunks())[owner]]
        if k:
            split = pc.split_pattern(merged.column("prefix").combine_chunks(), " ").flatten()
            parts += [text_hashes(split)[owner * k + j] for j in range(k)]
        hashes = gram_hashes(parts[0], [*parts[1:], text_hashes(words)])
    lists = [words, pa.array(values[enough], pa.int64()), pa.array(hashes.view(np.int64), pa.int64())]
    columns = [merged.column("lang").combine_chunks(), merged.column("prefix").combine_chunks(), pa.array(total, pa.int64())]
    out = pa.RecordBatch.from_arrays(
        [*columns, *(pa.ListArray.from_arrays(offsets, x) for x in lists)], names=["lang", "prefix", "total", "nexts", "counts", "hashes"]
    )
    return out if k == 0 else out.filter(pa.array(np.diff(np.asarray(offsets)) > 0))


def level(texts: DataFrame, k: int, bits: Bits | None, hot: set[tuple[str, str]], buckets: int, least: int) -> DataFrame:
    """Merged stripes of the frequent prefixes of ``k`` words: total and frequent entries."""
    known = texts.sparkSession.sparkContext.broadcast((bits and (bits.table, bits.power), hot))

    def count(batches):
        table, hot_prefixes = known.value
        found = table and Bits(*table)
        pending, held = [], 0
        for batch in batches:
            for part in slices(batch, "text", CHUNK):
                nbytes = len(utf8(part.column(1))[0])
                if held and held + nbytes > CHUNK:
                    yield from stripes(pending, found, hot_prefixes)
                    pending, held = [], 0
                pending.append(part)
                held += nbytes
        yield from stripes(pending, found, hot_prefixes)

    def stripes(pending, found, hot_prefixes):
        if pending:
            table = pa.Table.from_batches(pending).combine_chunks()
            columns = [table.column(i).cast(pa.large_string()).combine_chunks() for i in (0, 1)]
            out = chunk_stripes(columns[0], columns[1], k, found, hot_prefixes, buckets)
            if out is not None:
                for at in range(0, out.num_rows, 2_000):
                    yield out.slice(at, 2_000)

    def merge(batches):
        carry = None
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                table = unpacked(pa.Table.from_batches([batch.slice(at, 1_000)]))
                table = merge_stripes(table if carry is None else pa.concat_tables([carry, table]))
                last = [table.column(n)[len(table) - 1] for n in _KEYS]
                open_ = pc.and_(*(pc.equal(table.column(n), x) for n, x in zip(_KEYS, last)))
                done = table.filter(pc.invert(open_))
                if len(done):
                    yield frequent_entries(done, k, least)
                carry = table.filter(open_)
        if carry is not None:
            yield frequent_entries(carry, k, least)

    dealt = texts.mapInArrow(count, _STRIPE).repartition(*_KEYS).sortWithinPartitions(*_KEYS)
    return materialize(dealt.mapInArrow(merge, _MERGED), f"stripes_{k}")


def phrases(
    docs: DataFrame, text: str = "text", group: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP
) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n and score of the best ``top`` phrases of 2 to ``longest`` words of each group.

    a counts the phrase, l and r the parts of its lowest-scoring cut, n the group's words; score is
    floor(1000 * a * n / (l * r)).  A phrase in a longer one of the same count is left out.
    """
    texts = docs.select(F.col(group).cast("string").alias("lang"), F.col(text).alias("text"))
    levels, hot, bits, buckets = [], set(), None, 4 * LEAST_BUCKETS
    for k in range(longest):
        now = level(texts, k, bits, hot, buckets, least)
        levels.append(now)
        if k + 1 < longest:
            if k == 0:
                everything = now.agg(F.sum("total")).first()[0] or 0
                buckets = max(LEAST_BUCKETS, everything // BUCKET_WORDS)
            entries = _entries(now, k)
            share = -(-everything // HOT)
            hot = {(r.lang, r.phrase) for r in entries.filter(F.col("f") >= max(share, 1)).select("lang", "phrase").collect()}  # at most HOT rows
            bits = bits_of(now)
    counted = materialize(reduce(DataFrame.unionByName, (_entries(now, k) for k, now in enumerate(levels))), "counted")
    totals = levels[0].groupBy("lang").agg(F.sum("total").alias("n"))
    longer = counted.filter("len > 1").withColumnRenamed("f", "a")
    extended = reduce(DataFrame.unionByName, (now.select("lang", F.col("prefix").alias("phrase"), F.array_max("counts").alias("most")) for now in levels[1:]))
    preceded = counted.filter("len > 2").select("lang", F.expr("substring(phrase, locate(' ', phrase) + 1)").alias("phrase"), F.col("f").alias("most"))
    inside = extended.unionByName(preceded).groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    alone = longer.join(inside, ["lang", "phrase"], "left").filter("most is null or most < a").drop("most")
    cuts = alone.withColumn("words", F.split("phrase", " ")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("len") - 1)))
    cuts = cuts.select(
        "lang",
        "phrase",
        "a",
        "k",
        F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("head"),
        F.array_join(F.slice("words", F.col("k") + 1, F.col("len") - F.col("k")), " ").alias("tail"),
    )
    cuts = cuts.join(counted.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(counted.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    wide = lambda c: F.col(c).cast("decimal(17,0)")  # noqa: E731  products of two stay exact
    scored = cuts.join(totals, "lang").withColumn("upper", wide("a") * wide("n") * F.lit(1000).cast("decimal(4,0)"))
    scored = scored.withColumn("lower", wide("l") * wide("r")).withColumn("score", F.expr("upper div lower"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    best = best.select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = best.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("place") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _entries(now: DataFrame, k: int) -> DataFrame:
    pairs = now.select("lang", "prefix", F.explode(F.arrays_zip("nexts", "counts")).alias("e"))
    phrase = F.concat_ws(" ", "prefix", "e.nexts") if k else F.col("e.nexts")
    return pairs.select("lang", phrase.alias("phrase"), F.lit(k + 1).alias("len"), F.col("e.counts").alias("f"))
