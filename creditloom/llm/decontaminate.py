"""Finding benchmark passages in documents by Wu-Manber multi-pattern search.

Texts and benchmark items are brought to one form: A-Z lower-cased, runs of anything but ASCII letters,
digits and characters beyond ASCII made one space, one space before and after.  The test strings are all
windows of ``size`` words of an item (an item of fewer words is one window) with their outer spaces, so a
byte match is a word match.  They are searched in length classes.  Per class, a table over hashed blocks of
bytes holds how far the search may skip when it sees a block; at positions that allow no skip, the hash of
the window's last and first block selects test strings, and comparing the bytes decides.  A text is
searched in many lanes at once, so a task handles slices of bounded size and no group of rows meets anywhere.

The benchmark is broadcast in blocks of at most ``block_bytes`` of item text; every block is searched in
turn over the same rows, so any benchmark size gives whole results.

Null and empty texts have no words and no hits; a null item has no windows, a null item id counts as an
empty one; items repeated under one id count once; repeated documents give a result each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from creditloom.llm.common import U64, free_names, mix, slices

SIZE = 10
BLOCK_BYTES = 8_000_000

_KEEP = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
_FORM = bytes(b if b in _KEEP else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

#: Length classes of test strings: a class is searched with the shortest length it may hold.
CLASSES = (3, 6, 12, 24, 48)
LANE = 4096


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FORM).split()


def windows_of(words: list[bytes], size: int) -> list[list[bytes]]:
    if not words:
        return []
    return [words[i : i + size] for i in range(max(1, len(words) - size + 1))]


class _Class:
    """The test strings of one length class."""

    def __init__(self, strings: list[bytes], numbers: list[int]):
        self.m = m = min(map(len, strings))
        self.width = width = min(8, m)
        self.mask = U64(2 ** (8 * width) - 1)
        self.bits = max(12, min(22, int(np.ceil(np.log2(len(strings) * (m - width + 1) + 1))) + 3))
        self.shift = np.full(2**self.bits, m - width + 1, np.int32)
        for back in range(m - width, -1, -1):  # from the greatest skip to none, so the least one stays
            blocks = self.blocks(b"".join(s[m - width - back : m - back].ljust(8, b"\0") for s in strings))
            self.shift[self.slot(blocks)] = back
        first = self.blocks(b"".join(s[:width].ljust(8, b"\0") for s in strings))
        last = self.blocks(b"".join(s[m - width : m].ljust(8, b"\0") for s in strings))
        keys = self.key(first, last)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.strings = [strings[i] for i in order]
        self.numbers = [numbers[i] for i in order]

    def blocks(self, joined: bytes) -> np.ndarray:
        return np.frombuffer(joined, "<u8") & self.mask

    def slot(self, blocks: np.ndarray) -> np.ndarray:
        return ((blocks * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    @staticmethod
    def key(first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return mix(first * U64(0xD6E8FEB86659FD93) ^ mix(last))

    def find(self, data: bytes, eights: np.ndarray, length: int):
        """(start, number of the test string) of every occurrence in ``data[:length]``."""
        at = np.arange(0, max(0, length - self.m + 1), LANE)
        stop = np.minimum(at + LANE, length - self.m + 1)
        back = self.m - self.width
        out = []
        while len(at):
            last = eights[at + back] & self.mask
            skip = self.shift[self.slot(last)]
            hit = np.flatnonzero(skip == 0)
            if len(hit):
                start, keys = at[hit], self.key(eights[at[hit]] & self.mask, last[hit])
                lo, hi = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
                for i in np.flatnonzero(hi > lo):
                    s = int(start[i])
                    for j in range(lo[i], hi[i]):
                        if data.startswith(self.strings[j], s):
                            out.append((s, self.numbers[j]))
            at = at + np.maximum(skip, 1)
            going = at < stop
            if not going.all():
                at, stop = at[going], stop[going]
        return out


class Searcher:
    """All test strings of a block of the benchmark."""

    def __init__(self, items: list[tuple[str, str]], size: int = SIZE):
        owners: dict[bytes, set[str]] = {}
        lengths: dict[bytes, int] = {}
        for item_id, text in items:
            for window in windows_of(words_of(text), size):
                string = b" " + b" ".join(window) + b" "
                owners.setdefault(string, set()).add(item_id)
                lengths[string] = len(window)
        strings = sorted(owners)
        self.owners = [sorted(owners[s]) for s in strings]
        self.words = [lengths[s] for s in strings]
        self.classes = []
        for low, high in zip(CLASSES, (*CLASSES[1:], 2**62)):
            inside = [i for i, s in enumerate(strings) if low <= len(s) < high]
            if inside:
                self.classes.append(_Class([strings[i] for i in inside], inside))

    def search(self, texts: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set[str]]]:
        """For each text, the (first word, words) of its occurrences and the items they belong to."""
        data = b"".join(b" " + b" ".join(t) + b" \n" if t else b"" for t in texts)
        length = len(data)
        data += b"\n" * 16
        raw = np.frombuffer(data, np.uint8)
        eights = np.ndarray((length + 9,), "<u8", data, strides=(1,))
        found = [x for c in self.classes for x in c.find(data, eights, length)]
        out: list[tuple[list[tuple[int, int]], set[str]]] = [([], set()) for _ in texts]
        if found:
            spaces = np.flatnonzero(raw[:length] == 32)
            firsts = np.cumsum([0, *(len(t) + 1 if t else 0 for t in texts)])
            where = np.searchsorted(spaces, [s for s, _ in found])
            doc = np.searchsorted(firsts, where, "right") - 1
            for d, w, (_, k) in zip(doc.tolist(), where.tolist(), found):
                out[d][0].append((w - int(firsts[d]), self.words[k]))
                out[d][1].update(self.owners[k])
        return out


def item_blocks(benchmark: DataFrame, block_bytes: int) -> list[list[tuple[str, str]]]:
    """The benchmark in blocks of bounded size; each is read on its own."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    return [[(r.item_id, r.text) for r in items.filter(number == b).collect()] for b in range(blocks)]


def contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", size: int = SIZE, block_bytes: int = BLOCK_BYTES
) -> tuple[DataFrame, list[str]]:
    """``docs`` with n_words, n_hit, n_items, items (sorted ids) and contaminated; and the names the columns got."""
    spark, given = docs.sparkSession, docs.columns
    blocks = [spark.sparkContext.broadcast(items) for items in item_blocks(benchmark, block_bytes)]
    before: list[str] = []
    for items in blocks[:-1]:
        docs, before = _search_block(docs, text, items, size, before)
    docs, names = _search_block(docs, text, blocks[-1], size, before, final=True)
    return docs.select(*given, *names), names


_FOUND = [("found_spans", T.ArrayType(T.IntegerType())), ("found_items", T.ArrayType(T.StringType()))]
_RESULT = [
    ("n_words", T.LongType()),
    ("n_hit", T.LongType()),
    ("n_items", T.LongType()),
    ("items", T.ArrayType(T.StringType())),
    ("contaminated", T.BooleanType()),
]


def _search_block(docs: DataFrame, text: str, items, size: int, before: list[str], final: bool = False):
    """One block of the benchmark over all rows; ``before`` names the columns with what earlier blocks found."""
    fields = _RESULT if final else _FOUND
    names = free_names(docs, [n for n, _ in fields])
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, kind) for n, (_, kind) in zip(names, fields))])
    at, old_at = docs.columns.index(text), [docs.columns.index(c) for c in before]

    def run(batches):
        searcher = Searcher(items.value, size)
        for batch in batches:
            for part in slices(batch, text):
                texts = [words_of(x) for x in part.column(at).to_pylist()]
                old = [part.column(i).to_pylist() for i in old_at] or [[[]] * len(texts), [[]] * len(texts)]
                found = searcher.search(texts)
                spans = [[*o, *(x for pair in s for x in pair)] for o, (s, _) in zip(old[0], found)]
                owners = [sorted({*o, *i}) for o, (_, i) in zip(old[1], found)]
                new = [pa.array(spans, pa.list_(pa.int32())), pa.array(owners, pa.list_(pa.string()))]
                if final:
                    hit = pa.array([covered(s, len(t)) if s else 0 for s, t in zip(spans, texts)], pa.int64())
                    counts = [pa.array([len(t) for t in texts], pa.int64()), hit, pa.array([len(o) for o in owners], pa.int64())]
                    new = [*counts, new[1], pc.greater(hit, 0)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *names])

    return docs.mapInArrow(run, schema), names


def covered(spans: list[int], n: int) -> int:
    """Words inside any of the spans (first word and words, one after the other)."""
    marks = np.zeros(n + 1, np.int64)
    pairs = np.array(spans, np.int64).reshape(-1, 2)
    np.add.at(marks, pairs[:, 0], 1)
    np.add.at(marks, pairs.sum(1), -1)
    return int((np.cumsum(marks)[:n] > 0).sum())


def contamination_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    out, (n, hit, count, items, bad) = contamination(docs.select("doc_id", "text"), benchmark)
    return out.select(
        "doc_id",
        F.col(n).alias("n_words"),
        F.col(hit).alias("n_hit"),
        F.col(count).alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort(items)), 256).alias("items_sha256"),
        F.col(bad).alias("contaminated"),
    )
