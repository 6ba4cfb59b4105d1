"""Shared pieces of the text operators: Arrow batches, vectorised words, scratch tables.

Rows are told apart by ``row_key``: the document id and a 64-bit hash of the text, so repeated ids with other
texts stay separate rows and identical rows count once and share their result.  Null and empty text differ.
A null id sorts first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

U64 = np.uint64
NULL_ID = -(2**63)
#: The text key of a null text.
NULL_TEXT = -(2**63)

#: Bytes of text that one vectorised step works on; a longer text is a step of its own.
STEP_BYTES = 2_000_000

WHITE = bytes([0x20, *range(0x09, 0x0E)])


def slices(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` bytes of text."""
    sizes = np.diff(utf8(batch.column(batch.schema.get_field_index(column)))[1])
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the row borders in them; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, borders, data = column.buffers()
    borders = np.frombuffer(borders, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[borders[0] : borders[-1]], borders - borders[0]


def delimiter_table(delimiters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(delimiters)] = True
    return table


WHITE_TABLE = delimiter_table(WHITE)


def word_spans(raw: np.ndarray, borders: np.ndarray, table: np.ndarray = WHITE_TABLE):
    """Starts and ends of all words, and for each row the index of its first word (one more at the end)."""
    inside = ~table[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = np.unique(borders[(borders > 0) & (borders < len(raw))])
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, borders)


_BASE = U64(0x9E3779B97F4A7C15 | 1)
_INVERSE = U64(pow(int(_BASE), -1, 2**64))
_BYTE_CODES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_powers: dict[str, np.ndarray] = {}


def _power_table(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        grown = np.full(max(n, STEP_BYTES + 1), base, np.uint64)
        grown[0] = 1
        have = np.cumprod(grown, dtype=np.uint64)
        if n <= 8 * STEP_BYTES:
            _powers[name] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(31))
    h = h * U64(0x7FB5D329728EA185)
    h = h ^ (h >> U64(27))
    h = h * U64(0x81DADEF4BC2DD44D)
    return h ^ (h >> U64(33))


class RangeHash:
    """Hashes of any ranges of a sequence of codes, from one prefix sum (a polynomial modulo 2**64)."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * _power_table("inverse", _INVERSE, n), out=self.sums[1:])
        self.power = _power_table("base", _BASE, n + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.power[starts] + (ends - starts).astype(np.uint64))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return RangeHash(_BYTE_CODES[raw])(starts, ends)


def free_names(df: DataFrame, names: list[str]) -> list[str]:
    """``names`` with underscores in front until none is a column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def append(df: DataFrame, text: str, fields: list[tuple[str, T.DataType]], make: Callable[[], Callable]) -> tuple[DataFrame, list[str]]:
    """``df`` with columns computed from a text column; returns it and the names the columns got.

    ``make`` runs once in a task and returns a function from the text column of a slice to the new columns.
    """
    names = free_names(df, [name for name, _ in fields])
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, kind) for n, (_, kind) in zip(names, fields))])
    at = df.columns.index(text)

    def run(batches):
        work = make()
        for batch in batches:
            for part in slices(batch, text):
                new = work(part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *names])

    return df.mapInArrow(run, schema), names


def row_key(id_column: str, text: str):
    """Columns that order and identify rows."""
    return (
        F.coalesce(F.col(id_column).cast("long"), F.lit(NULL_ID)).alias("k_id"),
        F.when(F.col(text).isNull(), F.lit(NULL_TEXT)).otherwise(F.xxhash64(text)).alias("k_text"),
    )
