"""Periodic runs of words: passages that repeat one group of words over and over.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) and a length of at
least ``least_words`` and ``least_periods`` times q that no neighbouring word extends.  Per document the words
are named in a dictionary of basic factors: the factor of length 1 at a place is its word, and the factor of
length 2L is named by the names of its two halves.  At each length L a factor's next occurrence at distance d,
L/2 < d <= L, proposes the period d: occurrences that lie within twice the factor's length form an arithmetic
progression whose difference is the period.  In a run with smallest period q, take the L with L/2 < q <= L; every factor
of length L that has room for one more period in the run recurs first at distance q, since a nearer one would be a smaller
period.  So the places that propose q are consecutive, from the run's first word to L + q words before its end, and the run
can be read from them.  Conversely a chain of places that propose d is a stretch whose smallest period is d.
Each run therefore comes from one chain of one length, extended as far as it goes, and none comes twice.

Places whose factor occurs once in the document are left out of longer factors, so texts without repeats end
after a few lengths.  Names are exact (pairs of names are numbered), never hashes.

Null, empty and blank texts have no words and no runs; their collapsed text is empty.  Rows are independent:
repeated ids and rows give a result each.  Documents are worked on whole, in slices balanced by bytes; columns
of the input keep their names, clashing new ones get underscores in front.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from creditloom.llm.common import append, utf8, word_spans
from creditloom.llm.rules import words_of

LEAST_WORDS = 24
LEAST_PERIODS = 3

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def word_array(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words as a string array; spans are in order and do not overlap."""
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    letters = raw[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
    return pa.Array.from_buffers(pa.large_utf8(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])


def numbered(keys: np.ndarray) -> np.ndarray:
    """Equal keys get equal numbers from 0."""
    return pd.factorize(keys)[0].astype(np.int64)


def chains(at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of every stretch of consecutive places with one period; ``at`` ascends."""
    breaks = np.flatnonzero((np.diff(at) != 1) | (np.diff(period) != 0)) + 1
    return np.r_[0, breaks].astype(np.int64), np.r_[breaks, len(at)].astype(np.int64) - 1


def runs_of(names: np.ndarray, first: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS):
    """Starts (in the whole sequence), lengths and periods of all runs.

    ``names`` are equal for equal words; document i has the words from ``first[i]`` to before ``first[i + 1]``.
    """
    if least_periods < 3:
        raise ValueError("a run has three periods or more")
    sizes = np.diff(first)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    end = first[1:][owner]
    at = np.arange(len(names))
    name = numbered(owner * (names.max(initial=0) + 1) + names)
    found = []
    width = 1
    while len(at):
        order = np.argsort(name, kind="stable")
        same = name[order][1:] == name[order][:-1]
        gap = np.diff(at[order])
        near = same & (2 * gap > width) & (gap <= width)
        if near.any():
            where, period = at[order][:-1][near], gap[near]
            back = np.argsort(where)
            where, period = where[back], period[back]
            a, b = chains(where, period)
            start, q = where[a], period[a]
            length = where[b] + width + q - start
            long = (length >= least_words) & (length >= least_periods * q)
            found.append((start[long], length[long], q[long]))
        again = np.zeros(len(at), bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        dense = np.full(len(names), -1, np.int64)
        dense[at[again]] = name[again]
        at = at[again]
        at = at[at + 2 * width <= end[at]]
        at = at[dense[at + width] >= 0]
        name = numbered(dense[at] * (dense.max(initial=0) + 1) + dense[at + width])
        width *= 2
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, length, q = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((q, start))
    return start[order], length[order], q[order]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact length / period; of equal ones the first by start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def periodic_runs(
    docs: DataFrame, text: str = "text", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS
) -> tuple[DataFrame, list[str]]:
    """``docs`` with n_words, all runs by start and period, the strongest run (null without one), and the text without
    the words that repeat a run's first period, joined by one space.  Returns the names the four columns got.
    """

    def make():
        def work(column: pa.Array):
            raw, borders = utf8(column)
            starts, ends, first = word_spans(raw, borders)
            words = word_array(raw, starts, ends)
            codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
            start, length, q = runs_of(codes, first, least_words, least_periods)
            step = np.zeros(len(codes) + 1, np.int64)
            np.add.at(step, start + q, 1)
            np.add.at(step, start + length, -1)
            kept = np.cumsum(step[:-1]) <= 0
            left = np.r_[0, np.cumsum(kept)][first]
            joined = pc.binary_join(
                pa.ListArray.from_arrays(pa.array(left, pa.int32()), words.filter(pa.array(kept))), pa.scalar(" ", pa.large_string())
            )
            owner = np.searchsorted(first, start, side="right") - 1
            local = start - first[owner]
            lists = np.searchsorted(owner, np.arange(len(column) + 1))
            parts = [pa.array(x, pa.int64()) for x in (local, length, q)]
            runs = pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.StructArray.from_arrays(parts, names=RUN.names))
            rows = list(zip(local.tolist(), length.tolist(), q.tolist()))
            best = [strongest(rows[a:b]) for a, b in zip(lists[:-1].tolist(), lists[1:].tolist())]
            top = pa.array([x and dict(zip(RUN.names, x)) for x in best], pa.struct([(n, pa.int64()) for n in RUN.names]))
            return pa.array(np.diff(first), pa.int64()), runs, top, joined.cast(pa.string())

        return work

    fields = [("n_words", T.LongType()), ("runs", T.ArrayType(RUN)), ("strongest", RUN), ("collapsed", T.StringType())]
    return append(docs, text, fields, make)


def planted(doc_id: str, text: str) -> Column:
    """The text of the contract: in a tenth of the documents the words from some place on repeat with one period."""
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = words_of(F.col(text))
    n = F.size(words).cast("long")
    a = F.pmod(g, F.greatest(n, F.lit(1)))
    p = F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8)))) + 1
    period = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(period, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    changed = F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " ")
    return F.when((F.pmod(h, F.lit(10)) == 0) & F.col(text).isNotNull() & (n > 0), changed).otherwise(F.col(text))


def runs_query(docs: DataFrame) -> DataFrame:
    """Digest per document of the runs in its text, periods planted as ``planted`` says."""
    texts = docs.select("doc_id", planted("doc_id", "text").alias("text"))
    out, (_, runs, top, collapsed) = periodic_runs(texts)
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.concat(F.array_join(F.transform(F.col(runs), line), "\n"), F.when(F.size(runs) > 0, "\n").otherwise(""))
    best = F.col(top)
    return out.select(
        "doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr(f"1000 * {top}.length div {top}.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2(collapsed, 256).alias("collapsed_sha256"),
    )
