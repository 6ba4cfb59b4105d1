"""Text quality by votes of the nearest labelled documents.

A text becomes the bag of its words' forms (case, first and last character, length), pairs of neighbouring
forms, the share of words equal to the one before, hashed words and its length.  Bags are weighted by inverse document
frequency and projected on the leading singular vectors of a labelled sample (latent-semantic vectors).
The vectors of the sample are broadcast - at most ``PER_LABEL`` of each label, so the size is fixed - and the
cosine of every document with every one of them is computed in blocks.  The ``NEIGHBOURS`` nearest vote,
weighted by a power of the cosine and by how many labelled rows each sampled one stands for.

Only rows whose crc32(doc_id as text) mod 5 is not 0 are learnt from; labels, lang, source and doc_id are no
input of a score.  The sample is drawn by a hash of the id.  Labels other than 0 and 1 and null ids are not
learnt from; a document labelled twice counts for both labels.  Null and empty texts, and all texts if
nothing can be learnt, get the share of label 1 among the labelled rows (0.5 without any).  Rows are
independent, so repeated ids get a result each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from creditloom.llm.common import append, mix, U64, utf8, word_hashes, word_spans
from creditloom.llm.tokens import forget_pieces

PER_LABEL = 3000
NEIGHBOURS = 25
RANK = 48
SHARPNESS = 4
THRESHOLD = 0.3

_FORMS, _PAIRS, _WORDS, _SIZES = 1024, 1024, 256, 24
_SHARES = 11
FEATURES = _FORMS + _PAIRS + _WORDS + _SIZES + _SHARES

_KIND = np.zeros(256, np.uint64)  # other bytes: punctuation, each its own kind
_KIND[:128] = np.arange(128) + 8
_KIND[[*range(97, 123)]] = 1
_KIND[[*range(65, 91)]] = 2
_KIND[[*range(48, 58)]] = 3
_KIND[128:] = 4
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1


def bags(column: pa.Array):
    """Row borders, feature numbers and counts of the texts of a column."""
    raw, borders = utf8(column)
    starts, ends, first = word_spans(raw, borders)
    n = np.diff(first)
    rows = np.repeat(np.arange(len(n)), n)
    if not len(starts):
        return np.zeros(len(n) + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    words = word_hashes(raw, starts, ends)
    length = ends - starts
    upper = np.concatenate([[0], np.cumsum(_UPPER[raw])])
    caps = (upper[ends] - upper[starts]) * 2 > length
    size = np.minimum(np.log2(length).astype(np.uint64), U64(5))
    form = ((_KIND[raw[starts]] * U64(256) + _KIND[raw[ends - 1]]) * U64(2) + caps.astype(np.uint64)) * U64(8) + size
    code = mix(form)
    inner = np.concatenate([[False], rows[1:] == rows[:-1]])
    before = np.roll(code, 1)
    parts = [
        (rows, (code % U64(_FORMS)).astype(np.int64)),
        (rows[inner], _FORMS + (mix(before * U64(31) + code)[inner] % U64(_PAIRS)).astype(np.int64)),
        (rows, _FORMS + _PAIRS + (words % U64(_WORDS)).astype(np.int64)),
        (np.flatnonzero(n), _FORMS + _PAIRS + _WORDS + np.minimum(np.log2(n[n > 0]).astype(np.int64), _SIZES - 1)),
    ]
    again = np.bincount(rows[inner & (words == np.roll(words, 1))], minlength=len(n))
    share = (10 * again // np.maximum(n, 1))[rows]
    parts.append((rows[share > 0], FEATURES - _SHARES + share[share > 0]))
    keys = np.sort(np.concatenate([r * FEATURES + f for r, f in parts]))
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    often = np.diff(np.append(new, len(keys)))
    keys = keys[new]
    return np.searchsorted(keys, np.arange(len(n) + 1) * FEATURES), keys % FEATURES, often.astype(np.float32)


def matrix(borders: np.ndarray, features: np.ndarray, often: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weighted bags as rows of length one."""
    out = np.zeros((len(borders) - 1, FEATURES), np.float32)
    rows = np.repeat(np.arange(len(out)), np.diff(borders))
    out[rows, features] = (1 + np.log(often)) * idf[features]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(norm > 1e-12, norm, 1)).astype(np.float32)


class Neighbours:
    """Latent-semantic vectors of a labelled sample, and the votes of the nearest ones."""

    def __init__(self, bag, labels: np.ndarray, stands_for: np.ndarray, prior: float):
        borders, features, often = bag
        self.prior = prior
        self.known = len(labels) > 0
        if not self.known:
            return
        df = np.bincount(features, minlength=FEATURES)
        self.idf = np.log1p(len(labels) / np.maximum(df, 1)).astype(np.float32)
        x = matrix(borders, features, often, self.idf)
        rank = min(RANK, *x.shape)
        probe = np.random.default_rng(11).standard_normal((FEATURES, rank + 8)).astype(np.float32)
        q = np.linalg.qr(x @ probe)[0]
        for _ in range(3):
            q = np.linalg.qr(x @ (x.T @ q))[0]
        self.axes = np.linalg.svd(q.T @ x, full_matrices=False)[2][:rank].T.astype(np.float32)
        self.vectors = _unit(x @ self.axes)
        self.labels = labels.astype(np.float32)
        self.stands_for = stands_for.astype(np.float32)

    def scores(self, column: pa.Array) -> np.ndarray:
        borders, features, often = bags(column)
        out = np.full(len(borders) - 1, self.prior)
        if not self.known:
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(out), 512):
            cut = borders[at : at + 513]
            inside = slice(cut[0], cut[-1])
            mine = _unit(matrix(cut - cut[0], features[inside], often[inside], self.idf) @ self.axes)
            cosine = mine @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 0) ** SHARPNESS * self.stands_for[near]
            total = weight.sum(1)
            some = (total > 0) & (np.diff(cut) > 0)
            out[at : at + len(some)][some] = ((weight * self.labels[near]).sum(1)[some] / total[some]).clip(0, 1)
        return out


def held_out(id_column: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Neighbours:
    """Learn from at most ``per_label`` labelled documents of each label, drawn by a hash of the id."""
    usable = (
        labels.select(F.col("doc_id").alias("l_id"), F.col("quality").cast("int").alias("l_label"))
        .filter(F.col("l_id").isNotNull() & F.col("l_label").isin(0, 1) & ~held_out("l_id"))
        .distinct()
    )
    totals = {r.l_label: r["count"] for r in usable.groupBy("l_label").count().collect()}
    all_rows = sum(totals.values())
    prior = totals.get(1, 0) / all_rows if all_rows else 0.5
    draw = F.xxhash64("l_id")
    sample = None
    for label in sorted(totals):
        part = usable.filter(F.col("l_label") == label).orderBy(draw, "l_id").limit(per_label)
        sample = part if sample is None else sample.unionByName(part)
    if sample is None:
        return Neighbours((np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)), np.zeros(0), np.zeros(0), prior)
    # The sample has a bounded number of rows, so it is broadcast; a text becomes a bag of at most FEATURES counts.
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("l_id")).select("l_id", "l_label", "text")

    def make():
        forget_pieces()

        def work(column: pa.Array):
            borders, features, often = bags(column)
            borders = pa.array(borders.astype(np.int32))
            return [pa.ListArray.from_arrays(borders, pa.array(features.astype(np.int32))), pa.ListArray.from_arrays(borders, pa.array(often))]

        return work

    fields = [("features", T.ArrayType(T.IntegerType())), ("often", T.ArrayType(T.FloatType()))]
    rows = append(texts, "text", fields, make)[0].drop("text").dropDuplicates(["l_id", "l_label"]).toPandas()
    rows = rows.sort_values(["l_id", "l_label"], ignore_index=True)
    sizes = rows.features.map(len).to_numpy(np.int64)
    borders = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    join = lambda c, kind: np.concatenate([np.asarray(x, kind) for x in c] or [np.zeros(0, kind)])
    y = rows.l_label.to_numpy(np.int64)
    kept = np.bincount(y, minlength=2)
    stands_for = np.array([totals.get(int(v), 0) / kept[v] for v in y], np.float64)
    return Neighbours((borders, join(rows.features, np.int64), join(rows.often, np.float32)), y, stands_for, prior)


def quality(docs: DataFrame, model: Neighbours, text: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, list[str]]:
    """``docs`` with score (0 to 1) and predicted (0 or 1); and the names the columns got."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        forget_pieces()
        model = shared.value

        def work(column: pa.Array):
            scores = model.scores(column)
            return [pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))]

        return work

    return append(docs, text, [("score", T.DoubleType()), ("predicted", T.IntegerType())], make)


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out, (score, predicted) = quality(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), F.col(score).alias("score"), F.col(predicted).alias("predicted"))
