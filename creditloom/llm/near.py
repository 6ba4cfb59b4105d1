"""Near-duplicate documents by improved consistent weighted sampling.

A document is the bag of its runs of five words.  Two documents are similar if the Jaccard similarity of their
bags is 0.8 with runs weighted by inverse document frequency, or with all runs alike.  The weights look past
passages that many documents share; but what a large family of copies has in common is frequent too, and weighs
less than the few runs in which two of its members differ, the less the larger the family.  The plain similarity
of two texts does not depend on how many copies there are.

Document frequencies are counted over all documents in a table of ``CLASSES`` hashed counters, whose size
and relative error do not depend on the corpus; what all counters have on average is taken off as noise.
``BANDS * ROWS`` samples of either kind are drawn per document so that two documents agree in one with a probability
equal to their similarity of that kind; ``ROWS`` samples make the key of a band.

Documents of equal words are one node.  In each bucket of a band the members are first compared with a
hub: the member with the most company over all its buckets, which in a family of copies is the one they all
resemble.  What that leaves in different components of a bucket is compared with a few more hubs drawn by hash,
and what is still apart across components; so a bucket never gives all its pairs.  In the last two comparisons
pairs whose samples of both kinds agree so seldom that a similarity of 0.8 is 3.5 standard deviations away are
left out inside the join.  Every link is verified by the similarities of the whole texts; classes are the
connected components.

Null texts and texts without words are classes of their own; a text of fewer than five words is one run.
Identical rows share a class; ids may repeat with different texts.  Classes are named by their least id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from creditloom.llm.common import NULL_ID, U64, RangeHash, mix, row_key, slices, utf8, word_hashes, word_spans
from creditloom.llm.components import components
from creditloom.llm.scratch import materialize

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 18, 5
DRAWN_HUBS = 5
#: More samples for texts in buckets of several components, weighted and plain, of two bits each.
FINE, FINE_PLAIN = 384, 1024
_LOW_BITS = 0x5555555555555555
CLASSES = 65_536
#: Text bytes of one vectorised step of the sampling, so that its arrays stay in the processor's cache.
SAMPLE_STEP = 300_000

_SHINGLE_BITS = 48


def _may_differ(count: int, deviations: float) -> int:
    """In how many of ``count`` samples of two bits two texts of similarity 0.8 differ at most but for ``deviations``."""
    unlike = (1 - SIMILAR) * 3 / 4
    return int(count * unlike + deviations * (count * unlike * (1 - unlike)) ** 0.5) + 1


def shingles(column: pa.Array, size: int = SHINGLE):
    """Distinct shingles of the texts of a column: code, how often, and the borders of the rows; and two hashes of each text's words."""
    raw, borders = utf8(column)
    starts, ends, first = word_spans(raw, borders)
    words = word_hashes(raw, starts, ends)
    hashes, other = RangeHash(words), RangeHash(mix(words ^ U64(0xA0761D6478BD642F)))
    whole = hashes(first[:-1], first[1:]), other(first[:-1], first[1:])
    n = np.diff(first)
    count = np.where(n == 0, 0, np.maximum(1, n - size + 1))
    row = np.repeat(np.arange(len(n)), count)
    at = first[:-1][row] + np.arange(len(row)) - (np.cumsum(count) - count)[row]
    codes = hashes(at, np.minimum(at + size, first[1:][row])) >> U64(64 - _SHINGLE_BITS)
    keys = np.sort((row.astype(np.uint64) << U64(_SHINGLE_BITS)) | codes)
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    often = np.diff(np.append(new, len(keys)))
    keys = keys[new]
    owner = (keys >> U64(_SHINGLE_BITS)).astype(np.int64)
    return keys & U64(2**_SHINGLE_BITS - 1), often, np.searchsorted(owner, np.arange(len(n) + 1)), whole


def counter_of(codes: np.ndarray) -> np.ndarray:
    return (mix(codes) >> U64(48)).astype(np.int64)


def frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """Documents per counter and documents with words; the sums of at most ``CLASSES`` counters reach the driver."""

    def run(batches):
        total, n = np.zeros(CLASSES, np.int64), 0
        for batch in batches:
            for part in slices(batch, text):
                codes, _, borders, _ = shingles(part.column(0))
                total += np.bincount(counter_of(codes), minlength=CLASSES)
                n += int((np.diff(borders) > 0).sum())
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], n))], names=["counter", "n"])

    rows = docs.select(text).mapInArrow(run, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(CLASSES, np.int64)
    inner = rows[rows.counter >= 0]
    counts[inner.counter.to_numpy(np.int64)] = inner.n
    return counts, int(rows[rows.counter < 0].n.sum())


def rarity(counts: np.ndarray, documents: int) -> np.ndarray:
    """Inverse document frequency of the shingles of each counter."""
    mean = counts.mean()
    df = np.maximum(np.maximum(counts - mean, 4 * np.sqrt(mean)), 1.0)
    return np.log1p(max(documents, 1) / df).astype(np.float32)


_QUANTILES = 65_536


def _gamma_quantiles() -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution, by Newton's method on 1 - (1 + x) exp(-x)."""
    p = (np.arange(_QUANTILES) + 0.5) / _QUANTILES
    x = np.sqrt(2 * p) + p
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / np.maximum(x * np.exp(-x), 1e-300), 1e-9)
    return x


def _hashed(codes: np.ndarray, seed: np.uint64) -> np.ndarray:
    h = (codes ^ seed) * U64(0x9FB21C651E98DF25)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    return h


def sampler(idf: np.ndarray, count: int, seed: int, plain_count: int):
    gamma = _gamma_quantiles()
    rate, log_c = gamma.astype(np.float32), np.log(gamma).astype(np.float32)
    seeds = np.random.default_rng(seed).integers(1, 2**63, max(count, plain_count), dtype=np.uint64)

    def samples(codes: np.ndarray, often: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``count`` weighted and ``plain_count`` plain samples of every row that has shingles; others keep zeros."""
        out = np.zeros((count, len(borders) - 1), np.uint64)
        plain = np.zeros((plain_count, len(borders) - 1), np.uint64)
        rows = np.flatnonzero(np.diff(borders) > 0)
        if not len(rows):
            return out, plain
        begin = borders[:-1][rows]
        counts = np.diff(borders)[rows]
        log_w = np.log(often * idf[counter_of(codes)]).astype(np.float32)
        # The second and later occurrences of a shingle are elements of their own of the plain samples.
        extra = np.repeat(np.arange(len(codes)), often - 1)
        nth = np.arange(len(extra)) - np.repeat(np.cumsum(often - 1) - (often - 1), often - 1)
        again = mix(codes[extra] ^ ((nth + 1).astype(np.uint64) * U64(0x9E3779B97F4A7C15)))
        of = np.searchsorted(begin, extra, "right") - 1
        heads = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
        for k, seed in enumerate(seeds):
            h = _hashed(codes, seed)
            if k < plain_count:
                lowest = np.minimum.reduceat(h, begin)
                if len(heads):
                    lowest[of[heads]] = np.minimum(lowest[of[heads]], np.minimum.reduceat(_hashed(again, seed), heads))
                plain[k, rows] = mix(lowest)
            if k >= count:
                continue
            r = rate[h >> U64(48)]
            beta = (h & U64(0xFFFFFF)).astype(np.float32) * np.float32(2**-24)
            t = np.floor(log_w / r + beta)
            a = log_c[(h >> U64(28)) & U64(0xFFFF)] - r * (t - beta + np.float32(1))
            least = np.minimum.reduceat(a, begin)
            hit = np.flatnonzero(a == np.repeat(least, counts))
            pick = hit[np.searchsorted(hit, begin)]  # the first of equal ones
            out[k, rows] = mix(codes[pick] ^ (t[pick].astype(np.int64).view(np.uint64) * U64(0x9E3779B97F4A7C15)))
        return out, plain

    return samples


def band_keys(samples: np.ndarray) -> np.ndarray:
    out = np.zeros((BANDS, samples.shape[1]), np.uint64)
    for k in range(BANDS * ROWS):
        out[k // ROWS] = mix(out[k // ROWS] * U64(0xD6E8FEB86659FD93) + samples[k])
    return out


def _lists(columns: np.ndarray) -> pa.Array:
    width, rows = columns.shape
    flat = pa.array(np.ascontiguousarray(columns.T).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), flat)


def _signatures(shared):
    def run(batches):
        draw = sampler(shared.value, BANDS * ROWS, 7, BANDS * ROWS)
        for batch in batches:
            for part in slices(batch, "text", SAMPLE_STEP):
                codes, often, borders, whole = shingles(part.column(2))
                keys = _lists(np.concatenate([band_keys(kind) for kind in draw(codes, often, borders)]).view(np.int64))
                cols = [part.column(0), part.column(1), *(pa.array(w.view(np.int64)) for w in whole), pa.array(np.diff(borders) > 0), keys]
                yield pa.RecordBatch.from_arrays(cols, names=["k_id", "k_text", "c1", "c2", "some", "bands"])

    return run


def _packed(samples: np.ndarray) -> np.ndarray:
    """Two bits of each sample, 32 samples in a word."""
    out = np.zeros((len(samples) // 32, samples.shape[1]), np.uint64)
    for k, sample in enumerate(samples):
        out[k // 32] |= (sample >> U64(20) & U64(3)) << U64(k % 32 * 2)
    return out.view(np.int64)


def _fine_samples(shared):
    """Two bits of each of ``FINE`` more weighted samples and ``FINE_PLAIN`` more plain ones."""

    def run(batches):
        draw = sampler(shared.value, FINE, 8, FINE_PLAIN)
        for batch in batches:
            for part in slices(batch, "text", SAMPLE_STEP):
                codes, often, borders, _ = shingles(part.column(1))
                short = [_lists(_packed(kind)) for kind in draw(codes, often, borders)]
                yield pa.RecordBatch.from_arrays([part.column(0), *short], names=["node", "samples", "plain"])

    return run


def _similarity(shared):
    def weights(column: pa.Array, idf: np.ndarray):
        codes, often, borders, _ = shingles(column)
        return codes, (often * idf[counter_of(codes)], often), borders

    def similar(u: np.ndarray, v: np.ndarray, j: np.ndarray, k: np.ndarray) -> bool:
        both = float(np.minimum(u[j], v[k]).sum())
        return both >= SIMILAR * (float(u.sum()) + float(v.sum()) - both) * (1 - 1e-9)

    def run(batches):
        idf = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                a, wa, ba = weights(part.column(2), idf)
                b, wb, bb = weights(part.column(3), idf)
                good = np.zeros(part.num_rows, bool)
                for i in range(part.num_rows):
                    x, y = slice(ba[i], ba[i + 1]), slice(bb[i], bb[i + 1])
                    _, j, k = np.intersect1d(a[x], b[y], assume_unique=True, return_indices=True)
                    good[i] = any(similar(u[x], v[y], j, k) for u, v in zip(wa, wb))
                yield part.select([0, 1]).filter(pa.array(good))

    return run


def near_classes(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """k_id, k_text, and the class of each row: class_id, class_text (the keys of its first row) and class_rows."""
    spark = docs.sparkSession
    keyed = docs.select(*row_key(id_column, text), F.col(text).alias("text"))
    counts, documents = frequencies(keyed.select("text"))
    shared = spark.sparkContext.broadcast(rarity(counts, documents))
    signed = materialize(
        keyed.mapInArrow(_signatures(shared), "k_id long, k_text long, c1 long, c2 long, some boolean, bands array<long>"), "signed"
    )
    node = F.concat_ws(":", "k_id", "k_text")
    equal = signed.filter("some").groupBy("c1", "c2").agg(
        F.min(F.struct("k_id", "k_text")).alias("k"), F.first("bands").alias("bands")
    )
    reps = materialize(equal.select("c1", "c2", "k.*", "bands").withColumn("node", node), "reps")
    members = reps.select("node", F.posexplode("bands").alias("band", "key"))
    shared_keys = materialize(members.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    inside = materialize(members.join(shared_keys, ["band", "key"]), "members")
    company = materialize(inside.groupBy("node").agg(F.sum("n").alias("company")), "company")
    inside = materialize(inside.drop("n").join(company, "node"), "members")
    most = F.max(F.struct("company", "node"))["node"]
    drawn = [F.min(F.struct(F.xxhash64("node", "band", F.lit(i)).alias("x"), "node"))["node"] for i in range(DRAWN_HUBS)]
    buckets = materialize(inside.groupBy("band", "key").agg(most.alias("hub"), F.array_distinct(F.array(*drawn)).alias("drawn")), "hubs")
    inside = inside.drop("company")
    # Only texts that share a bucket with another are compared; they are taken out once.  A merge join at every size.
    some = materialize(company.select("node"), "nodes")
    texts = materialize(keyed.withColumn("node", node).select("node", "text").join(some.hint("merge"), "node", "left_semi"), "texts")

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) whose texts are similar."""
        one = texts.select(F.col("node").alias("u"), "text")
        two = texts.select(F.col("node").alias("v"), F.col("text").alias("text_v"))
        joined = pairs.join(one.hint("merge"), "u").join(two.hint("merge"), "v").select("u", "v", "text", "text_v")
        return materialize(joined.mapInArrow(_similarity(shared), "u string, v string").distinct(), "links")

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()

    def placed(nodes: DataFrame, parts: DataFrame) -> DataFrame:
        return nodes.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))

    pairs = inside.join(buckets, ["band", "key"]).select(F.col("node").alias("u"), F.col("hub").alias("v")).filter("u <> v")
    tested = materialize(ordered(pairs), "pairs")
    links = linked(tested)
    parts = components(links)
    # Buckets that still hold several components; in one of two members the only pair has been compared.
    held = materialize(placed(inside.select("band", "key", "node"), parts), "placed")
    mixed = held.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"))
    mixed = held.join(materialize(mixed.filter("lo <> hi and n > 2").select("band", "key"), "mixed"), ["band", "key"])
    unsettled = materialize(mixed.select("node").distinct(), "unsettled")
    fine = texts.hint("merge").join(unsettled, "node").mapInArrow(_fine_samples(shared), "node string, samples array<long>, plain array<long>")
    fine = materialize(fine.dropDuplicates(["node"]), "fine")
    mixed = materialize(mixed.join(fine, "node").join(reps.select("node", "bands"), "node"), "mixed")

    def few_differ(kind: str):
        """Whether 384 samples differ in few places by 4.5 standard deviations, and all samples by 3.5; the first is compiled."""
        words = [F.col(kind + "u")[i].bitwiseXOR(F.col(kind + "v")[i]) for i in range(FINE // 32)]
        lanes = lambda w: F.bit_count(w.bitwiseOR(F.shiftrightunsigned(w, 1)).bitwiseAND(F.lit(_LOW_BITS)))
        total = F.aggregate(F.zip_with(kind + "u", kind + "v", lambda a, b: lanes(a.bitwiseXOR(b))), F.lit(0), lambda t, n: t + n)
        return (sum(map(lanes, words), F.lit(0)) <= _may_differ(FINE, 4.5)) & (total <= _may_differ({"s": FINE, "p": FINE_PLAIN}[kind], 3.5))

    side = lambda rows, n: rows.select(
        "band", "key", *(F.col(c).alias(a + n) for c, a in (("node", ""), ("component", "c"), ("samples", "s"), ("plain", "p"), ("bands", "b")))
    )
    apart = F.expr("cu <> cv") & (few_differ("s") | few_differ("p"))
    drawn_hubs = buckets.select("band", "key", F.explode("drawn").alias("node"))
    pairs = side(mixed.join(drawn_hubs, ["band", "key", "node"]), "u").join(side(mixed, "v"), ["band", "key"]).filter(apart)
    pairs = materialize(ordered(pairs).join(tested, ["u", "v"], "left_anti"), "pairs")
    tested = tested.unionByName(pairs)
    links = materialize(links.unionByName(linked(pairs)), "links")
    parts = components(links)
    mixed = placed(mixed.drop("component"), parts)
    first_band = F.array_position(F.zip_with("bu", "bv", lambda a, b: a == b), True) - 1  # a pair shows in one bucket only
    across = side(mixed, "u").join(side(mixed, "v"), ["band", "key"]).filter(F.expr("u < v") & apart & (first_band == F.col("band")))
    more = linked(materialize(across.select("u", "v").join(tested, ["u", "v"], "left_anti"), "across"))
    parts = components(links.unionByName(more))
    named = reps.select("c1", "c2", "node").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = signed.select("k_id", "k_text", "c1", "c2", "some").join(named.drop("node"), ["c1", "c2"], "left")
    rows = materialize(rows.select("k_id", "k_text", F.when(F.col("some"), F.col("component")).otherwise(node).alias("component")), "classed")
    heads = materialize(
        rows.groupBy("component").agg(F.min(F.struct("k_id", "k_text")).alias("head"), F.count("*").alias("class_rows")), "heads"
    )
    return rows.join(heads, "component").select(
        "k_id", "k_text", F.col("head.k_id").alias("class_id"), F.col("head.k_text").alias("class_text"), "class_rows"
    )


def near_query(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (least id of the class) and class_rows of every row."""
    own = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return near_classes(docs).select(own("k_id").alias("doc_id"), own("class_id").alias("class_id"), "class_rows")
