"""Classes of near copies against all pairs of texts, in families of many copies."""

import random
from collections import Counter

import pyarrow as pa
import pytest

from creditloom.llm import near

SCHEMA = "doc_id long, text string"


def words(rng, n):
    return [f"w{rng.randrange(100_000)}" for _ in range(n)]


def changed(rng, text, n):
    out = list(text)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"n{rng.randrange(10**9)}"
    return out


def bag(text):
    w = text.split()
    return Counter(tuple(w[i : i + near.SHINGLE]) for i in range(max(1, len(w) - near.SHINGLE + 1))) if w else Counter()


def plain(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def classes_of_links(texts, linked):
    least = list(range(len(texts)))

    def head(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((head(i), head(j)))
                least[b] = a
    return [head(i) for i in range(len(texts))]


def found(spark, texts):
    got = near.near_query(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
    return [r.class_id for r in sorted(got, key=lambda r: r.doc_id)]


def test_copies_in_a_large_family_are_found(spark):
    rng = random.Random(1)
    base = words(rng, 400)
    copies = [" ".join(base)] + [" ".join(changed(rng, base, 8)) for _ in range(80)]
    unlike = [" ".join(changed(rng, base, 40)) for _ in range(5)] + [" ".join(words(rng, 400)) for _ in range(40)]
    assert all(plain(bag(copies[0]), bag(t)) >= 0.8 for t in copies)
    got = found(spark, copies + unlike)
    assert got[: len(copies)] == [0] * len(copies)
    assert got[len(copies) :] == list(range(len(copies), len(copies) + len(unlike)))


@pytest.mark.parametrize("seed", [2, 3])
def test_classes_match_all_pairs(spark, seed):
    rng = random.Random(seed)
    texts = []
    for size in (60, 25, 8, 3):
        base = words(rng, rng.choice([30, 200, 400]))
        texts += [" ".join(changed(rng, base, int(len(base) * rng.uniform(0, 0.05)))) for _ in range(size)]
    step = words(rng, 300)
    for _ in range(40):  # each like the one before it only
        step = changed(rng, step, 4)
        texts.append(" ".join(step))
    line = " ".join(words(rng, 12))
    texts += ["\n".join([line] * n) for n in (1, 2, 10, 11, 12)] + [" ".join(words(rng, 50)) for _ in range(30)] + ["a b", "a  b", "", "c"]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    idf = near.rarity(*near.frequencies(docs))
    codes, often, borders, _ = near.shingles(pa.array(texts))
    weight = often * idf[near.counter_of(codes)]
    weighed = [dict(zip(codes[a:b].tolist(), weight[a:b].tolist())) for a, b in zip(borders[:-1], borders[1:])]
    bags = [bag(t) for t in texts]

    def linked(i, j):
        u, v = weighed[i], weighed[j]
        both = sum(min(x, v[c]) for c, x in u.items() if c in v)
        total = sum(u.values()) + sum(v.values()) - both
        return bool(total) and (both >= near.SIMILAR * total * (1 - 1e-9) or plain(bags[i], bags[j]) >= near.SIMILAR - 1e-9)

    want = classes_of_links(texts, linked)
    assert found(spark, texts) == want
    assert max(Counter(want).values()) >= 40
