"""The linear program of the packing, its rounding, and the pieces against the tokenizers library."""

import random
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest

from creditloom.llm import pack, tokens


def placed_pieces(plan, capacity):
    count = defaultdict(int)
    for held, times in plan:
        assert times > 0 and sum(s * n for s, n in held.items()) <= capacity
        for s, n in held.items():
            count[s] += n * times
    return dict(count)


def histograms():
    yield {683: 300_000}, 2048
    yield {683: 300_000, 1365: 100, 700: 5_000, 650: 5_000}, 2048
    yield {2048: 7, 1: 3}, 2048
    yield {1: 5}, 2048
    rng = random.Random(1)
    yield {rng.randrange(200, 1300): rng.randrange(1_000, 20_000) for _ in range(60)}, 2048
    yield {s: 1 + 20_000 // s for s in range(1, 2049, 3)}, 2048
    for seed in range(4):
        rng = random.Random(seed)
        yield {rng.randrange(1, 65): rng.randrange(1, 500) for _ in range(20)}, 64


@pytest.mark.parametrize("lengths, capacity", list(histograms()))
def test_solution_is_whole_bounded_and_never_worse_than_best_fit(lengths, capacity):
    report = {}
    plan = pack.solve(lengths, capacity, report=report)
    assert placed_pieces(plan, capacity) == lengths
    sequences = sum(times for _, times in plan)
    assert sequences == report["sequences"] <= report["best_fit"] == sum(t for _, t in pack.best_fit(dict(lengths), capacity))
    assert sequences >= -(-sum(s * n for s, n in lengths.items()) // capacity)
    runs = pack.runs_of(plan)
    assert sum(r[2] for r in runs) == sum(lengths.values())


def test_program_finds_what_best_fit_misses():
    # 60 neighbouring lengths of about a sixth of a sequence: 165,476 sequences by best fit alone.
    first = random.Random(1).randrange(200, 1300)
    lengths = {first + i: random.Random(i).randrange(1_000, 20_000) for i in range(60)}
    report = {}
    pack.solve(lengths, 2048, report=report)
    assert report["sequences"] < 0.97 * report["best_fit"]
    assert report["by_program"] > 0.9 * report["pieces"]


def test_cover_and_bound_enclose_the_optimum():
    # Sequences hold one of 6 and one of 4, or two of 5: 40 + 15 of them are needed, fractional or whole.
    solution = pack.fractional_cover({4: 40, 5: 30, 6: 40}, 10)
    assert solution.bound - 1e-6 <= 55 <= solution.total + 1e-6
    assert solution.gap <= pack.GAP
    covered = defaultdict(float)
    for key, times in solution.used.items():
        for a, n in key:
            covered[int(solution.sizes[a])] += n * times
    assert all(covered[s] >= n - 1e-6 for s, n in {4: 40, 5: 30, 6: 40}.items())


def test_knapsack_matches_recursion():
    rng = np.random.default_rng(3)
    sizes = np.array([3, 4, 7, 11])
    prices = rng.random(4)

    @lru_cache(None)
    def best(room):
        return max([0.0] + [prices[i] + best(room - s) for i, s in enumerate(sizes.tolist()) if s <= room])

    values, _ = pack.knapsack(prices, sizes, 60)
    assert np.allclose(values, [best(room) for room in range(61)])


def test_pieces_match_the_library(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.default_tokenizer())
    rng = random.Random(4)
    texts = ["", None, "naïve 漢字", " ".join(f"w{rng.randrange(500)}" for _ in range(700)), "a" * 5_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = []
    for i, text in enumerate(texts):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        first = (len(ids) - 1) % 64 + 1
        borders = [0, *range(first, len(ids) + 1, 64)]
        for piece, (a, b) in enumerate(zip(borders, borders[1:])):
            want.append((i, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    got = pack.pack(docs, capacity=64).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
