"""Line dedup on long lines: against all pairs, and how many pairs are verified."""

import random

import pytest

from creditloom.llm import lines
from creditloom.llm.scratch import Tables


def brute(texts):
    """Removed line numbers of each document by comparing every line with all earlier ones."""
    earlier, out = [], {}
    for doc, text in enumerate(texts):
        gone = []
        for i, line in enumerate(text.split("\n")):
            words = frozenset(line.split())
            if words and any(w == words or len(w & words) >= 0.8 * len(w | words) - 1e-9 for w in earlier):
                gone.append(str(i))
            if words:
                earlier.append(words)
        out[doc] = ",".join(gone)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_around_the_signature_size_match_all_pairs(spark, seed):
    rng = random.Random(seed)
    common = [f"w{i}" for i in range(400)]
    made = []
    for _ in range(25):
        base = rng.sample(common, rng.choice([70, 79, 80, 81, 100, 160]))
        made.append(base)
        for _ in range(4):
            # Around the border of 0.8, so that some copies go and some stay, and sizes cross that of the wide signature.
            changed = [w for w in base if rng.random() > rng.choice([0.02, 0.1, 0.2])]
            made.append(changed + rng.sample(common, rng.randrange(12)))
    rng.shuffle(made)
    texts = ["\n".join(" ".join(line) for line in made[i : i + 3]) for i in range(0, len(made), 3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.removed_lines for r in lines.lines_query(docs).collect()}
    want = brute(texts)
    assert got == want
    assert any(want.values())


class Counted(Tables):
    """Tables that remember how many pairs were written to be verified."""

    pairs = 0

    def write(self, df, name):
        out = super().write(df, name)
        if name == "pairs":
            self.pairs += out.count()
        return out


def test_long_lines_with_a_rare_word_in_common_are_not_all_verified(spark):
    rng = random.Random(3)
    common = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(["rare", *rng.sample(common, 160)])) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tables = Counted(spark)
    assert lines.repeated_lines(docs, tables).count() == 0
    # All pairs: 3,160.
    assert tables.pairs < 32


def _family(rng, members):
    """Copies of one line of 72 words, each with other words changed, so that most are similar to the first, but few to one another."""
    base = [f"w{i}" for i in range(72)]
    out = [base]
    for m in range(members):
        at = set(rng.sample(range(72), 6))
        out.append([f"x{rng.randrange(4000)}" if i in at else w for i, w in enumerate(base)])
    return out


def test_copies_of_medium_lines_that_are_not_similar_are_not_all_verified(spark):
    rng = random.Random(5)
    base, *rest = _family(rng, 120)
    docs = spark.createDataFrame([(i, " ".join(words)) for i, words in enumerate(rest)], "doc_id long, text string")
    tables = Counted(spark)
    got = {r.k_id for r in lines.repeated_lines(docs, tables).collect()}
    sets = [frozenset(words) for words in rest]
    assert got == {i for i, w in enumerate(sets) if any(len(w & v) >= 0.8 * len(w | v) - 1e-9 for v in sets[:i])}
    # All pairs: 7,140.
    assert tables.pairs < 1500


@pytest.mark.parametrize("seed", [3])
def test_lines_around_the_wide_signature_match_all_pairs(spark, seed):
    rng = random.Random(seed)
    common = [f"w{i}" for i in range(300)]
    made = []
    for _ in range(25):
        base = rng.sample(common, rng.choice([38, lines.WIDE - 1, lines.WIDE, lines.WIDE + 1, 48, 60]))
        made.append(base)
        for _ in range(4):
            changed = [w for w in base if rng.random() > rng.choice([0.02, 0.1, 0.2])]
            made.append(changed + rng.sample(common, rng.randrange(6)))
    rng.shuffle(made)
    texts = ["\n".join(" ".join(line) for line in made[i : i + 3]) for i in range(0, len(made), 3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.removed_lines for r in lines.lines_query(docs).collect()} == brute(texts)
