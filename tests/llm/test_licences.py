"""Licence scan: a line is coded once, and its coded windows hold what its words say."""

import random

from pyspark.sql import functions as F

from creditloom.llm import licenses as L


def test_a_line_is_split_into_words_once(spark, monkeypatch):
    seen = []
    real = L.tokens
    monkeypatch.setattr(L, "tokens", lambda paragraph: seen.append(1) or real(paragraph))
    texts = ["plain words of a line", "Released under the MIT License.\nand more", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.families for r in L.licence_query(docs).collect()} == {0: "", 1: "mit", 2: "", 3: ""}
    assert len(seen) == 1


def test_coded_windows_hold_the_terms_of_their_words(spark):
    rng = random.Random(11)
    known = [t for t in L.TERMS if " " not in t]
    lines = [[rng.choice(known) if rng.random() < 0.6 else "zzz" for _ in range(n)] for n in (1, 2, 17, 18, 32, 33, 34, 49, 50, 90)]
    lines += [t.split() for texts in L.TEMPLATES.values() for t in texts]
    rows = [(i, " ".join(words)) for i, words in enumerate(lines)]
    coded = L.coded_lines(spark.createDataFrame(rows, "id long, paragraph string"))
    got = {(r.id, r.pos): {L.TERMS[c - 1] for c in r.held} for r in coded.select("id", F.posexplode(L.windows_of()).alias("pos", "w")).select("id", "pos", "w.held").collect()}
    want = {}
    for i, text in rows:
        words = L._words(text)
        for pos, at in enumerate(range(0, max(len(words) - (L.WINDOW - L.STEP + 1), 0) + 1, L.STEP)):
            window = words[at : at + L.WINDOW]
            want[i, pos] = {t for t in [*window, *(" ".join(p) for p in zip(window, window[1:]))] if t in L.TERMS}
    assert got == want


def test_licence_words_are_found_in_any_case(spark):
    texts = ["LICENCE", "a Licenſe", "permit", "MIT.", "summit", "AGPL gpl", "xbsd", "All Rights", "commons", "Kopyright", "copyRIGHT", ""]
    df = spark.createDataFrame([(t,) for t in texts], "paragraph string")
    got = df.select(L._has_licence_words("paragraph").alias("hinted"), F.col("paragraph").rlike(L.LICENCE_WORDS).alias("all")).collect()
    assert all(r.hinted == r.all for r in got)
    assert sum(r.all for r in got) == 5
