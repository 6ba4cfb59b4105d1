"""Edge cases and brute-force comparisons of the text operators on toy tables."""

import hashlib
import random
import re
from collections import defaultdict

import duckdb
import pytest

from creditloom.llm import components as parts, decontaminate, lines, near, pack, quality, rules, substrings, tokens, urls
from creditloom.llm.queries import ORACLES, QUERIES

DOC = "doc_id long, text string, n_words string, k_id string, score string"


def rows(texts, first=1):
    return [(i, t, "x", "y", "z") for i, t in enumerate(texts, first)]


def words(seed, n, size=300):
    rng = random.Random(seed)
    return [f"w{rng.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    base = words(1, 120)
    changed = base[:60] + ["other"] + base[61:]
    texts = [
        " ".join(base),
        " ".join(changed),
        " ".join(base),
        None,
        "",
        "  \n\t\n ",
        "one two",
        "a b c d e f g h i j\nshort line here now ok\n" + " ".join(words(2, 40)),
        "a b c d e f g h i k\n" + " ".join(words(2, 40)),
        " ".join(words(3, 5000)),
        "x" * 50_000,
        "<|endoftext|>  tail  ",
        "naïve café – 漢字　テスト",
    ]
    data = rows(texts) + [(1, texts[0], "x", "y", "z"), (None, "no id at all", None, None, None), (7, "same id, other text", "", "", "")]
    return spark.createDataFrame(data, DOC).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def test_token_counts_match_the_library(docs, empty):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.default_tokenizer())
    want = sorted((r.doc_id or 0, len(plain.encode(r.text or "", add_special_tokens=False))) for r in docs.collect())
    out, (size, n, over) = tokens.token_counts(docs)
    got = out.collect()
    assert sorted((r.doc_id or 0, r[n]) for r in got) == want
    assert all(r[over] == (r[n] > 1024) and r[size] == len((r.text or "").encode()) for r in got)
    assert n != "n_tokens" or "n_tokens" not in docs.columns
    assert tokens.count_query(empty).count() == 0


def test_token_pieces_are_cut_at_safe_places():
    rng = random.Random(5)
    letters = ["a", "B", " ", "  ", "\n", "\t", "é", "1", "'s", "-", "　", "\x85", "\x1c", "ß", "<|endoftext|>"]
    encoder = tokens.Encoder(lengths_only=True)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(2000)]
    assert encoder.batch(texts) == [len(x) for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    long = " ".join(words(9, 20_000))
    assert "".join(tokens.stretches(long, 1000)) == long


def test_packing_is_whole_and_tight(docs, empty):
    placed = pack.pack(docs, capacity=64).collect()
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in placed:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[(r.doc_id, r.piece, r.ids_crc32)].append(r)
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in placed)
    assert len(by_sequence) <= -(-total // 64) + 2
    assert pack.pack(empty).count() == 0
    for seed in range(5):
        rng = random.Random(seed)
        lengths = {rng.randrange(1, 65): rng.randrange(1, 500) for _ in range(20)}
        plan = pack.solve(lengths, 64)
        count = defaultdict(int)
        for held, times in plan:
            assert sum(s * n for s, n in held.items()) <= 64
            for s, n in held.items():
                count[s] += n * times
        assert dict(count) == lengths


def plain_words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


@pytest.mark.parametrize("block_bytes", [8_000_000, 60])
def test_decontamination_matches_brute_force(spark, docs, empty, block_bytes):
    base = words(1, 120)
    bench = [(1, " ".join(base[20:45])), (2, "One, TWO!"), (3, None), (4, ""), (5, "x"), (None, "café 漢字"), (10, " ".join(base[60:72])), (1, "no id")]
    bench = spark.createDataFrame(bench, "item_id long, text string")
    windows = defaultdict(set)
    for item, text in bench.collect():
        w = plain_words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(str(item) if item is not None else "")
    out, (n, hit, count, items, bad) = decontaminate.contamination(docs, bench, block_bytes=block_bytes)
    for r in out.collect():
        w, covered, owners = plain_words(r.text), set(), set()
        for window, names in windows.items():
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    covered |= set(range(i, i + len(window)))
                    owners |= names
        assert (r[n], r[hit], r[count], r[items], r[bad]) == (len(w), len(covered), len(owners), sorted(owners), bool(covered))
    assert decontaminate.contamination_query(empty, bench).count() == 0
    assert decontaminate.contamination_query(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_substring_dedup_matches_brute_force(docs, empty):
    order = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    first = {}
    for r in order:
        w = (r.text or "").encode().split()
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            place = (r.doc_id is not None, r.doc_id or 0, i)
            first[key] = min(first.get(key, place), place)
    want = []
    for r in order:
        w = (r.text or "").encode().split()
        gone = set()
        for i in range(len(w) - 19):
            if first[tuple(w[i : i + 20])] < (r.doc_id is not None, r.doc_id or 0, i):
                gone |= set(range(i, i + 20))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((r.doc_id or -1, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    got = [(r.doc_id or -1, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup_query(docs).collect()]
    assert sorted(got) == sorted(want)
    assert substrings.dedup_query(empty).count() == 0


def test_line_dedup_edges(docs, empty):
    got = {(r.doc_id, r.n_lines): r.removed_lines for r in lines.lines_query(docs).filter("doc_id is not null").collect()}
    assert got[(1, 1)] == "" and got[(3, 1)] == "0"  # the repeated row shares the result of the first
    assert got[(2, 1)] == "0"
    assert got[(4, 0)] == "" and got[(5, 1)] == "" and got[(6, 3)] == ""
    assert got[(9, 2)] == "0,1"[0:3] or got[(9, 2)] == "1"
    assert lines.lines_query(empty).count() == 0


def test_near_classes(docs, empty):
    got = {(r.doc_id, r.class_rows): r.class_id for r in near.near_query(docs).collect()}
    same = {d: c for (d, _), c in got.items() if d in (1, 2, 3)}
    assert set(same.values()) == {1}
    assert all(c == d for (d, n), c in got.items() if n == 1)
    assert near.near_query(docs).count() == docs.count()
    assert near.near_query(empty).count() == 0


def test_components_of_chain_and_star(spark, empty):
    edges = [(i, i + 1) for i in range(60)] + [(1000, j) for j in range(1001, 1100)] + [(7, 7), (None, 3), (5, 4)]
    found = dict(parts.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert all(found[i] == 0 for i in range(61)) and all(found[j] == 1000 for j in range(1000, 1100))
    assert parts.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_rules_on_edges(docs, empty):
    for r in rules.rules_query(docs).collect():
        assert r.kept in (True, False) and r.n_words >= 0 and not (r.base_failed and r.kept)
    assert rules.rules_query(empty).count() == 0


def test_quality_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.quality_query(docs, none).collect()} == {0.5}
    some = spark.createDataFrame([(i, i % 2) for i in range(1, 14)] + [(None, 1), (3, None), (2, 7)], "doc_id long, quality int")
    got = quality.quality_query(docs, some).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.quality_query(empty, some).count() == 0


def test_url_aliases(spark):
    pages = [
        (1, "https://a.example.com/de/x", ""),
        (2, "http://mirror.test/x", '<link rel="canonical" href="https://A.example.com/de/x#top">'),
        (3, "http://hop.test/y", "<meta http-equiv=refresh content='0; url=http://mirror.test/x'>"),
        (4, "http://w.org/fr/", "<link href='/fr/z' rel=canonical>"),
        (5, "http://w.org/fr/z", None),
        (6, "http://free.test/", "<link rel=canonical href='http://w.org/fr/z'><link rel=canonical href=http://x.net/>"),
        (7, None, "<link rel=canonical href='/q'>"),
        (8, "no scheme", None),
        (9, "http://x.NET", None),
        (10, "http://x.net/", None),
        (10, "http://x.net/", None),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[1][2:] == ("example.com/de/", "block")
    assert got[2][3] == got[3][3] == "block"
    assert got[4][2:] == got[5][2:] == ("org/fr/", "allow")
    assert got[6][3] == "allow"
    assert got[7] == ("", "", None, "allow") and got[8] == ("", "", None, "allow")
    assert got[9] == ("x.net", "", None, "allow") and got[10] == ("x.net", "/", "net/", "block")


def test_licences(spark, empty):
    from creditloom.llm.licenses import licence_query

    plain = [" ".join(words(i, 12)) for i in range(60)]
    texts = [*plain, "Released under the MIT License.", "x\nLicensed under CC BY-NC 4.0.\ny", "our license to thrill is a film", None, ""]
    got = {r.doc_id: (r.n_licences, r.families) for r in licence_query(spark.createDataFrame(rows(texts), DOC)).collect()}
    assert got[61] == (1, "mit") and got[62] == (1, "cc-by-nc")
    assert all(v == (0, "") for k, v in got.items() if k not in (61, 62))
    assert licence_query(empty).count() == 0


def test_licence_model_counts_every_plain_window(spark):
    from creditloom.llm.licenses import LICENCE_WORDS, TERMS, fit, paragraphs_of

    # More lines than any sample would hold; rare terms and copies of lines count as often as they occur.
    texts = [f"line {i} of the corpus {'is governed by rain' if i % 900 == 0 else 'tells nothing'}" for i in range(4500)]
    texts += ["copied words " * 24] * 10 + ["a license line does not count", None, ""]
    docs = spark.createDataFrame(rows(texts), DOC)
    model = fit(paragraphs_of(docs))
    assert not any(w in LICENCE_WORDS for w in ("governed", "corpus"))
    assert model.windows == 4500 + 10 * 2
    assert model.background["of"] == model.background["the"] == 4500
    assert model.background["governed"] == model.background["governed by"] == 5
    assert "license" in TERMS and "license" not in model.background
    assert all(0 <= b < 0.01 for b in model.bars)
    empty_model = fit(paragraphs_of(docs.limit(0)))
    assert empty_model.windows == 0 and set(empty_model.bars) == {0.0}


def test_licences_of_every_template_alone_and_inside_lines(spark):
    from creditloom.llm.licenses import TEMPLATES, licence_query

    texts, want = [" ".join(words(i, 12)) for i in range(60)] + [" ".join(words(i, 90)) for i in range(60)], {}
    for family, templates in TEMPLATES.items():
        for t in templates:
            for before, after in [(0, 0), (5, 0), (20, 0), (40, 0), (17, 30), (200, 3), (0, 60)]:
                texts.append(" ".join([*words(before, before), t, *words(after + 1, after)]))
                want[len(texts)] = (1, family)
    texts += ["All rights reserved.", "tail " * 50 + "All rights reserved.", "Released under the MIT License. " + " ".join(words(4, 9)) + " Licensed under CC BY 4.0."]
    want |= {len(texts) - 2: (1, "proprietary"), len(texts) - 1: (1, "proprietary"), len(texts): (2, "cc-by,mit")}
    texts += ["the film was released under the title of the work", "it is subject to the terms of the house, and you may not use this file"]
    got = {r.doc_id: (r.n_licences, r.families) for r in licence_query(spark.createDataFrame(rows(texts), DOC)).collect()}
    assert {k: (got[k], texts[k - 1]) for k in got if got[k] != want.get(k, (0, ""))} == {}


def test_texts_of_one_id_with_equal_32_bit_hashes_stay_apart(spark):
    import corpus_pipeline
    from pyspark.sql import functions as F

    from creditloom.llm.common import row_key

    tail = " ".join(words(1, 40))
    made = spark.range(300_000).select(F.concat(F.lit(tail + " "), F.col("id").cast("string"), F.lit(" end")).alias("text"))
    twins = made.groupBy(F.hash("text")).agg(F.collect_list("text").alias("t")).filter("size(t) > 1").first().t[:2]
    both = spark.createDataFrame([(None, twins[0]), (None, twins[1]), (None, None), (None, ""), (None, twins[0])], "doc_id long, text string")
    assert both.select(*row_key("doc_id", "text")).distinct().count() == 4
    assert both.select(F.hash(F.coalesce("text", F.lit("")))).distinct().count() == 2
    # Unlike texts of equal keys would lose one of them here.
    plain = spark.range(300_000).select(F.concat(F.sha2(F.col("id").cast("string"), 256), F.lit(" "), F.sha2(F.concat(F.lit("x"), F.col("id").cast("string")), 256)).alias("text"))
    unlike = plain.groupBy(F.hash("text")).agg(F.collect_list("text").alias("t")).filter("size(t) > 1").first().t[:2]
    docs = spark.createDataFrame([(None, t) for t in unlike], "doc_id long, text string")
    assert {r.text for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, "").collect()} == set(unlike)


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    from check import duck, normal

    df = QUERIES[name](spark, SF)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    cur = duck(SF).execute(ORACLES[name])
    assert got == normal(cur.fetchall(), [c[0] for c in cur.description])


def test_quality_held_out_accuracy(spark):
    labels = dict(duckdb.sql(f"select doc_id, quality from '/root/testdata/sf0.01/labels.parquet'").fetchall())
    got = [r for r in QUERIES["op6_quality_classifier"](spark, "/root/testdata/sf0.01").collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in got) >= 0.95 * len(got)


def test_pipeline_stages(spark):
    import corpus_pipeline

    before = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert pieces and {r.doc_id for r in pieces} <= before


def test_quality_starts_without_the_pieces_of_the_encoders(spark, docs, monkeypatch):
    inner, starts = quality.append, []
    monkeypatch.setattr(quality, "append", lambda df, text, fields, make: starts.append(make) or inner(df, text, fields, make))
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 14)], "doc_id long, quality int")
    quality.quality(docs, quality.fit(docs, labels))
    assert len(starts) == 2
    for start in starts:
        encode = tokens.encoder(None, True)
        before = encode.batch(["one two", "two three"])
        assert encode.known
        start()
        assert not encode.known
        assert encode.batch(["one two", "two three"]) == before
