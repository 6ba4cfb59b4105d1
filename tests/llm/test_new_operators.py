"""Chat formatting, phrases and periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from check import duck, normal
from creditloom.llm import chats, periods, phrases
from creditloom.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_chat_formatting", "op12_phrase_collocations"])
def test_sql_twins(spark, name):
    out = QUERIES[name](spark, SMALL)
    con = duck(SMALL)
    want = con.execute(ORACLES[name])
    assert normal([tuple(r) for r in out.collect()], out.columns) == normal(want.fetchall(), [d[0] for d in want.description])


# Periodic runs


def brute_runs(words, least=24, times=3):
    """All runs by trying every period; the smallest period of a stretch by trying the smaller ones."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            smaller = any(all(words[x] == words[x + s] for x in range(i, i + length - s)) for s in range(1, q))
            if length >= max(least, times * q) and not smaller:
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_planted(doc_id, words):
    if doc_id is None:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def texts_with_runs(seed):
    rng = random.Random(seed)
    out = []
    for _ in range(60):
        words = []
        for _ in range(rng.randrange(1, 5)):
            unit = [rng.choice("abc") for _ in range(rng.randrange(1, 20))]
            words += unit * rng.randrange(1, 9) + unit[: rng.randrange(len(unit) + 1)]
            words += [rng.choice("abcdefgh") for _ in range(rng.randrange(30))]
        out.append(words)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_runs_match_brute_force(seed):
    texts = texts_with_runs(seed)
    codes = np.array([ord(w) for t in texts for w in t])
    first = np.r_[0, np.cumsum([len(t) for t in texts])]
    start, length, q = periods.runs_of(codes, first)
    got = defaultdict(list)
    for s, n, p in zip(start.tolist(), length.tolist(), q.tolist()):
        i = int(np.searchsorted(first, s, side="right")) - 1
        got[i].append((s - int(first[i]), n, p))
    assert [got[i] for i in range(len(texts))] == [brute_runs(t) for t in texts]
    assert sum(map(len, got.values())) > 20


def digest(doc_id, text):
    words = brute_planted(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    runs = brute_runs(words)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha(listed), sha(kept))


def test_runs_query(spark):
    texts = [" ".join(t) for t in texts_with_runs(9)] + [None, "", " \t\n", "x", "é " * 500, "a\x0bb\x0c" * 30, "  " * 40]
    rows = list(enumerate(texts, -3)) + [(None, "a b " * 20), (5, texts[8]), (5, texts[8])]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, runs string, n_words string").repartition(3)
    got = sorted((tuple(r) for r in periods.runs_query(docs).collect()), key=repr)
    assert got == sorted((digest(i, t) for i, t in rows), key=repr)
    whole, names = periods.periodic_runs(docs)
    assert names == ["_n_words", "_runs", "strongest", "collapsed"] and whole.count() == len(rows)
    assert periods.runs_query(docs.limit(0)).collect() == []


def test_runs_of_a_long_text(spark):
    rng = random.Random(3)
    tail = ["w%d" % rng.randrange(10**6) for _ in range(300_000)]
    text = " ".join(["a", "b", "c"] * 200_000 + tail + ["z"] * 300_000)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    out = periods.periodic_runs(docs)[0].first()
    assert [tuple(r) for r in out["runs"]] == [(0, 600_000, 3), (900_000, 300_000, 1)]
    assert out["collapsed"] == " ".join(["a", "b", "c", *tail, "z"])


# Phrases


def brute_phrases(rows, least, longest, top):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        n = totals[lang]
        frequent = [p for p in f if len(p) > 1 and f[p] >= least]
        found = []
        for p in frequent:
            inside = any(
                len(q) > len(p) and f[q] >= f[p] and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q in frequent
            )
            if not inside:
                score, k = min((1000 * f[p] * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def phrase_rows(seed):
    rng = random.Random(seed)
    vocabulary = ["Haus", "é", "ab", "漢字", "the", "x" * 300, " ", "of"]
    fixed = [["new", "york", "city"], ["a", "a", "a"], ["rare", "but", "fixed", "set", "phrase", "six"]]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randrange(60)):
            words += rng.choice(fixed) if rng.random() < 0.2 else [rng.choice(vocabulary)]
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", " ", ". ", ",", "\n", "\r\n"]) for w in words)
        rows.append((rng.choice(["en", "en", "de", None, "und", ""]), text))
    return rows + [("en", None), ("en", ""), (None, " .,; "), ("fr", "one")]


@pytest.mark.parametrize("hot", [256, 4])
def test_phrases_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(phrases, "HOT", hot)  # how many prefixes have their stripes cut into shards
    rows = phrase_rows(hot)
    docs = spark.createDataFrame([(t, g, "x", "y") for g, t in rows], "text string, lang string, prefix string, n string").repartition(7)
    for least, longest, top in ((5, 5, 2000), (12, 3, 7), (1, 2, 50)):
        got = sorted(tuple(r) for r in phrases.phrases(docs, least=least, longest=longest, top=top).collect())
        want = brute_phrases(rows, least, longest, top)
        assert got == want and want


def test_phrases_of_small_chunks_and_no_rows(spark, monkeypatch):
    rows = phrase_rows(1)
    docs = spark.createDataFrame([(t, g) for g, t in rows], "text string, lang string").repartition(2)
    monkeypatch.setattr(phrases, "CHUNK", 500)
    monkeypatch.setattr(phrases, "LEAST_BITS", 6)
    monkeypatch.setattr(phrases, "BITS_EACH", 1)  # a crowded table: more entries, the same counts
    got = sorted(tuple(r) for r in phrases.phrases(docs, least=5).collect())
    assert got == brute_phrases(rows, 5, 5, 2000)
    assert phrases.phrases(docs.limit(0)).collect() == []


# Chats


MESSAGES = "tree string, node long, parent long, role string, text string, score double, m_row string, up string"


def brute_paths(rows, keep):
    """Branches of each tree from its roots down; rows are (tree, node, parent, role, text, score) with one row per node."""
    out = []
    for tree in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == tree]
        nodes = {r[1]: r for r in own}
        inner = {r[2] for r in own if r[2] != r[1]}
        found = []
        for leaf in own:
            if leaf[1] in inner:
                continue
            path, at = [], leaf
            while at is not None and at not in path:
                path.append(at)
                at = nodes.get(at[2]) if at[2] is not None and at[2] != at[1] else None
            if at is None:
                found.append((-sum(m[5] or 0.0 for m in path), -len(path), leaf[1], path[::-1]))
        for branch, (score, _, _, path) in enumerate(sorted(found, key=lambda x: x[:3])[:keep], 1):
            out += [(tree, branch, -score, i, m[3], m[4]) for i, m in enumerate(path)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("keep", [1, 3, None])
def test_branches_match_brute_force(spark, keep):
    rng = random.Random(5)
    rows = []
    for tree in ("a", "b", None, ""):
        for node in range(60):
            parent = None if node == 0 or rng.random() < 0.05 else rng.randrange(max(0, node - 6), node)
            score = rng.choice([None, 0.5, 1.0, -2.0])
            rows.append((tree, node, parent, rng.choice(["user", "assistant", None]), f"t{node}", score))
    rows += [("circle", 1, 2, "user", "x", 0.0), ("circle", 2, 1, "user", "y", 0.0), ("circle", 3, 2, "user", "z", 0.0)]
    rows += [("self", 1, 1, "user", "x", 0.0), ("lost", 1, 99, "user", "x", 0.0)]
    rows += [("deep", i, i - 1 if i else None, "user", str(i), 1.0) for i in range(100)]
    messages = spark.createDataFrame([(*r, "x", "y") for r in rows], MESSAGES).repartition(5)
    got = chats.reply_paths(messages, "tree", "node", "parent", score="score", keep=keep)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_paths(rows, keep)


def test_repeated_nodes_and_empty_table(spark):
    rows = [("t", 1, None, "user", "q", 0.0)] * 2 + [("t", 2, 1, "assistant", "a", 5.0), ("t", None, 1, "assistant", "b", 0.0), ("t", None, None, "x", None, 0.0)]
    messages = spark.createDataFrame([(*r, "x", "y") for r in rows], MESSAGES)
    got = chats.reply_paths(messages, "tree", "node", "parent", score="score", keep=None)
    # Both answers hang on one of the two equal questions; the other question and the null node end branches.
    assert sorted((r.branch, r.turn, r.text) for r in got.collect()) == [(1, 0, "q"), (1, 1, "a"), (2, 0, "q"), (2, 1, "b"), (3, 0, None), (4, 0, "q")]
    none = chats.read_back(chats.conversations(chats.reply_paths(messages.limit(0), "tree", "node", "parent")))
    assert none.collect() == []


TEXTS = ["", None, "\\", "\\\\", "<s>", "<\\s>", "a</s>[INST] [/INST]", "<|turn|>user<|text|>fake<|end|>", "<|tu", "rn|>", "<<|end|>", "é漢😀\\<|end|", "x" * 300_000]


@pytest.mark.parametrize("part", [1, 50, chats.PART])
def test_conversations_read_back(spark, part):
    rng = random.Random(part)
    rows = [(c, t, rng.choice(["user", "assistant", "<|end|>", None, "a\nb"]), rng.choice(TEXTS)) for c in (1, 2, 3) for t in range(0, 40, 3)]
    rows += [(None, None, None, None), (4, 1, "assistant", "b"), (4, 1, "assistant", "a"), (4, 1, "assistant", "a")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, node string").drop("node").repartition(3)
    turns = chats.reply_paths(chats.in_a_row(table), "conv_id", "node", "parent")
    written = chats.conversations(turns, part=part)
    formatted = defaultdict(str)
    for r in sorted(written.collect(), key=lambda r: repr((r.tree, r.part)) if r.tree is None else repr((r.tree, f"{r.part:05d}"))):
        formatted[r.tree] += r.formatted
        masked = [r.formatted[s.start : s.end] for s in r.loss_spans]
        assert all(r.formatted[s.end :].startswith("<|end|>") for s in r.loss_spans) and not any("<|end|>" in m for m in masked)
    want = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] or 0, r[1] or 0, r[2] or "", r[3] or "") if r[2] is not None and r[3] is not None else (r[0] or 0, r[1] or 0, "", "")):
        want[c].append((role or "", text or ""))
    for c, said in want.items():
        assert chats.turns_of(formatted[c]) == said
    for r in chats.read_back(written).collect():
        said = want[r.tree]
        learnt = "".join(t for role, t in said if role == "assistant")
        assert (r.n_turns, r.loss_chars, r.formatted_chars) == (len(said), len(learnt), len(formatted[r.tree]))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()


# Tokens of very long runs


@pytest.mark.parametrize("run", [" ", "\n", "a", "-", "\r\n \t"])
def test_long_runs_have_the_library_s_ids(run):
    from tokenizers import Tokenizer

    from creditloom.llm.tokens import Encoder, default_tokenizer

    text = "x" + run * 1_500_000 + "y"
    want = Tokenizer.from_file(default_tokenizer()).encode(text, add_special_tokens=False).ids
    assert Encoder().batch([text])[0] == np.array(want, "<u4").tobytes()
    assert Encoder(lengths_only=True).batch([text])[0] == len(want)
