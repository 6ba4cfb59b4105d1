"""Token counts and token ids of whole texts.

A byte-level BPE never merges across its own word borders, and a border always lies before a space that
stands between two visible characters.  So a text is cut at those safe places, each distinct piece is
encoded once in a batch, and the pieces of later texts are looked up.  Texts are
worked on in slices balanced by bytes, long texts in stretches that end at a safe place.  A text that holds
a special string is encoded whole, because special strings change what counts as the end of white space.

Null and empty texts have no tokens.  Rows are independent: repeated ids and rows give a result each.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from creditloom.llm.common import append, utf8

#: Entries kept in a worker before the table of pieces is started anew (memory only, never results).
CACHE_ENTRIES = 800_000
#: Characters of a long text that are cut into pieces at a time.
STRETCH = 1_000_000

# Unicode White_Space, as the tokenizer's own pattern takes it.
_WHITE = "\t-\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_PIECE = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
_SAFE = re.compile(f"(?<=[^{_WHITE}]) (?=[^{_WHITE}])")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def stretches(text: str, size: int = STRETCH):
    """Consecutive parts of about ``size`` characters, cut only where the tokenizer has a border as well."""
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranks(tokenizer_json: dict) -> dict[bytes, int] | None:
    """Bytes and ranks of a byte-level BPE whose merges apply in the order of their ids, else None."""
    model, before = tokenizer_json["model"], tokenizer_json.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    if tokenizer_json.get("normalizer") or model.get("ignore_merges") or model.get("dropout"):
        return None
    letters = _byte_letters()
    special = {t["content"] for t in tokenizer_json.get("added_tokens", [])}
    vocabulary = {t: i for t, i in model["vocab"].items() if t not in special}
    merged = [vocabulary.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    if None in merged or merged != sorted(merged) or any(c not in letters for t in vocabulary for c in t):
        return None
    return {bytes(letters[c] for c in t): i for t, i in vocabulary.items()}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, or only their number.

    The tokenizers library encodes what is rare: whole texts with special strings, very long pieces and pieces with
    characters beyond the Latin blocks.  The many other pieces go through tiktoken with the ranks of the same
    file, which gives the same ids several times faster; a file of another kind uses the one library only.
    """

    #: Below this code point both libraries class letters, digits and marks alike.
    SAME_CLASSES = 0x250
    #: Longer pieces go to the tokenizers library: tiktoken overflows its stack on a run of a million blanks.
    LONG_PIECE = 10_000

    def __init__(self, path: str | None = None, lengths_only: bool = False):
        import tiktoken
        from tokenizers import Tokenizer

        path = path or default_tokenizer()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            ranks = _ranks(json.load(f))
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.quick = ranks and tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.lengths_only = lengths_only
        self.known: dict[str, int | bytes] = {}

    def _form(self, ids: list[int]) -> int | bytes:
        return len(ids) if self.lengths_only else np.array(ids, "<u4").tobytes()

    def _whole(self, texts: list[str]) -> list:
        return [self._form(x.ids) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: set[str]) -> None:
        if self.quick is None:
            rare = list(pieces)
        else:
            form, encode, top = self._form, self.quick.encode_ordinary, chr(self.SAME_CLASSES)
            rare = [p for p in pieces if len(p) > self.LONG_PIECE or max(p) >= top]
            self.known.update((p, form(encode(p))) for p in pieces.difference(rare))
        self.known.update(zip(rare, self._whole(rare)))

    def batch(self, texts: list[str]) -> list:
        cut = [
            None if any(s in text for s in self.special) else [p for part in stretches(text) for p in _PIECE.findall(part)]
            for text in texts
        ]
        new = {p for pieces in cut if pieces for p in pieces if p not in self.known}
        if new:
            if len(self.known) + len(new) > CACHE_ENTRIES:
                self.known.clear()
                new = {p for pieces in cut if pieces for p in pieces}
            self._learn(new)
        look = self.known.__getitem__
        out = []
        for text, pieces in zip(texts, cut):
            if pieces is None:
                out.append(self._whole([text])[0])
            else:
                out.append(sum(map(look, pieces)) if self.lengths_only else b"".join(map(look, pieces)))
        return out


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str | None, lengths_only: bool) -> Encoder:
    """One encoder in a Python worker, kept from task to task."""
    key = (path, lengths_only)
    if key not in _encoders:
        _encoders[key] = Encoder(path, lengths_only)
    return _encoders[key]


def forget_pieces() -> None:
    """Empty the tables of pieces of this Python worker: steps that encode nothing need their room, encoders are kept."""
    for known in _encoders.values():
        known.known = {}


def token_counts(docs: DataFrame, text: str = "text", limit: int = 1024, tokenizer: str | None = None) -> tuple[DataFrame, list[str]]:
    """``docs`` with the UTF-8 bytes and tokens of each text, and whether it has more than ``limit`` tokens.

    Returns the frame and the names of the three columns (underscores in front where a name is taken).
    """

    def make():
        count = encoder(tokenizer, True)

        def work(column: pa.Array):
            sizes = np.diff(utf8(column)[1])
            n = np.array(count.batch([x or "" for x in column.to_pylist()]), np.int64)
            return pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)

        return work

    fields = [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())]
    return append(docs, text, fields, make)


def count_query(docs: DataFrame) -> DataFrame:
    out, (size, n, over) = token_counts(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col(size).alias("n_bytes"), F.col(n).alias("n_tokens"), F.col(over).alias("over_limit"))
