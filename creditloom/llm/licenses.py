"""Licence families of documents, by a trained classifier of word windows and template comparison.

A line is cut into overlapping windows of ``WINDOW`` words, so a notice is judged alike wherever it stands in a
line.  A window is the set of the words and word pairs in it that some template has.  The classifier is a naive
Bayes model of such sets, each template against the unknown class: a term of the template is there because the
notice has it (the share of the template's whole and cut texts that hold it) or because the text around it has it
(the share of plain windows that hold it).  A family is as likely as the likeliest of its templates.  The unknown class is counted over every window of every line without
licence words that holds no template, as often as it occurs.  The bars are worked out over the same windows: a family
must be at least as likely as it is for all but one in a thousand of them (a quantile sketch, to a rank of 1/10,000).

A likely family counts when the window also holds at least ``CONFIRM`` of the word pairs of one of its
templates, one of them a pair that no other family has.  Of several such families the one with most pairs
comes first, and another counts only if that still holds without the pairs of those before it.

Each line is coded once: a short code for every word and every pair of neighbouring words, 0 for those no template has;
windows are cut from the codes.  Lines and windows without a pair of one family alone are left out before the classifier,
which does not change the result.  Everything is DataFrame functions, no Python runs on the executors.  Null and
empty texts have no lines.  A licence is a family on a line: a line with notices of two families counts twice,
with two of one family once.  Identical rows share their result; documents without a licence get zero and an
empty list.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from creditloom.llm.common import free_names, row_key
from creditloom.llm.scratch import materialize

CONFIRM = 0.5
#: Words of a window and from one to the next; any ``WINDOW - STEP + 1`` words in a row lie in one window.
WINDOW, STEP = 32, 16
#: Share of the plain windows that stay below the bar of a family.
BAR = 0.999

# Licence families and short notices of each.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "This software is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "SPDX-License-Identifier: MIT",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.",
        "Licensed under the GNU GPL v2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "You can redistribute it under the terms of the GNU Lesser General Public License.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ),
    "proprietary": (
        "All rights reserved. No part of this publication may be reproduced without prior written permission.",
        "Copyright. All rights reserved.",
    ),
}
LICENCE_WORDS = r"(?i)licen[sc]|copyright|all rights|spdx|permission|redistribut|creative commons|\bgpl\b|\bbsd\b|\bmit\b|apache|mozilla"


def tokens(paragraph: str | Column) -> Column:
    return F.array_remove(F.split(F.lower(paragraph), r"[^\p{L}\p{N}+-]+"), "")


def _words(template: str) -> list[str]:
    return [w for w in re.split(r"[^\w+-]+", template.lower()) if w]


def _pairs(template: str) -> list[str]:
    words = _words(template)
    return sorted({" ".join(p) for p in zip(words, words[1:])})


def _own_pairs() -> dict[str, set[str]]:
    """The word pairs of each family that no other family has."""
    pairs = {family: {p for t in templates for p in _pairs(t)} for family, templates in TEMPLATES.items()}
    return {family: mine.difference(*(other for name, other in pairs.items() if name != family)) for family, mine in pairs.items()}


OWN_PAIRS = _own_pairs()


def _term_rows() -> list[tuple[str, int, Counter]]:
    """The family of each template, its texts (whole and cut short at either end), and how many of them hold a term."""
    out = []
    for family, templates in TEMPLATES.items():
        for template in templates:
            parts = template.split()
            cuts = range(0, max(1, len(parts) // 3))
            texts = [" ".join(part) for cut in cuts for part in (parts[cut:], parts[: len(parts) - cut])]
            out.append((family, len(texts), Counter(t for text in texts for t in {*_words(text), *_pairs(text)})))
    return out


TERM_ROWS = _term_rows()
#: Words and word pairs of the templates, those of most templates first; a term's code is its place from 1.
TERMS = sorted({t for _, _, held in TERM_ROWS for t in held}, key=lambda t: (-sum(t in held for _, _, held in TERM_ROWS), " " in t, t))


#: The code of each pair of word codes that is a term, by ``_pair_key``.
PAIR_CODES = {TERMS.index(t.split(" ")[0]) + 1 << 16 | TERMS.index(t.split(" ")[1]) + 1: c for c, t in enumerate(TERMS, 1) if " " in t}
OWN_CODES = sorted(TERMS.index(t) + 1 for t in set().union(*OWN_PAIRS.values()))
#: In lower case; a line without any of them has no licence words.
LICENCE_HINTS = ("licens", "licenc", "copyright", "all rights", "spdx", "permission", "redistribut", "creative commons", "gpl", "bsd", "mit", "apache", "mozilla")


def _has_licence_words(paragraph: str) -> Column:
    """Whether a line has ``LICENCE_WORDS``; the expression runs only on lines with one of the hints."""
    lower = F.lower(paragraph)
    hinted = reduce(Column.__or__, (lower.contains(hint) for hint in LICENCE_HINTS))
    return hinted & F.col(paragraph).rlike(LICENCE_WORDS)


def _codes(words: str) -> Column:
    """The code of each word of an array, 0 for those that no template has."""
    known = [t for t in TERMS if " " not in t]
    codes = F.lit([TERMS.index(t) + 1 for t in known])
    return F.transform(words, lambda t: F.when(t.isin(known), F.get(codes, F.array_position(F.lit(known), t).cast("int") - 1)).otherwise(0).cast("short"))


def _pair_codes(word_codes: str) -> Column:
    """The code of each pair of neighbouring words, by the codes of its words."""
    n = F.greatest(F.size(word_codes) - 1, F.lit(0))
    keys, codes = F.lit(list(PAIR_CODES)), F.lit(list(PAIR_CODES.values()))

    def code(x: Column, y: Column) -> Column:
        key = F.call_function("shiftleft", x.cast("int"), F.lit(16)).bitwiseOR(y.cast("int"))
        found = F.when(key.isin(list(PAIR_CODES)), F.get(codes, F.array_position(keys, key).cast("int") - 1)).otherwise(0)
        return F.when((x > 0) & (y > 0), found).otherwise(0).cast("short")

    return F.zip_with(F.slice(word_codes, F.lit(1), n), F.slice(word_codes, F.lit(2), n), code)


def coded_lines(paragraphs: DataFrame) -> DataFrame:
    """``paragraphs`` with ``plain`` (no licence words) and the codes of the words and word pairs of each line, stored."""
    given = [c for c in paragraphs.columns if c != "paragraph"]
    words = paragraphs.select(*given, (~_has_licence_words("paragraph")).alias("plain"), tokens("paragraph").alias("words"))
    coded = words.select(*given, "plain", _codes("words").alias("word_codes"))
    # Stored first, as a filter on the codes would have them worked out once more.
    return materialize(coded.select("*", _pair_codes("word_codes").alias("pair_codes")), "licence_lines")


def windows_of() -> Column:
    """The windows of a coded line, as (held, pairs); the last one ends with it."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("word_codes") - (WINDOW - STEP + 1), F.lit(0)), F.lit(STEP))

    def window(at: Column) -> Column:
        pairs = F.filter(F.slice("pair_codes", at + 1, WINDOW - 1), lambda c: c > 0)
        words = F.filter(F.slice("word_codes", at + 1, WINDOW), lambda c: c > 0)
        return F.struct(F.array_distinct(F.concat(words, pairs)).alias("held"), pairs.alias("pairs"))

    return F.transform(starts, window)


def _may_be_confirmed(codes: str) -> Column:
    """Whether one of the pairs belongs to one family alone, without which nothing is confirmed."""
    return F.arrays_overlap(codes, F.lit(OWN_CODES).cast("array<smallint>"))


def _templates() -> Column:
    """All templates as an array of (family, place of the family, order of its pairs, codes of its pairs and own pairs)."""
    order = {pairs: i for i, pairs in enumerate(sorted({tuple(_pairs(t)) for templates in TEMPLATES.values() for t in templates}))}
    code = {t: c for c, t in enumerate(TERMS, 1)}
    codes = lambda pairs: F.array(*(F.lit(code[p]).cast("short") for p in pairs)).cast("array<smallint>")
    rows = []
    for label, (family, templates) in enumerate(TEMPLATES.items()):
        for template in templates:
            pairs = _pairs(template)
            own = [p for p in pairs if p in OWN_PAIRS[family]]
            place = F.lit(label).alias("label"), F.lit(order[tuple(pairs)]).alias("order")
            rows.append(F.struct(F.lit(family).alias("family"), *place, codes(pairs).alias("pairs"), codes(own).alias("own")))
    return F.array(*rows)


def _confirmed(pairs: str | Column, p: Column, bars: list[float]) -> Column:
    """Templates (matched, probability, family, shared, ...) that a window with these codes and probabilities confirms, best first."""

    def holds(shared: Column, t: Column) -> Column:
        return (F.size(shared) >= CONFIRM * F.size(t["pairs"])) & F.arrays_overlap(shared, t["own"])

    def compared(t: Column) -> Column:
        shared = F.array_intersect(pairs, t["pairs"])
        return F.struct(
            F.size(shared).alias("matched"), F.get(p, t["label"]).alias("probability"), t["family"].alias("family"),
            t["order"].alias("order"), t["pairs"].alias("pairs"), t["own"].alias("own"), shared.alias("shared"),
        )

    likely = F.filter(_templates(), lambda t: F.get(p, t["label"]) >= F.get(F.lit(bars), t["label"]))
    found = F.filter(F.transform(likely, compared), lambda t: holds(t["shared"], t))
    best_first = F.sort_array(found, asc=False)
    none = F.slice(best_first, 1, 0)

    def add(kept: Column, t: Column) -> Column:
        left = F.array_except(t["shared"], F.flatten(F.transform(kept, lambda k: k["shared"])))
        return F.when(holds(left, t), F.concat(kept, F.array(t))).otherwise(kept)

    return F.aggregate(best_first, none, add)


def plain_windows(lines: DataFrame) -> DataFrame:
    """``held``, the codes of the terms in it, of every window of a coded line without licence words that holds no template; stored."""
    windows = lines.filter("plain").select(F.explode(windows_of()).alias("w")).select("w.held")
    any_family = _confirmed("held", F.lit([1.0] * len(TEMPLATES)), [0.0] * len(TEMPLATES))
    return materialize(windows.filter(~_may_be_confirmed("held") | (F.size(any_family) == 0)), "plain")


@dataclass
class LicenceModel:
    """The fitted classifier.

    ``windows`` plain windows were counted, ``background`` of them hold a term.  A template's log odds are its base and the
    weights of the terms that a window holds, by their code less one (``bases`` and ``weights`` in the order of ``TERM_ROWS``);
    ``bars`` are the probabilities that the families need, in the order of ``TEMPLATES``.
    """

    windows: int
    background: dict[str, int]
    bases: list[float]
    weights: list[list[float]]
    bars: list[float]

    def probabilities(self, held: str | Column) -> Column:
        def odds(base: float, weights: list[float]) -> Column:
            return F.aggregate(held, F.lit(base), lambda so_far, c: so_far + F.get(F.lit(weights), c.cast("int") - 1))

        of_family: dict[str, list[Column]] = {family: [] for family in TEMPLATES}
        for (family, _, _), base, weights in zip(TERM_ROWS, self.bases, self.weights):
            of_family[family].append(odds(base, weights))
        return F.array(*[1 / (1 + F.exp(-F.array_max(F.array(*found)))) for found in of_family.values()])


def _weights(windows: int, background: dict[str, int]) -> tuple[list[float], list[list[float]]]:
    """Bases and weights of the templates, with half a window or text added to every count."""
    bases, weights = [], []
    for _, rows, held in TERM_ROWS:
        base, of_terms = 0.0, []
        for term in TERMS:
            if term not in held:
                of_terms.append(0.0)
                continue
            around = (background.get(term, 0) + 0.5) / (windows + 1)
            own = (held[term] + 0.5) / (rows + 1)
            absent = math.log(1 - own)
            base += absent
            of_terms.append(math.log((1 - (1 - own) * (1 - around)) / around) - absent)
        bases.append(base)
        weights.append(of_terms)
    return bases, weights


def fit(paragraphs: DataFrame) -> LicenceModel:
    return fit_coded(coded_lines(paragraphs))


def fit_coded(lines: DataFrame) -> LicenceModel:
    plain = plain_windows(lines)
    # One row per term of the templates; code 0 counts the windows.
    counts = plain.select(F.explode(F.concat(F.array(F.lit(0).cast("short")), "held")).alias("code")).groupBy("code").count().collect()
    by_code = {r["code"]: r["count"] for r in counts}
    windows, background = by_code.pop(0, 0), {TERMS[c - 1]: n for c, n in by_code.items() if c}
    model = LicenceModel(windows, background, *_weights(windows, background), [])
    scored = plain.select(model.probabilities("held").alias("p"))
    tops = scored.agg(*(F.percentile_approx(F.get("p", F.lit(i)), BAR, 10_000) for i in range(len(TEMPLATES)))).first()
    model.bars = [top or 0.0 for top in tops]
    return model


def licence_lines(lines: DataFrame, model: LicenceModel) -> DataFrame:
    """A row for every window of coded ``lines`` and family that it holds, with family and probability."""
    given = [c for c in lines.columns if c not in ("plain", "word_codes", "pair_codes")]
    windows = lines.filter(_may_be_confirmed("pair_codes")).select(*given, F.explode(windows_of()).alias("w")).select(*given, "w.*")
    windows = windows.filter(_may_be_confirmed("pairs"))
    # Stored, as the comparison would otherwise run the classifier again for each template.
    scored = materialize(windows.select(*given, "pairs", model.probabilities("held").alias("p")), "licence_windows")
    found = scored.select(*given, F.explode(_confirmed("pairs", F.col("p"), model.bars)).alias("found"))
    return found.select(*given, "found.family", "found.probability")


def paragraphs_of(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """k_id, k_text, place and paragraph of every line with a word."""
    lines = F.posexplode(F.split(F.col(text), "\n")).alias("place", "paragraph")
    return docs.select(*row_key(id_column, text), lines).filter(F.col("paragraph").rlike(r"[\p{L}\p{N}]"))


def scan(docs: DataFrame, model: LicenceModel | None = None, id_column: str = "doc_id", text: str = "text") -> tuple[DataFrame, list[str]]:
    """``docs`` with n_licences, families (sorted, distinct) and the best probability; and the columns' names."""
    lines = coded_lines(paragraphs_of(docs, id_column, text))
    model = model or fit_coded(lines)
    found = licence_lines(lines, model)
    a, b, *names = free_names(docs, ["k_id", "k_text", "n_licences", "families", "probability"])
    found = found.groupBy("k_id", "k_text", "place", "family").agg(F.max("probability").alias("probability"))
    per_row = found.groupBy("k_id", "k_text").agg(F.count("*"), F.array_sort(F.collect_set("family")), F.max("probability"))
    per_row = materialize(per_row.toDF(a, b, *names), "licences")
    keys = row_key(id_column, text)
    out = docs.select("*", keys[0].alias(a), keys[1].alias(b)).join(per_row, [a, b], "left").drop(a, b)
    n, families, probability = names
    return out.withColumns(
        {n: F.coalesce(n, F.lit(0).cast("long")), families: F.coalesce(families, F.array().cast("array<string>")), probability: F.coalesce(probability, F.lit(0.0))}
    ), names


def licence_query(docs: DataFrame) -> DataFrame:
    out, (n, families, probability) = scan(docs.select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.col(n).alias("n_licences"),
        F.array_join(families, ",").alias("families"),
        F.round(probability, 6).alias("probability"),
        (F.col(n) > 0).alias("licensed"),
    )
