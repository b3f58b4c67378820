"""License scans: a paragraph classifier over sparse word n-grams, applied by joins, confirmed against templates."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut

#: The notices of public licences, by family.
TEMPLATES = {
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Licensed under the MIT licence.",
        "The MIT License (MIT)",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "SPDX-License-Identifier: LGPL-3.0-only",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ),
    "agpl": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "epl": (
        "Licensed under the Eclipse Public License 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "boost": ("Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"),
    "artistic": ("Licensed under the Artistic License 2.0.", "SPDX-License-Identifier: Artistic-2.0"),
    "zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "SPDX-License-Identifier: Zlib",
    ),
    "eupl": ("Licensed under the European Union Public Licence (EUPL), Version 1.2.", "SPDX-License-Identifier: EUPL-1.2"),
    "cddl": ("The contents of this file are subject to the terms of the Common Development and Distribution License.", "SPDX-License-Identifier: CDDL-1.0"),
    "isc": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc0": ("Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0."),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
    "proprietary": ("All rights reserved.", "Copyright 2020 Example Corporation. All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited."),
}
UNKNOWN = "unknown"
#: Sentences that use the words of licences and are none.
OTHER = (
    "He got a driver license last week and a copy of the form.",
    "The software runs on any machine without much work.",
    "She works for the public library and reads the general news.",
    "You can use this table for free in the kitchen.",
    "The copyright office is closed on Monday.",
    "We reserved a room in the hotel, all of us.",
    "The source of the river is in the mountains, version after version of the map says so.",
    "Commons and lords met to vote on the law.",
    "The terms of the contract were agreed to in writing by the two persons.",
    "Apache helicopters and Mozilla browsers have nothing in common.",
    "A warranty covers parts of the car, the notice says.",
    "The program was released in the spring under a new name.",
    "Students of MIT published a paper on water.",
    "The rights of workers are the subject of this book.",
    "Attribution of the painting to the master is in doubt.",
    "Please include a notice of the meeting in all letters.",
)
#: Words too common to tell anything.
STOP = frozenset("a an and any are as at be by for from have he if in into is it its of on or she so that the their them then there these they this to up us was we were which will with you your".split())
TOKEN = r"[^a-z0-9]+"
VARIANTS, STEPS, SEED, RIDGE = 12, 250, 11, 1e-4
#: Share of held-out other paragraphs that may pass the threshold; the template comparison follows.
FALSE_ACCEPT = 0.02
#: Share of a template's n-grams that a paragraph must hold for its family to be confirmed.
CONFIRM = 0.6


def grams(text: str) -> list[str]:
    """Distinct n-grams that may be features: words that are not common, and pairs with one of them."""
    tokens = [t for t in re.split(TOKEN, text.lower()) if t]
    pairs = [f"{a} {b}" for a, b in zip(tokens, tokens[1:], strict=False) if a not in STOP or b not in STOP]
    return sorted({t for t in tokens if t not in STOP} | set(pairs))


@dataclass(frozen=True)
class LicenseModel:
    classes: tuple[str, ...]
    vocabulary: tuple[str, ...]
    weights: np.ndarray  # n-grams x classes, divided by the temperature
    bias: np.ndarray
    threshold: float  # below this probability a paragraph is unknown


def _examples(rng: np.random.Generator) -> tuple[list[str], list[str]]:
    texts, names = [], []
    filler = [w for s in OTHER for w in s.split()]
    every = [(k, t) for k, ts in TEMPLATES.items() for t in ts]
    for name, text in every:
        tokens = text.split()
        for v in range(VARIANTS):
            kept = [w for w in tokens if v == 0 or len(tokens) < 8 or rng.random() > 0.15 * (v % 3)]
            around = [list(rng.choice(filler, rng.integers(0, 12))) if v % 2 else [] for _ in range(2)]
            texts.append(" ".join([*around[0], *kept, *around[1]]))
            names.append(name)
    words = [w for _, t in every for w in t.split()]
    for v in range(VARIANTS * 20):
        if v % 3 == 0:
            texts.append(" ".join(rng.permutation(OTHER[v % len(OTHER)].split())) if v % 2 else OTHER[v % len(OTHER)])
        else:  # the words of licences out of order
            texts.append(" ".join([*rng.choice(words, rng.integers(1, 6 if v % 3 == 1 else 14)), *rng.choice(filler, rng.integers(1, 20))]))
        names.append(UNKNOWN)
    return texts, names


@cache
def train(seed: int = SEED) -> LicenseModel:
    """Softmax regression on variants of the templates; temperature and threshold from variants it has not seen."""
    rng = np.random.default_rng(seed)
    classes = (*TEMPLATES, UNKNOWN)
    vocabulary = tuple(sorted({g for ts in TEMPLATES.values() for t in ts for g in grams(t)} | {g for t in OTHER for g in grams(t)}))
    place = {g: i for i, g in enumerate(vocabulary)}

    def matrix(texts):
        x = np.zeros((len(texts), len(vocabulary)))
        for r, t in enumerate(texts):
            x[r, [place[g] for g in grams(t) if g in place]] = 1
        return x

    (texts, names), (held, held_names) = _examples(rng), _examples(rng)
    x, xh = matrix(texts), matrix(held)
    y, yh = (np.array([classes.index(n) for n in ns]) for ns in (names, held_names))
    w, b = np.zeros((len(vocabulary), len(classes))), np.zeros(len(classes))
    speed, onehot = np.zeros_like(w), np.eye(len(classes))[y]
    for _ in range(STEPS):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p = p / p.sum(axis=1, keepdims=True) - onehot
        speed = 0.9 * speed - 0.5 * (x.T @ p / len(x) + RIDGE * w)
        w, b = w + speed, b - 0.5 * p.mean(axis=0)

    def probability(t):
        z = (xh @ w + b) / t
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    heat = min(np.linspace(0.5, 4, 36), key=lambda t: -np.log(np.maximum(probability(t)[np.arange(len(yh)), yh], 1e-12)).sum())
    p = probability(heat)
    unknown = classes.index(UNKNOWN)
    best = np.delete(p, unknown, axis=1).max(axis=1)
    wrong = np.sort(best[yh == unknown])
    threshold = float(max(0.5, wrong[int(np.ceil((1 - FALSE_ACCEPT) * len(wrong))) - 1]))
    return LicenseModel(classes, vocabulary, w / heat, b / heat, threshold)


def _literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _values(spark: SparkSession, rows: list[str], names: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t({names})")


def _column_grams(tokens):
    """The n-grams of an array of words, as grams() makes them."""
    stop = sorted(STOP)
    kept = F.filter(tokens, lambda t: ~t.isin(stop))
    pairs = F.zip_with(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.when(~a.isin(stop) | ~b.isin(stop), F.concat_ws(" ", a, b)))
    return F.array_distinct(F.concat(kept, F.filter(pairs, lambda p: p.isNotNull())))


def _held(rows: DataFrame, model: LicenseModel) -> DataFrame:
    """rows with grams, the model's n-grams in the column line, sorted and joined by line ends, in place of it.

    Words and n-grams are columns of their own, since a lambda's body repeats what is written into it.
    """
    rest = [c for c in rows.columns if c != "line"]
    rows = rows.select(*rest, F.filter(F.split(F.lower("line"), TOKEN), lambda t: t != "").alias("tokens"))
    known = F.filter(_column_grams(F.col("tokens")), lambda g: g.isin(list(model.vocabulary)))
    return rows.select(*rest, F.array_join(F.array_sort(known), "\n").alias("grams"))


def classify_paragraphs(held: DataFrame, model: LicenseModel) -> DataFrame:
    """grams, family, score, template, similarity of distinct sets of n-grams (column grams, see _held()) that a
    template confirms. Score and similarity look at nothing else of a paragraph.

    The model has a fixed size (its vocabulary comes from the templates), so its tables are broadcast.
    """
    spark = held.sparkSession
    kept = [i for i in range(len(model.vocabulary)) if np.abs(model.weights[i]).max() > 1e-6]
    weights = _values(spark, [f"({_literal(model.vocabulary[i])}, array({', '.join(f'{v:.9g}D' for v in model.weights[i])}))" for i in kept], "gram, w")
    k = len(model.classes)
    scored = held.select("grams", F.explode(F.split("grams", "\n")).alias("gram")).join(F.broadcast(weights), "gram").groupBy("grams").agg(*[F.sum(F.col("w")[i]).alias(f"z{i}") for i in range(k)])
    logits = F.array(*[F.col(f"z{i}") + F.lit(float(model.bias[i])) for i in range(k)])
    top = F.array_max("z")
    p = F.transform("z", lambda v: F.exp(v - F.array_max("z")))
    family = F.element_at(F.array(*[F.lit(c) for c in model.classes]), F.array_position("z", top).cast("int"))
    scored = scored.select("grams", logits.alias("z")).select("grams", family.alias("family"), (F.lit(1.0) / F.aggregate(p, F.lit(0.0), lambda a, v: a + v)).alias("score"))
    scored = scored.where((F.col("family") != UNKNOWN) & (F.col("score") >= model.threshold))
    sets = _values(spark, [f"({_literal(name)}, {_literal(text)}, array({', '.join(_literal(g) for g in grams(text))}))" for name, ts in TEMPLATES.items() for text in ts], "family, template, held")
    alike = (F.size(F.array_intersect(F.split("grams", "\n"), "held")) / F.size("held")).alias("similarity")
    near = scored.join(F.broadcast(sets), "family").select("grams", "family", "score", "template", alike).where(F.col("similarity") >= CONFIRM)
    best = near.groupBy("grams").agg(F.max(F.struct("similarity", "template", "family", "score")).alias("m"))
    return best.select("grams", "m.family", "m.score", "m.template", "m.similarity")


@cache
def cue_grams() -> tuple[str, ...]:
    """N-grams of which every paragraph that a template can confirm holds one: of each template so many that those left
    are less than the share that has to be held. Pairs of uncommon words are taken first, as the least frequent."""
    chosen: set[str] = set()
    for held in sorted((grams(t) for ts in TEMPLATES.values() for t in ts), key=len):
        least = next(k for k in range(len(held) + 1) if k / len(held) >= CONFIRM)
        rare = sorted(held, key=lambda g: (g not in chosen, " " not in g, -sum(w not in STOP for w in g.split()), -len(g), g))
        chosen.update(rare[: len(held) - least + 1])
    return tuple(sorted(chosen))


def _branches(rests: set[str]) -> str:
    """A pattern of any of these n-grams, or ends of some, up to the end of a word; each beginning is tried once."""
    heads: dict[str, set[str]] = {}
    for r in rests - {""}:
        heads.setdefault(r[0], set()).add(r[1:])
    found = ["(?![a-z0-9])"] * ("" in rests) + [("[^a-z0-9]++" if c == " " else c) + _branches(more) for c, more in sorted(heads.items())]
    return found[0] if len(found) == 1 else f"(?:{'|'.join(found)})"


@cache
def cue_pattern() -> str:
    """What a lowered text, with a blank before it, matches if it holds one of cue_grams()."""
    return "[^a-z0-9]" + _branches(set(cue_grams()))


def _cue(column):
    """Whether one of cue_grams() occurs."""
    return F.lower(F.concat(F.lit(" "), column)).rlike(cue_pattern())


def _candidates(rows: DataFrame) -> DataFrame:
    """row, tag, block, number, lines, line: each block of neighbouring non-blank lines of at least two, and each line,
    if it holds a cue; block is the number of the block's first line."""
    blank = lambda x: F.btrim(x, F.lit(" \t\r\f\x0b")) == ""
    some = rows.where(_cue(F.col("text"))).select("row", "tag", F.split("text", "\n", -1).alias("all"))
    some = some.select("row", "tag", "all", F.concat(F.array(F.lit(True)), F.transform("all", blank), F.array(F.lit(True))).alias("blank"))
    at = F.sequence(F.lit(0), F.size("all") - 1)
    inner = lambda i, side: ~F.col("blank")[i + 1] & F.col("blank")[i + side]  # noqa: E731  blank[i + 1] is line i
    some = some.select("row", "tag", "all", F.filter(at, lambda i: inner(i, 0)).alias("first"), F.filter(at, lambda i: inner(i, 2)).alias("last"))
    text = lambda a, b: F.array_join(F.slice(F.col("all"), a + 1, b - a + 1), "\n")
    blocks = F.zip_with("first", "last", lambda a, b: F.struct(a.alias("block"), (b - a + 1).alias("lines"), text(a, b).alias("text")))
    some = some.select("row", "tag", F.inline(blocks)).where(_cue(F.col("text")))
    lone = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct((F.col("block") + i).alias("number"), F.lit(1).alias("lines"), x.alias("line")))
    whole = F.filter(F.array(F.struct(F.col("block").alias("number"), "lines", F.col("text").alias("line"))), lambda c: c["lines"] > 1)
    return some.select("row", "tag", "block", F.inline(F.filter(F.concat(lone, whole), lambda c: _cue(c["line"]))))


def scan_licenses(docs: DataFrame, model: LicenseModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_paragraphs (non-blank lines), n_licences, families (sorted, comma-joined, empty
    without one), and of the confirmed paragraph with the largest score (first of equals) its number from 0, family,
    score, template and similarity, else null.

    A paragraph without a cue cannot be confirmed by any template (see cue_grams()), so it is left out before any
    n-gram is made. Notices that are wrapped over lines are found too: each block of neighbouring non-blank lines is
    a further candidate beside its lines, numbered as its first line; it counts unless a line of it already confirmed
    the same family. What candidates hold of the model's n-grams is written once; each distinct set of them is judged
    once, and a frequent notice is one row after a map-side combine. Repeated rows are all returned; null and empty
    texts have no paragraph; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).select("id", F.xxhash64("id", "text").alias("row"), F.xxhash64("text").alias("tag"), "text")
    found = cut(_held(_candidates(rows), model), "licences")
    hits = found.join(classify_paragraphs(found.select("grams").distinct(), model), "grams").dropDuplicates(["row", "tag", "number", "lines"])
    lone = hits.where("lines = 1")
    wrapped = hits.where("lines > 1").join(lone.select("row", "tag", "block", "family"), ["row", "tag", "block", "family"], "left_anti")
    names = ["row", "tag", "number", "family", "score", "template", "similarity"]
    hits = lone.select(*names).unionByName(wrapped.select(*names))
    best = F.max(F.struct("score", (-F.col("number")).alias("back"), "family", "template", "similarity")).alias("m")
    per = hits.groupBy("row", "tag").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), best)
    count = F.size(F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "")).cast("long").alias("n_paragraphs")
    out = rows.select("id", "row", "tag", count).join(per, ["row", "tag"], "left")
    return out.select(
        F.col("id").alias(id_col), "n_paragraphs", F.coalesce("n", F.lit(0).cast("long")).alias("n_licences"), F.coalesce("families", F.lit("")).alias("families"),
        (-F.col("m.back")).alias("paragraph"), F.col("m.family").alias("family"), F.col("m.score").alias("score"), F.col("m.template").alias("template"), F.col("m.similarity").alias("similarity"),
    )
