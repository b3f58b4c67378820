"""Licence scans: every row against plain Python, recall of planted notices of several shapes, clean texts."""

import textwrap
from collections import Counter

import numpy as np
import pytest

from tessera.llm import licenses
from tests.llm.test_operators import SCHEMA, prose

CLEAN = (
    "The license plate of the car was stolen in Boston, and the public library is open at weekends.",
    "Students at MIT apply for a driver license in their first version of the form, with a copy.",
    "The general manager of the software house granted an interview, without any warranty of success.",
    "Eclipse of the sun: the public may watch from the terms of the artistic foundation's roof.",
    "A common distribution of prizes was a boost for the union, free of charge to any person.",
)


def shapes(template):
    return template, "\n".join(textwrap.wrap(template, 40)), template.upper(), "Read this.\n\n" + "\n".join(textwrap.wrap(template, 60)) + "\n\nThe end."


@pytest.fixture(scope="module")
def model():
    return licenses.train()


def brute(text, model):
    """The row of a text by loops, numpy and the model's own numbers."""
    weights = {g: w for g, w in zip(model.vocabulary, model.weights, strict=True) if np.abs(w).max() > 1e-6}

    def judge(part):
        held = set(licenses.grams(part))
        if not held & set(weights):
            return None
        z = model.bias + sum(weights[g] for g in held if g in weights)
        k = int(z.argmax())
        family, score = model.classes[k], 1 / np.exp(z - z.max()).sum()
        if family == licenses.UNKNOWN or score < model.threshold:
            return None
        best = max((len(held & set(licenses.grams(t))) / len(licenses.grams(t)), t) for t in licenses.TEMPLATES[family])
        return (family, score, best[1], best[0]) if best[0] >= licenses.CONFIRM else None

    lines = (text or "").split("\n")
    hits = [(i, judge(x)) for i, x in enumerate(lines)]
    hits = [(i, h) for i, h in hits if h]
    single, begin = list(hits), None
    for i, x in enumerate([*lines, ""]):
        blank = not x.strip(" \t\r\f\x0b")
        if blank and begin is not None and i - begin > 1:
            h = judge("\n".join(lines[begin:i]))
            if h and not any(begin <= at < i and one[0] == h[0] for at, one in single):
                hits.append((begin, h))
        begin = None if blank else i if begin is None else begin
    top = max(hits, key=lambda x: (round(x[1][1], 9), -x[0], x[1][0]), default=None)
    return sum(bool(x.strip(" ")) for x in lines), len(hits), ",".join(sorted({h[0] for _, h in hits})), *((top[0], top[1][0], top[1][2]) if top else (None, None, None))


def test_every_row_equals_brute_force(spark, model):
    rng = np.random.default_rng(17)
    templates = [t for ts in licenses.TEMPLATES.values() for t in ts]
    texts = [None, "", "\n \n\t\n", *CLEAN, *licenses.OTHER, prose(rng, 4000) + "\n" + templates[0] + "\n" + prose(rng, 4000)]
    for i in range(60):  # notices with lost and added words, one or two a text
        words = [w for t in rng.choice(templates, 1 + i % 2) for w in [*t.split(), "\n"] if rng.random() > 0.1 * (i % 4)]
        texts.append(prose(rng, 5) + ("\n" if i % 3 else " ") + "\n".join(textwrap.wrap(" ".join(words), 50)) + "\n\n" + str(rng.choice(licenses.OTHER)))
    rows = [(None if i == 9 else i, t, "en", "s", 0, "clash", "clash", "clash", "clash") for i, t in enumerate(texts)]
    rows += [rows[30], rows[30], rows[31]]
    got = licenses.scan_licenses(spark.createDataFrame(rows, SCHEMA).repartition(3), model)
    names = ("doc_id", "n_paragraphs", "n_licences", "families", "paragraph", "family", "template")
    assert Counter(tuple(r[n] for n in names) for r in got.collect()) == Counter((r[0], *brute(r[1], model)) for r in rows)


def test_recall_and_precision(model):
    """Every shape of every notice is found with its family; no clean text has a licence."""
    planted = [(family, s) for family, ts in licenses.TEMPLATES.items() for t in ts for s in shapes(t)]
    found = [family in brute(s, model)[2].split(",") for family, s in planted]
    assert np.mean(found) >= 0.97
    rng = np.random.default_rng(18)
    clean = [*CLEAN, *licenses.OTHER, *(prose(rng, 60) for _ in range(50))]
    assert not any(brute(t, model)[1] for t in clean)
