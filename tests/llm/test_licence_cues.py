"""What the licence scan leaves out before it makes n-grams, and texts of many blocks."""

import re
import textwrap
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import licenses
from tests.llm.test_licences import brute, shapes
from tests.llm.test_operators import SCHEMA

NAMES = ("doc_id", "n_paragraphs", "n_licences", "families", "paragraph", "family", "template")


@pytest.fixture(scope="module")
def model():
    return licenses.train()


def scanned(spark, texts, model):
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "clash", "clash", "clash", "clash") for i, t in enumerate(texts)], SCHEMA)
    return Counter(tuple(r[n] for n in NAMES) for r in licenses.scan_licenses(docs, model).collect())


def test_everyday_words_are_no_cue(spark):
    plain = "The only general version of a possible source, later published in print, was available with products, subjects and conditions, included with rights of the underground."
    notice = "released  UNDER\n * the MIT-Licence."
    rows = spark.createDataFrame([(plain,), (notice,), ("",)], "t string").select(licenses._cue(F.col("t")).alias("cue")).collect()
    assert [r["cue"] for r in rows] == [False, True, False]


def test_every_confirmed_paragraph_has_a_cue():
    """By number: what a template has beside the cues never reaches the share. By text: any words of it that reach it."""
    rng, cues = np.random.default_rng(19), set(licenses.cue_grams())
    for template in (t for ts in licenses.TEMPLATES.values() for t in ts):
        held = set(licenses.grams(template))
        assert len(held - cues) / len(held) < licenses.CONFIRM
        for text in shapes(template):
            for lost in np.arange(8) / 20:
                words = [w for w in re.findall(r"\S+|\s+", text) if w.isspace() or rng.random() >= lost]
                part = "".join(words).replace(" ", str(rng.choice([" ", " ", " é", "_"])))
                if len(held & set(licenses.grams(part))) / len(held) >= licenses.CONFIRM:
                    assert re.search(licenses.cue_pattern(), " " + part.lower())


def test_blank_lines_of_any_kind_part_blocks(spark, model):
    mit, bsd = (textwrap.fill(licenses.TEMPLATES[k][i], 60) for k, i in (("mit", 5), ("bsd", 4)))
    texts = [(mit + "\n\n" + bsd + "\n").replace("\n", "\r\n"), "\n \t\n\x0b\n" + mit + "\n\f\n\n \n" + bsd + "\n ", "x\r\r \r" + mit + "\n \n" + bsd, "\n\n" + mit + "\n\n\n"]
    assert scanned(spark, texts, model) == Counter((i, *brute(t, model)) for i, t in enumerate(texts))


def test_a_text_of_many_blocks(spark, model):
    """Blocks that a line of them confirms already count once; 4,000 of them are no pairs of blocks and lines."""
    part = "Released under the MIT License.\nThis project is licensed\nunder the terms of the MIT license.\n\n"
    wrapped = textwrap.fill(licenses.TEMPLATES["bsd"][4], 60) + "\n\n"
    few, many = (part + wrapped) * 3, (part + wrapped) * 2000
    small = brute(few, model)
    lines = wrapped.count("\n") - 1
    want = (2000 * (3 + lines), small[1] // 3 * 2000, *small[2:])
    assert small[:2] == (3 * (3 + lines), small[1] // 3 * 3)
    assert scanned(spark, [few, many], model) == Counter({(0, *small): 1, (1, *want): 1})
