"""Texts that repeat a line or a pair of words again and again: one row a chain of equal blocks, results as brute force."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import suffixes
from tests.llm.test_operators import brute_repeats, brute_words, prose
from tests.llm.test_passages import brute_passages


def lines():
    rng = np.random.default_rng(31)
    made = [f"{prose(rng, 30, 10**6)} {(prose(rng, n, 10**6) + chr(10)) * k}{prose(rng, 20, 10**6)}" for n, k in ((2, 300), (7, 90), (40, 12), (49, 6), (50, 6), (51, 6), (60, 5), (101, 3))]
    pair = [prose(rng, 30 + i, 10**6) + " to be" * 400 + " " + prose(rng, 12, 10**6) for i in range(6)]
    return [*made, *pair, "ab" * 1000, "x" * 401, "xyz" * 133 + "x", prose(rng, 400, 10**6)]


@pytest.mark.parametrize("hot", [4000, 1])
def test_repeated_lines_equal_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT_BLOCKS", hot)
    rows = list(enumerate(lines()))
    of, exact = brute_passages(rows), brute_repeats(rows)
    got = suffixes.repeat_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = Counter((i, *exact(i, t), *of(t)[:2], tuple(of(t)[2])) for i, t in rows)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], r["n_passage_words"], r["n_passages"], tuple(brute_words(r["text"]))) for r in got) == want


def test_a_chain_is_one_row():
    batch = pa.record_batch({"row": [1], "tag": [0], "text": ["to be " * 5000]})
    for rule in (suffixes.PASSAGES, suffixes.BYTES):
        assert sum(len(b) for b in suffixes._find(rule)([batch])) < 20
