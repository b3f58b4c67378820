"""Near copies of the pipeline against brute force over all pairs."""

import re

import numpy as np
import pytest

from tessera.llm import copies, simhash
from tests.llm.test_operators import LOW, SCHEMA, prose


def brute_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set())


def brute_keep(rows):
    """The ids that stay: the least of each component of links with Jaccard >= 0.8."""
    sets, label = [brute_set(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    return {min(rows[k][0] for k in range(len(rows)) if label[k] == x) for x in set(label)}


@pytest.mark.parametrize("frequent", [1, copies.FREQUENT])
def test_near_copies_equal_brute_force(spark, frequent, monkeypatch):
    monkeypatch.setattr(copies, "FREQUENT", frequent)
    monkeypatch.setattr(copies, "SAMPLED", 1)
    rng = np.random.default_rng(9)
    texts = [None, "", " \n", "one", "One", "two words", "a b c d e", "a b c d f"]
    common = prose(rng, 60)
    for _ in range(6):
        base = prose(rng, int(rng.integers(40, 200))).split()
        texts.append(" ".join(base))
        for changes in (1, 1, 2, 2, 3, 3, 4, 4, 6, 8):
            words = list(base)
            for at in rng.integers(0, len(words), changes):
                words[at] = f"new{rng.integers(1e6)}"
            texts.append(" ".join(words))
        texts += [" ".join(base), " ".join(base).upper(), common + " " + prose(rng, 30)]
    rows = [(i, t, "en", "s", len(t or ""), "clash", "clash", "clash", "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute_keep([(i, t) for i, t, *_ in rows])
    got = [r["doc_id"] for r in copies.keep_one(docs).collect()]
    assert sorted(got) == sorted(want)
    assert set(got) != {r["doc_id"] for r in simhash.keep_one(docs).collect()}


def test_no_rows(spark):
    assert copies.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0


def test_simhash_links_are_candidates(spark, monkeypatch):
    """The stage looks for near copies by SimHash first; its links are those of brute force over the fingerprints."""
    seen = []
    monkeypatch.setattr(copies, "marked", lambda nodes, real=copies.marked: seen.append((nodes, real(nodes))) or seen[-1][1])
    rng = np.random.default_rng(4)
    base = prose(rng, 400).split()
    texts = [" ".join(base), " ".join([*base, "tail"]), " ".join(["head", *base]), prose(rng, 300), prose(rng, 200), ""]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), "clash", "clash", "clash", "clash") for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r["doc_id"] for r in copies.keep_one(docs).collect()) == [0, 3, 4, 5]
    (nodes, links), = seen
    sim = {r["fp"]: r["sim"] for r in nodes.collect()}
    near = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= simhash.MOST
    want = {(a, b) for a in sim for b in sim if a < b and near(sim[a], sim[b])}
    got = {(r["a"], r["b"]) for r in links.collect()}
    assert want and got <= want
    label = {a: a for a in sim}
    for a, b in sorted(got) * len(sim):
        label[a] = label[b] = min(label[a], label[b])
    assert all(label[a] == label[b] for a, b in want)
