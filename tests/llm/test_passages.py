"""Passages of 50 words: what is left against brute force, and recall of planted ones of 51 words and more."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import suffixes
from tests.llm.test_operators import SCHEMA, brute_repeats, brute_words, prose

WORDS = suffixes.PASSAGES.match


def brute_passages(rows):
    """(words in repeated passages, passages) of a text, given all (id, text)."""
    count = Counter()
    for _, t in rows:
        w = brute_words(t)
        count.update(tuple(w[k : k + WORDS]) for k in range(len(w) - WORDS + 1))

    def of(t):
        w = brute_words(t)
        gone = np.zeros(len(w) + 1, bool)
        for k in range(len(w) - WORDS + 1):
            if count[tuple(w[k : k + WORDS])] > 1:
                gone[k : k + WORDS] = True
        return int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), [x for x, g in zip(w, gone, strict=False) if not g]

    return of


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(12)
    short = [" ".join(f"{'abcdefgh'[i % 8]}{int(x)}" for i, x in enumerate(rng.integers(0, 99, n))) for n in (51, 55, 60, 75)]
    texts = [None, "", " ... ", "one", "w " * 49, "w " * 51, prose(rng, 49), "Ünï " * 60, prose(rng, 3000)]
    for k in range(24):  # each passage in six documents, some in capitals or on lines of their own
        passage = short[k % 4]
        passage = (passage.upper(), passage.replace(" ", ", "), passage.replace(" ", "\n"), passage)[k // 4 % 4]
        texts.append(prose(rng, int(rng.integers(5, 300)), 100_000) + " " + passage + ". " + prose(rng, int(rng.integers(0, 300)), 100_000))
    texts += [prose(rng, 200, 100_000) for _ in range(20)]
    rows = [(i, t, "en", "s", len(t or ""), "clash", "clash", "clash", "clash") for i, t in enumerate(texts)]
    rows += [rows[-1], rows[-1], (None, *rows[3][1:]), (None, *rows[3][1:])]
    return spark.createDataFrame(rows, SCHEMA).repartition(4), [r[:2] for r in rows], range(9, 33), range(33, 52)


@pytest.mark.parametrize("hot", [4000, 1])
def test_report_equals_brute_force(planted, hot, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT_BLOCKS", hot)
    monkeypatch.setattr(suffixes, "MERGE_BYTES", 20_000)
    docs, rows, hit, clean = planted
    of, exact = brute_passages(rows), brute_repeats(rows)
    want = Counter((i, *exact(i, t), *of(t)[:2], tuple(of(t)[2])) for i, t in rows)
    got = suffixes.repeat_report(docs).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], r["n_passage_words"], r["n_passages"], tuple(brute_words(r["text"]))) for r in got) == want
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["n_passages"] for i in hit) and not any(by[i]["n_passages"] for i in clean)


def test_every_row_stays_with_its_columns(planted):
    docs, rows, hit, clean = planted
    out = suffixes.without_repeats(docs, rule=suffixes.PASSAGES)
    assert out.columns == docs.columns
    got = out.collect()
    before = dict(rows)
    assert len(got) == len(rows)
    assert all(r["text"] == before[r["doc_id"]] for r in got if r["doc_id"] in clean)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert suffixes.without_repeats(docs.limit(0), rule=suffixes.PASSAGES).count() == 0


def test_many_equal_rows_take_linear_work(spark):
    rng = np.random.default_rng(3)
    text = prose(rng, 400)
    df = spark.createDataFrame([(i % 5, text) for i in range(3000)] + [(9, prose(rng, 400, 100_000))], "doc_id long, text string").repartition(4)
    got = suffixes.remove_repeats(df).collect()
    n = len(text.encode())
    empty = hashlib.sha256(b"").hexdigest()
    assert Counter(tuple(r)[1:] for r in got if r["doc_id"] != 9) == Counter({(n, n, 1, empty): 3000})
    assert [r["n_removed"] for r in got if r["doc_id"] == 9] == [0]
