"""The pipeline's stages, one after the other, against brute force on what the stage before kept."""

from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline
from tests.llm.test_copies import brute_keep
from tests.llm.test_operators import brute_contamination, brute_words
from tests.llm.test_passages import brute_passages

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
def test_every_stage(spark, tmp_path):
    from tessera.llm import quality
    from tessera.llm.common import table

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = docs.columns
    kept = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(DATA))
        out.write.parquet(str(tmp_path / name))
        docs = kept[name] = spark.read.parquet(str(tmp_path / name))
    rows = {k: [(r["doc_id"], r["text"]) for r in df.collect()] for k, df in kept.items() if k != "pieces"}
    assert all(kept[k].columns == names for k in rows)

    model = quality.contract_model(kept["documents"], table(spark, str(DATA), "labels"))
    good = {r["doc_id"] for r in quality.score_quality(kept["documents"], model).where(f"score >= {quality.THRESHOLD}").collect()}
    assert Counter(rows["quality"]) == Counter(x for x in rows["documents"] if x[0] in good)

    least = brute_keep(rows["quality"])  # five-word shingles, Jaccard 0.8
    assert Counter(rows["near_duplicates"]) == Counter(x for x in rows["quality"] if x[0] in least)

    of = brute_passages(rows["near_duplicates"])  # 50 words or more
    before = dict(rows["near_duplicates"])
    assert {i for i, _ in rows["repeats"]} == set(before)
    for i, t in rows["repeats"]:
        gone, _, left = of(before[i])
        assert brute_words(t) == left and (gone or t == before[i])

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    hit = brute_contamination(items)
    assert Counter(rows["benchmark"]) == Counter((i, t) for i, t in rows["repeats"] if not hit(i, t)[4])

    ids = {r["doc_id"]: r for r in kept["pieces"].collect()}
    assert set(ids) == {i for i, _ in rows["benchmark"]} and all(r["exact"] for r in ids.values())
