import pytest
from pyspark.sql import functions as F

from tests.orbits import SCHEMA, pair
from tessera.operators.components import component_table, key_components
from tessera.operators.pairing import eligibility, header, orbits, pair_rows
from tessera.operators.splits import shared_keys, subset_of_size
from tessera.plans.build import BuildConfig, build_dataset, probe


def source(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def reasons(spark, rows):
    got = eligibility(pair_rows(header(source(spark, rows)))).select("id", "fault", "reason").collect()
    return {r["id"]: r["fault"] or r["reason"] for r in got}


def test_reasons_come_in_order(spark):
    a = pair("a", aliases=["x"], missing_aliases=["y"])
    short = pair("b")
    short[1]["paragraphs"] = short[1]["paragraphs"][:19]
    twice = pair("c")
    twice[0]["paragraphs"] = [*twice[0]["paragraphs"][:19], dict(twice[0]["paragraphs"][18])]
    unused = pair("d")
    unused[0]["paragraphs"][5] = dict(unused[0]["paragraphs"][5], is_supporting=True)
    keeps = pair("e")
    keeps[1]["paragraphs"] = keeps[0]["paragraphs"]
    holds = pair("f")
    holds[1]["paragraphs"][7] = dict(holds[1]["paragraphs"][7], paragraph_text="bridgef meets goalf")
    third = [*pair("g"), pair("g")[0]]
    other = pair("h", question="Another?")
    got = reasons(spark, [*a, *short, *twice, *unused, *keeps, *holds, *third, *other])
    assert got == {"a": "eligible", "b": "not_20_paragraphs", "c": "invalid_slots", "d": "invalid_support", "e": "missing_keeps_all_support", "f": "missing_contains_every_subanswer", "g": "not_two_rows", "h": "question_differs"}


def test_components_join_ids_texts_and_answers(spark):
    rows = [*pair("a", aliases=["shared alias"]), *pair("b", aliases=["Shared   Alias"]), *pair("c", aliases=[""])]
    found = orbits(eligibility(pair_rows(header(source(spark, rows)))), "o_")
    sizes = [r["size"] for r in component_table(key_components(found, "orbit_id", "leakage_keys")).collect()]
    assert sorted(sizes) == [1, 2]
    assert found.where(F.exists("leakage_keys", lambda k: k == "answer:")).isEmpty()


def test_components_of_a_hub_and_a_chain(spark):
    rows = [(f"h{i}", ["hub"]) for i in range(300)] + [(f"c{i:03d}", [f"k{i}", f"k{i + 1}"]) for i in range(60)] + [("alone", [])]
    got = key_components(spark.createDataFrame(rows, "id string, keys array<string>"), "id", "keys")
    sizes = sorted(r["count"] for r in got.groupBy("label").count().collect())
    assert sizes == [1, 60, 300]
    assert got.where("id = 'c059'").first()["label"] == "c000"


def test_subset_of_size_is_exact_or_fails():
    sizes = [("a", 5), ("b", 3), ("c", 4), ("d", 9)]
    chosen = subset_of_size(sizes, 12, "seed", "train")
    assert sum(dict(sizes)[c] for c in chosen) == 12
    with pytest.raises(RuntimeError):
        subset_of_size([("a", 5), ("b", 9)], 12, "seed")


@pytest.fixture(scope="module")
def built(spark):
    rows = [r for i in range(8) for r in pair(f"p{chr(97 + i)}", aliases=["shared"] if i in (3, 5) else [])]
    return build_dataset(source(spark, rows), BuildConfig({"train": 3, "dev": 2, "shadow": 2}, seed="s"))


def test_build_keeps_every_rule(built):
    row = built.audits["invariants"].first().asDict()
    assert set(row.values()) == {7}
    assert shared_keys(built.orbits).isEmpty()
    assert built.reserve.count() == 1
    assert {r["split"]: r["count"] for r in built.records.groupBy("split").count().collect()} == {"train": 9, "dev": 6, "shadow": 6}


def test_distractors_change_two_slots_within_the_split(built):
    rows = {r["id"]: r for r in built.records.collect()}
    splits = {r["orbit_id"]: r["split"] for r in rows.values()}
    support = {p["paragraph_text"] for r in rows.values() if r["state"] == "C" for p in r["paragraphs"] if p["is_supporting"]}
    for r in rows.values():
        if r["state"] != "D":
            assert r["donors"] is None
            continue
        c = rows[r["orbit_id"] + "::C"]
        changed = [i for i in range(20) if r["paragraphs"][i] != c["paragraphs"][i]]
        assert changed == [d["target_slot"] for d in r["donors"]] and len(changed) == 2
        for d in r["donors"]:
            assert splits[d["source_orbit_id"]] == r["split"] and d["source_orbit_id"] != r["orbit_id"]
            new, old = (len(" ".join([x["paragraphs"][d["target_slot"]]["title"], x["paragraphs"][d["target_slot"]]["paragraph_text"]]).split()) for x in (r, c))
            assert abs(d["matching_diagnostics"]["length_ratio"] - max(new, old) / min(new, old)) < 1e-9
            assert d["matching_diagnostics"]["length_ratio"] <= 1.25 + 1e-12
            assert r["paragraphs"][d["target_slot"]]["paragraph_text"] not in support


def test_records_carry_targets_and_flags(built):
    for r in built.records.collect():
        line = r["messages"][1]["content"]
        assert line == ("U | evidence=[] | answer=INSUFFICIENT_EVIDENCE" if r["state"] == "M" else f"S | evidence=[P00,P01] | answer={r['answer']}")
        assert r["sealed"] == (r["split"] == "shadow") == (not r["training_read_allowed"])
        assert r["messages"][0]["content"].count("[P") == 21


def test_build_is_the_same_from_rows_in_any_order(spark, built):
    rows = [r for i in reversed(range(8)) for r in pair(f"p{chr(97 + i)}", aliases=["shared"] if i in (3, 5) else [])]
    again = build_dataset(source(spark, rows), BuildConfig({"train": 3, "dev": 2, "shadow": 2}, seed="s"))
    key = lambda b: sorted((r["id"], r["split"], str(r["donors"])) for r in b.records.collect())
    assert key(again) == key(built)


def test_probe_leaves_the_sealed_split_out(built):
    got = {r["pair"]: r for r in probe(built.records, "folds").collect()}
    assert set(got) == {"C-D", "D-M", "C-M"}
    assert all(r["positives"] == r["negatives"] == 5 for r in got.values())
