import json

import pytest

from tessera.functions.digest import canonical_sha
from tessera.plans.gates import Checks
from tessera.sources import control, jsonl
from tessera.streaming.predictions import error_counts, stream_predictions
from tests.orbits import pair


def test_jsonl_finds_every_fault(spark, tmp_path):
    good = [json.dumps(r | {"more": 1}) for r in pair("a")]
    bad = ['{"id": "x"', good[0].replace('"id": "a"', '"id": "a", "id": "b"'), json.dumps({k: v for k, v in pair("b")[0].items() if k != "answer"}), json.dumps(pair("c")[0] | {"answerable": "yes"}), "[1]", good[0].replace("1000", "NaN")]
    (tmp_path / "s.jsonl").write_text("\n".join([*good, "", *bad]) + "\n")
    rows = jsonl.read_jsonl(spark, str(tmp_path))
    assert rows.where("fault IS NULL").count() == 2 and rows.where("fault IS NOT NULL").count() == 6
    assert rows.where("fault IS NULL AND NOT answerable").first()["question_decomposition"][1]["paragraph_support_idx"] is None
    with pytest.raises(Exception, match="a source line is wrong"):
        jsonl.good_rows(rows).collect()
    jsonl.check_counts(rows.where("fault IS NULL"), rows=2, id=1)
    with pytest.raises(ValueError):
        jsonl.check_counts(rows.where("fault IS NULL"), rows=3)


def test_canonical_lines_are_sorted_and_compact(spark, tmp_path):
    rows = spark.createDataFrame([(2, "é/", 0.0001), (1, "a", 1.0)], "id int, b string, a double")
    jsonl.write_canonical(rows, str(tmp_path / "out"), ["id"])
    lines = [line for p in sorted((tmp_path / "out").glob("part-*")) for line in p.read_text().splitlines()]
    assert lines == ['{"a":1.0,"b":"a","id":1}', '{"a":0.0001,"b":"é/","id":2}']


def test_release_keeps_the_sealed_split_shut(spark, tmp_path):
    rows = spark.createDataFrame([("a", "train", False, True), ("b", "shadow", True, False)], "id string, split string, sealed boolean, training_read_allowed boolean")
    jsonl.write_release(rows, str(tmp_path / "r"))
    assert [r["id"] for r in jsonl.read_split(spark, str(tmp_path / "r"), "train").collect()] == ["a"]
    with pytest.raises(PermissionError):
        jsonl.read_split(spark, str(tmp_path / "r"), "shadow")


def test_control_documents(tmp_path):
    p = tmp_path / "m.json"
    control.write_once(p, {"b": 1, "a": "é"})
    assert control.read_object(p) == {"a": "é", "b": 1} and len(control.verify_sidecar(p)) == 64
    with pytest.raises(FileExistsError):
        control.write_once(p, {})
    p.write_text('{"a": 1}')
    with pytest.raises(ValueError):
        control.verify_sidecar(p)
    control.write_atomic(p, {"z": 1})
    assert control.read_object(p) == {"z": 1}
    (tmp_path / "link").symlink_to(p)
    with pytest.raises(OSError):
        control.read_stable(tmp_path / "link")
    with pytest.raises(PermissionError):
        control.open_path("/data/Shadow.sealed.jsonl")
    with pytest.raises(ValueError):
        control.separate_roots(tmp_path, tmp_path / "in")
    assert "m.json" in control.write_checksums(tmp_path).read_text()
    assert control.binding(tmp_path, {"m.json": "0" * 64, "none": "1"}) == {"m.json": False, "none": False}
    assert canonical_sha({"a": 1, "b": 2}) == canonical_sha({"b": 2, "a": 1})


def test_only_literal_truth_releases():
    checks = Checks()
    checks.add("a", True)
    assert checks.decision == "READY"
    checks.add("b", 1)
    assert checks.decision == "HOLD" and Checks().decision == "HOLD"


def test_streamed_predictions_are_parsed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id": "x", "prediction": "U | evidence=[] | answer=INSUFFICIENT_EVIDENCE"}\n{"id": "y", "prediction": "?"}\n')
    q = error_counts(stream_predictions(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("errors").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert {r["error"]: r["n"] for r in spark.table("errors").collect()} == {"none": 1, "grammar_mismatch": 1}
