"""Notices that are wrapped over lines."""

import textwrap

from tessera.llm import licenses
from tests.llm.test_operators import SCHEMA, by_id


def test_wrapped_notices_are_found(spark):
    wrapped = lambda family, k: textwrap.fill(licenses.TEMPLATES[family][k], 78)
    texts = {
        1: "Some words first.\n \n\n" + wrapped("mit", 3) + "\n\nTail.",
        2: wrapped("bsd", 3) + "\n" + wrapped("bsd", 4),
        3: "\n".join("# " + x for x in wrapped("apache", 2).split("\n")),
        4: "Tail.\nReleased under the MIT License.\nMore.",
        5: "She works for the public library\nand reads the general news.",
    }
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), "clash", "clash", "clash", "clash") for i, t in texts.items()], SCHEMA)
    got = by_id(licenses.scan_licenses(docs, licenses.train()), "n_licences", "families", "paragraph")
    assert got[1] == [(1, "mit", 3)]
    assert [x[1] for x in got[2]] == ["bsd"]
    assert got[3][0][1:] == ("apache", 0)
    assert got[4] == [(1, "mit", 1)] and got[5] == [(0, "", None)]
