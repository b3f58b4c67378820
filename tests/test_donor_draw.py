"""The positions of a slot are drawn once, not once for each of them, and equal plain arithmetic."""

import hashlib
import math

from pyspark.sql import functions as F

from tessera.operators import donors


def plain(count, bounds, salt):
    low = max(1, math.ceil(count / 1.25))
    high = max(low, math.floor(count * 1.25))
    below = lambda n: max([u for c, _, u in bounds if c < n], default=0)
    left, right = below(low), below(high + 1)
    if right <= left:
        return []
    width, center = right - left, max(left, min(right, below(count)))
    value = int(hashlib.sha256(salt.encode()).hexdigest(), 16)
    start, want = value % width, max(1, value // width % width)
    stride = next((s for s in range(want, max(want, min(want + 64, width - 1)) + 1) if math.gcd(s, width) == 1), 1)
    near = [p for p in range(center - donors.NEAR, center + donors.NEAR) if left <= p < right]
    return sorted({*near, *(left + (start + k * stride) % width for k in range(min(donors.DRAWN, width)))})


def test_positions_are_drawn_once(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(donors, "stride_draw", lambda salt, width, real=donors.stride_draw: calls.append(real(salt, width)) or calls[-1])
    rows = [(i, 5 + i % 40, [(c, 0, (c - 3) * (i + 1)) for c in range(4, 50, 1 + i % 5)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, count int, bounds array<struct<count:int,below:long,upto:long>>")
    found = donors.candidate_positions(F.col("count"), F.col("bounds"), 1.25, F.concat(F.lit("s"), F.col("id").cast("string")))
    got = {r["id"]: r["p"] for r in df.select("id", found.alias("p")).collect()}
    assert got == {i: plain(n, b, f"s{i}") for i, n, b in rows}
    plan = df.select(found.alias("p"))._jdf.queryExecution().analyzed().toString()
    assert len(calls) == 1 and plan.count("sha2") <= 2
