"""Shard boundaries inside groups of equal texts, with counts from a sorted list instead of a table."""

from bisect import bisect_left

import numpy as np
import pytest

from tessera.llm import sharding


@pytest.mark.parametrize("share", [0.01, 0.03])
@pytest.mark.parametrize("place", [0.25, 0.5])
def test_boundaries_inside_a_group_of_equal_texts_settle(monkeypatch, share, place):
    rng = np.random.default_rng(4)
    n, shards = 20_000, 16
    group = int(n * share)
    before = n // 2 - int(group * place)
    hot = 1 << 63
    k1 = [int(x) >> 1 for x in rng.integers(0, 1 << 63, before)] + [hot] * group + [hot + 1 + int(x) for x in rng.integers(0, (1 << 63) - 2, n - before - group)]
    k2 = (1 << 63) + rng.permutation(1 << 20)[:n].astype(object)
    keys = sorted((a << 128) + (int(b) << 64) + i for i, (a, b) in enumerate(zip(k1, k2, strict=True)))
    monkeypatch.setattr(sharding, "count_below", lambda rows, want: {k: (1000 * bisect_left(keys, k),) + (bisect_left(keys, k),) for k in want})
    got, _ = sharding.find_splitters(None, 1000 * n, n, shards, 4, 0.002)
    mean = n / shards
    off = [abs(bisect_left(keys, got[4 * j - 1]) - mean * j) for j in range(1, shards)]
    assert max(off) <= max(1, 0.002 * mean)
