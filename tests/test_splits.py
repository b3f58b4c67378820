"""The exact subset sum against a table of every total, and its growth."""

import random
import time

import pytest

from tessera.operators.splits import first_subset


def plain(order, target):
    """Each total with the first component that reaches it, all totals looked at for each component."""
    way = {0: (0, "")}
    for name, size in order:
        if target in way:
            break
        for before in sorted((t for t in way if t + size <= target), reverse=True):
            way.setdefault(before + size, (before, name))
    if target not in way:
        return None
    chosen, total = [], target
    while total:
        total, name = way[total]
        chosen.append(name)
    return chosen


@pytest.mark.parametrize("sizes", [(1, 2, 3, 9), (2, 4, 8, 16), (6, 9, 15, 10), (1, 60), (3, 3, 3, 3, 100, 1), tuple(range(1, 200))])
def test_the_same_components_are_chosen(sizes):
    draw = random.Random(7)
    for _ in range(200):
        order = [(f"c{i}", draw.choice(sizes)) for i in range(draw.randint(0, 40))]
        target = draw.randint(0, 250)
        want = plain(order, target)
        if want is None:
            with pytest.raises(RuntimeError):
                first_subset(iter(order), target)
        else:
            assert first_subset(iter(order), target) == want


def test_many_components_take_time_in_proportion():
    draw = random.Random(3)
    order = [(f"c{i}", draw.randint(1, 30)) for i in range(60_000)]
    size, target = dict(order), sum(n for _, n in order) // 2
    began = time.perf_counter()
    chosen = first_subset(iter(order), target)
    assert sum(size[c] for c in chosen) == target and len(set(chosen)) == len(chosen)
    assert time.perf_counter() - began < 30
