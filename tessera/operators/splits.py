"""Exact-size splits of whole components, and the proof that they share no key."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.digest import joined_sha


def subset_of_size(sizes: Sequence[tuple[str, int]], target: int, *salt: str) -> list[str]:
    """Ids whose sizes add up to the target: components enter in digest order, each total remembers the first way to
    reach it, and the search ends with the component that reaches the target. Raises if no subset fits."""
    return first_subset(sorted(sizes, key=lambda c: (hashlib.sha256("\n".join([*salt, c[0]]).encode()).hexdigest(), c[0])), target, *salt)


class _Sums:
    """Totals that components reach, each with the first component that reached it.

    Totals are multiples of the sizes' common divisor. Of the longest run without a gap (`low` to `high`, in units of the
    divisor) no total can be new, so a component looks only at the totals below and above it: with sizes far smaller than
    the target these are few, and the whole search takes time in proportion to the target."""

    def __init__(self, target: int):
        self.target = target
        self.by = np.full(target + 1, -1, np.int32)  # number of the component, -1: not reached
        self.by[0] = -2
        self.sizes: list[int] = []
        self.names: list[str] = []
        self.unit = self.low = self.high = self.top = self.work = 0

    def _longest_run(self, has: np.ndarray) -> None:
        edges = np.flatnonzero(np.diff(np.concatenate([[False], has[: self.top + 1], [False]])))
        at = int(np.argmax(edges[1::2] - edges[::2]))
        self.low, self.high, self.work = int(edges[2 * at]), int(edges[2 * at + 1]), 0

    def add(self, name: str, size: int) -> None:
        if not 0 < size <= self.target:
            return
        if size % self.unit if self.unit else True:
            old = self.unit
            self.unit = math.gcd(old, size)
            self.top = self.top * old // self.unit
            self._longest_run(self.by[:: self.unit] != -1)
        by, step = self.by[:: self.unit], size // self.unit
        end = min(self.top + step, len(by) - 1) + 1
        new = []
        for lo, hi in ((step, min(self.low, end)), (max(self.high, step), end)):
            if lo < hi:
                new.append(lo + np.flatnonzero((by[lo - step : hi - step] != -1) & (by[lo:hi] == -1)))
                self.work += hi - lo
        if not any(map(len, new)):
            return
        for at in new:
            by[at] = len(self.names)
        self.names.append(name)
        self.sizes.append(size)
        self.top = max(self.top, *(int(at[-1]) for at in new if len(at)))
        gap = by[self.high : self.top + 1] == -1
        self.high = self.high + int(gap.argmax()) if gap.any() else self.top + 1
        while self.low and by[self.low - 1] != -1:
            self.low -= 1
        if self.work > 8 * (self.top + 1):
            self._longest_run(by != -1)

    def chosen(self) -> list[str]:
        found, total = [], self.target
        while total:
            one = int(self.by[total])
            found.append(self.names[one])
            total -= self.sizes[one]
        return found


def first_subset(order: Iterable[tuple[str, int]], target: int, *salt: str) -> list[str]:
    """The same of components that come in their order already; no more of them are read than it takes."""
    if target == 0:
        return []
    sums = _Sums(target)
    for name, size in order:
        sums.add(name, size)
        if sums.by[target] != -1:
            return sums.chosen()
    raise RuntimeError(f"no whole components add up to {target} for {salt[-1] if salt else 'the split'}")


def assign_splits(components: DataFrame, targets: dict[str, int], seed: str) -> DataFrame:
    """components (component_id, size) with the split of each chosen one; the pool shrinks from split to split.

    Components are sorted by digest on the executors and come to the driver one partition at a time, until the target
    is reached; the driver holds a way to each total and the chosen ids, both bounded by the targets."""
    chosen: dict[str, str] = {}
    for split, target in targets.items():
        keyed = components.select("component_id", "size").withColumn("k", joined_sha(seed, split, F.col("component_id")))
        coming = keyed.orderBy("k", "component_id").toLocalIterator()
        chosen |= dict.fromkeys(first_subset(((r[0], r[1]) for r in coming if r[0] not in chosen), target, seed, split), split)
    placed = components.sparkSession.createDataFrame(list(chosen.items()), "component_id string, split string")
    return components.join(placed, "component_id")


def shared_keys(rows: DataFrame, keys_col: str = "leakage_keys", split_col: str = "split") -> DataFrame:
    """Keys that occur in more than one split; a clean assignment has none."""
    return rows.select(split_col, F.explode(keys_col).alias("key")).groupBy("key").agg(F.array_sort(F.collect_set(split_col)).alias("splits")).where(F.size("splits") > 1)


def overlap_counts(rows: DataFrame, keys_col: str = "leakage_keys", split_col: str = "split") -> DataFrame:
    """(first, second, n) for each pair of splits that shares keys."""
    found = shared_keys(rows, keys_col, split_col)
    pairs = F.flatten(F.transform("splits", lambda a, i: F.transform(F.slice("splits", i + 2, F.size("splits")), lambda b: F.struct(a.alias("first"), b.alias("second")))))
    return found.select(F.explode(pairs).alias("p")).groupBy("p.first", "p.second").agg(F.count("*").alias("n"))


def reserve_ledger(eligible: DataFrame, selected: DataFrame, id_col: str = "orbit_id") -> DataFrame:
    """Eligible rows that no split took."""
    return eligible.join(selected.select(id_col), id_col, "left_anti")
