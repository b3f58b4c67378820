"""Histogram sort: exact byte counts below candidate key boundaries, refined until the splitters fit, one exchange."""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut
from tessera.operators.ranking import global_rank

BIAS = 1 << 63  # signed 64-bit values compare as unsigned ones after adding this
TOP = 1 << 192
HALVED = 8


@dataclass(frozen=True)
class Splitter:
    key: int  # rows whose key is below it lie to the left
    below: int  # their exact bytes
    rows: int  # and their number


def triple(key: int) -> tuple[int, int, int]:
    """The three signed 64-bit columns of a 192-bit key."""
    mask = (1 << 64) - 1
    return tuple(((key >> s) & mask) - BIAS for s in (128, 64, 0))


def _below(key: int) -> str:
    a, b, c = triple(key)
    a, b, c = ("(-9223372036854775807L - 1L)" if x == -BIAS else f"{x}L" for x in (a, b, c))
    if key & ((1 << 128) - 1) == 0:
        return f"k1 < {a}"
    return f"(k1 < {a} OR (k1 = {a} AND (k2 < {b} OR (k2 = {b} AND k3 < {c}))))"


def bucket_of(keys: list[int]) -> Column:
    """How many of the sorted keys are at or below a row's key: a balanced tree of comparisons inside codegen."""

    def tree(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"IF({_below(keys[mid])}, {tree(lo, mid)}, {tree(mid + 1, hi)})"

    return F.expr(tree(0, len(keys)))


def _probes(lo: Splitter, hi: Splitter, target: float, n: int, cuts: int = 2) -> set[int]:
    """Candidate keys strictly inside: around the linear guess, and the ends of `cuts` equal parts, so that the interval
    always shrinks by that factor."""
    width = hi.key - lo.key
    if width <= 1:
        return set()
    at = (target - lo.below) / max(1, hi.below - lo.below)
    found = {lo.key + width * i // cuts for i in range(1, cuts)}
    for i in range(n):
        f = min(1.0, max(0.0, at + (i - (n - 1) / 2) * 0.02))
        found.add(lo.key + (width * int(f * (1 << 60)) >> 60))
    return {k for k in found if lo.key < k < hi.key}


def find_splitters(rows: DataFrame, total: int, n_rows: int, n_shards: int, parts: int, tolerance: float, probes: int = 3) -> tuple[list[int], int]:
    """Keys that cut the rows into n_shards * parts slices of near equal bytes; every `parts`-th one is tight.

    Each round is one map-side combined count: at most a few rows per probe reach the driver, never rows of the
    table. A shard boundary is tight within `tolerance` of a shard's mean, a slice inside a shard within a
    quarter of a slice's. A boundary goes to the edge of a group of equal texts if that stays within tolerance.
    Rounds go on until no boundary is open: an interval halves in each, and after HALVED rounds, where the guess gains
    little since the keys lie in a group of equal texts, shrinks to an eighth. It raises if 192 bits did not do.
    """
    n = n_shards * parts
    targets = [total * j / n for j in range(1, n)]
    allowed = [tolerance * total / n_shards if j % parts == 0 else 0.25 * total / n for j in range(1, n)]
    known = {0: (0, 0), TOP: (total, n_rows)}
    known |= count_below(rows, [TOP * j // (4 * n) for j in range(1, 4 * n)])
    done = 0
    for done in range(193):
        ordered = sorted(known)
        want: set[int] = set()
        for t, most in zip(targets, allowed, strict=True):
            i = bisect_left(ordered, t, hi=len(ordered) - 1, key=lambda k: known[k][0])
            lo, hi = Splitter(ordered[max(0, i - 1)], *known[ordered[max(0, i - 1)]]), Splitter(ordered[i], *known[ordered[i]])
            if min(t - lo.below, hi.below - t) > most and hi.rows - lo.rows > 1:
                want |= _probes(lo, hi, t, probes, 2 if done < HALVED else 8)
        if not want:
            break
        known |= count_below(rows, sorted(want))
    else:
        raise RuntimeError("the shard boundaries did not settle")
    edges = set()
    best = []
    for t in targets:
        key = min(known, key=lambda k: (abs(known[k][0] - t), k))
        best.append(key)
        group = key >> 128
        edges |= {k for k in (group << 128, (group + 1) << 128) if 0 < k < TOP and k not in known}
    if edges:
        known |= count_below(rows, sorted(edges))
    for j, (t, most) in enumerate(zip(targets, allowed, strict=True)):
        group = best[j] >> 128
        near = [k for k in (group << 128, (group + 1) << 128) if k in known and abs(known[k][0] - t) <= most]
        if near:
            best[j] = min(near, key=lambda k: abs(known[k][0] - t))
    return sorted(best), done


def count_below(rows: DataFrame, keys: list[int]) -> dict[int, tuple[int, int]]:
    """Exact bytes and number of the rows below each key, from one aggregate over slices between neighbouring keys."""
    got = {r[0]: r[1:] for r in rows.groupBy(bucket_of(keys).alias("b")).agg(F.sum("size"), F.count("*")).collect()}
    out, size, n = {}, 0, 0
    for i, k in enumerate(keys):
        size, n = size + got.get(i, (0, 0))[0], n + got.get(i, (0, 0))[1]
        out[k] = (size, n)
    return out


def histogram_shards(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.002) -> DataFrame:
    """Shard and slot of every row, shards near equal in bytes (UTF-8 bytes of the text, plus 1).

    Rows are ordered by (hash of the text, id, a row number fixed in a written table), so equal texts are
    neighbours, a group of copies or one id may be cut anywhere, and no two rows tie. Only ids, sizes and
    checksums move, by ranges of the order within a shard, so a task's rows do not grow with a shard. Null text: size 1 and checksum 0; null id: kept,
    ordered first. Repeated rows are separate rows. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("k1"),
            F.coalesce(F.col(id_col).cast("long"), F.lit(-BIAS)).alias("k2"),
            F.monotonically_increasing_id().alias("k3"),
        ),
        "shards",
    )
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    keys, _ = find_splitters(rows, total, n, n_shards, 1, tolerance) if n else ([TOP - 1 - i for i in range(n_shards - 1)][::-1], 0)
    ranked = global_rank(rows.withColumn("shard", bucket_of(keys)), ["k1", "k2", "k3"], group="shard", name="slot")
    return ranked.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
