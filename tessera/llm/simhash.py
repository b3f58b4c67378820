"""SimHash near-duplicates: one-wildcard variants of two halves, an equality join, and components of verified links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import batch_rows, chunks, cut, drop, lean, others, ranges, restored, words
from tessera.operators.components import components

SHINGLE, BITS, MOST = 3, 64, 3
#: Fingerprints of one signature that one task compares; larger groups are dealt out as pairs of blocks.
BLOCK = 20_000
EXACT = 32

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32

P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
SEED = 42


def _left(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint64(k)) | (x >> np.uint64(64 - k))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _left(acc + lane * P2, 31) * P1


def xxh64(buf: np.ndarray, start: np.ndarray, size: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of the slices buf[s : s + size], all at once; buf has 8 spare bytes at its end."""
    lanes = np.ndarray((len(buf) - 7,), "<u8", buf.data, 0, (1,))
    ints = np.ndarray((len(buf) - 3,), "<u4", buf.data, 0, (1,))
    at, left = start.copy(), size
    with np.errstate(over="ignore"):
        s = np.uint64(seed)
        if size >= 32:
            acc = [np.full(len(start), v, np.uint64) for v in (s + P1 + P2, s + P2, s, s - P1)]
            while left >= 32:
                for i in range(4):
                    acc[i] = _round(acc[i], lanes[at + 8 * i])
                at, left = at + 32, left - 32
            h = _left(acc[0], 1) + _left(acc[1], 7) + _left(acc[2], 12) + _left(acc[3], 18)
            for a in acc:
                h = (h ^ _round(np.zeros_like(a), a)) * P1 + P4
        else:
            h = np.full(len(start), s + P5, np.uint64)
        h = h + np.uint64(size)
        while left >= 8:
            h = _left(h ^ _round(np.zeros_like(h), lanes[at]), 27) * P1 + P4
            at, left = at + 8, left - 8
        if left >= 4:
            h = _left(h ^ (ints[at].astype(np.uint64) * P1), 23) * P2 + P3
            at, left = at + 4, left - 4
        for _ in range(left):
            h = _left(h ^ (buf[at].astype(np.uint64) * P5), 11) * P1
            at = at + 1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


#: The eight bits of a byte, as the eight bytes of a number.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def bit_counts(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many values of each group (sizes, none 0) have each of the 64 bits: byte-wide sums over up to 255 values."""
    pieces = -(-sizes // 255)
    group = np.repeat(np.arange(len(sizes)), pieces)
    inner = np.arange(len(group)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = (np.cumsum(sizes) - sizes)[group] + 255 * inner
    lanes = h.view(np.uint8).reshape(-1, 8)
    out = np.empty((len(sizes), 64), np.int64)
    begin = np.cumsum(pieces) - pieces
    for k in range(8):
        part = np.add.reduceat(SPREAD[lanes[:, k]], start).view(np.uint8).reshape(-1, 8)
        out[:, 8 * k : 8 * k + 8] = np.add.reduceat(part, begin, axis=0, dtype=np.int64)
    return out


def hash_slices(buf: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """XXH64 of slices of any lengths; buf has 8 spare bytes at its end."""
    h = np.empty(len(begin), np.uint64)
    by = np.argsort(np.minimum(length, 60_000).astype(np.uint16), kind="stable")
    edges = np.flatnonzero(np.append(True, np.diff(length[by]) != 0)) if len(by) else []
    for lo, hi in zip(edges, np.append(edges[1:], len(by)), strict=True):
        at = by[lo:hi]
        one = int(length[at[0]])
        if one <= 256 or len(at) >= 1000:
            h[at] = xxh64(buf, begin[at], one)
        else:
            h[at] = [xxhash.xxh64_intdigest(buf[b : b + one].tobytes(), SEED) for b in begin[at]]
    return h


def shingles(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, their number by text): XXH64 of each run of `width` words, lowered and one space apart; a text of fewer
    words is one run, one without words has none."""
    n = len(off) - 1
    start, end, doc = words(~SPACE[data], off)
    if not len(start):
        return np.empty(0, np.uint64), np.zeros(n, np.int64)
    size = end - start
    to = np.cumsum(size + 1) - (size + 1)
    buf = np.full(int(to[-1] + size[-1] + 8), 32, np.uint8)
    buf[ranges(to, size)] = LOWERED[data[ranges(start, size)]]
    count = np.bincount(doc, minlength=n)
    first = np.cumsum(count) - count
    over = width - 1
    full = np.flatnonzero(doc[: len(doc) - over] == doc[over:]) if len(doc) > over else np.empty(0, np.int64)
    few = np.flatnonzero((count > 0) & (count < width))
    head = np.concatenate([full, first[few]])
    tail = np.concatenate([full + over, first[few] + count[few] - 1])
    order = np.argsort(doc[head], kind="stable")
    head, tail = head[order], tail[order]
    return hash_slices(buf, to[head], to[tail] + size[tail] - to[head]), np.bincount(doc[head], minlength=n)


def fingerprints(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The 64-bit fingerprint of each text; a text without words has 0."""
    out = np.zeros(len(off) - 1, np.uint64)
    h, count = shingles(data, off, SHINGLE)
    has = np.flatnonzero(count)
    if len(has):
        ones = bit_counts(h, count[has])
        out[has] = np.packbits(2 * ones > count[has][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part, data, off in chunks(batch, "text"):
                yield pa.record_batch({"id": part.column("id"), "fp": pa.array(fingerprints(data, off).view(np.int64))})

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(run), f"id {kind}, fp long")


def signatures(prints: DataFrame) -> DataFrame:
    """(sig, fp): each half as it is, and with each of its 32 bits as a wildcard. Of two fingerprints with at most 3
    differing bits one half differs in at most 1, so the two share a signature."""
    made = []
    for seg in range(2):
        half = F.expr("fp & 4294967295") if seg == 0 else F.expr("shiftrightunsigned(fp, 32)")
        made.append(half + F.lit((seg << 38) | (EXACT << 32)))
        made += [half.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << p))) + F.lit((seg << 38) | (p << 32)) for p in range(32)]
    return prints.select("fp", F.explode(F.array(*made)).alias("sig"))


def _within(x: np.ndarray, y: np.uint64) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= MOST


def links(members: np.ndarray, side: np.ndarray | None) -> list[tuple[int, int]]:
    """A spanning forest of the links among fingerprints of one signature, each found by comparing a newly reached one
    with all not yet reached. side: the wildcard bit; with it, only links across the two sides are looked for, since
    fingerprints that agree in the bit share the exact half too."""
    if side is None:
        pools = [members, members[:0]]
    else:
        pools = [members[~side], members[side]]
    found: list[tuple[int, int]] = []
    for own in range(1 if side is None else 2):
        while len(pools[own]):
            seed, pools[own] = pools[own][0], pools[own][1:]
            queue = [(seed, own)]
            while queue:
                one, at = queue.pop()
                other = at if side is None else 1 - at
                near = _within(pools[other], one)
                if near.any():
                    hit = pools[other][near]
                    pools[other] = pools[other][~near]
                    found += [(int(one.view(np.int64)), int(x)) for x in hit.view(np.int64)]
                    queue += [(x, other) for x in hit]
    return found


def _pairs(batches):
    """Edges of every signature of a sorted stream; only an unfinished signature is carried on."""
    carry = None
    blank = pa.record_batch({k: pa.array([], pa.int64()) for k in ("sig", "part", "fp")})
    for batch in _closed(batches, blank):
        sig, part, fp = (batch.column(k).to_numpy() for k in ("sig", "part", "fp"))
        if carry is not None:
            sig, part, fp = (np.concatenate([a, b]) for a, b in zip(carry, (sig, part, fp), strict=True))
        new = np.flatnonzero(np.append(True, (sig[1:] != sig[:-1]) | (part[1:] != part[:-1]))) if len(sig) else np.empty(0, np.int64)
        last = batch is blank
        stop = len(sig) if last or not len(new) else int(new[-1])
        carry = None if last else (sig[stop:], part[stop:], fp[stop:])
        size = np.diff(np.append(new, len(sig)))
        new, size = new[new < stop], size[new < stop]
        wild = (sig[new] >> 32) & 63
        place = np.where(wild == EXACT, 0, wild + 32 * (sig[new] >> 38))
        out = []
        two = np.flatnonzero(size == 2)
        a, b = fp[new[two]].view(np.uint64), fp[new[two] + 1].view(np.uint64)
        apart = ((a ^ b) >> place[two].astype(np.uint64)) & np.uint64(1)
        good = (np.bitwise_count(a ^ b) <= MOST) & ((wild[two] == EXACT) | (apart == 1))
        out.append(np.column_stack([a[good].view(np.int64), b[good].view(np.int64)]))
        bit = (fp[:stop] >> np.repeat(place, size)) & 1
        high = np.add.reduceat(bit, new) if len(new) else new
        for g in np.flatnonzero((size > 2) & ((wild == EXACT) | (high > 0) & (high < size))):
            s = slice(new[g], new[g] + size[g])
            got = links(fp[s].view(np.uint64), None if wild[g] == EXACT else bit[s] == 1)
            if got:
                out.append(np.array(got, np.int64))
        edges = np.concatenate(out)
        yield pa.record_batch({"a": pa.array(edges[:, 0].copy()), "b": pa.array(edges[:, 1].copy())})


def _closed(batches, blank):
    yield from batches
    yield blank


def link_edges(prints: DataFrame) -> DataFrame:
    """Edges (a, b) whose components are those of all links among distinct fingerprints (column fp).

    Signatures with more than BLOCK fingerprints are cut into blocks, and each pair of blocks is a group of its own,
    so that no task holds more than 2 * BLOCK of one signature; all links are still looked for.
    """
    sigs = signatures(prints)
    hot = cut(sigs.groupBy("sig").count().where(F.col("count") > BLOCK).select("sig", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "hot")
    if hot.isEmpty():
        rows = sigs.select("sig", F.lit(0).cast("long").alias("part"), "fp")
    else:
        k = F.pmod(F.xxhash64("fp"), F.col("blocks"))
        dealt = sigs.join(hot, "sig", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("k", k)
        dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = dealt.select("sig", (F.least("k", "j") * F.col("blocks") + F.greatest("k", "j")).cast("long").alias("part"), "fp")
    kept = rows.repartition("sig", "part").sortWithinPartitions("sig", "part", "fp")
    return kept.mapInArrow(lean(_pairs), "a long, b long")


def classes(prints: DataFrame, least) -> DataFrame:
    """(fp, one) for every fingerprint: `least` (an aggregate of prints) over its component."""
    with batch_rows(prints.sparkSession, 50_000):
        nodes = cut(prints.groupBy("fp").agg(least.alias("rep")), "nodes")
        edges = cut(link_edges(nodes.select("fp")), "links")
    labels = components(edges)
    drop(edges)
    named = nodes.join(labels, nodes["fp"] == labels["node"], "left").select("fp", "rep", F.coalesce("label", "fp").alias("label"))
    return named.join(named.groupBy("label").agg(F.min("rep").alias("one")), "label").select("fp", "one")


def keep_least(docs: DataFrame, rows: DataFrame, prints: DataFrame, found: DataFrame, text_col: str) -> DataFrame:
    """The rows of docs whose key is the chosen one (column one of found) of a group, each key once."""
    chosen = found.select(F.col("one").alias("key")).distinct()
    copies = prints.groupBy(F.col("id").alias("key")).agg(F.count("*").alias("n"))
    chosen = cut(chosen.join(copies, "key").select("key.id", "key.hash", "n"), "chosen")
    near = (rows["key.id"].eqNullSafe(chosen["id"])) & (rows["key.hash"] == chosen["hash"])
    kept = rows.join(chosen, near).select("doc", "text", "id", "hash", "n")
    if chosen.where("n > 1").isEmpty():
        return restored(kept, docs, text_col)
    repeated = kept.where("n > 1").groupBy("id", "hash").agg(F.first(F.struct("doc", "text")).alias("r")).select("r.*")
    return restored(kept.where("n = 1").select("doc", "text").unionByName(repeated), docs, text_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every component, that of the smallest id (of one id, the smallest hash of a text), as it was."""
    rows = docs.select(others(docs, text_col).alias("doc"), F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash")).alias("key"), F.col(text_col).alias("text"))
    prints = cut(fingerprint_documents(rows, "key"), "fingerprints")
    return keep_least(docs, rows, prints, classes(prints, F.min("id")), text_col)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp and component_id (the smallest id reachable by links of at most 3 differing bits) of every row.

    Texts are whole; null and blank ones have fingerprint 0, which links like any other. Rows of equal fingerprint
    are one node, so groups of copies cost one row after a map-side combine. Null ids are kept; a component of
    null ids only has a null component_id. An empty table gives an empty result.
    """
    prints = cut(fingerprint_documents(docs, id_col, text_col), "fingerprints")
    found = cut(classes(prints, F.min("id")), "classes")
    return prints.join(found, "fp").select(F.col("id").alias(id_col), "fp", F.col("one").alias("component_id"))


def hex_print(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
