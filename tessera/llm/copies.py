"""Near copies: SimHash links and stars of rare shingles, each checked by exact set similarity, then the pairs left open."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import batch_rows, chunks, crc_mod, cut, drop, lean, others
from tessera.llm.simhash import bit_counts, keep_least, link_edges, shingles
from tessera.operators.components import components

#: Words of a shingle, and the least Jaccard similarity of two sets of shingles as a fraction.
WIDTH, NUM, DEN = 5, 4, 5
#: One document in so many is read to learn which shingles are frequent, and so many of these are kept. Both decide
#: only the order in which shingles are tried, never a result.
SAMPLED, FREQUENT = 16, 1 << 18


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, their number by text): the distinct shingles of each text, sorted."""
    h, count = shingles(data, off, width)
    doc = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])) if len(h) else np.empty(0, bool)
    return h[new], np.bincount(doc[new], minlength=len(count))


def _frequent(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingles, counts) of the most frequent ones of a sample."""

    def run(batches):
        for batch in batches:
            for _, data, off in chunks(batch, "text"):
                yield pa.record_batch({"s": pa.array(shingle_sets(data, off, width)[0].view(np.int64))})

    seen = rows.where(crc_mod("key.hash", SAMPLED) == 0).select("text").mapInArrow(lean(run), "s long").groupBy("s").count()
    top = seen.where("count > 1").orderBy(F.desc("count"), "s").limit(FREQUENT).toArrow()
    s, n = (top.column(c).to_numpy() for c in ("s", "count"))
    order = np.argsort(s.view(np.uint64))
    return s.view(np.uint64)[order], n[order]


def _prints(rows: DataFrame, width: int) -> DataFrame:
    """(id, fp, n, head, sim): fp stands for the set of shingles, n is its size, head are its rarest ones, of which two sets
    that are similar enough share at least one; sim is the SimHash fingerprint of the set."""
    known, often = _frequent(rows, width)
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part, data, off in chunks(batch, "text"):
                h, n = shingle_sets(data, off, width)
                begin = np.cumsum(n) - n
                fp = np.array([xxhash.xxh64_intdigest(h[b : b + k].tobytes()) if k else 0 for b, k in zip(begin, n, strict=True)], np.uint64)
                sim, has = np.zeros(len(n), np.uint64), np.flatnonzero(n)
                if len(has):
                    sim[has] = np.packbits(2 * bit_counts(h, n[has]) > n[has][:, None], axis=1, bitorder="little").view("<u8").ravel()
                rank = np.zeros(len(h), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    rank = np.where(known[at] == h, often[at], 0)
                doc = np.repeat(np.arange(len(n)), n)
                h = h[np.lexsort((h, rank, doc))]
                size = np.where(n > 0, n - (NUM * n + DEN - 1) // DEN + 1, 0)
                head = h[np.arange(len(h)) - begin[doc] < size[doc]]
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(head.view(np.int64)))
                yield pa.record_batch({"id": part.column("key"), "fp": pa.array(fp.view(np.int64)), "n": pa.array(n.astype(np.int32)), "head": lists, "sim": pa.array(sim.view(np.int64))})

    return cut(rows.select("key", "text").mapInArrow(lean(run), f"id {kind}, fp long, n int, head array<long>, sim long"), "prints")


def _groups(batches, names):
    """Whole groups of equal first column of a sorted stream: the columns, and where each group begins."""
    carry = None
    for batch in batches:
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in names]
        if carry is not None:
            cols = [np.concatenate(x) for x in zip(carry, cols, strict=True)]
        new = np.flatnonzero(np.append(True, cols[0][1:] != cols[0][:-1])) if len(cols[0]) else np.empty(0, np.int64)
        if not len(new):
            continue
        carry = [c[new[-1] :] for c in cols]
        if len(new) > 1:
            yield [c[: new[-1]] for c in cols], new[:-1]
    if carry is not None and len(carry[0]):
        yield carry, np.zeros(1, np.int64)


def _may(na, at, nb, other):
    """Whether sets of these sizes can be similar enough if their first common shingle has these places."""
    need = (NUM * (na.astype(np.int64) + nb) + NUM + DEN - 1) // (NUM + DEN)
    return np.minimum(na - at, nb - other) >= need


def _shared(batches):
    """Rows of the shingles that several sets have, and whether each may be a near copy of the group's centre: the set
    with the fewest rarer shingles."""
    for (s, pos, fp, n), new in _groups(batches, ("s", "pos", "fp", "n")):
        size = np.diff(np.append(new, len(s)))
        keep = np.repeat(size > 1, size)
        centre = np.repeat(new, size)
        star = _may(n, pos, n[centre], pos[centre]) & (fp != fp[centre])
        out = {"s": s, "pos": pos, "fp": fp, "n": n, "centre": fp[centre], "star": star}
        yield pa.record_batch({k: pa.array(v[keep]) for k, v in out.items()})


def _open(batches):
    """All pairs of a shingle's sets that may be near copies and lie in different components. Those of the largest
    component are compared with the others only."""
    for (s, fp, n, pos, label), new in _groups(batches, ("s", "fp", "n", "pos", "label")):
        for lo, hi in zip(new, np.append(new[1:], len(s)), strict=True):
            own, number = np.unique(label[lo:hi], return_inverse=True)
            if len(own) < 2:
                continue
            large = np.bincount(number).argmax()
            for i in lo + np.flatnonzero(number != large):
                at = lo + np.flatnonzero(label[lo:hi] != label[i])
                hit = at[_may(n[at], pos[at], n[i], pos[i])]
                if len(hit):
                    yield pa.record_batch({"a": pa.array(np.minimum(fp[hit], fp[i])), "b": pa.array(np.maximum(fp[hit], fp[i]))})


def _similar(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets of shingles are similar enough, read from the texts again."""

    def run(batches):
        for batch in batches:
            for part, data, off in chunks(batch, "text"):
                h, n = shingle_sets(data, off, width)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.record_batch({"fp": part.column("fp"), "held": lists})

    ids = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    wanted = nodes.join(ids, "fp").select("fp", "rep.id", "rep.hash")
    texts = rows.join(wanted, rows["key.id"].eqNullSafe(wanted["id"]) & (rows["key.hash"] == wanted["hash"])).select("fp", "text")
    sets = cut(texts.mapInArrow(lean(run), "fp long, held array<long>").dropDuplicates(["fp"]), "sets")
    left, right = (sets.select(F.col("fp").alias(k), F.col("held").alias(f"{k}_held")) for k in ("a", "b"))
    both = F.size(F.array_intersect("a_held", "b_held"))
    near = (NUM + DEN) * both >= NUM * (F.size("a_held") + F.size("b_held"))
    out = cut(pairs.join(left, "a").join(right, "b").where(near).select("a", "b"), "similar")
    drop(sets)
    return out


def marked(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets whose SimHash fingerprints are linked: each set with the least one of its fingerprint, and
    these along the links of at most 3 differing bits, by the halves and wildcards of op2."""
    one = cut(nodes.groupBy("sim").agg(F.min("fp").alias("one")), "marks")
    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    equal = nodes.select("sim", "fp").join(one, "sim").where("fp <> one").select(*ordered("fp", "one"))
    with batch_rows(nodes.sparkSession, 50_000):
        edges = cut(link_edges(one.select(F.col("sim").alias("fp"))).distinct(), "links")
    left, right = (one.select(F.col("sim").alias(k), F.col("one").alias(f"one_{k}")) for k in ("a", "b"))
    found = cut(equal.unionByName(edges.join(left, "a").join(right, "b").select(*ordered("one_a", "one_b"))).distinct(), "marked")
    drop(edges)
    drop(one)
    return found


def near_copies(rows: DataFrame, prints: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(nodes, labels): distinct sets of shingles with their least key, and (node, label) of those linked to others."""
    nodes = cut(prints.groupBy("fp").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("head").alias("head"), F.first("sim").alias("sim")), "nodes")
    alike = marked(nodes)
    keys = nodes.select("fp", "n", F.posexplode("head").alias("pos", "s"))
    with batch_rows(rows.sparkSession, 50_000):
        sorted_keys = keys.select("s", "pos", "fp", "n").repartition("s").sortWithinPartitions("s", "pos", "fp")
        shared = cut(sorted_keys.mapInArrow(lean(_shared), "s long, pos int, fp long, n int, centre long, star boolean"), "shared")
    stars = cut(shared.where("star").select(F.least("fp", "centre").alias("a"), F.greatest("fp", "centre").alias("b")).unionByName(alike).distinct(), "stars")
    links = _similar(stars, nodes, rows, width)
    found = components(links)
    named = shared.join(found, shared["fp"] == found["node"], "left").select("s", "fp", "n", "pos", F.coalesce("label", "fp").alias("label"))
    mixed = named.groupBy("s").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("s")
    with batch_rows(rows.sparkSession, 50_000):
        split = named.join(mixed, "s").repartition("s").sortWithinPartitions("s", "fp")
        left = cut(split.mapInArrow(lean(_open), "a long, b long").distinct().join(stars, ["a", "b"], "left_anti"), "open")
    more = _similar(left, nodes, rows, width)
    return nodes, components(links.unionByName(more))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row of every group of near copies, that of the smallest id (of one id, the smallest hash of a text), as it was.

    Two texts are near copies if their sets of shingles of `width` words have a Jaccard similarity of at least NUM / DEN;
    groups are the components of these links. SimHash links are candidates first, confirmed by the whole sets; at this
    similarity they miss most links, so the result is made exact: similar sets share one of their rarest shingles, and of the sets of such a shingle all pairs are compared by their whole sets, but for pairs that are in one component
    already or whose sizes and places rule the similarity out. Texts without words are one group.
    """
    rows = docs.select(others(docs, text_col).alias("doc"), F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash")).alias("key"), F.col(text_col).alias("text"))
    prints = _prints(rows, width)
    nodes, labels = near_copies(rows, prints, width)
    named = nodes.join(labels, nodes["fp"] == labels["node"], "left").select("rep", F.coalesce("label", "fp").alias("label"))
    return keep_least(docs, rows, prints, named.groupBy("label").agg(F.min("rep").alias("one")), text_col)
