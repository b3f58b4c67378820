"""Repeated strings: sorted, front-coded suffix runs are exchanged and merged by loser trees that keep common prefixes.

A symbol goes if a string of `match` symbols that covers it starts anywhere else; a Rule says what symbols are (bytes, or
words whatever their case and punctuation). Each window of `match` symbols belongs to one anchor, the least of its grams
in the part where a context of `context` symbols still fits behind it. Equal windows have equal anchors at equal places,
so only suffixes at anchors are sorted, and of these only the ones whose context occurs twice (a hash that leaves out
nothing that repeats). Windows with one anchor form a block; equal blocks that follow each other in a text, as in a line
that is written again and again, are one row, a chain:

1. blocks with one digest are a class, of which two go on (so that the sort shows that they are equal), or the only one;
   a context with more than HOT_BLOCKS classes is taken apart into single windows, of which only repeated ones go on,
2. these blocks become suffixes from the anchor on, sorted per task into front-coded runs, dealt out by splitters of the
   suffix order and merged by a loser tree with common prefixes, which gives the order and the lengths that neighbours
   share. For each distance d of a window's start from its anchor, two windows are equal exactly if their suffixes share
   match - d symbols and the texts in front share d, which are both runs of sorted neighbours,
3. what the merge finds of a class holds for all its blocks: their digest is XXH64 over both ends, which cover a block.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SliceHash, batch_rows, chunks, cut, drop, layout, lean, mixed, others, ranges, restored, text_view, words
from tessera.llm.decontam import WORD
from tessera.llm.simhash import LOWERED, SEED, hash_slices, xxh64


@dataclass(frozen=True)
class Rule:
    """What has to occur twice: `match` symbols in a row. `context` only decides how anchors are chosen."""

    words: bool
    match: int
    context: int

    @property
    def reach(self) -> int:
        """Largest distance from a window's start to its anchor; below 256."""
        return self.match - self.context

    @property
    def width(self) -> int:
        """Bytes of a symbol."""
        return 8 if self.words else 1


#: Strings of 400 bytes; passages of 50 words. Shorter contexts leave fewer anchors, at a reach below 256.
BYTES, PASSAGES = Rule(False, 400, 160), Rule(True, 50, 18)
#: Text bytes that anchors are looked for in at a time; a chunk needs about 80 times as much memory.
FIND_BYTES = 2 << 20
#: Raw bytes of suffixes in one sorted run, and about what one merging task takes.
RUN_BYTES, MERGE_BYTES = 8 << 20, 8 << 20
#: A context with more classes of blocks than this is taken apart into single windows.
HOT_BLOCKS = 4000
#: Bits that mark these contexts; the driver holds the places of set bits.
HOT_BITS = 1 << 22
#: Ranges of the suffix order that splitters are sampled for, and sampled places for each; finer tasks than this number
#: of ranges cut a range by hash, so what the driver holds does not grow with the input.
RANGES, PLACES = 4096, 32


def symbols(data: np.ndarray, off: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all symbols, offsets in symbols, first byte, end byte) of texts; a word's symbol is the XXH64 of its
    lowered bytes, big-endian."""
    if not rule.words:
        return data, off, np.empty(0, np.int64), np.empty(0, np.int64)
    low = np.append(LOWERED[data], np.zeros(8, np.uint8))
    at, start, end = word_places(low[: len(data)], off)
    return hash_slices(low, start, end - start).astype(">u8").view(np.uint8), at, start, end


def word_places(low: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets in words, first byte, end byte) of the words of lowered texts."""
    start, end, doc = words(WORD[low], off)
    return np.append(0, np.cumsum(np.bincount(doc, minlength=len(off) - 1))), start, end


def anchors(raw: np.ndarray, off: np.ndarray, rule: Rule) -> tuple[np.ndarray, ...]:
    """(document, first window, last window, anchor, hash of context, digest of block, first four bytes of the suffix);
    places in symbols. Texts below `match` symbols have none."""
    n, size, w = int(off[-1]), np.diff(off), rule.width
    many = np.maximum(size - rule.match + 1, 0)
    if not many.sum():
        return tuple(np.empty(0, np.int64) for _ in range(7))
    pad = np.concatenate([raw, np.zeros(24, np.uint8)])
    if rule.words:
        code = pad.view(">u8").astype(np.uint64)
        gram = code[:n] + code[1 : n + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + code[2 : n + 2] * np.uint64(0x165667B19E3779F9)
        hashed = SliceHash(codes=code[:n])
    else:
        gram = np.ndarray((n,), "<u8", pad.data, 0, (1,))
        hashed = SliceHash(raw)
    value = gram * np.uint64(0xD6E8FEB86659FD93)
    wide = rule.reach + 1
    key = np.full(-(-n // wide) * wide + wide, np.iinfo(np.uint64).max, np.uint64)
    key[:n] = (value >> np.uint64(32) << np.uint64(32)) | np.arange(n, dtype=np.uint64)  # the first of equal values
    rows = key.reshape(-1, wide)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    start = ranges(off[:-1], many)
    doc = np.repeat(np.arange(len(size)), many)
    at = (np.minimum(behind[start], ahead[start + rule.reach]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])))
    last = start[np.append(first[1:], len(start)) - 1]
    at, begin, doc = at[first], start[first], doc[first]
    head = np.ndarray((len(pad) - 3,), ">u4", pad.data, 0, (1,))[at * w].astype(np.int64) - (1 << 31)
    return doc, begin, last, at, hashed(at, at + rule.context), digests(pad, begin, last, at, rule), head


def digests(pad: np.ndarray, begin: np.ndarray, last: np.ndarray, at: np.ndarray, rule: Rule) -> np.ndarray:
    """Of blocks: XXH64 of the first and the last window (which cover the block) and the places in it."""
    w = rule.width
    ends = [xxh64(pad, x * w, rule.match * w, SEED + k) for k, x in enumerate((begin, last))]
    return mixed(ends[0] ^ (ends[1] * np.uint64(0x9E3779B97F4A7C15)) ^ (((last - begin) * 1024 + (at - begin)).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))


def pack(begin: np.ndarray, at: np.ndarray, last: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """First window (31 bits), anchor and last window relative to it (8 each), and 16 bits more of the text's hash."""
    return (((tag & 0xFFFF) << 47) | (begin << 16) | ((at - begin) << 8) | (last - begin)).astype(np.int64)


def unpack(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    begin = (pos >> 16) & 0x7FFFFFFF
    return begin, begin + ((pos >> 8) & 0xFF), begin + (pos & 0xFF), pos >> 47


def chains(doc: np.ndarray, begin: np.ndarray, ctx: np.ndarray, block: np.ndarray, match: int) -> tuple[np.ndarray, np.ndarray]:
    """(first block, distance to the last) of each chain: equal blocks of a text, each at most `match` symbols behind the
    one before, so that their windows' strings are one. Blocks come by document and place."""
    by = np.argsort(block, kind="stable")
    b, c, d, at = block[by], ctx[by], doc[by], begin[by]
    new = np.flatnonzero(np.append(True, (b[1:] != b[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1]) | (at[1:] - at[:-1] > match))) if len(by) else by
    last = np.append(new[1:], len(by)) - 1 if len(new) else new
    order = np.argsort(by[new])
    return by[new][order], (at[last] - at[new])[order]


#: more: how far the last block of the chain is from the one at pos.
BLOCKS = "row long, pos long, ctx long, block long, head int, more int"


def _blocks(row, pos, ctx, block, head, more) -> pa.RecordBatch:
    made = {"row": row, "pos": pos, "ctx": ctx.view(np.int64), "block": block.view(np.int64), "head": head.astype(np.int32), "more": more.astype(np.int32)}
    return pa.record_batch({k: pa.array(v) for k, v in made.items()})


def _find(rule: Rule):
    def run(batches):
        for batch in batches:
            for part, data, off in chunks(batch, "text", FIND_BYTES):
                raw, off, _, _ = symbols(data, off, rule)
                doc, begin, last, at, ctx, block, head = anchors(raw, off, rule)
                own, more = chains(doc, begin, ctx, block, rule.match)
                doc, begin, last, at, ctx, block, head = (x[own] for x in (doc, begin, last, at, ctx, block, head))
                base = off[doc]
                yield _blocks(part.column("row").to_numpy()[doc], pack(begin - base, at - base, last - base, part.column("tag").to_numpy()[doc]), ctx, block, head, more)

    return run


def _windows(rule: Rule, hot: np.ndarray):
    """The blocks whose context's bit is set in `hot`, as blocks of one window each."""

    def run(batches):
        for batch in batches:
            for part, data, off in chunks(batch, "text", FIND_BYTES):
                raw, off, _, _ = symbols(data, off, rule)
                doc, begin, last, at, ctx, block, head = anchors(raw, off, rule)
                own, more = chains(doc, begin, ctx, block, rule.match)
                bit = ctx[own].view(np.uint64) & np.uint64(HOT_BITS - 1)
                marked = np.flatnonzero(hot[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
                own, more = own[marked], more[marked]
                many = (last - begin + 1)[own]
                which = np.repeat(own, many)
                start = ranges(begin[own], many)
                doc, at, base = doc[which], at[which], off[doc[which]]
                block = digests(np.concatenate([raw, np.zeros(24, np.uint8)]), start, start, at, rule)
                yield _blocks(part.column("row").to_numpy()[doc], pack(start - base, at - base, start - base, part.column("tag").to_numpy()[doc]), ctx[which], block, head[which], np.repeat(more, many))

    return run


def shared_prefix(a: bytes, b: bytes, known: int) -> tuple[bool, int]:
    """(a is not above b, bytes that they share), given that the first `known` are equal."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return len(a) <= len(b), n
    at = n - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8
    return a[at] < b[at], at


class LoserTree:
    """Merges sorted runs. Every loser keeps the prefix that it shares with the winner that beat it, so bytes known to
    be equal are never looked at again: unequal prefixes decide alone, equal ones are compared from there on."""

    def __init__(self, runs: list[tuple[list[bytes], list[int]]]):
        self.runs = runs
        self.size = 1 << max(0, len(runs) - 1).bit_length()
        self.next = [0] * self.size
        self.loser, self.common = [0] * self.size, [-1] * self.size

    def _text(self, run: int) -> bytes:
        return self.runs[run][0][self.next[run]]

    def _play(self, a: int, common_a: int, b: int, common_b: int) -> tuple[int, int, int, int]:
        """(winner, its prefix shared with the last output, loser, its prefix shared with the winner); -1: run is over."""
        if common_a > common_b:
            return a, common_a, b, common_b
        if common_a < common_b:
            return b, common_b, a, common_a
        if common_a < 0:
            return a, -1, b, -1
        first, same = shared_prefix(self._text(a), self._text(b), common_a)
        return (a, common_a, b, same) if first else (b, common_b, a, same)

    def _start(self, node: int) -> tuple[int, int]:
        if node >= self.size:
            run = node - self.size
            return run, 0 if run < len(self.runs) and self.runs[run][0] else -1
        winner, common, self.loser[node], self.common[node] = self._play(*self._start(2 * node), *self._start(2 * node + 1))
        return winner, common

    def __iter__(self):
        """(run, place in it, prefix shared with the one before) in order."""
        run, common = self._start(1)
        while common >= 0:
            place = self.next[run]
            yield run, place, common
            self.next[run] = place + 1
            texts, shared = self.runs[run]
            common = shared[place + 1] if place + 1 < len(texts) else -1
            node = (run + self.size) >> 1
            while node:
                run, common, self.loser[node], self.common[node] = self._play(run, common, self.loser[node], self.common[node])
                node >>= 1


def neighbours(texts: list[bytes]) -> np.ndarray:
    """Bytes that each of sorted texts shares with the one before (0 for the first)."""
    if not texts:
        return np.empty(0, np.int64)
    size = np.array([len(t) for t in texts])
    grid = np.zeros((len(texts), int(size.max()) + 1), np.uint8)
    off = np.concatenate([[0], np.cumsum(size)])
    grid[np.repeat(np.arange(len(texts)), size), ranges(np.zeros(len(texts), np.int64), size)] = np.frombuffer(b"".join(texts), np.uint8)
    assert off[-1] == size.sum()
    out = np.zeros(len(texts), np.int64)
    other = grid[1:] != grid[:-1]
    out[1:] = np.where(other.any(axis=1), other.argmax(axis=1), grid.shape[1])
    out[1:] = np.minimum(out[1:], np.minimum(size[1:], size[:-1]))
    return out


FIELDS = (("row", "<i8"), ("pos", "<i8"), ("ctx", "<i8"), ("block", "<i8"), ("copies", "<i8"), ("near", "<i2"), ("far", "<i2"), ("common", "<i2"), ("size", "<i2"), ("front", "<i2"))


def write_run(texts: list[bytes], fronts: list[bytes], numbers: dict[str, np.ndarray]) -> bytes:
    """A sorted run: numbers, then of each suffix the bytes past the prefix shared with the one before, then the fronts;
    all of it compressed."""
    common = neighbours(texts)
    columns = numbers | {"common": common, "size": np.array([len(t) for t in texts]), "front": np.array([len(t) for t in fronts])}
    head = b"".join(np.asarray(columns[k]).astype(t).tobytes() for k, t in FIELDS)
    whole = struct.pack("<i", len(texts)) + head + b"".join(t[c:] for t, c in zip(texts, common.tolist(), strict=True)) + b"".join(fronts)
    return zstandard.ZstdCompressor(level=3).compress(whole)


def read_run(raw: bytes) -> tuple[list[bytes], list[bytes], dict[str, np.ndarray]]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    (n,) = struct.unpack_from("<i", raw)
    at, numbers = 4, {}
    for k, t in FIELDS:
        numbers[k] = np.frombuffer(raw, t, n, at).astype(np.int64)
        at += n * np.dtype(t).itemsize
    texts, before = [], b""
    for c, s in zip(numbers["common"].tolist(), numbers["size"].tolist(), strict=True):
        before = before[:c] + raw[at : at + s - c]
        at += s - c
        texts.append(before)
    fronts = []
    for s in numbers["front"].tolist():
        fronts.append(raw[at : at + s])
        at += s
    return texts, fronts, numbers


def _runs(rule: Rule, splitters: np.ndarray, within: int):
    """Joined rows (text, entries of its blocks) to sorted runs, one for each merging task and RUN_BYTES of suffixes.

    A task is a range of the suffix order (between splitters of order keys), cut into `within` by a hash. Copies of one
    text follow each other and are taken once."""
    w = rule.width

    def flush(held):
        held.sort(key=lambda e: (e[0], e[1]))
        lo = 0
        for hi in range(1, len(held) + 1):
            if hi == len(held) or held[hi][0] != held[lo][0]:
                own = held[lo:hi]
                numbers = {k: np.array([e[3 + i] for e in own], np.int64) for i, k in enumerate(("row", "pos", "ctx", "block", "copies", "near", "far"))}
                yield pa.record_batch({"task": pa.array([own[0][0]], pa.int64()), "run": pa.array([write_run([e[1] for e in own], [e[2] for e in own], numbers)], pa.binary())})
                lo = hi

    def run(batches):
        held, size, before = [], 0, None
        for batch in batches:
            for part, data, off in chunks(batch, "text"):
                raw, off, _, _ = symbols(data, off, rule)
                rows, tags = part.column("row").to_pylist(), part.column("tag").to_pylist()
                lists = part.column("entries")
                where, entries = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()
                begin, at, last, _ = unpack(entries.field("pos").to_numpy())
                ctx, block = entries.field("ctx").to_numpy(), entries.field("block").to_numpy()
                order = entries.field("order").to_numpy()
                task = np.searchsorted(splitters, order, "right") * within + order % within
                columns = [x.tolist() for x in (task, begin, at, last, entries.field("pos").to_numpy(), ctx, block, entries.field("copies").to_numpy())]
                for i in range(len(rows)):
                    if (rows[i], tags[i]) == before:
                        continue
                    before = (rows[i], tags[i])
                    text = raw[off[i] * w : off[i + 1] * w].tobytes()
                    for k in range(where[i], where[i + 1]):
                        t, b, a, z, pos, c, bl, n = (x[k] for x in columns)
                        held.append((t, text[a * w : (z + rule.match) * w], text[b * w : a * w][::-1], rows[i], pos, c, bl, n, a - z, a - b))
                        size += (z + rule.match - b) * w
                        if size >= RUN_BYTES:
                            yield from flush(held)
                            held, size = [], 0
        yield from flush(held)

    return run


def repeated_windows(common: np.ndarray, size: np.ndarray, fronts: list[bytes], near: np.ndarray, far: np.ndarray, rule: Rule = BYTES) -> np.ndarray:
    """(suffix, distance) pairs whose window occurs at another suffix as well, as a table of booleans.

    common: bytes shared with the suffix before, in sorted order; fronts: what stands before each, backwards."""
    n, w = len(size), rule.width
    order = sorted(range(n), key=fronts.__getitem__)
    front_common = neighbours([fronts[i] for i in order]) // w
    order = np.array(order)
    front_size = np.array([len(f) for f in fronts]) // w
    common, size = common // w, size // w
    out = np.zeros((n, rule.reach + 1), bool)
    front_class = np.empty(n, np.int64)
    for d in range(int(near.min()), int(far.max()) + 1):
        on = np.flatnonzero((near <= d) & (d <= far) & (front_size >= d) & (size >= rule.match - d))
        if len(on) < 2:
            continue
        behind = np.cumsum(common < rule.match - d)
        front_class[order] = np.cumsum(front_common < d)
        key = behind[on] * (n + 1) + front_class[on]
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        hit = np.zeros(len(on), bool)
        hit[by[1:][same]] = True
        hit[by[:-1][same]] = True
        out[on[hit], d] = True
    return out


def merge_runs(raw: list[bytes]) -> tuple[list[bytes], np.ndarray, dict[str, np.ndarray]]:
    """(fronts, common prefixes, numbers) of the suffixes of all runs, in order."""
    read = [read_run(r) for r in raw]
    tree = LoserTree([(texts, numbers["common"].tolist()) for texts, _, numbers in read])
    base = np.cumsum([0] + [len(r[0]) for r in read]).tolist()
    order, common = [], []
    for run, place, shared in tree:
        order.append(base[run] + place)
        common.append(shared)
    fronts = [f for r in read for f in r[1]]
    return [fronts[i] for i in order], np.array(common), {k: np.concatenate([r[2][k] for r in read])[order] for k, _ in FIELDS}


def _merge(rule: Rule):
    """Runs of distances lo..hi whose windows repeat: of a block (row, pos), or of every block of a class (ctx, block)."""

    def run(table: pa.Table) -> pa.Table:
        fronts, common, numbers = merge_runs(table.column("run").to_pylist())
        hit = repeated_windows(common, numbers["size"], fronts, numbers["near"], numbers["far"], rule)
        edge = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        i, lo = np.nonzero(edge == 1)
        _, hi = np.nonzero(edge == -1)
        hi = hi - 1
        one = numbers["copies"][i] == 1
        keys = {"row": np.where(one, numbers["row"][i], 0), "pos": np.where(one, numbers["pos"][i], 0), "ctx": np.where(one, 0, numbers["ctx"][i]), "block": np.where(one, 0, numbers["block"][i])}
        return pa.table({k: pa.array(v) for k, v in (keys | {"lo": lo, "hi": hi}).items()} | {"single": pa.array(one)})

    return run


def _copies():
    """Of rows of blocks: two for a chain, whose first and last block are told apart, else one."""
    return F.count("*") + F.count_if(F.col("more") > 0)


def _classes(blocks: DataFrame, hot: bool) -> DataFrame:
    """Blocks with one digest. order: the first four bytes of the suffix, then bits of the context, or of a single
    window of a context that was taken apart, so that splitters can cut such a context too."""
    order = F.shiftleft(F.col("head").cast("long"), 32).bitwiseOR(F.shiftrightunsigned("block" if hot else "ctx", 32))
    one, two = F.min(F.struct("row", "pos")), F.max(F.struct("row", (F.col("pos") + F.shiftleft(F.col("more").cast("long"), 16)).alias("pos")))
    made = blocks.groupBy("ctx", "block").agg(F.first("head").alias("head"), _copies().alias("copies"), one.alias("one"), two.alias("two"))
    return made.select("ctx", "block", "copies", "one", "two", order.alias("order"))


def _entries(keyed: DataFrame, *entry) -> DataFrame:
    return keyed.groupBy("row", "tag").agg(F.collect_list(F.struct(*entry)).alias("entries"))


def _apart(rows: DataFrame, hot: DataFrame, rule: Rule) -> DataFrame:
    """The blocks of hot contexts as blocks of one window each, found by a second pass over the texts, which need not
    move: a bitmap of fixed size lets the blocks through, a join drops those that only share a bit."""
    bits = np.zeros(HOT_BITS // 8, np.uint8)
    place = hot.select(F.col("ctx").bitwiseAND(F.lit(HOT_BITS - 1)).alias("p")).distinct().toArrow().column("p").to_numpy()
    np.bitwise_or.at(bits, place >> 3, (1 << (place & 7)).astype(np.uint8))
    return cut(rows.mapInArrow(lean(_windows(rule, bits)), BLOCKS).join(hot, "ctx").select("row", "pos", "ctx", "block", "head", "more"), "windows")


def _hits(rows: DataFrame, able: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """What the merge finds of the candidate blocks; see _merge()."""
    n, doubles = classes.agg(F.count("*"), F.count_if(F.col("copies") > 1)).first()
    parts = max(1, -(-(n + doubles) * (rule.match + rule.reach // 2) * rule.width // MERGE_BYTES))
    found = min(parts, RANGES)
    splitters = np.empty(0, np.int64)
    if found > 1:
        share = min(1 << 20, -(-(found * PLACES << 20) // n))
        places = classes.where(F.pmod(F.xxhash64("ctx", "block"), F.lit(1 << 20)) < share).select("order").toArrow().column("order").to_numpy()
        if len(places):
            splitters = np.unique(np.sort(places)[(np.arange(1, found) * len(places)) // found])
    sent = classes.select("ctx", "block", "copies", "order", F.explode(F.when(F.col("copies") > 1, F.array("one", "two")).otherwise(F.array("one"))).alias("o"))
    placed = sent.select(F.col("o.row").alias("row"), F.shiftrightunsigned("o.pos", 47).alias("tag"), F.col("o.pos").alias("pos"), "ctx", "block", "copies", "order")
    entries = cut(_entries(placed, "pos", "ctx", "block", "copies", "order"), "entries")  # a table of its own: Spark can then split a text that many rows have
    made = rows.join(entries, ["row", "tag"]).select("row", "tag", "text", "entries").mapInArrow(lean(_runs(rule, splitters, -(-parts // found))), "task long, run binary")
    with batch_rows(rows.sparkSession, 64):
        hits = cut(made.groupBy("task").applyInArrow(_merge(rule), "row long, pos long, ctx long, block long, lo long, hi long, single boolean"), "hits")
    drop(entries)
    return hits


def find_repeats(rows: DataFrame, rule: Rule) -> DataFrame:
    """(row, tag, start, end): the strings of texts that repeat, in symbols; some may come twice. rows: row, tag, text."""
    rows = rows.where(F.octet_length("text") >= (2 * rule.match - 1 if rule.words else rule.match))
    found = cut(rows.mapInArrow(lean(_find(rule)), BLOCKS), "anchors")
    twice = cut(found.groupBy("ctx").agg(_copies().alias("n")).where("n > 1").select("ctx"), "contexts")
    able = cut(found.join(twice, "ctx"), "candidates")  # twice is a table of its own: Spark can then split a frequent context
    drop(found)
    drop(twice)
    classes = classes_table = cut(_classes(able, False), "blocks")
    hot = cut(classes.groupBy("ctx").agg(F.count("*").alias("n")).where(F.col("n") > HOT_BLOCKS).select("ctx"), "hot")
    if not hot.isEmpty():
        apart = _apart(rows, hot, rule)
        able = able.join(hot, "ctx", "left_anti").unionByName(apart)
        repeated = cut(_classes(apart, True).where("copies > 1"), "repeated")
        classes = classes.join(hot, "ctx", "left_anti").unionByName(repeated)
    hits = _hits(rows, able, classes, rule)
    drop(classes_table)
    several = hits.where("NOT single").select("ctx", "block", "lo", "hi").distinct()
    both = hits.where("single").select("row", "pos", F.lit(0).alias("more"), "lo", "hi").unionByName(able.join(several, ["ctx", "block"]).select("row", "pos", "more", "lo", "hi"))
    anchor = F.shiftright("pos", 16).bitwiseAND(F.lit(0x7FFFFFFF)) + F.shiftright("pos", 8).bitwiseAND(F.lit(0xFF))
    return both.select("row", F.shiftrightunsigned("pos", 47).alias("tag"), (anchor - F.col("hi")).alias("start"), (anchor - F.col("lo") + rule.match + F.col("more")).alias("end"))


def joined_runs(lists: pa.ListArray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the maximal runs of each row's strings, which touch or overlap; size: symbols of a row."""
    packed, many = lists.flatten().to_numpy(), lists.value_lengths().fill_null(0).to_numpy()
    row = np.repeat(np.arange(len(many)), many)
    base = np.cumsum(size + 1) - (size + 1)  # a gap between rows, so that runs end with their row
    start, end = (packed >> 31) + base[row], (packed & 0x7FFFFFFF) + base[row]
    order = np.argsort(start, kind="stable")
    row, start, end = row[order], start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.append(True, start[1:] > end[:-1])) if len(row) else np.empty(0, np.int64)
    last = np.append(new[1:], len(row)) - 1 if len(new) else new
    return row[new], start[new] - base[row[new]], end[last] - base[row[new]]


def left_over(text: bytes, gone: list[list[int]]) -> bytes:
    kept, at = [], 0
    for a, b in gone:
        kept.append(text[at : max(a, at)])
        at = max(at, b)
    return b"".join([*kept, text[at:]])


def whole_characters(text: bytes, gone: list[list[int]]) -> list[list[int]]:
    """The runs, with the rest of each character that lost a byte."""
    out = []
    for a, b in gone:
        while a and text[a] & 0xC0 == 0x80:
            a -= 1
        while b < len(text) and text[b] & 0xC0 == 0x80:
            b += 1
        out.append([a, b])
    return out


def _cut_out(rule: Rule | None, keep: Rule | None):
    """rule: of the counts and the digest; keep: of the text that is left."""

    def run(batches):
        for batch in batches:
            for part, data, off in chunks(batch, "text"):
                n, size = len(part), np.diff(off)
                row, begin, end = joined_runs(part.column("spans_byte"), size)
                gone: list[list[list[int]]] = [[] for _ in range(n)]
                for i, a, b in zip(row.tolist(), begin.tolist(), end.tolist(), strict=True):
                    gone[i].append([a, b])
                out = {"n_bytes": size, "n_removed": np.bincount(row, end - begin, n).astype(np.int64), "n_spans": np.bincount(row, minlength=n)}
                lists = part.column("spans_word")
                at, first, last = word_places(LOWERED[data], off) if len(lists.flatten()) else (np.zeros(n + 1, np.int64), off, off)
                row, begin, end = joined_runs(lists, np.diff(at))
                out |= {"n_passages": np.bincount(row, minlength=n), "n_passage_words": np.bincount(row, end - begin, n).astype(np.int64)}
                passages: list[list[list[int]]] = [[] for _ in range(n)]
                for i, a, b in zip(row.tolist(), begin.tolist(), end.tolist(), strict=True):  # up to the next word that stays, or the end of the last
                    stop = first[at[i] + b] if at[i] + b < at[i + 1] else last[at[i + 1] - 1]
                    passages[i].append([int(first[at[i] + a] - off[i]), int(stop - off[i])])
                digest, kept = [], []
                for i in range(n):
                    text = data[off[i] : off[i + 1]].tobytes()
                    digest.append(hashlib.sha256(left_over(text, gone[i])).hexdigest() if rule else None)
                    kept.append(left_over(text, passages[i] if keep.words else whole_characters(text, gone[i])) if keep else None)
                made = {k: pa.array(v, pa.int64()) for k, v in out.items()} | {"kept_sha256": pa.array(digest, pa.string()), "kept": pa.array(kept, pa.binary()).cast(pa.string())}
                yield pa.record_batch({"id": part.column("id"), "doc": part.column("doc"), **{k: made[k] for k in RESULT}})

    return run


RESULT = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string", "n_passages": "long", "n_passage_words": "long", "kept": "string"}


def keyed(docs: DataFrame, id_col: str, text_col: str, carry: bool) -> DataFrame:
    """id, text, doc (all other columns if carried), and the 80 bits that stand for the text: row and tag."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), (others(docs, text_col) if carry else F.lit(0)).alias("doc"), F.xxhash64(text).alias("row"), F.xxhash64(F.lit(1), text).bitwiseAND(F.lit(65535)).alias("tag"))


def _without(docs: DataFrame, id_col: str, text_col: str, rule: Rule | None, keep: Rule | None, carry: bool) -> DataFrame:
    rows = keyed(docs, id_col, text_col, carry)
    both = [find_repeats(rows.select("row", "tag", "text"), x).select("row", "tag", F.lit(x.words).alias("words"), (F.shiftleft("start", 31) + F.col("end")).alias("span")) for x in dict.fromkeys(x for x in (rule, keep) if x)]
    spans = both[0] if len(both) == 1 else both[0].unionByName(both[1])
    of = lambda words: F.collect_set(F.when(F.col("words") == words, F.col("span")))  # noqa: E731  copies of a text have one set
    lists = cut(spans.groupBy("row", "tag").agg(of(False).alias("spans_byte"), of(True).alias("spans_word")), "strings")
    joined = rows.join(lists, ["row", "tag"], "left")
    fields = layout(rows, ["id", "doc"], ", ".join(f"{k} {t}" for k, t in RESULT.items()))
    return joined.drop("row", "tag").mapInArrow(lean(_cut_out(rule, keep)), fields).withColumnRenamed("id", id_col)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 of every row: strings of 400 bytes that start anywhere else go.

    Whole texts as UTF-8 bytes; null is empty, and texts below 400 bytes stay as they are. Texts are told apart by 80
    bits of their XXH64. Repeated rows, with one id or not, repeat each other's strings, so their texts go as a whole;
    each row has its result. Other columns are never read. An empty table gives an empty result.
    """
    return _without(docs, id_col, text_col, BYTES, None, False).select(id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256")


def repeat_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of remove_repeats(), then what the same search finds of passages of 50 words, whatever their case
    and punctuation: n_passages, n_passage_words, and the text without them."""
    return _without(docs, id_col, text_col, BYTES, PASSAGES, False).drop("doc").withColumnRenamed("kept", text_col)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", rule: Rule = BYTES) -> DataFrame:
    """All rows with what remains of their texts (empty if nothing does, null becomes empty); a column of lengths is kept
    true. Of bytes, characters that lose one go whole; of words, a passage goes up to the next word that stays. Repeated
    rows all stay, each with what is left of it; ties cannot occur, an empty table stays empty, other columns travel
    inside one struct."""
    out = _without(docs, id_col, text_col, None if rule.words else rule, rule, True)
    new = {text_col: F.col("kept")} | ({chars_col: F.length("kept").cast(docs.schema[chars_col].dataType)} if chars_col in docs.columns else {})
    return restored(out, docs, text_col, **new)
