"""Benchmark decontamination: an FM-index of each training shard, searched backward for the windows of the items."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WIDE_CHUNK_BYTES, Index, SliceHash, chunks, cut, layout, lean, others, ranges, restored, text_view, words

WINDOW = 13
#: A document is contaminated if its hit words, times this, reach its words.
PART = 20
#: Every so many symbols the index keeps a text position; the start of each run is kept besides.
SAMPLE = 8
#: Item bytes that one pass searches for; more items are searched in blocks, all against all documents.
BLOCK_BYTES = 16 << 20

WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32


class FMIndex:
    """Full suffix order of a text of symbols >= 1 whose runs end in 0; counts and locates patterns without a 0.

    The Burrows-Wheeler string is a wavelet matrix of packed bits with a popcount rank per 64; text positions are
    sampled. Separators differ from one another in the suffix order, so sorting ends with the longest run.
    """

    def __init__(self, text: np.ndarray, symbols: int):
        n = len(text)
        zero = text == 0
        cuts = np.flatnonzero(zero)
        rank = text.astype(np.int64) + len(cuts)
        rank[cuts] = np.arange(len(cuts))
        order, rank = self._dense(rank)
        step = 1
        while rank[order[-1]] + 1 < n:
            key = rank * (n + 1)
            key[: n - step] += rank[step:] + 1
            order, rank = self._dense(key)
            step *= 2
        self.n = n
        last = text[order - 1]
        start_of_run = zero[order - 1]
        self.sampled = (order % SAMPLE == 0) | start_of_run
        self.before = np.cumsum(self.sampled) - self.sampled
        self.values = order[self.sampled]
        self.levels = max(1, int(symbols).bit_length())
        count = np.bincount(text, minlength=symbols + 1)
        self.first = np.cumsum(count) - count
        self.bits, self.ranks, self.zeros = [], [], []
        for level in range(self.levels):
            bit = (last >> (self.levels - 1 - level)) & 1 == 1
            packed = np.packbits(bit, bitorder="little")
            wide = np.zeros(n // 64 + 1, "<u8")
            wide.view(np.uint8)[: len(packed)] = packed
            self.bits.append(wide)
            self.ranks.append(np.cumsum(np.append(0, np.bitwise_count(wide[:-1]).astype(np.int64))))
            self.zeros.append(n - int(bit.sum()))
            last = np.concatenate([last[~bit], last[bit]])
        self.base = np.zeros(symbols + 1, np.int64)  # where the symbol's rows start after the last level
        every = np.arange(symbols + 1)
        self.base = self._descend(every, np.zeros(symbols + 1, np.int64))

    @staticmethod
    def _dense(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key, kind="stable")
        s = key[order]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(np.append(0, s[1:] != s[:-1]))
        return order, rank

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.ranks[level][block] + np.bitwise_count(self.bits[level][block] & mask)

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level in range(self.levels):
            one = self._ones(level, at)
            bit = (symbol >> (self.levels - 1 - level)) & 1 == 1
            at = np.where(bit, self.zeros[level] + one, at - one)
        return at

    def before_row(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Backward step: the row of the suffixes that put the symbol in front of those above row `at`."""
        return self.first[symbol] + self._descend(symbol, at) - self.base[symbol]

    def search(self, patterns: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, first row, end row) of the patterns that occur; patterns are right-aligned in their matrix."""
        live = np.arange(len(patterns))
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n)
        width = patterns.shape[1]
        for back in range(1, width + 1):
            on = live[sizes[live] >= back]
            symbol = patterns[on, width - back]
            lo[on], hi[on] = self.before_row(symbol, lo[on]), self.before_row(symbol, hi[on])
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        return live, lo[live], hi[live]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back to the nearest sampled one, all rows together."""
        out = np.empty(len(rows), np.int64)
        live, rows, steps = np.arange(len(rows)), rows.copy(), 0
        while len(live):
            known = self.sampled[rows]
            out[live[known]] = self.values[self.before[rows[known]]] + steps
            live, rows = live[~known], rows[~known]
            at, symbol = rows, np.zeros(len(rows), np.int64)
            for level in range(self.levels):
                one = self._ones(level, at)
                bit = (self.bits[level][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
                symbol = symbol * 2 + bit
                at = np.where(bit, self.zeros[level] + one, at - one)
            rows = self.first[symbol] + at - self.base[symbol]
            steps += 1
        return out


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, start, end) of every word; offsets are bytes of the buffer."""
    low = LOWERED[data]
    start, end, doc = words(WORD[low], off)
    return SliceHash(low)(start, end), doc, start, end


@dataclass(frozen=True)
class Phrases:
    """The windows of a block of items over their own vocabulary; symbol 0 is any other word."""

    names: list[str]
    vocabulary: np.ndarray
    windows: np.ndarray
    sizes: np.ndarray
    item: np.ndarray

    @staticmethod
    def of(names: list[str], texts: pa.Array) -> Phrases:
        data, off = text_view(texts)
        h, doc, _, _ = word_hashes(data, off)
        vocabulary, symbol = np.unique(h, return_inverse=True)
        count = np.bincount(doc, minlength=len(names))
        first = np.cumsum(count) - count
        size = np.minimum(count, WINDOW)
        many = np.where(count > 0, count - size + 1, 0)
        item = np.repeat(np.arange(len(names)), many)
        start = ranges(first, many)
        windows = np.zeros((len(start), WINDOW), np.int64)
        for back in range(1, WINDOW + 1):
            on = size[item] >= back
            windows[on, WINDOW - back] = symbol[start[on] + size[item[on]] - back] + 1
        return Phrases(names, vocabulary, windows, size[item], item)

    def occurrences(self, data: np.ndarray, off: np.ndarray, index: Index) -> tuple[np.ndarray, ...]:
        """(words per text, start and end byte of each word, first word and item of each occurrence, its words, text).

        Words outside the vocabulary end a run, and runs shorter than the shortest window are left out of the
        index, since no window fits into them.
        """
        n = len(off) - 1
        h, doc, start, end = word_hashes(data, off)
        count = np.bincount(doc, minlength=n)
        symbol = np.zeros(len(h), np.int64)
        if len(self.vocabulary):
            at, where = index.probe(h)
            symbol[at] = where + 1
        none = (count, start, end, *[np.empty(0, np.int64)] * 4)
        if not len(self.sizes) or not len(h):
            return none
        edge = np.cumsum(count) - count
        head, tail, _ = words(symbol > 0, np.append(edge, len(symbol)))
        long = tail - head >= self.sizes.min()
        head, tail = head[long], tail[long]
        if not len(head):
            return none
        size = tail - head
        text = np.zeros(int((size + 1).sum()), np.int64)
        to = np.cumsum(size + 1) - (size + 1)
        word = np.zeros(len(text), np.int64)
        word[ranges(to, size)] = ranges(head, size)
        text[ranges(to, size)] = symbol[ranges(head, size)]
        fm = FMIndex(text, len(self.vocabulary))
        found, lo, hi = fm.search(self.windows, self.sizes)
        if not len(found):
            return none
        which = np.repeat(found, hi - lo)
        place = word[fm.locate(ranges(lo, hi - lo))]
        return count, start, end, place, self.item[which], self.sizes[which], doc[place]


SPANS = "array<struct<word:int,end_word:int,start:int,end:int>>"


def _scan(phrases: Phrases, carry: bool):
    def run(batches):
        index = Index(phrases.vocabulary)
        for batch in batches:
            for part, data, off in chunks(batch, "text", WIDE_CHUNK_BYTES):
                n = len(off) - 1
                count, start, end, place, item, size, doc = phrases.occurrences(data, off, index)
                first = np.cumsum(count) - count
                cover = np.zeros(len(start) + 1, np.int64)
                np.add.at(cover, place, 1)
                np.add.at(cover, place + size, -1)
                hit = np.cumsum(cover)[:-1] > 0
                head, tail, own = words(hit, np.append(first, len(hit)))
                spans = pa.StructArray.from_arrays(
                    [pa.array(x.astype(np.int32)) for x in (head - first[own], tail - first[own], start[head] - off[own], end[tail - 1] - off[own])], ["word", "end_word", "start", "end"]
                )
                pairs = np.unique(np.column_stack([doc, item]), axis=0) if len(doc) else np.empty((0, 2), np.int64)
                names = pa.array([phrases.names[i] for i in pairs[:, 1]], pa.string())
                lists = [pa.ListArray.from_arrays(pa.array(np.searchsorted(o, np.arange(n + 1)).astype(np.int32)), v) for o, v in ((own, spans), (pairs[:, 0], names))]
                yield pa.record_batch({"uid": part.column("uid"), "id": part.column("id"), "doc": part.column("doc"), **{k: part.column(k) for k in ["text"][:carry]}, "n_words": pa.array(count.astype(np.int64)), "spans": lists[0], "items": lists[1]})

    return run


def _finish(batches):
    """Unites the spans of a row (sorted or not) and counts its words and items."""
    for batch in batches:
        rows = {k: [] for k in ("n_hit", "n_items", "items_sha256", "items", "spans")}
        for spans, items in zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True):
            one: list[dict] = []
            for s in sorted(spans, key=lambda x: x["word"]):
                if one and s["word"] <= one[-1]["end_word"]:
                    if s["end_word"] > one[-1]["end_word"]:
                        one[-1] |= {"end_word": s["end_word"], "end": s["end"]}
                else:
                    one.append(dict(s))
            items = sorted(set(items))
            rows["n_hit"].append(sum(s["end_word"] - s["word"] for s in one))
            rows["n_items"].append(len(items))
            rows["items_sha256"].append(hashlib.sha256(",".join(items).encode()).hexdigest())
            rows["items"].append(items)
            rows["spans"].append(one)
        kind = pa.list_(pa.struct([(k, pa.int32()) for k in ("word", "end_word", "start", "end")]))
        types = {"n_hit": pa.int64(), "n_items": pa.int64(), "items_sha256": pa.string(), "items": pa.list_(pa.string()), "spans": kind}
        yield pa.record_batch({"id": batch.column("id"), "doc": batch.column("doc"), **{k: batch.column(k) for k in batch.schema.names if k == "text"}, "n_words": batch.column("n_words"), **{k: pa.array(v, types[k]) for k, v in rows.items()}})


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, carry: bool = False) -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256, contaminated, items and removal spans of every row.

    Each chunk of a partition is a shard with an index of its own, so documents are never shuffled. Items of up to
    block_bytes travel with the function; more are searched block by block and the spans of a row united. Null
    and wordless texts have no words and are clean; items that are null or wordless have no window; repeated
    items each count. With carry, `text` and `doc` (all other columns) follow. A span is in words (word, end_word) and in bytes (start, end) of the text.
    """
    items = items.select(F.col(item_col).cast("string").alias("name"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    read = docs.select(F.lit(0).cast("long").alias("uid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), (others(docs, text_col) if carry else F.lit(0)).alias("doc"))
    carried = ["id", "doc", *["text"][:carry]]
    if blocks > 1:
        read = cut(read.withColumn("uid", F.monotonically_increasing_id()), "texts")
    found = None
    for k in range(blocks):
        own = (items if blocks == 1 else items.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == k)).toArrow()
        one = read.mapInArrow(lean(_scan(Phrases.of(own["name"].to_pylist(), own["text"].combine_chunks()), carry)), layout(read, ["uid", *carried], f"n_words long, spans {SPANS}, items array<string>"))
        found = one if found is None else found.unionByName(one)
    if blocks > 1:
        found = found.groupBy("uid").agg(F.first("id").alias("id"), F.first("doc").alias("doc"), *[F.first("text").alias("text")][:carry], F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    found = found.select(*carried, "n_words", "spans", "items").mapInArrow(lean(_finish), layout(read, carried, f"n_words long, n_hit long, n_items long, items_sha256 string, items array<string>, spans {SPANS}"))
    rule = (F.col("n_hit") > 0) & (PART * F.col("n_hit") >= F.col("n_words"))
    return found.select(F.col("id").alias(id_col), "n_words", "n_hit", "n_items", "items_sha256", rule.alias("contaminated"), "items", "spans", *["doc", "text"][: 2 * carry])


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that are not contaminated, as they were."""
    return restored(decontaminate(docs, items, id_col, text_col, carry=True).where("NOT contaminated"), docs, text_col)
