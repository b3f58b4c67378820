"""SentencePiece encoding and decoding: batched numpy Viterbi over words of equal length, exact round trip."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WIDE_CHUNK_BYTES, Index, SliceHash, chunks, lean, mixed, ranges, worker_state

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Cells of one Viterbi table; bounds the memory of a batch of equal-length words.
CELLS = 1 << 21
#: Score of a byte piece in a unigram model: taken only where no piece covers a character.
BYTE_SCORE = -100.0
#: Words whose pieces a worker keeps; results do not depend on it.
KEPT_WORDS = 500_000
NEVER = np.int64(1) << 40


def _pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
    return x * np.uint64(0x9E3779B97F4A7C15)  # odd, so no two pairs meet


@dataclass(frozen=True)
class Pieces:
    """A vocabulary as arrays: sorted hashes of the piece strings with their ids and scores, and the bytes of every id.

    A unigram model takes the path of the largest total score. In a merge list (byte pair encoding) a path is right
    exactly if no two neighbours would have merged differently, and each prefix has one such path; so the same
    tables are filled, with neighbours that fit scoring 0 and others nothing. A space stands for the word mark, so a
    mark in a text has no piece and falls back to bytes: decoding is exact for every text.
    """

    keys: np.ndarray
    ids: np.ndarray
    scores: np.ndarray
    bytes_: np.ndarray
    offsets: np.ndarray
    byte_ids: np.ndarray
    longest: int
    joined: np.ndarray  # bytes that occur in pieces of several bytes; the others are words of their own
    merges: bool
    time: np.ndarray  # when a piece is merged; -1 for characters and bytes
    left: np.ndarray
    right: np.ndarray
    pairs: np.ndarray  # sorted keys of pairs that merge, and when
    pair_time: np.ndarray

    @staticmethod
    def load(path: str = MODEL) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        raw, normal, byte_ids = [], [], np.full(256, -1, np.int32)
        for i in range(n):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:5], 16)
                byte_ids[value] = i
                raw.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                raw.append(b"")
            else:
                raw.append(model.id_to_piece(i).replace(MARK, " ").encode())
                normal.append(i)
        if (byte_ids < 0).any():
            raise ValueError("the vocabulary has no byte pieces, so not every text could be encoded")
        score = np.array([model.get_score(i) for i in normal])
        merges = bool((score == np.round(score)).all() and score.min() < -1000)  # a merge list scores minus its ranks
        time, left, right = np.full(n, -1, np.int64), np.arange(n), np.arange(n)
        pairs: dict[tuple[int, int], int] = {}
        if merges:
            named = {raw[i].decode(): i for i in normal}
            rank = {s: r for r, s in enumerate(sorted({-s for s in score}))}
            when = {i: rank[-s] for i, s in zip(normal, score, strict=True)}
            reached = []
            for word, i in named.items():
                if len(word) > 1:
                    pairs |= {(named[word[:k]], named[word[k:]]): when[i] for k in range(1, len(word)) if word[:k] in named and word[k:] in named}
            for word, i in named.items():
                last = _last_merge(word, named, when, pairs)
                if last is not None:
                    reached.append(i)
                    if len(word) > 1:
                        time[i], (left[i], right[i]) = when[i], last
            keep = np.isin(normal, reached)
            normal, score = [i for i, k in zip(normal, keep, strict=True) if k], np.zeros(int(keep.sum()))
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        data = np.frombuffer(b"".join(raw), np.uint8)
        at = np.array(normal)
        h = SliceHash(data)(offsets[at], offsets[at + 1])
        order = np.argsort(h)
        if len(np.unique(h)) != len(h):
            raise ValueError("two pieces share a hash")
        joined = np.zeros(256, bool)
        for i in normal:
            if len(raw[i]) > 1:
                joined[list(raw[i])] = True
        a, b, t = (np.array(x, np.int64) for x in (zip(*[(a, b, t) for (a, b), t in pairs.items()], strict=True) if pairs else ([], [], [])))
        key = _pair_key(a, b)
        by = np.argsort(key)
        return Pieces(h[order], at[order].astype(np.int32), score[order], data, offsets, byte_ids, int(np.diff(offsets).max()), joined, merges, time, left, right, key[by], t[by])

    def fit(self, a: np.ndarray, b: np.ndarray, seen: Index) -> np.ndarray:
        """Whether merging leaves the border between pieces a and b: their last merges are undone in turn, newest first,
        and at no time may the two that then met have merged with each other."""
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), NEVER)
        while len(live):
            met = np.full(len(live), NEVER)
            i, k = seen.probe(_pair_key(a, b))
            met[i] = self.pair_time[k]
            bad = met < limit
            good[live[bad]] = False
            ta, tb = self.time[a], self.time[b]
            undo = ta > tb
            limit = np.where(undo, ta, tb + 1)
            a, b = np.where(undo, self.right[a], a), np.where(undo, b, self.left[b])
            on = ~bad & ((ta >= 0) | (tb >= 0))
            live, a, b, limit = live[on], a[on], b[on], limit[on]
        return good

    def viterbi(self, data: np.ndarray, odd: np.ndarray, hashed: SliceHash, seen: tuple[Index, Index], start: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, tokens of each word) of words data[start:start+size]; all words advance one byte at a time.

        odd: bytes of characters without a piece."""
        n = len(start)
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0
        step = np.ones((n, size + 1), np.int32)
        piece = np.zeros((n, size + 1), np.int32)
        row = np.arange(n)
        every = start[:, None] + np.arange(size + 1)
        prefix, down = hashed.prefix[every], hashed.down[every]
        for end in range(1, size + 1):
            first = max(0, end - self.longest)
            maybe, where = seen[0].probe(mixed((prefix[:, end, None] - prefix[:, first:end]) * down[:, first:end]).ravel())
            if self.merges:
                r, c = np.divmod(maybe, end - first)
                c += first
                open_ = np.isfinite(best[r, c])
                maybe, where, r, c = maybe[open_], where[open_], r[open_], c[open_]
                inner = np.flatnonzero(c > 0)
                good = np.ones(len(c), bool)
                good[inner] = self.fit(piece[r[inner], c[inner]], self.ids[where[inner]], seen[1])
                maybe, where = maybe[good], where[good]
            gain = np.full((n, end - first), -np.inf)
            gain.ravel()[maybe] = self.scores[where]
            found = np.zeros((n, end - first), np.int32)
            found.ravel()[maybe] = self.ids[where]
            total = best[:, first:end] + gain
            pick = total.argmax(axis=1)  # the first of equals, which is the longest piece
            top = total[row, pick]
            fall = np.where(odd[start + end - 1], best[:, end - 1] + BYTE_SCORE, -np.inf)
            use = top > fall
            best[:, end] = np.where(use, top, fall)
            step[:, end] = np.where(use, end - first - pick, 1)
            piece[:, end] = np.where(use, found[row, pick], self.byte_ids[data[start + end - 1]])
        at = np.full(n, size)
        rows, tokens = [], []
        live = np.arange(n)
        while len(live):
            tokens.append(piece[live, at[live]])
            rows.append(live)
            at[live] -= step[live, at[live]]
            live = live[at[live] > 0]
        rows, tokens = np.concatenate(rows), np.concatenate(tokens)
        order = np.lexsort((-np.arange(len(rows)), rows))  # last token was found first
        return tokens[order], np.bincount(rows, minlength=n)

    def solve(self, buf: np.ndarray, hashed: SliceHash, start: np.ndarray, sizes: np.ndarray, seen: tuple[Index, Index]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, tokens of each word) of distinct words, those of equal length together."""
        head = np.flatnonzero((buf & 0xC0) != 0x80)
        wide = np.diff(np.append(head, len(buf)))
        known = np.zeros(len(head), bool)
        known[seen[0].probe(hashed(head, head + wide))[0]] = True
        odd = np.repeat(~known, wide) if len(head) and head[0] == 0 else np.ones(len(buf), bool)
        order = np.argsort(sizes, kind="stable")
        bounds = np.flatnonzero(np.append(True, np.diff(sizes[order]) > 0))
        parts, counts = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for lo, hi in zip(bounds, np.append(bounds[1:], len(order)), strict=True):
            one = int(sizes[order[lo]])
            block = max(1, CELLS // (min(one, self.longest) * 4 + one))
            for k in range(lo, hi, block):
                t, c = self.viterbi(buf, odd, hashed, seen, start[order[k : min(hi, k + block)]], one)
                parts.append(t)
                counts.append(c)
        tokens, count = np.concatenate(parts), np.empty(len(order), np.int64)
        count[order] = np.concatenate(counts)
        begin = np.empty(len(order), np.int64)
        begin[order] = np.cumsum(count[order]) - count[order]
        return tokens[ranges(begin, count)], count

    def encode(self, data: np.ndarray, off: np.ndarray, kept: Kept) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, offsets) of texts; a text that is not empty gets a space in front, as the mark of its first word."""
        n = len(off) - 1
        size = np.diff(off)
        lead = (size > 0).astype(np.int64)
        to = np.concatenate([[0], np.cumsum(size + lead)])
        buf = np.full(int(to[-1]), 32, np.uint8)
        buf[ranges(to[:-1] + lead, size)] = data
        if not len(buf):
            return np.empty(0, np.int32), np.zeros(n + 1, np.int64)
        space, own = buf == 32, ~self.joined[buf]
        own[buf >= 128] = False  # a character stays whole
        first = own.copy()
        first[1:] |= own[:-1] | (space[1:] & ~space[:-1])
        first[to[:-1][lead > 0]] = True
        start = np.flatnonzero(first)
        length = np.diff(np.append(start, len(buf)))
        hashed = SliceHash(buf)
        names, at, word = np.unique(hashed(start, start + length) ^ (length.astype(np.uint64) << np.uint64(40)), return_index=True, return_inverse=True)
        begin, count = kept.words(self, names, lambda new: self.solve(buf, hashed, start[at[new]], length[at[new]], kept.seen))
        out = kept.tokens[ranges(begin[word], count[word])]
        before = np.concatenate([[0], np.cumsum(count[word])])
        return out, before[np.searchsorted(start, to)]

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of token lists, without the space in front; ids that stand for no text give none."""
        size = np.diff(self.offsets)[ids]
        data = self.bytes_[ranges(self.offsets[ids], size)]
        to = np.concatenate([[0], np.cumsum(size)])[off]
        keep = np.ones(len(data), bool)
        lead = np.diff(to) > 0
        keep[to[:-1][lead]] = False
        return data[keep], to - np.concatenate([[0], np.cumsum(lead)])


def _last_merge(word: str, named: dict[str, int], when: dict[int, int], pairs: dict[tuple[int, int], int]) -> tuple[int, int] | None:
    """The two pieces whose merge makes the word, if merging its characters makes it; a character is made of itself."""
    if any(c not in named for c in word):
        return None
    parts = [named[c] for c in word]
    last = (parts[0], parts[0]) if len(parts) == 1 else None
    texts = list(word)
    while len(parts) > 1:
        t, k = min((pairs.get(p, NEVER), k) for k, p in enumerate(zip(parts, parts[1:], strict=False)))
        if t == NEVER:
            return None
        last = parts[k], parts[k + 1]
        texts[k : k + 2] = [texts[k] + texts[k + 1]]
        parts[k : k + 2] = [named[texts[k]]]
    return last


class Kept:
    """Filters of a vocabulary, and the pieces of the words that this worker has met, by their 64-bit hashes."""

    def __init__(self, pieces: Pieces):
        self.seen = Index(pieces.keys), Index(pieces.pairs)
        self.clear()

    def clear(self) -> None:
        self.names, self.begin, self.count, self.tokens = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def words(self, pieces: Pieces, names: np.ndarray, solve) -> tuple[np.ndarray, np.ndarray]:
        if len(self.names) > KEPT_WORDS:
            self.clear()
        at = np.searchsorted(self.names, names)
        old = np.zeros(len(names), bool)
        inside = at < len(self.names)
        old[inside] = self.names[at[inside]] == names[inside]
        new = np.flatnonzero(~old)
        if len(new):
            tokens, count = solve(new)
            begin = len(self.tokens) + np.cumsum(count) - count
            self.tokens = np.concatenate([self.tokens, tokens])
            self.names, self.begin, self.count = (np.insert(x, at[new], y) for x, y in ((self.names, names[new]), (self.begin, begin), (self.count, count)))
            at = np.searchsorted(self.names, names)
        return self.begin[at], self.count[at]

    @staticmethod
    def of(pieces: Pieces) -> Kept:
        """This worker process's own, shared by its tasks."""
        state = worker_state()
        name = hashlib.sha256(pieces.bytes_.tobytes() + pieces.scores.tobytes()).hexdigest()
        if getattr(state, "name", None) != name:
            state.name, state.kept = name, Kept(pieces)
        return state.kept


def encode_pieces(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array of int), n_bytes, n_tokens, ids_sha256 (of little-endian 32-bit ids), exact (decoding gives the text).

    Null and empty texts have no ids. Words are told apart by 64-bit hashes inside one chunk; `exact` compares the
    decoded bytes with the text. Repeated rows are returned each; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        kept = Kept.of(pieces)
        for batch in batches:
            for part, data, off in chunks(batch, "text", WIDE_CHUNK_BYTES):
                ids, at = pieces.encode(data, off, kept)
                back, to = pieces.decode(ids, at)
                same = np.diff(to) == np.diff(off)
                if len(back) != len(data) or not np.array_equal(back, data):
                    same &= np.array([np.array_equal(back[to[i] : to[i + 1]], data[off[i] : off[i + 1]]) for i in range(len(off) - 1)], bool)
                raw = ids.astype("<i4").tobytes()
                yield pa.record_batch(
                    {
                        "id": part.column("id"),
                        "ids": pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)),
                        "n_bytes": pa.array(np.diff(off)),
                        "n_tokens": pa.array(np.diff(at)),
                        "ids_sha256": pa.array([hashlib.sha256(raw[4 * at[i] : 4 * at[i + 1]]).hexdigest() for i in range(len(off) - 1)], pa.string()),
                        "exact": pa.array(same),
                    }
                )

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(run), f"id {kind}, ids array<int>, n_bytes long, n_tokens long, ids_sha256 string, exact boolean")
    return out.withColumnRenamed("id", id_col)


def decode_pieces(rows: DataFrame, pieces: Pieces, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text of token lists; null lists give an empty text."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            lists = batch.column("ids")
            off = lists.offsets.to_numpy().astype(np.int64)
            data, to = pieces.decode(lists.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]], off - off[0])
            text = [data[to[i] : to[i + 1]].tobytes().decode("utf-8", "replace") for i in range(len(to) - 1)]
            yield pa.record_batch({"id": batch.column("id"), "text": pa.array(text, pa.string())})

    ids = F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>"))
    out = rows.select(F.col(id_col).alias("id"), ids.alias("ids")).mapInArrow(lean(run), f"id {kind}, text string")
    return out.withColumnRenamed("id", id_col)
