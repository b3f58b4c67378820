"""Language identification by bit-sliced Bloom filters: one probe of an n-gram returns a bitmask of languages."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import chunks, crc_mod, lean, text_view

#: Bytes of an n-gram; letters are lowered first, runs of other ASCII bytes count as one space.
GRAM = 5
#: Training rows a language (expected number of a hash-chosen sample).
TRAIN_ROWS = 4000
#: Slots of a filter for each n-gram of the language that has most of them, and hash functions: a filter is full to about
#: a third at most, and takes 3 % of the n-grams that it does not hold.
SPREAD, HASHES = 8, 3
#: A language has a filter of the n-grams of each of these shares and more among its own: of all, and of the common ones,
#: since labels are not clean and a large enough sample holds nearly every n-gram of its neighbours once.
TIERS = (0.0, 2e-5)

FOLD = np.full(256, 32, np.uint8)
FOLD[65:91] = np.arange(97, 123)
FOLD[97:123] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)


@dataclass(frozen=True)
class LanguageFilters:
    languages: tuple[str, ...]
    masks: np.ndarray  # slots x words, a bit for each language and tier; slots are a power of two
    false_positive: np.ndarray  # share of random n-grams that each of these filters takes

    def probe(self, h: np.ndarray) -> np.ndarray:
        """Of each n-gram the bitmask of all languages that hold it, as words."""
        hit = self.masks[slots(h, len(self.masks))[0]]
        for s in slots(h, len(self.masks))[1:]:
            hit &= self.masks[s]
        return hit

    def bit(self, words: np.ndarray, which: int) -> np.ndarray:
        word, place = divmod(which, 8 * words.dtype.itemsize)
        return (words[:, word] >> words.dtype.type(place)) & words.dtype.type(1)


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every n-gram of folded bytes; runs of spaces are one, and each text starts and ends with one."""
    n = len(off) - 1
    length = np.diff(off) + 2
    at = np.cumsum(length) - length
    buf = np.full(int(length.sum()), 32, np.uint8)
    doc = np.repeat(np.arange(n), length)
    inner = np.ones(len(buf), bool)
    inner[at] = inner[at + length - 1] = False
    buf[inner] = FOLD[data]
    keep = np.ones(len(buf), bool)
    keep[1:] = (buf[1:] != 32) | (buf[:-1] != 32) | (doc[1:] != doc[:-1])
    buf, doc = buf[keep], doc[keep]
    m = len(buf) - GRAM + 1
    if m <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    value = np.zeros(m, np.uint64)
    for i in range(GRAM):
        value = (value << np.uint64(8)) | buf[i : m + i]
    same = doc[:m] == doc[GRAM - 1 :]
    return mix(value[same]), doc[:m][same]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def slots(h: np.ndarray, size: int) -> list[np.ndarray]:
    """The probed slots: two halves of the hash, combined."""
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return [((a + np.uint64(i) * b) & np.uint64(size - 1)).astype(np.int64) for i in range(HASHES)]


def filters(languages: tuple[str, ...], g: np.ndarray, lang: np.ndarray, count: np.ndarray) -> LanguageFilters:
    """Filters of distinct (n-gram, number of its language) with counts; their size follows from the largest language."""
    each = np.bincount(lang, minlength=len(languages)) if len(lang) else np.zeros(1, np.int64)
    share = count / np.bincount(lang, count)[lang] if len(lang) else count
    size = 1 << max(10, int(SPREAD * each.max() - 1).bit_length())
    many = len(languages) * len(TIERS)
    kind = next((t for t in (np.uint8, np.uint16, np.uint32) if many <= 8 * np.dtype(t).itemsize), np.uint64)
    width = 8 * np.dtype(kind).itemsize
    masks = np.zeros((size, max(1, -(-many // width))), kind)
    for i in range(many):
        language, tier = divmod(i, len(TIERS))
        for s in slots(g[(lang == language) & (share >= TIERS[tier])], size):
            masks[s, i // width] |= kind(1) << kind(i % width)
    model = LanguageFilters(languages, masks, np.zeros(0))
    fill = np.array([np.count_nonzero(model.bit(masks, i)) / size for i in range(many)])
    return LanguageFilters(languages, masks, fill**HASHES)


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> LanguageFilters:
    """Filters of all n-grams of a hash-chosen sample of about `rows` labelled rows a language (all if there are fewer).

    n-grams are counted on the executors; the distinct ones of the sample reach the driver, which `rows` bounds whatever
    the size of the corpus. Repeated rows count as often as they occur, null texts hold nothing. No labelled row: no language, and every prediction is `und`.
    """
    labelled = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, F.lit("train")).alias("h"))
    there = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    languages = tuple(sorted(there))
    if not languages:
        return filters((), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    most = F.element_at(F.create_map(*[x for k, n in there.items() for x in (F.lit(k), F.lit(min(1.0, rows / n)))]), F.col("lang"))
    sample = labelled.where(F.pmod("h", F.lit(1 << 20)) < most * (1 << 20)).select("lang", "text")

    def held(batches):
        for batch in batches:
            for part, data, off in chunks(batch, "text"):
                h, doc = grams(data, off)
                code = part.column("lang").dictionary_encode()
                lang = np.asarray(code.indices)[doc]
                for i, name in enumerate(code.dictionary.to_pylist()):
                    g, c = np.unique(h[lang == i], return_counts=True)
                    yield pa.record_batch({"lang": pa.array(np.full(len(g), languages.index(name), np.int32)), "g": pa.array(g.view(np.int64)), "c": pa.array(c.astype(np.int64))})

    pairs = sample.mapInArrow(lean(held), "lang int, g long, c long").groupBy("lang", "g").agg(F.sum("c").alias("c")).toArrow()
    return filters(languages, pairs["g"].to_numpy().view(np.uint64), pairs["lang"].to_numpy(), pairs["c"].to_numpy())


def predict_languages(docs: DataFrame, model: LanguageFilters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """lang_pred and score of every row, other columns unread.

    A language's count is the popcount of its bits over the document's n-grams, less the false positives that its
    filters' fill makes likely. The largest count wins (ties: the first name); the score is its share of all
    corrected counts, 1 / languages if none is positive. `und` with score 0 for null, or a text without a letter.
    The filters' size is bounded by the training sample, so they travel with the function. Repeated rows have equal
    results; an empty table has none.
    """
    names, fp = model.languages, model.false_positive
    ascii_letter = np.zeros(256, bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True

    def score(batches):
        for batch in batches:
            for part, data, off in chunks(batch, "text"):
                n = len(off) - 1
                h, doc = grams(data, off)
                hit = model.probe(h)
                total = np.bincount(doc, minlength=n)
                got = np.zeros((n, max(1, len(names))))
                for i in range(len(names) * len(TIERS)):
                    got[:, i // len(TIERS)] += np.maximum(0, (np.bincount(doc, model.bit(hit, i), minlength=n) - fp[i] * total) / (1 - min(fp[i], 0.999)))
                letters = np.add.reduceat(np.append(ascii_letter[data], False), np.minimum(off[:-1], len(data))) > 0 if n else np.empty(0, bool)
                letters &= np.diff(off) > 0
                for i in np.flatnonzero(~letters & (np.diff(off) > 0)):
                    letters[i] = any(map(str.isalpha, data[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace")))
                best = got.argmax(axis=1)
                whole = got.sum(axis=1)
                share = np.where(whole > 0, got[np.arange(n), best] / np.where(whole > 0, whole, 1), 1 / max(1, len(names)))
                known = letters & (len(names) > 0)
                pred = [names[b] if k else "und" for b, k in zip(best, known, strict=True)]
                yield pa.record_batch({"id": part.column("id"), "lang_pred": pa.array(pred, pa.string()), "score": pa.array(np.where(known, share, 0.0))})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(score), f"id {kind}, lang_pred string, score double")


def identify_languages(docs: DataFrame) -> DataFrame:
    """The contract's folds: learn where crc32(doc_id) mod 4 is not 2, predict every row. A null id counts as an empty one;
    repeated rows are all returned, other columns are not read, an empty table gives an empty result."""
    model = fit_languages(docs.where(crc_mod("doc_id", 4) != 2))
    out = predict_languages(docs, model).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
