"""Quality classifier: histogram gradient-boosted trees over document statistics, flattened for numpy traversal."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SliceHash, chunks, crc_mod, lean, others, restored, words

#: Labelled rows that the fit takes at most (expected number of a hash-chosen sample).
TRAIN_ROWS = 20_000
BINS, TREES, DEPTH, RATE, MIN_HESSIAN, RIDGE = 64, 120, 5, 0.1, 4.0, 1.0
THRESHOLD = 0.3

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#$%&*@^~<>=+_\\{}[]"]] = True
#: Classes of bytes whose shares are features.
KINDS = ("other", "non_ascii", "digit", "upper", "symbol", "pipe", "stop", "comma", "newline", "punct")
CLASS = np.zeros(256, np.int64)
for _k, _on in enumerate(
    [
        lambda c: c >= 128,
        lambda c: chr(c).isdigit() and c < 128,
        lambda c: 65 <= c <= 90,
        lambda c: SYMBOL[c],
        lambda c: c == 124,
        lambda c: c == 46,
        lambda c: c == 44,
        lambda c: c == 10,
        lambda c: 32 < c < 127 and not chr(c).isalnum() and not SYMBOL[c] and c not in (124, 46, 44),
    ]
):
    CLASS[[c for c in range(256) if _on(c)]] = _k + 1
FEATURES = (
    "log_bytes", "log_words", "word_length", "longest_word", "non_ascii", "digits", "upper", "symbols", "pipes", "stops", "commas", "newlines",
    "other_punct", "repeated_next", "distinct_words", "distinct_pairs", "top_word", "symbol_words", "short_words", "one_pipe_words",
    "log_lines", "duplicate_lines", "line_length", "stops_a_word", "capital_words", "longest_repeat",
)


def group_max(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Largest value of each document (sorted), 0 without one."""
    out = np.zeros(n)
    if len(doc):
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        out[doc[first]] = np.maximum.reduceat(values, first)
    return out


def distinct(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of distinct values, largest number of one value) for each document."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    bits = np.uint64(max(1, int(n).bit_length()))
    key = np.sort((doc.astype(np.uint64) << (np.uint64(64) - bits)) | (h >> bits))
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    d = (key[first] >> (np.uint64(64) - bits)).astype(np.int64)
    return np.bincount(d, minlength=n).astype(float), group_max(np.diff(np.append(first, len(key))), d, n)


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text; an empty text has zeros."""
    n = len(off) - 1
    size = np.maximum(1, np.diff(off)).astype(float)
    hashed = SliceHash(data)

    kind = np.bincount(np.repeat(np.arange(n) * len(KINDS), np.diff(off)) + CLASS[data], minlength=n * len(KINDS)).reshape(n, len(KINDS))
    share = dict(zip(KINDS, (kind / size[:, None]).T, strict=True))
    start, end, doc = words(~SPACE[data], off)
    count = np.bincount(doc, minlength=n)
    per = np.maximum(1, count)
    h = hashed(start, end)
    length = end - start
    longest = group_max(length, doc, n)
    next_same = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    by = np.bincount(doc[1:][next_same], minlength=n)
    run_start = np.flatnonzero(np.append(True, ~next_same)) if len(h) else np.empty(0, np.int64)
    run = group_max(np.diff(np.append(run_start, len(h))), doc[run_start], n)
    kinds, top = distinct(doc, h, n)
    inside = doc[1:] == doc[:-1]
    pairs, _ = distinct(doc[1:][inside], (h[1:] * np.uint64(3) + h[:-1])[inside], n)
    last, head = data[end - 1], data[start]
    line_start, line_end, line_doc = words(data != 10, off)
    lines = np.bincount(line_doc, minlength=n)
    line_kinds, _ = distinct(line_doc, hashed(line_start, line_end), n)
    columns = [
        np.log1p(np.diff(off)), np.log1p(count), np.bincount(doc, length, n) / per, np.log1p(longest), share["non_ascii"], share["digit"],
        share["upper"], share["symbol"], share["pipe"], share["stop"], share["comma"], share["newline"], share["punct"],
        by / per, kinds / per, pairs / np.maximum(1, count - 1), top / per, np.bincount(doc, SYMBOL[last], n) / per, np.bincount(doc, length <= 3, n) / per,
        np.bincount(doc, (length == 1) & (head == 124), n) / per, np.log1p(lines), 1 - line_kinds / np.maximum(1, lines), size / np.maximum(1, lines),
        kind[:, KINDS.index("stop")] / per, np.bincount(doc, (head >= 65) & (head <= 90), n) / per, np.log1p(run),
    ]
    return np.column_stack(columns).astype(np.float32)


@dataclass(frozen=True)
class Trees:
    """Complete binary trees side by side: feature, threshold and value of node i of tree t; children 2i+1 and 2i+2."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        row = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[row, feature[node]] > threshold[node])
            total += value[node]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic loss, quantile bins, level-wise growth; without rows of both labels the score is the label's share."""
    n, f = x.shape if x.ndim == 2 else (0, len(FEATURES))
    p = (y.sum() + 1) / (n + 2)
    bias = float(np.log(p / (1 - p)))
    nodes = 2 ** (DEPTH + 1) - 1
    feature, threshold, value = np.zeros((TREES, nodes), np.int64), np.full((TREES, nodes), np.inf, np.float32), np.zeros((TREES, nodes))
    if n == 0 or y.min() == y.max():
        return Trees(feature[:0], threshold[:0], value[:0], bias)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1]).astype(np.float32)) for j in range(f)]
    binned = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
    flat = binned + np.arange(f) * BINS
    raw = np.full(n, bias)
    for t in range(TREES):
        q = 1 / (1 + np.exp(-raw))
        g, h = q - y, q * (1 - q)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (f * BINS) + flat).ravel()
            hist = [np.bincount(at, np.repeat(w, f), width * f * BINS).reshape(width, f, BINS).cumsum(axis=2) for w in (g, h)]
            all_g, all_h = hist[0][:, :1, -1:], hist[1][:, :1, -1:]
            gain = hist[0] ** 2 / (hist[1] + RIDGE) + (all_g - hist[0]) ** 2 / (all_h - hist[1] + RIDGE) - all_g**2 / (all_h + RIDGE)
            gain[(hist[1] < MIN_HESSIAN) | (all_h - hist[1] < MIN_HESSIAN)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            good = gain.reshape(width, -1).max(axis=1) > 1e-9
            j, b = best // BINS, best % BINS
            split_bin = np.full(width, BINS)
            for k in np.flatnonzero(good):
                if b[k] < len(cuts[j[k]]):
                    feature[t, first + k], threshold[t, first + k], split_bin[k] = j[k], cuts[j[k]][b[k]], b[k]
            own = node - first
            node = 2 * node + 1 + (binned[np.arange(n), feature[t, node]] > split_bin[own])
        first = 2**DEPTH - 1
        leaf_g, leaf_h = np.bincount(node - first, g, 2**DEPTH), np.bincount(node - first, h, 2**DEPTH)
        value[t, first:] = -RATE * leaf_g / (leaf_h + RIDGE)
        raw += value[t, node]
    return Trees(feature, threshold, value, bias)


def _measure(extra: tuple[str, ...]):
    def run(batches):
        for batch in batches:
            for part, data, off in chunks(batch, "text"):
                x = statistics(data, off)
                yield pa.record_batch({**{c: part.column(c) for c in extra}, "x": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))})

    return run


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Trees:
    """Trees from a hash-chosen sample of about `rows` labelled ids (all if there are fewer); one label an id, the largest.

    Rows with a null id or label teach nothing. The ids of the sample are broadcast: their number is what `rows` bounds.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    n = known.count()
    part = int(min(1.0, rows / max(1, n)) * (1 << 20))
    sample = known.where(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 20)) < part)
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").select("text", F.col("label").cast("int").alias("label"))
    got = found.mapInArrow(lean(_measure(("label",))), "label int, x array<float>").toArrow()
    if not got.num_rows:
        return fit_trees(np.empty((0, len(FEATURES))), np.empty(0))
    x = got["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
    order = np.lexsort(x.T)  # the fit does not depend on the order in which executors answer
    return fit_trees(x[order], got["label"].to_numpy()[order].astype(float))


def score_quality(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Score of every row from its whole text, beside its id and the columns of `keep`; null counts as an empty text."""
    names = tuple(dict.fromkeys((id_col, *keep)))
    kinds = {c: docs.schema[c].dataType.simpleString() for c in names}

    def run(batches):
        for batch in batches:
            for part, data, off in chunks(batch, "__text"):
                yield pa.record_batch({**{f"c{i}": part.column(f"c{i}") for i in range(len(names))}, "__score": pa.array(model.score(statistics(data, off)))})

    inner = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], F.col(text_col).alias("__text"))
    out = inner.mapInArrow(lean(run), ", ".join(f"c{i} {kinds[c]}" for i, c in enumerate(names)) + ", __score double")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("__score").alias("score"))


def keep_good(docs: DataFrame, model: Trees, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that the model does not reject, all columns as they were."""

    def run(batches):
        for batch in batches:
            for part, data, off in chunks(batch, "text"):
                yield part.filter(pa.array(model.score(statistics(data, off)) >= threshold))

    rows = docs.select(others(docs, text_col).alias("doc"), F.col(text_col).alias("text"))
    return restored(rows.mapInArrow(lean(run), rows.schema), docs, text_col)


def contract_model(docs: DataFrame, labels: DataFrame) -> Trees:
    """Learns only from ids whose crc32 modulo 5 is not 0."""
    return fit_quality(docs, labels.where(crc_mod("doc_id", 5) != 0))


def judge_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_quality(docs, contract_model(docs, labels))
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
