"""Numbers of paragraph sets, as expressions over arrays; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import jaccard, tokens

# Names and order of the feature vectors.
SURFACE = (
    "document_count", "total_characters", "mean_document_characters", "std_document_characters", "min_document_characters", "max_document_characters",
    "total_word_tokens", "mean_document_tokens", "std_document_tokens", "mean_title_tokens", "std_title_tokens", "exact_title_duplicate_fraction",
    "exact_text_duplicate_fraction", "mean_pairwise_title_jaccard", "mean_pairwise_text_jaccard", "digit_character_fraction", "punctuation_character_fraction", "slot_length_slope",
)
SEMANTIC = (*SURFACE, "question_document_jaccard_mean", "question_document_jaccard_max", "question_document_jaccard_top2_sum", "question_title_jaccard_max", "question_overlap_document_fraction")


def total(a) -> Column:
    return F.aggregate(F.transform(a, lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x)


def mean(a) -> Column:
    return F.coalesce(F.try_divide(total(a), F.size(a)), F.lit(0.0))


def let(value, body) -> Column:
    """body(value) with the value computed once: a lambda's variable is bound, an expression would be repeated."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def std(a) -> Column:
    """Population standard deviation; 0 of nothing."""
    return let(a, lambda v: let(mean(v), lambda m: F.sqrt(mean(F.transform(v, lambda x: F.pow(x - m, F.lit(2)))))))


def median(a) -> Column:
    s, n = F.array_sort(F.transform(a, lambda x: x.cast("double"))), F.size(a)
    return (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2).cast("int") + 1)) / 2


def duplicate_fraction(a) -> Column:
    """Equal unordered pairs over all pairs, from the counts of the distinct values."""
    times = lambda v, x: F.size(F.filter(v, lambda y: y == x))
    pairs = lambda v: total(F.transform(F.array_distinct(v), lambda x: let(times(v, x), lambda k: k * (k - 1) / 2)))
    return let(a, lambda v: F.coalesce(F.try_divide(pairs(v), F.size(v) * (F.size(v) - 1) / 2), F.lit(0.0)))


def mean_pairwise_jaccard(sets) -> Column:
    def of(v):
        n = F.size(v)
        pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: let(F.get(v, i), lambda x: F.transform(F.slice(v, i + 2, F.greatest(n - 1 - i, F.lit(0))), lambda y: jaccard(x, y)))))
        return F.when(n < 2, 0.0).otherwise(mean(pairs))

    return let(sets, of)


def slope(a) -> Column:
    """Least-squares slope of values over their places."""
    def of(v, avg):
        mid = (F.size(v) - 1) / 2.0
        up = total(F.transform(v, lambda x, i: (i - mid) * (x - avg)))
        return F.coalesce(F.try_divide(up, total(F.transform(v, lambda x, i: F.pow(i - mid, F.lit(2))))), F.lit(0.0))

    return let(a, lambda v: let(mean(v), lambda avg: of(v, avg)))


def _hashes(words) -> Column:
    return F.array_distinct(F.transform(words, lambda t: F.xxhash64(t)))


def measured(p) -> Column:
    """What the features need of a paragraph: sets of 64-bit word hashes, hashes of the normalized texts, counts."""
    def of(title, body, whole):
        count = lambda pattern: F.regexp_count(whole, F.lit(pattern))
        words = tokens(whole)
        return F.struct(
            F.length(whole).cast("double").alias("chars"), F.size(words).alias("count"), _hashes(words).alias("words"), _hashes(title).alias("title_words"), _hashes(body).alias("text_words"),
            F.xxhash64(F.array_join(title, " ")).alias("title"), F.xxhash64(F.array_join(body, " ")).alias("text"), count(r"[\p{Nd}²³¹⁰-⁹₀-₉]").alias("digits"), count(r"\p{Punct}").alias("puncts"),
        )

    return let(tokens(p["title"]), lambda t: let(tokens(p["paragraph_text"]), lambda b: let(F.concat_ws(" ", p["title"], p["paragraph_text"]), lambda w: of(t, b, w))))


def measure_all(paragraphs) -> Column:
    return F.transform(paragraphs, measured)


def _size_of(field: str):
    return lambda p: F.size(p[field]).cast("double")


def surface_of(m) -> Column:
    """The 18 numbers of SURFACE of measured paragraphs; word counts are of distinct words."""
    chars = F.transform(m, lambda p: p["chars"])
    words, titles = (F.transform(m, _size_of(f)) for f in ("words", "title_words"))
    size = F.greatest(total(chars), F.lit(1.0))
    part = lambda f: total(F.transform(m, lambda p: p[f])) / size
    return F.array(
        F.size(m).cast("double"), total(chars), mean(chars), std(chars), F.coalesce(F.array_min(chars), F.lit(0.0)), F.coalesce(F.array_max(chars), F.lit(0.0)),
        total(words), mean(words), std(words), mean(titles), std(titles), duplicate_fraction(F.transform(m, lambda p: p["title"])), duplicate_fraction(F.transform(m, lambda p: p["text"])),
        mean_pairwise_jaccard(F.transform(m, lambda p: p["title_words"])), mean_pairwise_jaccard(F.transform(m, lambda p: p["text_words"])), part("digits"), part("puncts"), slope(chars),
    )


def extras_of(question, m) -> Column:
    """The five numbers that SEMANTIC has beyond SURFACE, of a set of word hashes and measured paragraphs."""
    def of(over, titles):
        return F.array(
            mean(over), F.coalesce(F.array_max(over), F.lit(0.0)), total(F.slice(F.sort_array(over, asc=False), 1, 2)), F.coalesce(F.array_max(titles), F.lit(0.0)),
            F.size(F.filter(over, lambda x: x > 0)) / F.greatest(F.size(over), F.lit(1)),
        )

    return let(F.transform(m, lambda p: jaccard(question, p["words"])), lambda o: let(F.transform(m, lambda p: jaccard(question, p["title_words"])), lambda t: of(o, t)))


def question_hashes(question) -> Column:
    return _hashes(tokens(question))


def surface_features(paragraphs) -> Column:
    return let(measure_all(paragraphs), surface_of)


def semantic_extras(question, paragraphs) -> Column:
    return let(question_hashes(question), lambda q: let(measure_all(paragraphs), lambda m: extras_of(q, m)))


def semantic_features(question, paragraphs) -> Column:
    return F.concat(surface_features(paragraphs), semantic_extras(question, paragraphs))


def feature_distance(a, b) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y) / (1.0 + F.abs(x) + F.abs(y))))


def length_ratio(a, b) -> Column:
    return F.greatest(a, b) / F.least(a, b)


def nearest_rank(values, fraction: float) -> Column:
    """sorted[ceil(fraction * n)] counted from 1; 0 of nothing."""
    n = F.size(values)
    return F.when(n == 0, F.lit(0)).otherwise(F.element_at(F.array_sort(values), F.greatest(F.least(F.ceil(F.lit(fraction) * n).cast("int"), n), F.lit(1))))


def cosine_rate(step, peak: float = 2e-4, warm: int = 8, steps: int = 240) -> Column:
    """Linear warm-up, then half a cosine down to 0."""
    progress = (step - warm) / (steps - warm)
    return F.when(step < warm, peak * step / warm).otherwise(peak * 0.5 * (1 + F.cos(F.pi() * progress)))


def close(a, b, relative: float = 1e-9, absolute: float = 1e-12) -> Column:
    return F.abs(a - b) <= F.greatest(relative * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))
