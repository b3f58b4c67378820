"""Text functions as column expressions: tokens, answers, phrases, the generation grammar, rendered prompts."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
WORD = r"[\p{L}\p{N}_]+"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = ("a", "an", "the")
STATES = ("C", "D", "M")
SLOTS = 20
SENTINEL = "INSUFFICIENT_EVIDENCE"
CONTROL_TOKENS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>")
REFUSAL = "U | evidence=[] | answer=INSUFFICIENT_EVIDENCE"
PROMPT_HEAD = (
    "Use only the paragraph registry to answer the question. Select the complete set of supporting paragraph IDs.\n"
    "Return exactly one line in one of these forms:\n"
    "S | evidence=[P00,P01] | answer=<answer>\n"
    "U | evidence=[] | answer=INSUFFICIENT_EVIDENCE\n\n"
)
GRAMMAR = (
    r"\A[ \t]*([SU])[ \t]*\|[ \t]*evidence[ \t]*=[ \t]*\[([ \t]*(?:P(?:0[0-9]|1[0-9])(?:[ \t]*,[ \t]*P(?:0[0-9]|1[0-9]))*)?[ \t]*)\]"
    r"[ \t]*\|[ \t]*answer[ \t]*=[ \t]*([^|\r\n]*?)[ \t]*\z"
)


def tokens(x) -> Column:
    """Words of lowered text in order, repeats kept; exact for text that compatibility normalization leaves alone."""
    return F.regexp_extract_all(F.replace(F.lower(x), F.lit("ß"), F.lit("ss")), F.lit(WORD), F.lit(0))


@F.pandas_udf(T.ArrayType(T.StringType()))
def exact_tokens(x: pd.Series) -> pd.Series:
    """The same for any text: compatibility-normalized and case-folded."""
    return x.map(lambda s: None if s is None else re.findall(r"\w+", unicodedata.normalize("NFKC", s).casefold()))


def normalized(x) -> Column:
    return F.array_join(tokens(x), " ")


def token_set(x) -> Column:
    return F.array_distinct(tokens(x))


def jaccard(a, b) -> Column:
    """Of two arrays without repeats; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def contains_phrase(words, phrase) -> Column:
    """Whether an array of words holds another as neighbours; never for an empty one."""
    pad = lambda a: F.concat(F.lit(" "), F.array_join(a, " "), F.lit(" "))
    return (F.size(phrase) > 0) & (F.instr(pad(words), pad(phrase)) > 0)


def leaks(words, phrases) -> Column:
    return F.exists(phrases, lambda p: contains_phrase(words, p))


def forbidden_phrases(answer, *lists) -> Column:
    """Distinct token lists of an answer, its aliases and sub-answers, without empty ones."""
    every = F.concat(F.array(answer), *lists)
    return F.array_distinct(F.filter(F.transform(every, tokens), lambda t: F.size(t) > 0))


def normalize_answer(x) -> Column:
    """Lower case; punctuation deleted; articles dropped; white space collapsed, in this order."""
    bare = F.translate(F.lower(x), PUNCTUATION, "")
    bare = F.regexp_replace(bare, rf"(?U)\b({'|'.join(ARTICLES)})\b", " ")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def _bag(x) -> Column:
    return F.filter(F.split(x, " "), lambda t: t != "")


def _times(array, value) -> Column:
    return F.size(F.filter(array, lambda t: t == value))


def _f1(shared, n_a, n_b) -> Column:
    return F.coalesce(F.try_divide(2.0 * shared, n_a + n_b), F.lit(0.0))


def answer_exact(prediction, gold) -> Column:
    return (normalize_answer(prediction) == normalize_answer(gold)).cast("double")


def bag_f1(p, g) -> Column:
    """F1 of two bags of words; 1 if both are empty, 0 if one is."""
    shared = F.aggregate(F.array_distinct(g), F.lit(0), lambda n, t: n + F.least(_times(g, t), _times(p, t)))
    return F.when((F.size(p) == 0) | (F.size(g) == 0), (F.size(p) == F.size(g)).cast("double")).otherwise(_f1(shared, F.size(p), F.size(g)))


def answer_f1(prediction, gold) -> Column:
    return bag_f1(_bag(normalize_answer(prediction)), _bag(normalize_answer(gold)))


def best_answer(prediction, golds) -> Column:
    """Struct of the largest exact match and the largest F1 over all accepted answers, each on its own."""
    return F.struct(F.array_max(F.transform(golds, lambda g: answer_exact(prediction, g))).alias("em"), F.array_max(F.transform(golds, lambda g: answer_f1(prediction, g))).alias("f1"))


def support_scores(prediction, gold) -> Column:
    """Struct em, f1, precision, recall of two sets of slots; both empty: em and f1 are 1, the others 0."""
    p, g = F.array_distinct(prediction), F.array_distinct(gold)
    n = F.size(F.array_intersect(p, g))
    both = (F.size(p) == 0) & (F.size(g) == 0)
    same = (F.size(p) == F.size(g)) & (n == F.size(g))
    part = lambda k: F.coalesce(F.try_divide(n, k), F.lit(0.0))
    return F.struct(
        same.cast("double").alias("em"),
        F.when(both, 1.0).otherwise(_f1(n, F.size(p), F.size(g))).alias("f1"),
        part(F.size(p)).alias("precision"),
        part(F.size(g)).alias("recall"),
    )


def parse_prediction(x) -> Column:
    """Struct valid, status, support, answer, error of one generated line; nothing is repaired. A null is not a string."""
    support = F.transform(F.regexp_extract_all(F.regexp_extract(x, GRAMMAR, 2), F.lit(r"P(\d\d)"), F.lit(1)), lambda t: t.cast("int"))
    answer = F.regexp_replace(F.regexp_extract(x, GRAMMAR, 3), r"(?U)^\s+|\s+$", "")
    yes = F.regexp_extract(x, GRAMMAR, 1) == "S"
    error = (
        F.when(x.isNull(), "prediction_not_string")
        .when(~x.rlike(GRAMMAR), "grammar_mismatch")
        .when(support != F.array_sort(F.array_distinct(support)), "evidence_not_unique_strictly_sorted")
        .when(answer == "", "empty_answer")
        .when(yes & (F.size(support) == 0), "answerable_without_evidence")
        .when(yes & (answer == SENTINEL), "answerable_with_sentinel")
        .when(~yes & (F.size(support) > 0), "unanswerable_with_evidence")
        .when(~yes & (answer != SENTINEL), "unanswerable_without_sentinel")
    )
    ok = error.isNull()
    return F.struct(
        ok.alias("valid"),
        F.when(ok, F.regexp_extract(x, GRAMMAR, 1)).alias("status"),
        F.when(ok, support).otherwise(F.array().cast("array<int>")).alias("support"),
        F.when(ok, answer).otherwise("").alias("answer"),
        error.alias("error"),
    )


def one_line(x) -> Column:
    """White space collapsed; raises on blank text and on chat control tokens."""
    bad = F.trim(F.regexp_replace(x, r"(?U)\s+", " ")) == ""
    for token in CONTROL_TOKENS:
        bad = bad | F.contains(x, F.lit(token))
    clean = F.trim(F.regexp_replace(x, r"(?U)\s+", " "))
    return F.when(bad | x.isNull(), F.raise_error(F.lit("a field is blank or has a control token"))).otherwise(clean)


def slot_name(i) -> Column:
    return F.format_string("P%02d", i)


def ordered(paragraphs) -> Column:
    """In slot order, equal slots as they came; what is in order already is not compared one by one."""
    slots = F.transform(paragraphs, lambda p: p["idx"])
    return F.when(slots == F.array_sort(slots), paragraphs).otherwise(F.array_sort(paragraphs, lambda a, b: a["idx"] - b["idx"]))


def render_prompt(question, paragraphs, slots=SLOTS) -> Column:
    """The prompt; raises unless the paragraphs are exactly slots 0, 1, ... in order."""
    right = F.transform(paragraphs, lambda p: p["idx"]) == F.sequence(F.lit(0), (F.lit(slots) if isinstance(slots, int) else slots) - 1)
    lines = F.transform(paragraphs, lambda p: F.concat(F.lit("["), slot_name(p["idx"]), F.lit("] "), one_line(p["title"]), F.lit(": "), one_line(p["paragraph_text"])))
    text = F.concat(F.lit(PROMPT_HEAD), F.lit("Question: "), one_line(question), F.lit("\nParagraph registry:\n"), F.array_join(lines, "\n"))
    return F.when(right, text).otherwise(F.raise_error(F.lit("paragraphs must be the slots in order")))


def render_target(support, answer) -> Column:
    """The supported answer line; raises on slots that are none, repeated, unsorted or out of range, and on reserved signs."""
    good = (F.size(support) > 0) & F.forall(support, lambda i: (i >= 0) & (i < SLOTS)) & (support == F.array_sort(F.array_distinct(support))) & ~answer.rlike(r"[|\n\r]")
    line = F.concat(F.lit("S | evidence=["), F.array_join(F.transform(support, slot_name), ","), F.lit("] | answer="), one_line(answer))
    return F.when(good, line).otherwise(F.raise_error(F.lit("the target cannot be written")))


def render_state(state, question, paragraphs, support, answer) -> Column:
    """Struct prompt, completion; an unanswerable state gets the fixed refusal and sees no gold field."""
    return F.struct(render_prompt(question, paragraphs).alias("prompt"), F.when(state == "M", F.lit(REFUSAL)).otherwise(render_target(support, answer)).alias("completion"))
