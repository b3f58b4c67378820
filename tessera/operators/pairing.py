"""Pairs of answerable and unanswerable rows: one shuffle by id, then checks and an ordered eligibility decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.digest import sha, short_id
from tessera.functions.stats import let
from tessera.functions.text import SLOTS, contains_phrase, normalized, ordered, tokens


def header(rows: DataFrame) -> DataFrame:
    """Source rows with paragraphs in slot order and the supporting slots; what only pairs need is left to eligibility."""
    flagged = F.filter("paragraphs", lambda x: x["is_supporting"])
    return rows.withColumn("paragraphs", ordered(F.col("paragraphs"))).withColumn("support", F.array_sort(F.transform(flagged, lambda x: x["idx"])))


def text_hashes(paragraphs) -> Column:
    return F.array_distinct(F.transform(paragraphs, lambda x: sha(x["paragraph_text"])))


def support_hashes(paragraphs) -> Column:
    return text_hashes(F.filter(paragraphs, lambda x: x["is_supporting"]))


def held_subanswers(paragraphs, steps) -> Column:
    """Whether the paragraphs hold the answer of each step; their words are taken once for all steps."""
    whole = F.array_join(F.transform(paragraphs, lambda x: F.concat_ws(" ", x["title"], x["paragraph_text"])), " ")
    return let(tokens(whole), lambda words: F.transform(steps, lambda d: contains_phrase(words, tokens(d["answer"]))))


def valid_slots(paragraphs) -> Column:
    return F.array_sort(F.transform(paragraphs, lambda p: p["idx"])) == F.sequence(F.lit(0), F.lit(SLOTS - 1))


def valid_support(paragraphs, steps) -> Column:
    """Every step points to a supporting paragraph and every supporting paragraph to a step."""
    flagged = F.array_sort(F.transform(F.filter(paragraphs, lambda p: p["is_supporting"]), lambda p: p["idx"]))
    used = F.transform(steps, lambda s: s["paragraph_support_idx"])
    return (F.size(paragraphs) == SLOTS) & F.forall(used, lambda i: i.isNotNull()) & (F.array_sort(F.array_distinct(used)) == flagged)


def pair_rows(headers: DataFrame, id_col: str = "id") -> DataFrame:
    """One row per id: complete, missing (structs) and what is wrong with the pair, null if nothing is."""
    row = F.struct(*[c for c in headers.columns if c != id_col])
    pick = lambda flag: F.max(F.when(F.col("answerable") == flag, row))
    pairs = headers.groupBy(id_col).agg(F.count("*").alias("n"), F.count_if("answerable").alias("n_yes"), pick(True).alias("complete"), pick(False).alias("missing"))
    core = lambda c: F.transform(F.col(f"{c}.question_decomposition"), lambda d: F.struct(d["id"], d["question"], d["answer"]))
    fault = (
        F.when(F.col("n") != 2, "not_two_rows")
        .when(F.col("n_yes") != 1, "not_one_of_each")
        .when(F.col("complete.question") != F.col("missing.question"), "question_differs")
        .when(F.col("complete.answer") != F.col("missing.answer"), "answer_differs")
        .when(core("complete") != core("missing"), "decomposition_differs")
    )
    return pairs.withColumn("fault", fault)


def eligibility(pairs: DataFrame) -> DataFrame:
    """pairs with the first reason against each (or eligible) and the numbers of missing support texts and sub-answers."""
    c, m = "complete", "missing"
    lost = F.size(F.array_except(support_hashes(F.col(f"{c}.paragraphs")), text_hashes(F.col(f"{m}.paragraphs"))))
    gone = F.size(F.filter(held_subanswers(F.col(f"{m}.paragraphs"), F.col(f"{m}.question_decomposition")), lambda h: ~h))
    measured = pairs.withColumn("missing_support", lost).withColumn("missing_subanswers", gone)
    reason = (
        F.when((F.size(f"{c}.paragraphs") != SLOTS) | (F.size(f"{m}.paragraphs") != SLOTS), "not_20_paragraphs")
        .when(~(valid_slots(F.col(f"{c}.paragraphs")) & valid_slots(F.col(f"{m}.paragraphs"))), "invalid_slots")
        .when(~valid_support(F.col(f"{c}.paragraphs"), F.col(f"{c}.question_decomposition")), "invalid_support")
        .when(F.col("missing_support") == 0, "missing_keeps_all_support")
        .when(F.col("missing_subanswers") == 0, "missing_contains_every_subanswer")
        .when(F.size(f"{c}.paragraphs") - F.size(f"{c}.support") < 2, "fewer_than_two_nonsupport")
        .otherwise("eligible")
    )
    return measured.withColumn("reason", reason)


def reason_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("reason").agg(F.count("*").alias("n"))


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))


def orbits(pairs: DataFrame, prefix: str, id_col: str = "id") -> DataFrame:
    """Eligible pairs with an orbit id and the keys through which two of them must not be split: the source id, the
    support texts, and the answers and aliases of both rows (normalized; empty ones make no key)."""
    answers = F.concat(F.array("complete.answer"), "complete.answer_aliases", "missing.answer_aliases")
    named = F.transform(F.array_distinct(F.filter(F.transform(answers, normalized), lambda a: a != "")), lambda a: F.concat(F.lit("answer:"), a))
    texts = F.transform(support_hashes(F.col("complete.paragraphs")), lambda h: F.concat(F.lit("support_text:"), h))
    keys = F.array_distinct(F.concat(F.array(F.concat(F.lit("source_id:"), F.col(id_col))), texts, named))
    return pairs.where("reason = 'eligible'").withColumn("orbit_id", short_id(prefix, F.col(id_col))).withColumn("leakage_keys", keys)


def alias_policy(pairs: DataFrame, *by: str) -> DataFrame:
    """How often the two rows list other aliases, raw and normalized, and on which side."""
    norm = lambda c: F.array_distinct(F.transform(f"{c}.answer_aliases", normalized))
    only_m, only_c = F.size(F.array_except(norm("missing"), norm("complete"))), F.size(F.array_except(norm("complete"), norm("missing")))
    return pairs.groupBy(*by).agg(
        F.count_if(F.col("complete.answer_aliases") != F.col("missing.answer_aliases")).alias("different_lists"),
        F.count_if(only_m > 0).alias("missing_only_rows"), F.sum(only_m).alias("missing_only_values"),
        F.count_if(only_c > 0).alias("complete_only_rows"), F.sum(only_c).alias("complete_only_values"),
    )
