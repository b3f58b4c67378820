"""Phrases and length bands met in equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import contains_phrase, tokens

#: Words of a phrase that the join compares; shorter phrases are compared whole.
HEAD = 5


def phrase_matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id) of documents that hold all words of an item as neighbours; wordless items match nothing.

    Documents are cut into runs of as many words as the items' heads have, joined on equal heads and confirmed, so a
    pair is looked at only if it shares a head."""
    phrases = items.select(F.col(item_id).alias("item"), tokens(F.col(text)).alias("phrase")).where(F.size("phrase") > 0)
    phrases = phrases.withColumn("n", F.least(F.size("phrase"), F.lit(HEAD))).withColumn("head", F.array_join(F.slice("phrase", 1, F.lit(HEAD)), " "))
    lengths = [r[0] for r in phrases.select("n").distinct().collect()]
    words = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(doc_id, text).alias("row"), tokens(F.col(text)).alias("words"))
    found = None
    for n in sorted(lengths):
        heads = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.array_join(F.slice("words", i, n), " ")))
        one = words.where(F.size("words") >= n).select("doc", "words", F.explode(heads).alias("head"))
        met = one.join(phrases.where(F.col("n") == n).select("item", "phrase", "head"), "head").where(contains_phrase(F.col("words"), F.col("phrase")))
        met = met.select("doc", "item")
        found = met if found is None else found.unionByName(met)
    if found is None:
        found = words.select("doc").crossJoin(phrases.select("item").limit(0)).limit(0)
    return found.distinct().select(F.col("doc").alias(doc_id), F.col("item").alias(item_id))


def without_phrases(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    return docs.join(phrase_matches(docs, items, doc_id, item_id).select(doc_id).distinct(), doc_id, "left_anti")


def band_counts(rows: DataFrame, group: str, length: str, ratio: float) -> DataFrame:
    """For each group how many ordered pairs of rows are within the length ratio, a row with itself left out.

    Pairs are counted, not made: the numbers of rows per length and their running sums answer every band."""
    lengths = rows.groupBy(group, F.greatest(F.col(length), F.lit(1)).alias("n")).agg(F.count("*").alias("k"))
    lists = lengths.groupBy(group).agg(F.collect_list(F.struct("n", "k")).alias("l"))
    n = F.col("n")
    low, high = F.greatest(F.lit(1), F.ceil(n / ratio)), F.greatest(F.ceil(n / ratio), F.floor(n * ratio))
    inside = F.aggregate(F.filter("l", lambda b: (b["n"] >= low) & (b["n"] <= high)), F.lit(0).cast("long"), lambda s, b: s + b["k"])
    return lengths.join(lists, group).groupBy(group).agg(F.sum(F.col("k") * (inside - 1)).alias("n_pairs"))


def token_overlaps(rows: DataFrame, id_col: str, text: str) -> DataFrame:
    """(a, b, jaccard) of pairs a < b that share a word: an equi-join on words, counted per pair.

    Meant for a bounded set of texts, such as the items of a benchmark; a frequent word meets all its texts."""
    sets = rows.select(F.col(id_col).alias("id"), F.array_distinct(tokens(F.col(text))).alias("t"))
    flat = sets.select("id", F.size("t").alias("n"), F.explode("t").alias("w"))
    a, b = flat.select(F.col("id").alias("a"), F.col("n").alias("na"), "w"), flat.select(F.col("id").alias("b"), F.col("n").alias("nb"), "w")
    met = a.join(b, "w").where("a < b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("k"))
    return met.select("a", "b", (F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))).alias("jaccard"))
