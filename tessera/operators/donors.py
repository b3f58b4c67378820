"""Replacement paragraphs: a length band turned into positions, drawn by digest and met in an equi-join, then ranked.

The band join is never one: the number of donors below each length is a small array per split, so a slot knows the
positions of its band, draws up to 64 of them, and joins on (split, position).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.digest import joined_sha, mod_pair, sha
from tessera.functions.stats import extras_of, feature_distance, length_ratio, let, mean, measure_all, measured, median, question_hashes, surface_of
from tessera.functions.text import forbidden_phrases, jaccard, leaks, tokens
from tessera.operators.ranking import global_rank, top
from tessera.plans.lineage import cut

# Weights and sizes of the matching.
W_DUPLICATE, W_QUESTION, W_TITLE, W_LENGTH, W_ALIKE, W_COHERENCE, W_LOCAL = 50.0, 10.0, 6.0, 2.0, 0.5, 3.0, 0.01
NEAR, DRAWN, CHEAP, KEPT, PAIRS = 4, 56, 16, 8, 8


@dataclass(frozen=True)
class Matching:
    seed: str
    ratio: float = 1.25


def _parts(orbits: DataFrame) -> int:
    """Tasks over which measuring is dealt out by name: the rows are few bytes and much work, so sizes say nothing of it."""
    return int(orbits.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _content(p) -> Column:
    return F.concat_ws(" ", p["title"], p["paragraph_text"])


def _count(m) -> Column:
    return F.greatest(F.lit(1), m["count"])


def prepare(orbits: DataFrame) -> DataFrame:
    """orbits with their paragraphs measured (m) and the question's words (q), written once: ranking reads numbers only."""
    return cut(orbits.repartition(_parts(orbits), "orbit_id").withColumn("m", measure_all("paragraphs")).withColumn("q", question_hashes(F.col("question"))), "orbits")


def donor_pool(orbits: DataFrame) -> DataFrame:
    """Non-support paragraphs of selected orbits whose text supports no selected orbit, placed by (length, key) per split.

    orbits: orbit_id, id, split, paragraphs (of the complete row, in order), support."""
    used = orbits.select(F.explode("paragraphs").alias("p"), "support").where(F.col("p.is_supporting") | F.array_contains("support", F.col("p.idx"))).select(sha(F.col("p.paragraph_text")).alias("text_hash")).distinct()
    rows = orbits.select("split", "orbit_id", "id", "support", F.explode("paragraphs").alias("p")).where(~F.col("p.is_supporting") & ~F.array_contains("support", F.col("p.idx")))
    rows = rows.withColumn("text_hash", sha(F.col("p.paragraph_text"))).join(used, "text_hash", "left_anti")
    rows = rows.select(
        "split", F.col("orbit_id").alias("donor_orbit"), sha(F.col("id")).alias("donor_pair_sha"), F.col("p.idx").alias("donor_slot"), F.col("p").alias("donor"), F.col("text_hash").alias("donor_hash"),
        tokens(_content(F.col("p"))).alias("donor_words"), measured(F.col("p")).alias("donor_m"), joined_sha(F.col("orbit_id"), F.col("p.idx"), F.col("text_hash")).alias("donor_key"),
    ).withColumn("donor_count", _count(F.col("donor_m")))
    return global_rank(rows, ["donor_count", "donor_key"], group="split", name="position")


def _gcd(a, b) -> Column:
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(90)), start, lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.pmod(s["a"], s["b"]).alias("b"))), lambda s: s["a"])


def stride_draw(salt, width) -> Column:
    """Struct start, stride of a walk through 0 .. width - 1: both from a digest, the stride raised until it shares no
    factor with the width (the next such number is never 64 away)."""
    def of(w, draw):
        free = lambda want: F.filter(F.sequence(want, F.greatest(want, F.least(want + 64, w.cast("long") - 1))), lambda s: _gcd(s, w) == 1)
        first = let(F.greatest(draw["next"], F.lit(1).cast("long")), lambda want: F.get(free(want), F.lit(0)))
        return F.struct(draw["rest"].alias("start"), F.coalesce(first, F.lit(1).cast("long")).alias("stride"))

    return let(width, lambda w: let(mod_pair(sha(salt), w), lambda draw: of(w, draw)))


def candidate_positions(count, bounds, ratio: float, salt) -> Column:
    """Up to 8 positions around the slot's own length and up to 56 of a stride through its band.

    bounds: sorted structs (count, below, upto): donors of a smaller length, and of a smaller or equal one."""
    low = F.greatest(F.lit(1), F.ceil(count / ratio))
    high = F.greatest(low, F.floor(count * ratio))
    below = lambda n: F.coalesce(F.array_max(F.transform(F.filter(bounds, lambda b: b["count"] < n), lambda b: b["upto"])), F.lit(0).cast("long"))

    def of(left, right, draw):  # bound, not repeated for each position
        width = right - left
        center = F.greatest(left, F.least(right, below(count)))
        near = F.filter(let(center, lambda c: F.sequence(c - NEAR, c + NEAR - 1)), lambda p: (p >= left) & (p < right))
        drawn = F.transform(F.sequence(F.lit(0).cast("long"), F.least(F.lit(DRAWN), width) - 1), lambda k: left + F.pmod(draw["start"] + k * draw["stride"], width))
        return F.when(width <= 0, F.array().cast("array<bigint>")).otherwise(F.array_sort(F.array_distinct(F.concat(near, drawn))))

    return let(below(low), lambda left: let(below(high + 1), lambda right: let(stride_draw(salt, F.greatest(right - left, F.lit(1))), lambda draw: of(left, right, draw))))


def _profile(m, others, question) -> Column:
    """What a measured paragraph is to its neighbours and the question."""
    rate = lambda f: F.size(F.filter(others, lambda o: o[f] == m[f])) / F.greatest(F.lit(1), F.size(others))
    return F.struct(rate("title").alias("title_dup"), rate("text").alias("text_dup"), jaccard(question, m["words"]).alias("question"), jaccard(question, m["title_words"]).alias("question_title"))


def _coherence(m, others) -> Column:
    one = lambda f: mean(F.transform(others, lambda o: jaccard(m[f], o[f])))
    return F.struct(one("title_words").alias("title"), one("text_words").alias("text"))


def slots(orbits: DataFrame, m: Matching) -> DataFrame:
    """Every non-support slot of prepared orbits with its profile and its place in the order in which slots are tried."""
    rows = orbits.withColumn("middle", median(F.transform("m", _count)))
    rows = rows.select("*", F.posexplode("m").alias("place", "old_m")).where(~F.array_contains("support", F.col("place"))).withColumnRenamed("place", "slot")
    rows = rows.withColumn("old_hash", sha(F.get("paragraphs", F.col("slot"))["paragraph_text"]))
    others = F.filter("m", lambda o, i: i != F.col("slot"))
    both = let(others, lambda o: F.struct(_profile(F.col("old_m"), o, F.col("q")).alias("old"), _coherence(F.col("old_m"), o).alias("coherence")))
    rows = rows.withColumn("both", both).select("*", F.col("both.old").alias("old"), F.col("both.coherence").alias("old_coherence"), _count(F.col("old_m")).alias("count")).drop("both")
    rank = F.struct(
        F.round(F.col("old.title_dup") + F.col("old.text_dup"), 12).alias("a"), F.round("old.question", 12).alias("b"), F.round(F.col("old_coherence.title") + F.col("old_coherence.text"), 12).alias("c"),
        F.round(F.abs(F.col("count") - F.col("middle")) / F.greatest(F.lit(1.0), F.col("middle")), 12).alias("d"), joined_sha(m.seed, F.col("orbit_id"), "slot", F.col("slot")).alias("e"),
    )
    return cut(rows.withColumn("slot_rank", rank).drop("paragraphs", "question", "id", "middle"), "slots")


def proposals(orbits: DataFrame, pool: DataFrame, m: Matching) -> DataFrame:
    """Up to 8 ranked donors for each of the first two slots of an orbit that have any.

    orbits: prepared, with phrases (token lists that no donor may hold)."""
    lengths = pool.groupBy("split", "donor_count").agg(F.count("*").alias("n"))
    arrays = lengths.groupBy("split").agg(F.array_sort(F.collect_list(F.struct(F.col("donor_count").alias("count"), "n"))).alias("l"))
    upto = F.transform("l", lambda b, i: F.struct(b["count"].alias("count"), F.aggregate(F.slice("l", 1, i + 1), F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("upto")))
    parts = _parts(orbits)
    tried = slots(orbits, m).join(arrays.select("split", upto.alias("bounds")), "split").repartition(parts, "orbit_id", "slot")
    salt = F.concat_ws("\n", F.lit(m.seed), F.col("orbit_id"), F.col("slot").cast("string"))
    drawn = tried.select("split", "orbit_id", "slot", F.explode(candidate_positions(F.col("count"), F.col("bounds"), m.ratio, salt)).alias("position"))
    drawn = drawn.join(pool, ["split", "position"]).drop("split").repartition(parts, "orbit_id", "slot")
    met = drawn.join(tried.drop("bounds"), ["orbit_id", "slot"])
    ratio = length_ratio(F.col("count"), F.col("donor_count"))
    met = met.where((F.col("donor_orbit") != F.col("orbit_id")) & (F.col("donor_hash") != F.col("old_hash")) & (ratio <= m.ratio + 1e-12) & ~leaks(F.col("donor_words"), F.col("phrases")))
    others = F.filter("m", lambda o, i: i != F.col("slot"))
    met = met.withColumn("new", let(others, lambda o: _profile(F.col("donor_m"), o, F.col("q"))))
    gap = lambda f: F.abs(F.col(f"old.{f}") - F.col(f"new.{f}"))
    met = met.withColumn(
        "gaps",
        F.struct(
            (gap("title_dup") + gap("text_dup")).alias("duplicate_delta"), gap("question").alias("question_overlap_delta"), gap("question_title").alias("title_question_overlap_delta"),
            ratio.alias("length_ratio"), jaccard(F.col("old_m.words"), F.col("donor_m.words")).alias("source_token_jaccard"),
        ),
    )
    g = lambda f: F.col(f"gaps.{f}")
    cheap = W_DUPLICATE * g("duplicate_delta") + W_QUESTION * g("question_overlap_delta") + W_TITLE * g("title_question_overlap_delta") + W_LENGTH * F.abs(F.log(F.col("donor_count") / F.col("count"))) - W_ALIKE * g("source_token_jaccard")
    met = met.withColumn("cheap", F.round(cheap, 12)).withColumn("tie", joined_sha(m.seed, F.col("orbit_id"), F.col("slot"), F.col("donor_key")))
    short = top(met.drop("donor_words", "phrases", "old_hash", "new", "old"), CHEAP, [F.col("cheap"), F.col("tie")], "orbit_id", "slot")
    short = short.withColumn("coherence", let(others, lambda o: _coherence(F.col("donor_m"), o)))
    apart = F.abs(F.col("old_coherence.title") - F.col("coherence.title")) + F.abs(F.col("old_coherence.text") - F.col("coherence.text"))
    short = short.withColumn("coherence_delta", apart).withColumn("cost", F.round(F.col("cheap") + W_COHERENCE * F.col("coherence_delta"), 12))
    best = top(short, KEPT, [F.col("cost"), F.col("tie")], "orbit_id", "slot")
    first = top(best.select("orbit_id", "slot", "slot_rank").distinct(), 2, [F.col("slot_rank")], "orbit_id").select("orbit_id", "slot", "slot_rank")
    return best.drop("slot_rank").join(first, ["orbit_id", "slot"])


def overwrite(paragraphs, changes) -> Column:
    """Paragraphs with those of `changes` (structs slot, title, paragraph_text) in their slots, as non-support."""
    def one(p):
        c = F.get(F.filter(changes, lambda x: x["slot"] == p["idx"]), F.lit(0))
        return F.when(c.isNull(), p).otherwise(F.struct(p["idx"].alias("idx"), c["title"].alias("title"), c["paragraph_text"].alias("paragraph_text"), F.lit(False).alias("is_supporting")))

    return F.transform(paragraphs, one)


def distractors(orbits: DataFrame, pool: DataFrame, m: Matching) -> DataFrame:
    """Of prepared orbits: orbit_id, paragraphs with exactly two replaced, and the two donors with their diagnostics, in slot order.

    Of the pairs of proposals for the two slots (other slots, other donors) the 8 of least local cost are rescored by
    the distance of the feature vectors. An orbit without a pair gives no row."""
    offer = F.struct("slot", "slot_rank", "cost", "tie", "donor_key", F.col("donor.title").alias("title"), F.col("donor.paragraph_text").alias("paragraph_text"), F.col("donor_m").alias("m"), "donor_orbit", "donor_pair_sha", "donor_slot", "donor_hash", "gaps", "coherence_delta", F.col("split").alias("donor_split"))
    made = proposals(orbits, pool, m).groupBy("orbit_id").agg(F.array_sort(F.collect_list(F.struct(F.col("slot_rank").alias("k"), F.col("cost").alias("c"), F.col("tie").alias("t"), offer.alias("o")))).alias("offers"))
    made = made.withColumn("offers", F.transform("offers", lambda x: x["o"]))  # at most 2 x 8
    pairs = F.flatten(F.transform("offers", lambda a, i: F.transform(F.filter(F.slice("offers", i + 2, F.size("offers")), lambda b: (b["slot"] != a["slot"]) & (b["donor_key"] != a["donor_key"])), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    rows = made.select("orbit_id", F.explode(pairs).alias("pair")).withColumn("local", F.round(F.col("pair.a.cost") + F.col("pair.b.cost"), 12))
    name = lambda s: F.concat_ws(":", F.col(f"pair.{s}.slot").cast("string"), F.col(f"pair.{s}.donor_key"))
    rows = top(rows, PAIRS, [F.col("local"), joined_sha(m.seed, F.col("orbit_id"), name("a"), name("b"))], "orbit_id")
    rows = rows.repartition(_parts(orbits), "orbit_id").join(orbits.select("orbit_id", "q", "m", "paragraphs"), "orbit_id")
    new = F.transform("m", lambda x, i: F.when(i == F.col("pair.a.slot"), F.col("pair.a.m")).when(i == F.col("pair.b.slot"), F.col("pair.b.m")).otherwise(x))
    apart = let(new, lambda n: feature_distance(surface_of(F.col("m")), surface_of(n)) + feature_distance(extras_of(F.col("q"), F.col("m")), extras_of(F.col("q"), n)))
    rows = rows.withColumn("score", F.round(apart + W_LOCAL * F.col("local"), 12))
    rows = top(rows, 1, [F.col("score"), joined_sha(m.seed, F.col("orbit_id"), F.col("pair.a.donor_key"), F.col("pair.b.donor_key"))], "orbit_id")

    def entry(o):
        diagnostics = F.create_map(
            F.lit("duplicate_delta"), o["gaps"]["duplicate_delta"], F.lit("question_overlap_delta"), o["gaps"]["question_overlap_delta"], F.lit("title_question_overlap_delta"), o["gaps"]["title_question_overlap_delta"],
            F.lit("coherence_delta"), o["coherence_delta"], F.lit("length_ratio"), o["gaps"]["length_ratio"], F.lit("source_token_jaccard"), o["gaps"]["source_token_jaccard"],
        )
        return F.struct(o["slot"].alias("target_slot"), o["donor_split"].alias("source_split"), o["donor_orbit"].alias("source_orbit_id"), o["donor_pair_sha"].alias("source_pair_id_sha256"), o["donor_slot"].alias("source_slot"), o["donor_hash"].alias("source_text_sha256"), o["cost"].alias("local_cost"), diagnostics.alias("matching_diagnostics"))

    donors = F.array_sort(F.transform(F.array("pair.a", "pair.b"), entry), lambda x, y: x["target_slot"] - y["target_slot"])
    return rows.select("orbit_id", overwrite(F.col("paragraphs"), F.array("pair.a", "pair.b")).alias("paragraphs"), donors.alias("donors"), F.col("score").alias("joint_cost"))


def phrases_of(complete, missing) -> Column:
    return forbidden_phrases(complete["answer"], complete["answer_aliases"], missing["answer_aliases"], F.transform(complete["question_decomposition"], lambda d: d["answer"]))
