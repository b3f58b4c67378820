"""From orbits to records: one row per state, whitelisted for rendering, with invariants counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import SLOTS, STATES, render_state

# Columns of a record.
RECORD = (
    "id", "orbit_id", "component_id", "state", "split", "question", "paragraphs", "answer", "answer_aliases", "gold_support_idxs", "answerable",
    "source_pair_id_sha256", "donors", "joint_cost", "messages", "training_read_allowed", "sealed",
)
SEALED_SPLIT = "shadow"


def records(orbits: DataFrame, distractors: DataFrame) -> DataFrame:
    """Three records per orbit, C, D and M in this order (column place): D has the replaced paragraphs and the donors,
    M the paragraphs and aliases of the unanswerable row and the refusal as its target."""
    both = orbits.join(distractors.select("orbit_id", F.col("paragraphs").alias("changed"), "donors", "joint_cost"), "orbit_id")
    no_donor = F.lit(None).cast(distractors.schema["donors"].dataType)

    def state(name: str) -> Column:
        row = "missing" if name == "M" else "complete"
        return F.struct(
            F.lit(name).alias("state"),
            (F.col("changed") if name == "D" else F.col(f"{row}.paragraphs")).alias("paragraphs"),
            F.col(f"{row}.answer_aliases").alias("answer_aliases"),
            F.col(f"{row}.support").alias("gold_support_idxs"),
            F.lit(name != "M").alias("answerable"),
            (F.col("donors") if name == "D" else no_donor).alias("donors"),
            F.when(F.lit(name == "D"), F.col("joint_cost")).alias("joint_cost"),
        )

    rows = both.select("orbit_id", "component_id", "split", F.sha2("id", 256).alias("source_pair_id_sha256"), F.col("complete.question").alias("question"), F.col("complete.answer").alias("answer"), F.posexplode(F.array(*[state(s) for s in STATES])).alias("place", "s"))
    rows = rows.select("*", "s.*").drop("s").withColumn("id", F.concat_ws("::", "orbit_id", "state"))
    shown = render_state(F.col("state"), F.col("question"), F.col("paragraphs"), F.col("gold_support_idxs"), F.col("answer"))
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    sealed = F.col("split") == SEALED_SPLIT
    rows = rows.withColumn("r", shown).withColumn("messages", F.array(message("user", F.col("r.prompt")), message("assistant", F.col("r.completion"))))
    return rows.withColumn("sealed", sealed).withColumn("training_read_allowed", ~sealed).select(*RECORD, "place")


def render_records(rows: DataFrame) -> DataFrame:
    """prompt and completion from whitelisted columns only; a sealed or unreadable row raises."""
    closed = F.col("sealed") | ~F.col("training_read_allowed")
    guard = F.when(closed, F.raise_error(F.lit("a sealed record cannot be rendered"))).otherwise(F.col("question"))
    shown = render_state(F.col("state"), guard, F.col("paragraphs"), F.col("gold_support_idxs"), F.col("answer"))
    return rows.select("id", "orbit_id", "state", shown.alias("r")).select("id", "orbit_id", "state", "r.prompt", "r.completion", F.sha2("r.prompt", 256).alias("prompt_sha256"), F.sha2("r.completion", 256).alias("completion_sha256"))


def adapt_gold(rows: DataFrame) -> DataFrame:
    """Gold rows: answers are the answer and its aliases; support comes from gold_support_idxs, else support_indices,
    else the flagged paragraphs (whichever column there is), sorted and without repeats; a slot out of range raises."""
    flagged = F.transform(F.filter("paragraphs", lambda p: p["is_supporting"]), lambda p: p["idx"]) if "paragraphs" in rows.columns else None
    source = F.col("gold_support_idxs") if "gold_support_idxs" in rows.columns else F.col("support_indices") if "support_indices" in rows.columns else flagged
    support = F.array_sort(F.array_distinct(source.cast("array<int>")))
    bad = F.exists(support, lambda i: (i < 0) | (i >= SLOTS)) | (F.col("answerable") & (F.trim("answer") == ""))
    checked = F.when(bad, F.raise_error(F.lit("a gold row is out of range"))).otherwise(support)
    return rows.select("id", "orbit_id", "state", F.concat(F.array("answer"), "answer_aliases").alias("answers"), checked.alias("support"), "answerable")


def invariants(rows: DataFrame, orbits: DataFrame) -> DataFrame:
    """For each construction rule how many orbits keep it; every count must equal `orbits`."""
    by = rows.groupBy("orbit_id").pivot("state", list(STATES)).agg(F.first(F.struct("paragraphs", "gold_support_idxs", "donors", "split")))
    by = by.join(orbits.select("orbit_id", F.col("complete.paragraphs").alias("source")), "orbit_id")
    at = lambda s, i: F.get(F.col(f"{s}.paragraphs"), i)
    every = F.sequence(F.lit(0), F.lit(SLOTS - 1))
    changed = F.filter(every, lambda i: at("C", i) != at("D", i))
    targets = F.transform("D.donors", lambda d: d["target_slot"])
    ratio = F.transform("D.donors", lambda d: F.element_at(d["matching_diagnostics"], "length_ratio"))
    return by.agg(
        F.count("*").alias("orbits"),
        F.count_if(F.col("C.paragraphs") == F.col("source")).alias("complete_is_source"),
        F.count_if(F.size(changed) == 2).alias("two_slots_changed"),
        F.count_if(changed == targets).alias("changes_are_recorded"),
        F.count_if(F.forall("C.gold_support_idxs", lambda i: at("C", i) == at("D", i))).alias("support_kept"),
        F.count_if(F.forall("D.donors", lambda d: d["source_split"] == F.col("D.split"))).alias("donors_in_split"),
        F.count_if(F.forall(ratio, lambda r: r <= 1.25 + 1e-12)).alias("length_in_band"),
    )


def donor_stats(rows: DataFrame, ceiling: float = 1.25) -> DataFrame:
    d = rows.where("state = 'D'").select("joint_cost", F.explode("donors").alias("d")).select("joint_cost", F.element_at("d.matching_diagnostics", "length_ratio").alias("ratio"))
    return d.agg(F.max("ratio").alias("max_ratio"), F.avg("ratio").alias("mean_ratio"), F.count_if(F.col("ratio") > ceiling + 1e-12).alias("violations"), F.avg("joint_cost").alias("mean_cost"), F.max("joint_cost").alias("max_cost"))
