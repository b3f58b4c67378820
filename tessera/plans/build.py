"""The data set build as one plan: pairs, eligibility, components, splits, distractors, records, audits, release."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.stats import semantic_features, surface_features
from tessera.operators.components import component_table, key_components
from tessera.operators.donors import Matching, distractors, donor_pool, phrases_of, prepare
from tessera.operators.pairing import alias_policy, eligibility, header, histogram, orbits, pair_rows, reason_counts
from tessera.operators.probes import auc, oof_scores
from tessera.operators.records import donor_stats, invariants, records
from tessera.operators.splits import assign_splits, overlap_counts, reserve_ledger
from tessera.plans.lineage import cut


@dataclass(frozen=True)
class BuildConfig:
    targets: dict[str, int] = field(default_factory=lambda: {"train": 1920, "dev": 400, "shadow": 400})
    seed: str = "tessera"
    prefix: str = "orbit_"
    ratio: float = 1.25
    folds: int = 5

    def __post_init__(self):
        if not self.targets or any(n < 1 for n in self.targets.values()) or self.ratio < 1:
            raise ValueError("targets must be positive and the ratio at least 1")


@dataclass(frozen=True)
class Build:
    pairs: DataFrame
    orbits: DataFrame
    components: DataFrame
    reserve: DataFrame
    records: DataFrame
    audits: dict[str, DataFrame]


def build_dataset(source: DataFrame, config: BuildConfig) -> Build:
    """All tables of a release. Raises on a faulty pair and if whole components cannot fill a split exactly."""
    pairs = cut(eligibility(pair_rows(header(source.drop("row_sha256", "file", "fault")))), "pairs")
    faults = pairs.where("fault IS NOT NULL").select("id", "fault").take(5)
    if faults:
        raise ValueError(f"pairs are faulty: {[tuple(r) for r in faults]}")
    eligible = orbits(pairs, config.prefix)
    members = cut(key_components(eligible, "orbit_id", "leakage_keys"), "members")
    components = component_table(members)
    placed = assign_splits(components, config.targets, config.seed)
    chosen = placed.select("component_id", "split", F.explode("members").alias("orbit_id"))
    selected = cut(eligible.join(chosen, "orbit_id"), "selected")
    work = selected.select("id", "orbit_id", "split", F.col("complete.question").alias("question"), F.col("complete.paragraphs").alias("paragraphs"), F.col("complete.support").alias("support"), phrases_of(F.col("complete"), F.col("missing")).alias("phrases"))
    work = prepare(work)
    matching = Matching(config.seed, config.ratio)
    changed = cut(distractors(work, donor_pool(work), matching), "distractors")
    lost = selected.join(changed, "orbit_id", "left_anti").select("orbit_id").take(5)
    if lost:
        raise RuntimeError(f"no two valid replacements for {[r[0] for r in lost]}")
    rows = cut(records(selected, changed), "records")
    audits = {
        "reasons": reason_counts(pairs),
        "missing_support": histogram(pairs.where("reason NOT IN ('not_20_paragraphs', 'invalid_slots', 'invalid_support')"), "missing_support"),
        "component_sizes": histogram(components, "size"),
        "aliases": alias_policy(selected, "split"),
        "overlap": overlap_counts(selected),
        "invariants": invariants(rows, selected),
        "donors": donor_stats(rows, config.ratio),
    }
    return Build(pairs, selected, components, reserve_ledger(eligible, selected), rows, audits)


def probe(rows: DataFrame, seed: str, semantic: bool = False, folds: int = 5) -> DataFrame:
    """(pair, auc, separability) of an out-of-fold probe on surface or semantic features; the sealed split stays out."""
    features = semantic_features(F.col("question"), F.col("paragraphs")) if semantic else surface_features(F.col("paragraphs"))
    flat = rows.select("id", F.col("orbit_id").alias("group"), "state", "split", features.alias("features"))
    return auc(oof_scores(flat, seed, folds), "pair")
