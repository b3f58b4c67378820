"""The build and its parts on source pairs made from the driver's tables, with closed-form SQL beside them.

A customer k (for the whole build: a benchmark item, of which there are fewer) becomes the complete and the missing row of one source pair. What is wrong with a pair, which support the
missing row loses and who shares an alias follow from k alone, so SQL states the right result without the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import stats, text
from tessera.functions.digest import sha
from tessera.operators import audits, records, scoring
from tessera.operators.components import component_table, key_components
from tessera.operators.pairing import eligibility, header, histogram, orbits, pair_rows
from tessera.plans.build import Build, BuildConfig, build_dataset
from tessera.plans.catalogue import JAC, ONE, SAYS, TOK, query, read
from tessera.plans.lineage import cut, shared_path
from tessera.sources import jsonl

PREFIX = "orbit_"
#: Source pairs of one task at most, on average.
PART = 20_000
#: k % 12 that make a pair ineligible, with the reason, the support texts and the sub-answers that the missing row lacks.
FLAWS = {6: ("not_20_paragraphs", 2, 1), 7: ("invalid_slots", 2, 1), 8: ("invalid_support", 2, 1), 9: ("missing_keeps_all_support", 0, 0), 10: ("missing_contains_every_subanswer", 2, 0)}
#: k % 36 that make a pair faulty: other values of the missing row, or one row too many.
FAULTS = {11: "not_two_rows", 23: "question_differs", 35: "answer_differs", 10: "not_one_of_each", 22: "decomposition_differs"}

# Texts of slot i (expressions over k, seg and i that Spark and DuckDB both read).
TITLE = "concat('Title ', CAST((k + i) % 5 AS STRING), ' ', CAST(i AS STRING))"
HOLDS, LEADS = "concat('Customer ', ks, ' holds bridge', ks, ' near ', seg)", "concat('The bridge', ks, ' leads to goal', ks, ' of ', seg)"
NOTE = "concat('Note ', CAST(i AS STRING), ' of ', ks, ' tells word', CAST((k + i) % 7 AS STRING), ' and word', CAST((k * 3 + i) % 11 AS STRING), ' in ', seg, CASE WHEN (k + i) % 3 = 0 THEN ' more' ELSE '' END)"
FULL = f"CASE i WHEN 0 THEN {HOLDS} WHEN 1 THEN {LEADS} ELSE {NOTE} END"
LOST = f"CASE WHEN i = 0 THEN concat('Customer ', ks, ' holds bridge', ks, ' alone') WHEN i = 1 THEN concat('Nothing of it remains ', ks) WHEN i = 7 AND v = 10 THEN concat('bridge', ks, ' meets goal', ks) ELSE {NOTE} END"
QUESTION = "concat('Where does customer ', ks, ' lead?')"
HAS = "CASE WHEN k % 3 = 0 THEN concat('Shared  Alias ', CAST(k % 97 AS STRING)) ELSE concat('only ', ks) END"
MISSES = "CASE WHEN k % 3 = 0 THEN concat('shared alias ', CAST(k % 97 AS STRING)) ELSE concat('other', ks) END"


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("k"), F.concat(F.lit("field"), (F.col("item_id") % 5).cast("string")).alias("seg"))


def source_pairs(base: DataFrame, faults: bool = False) -> DataFrame:
    """Source rows, two for each k, with flawed ones; with faults, also pairs that do not belong together.

    A pair is a hundred times as large as its k, so k is dealt out by id first, also from one small file: no task makes
    many pairs, and the rows of an id meet without being moved."""
    parts = max(int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")), base.count() // PART + 1)
    c = base.select("k", F.col("k").cast("string").alias("ks"), (F.col("k") % 12).alias("v"), "seg")
    c = c.withColumn("id", F.concat(F.lit("c"), "ks")).repartition(parts, "id")
    slot = lambda body, support: F.expr(f"transform(sequence(0, 19), i -> named_struct('idx', CASE WHEN v = 7 AND i = 19 THEN 18 ELSE i END, 'title', {TITLE}, 'paragraph_text', {body}, 'is_supporting', {support}))")
    c = c.withColumn("p", slot(FULL, "i < 2 OR (v = 8 AND i = 5)")).withColumn("q", slot(LOST, "i = 0"))
    c = c.withColumn("q", F.when(F.col("v") == 6, F.slice("q", 1, 19)).when(F.col("v") == 9, F.col("p")).otherwise(F.col("q")))
    step = lambda n, word, at: F.struct(F.lit(n).alias("id"), F.lit("what?").alias("question"), F.concat(F.lit(word), F.col("ks")).alias("answer"), F.lit(at).cast("int").alias("paragraph_support_idx"))
    m = F.col("k") % 36
    odd = lambda name: F.lit(faults) & (m == next(x for x, f in FAULTS.items() if f == name))

    def row(complete: bool):
        other = lambda name, old, new: old if complete else F.when(odd(name), new).otherwise(old)
        last = 1 if complete else None
        return F.struct(
            F.col("p" if complete else "q").alias("paragraphs"),
            other("question_differs", F.expr(QUESTION), F.lit("Another?")).alias("question"),
            other("decomposition_differs", F.array(step(1000, "bridge", 0), step(2000, "goal", last)), F.array(step(1000, "bridge", 0))).alias("question_decomposition"),
            other("answer_differs", F.concat(F.lit("goal"), "ks"), F.lit("else")).alias("answer"),
            F.array(F.expr(HAS if complete else MISSES)).alias("answer_aliases"),
            (F.lit(True) if complete else odd("not_one_of_each")).alias("answerable"),
        )

    both = F.array(row(True), row(False))
    every = F.when(odd("not_two_rows"), F.concat(both, F.array(row(True)))).otherwise(both)
    return c.select("id", F.explode(every).alias("r")).select("id", "r.*")


MADE = "k AS (SELECT k, k::VARCHAR AS ks, k % 12 AS v, seg, 'c' || k AS id, 'orbit_' || substr(sha256('c' || k), 1, 20) AS orbit_id FROM ({0}))".format
K = MADE("SELECT c_custkey AS k, c_mktsegment AS seg FROM customer")
ITEMS = MADE("SELECT item_id AS k, 'field' || item_id % 5 AS seg FROM benchmark")
GOOD = f"e AS (SELECT * FROM k WHERE v NOT IN ({', '.join(map(str, FLAWS))}))"
FAULT = "CASE k % 36 " + " ".join(f"WHEN {m} THEN '{f}'" for m, f in FAULTS.items()) + " END"


@query(f"WITH {K} SELECT id, CASE WHEN k % 36 = 11 THEN 3 ELSE 2 END AS n, CASE WHEN k % 36 IN (10, 11) THEN 2 ELSE 1 END AS n_yes, {FAULT} AS fault FROM k")
def q41_pair_rows(spark, sf):
    return pair_rows(header(source_pairs(customers(spark, sf), faults=True))).select("id", "n", "n_yes", "fault")


def _pairs(spark, sf) -> DataFrame:
    return eligibility(pair_rows(header(source_pairs(customers(spark, sf)))))


@query(f"WITH {K} SELECT id, " + ", ".join("CASE v " + " ".join(f"WHEN {v} THEN {f[i]!r}" for v, f in FLAWS.items()) + f" ELSE {e!r} END AS {n}" for i, e, n in ((0, "eligible", "reason"), (1, 2, "missing_support"), (2, 1, "missing_subanswers"))) + " FROM k")
def q42_eligibility(spark, sf):
    return _pairs(spark, sf).select("id", "reason", "missing_support", "missing_subanswers")


NORMAL = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))".format


@query(f"WITH {K}, {GOOD}, a AS (SELECT orbit_id, id, list_distinct(['source_id:' || id, 'support_text:' || sha256({HOLDS}), 'support_text:' || sha256({LEADS}), 'answer:goal' || ks, 'answer:' || {NORMAL(HAS)}, 'answer:' || {NORMAL(MISSES)}]) AS l FROM e) SELECT id, orbit_id, len(l) AS n_keys, sha256(array_to_string(list_sort(l), chr(10))) AS keys_sha FROM a".replace("STRING", "VARCHAR"))
def q43_orbits(spark, sf):
    found = orbits(_pairs(spark, sf), PREFIX)
    return found.select("id", "orbit_id", F.size("leakage_keys").cast("long").alias("n_keys"), sha(F.array_join(F.array_sort("leakage_keys"), "\n")).alias("keys_sha"))


GROUPS = f"WITH {K}, {GOOD}, g AS (SELECT CASE WHEN k % 3 = 0 THEN 'g' || k % 97 ELSE id END AS g, orbit_id FROM e), c AS (SELECT g, count(*) AS size, string_agg(orbit_id, chr(10) ORDER BY orbit_id) AS members FROM g GROUP BY g)"


def _component_table(spark, sf) -> DataFrame:
    found = cut(orbits(_pairs(spark, sf), PREFIX).select("orbit_id", "leakage_keys"), "keys")
    return component_table(key_components(found, "orbit_id", "leakage_keys"))


@query(f"{GROUPS} SELECT 'component_' || substr(sha256(members), 1, 20) AS component_id, size, sha256(members) AS members_sha FROM c")
def q44_component_table(spark, sf):
    return _component_table(spark, sf).select("component_id", "size", sha(F.array_join("members", "\n")).alias("members_sha"))


@query(f"{GROUPS} SELECT size::VARCHAR AS value, count(*) AS n FROM c GROUP BY 1")
def q38_component_histogram(spark, sf):
    return histogram(_component_table(spark, sf), "size")


_BUILT: dict[tuple[str, str], Build] = {}  # its tables are written, so the queries of one session share them


def _build(spark: SparkSession, sf: str) -> Build:
    """The whole build over all eligible pairs: two splits of a quarter, the rest is train."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _BUILT:
        _BUILT[key] = _make(spark, sf)
    return _BUILT[key]


def _make(spark: SparkSession, sf: str) -> Build:
    base = items(spark, sf)
    n = base.where(~(F.col("k") % 12).isin(*FLAWS)).count()
    return build_dataset(source_pairs(base), BuildConfig({"dev": n // 4, "shadow": n // 4, "train": n - 2 * (n // 4)}, prefix=PREFIX))


@query(f"WITH {ITEMS}, {GOOD} SELECT n AS orbits, n AS complete_is_source, n AS two_slots_changed, n AS changes_are_recorded, n AS support_kept, n AS donors_in_split, n AS length_in_band, 0 AS violations, 0 AS shared_keys, 0 AS reserve FROM (SELECT count(*) AS n FROM e)")
def q45_build_dataset(spark, sf):
    """What the build promises of every orbit, counted over its records; no key in two splits, no orbit left over."""
    made = _build(spark, sf)
    donors = made.audits["donors"].select("violations")
    shared = made.audits["overlap"].agg(F.coalesce(F.sum("n"), F.lit(0)).alias("shared_keys"))
    left = made.reserve.agg(F.count("*").alias("reserve"))
    rows = made.audits["invariants"]
    for one in (donors, shared, left):  # each is one row
        rows = rows.withColumn("one", F.lit(1)).join(F.broadcast(one.withColumn("one", F.lit(1))), "one").drop("one")
    return rows


PROMPT = f"sha256('{text.PROMPT_HEAD}' || 'Question: ' || {QUESTION} || chr(10) || 'Paragraph registry:' || chr(10) || string_agg('[P' || lpad(i::VARCHAR, 2, '0') || '] ' || {TITLE} || ': ' || {{0}}, chr(10) ORDER BY i))"
SLOTS_SQL = f"WITH {ITEMS}, {GOOD}, s AS (SELECT * FROM e, range(20) AS r(i))"


@query(
    (
        SLOTS_SQL
        + f", t AS (SELECT orbit_id, ks, {PROMPT.format(ONE(FULL))} AS c, {PROMPT.format(ONE(LOST))} AS m FROM s GROUP BY orbit_id, k, ks, seg, v)"
        + " SELECT orbit_id || '::' || st AS id, st AS state, st <> 'M' AS answerable, CASE st WHEN 'C' THEN c WHEN 'M' THEN m END AS prompt_sha,"
        + f" CASE st WHEN 'M' THEN '{text.REFUSAL}' ELSE 'S | evidence=[P00,P01] | answer=goal' || ks END AS completion, CASE st WHEN 'M' THEN '0' ELSE '0,1' END AS support, CASE st WHEN 'D' THEN 2 ELSE 0 END AS n_donors"
        + " FROM t, (VALUES ('C'), ('D'), ('M')) AS x(st)"
    ).replace("STRING", "VARCHAR")
)
def q46_build_records(spark, sf):
    """The three records of every orbit; the distracted prompt depends on the draw of donors and is left out."""
    rows = _build(spark, sf).records
    said = lambda i: F.get("messages", F.lit(i))["content"]
    return rows.select("id", "state", "answerable", F.when(F.col("state") != "D", sha(said(0))).alias("prompt_sha"), said(1).alias("completion"), F.array_join("gold_support_idxs", ",").alias("support"), F.coalesce(F.size("donors"), F.lit(0)).alias("n_donors"))


@query(
    f"""WITH p AS (SELECT conv_id, role || ' ' || text AS w, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i FROM conversations),
m AS (SELECT conv_id, i, length(w) AS chars, list_distinct({TOK('w')}) AS ww, list_distinct({TOK('role')}) AS tw, list_distinct({TOK('text')}) AS xw, array_to_string({TOK('role')}, ' ') AS t, array_to_string({TOK('text')}, ' ') AS x, len(regexp_extract_all(w, '[0-9]')) AS dg, len(regexp_extract_all(w, '[!-/:-@\\[-`{{-~]')) AS pu FROM p),
b AS (SELECT conv_id, count(*) AS n, sum(chars) AS sc, avg(chars) AS ac, stddev_pop(chars) AS dc, min(chars) AS lo, max(chars) AS hi, sum(len(ww)) AS sw, avg(len(ww)) AS aw, stddev_pop(len(ww)) AS dw, avg(len(tw)) AS mt, stddev_pop(len(tw)) AS st, sum(dg) AS dg, sum(pu) AS pu, coalesce(regr_slope(chars, i), 0) AS sl FROM m GROUP BY 1),
j AS (SELECT a.conv_id, avg({JAC('a.tw', 'b.tw')}) AS jt, avg({JAC('a.xw', 'b.xw')}) AS jx FROM m a JOIN m b ON a.conv_id = b.conv_id AND a.i < b.i GROUP BY 1),
dt AS (SELECT conv_id, sum(c * (c - 1) / 2) AS k FROM (SELECT conv_id, t, count(*) AS c FROM m GROUP BY 1, 2) GROUP BY 1), dx AS (SELECT conv_id, sum(c * (c - 1) / 2) AS k FROM (SELECT conv_id, x, count(*) AS c FROM m GROUP BY 1, 2) GROUP BY 1)
SELECT conv_id, """
    + ", ".join(
        f"round({e}, 6)::DOUBLE AS {n}"
        for n, e in zip(
            stats.SURFACE,
            ("n", "sc", "ac", "dc", "lo", "hi", "sw", "aw", "dw", "mt", "st", "coalesce(dt.k / nullif(n * (n - 1) / 2, 0), 0)", "coalesce(dx.k / nullif(n * (n - 1) / 2, 0), 0)", "coalesce(jt, 0)", "coalesce(jx, 0)", "dg / greatest(sc, 1)", "pu / greatest(sc, 1)", "CASE WHEN n < 2 THEN 0 ELSE sl END"),
            strict=True,
        )
    )
    + " FROM b JOIN dt USING (conv_id) JOIN dx USING (conv_id) LEFT JOIN j USING (conv_id)"
)
def q47_surface_features(spark, sf):
    p = F.struct(F.col("turn").alias("idx"), F.col("role").alias("title"), F.col("text").alias("paragraph_text"))
    by = read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(p)).alias("p")).select("conv_id", stats.surface_features(F.col("p")).alias("x"))
    return by.select("conv_id", *[F.round(F.get("x", F.lit(i)), 6).alias(n) for i, n in enumerate(stats.SURFACE)])


VECTORS = (("l_quantity", "l_extendedprice", "l_discount"), ("l_suppkey", "l_partkey", "l_tax"))


@query("SELECT l_orderkey, round(sum(" + " + ".join(f"abs({a} - {b}) / (1 + abs({a}) + abs({b}))" for a, b in zip(*VECTORS, strict=True)) + "), 6) AS distance FROM lineitem GROUP BY 1")
def q48_feature_distance(spark, sf):
    a, b = (F.array(*[F.col(c).cast("double") for c in v]) for v in VECTORS)
    return read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(stats.feature_distance(a, b)), 6).alias("distance"))


@query("""WITH s AS (SELECT item_id % 5 AS c, item_id % 4 AS d, item_id % 3 AS m FROM benchmark)
SELECT 'C' AS state, count(*) AS count, avg((c < 4)::INT) AS parse_rate, avg((c < 3)::INT) AS answer_em, round(avg(CASE WHEN c < 3 THEN 1 WHEN c = 3 THEN 2 / 3 ELSE 0 END), 9) AS answer_f1, avg((c < 3)::INT) AS support_em, round(avg(CASE WHEN c < 3 THEN 1 WHEN c = 3 THEN 2 / 3 ELSE 0 END), 9) AS support_f1, avg((c < 4)::INT) AS answerability_accuracy, 0.0 AS refusal_rate, 0.0 AS false_refusal_rate FROM s
UNION ALL SELECT 'D', count(*), 1, avg((d <> 0)::INT), avg((d <> 0)::INT), 0, round(avg(CASE WHEN d <> 0 THEN 0.8 ELSE 0 END), 9), avg((d <> 0)::INT), avg((d = 0)::INT), avg((d = 0)::INT) FROM s
UNION ALL SELECT 'M', count(*), 1, NULL, NULL, NULL, NULL, avg((m <> 0)::INT), avg((m <> 0)::INT), NULL FROM s""")
def q49_state_summary(spark, sf):
    made = F.explode(F.array(*[F.struct(F.lit(s).alias("state"), F.expr(x).alias("prediction")) for s, x in SAYS.items()]))
    rows = read(spark, sf, "benchmark").select("item_id", made.alias("s")).select(F.concat_ws("::", F.col("item_id").cast("string"), "s.state").alias("id"), F.col("item_id").cast("string").alias("orbit_id"), "s.state", "s.prediction", F.array(F.concat(F.lit("gold "), F.col("item_id").cast("string"))).alias("answers"), F.array(F.lit(1), F.lit(3)).alias("support"), (F.col("s.state") != "M").alias("answerable"))
    out = scoring.evaluate(rows.drop("prediction"), rows.select("id", "prediction"))["state_summary"]
    return out.select("state", "count", *[F.round(c, 9).alias(c) for c in out.columns if c not in ("state", "count")])


#: step % 10 of a ledger row that is spoilt, and how.
SPOILT = {3: "missing_step", 4: "not_finite", 5: "flag_false", 6: "batch_differs", 7: "consumed_differs", 8: "rate_differs", 9: "repeated_step"}


@query("WITH n AS (SELECT count(*) // 8 AS n FROM customer) SELECT s AS optimizer_step, CASE s % 10 " + " ".join(f"WHEN {m} THEN '{f}'" for m, f in SPOILT.items()) + " END AS fault FROM n, range(1, 1000000) AS t(s) WHERE s <= n AND s % 10 >= 3 UNION ALL SELECT n + 1, 'extra_step' FROM n")
def q35_ledger_check(spark, sf):
    """The step ledger of a run over all customers, with planted faults of every kind."""
    n = read(spark, sf, "customer").count() // 8
    plan = audits.schedule(read(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("orbit_id")))
    step, bad = (F.col("batch") + 1), lambda m: (F.col("batch") + 1) % 10 == m
    rows = audits.batch_digests(plan).where(F.col("batch") < n).where(~bad(3)).select(
        step.cast("long").alias("optimizer_step"), F.when(bad(6), "x").otherwise(F.col("orbit_batch_sha256")).alias("orbit_batch_sha256"),
        (step * 8 + F.when(bad(7), 1).otherwise(0)).cast("long").alias("consumed_orbits"), (stats.cosine_rate(F.col("batch"), steps=n) + F.when(bad(8), 1e-6).otherwise(0.0)).alias("learning_rate_applied"),
        F.when(bad(4), float("nan")).otherwise(F.lit(1.0)).alias("grad_norm_preclip"), (~bad(5)).alias("finite"),
    )
    more = spark.createDataFrame([(n + 1, "y", 0, 0.0, 1.0, True)], rows.schema)
    ledger = cut(rows.unionByName(rows.where("optimizer_step % 10 = 9")).unionByName(more), "ledger")
    return audits.ledger_faults(ledger, plan, steps=n)


@query("SELECT s AS step, round(CASE WHEN s < 8 THEN 2e-4 * s / 8 ELSE 2e-4 * 0.5 * (1 + cos(pi() * (s - 8) / 232)) END, 12) AS rate FROM range(241) AS t(s)")
def q50_cosine_rate(spark, sf):
    return spark.range(241).select(F.col("id").alias("step"), F.round(stats.cosine_rate(F.col("id")), 12).alias("rate"))


@query(f"WITH {K} SELECT id AS orbit_id FROM k WHERE v IN (1, 2, 3, 4)")
def q51_triples(spark, sf):
    """Groups of records that are not three states in order: one is missing, two are swapped, a sealed one, two splits."""
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 12).alias("v"))
    state = F.posexplode(F.when(F.col("v") == 1, F.array(F.lit("C"), F.lit("D"))).when(F.col("v") == 2, F.array(*map(F.lit, "CMD"))).otherwise(F.array(*map(F.lit, "CDM"))))
    rows = c.select("k", "v", state.alias("at", "state"))
    orbit = F.concat(F.lit("c"), F.col("k").cast("string"))
    return audits.triples(rows.select(
        orbit.alias("orbit_id"), F.concat_ws("::", orbit, "state").alias("id"), "state", (F.col("k") * 3 + F.col("at")).alias("place"), F.when((F.col("v") == 4) & (F.col("at") == 1), "dev").otherwise("train").alias("split"),
        F.lit(True).alias("training_read_allowed"), ((F.col("v") == 3) & (F.col("at") == 2)).alias("sealed"),
    )).select("orbit_id")


@query("SELECT l_returnflag, l_linestatus, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")) + " FROM lineitem GROUP BY 1, 2")
def q52_micro_means(spark, sf):
    out = audits.micro_means(read(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")
    return out.select("l_returnflag", "l_linestatus", *[F.round(c, 6).alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")])


@query("SELECT lang, source, count(*) AS n, min(n_chars) AS min, quantile_disc(n_chars, 0.5) AS p50, quantile_disc(n_chars, 0.95) AS p95, quantile_disc(n_chars, 0.99) AS p99, max(n_chars) AS max, count(*) FILTER (n_chars > 3000) AS over_limit FROM documents GROUP BY 1, 2")
def q53_lengths_by_group(spark, sf):
    return audits.length_audit(read(spark, sf, "documents"), 3000, "n_chars", "lang", "source")


@query(f"WITH {K}, {GOOD} SELECT id, orbit_id, 'goal' || ks || '|' || {HAS} AS answers, '0,1' AS support, true AS answerable FROM e".replace("STRING", "VARCHAR"))
def q54_adapt_gold(spark, sf):
    rows = _pairs(spark, sf).where("reason = 'eligible'").select("id", F.concat(F.lit(PREFIX), F.substring(sha("id"), 1, 20)).alias("orbit_id"), F.lit("C").alias("state"), "complete.answer", "complete.answer_aliases", "complete.paragraphs", "complete.answerable")
    return records.adapt_gold(rows).select("id", "orbit_id", F.array_join("answers", "|").alias("answers"), F.array_join("support", ",").alias("support"), "answerable")


JSON_ROW = "doc_id bigint, text string, lang string, n_chars bigint"


@query("SELECT doc_id, sha256(text) AS text_sha, lang, n_chars, NULL::VARCHAR AS fault FROM documents")
def q55_jsonl_round_trip(spark, sf):
    """All documents written as canonical JSON lines and read again by the strict scan."""
    path = shared_path(spark, "lines")
    rows = read(spark, sf, "documents").select("doc_id", "text", "lang", "n_chars")
    jsonl.write_canonical(rows, path, ["doc_id"])
    return jsonl.read_jsonl(spark, path, JSON_ROW).select("doc_id", sha("text").alias("text_sha"), "lang", "n_chars", "fault")


@query("SELECT doc_id, text FROM documents WHERE doc_id % 3 = 0 AND doc_id IN (SELECT doc_id FROM labels)")
def q56_reread_release(spark, sf):
    """Full rows of the labelled documents, released by split; only the open split is read."""
    rows = jsonl.reread(read(spark, sf, "documents"), read(spark, sf, "labels"), "doc_id")
    split = F.element_at(F.array(*map(F.lit, ("train", "dev", "shadow"))), (F.col("doc_id") % 3 + 1).cast("int"))
    path = shared_path(spark, "release")
    jsonl.write_release(rows.withColumn("split", split).withColumn("sealed", F.col("split") == "shadow").withColumn("training_read_allowed", F.col("split") != "shadow"), path)
    return jsonl.read_split(spark, path, "train").select("doc_id", "text")


@query(None)
def q57_render_records(spark, sf):
    """Prompts and completions of the records that may be read, from whitelisted columns only."""
    rows = _build(spark, sf).records.where("NOT sealed")
    return records.render_records(rows)
