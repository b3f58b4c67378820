"""The engine's operators on the driver's tables, one query each, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import stats, text
from tessera.functions.digest import joined_sha, mod_pair, sha
from tessera.operators import audits, comparison, donors, probes, scoring, splits
from tessera.operators.components import key_components
from tessera.operators.pairing import alias_policy, reason_counts
from tessera.operators.phrases import band_counts, phrase_matches, token_overlaps, without_phrases
from tessera.operators.ranking import stable_folds, top

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# SQL texts shared by several oracles.
TOK = r"regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[\p{{L}}\p{{N}}_]+')".format
PUNCT = text.PUNCTUATION.replace("'", "''")
NORM = ("array_to_string(list_filter(regexp_split_to_array(trim(translate(lower({0}), '" + PUNCT.replace("{", "{{").replace("}", "}}") + r"', '')), '\s+'), lambda t: t NOT IN ('a', 'an', 'the', '')), ' ')").format
JAC = "coalesce(len(list_intersect({0}, {1})) / nullif(len(list_distinct(list_concat({0}, {1}))), 0), 0)".format


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User and assistant texts of a conversation, two turns at a time, by one shuffle."""
    pick = lambda role: F.max(F.when(F.col("role") == role, F.col("text")))
    return read(spark, sf_dir, "conversations").groupBy("conv_id", F.floor(F.col("turn") / 2).alias("pair")).agg(F.count("*").alias("n"), pick("user").alias("said"), pick("assistant").alias("reply"))


PAIRS_SQL = "SELECT conv_id, turn // 2 AS pair, count(*) AS n, max(CASE WHEN role = 'user' THEN text END) AS said, max(CASE WHEN role = 'assistant' THEN text END) AS reply FROM conversations GROUP BY ALL"


@query(f"SELECT doc_id, len({TOK('text')}) AS n_tokens, len(list_distinct({TOK('text')})) AS n_distinct FROM documents")
def q01_token_counts(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("n_tokens"), F.size(text.token_set(F.col("text"))).cast("long").alias("n_distinct"))


@query("SELECT doc_id, CAST((row_number() OVER (ORDER BY sha256('folds' || chr(10) || doc_id), doc_id) - 1) % 5 AS INT) AS fold FROM documents")
def q02_sha_folds(spark, sf):
    return stable_folds(read(spark, sf, "documents"), "doc_id", "folds")


@query(f"WITH d AS (SELECT doc_id, ' ' || array_to_string({TOK('text')}, ' ') || ' ' AS t FROM documents), b AS (SELECT item_id, ' ' || array_to_string({TOK('text')}, ' ') || ' ' AS p FROM benchmark) SELECT doc_id, item_id FROM d JOIN b ON contains(t, p) AND p <> '  '")
def q03_phrase_containment(spark, sf):
    return phrase_matches(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


@query("SELECT source, round(regr_slope(length(text), doc_id), 6) AS slope, round(stddev_pop(length(text)), 6) AS std FROM documents GROUP BY source")
def q04_slot_slope_std(spark, sf):
    n = F.length("text").cast("double")
    return read(spark, sf, "documents").groupBy("source").agg(F.round(F.regr_slope(n, F.col("doc_id").cast("double")), 6).alias("slope"), F.round(F.stddev_pop(n), 6).alias("std"))


@query("SELECT count(*) AS n, min(n_chars) AS min, quantile_disc(n_chars, 0.5) AS p50, quantile_disc(n_chars, 0.95) AS p95, quantile_disc(n_chars, 0.99) AS p99, max(n_chars) AS max, count(*) FILTER (n_chars > 6144) AS over_limit FROM documents")
def q05_nearest_rank_pctl(spark, sf):
    return audits.length_audit(read(spark, sf, "documents"), 6144, "n_chars")


@query(r"SELECT doc_id, length(text) AS n_length, len(regexp_extract_all(text, '[0-9]')) AS n_digits, len(regexp_extract_all(text, '[!-/:-@\[-`{-~]')) AS n_punct FROM documents")
def q06_char_features(spark, sf):
    count = lambda p: F.regexp_count(F.col("text"), F.lit(p)).cast("long")
    return read(spark, sf, "documents").select("doc_id", F.length("text").cast("long").alias("n_length"), count("[0-9]").alias("n_digits"), count(r"[!-/:-@\[-`{-~]").alias("n_punct"))


HORNER = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(sha256({0}), ''), lambda c: (instr('0123456789abcdef', c) - 1)::BIGINT)), lambda a, d: (a * 16 + d) % (({1})::BIGINT * ({1})::BIGINT))".format


@query(f"WITH w AS (SELECT doc_id, 1000 + doc_id % 977 AS w, doc_id::VARCHAR AS s FROM documents), h AS (SELECT doc_id, w, {HORNER('s', 'w')} AS v FROM w) SELECT doc_id, v % w AS rest, v // w AS next FROM h")
def q07_horner_mod(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", mod_pair(sha(F.col("doc_id").cast("string")), 1000 + F.col("doc_id") % 977).alias("m"))
    return d.select("doc_id", "m.rest", "m.next")


@query(f"SELECT conv_id, turn, {NORM('text')} AS answer FROM conversations")
def q08_answer_norm(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", text.normalize_answer(F.col("text")).alias("answer"))


@query("SELECT sha256(text) AS sha, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def q09_text_hash_dups(spark, sf):
    return read(spark, sf, "documents").groupBy(sha("text").alias("sha")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query(f"WITH g AS (SELECT source, array_to_string({TOK('text')}, ' ') AS t, count(*) AS c FROM documents GROUP BY ALL) SELECT source, sum(c)::BIGINT AS n, count(*) AS n_distinct, round(coalesce(sum(c * (c - 1) / 2) / nullif(sum(c) * (sum(c) - 1) / 2, 0), 0), 9) AS duplicate_fraction FROM g GROUP BY source")
def q10_normalized_dups(spark, sf):
    g = read(spark, sf, "documents").groupBy("source", sha(text.normalized(F.col("text"))).alias("t")).agg(F.count("*").alias("c"))
    n = F.sum("c").cast("double")
    return g.groupBy("source").agg(F.sum("c").alias("n"), F.count("*").alias("n_distinct"), F.round(F.coalesce(F.try_divide(F.sum(F.col("c") * (F.col("c") - 1) / 2), n * (n - 1) / 2), F.lit(0.0)), 9).alias("duplicate_fraction"))


@query(f"WITH b AS (SELECT ' ' || array_to_string({TOK('text')}, ' ') || ' ' AS p FROM benchmark) SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM b WHERE p <> '  ' AND contains(' ' || array_to_string({TOK('d.text')}, ' ') || ' ', p)) GROUP BY lang")
def q11_phrase_anti_join(spark, sf):
    kept = without_phrases(read(spark, sf, "documents"), read(spark, sf, "benchmark"))
    return kept.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


@query(f"SELECT conv_id, pair, n, length(said) AS n_said, length(reply) AS n_reply, CASE WHEN n <> 2 THEN 'not_two_turns' WHEN said IS NULL OR reply IS NULL THEN 'not_one_of_each' END AS fault FROM ({PAIRS_SQL})")
def q12_pair_pivot(spark, sf):
    fault = F.when(F.col("n") != 2, "not_two_turns").when(F.col("said").isNull() | F.col("reply").isNull(), "not_one_of_each")
    return turn_pairs(spark, sf).select("conv_id", "pair", "n", F.length("said").cast("long").alias("n_said"), F.length("reply").cast("long").alias("n_reply"), fault.alias("fault"))


REASONS = (("no_lines", "n IS NULL"), ("too_many_lines", "n > 6"), ("all_returned", "returned = n"), ("open_lines", "open > 0"), ("cheap", "o_totalprice < 1000"))


@query("WITH l AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_linestatus = 'O') AS open FROM lineitem GROUP BY 1) SELECT CASE " + " ".join(f"WHEN {c} THEN '{r}'" for r, c in REASONS) + " ELSE 'eligible' END AS reason, count(*) AS n FROM orders LEFT JOIN l ON o_orderkey = l_orderkey GROUP BY 1")
def q13_case_reasons(spark, sf):
    lines = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_linestatus") == "O").alias("open"))
    rows = read(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    case = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for r, c in REASONS) + " ELSE 'eligible' END"
    return reason_counts(rows.withColumn("reason", F.expr(case)))


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def q14_reserve_ledger(spark, sf):
    taken = read(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return splits.reserve_ledger(read(spark, sf, "customer").select("c_custkey", "c_nationkey"), taken, "c_custkey")


LINES = "SELECT DISTINCT doc_id, trim(l) AS l FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE trim(l) <> ''"


@query(f"WITH RECURSIVE k AS ({LINES}), f AS (SELECT l, min(doc_id) AS f FROM k GROUP BY l), e AS (SELECT DISTINCT doc_id AS a, f AS b FROM k JOIN f USING (l) WHERE doc_id <> f), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT doc_id, doc_id AS label FROM documents UNION SELECT s.b, r.label FROM r JOIN s ON r.doc_id = s.a) SELECT doc_id, min(label) AS label FROM r GROUP BY doc_id")
def q15_components(spark, sf):
    lines = F.array_distinct(F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.trim(x)), lambda x: x != ""))
    return key_components(read(spark, sf, "documents").select("doc_id", F.transform(lines, lambda x: sha(x)).alias("keys")), "doc_id", "keys")


@query("SELECT split, count(*) // n AS n, 0 AS cut_components, 0 AS in_two_splits FROM (SELECT 1 FROM orders), (VALUES ('train', 4), ('dev', 10), ('shadow', 10)) AS t(split, n) GROUP BY split, n")
def q16_exact_split(spark, sf):
    """Rows of each split, counted again from the orders of its customers: components that lie in it in part, or in two."""
    orders = read(spark, sf, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("component_id"))
    sizes = orders.groupBy("component_id").agg(F.count("*").cast("int").alias("size"))
    n = orders.count()
    placed = splits.assign_splits(sizes, {"train": n // 4, "dev": n // 10, "shadow": n // 10}, "seed")
    by = orders.join(placed, "component_id").groupBy("component_id", "split", "size").agg(F.count("*").alias("rows"))
    twice = by.groupBy("component_id").agg(F.count_distinct("split").alias("splits"))
    return by.join(twice, "component_id").groupBy("split").agg(F.sum("rows").alias("n"), F.count_if(F.col("rows") != F.col("size")).alias("cut_components"), F.count_if(F.col("splits") > 1).alias("in_two_splits"))


@query("WITH k AS (SELECT DISTINCT ['train', 'dev', 'shadow'][doc_id % 3 + 1] AS split, sha256(text) AS key FROM documents) SELECT a.split AS first, b.split AS second, count(*) AS n FROM k a JOIN k b ON a.key = b.key AND a.split < b.split GROUP BY ALL")
def q17_split_overlap(spark, sf):
    rows = read(spark, sf, "documents").select(F.element_at(F.array(*map(F.lit, ("train", "dev", "shadow"))), (F.col("doc_id") % 3 + 1).cast("int")).alias("split"), F.array(sha("text")).alias("leakage_keys"))
    return splits.overlap_counts(rows)


@query(f"WITH t AS (SELECT doc_id, lang, greatest(len({TOK('text')}), 1) AS n FROM documents) SELECT a.lang, count(*) AS n_pairs FROM t a JOIN t b ON a.lang = b.lang AND a.doc_id <> b.doc_id AND b.n BETWEEN greatest(1, ceil(a.n / 1.25)) AND greatest(ceil(a.n / 1.25), floor(a.n * 1.25)) GROUP BY a.lang")
def q18_length_band_join(spark, sf):
    rows = read(spark, sf, "documents").select("lang", F.size(text.tokens(F.col("text"))).alias("n"))
    return band_counts(rows, "lang", "n", 1.25)


STRIDE = "(SELECT min(x) FROM unnest(range(greatest(v // w, 1), greatest(greatest(v // w, 1), least(greatest(v // w, 1) + 64, w - 1)) + 1)) AS u(x) WHERE gcd(x, w) = 1)"


@query(f"WITH w AS (SELECT doc_id, n_chars % 500 + 1 AS w, 'seed' || chr(10) || doc_id AS s FROM documents), h AS (SELECT doc_id, w, {HORNER('s', 'w')} AS v FROM w), d AS (SELECT doc_id, w, v % w AS start, coalesce({STRIDE}, 1) AS stride FROM h) SELECT doc_id, start, stride, list_sum(list_transform(range(0, least(56, w)), lambda k: (start + k * stride) % w))::BIGINT AS total FROM d")
def q19_stride_sample(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", (F.col("n_chars") % 500 + 1).alias("w"))
    rows = rows.withColumn("d", donors.stride_draw(F.concat_ws("\n", F.lit("seed"), F.col("doc_id").cast("string")), F.col("w")))
    places = F.transform(F.sequence(F.lit(0).cast("long"), F.least(F.lit(donors.DRAWN), F.col("w")) - 1), lambda k: F.pmod(F.col("d.start") + k * F.col("d.stride"), F.col("w")))
    return rows.select("doc_id", "d.start", "d.stride", F.aggregate(places, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query(f"WITH d AS (SELECT doc_id, greatest(len({TOK('text')}), 1) AS n FROM documents), b AS (SELECT item_id, greatest(len({TOK('text')}), 1) AS m FROM benchmark), p AS (SELECT item_id, doc_id, round(2 * abs(ln(n / m)), 9) AS cost FROM b JOIN d ON greatest(n, m) / least(n, m) <= 1.25 + 1e-12), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY cost, sha256('seed' || chr(10) || item_id || chr(10) || doc_id)) AS k FROM p) SELECT item_id, doc_id, cost FROM r WHERE k <= 3")
def q20_topk_donor_cost(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.greatest(F.size(text.tokens(F.col("text"))), F.lit(1)).alias("n"))
    b = read(spark, sf, "benchmark").select("item_id", F.greatest(F.size(text.tokens(F.col("text"))), F.lit(1)).alias("m"))
    band = F.sequence(F.greatest(F.lit(1), F.floor(F.col("m") / 1.25).cast("int")), F.ceil(F.col("m") * 1.25).cast("int"))
    met = b.withColumn("n", F.explode(band)).where(stats.length_ratio(F.col("n"), F.col("m")) <= 1.25 + 1e-12).join(d, "n")
    met = met.withColumn("cost", F.round(2 * F.abs(F.log(F.col("n") / F.col("m"))), 9))
    return top(met, 3, [F.col("cost"), joined_sha("seed", F.col("item_id"), F.col("doc_id"))], "item_id").select("item_id", "doc_id", "cost")


@query(f"WITH s AS (SELECT item_id, list_distinct({TOK('text')}) AS t FROM benchmark) SELECT x.item_id AS a, y.item_id AS b, round({JAC('x.t', 'y.t')}, 9) AS jaccard FROM s x JOIN s y ON x.item_id < y.item_id WHERE len(list_intersect(x.t, y.t)) > 0")
def q21_jaccard_pairs(spark, sf):
    return token_overlaps(read(spark, sf, "benchmark"), "item_id", "text").withColumn("jaccard", F.round("jaccard", 9))


@query(f"WITH q AS (SELECT conv_id, list_distinct({TOK('text')}) AS q FROM conversations WHERE turn = 0), p AS (SELECT conv_id, {JAC('q', f'list_distinct({TOK(chr(116)+chr(101)+chr(120)+chr(116))})')} AS j FROM conversations JOIN q USING (conv_id) WHERE turn > 0) SELECT conv_id, round(avg(j), 9) AS mean, round(max(j), 9) AS max, round(list_sum(list_sort(list(j), 'DESC')[1:2]), 9) AS top2, round(avg((j > 0)::INT), 9) AS part FROM p GROUP BY conv_id")
def q22_overlap_features(spark, sf):
    c = read(spark, sf, "conversations")
    p = F.struct(F.col("turn").alias("idx"), F.lit("").alias("title"), F.col("text").alias("paragraph_text"))
    by = c.groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("question"), F.array_sort(F.collect_list(F.when(F.col("turn") > 0, p))).alias("p")).where("question IS NOT NULL AND size(p) > 0")
    by = by.select("conv_id", stats.semantic_extras(F.col("question"), F.col("p")).alias("x"))
    return by.select("conv_id", *[F.round(F.get("x", F.lit(i)), 9).alias(n) for i, n in ((0, "mean"), (1, "max"), (2, "top2"), (4, "part"))])


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.025), 6) AS low, round(quantile_cont(l_extendedprice, 0.975), 6) AS high FROM lineitem GROUP BY 1")
def q23_interpolated_ci(spark, sf):
    q = F.percentile("l_extendedprice", F.array(F.lit(0.025), F.lit(0.975)))
    return read(spark, sf, "lineitem").groupBy("l_returnflag").agg(q.alias("q")).select("l_returnflag", F.round(F.get("q", F.lit(0)), 6).alias("low"), F.round(F.get("q", F.lit(1)), 6).alias("high"))


# Lines that test every verdict of the grammar, chosen by item.
LINES_OF = (
    "'S | evidence=[P00,P03] | answer=' || item_id",
    "' S\t|evidence = [ P01 , P02 ]| answer= two words  '",
    "'U | evidence=[] | answer=INSUFFICIENT_EVIDENCE'",
    "'S | evidence=[P03,P01] | answer=x'",
    "'S | evidence=[P01,P01] | answer=x'",
    "'S | evidence=[] | answer=x'",
    "'S | evidence=[P01] | answer=INSUFFICIENT_EVIDENCE'",
    "'U | evidence=[P01] | answer=INSUFFICIENT_EVIDENCE'",
    "'U | evidence=[] | answer=x'",
    "'S | evidence=[P20] | answer=x'",
    "'The answer: S | evidence=[P01] | answer=x'",
    "'S | evidence=[P01] | answer='",
    "'S | evidence=[P01] | answer=x' || chr(10)",
    "NULL",
)
CASE = "CASE " + " ".join(f"WHEN item_id % {len(LINES_OF)} = {i} THEN {x}" for i, x in enumerate(LINES_OF)) + " END"
RE2 = text.GRAMMAR.replace("'", "''")


@query(rf"""WITH p AS (SELECT item_id, {CASE} AS x FROM benchmark),
m AS (SELECT item_id, x, regexp_matches(x, '{RE2}') AS ok, regexp_extract(x, '{RE2}', 1) AS s, list_transform(regexp_extract_all(regexp_extract(x, '{RE2}', 2), 'P(\d\d)', 1), lambda t: t::INT) AS e, trim(regexp_extract(x, '{RE2}', 3)) AS a FROM p),
r AS (SELECT *, CASE WHEN x IS NULL THEN 'prediction_not_string' WHEN NOT ok THEN 'grammar_mismatch' WHEN e <> list_sort(list_distinct(e)) THEN 'evidence_not_unique_strictly_sorted' WHEN a = '' THEN 'empty_answer'
  WHEN s = 'S' AND len(e) = 0 THEN 'answerable_without_evidence' WHEN s = 'S' AND a = 'INSUFFICIENT_EVIDENCE' THEN 'answerable_with_sentinel' WHEN s = 'U' AND len(e) > 0 THEN 'unanswerable_with_evidence' WHEN s = 'U' AND a <> 'INSUFFICIENT_EVIDENCE' THEN 'unanswerable_without_sentinel' END AS error FROM m)
SELECT item_id, error IS NULL AS valid, CASE WHEN error IS NULL THEN s END AS status, CASE WHEN error IS NULL THEN a ELSE '' END AS answer, CASE WHEN error IS NULL THEN len(e) ELSE 0 END AS n_support, error FROM r""")
def q24_parse_grammar(spark, sf):
    rows = read(spark, sf, "benchmark").select("item_id", F.expr(CASE.replace("\t", "\\t")).alias("x"))
    return rows.select("item_id", text.parse_prediction(F.col("x")).alias("r")).select("item_id", "r.valid", "r.status", "r.answer", F.size("r.support").cast("long").alias("n_support"), "r.error")


BAG = "list_filter(string_split({0}, ' '), lambda t: t <> '')".format


@query(f"WITH p AS (SELECT conv_id, pair, {BAG(NORM('said'))} AS g, {BAG(NORM('reply'))} AS p FROM ({PAIRS_SQL}) WHERE said IS NOT NULL AND reply IS NOT NULL), k AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(g), lambda t: least(len(list_filter(g, lambda x: x = t)), len(list_filter(p, lambda x: x = t))))), 0) AS n FROM p) SELECT conv_id, pair, round(CASE WHEN len(g) = 0 OR len(p) = 0 THEN (len(g) = len(p))::INT ELSE 2.0 * n / (len(g) + len(p)) END, 9) AS f1 FROM k")
def q25_token_f1(spark, sf):
    rows = turn_pairs(spark, sf).where("said IS NOT NULL AND reply IS NOT NULL")
    return rows.select("conv_id", "pair", F.round(text.answer_f1(F.col("reply"), F.col("said")), 9).alias("f1"))


@query("WITH s AS (SELECT l_orderkey, coalesce(list(DISTINCT l_linenumber) FILTER (l_returnflag = 'R'), []) AS p, coalesce(list(DISTINCT l_linenumber) FILTER (l_linestatus = 'F'), []) AS g FROM lineitem GROUP BY 1), n AS (SELECT *, len(list_intersect(p, g)) AS n FROM s) SELECT l_orderkey, (len(p) = len(g) AND n = len(g))::INT::DOUBLE AS em, round(CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1 ELSE coalesce(2.0 * n / nullif(len(p) + len(g), 0), 0) END, 9) AS f1, round(coalesce(n / nullif(len(p), 0), 0), 9) AS precision, round(coalesce(n / nullif(len(g), 0), 0), 9) AS recall FROM n")
def q26_support_f1(spark, sf):
    pick = lambda c, v: F.collect_set(F.when(F.col(c) == v, F.col("l_linenumber")))
    sets = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(pick("l_returnflag", "R").alias("p"), pick("l_linestatus", "F").alias("g"))
    s = sets.select("l_orderkey", text.support_scores(F.col("p"), F.col("g")).alias("s"))
    return s.select("l_orderkey", *[F.round(f"s.{c}", 9).alias(c) for c in ("em", "f1", "precision", "recall")])


# Gold is `gold <item>` with slots 1 and 3; what a state says depends on the item.
SAYS = {
    "C": "CASE WHEN item_id % 5 < 3 THEN 'S | evidence=[P01,P03] | answer=gold ' || item_id WHEN item_id % 5 = 3 THEN 'S | evidence=[P01] | answer=gold' ELSE 'no line' END",
    "D": "CASE WHEN item_id % 4 = 0 THEN 'U | evidence=[] | answer=INSUFFICIENT_EVIDENCE' ELSE 'S | evidence=[P01,P02,P03] | answer=The gold, ' || item_id END",
    "M": "CASE WHEN item_id % 3 = 0 THEN 'S | evidence=[P01] | answer=x' ELSE 'U | evidence=[] | answer=INSUFFICIENT_EVIDENCE' END",
}


@query("""WITH s AS (SELECT item_id, item_id % 5 < 4 AS c_says, CASE WHEN item_id % 5 < 3 THEN 1.0 WHEN item_id % 5 = 3 THEN 2.0 / 3 ELSE 0 END AS c, CASE WHEN item_id % 5 < 3 THEN 1.0 WHEN item_id % 5 = 3 THEN 2.0 / 3 ELSE 0 END AS cs, item_id % 4 <> 0 AS d_says, CASE WHEN item_id % 4 <> 0 THEN 1.0 ELSE 0 END AS d, CASE WHEN item_id % 4 <> 0 THEN 0.8 ELSE 0 END AS ds, item_id % 3 <> 0 AS m_no, (item_id % 5 < 4)::INT AS c_ok FROM benchmark)
SELECT item_id::VARCHAR AS orbit_id, round(least(c, d), 9) AS cd_min_f1, round(CASE WHEN c_says AND d_says AND m_no THEN least(c, d) ELSE 0 END, 9) AS orbit_answer_suff_f1, round(CASE WHEN c_says AND d_says AND m_no THEN least(cs, ds) ELSE 0 END, 9) AS orbit_support_suff_f1, (CASE WHEN d_says THEN 0 ELSE 1 END) / 2 AS false_refusal_rate, m_no::INT::DOUBLE AS m_refusal_rate, round((c_ok + 2) / 3, 9) AS parse_rate FROM s""")
def q27_orbit_scores(spark, sf):
    b = read(spark, sf, "benchmark").select("item_id")
    made = F.explode(F.array(*[F.struct(F.lit(s).alias("state"), F.expr(x).alias("prediction")) for s, x in SAYS.items()]))
    rows = b.select("item_id", made.alias("s")).select(F.concat_ws("::", F.col("item_id").cast("string"), "s.state").alias("id"), F.col("item_id").cast("string").alias("orbit_id"), "s.state", "s.prediction", F.array(F.concat(F.lit("gold "), F.col("item_id").cast("string"))).alias("answers"), F.array(F.lit(1), F.lit(3)).alias("support"), (F.col("s.state") != "M").alias("answerable"))
    out = scoring.evaluate(rows.drop("prediction"), rows.select("id", "prediction"))["orbits"]
    return out.select("orbit_id", *[F.round(c, 9).alias(c) for c in ("cd_min_f1", "orbit_answer_suff_f1", "orbit_support_suff_f1", "false_refusal_rate", "m_refusal_rate", "parse_rate")])


@query("WITH g AS (SELECT doc_id AS i, count(*) AS g FROM documents GROUP BY 1), p AS (SELECT doc_id AS j, count(*) AS p FROM labels GROUP BY 1) SELECT count(g) AS gold_ids, count(*) FILTER (g IS NOT NULL AND p IS NOT NULL) AS matched, count(*) FILTER (p IS NULL) AS missing, count(*) FILTER (g IS NULL) AS extra, count(*) FILTER (g > 1) AS repeated_gold, count(*) FILTER (p > 1) AS repeated_predictions FROM g FULL JOIN p ON i = j")
def q28_align_check(spark, sf):
    name = lambda t: read(spark, sf, t).select(F.col("doc_id").alias("id"))
    return scoring.alignment(name("documents"), name("labels")).drop("first_missing", "first_extra")


@query("WITH r AS (SELECT quality, avg(k) OVER (PARTITION BY n_chars) AS k FROM (SELECT quality, n_chars, row_number() OVER (ORDER BY n_chars) AS k FROM labels JOIN documents USING (doc_id))) SELECT round((sum(k) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2) / (count(*) FILTER (quality = 1) * count(*) FILTER (quality = 0)), 9) AS auc, count(*) FILTER (quality = 1) AS positives, count(*) FILTER (quality = 0) AS negatives FROM r")
def q29_auc(spark, sf):
    rows = read(spark, sf, "labels").join(read(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return probes.auc(rows, label="quality", score="n_chars").select(F.round("auc", 9).alias("auc"), "positives", "negatives")


@query(None)
def q30_oof_logistic(spark, sf):
    rows = read(spark, sf, "labels").join(read(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    t = F.col("text")
    share = lambda p: F.regexp_count(t, F.lit(p)) / F.greatest(F.length(t), F.lit(1))
    features = F.array(F.log1p(F.length(t).cast("double")), share("[A-Z]"), share(r"\p{Punct}"), share("[ \n]"), share("[0-9]"))
    made = rows.select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("group"), F.when(F.col("quality") == 1, "D").otherwise("C").alias("state"), F.lit("train").alias("split"), features.alias("features"))
    return probes.auc(probes.oof_scores(made, "folds"), "pair").select("pair", F.round("auc", 4).alias("auc"), F.round("separability", 4).alias("separability"))


ARMS = "SELECT c_nationkey AS unit, count(*) AS k, round(avg(c_acctbal) / 10000, 9) AS control, round(avg(c_acctbal + c_custkey % 700) / 10000, 9) AS treatment FROM customer GROUP BY c_nationkey"


def arm_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("orbit_id"))
    return c.agg(F.round(F.avg("c_acctbal") / 10000, 9).alias("control"), F.round(F.avg(F.col("c_acctbal") + F.col("c_custkey") % 700) / 10000, 9).alias("treatment")).withColumn("metric", F.lit("balance"))


DRAW = HORNER("'20260814' || chr(10) || b || chr(10) || i", "n")


@query(f"WITH a AS (SELECT *, row_number() OVER (ORDER BY unit) - 1 AS place, count(*) OVER () AS n FROM ({ARMS})), t AS (SELECT b, i, n FROM (SELECT max(n) AS n FROM a), range(200) AS x(b), range(100) AS y(i) WHERE i < n), s AS (SELECT b, avg(treatment - control) AS m FROM (SELECT b, {DRAW} % n AS place FROM t) JOIN a USING (place) GROUP BY b) SELECT (SELECT round(avg(treatment - control), 9) FROM a) AS delta, round(quantile_cont(m, 0.025), 9) AS ci_low, round(quantile_cont(m, 0.975), 9) AS ci_high FROM s")
def q31_bootstrap(spark, sf):
    out = comparison.digest_bootstrap(arm_rows(spark, sf), samples=200)  # as many as the SQL draws; q40 has them all
    return out.select(*[F.round(k, 9).alias(k) for k in ("delta", "ci_low", "ci_high")])


INTERVALS = "SELECT metric, round(avg(l_discount) + base, 6) AS control, round(avg(l_tax) + base + gain, 6) AS treatment, round(avg(l_tax) - avg(l_discount) + gain, 6) AS delta, round(avg(l_tax) - avg(l_discount) + gain - 0.02, 6) AS ci_low FROM lineitem, (VALUES {0}) AS m(metric, base, gain) GROUP BY metric, base, gain".format(
    ", ".join(f"('{m}', {0.9 if m == 'parse_rate' else 0.5}, {0.02 * i})" for i, m in enumerate(comparison.METRICS))
)


@query(f"WITH i AS ({INTERVALS}) " + " UNION ALL ".join(f"SELECT '{g}' AS gate, {r} AS passed FROM i WHERE metric = '{m}'" for g, m, r in comparison.GATES) + " UNION ALL SELECT 'run_integrity', true")
def q32_gates(spark, sf):
    rows = read(spark, sf, "lineitem").agg(F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"))
    made = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(0.9 if m == "parse_rate" else 0.5).alias("base"), F.lit(0.02 * i).alias("gain")) for i, m in enumerate(comparison.METRICS)]))
    rows = rows.select("d", "t", made.alias("m")).select("m.metric", F.round(F.col("d") + F.col("m.base"), 6).alias("control"), F.round(F.col("t") + F.col("m.base") + F.col("m.gain"), 6).alias("treatment"), F.round(F.col("t") - F.col("d") + F.col("m.gain"), 6).alias("delta"), F.round(F.col("t") - F.col("d") + F.col("m.gain") - 0.02, 6).alias("ci_low"))
    return comparison.gates(rows, {"same_data": True}).select("gate", "passed")


ONE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))".format


@query(f"SELECT conv_id, sha256('{text.PROMPT_HEAD}' || 'Question: Conversation ' || conv_id || chr(10) || 'Paragraph registry:' || chr(10) || string_agg('[P' || lpad(turn::VARCHAR, 2, '0') || '] ' || role || ': ' || {ONE('text')}, chr(10) ORDER BY turn)) AS prompt_sha FROM conversations GROUP BY conv_id")
def q33_render_prompt(spark, sf):
    p = F.struct(F.col("turn").cast("int").alias("idx"), F.col("role").alias("title"), F.col("text").alias("paragraph_text"))
    by = read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(p)).alias("p"))
    prompt = text.render_prompt(F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")), F.col("p"), F.size("p"))
    return by.select("conv_id", sha(prompt).alias("prompt_sha"))


@query("WITH l AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'new' ELSE l_returnflag END AS t, CASE WHEN l_linenumber = 1 THEN 'text' WHEN l_linenumber = 3 THEN 'third' ELSE l_linestatus END AS x, l_linenumber IN (1, 3) AS c, l_returnflag FROM lineitem) SELECT l_orderkey, string_agg(l_linenumber || ':' || CASE WHEN l_linenumber = 3 THEN 'new' ELSE t END || ':' || x || ':' || CASE WHEN c THEN 'false' ELSE (l_returnflag = 'R')::VARCHAR END, ',' ORDER BY l_linenumber, l_returnflag, x) AS slots FROM l GROUP BY 1")
def q34_slot_overwrite(spark, sf):
    p = F.struct(F.col("l_linenumber").alias("idx"), F.col("l_returnflag").alias("title"), F.col("l_linestatus").alias("paragraph_text"), (F.col("l_returnflag") == "R").alias("is_supporting"))
    by = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(p)).alias("p"))
    change = F.array(*[F.struct(F.lit(s).alias("slot"), F.lit("new").alias("title"), F.lit(x).alias("paragraph_text")) for s, x in ((1, "text"), (3, "third"))])
    shown = F.transform(donors.overwrite(F.col("p"), change), lambda x: F.concat_ws(":", x["idx"].cast("string"), x["title"], x["paragraph_text"], x["is_supporting"].cast("string")))
    return by.select("l_orderkey", F.array_join(shown, ",").alias("slots"))


@query(f"WITH p AS (SELECT n, [said] AS c, [reply] AS m, list_distinct([array_to_string({TOK('said')}, ' ')]) AS nc, list_distinct([array_to_string({TOK('reply')}, ' ')]) AS nm FROM ({PAIRS_SQL}) WHERE said IS NOT NULL AND reply IS NOT NULL), e AS (SELECT n, c <> m AS other, (NOT list_contains(nc, nm[1]))::INT AS om, (NOT list_contains(nm, nc[1]))::INT AS oc FROM p) SELECT n, count(*) FILTER (other) AS different_lists, count(*) FILTER (om > 0) AS missing_only_rows, sum(om)::BIGINT AS missing_only_values, count(*) FILTER (oc > 0) AS complete_only_rows, sum(oc)::BIGINT AS complete_only_values FROM e GROUP BY n")
def q36_alias_policy(spark, sf):
    rows = turn_pairs(spark, sf).where("said IS NOT NULL AND reply IS NOT NULL")
    rows = rows.select("n", F.struct(F.array("said").alias("answer_aliases")).alias("complete"), F.struct(F.array("reply").alias("answer_aliases")).alias("missing"))
    return alias_policy(rows, "n")


@query("WITH c AS (SELECT conv_id, count(*) AS n, min(turn) AS low, max(turn) AS high, count(DISTINCT turn) AS turns, count(*) FILTER (trim(text) = '') AS blank FROM conversations GROUP BY 1) SELECT count(*) AS conversations, count(*) FILTER (low = 0) AS start_at_0, count(*) FILTER (high = n - 1 AND turns = n) AS consecutive, count(*) FILTER (blank = 0) AS no_blank FROM c")
def q37_invariants(spark, sf):
    by = read(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.min("turn").alias("low"), F.max("turn").alias("high"), F.count_distinct("turn").alias("turns"), F.count_if(F.trim("text") == "").alias("blank"))
    return by.agg(F.count("*").alias("conversations"), F.count_if(F.expr("low = 0")).alias("start_at_0"), F.count_if(F.expr("high = n - 1 AND turns = n")).alias("consecutive"), F.count_if(F.expr("blank = 0")).alias("no_blank"))


@query("SELECT doc_id, (row_number() OVER (ORDER BY sha256('17' || chr(10) || doc_id), doc_id) - 1) // 8 AS batch FROM documents")
def q39_schedule(spark, sf):
    plan = audits.schedule(read(spark, sf, "documents"), "doc_id")
    return plan.select("doc_id", "batch")


@query(None)
def q40_exact_bootstrap(spark, sf):
    """The exact 10,000 resamples; a SQL engine has no such generator."""
    out = comparison.bootstrap(arm_rows(spark, sf))
    return out.select(*[F.round(k, 9).alias(k) for k in ("delta", "ci_low", "ci_high")])
