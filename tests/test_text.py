import math
import re
import string
import unicodedata

from pyspark.sql import functions as F

from tessera.functions import stats, text
from tessera.functions.digest import mod_pair, sha

GOOD = {
    "S | evidence=[P00,P03] | answer=Ada": ("S", [0, 3], "Ada"),
    " S\t|evidence = [ P01 , P02 ]| answer= two words \t": ("S", [1, 2], "two words"),
    "U | evidence=[] | answer=INSUFFICIENT_EVIDENCE": ("U", [], "INSUFFICIENT_EVIDENCE"),
}
BAD = {
    "So: S | evidence=[P00] | answer=x": "grammar_mismatch",
    "S | evidence=[P00] | answer=x and\nmore": "grammar_mismatch",
    "S | evidence=[P00] | answer=x\n": "grammar_mismatch",
    "s | evidence=[P00] | answer=x": "grammar_mismatch",
    "S | evidence=[P6] | answer=x": "grammar_mismatch",
    "S | evidence=[P20] | answer=x": "grammar_mismatch",
    "S | evidence=[P01,P01] | answer=x": "evidence_not_unique_strictly_sorted",
    "S | evidence=[P02,P01] | answer=x": "evidence_not_unique_strictly_sorted",
    "S | evidence=[] | answer=x": "answerable_without_evidence",
    "S | evidence=[P01] | answer=INSUFFICIENT_EVIDENCE": "answerable_with_sentinel",
    "U | evidence=[P01] | answer=INSUFFICIENT_EVIDENCE": "unanswerable_with_evidence",
    "U | evidence=[] | answer=x": "unanswerable_without_sentinel",
    "S | evidence=[P01] | answer=": "empty_answer",
    "S | evidence=[P01] | answer=x | more": "grammar_mismatch",
    None: "prediction_not_string",
}


def test_grammar(spark):
    rows = spark.createDataFrame([(x,) for x in [*GOOD, *BAD]], "x string").select("x", text.parse_prediction(F.col("x")).alias("r")).collect()
    for r in rows:
        if r["x"] in GOOD:
            assert (r["r"]["status"], r["r"]["support"], r["r"]["answer"]) == GOOD[r["x"]] and r["r"]["valid"]
        else:
            assert r["r"]["error"] == BAD[r["x"]] and not r["r"]["valid"] and r["r"]["answer"] == ""


TEXTS = ["  América—RAIL\nCity  ", "The North, ", "ﬁne ＡＢＣ straße", "", "a_b 12½ ǅ", "don't-stop", "the an a", "x  y\tz"]


def python_tokens(s):
    return re.findall(r"\w+", unicodedata.normalize("NFKC", s).casefold())


def python_answer(s):
    s = "".join(c for c in s.lower() if c not in string.punctuation)
    return " ".join(re.sub(r"\b(a|an|the)\b", " ", s).split())


def test_tokens_and_answers_equal_python(spark):
    df = spark.createDataFrame([(x,) for x in TEXTS], "x string")
    for r in df.select("x", text.exact_tokens("x").alias("e"), text.tokens(F.col("x")).alias("n"), text.normalize_answer(F.col("x")).alias("a")).collect():
        assert r["e"] == python_tokens(r["x"])
        assert r["a"] == python_answer(r["x"])
        if unicodedata.is_normalized("NFKC", r["x"]):
            assert r["n"] == r["e"]


def test_scalar_scores(spark):
    golds = F.array(F.lit("northern direction"), F.lit("the north"))
    ints = lambda *x: F.array(*map(F.lit, x)).cast("array<int>")
    one = spark.range(1).select(
        text.best_answer(F.lit("north"), golds).alias("best"), text.support_scores(ints(6, 10), ints(6, 12)).alias("s"), text.support_scores(ints(), ints()).alias("empty"), text.answer_f1(F.lit("the"), F.lit("an")).alias("nothing"),
        text.answer_f1(F.lit("x x y"), F.lit("x y y")).alias("bag"), text.contains_phrase(text.tokens(F.lit("an American city")), text.tokens(F.lit("America"))).alias("part"), text.contains_phrase(text.tokens(F.lit("an American city")), text.tokens(F.lit("American City"))).alias("whole"),
        text.contains_phrase(text.tokens(F.lit("x")), text.tokens(F.lit(""))).alias("none"), text.jaccard(ints(), ints()).alias("j"),
    ).first()
    assert tuple(one["best"]) == (1.0, 1.0)
    assert tuple(one["s"]) == (0.0, 0.5, 0.5, 0.5)
    assert tuple(one["empty"]) == (1.0, 1.0, 0.0, 0.0)
    assert one["nothing"] == 1.0 and abs(one["bag"] - 2 / 3) < 1e-12
    assert (one["part"], one["whole"], one["none"], one["j"]) == (False, True, False, 0.0)


def jac(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def python_surface(ps):
    combined = [p[0] + " " + p[1] for p in ps]
    n = len(ps)
    mean = lambda v: sum(v) / len(v) if v else 0.0
    std = lambda v: math.sqrt(mean([(x - mean(v)) ** 2 for x in v]))
    dup = lambda v: sum(v[i] == v[j] for i in range(n) for j in range(i)) / (n * (n - 1) / 2) if n > 1 else 0.0
    sets = lambda v: [set(python_tokens(x)) for x in v]
    pairwise = lambda s: mean([jac(s[i], s[j]) for i in range(n) for j in range(i)])
    chars, words, titles, bodies = [float(len(c)) for c in combined], [float(len(s)) for s in sets(combined)], sets([p[0] for p in ps]), sets([p[1] for p in ps])
    every = "".join(combined)
    mid = (n - 1) / 2
    up, down = sum((i - mid) * (c - mean(chars)) for i, c in enumerate(chars)), sum((i - mid) ** 2 for i in range(n))
    norm = lambda k: [" ".join(python_tokens(p[k])) for p in ps]
    t = [float(len(x)) for x in titles]
    return [float(n), sum(chars), mean(chars), std(chars), min(chars), max(chars), sum(words), mean(words), std(words), mean(t), std(t), dup(norm(0)), dup(norm(1)), pairwise(titles), pairwise(bodies), sum(c.isdigit() for c in every) / len(every), sum(c in string.punctuation for c in every) / len(every), up / down if down else 0.0]


def test_features_equal_python(spark):
    ps = [(f"Title {i % 7}", f"Text {i % 11} about rail, and city with number {i}²!") for i in range(20)]
    rows = [("rail city?", [{"title": a, "paragraph_text": b} for a, b in ps]), ("none", [{"title": "x", "paragraph_text": "y"}])]
    df = spark.createDataFrame(rows, "q string, p array<struct<title:string,paragraph_text:string>>")
    got = df.select(stats.surface_features(F.col("p")).alias("s"), stats.semantic_features(F.col("q"), F.col("p")).alias("t")).collect()
    want = python_surface(ps)
    assert len(got[0]["s"]) == 18 == len(stats.SURFACE) and len(got[0]["t"]) == 23 == len(stats.SEMANTIC)
    assert all(abs(a - b) < 1e-9 for a, b in zip(got[0]["s"], want, strict=True))
    q = set(python_tokens("rail city?"))
    over = [jac(q, set(python_tokens(a + " " + b))) for a, b in ps]
    extra = [sum(over) / 20, max(over), sum(sorted(over)[-2:]), max(jac(q, set(python_tokens(a))) for a, _ in ps), sum(x > 0 for x in over) / 20]
    assert all(abs(a - b) < 1e-9 for a, b in zip(got[0]["t"][18:], extra, strict=True))
    assert got[1]["s"][0] == 1.0 and got[1]["s"][-1] == 0.0


def test_horner_equals_big_integers(spark):
    import hashlib

    rows = [(str(i), 1 + (i * 7919) % 700_000_000) for i in range(200)]
    for r in spark.createDataFrame(rows, "s string, w long").select("s", "w", mod_pair(sha(F.col("s")), F.col("w")).alias("m")).collect():
        d = int(hashlib.sha256(r["s"].encode()).hexdigest(), 16)
        assert (r["m"]["rest"], r["m"]["next"]) == (d % r["w"], d // r["w"] % r["w"])


def test_nearest_rank_median_and_rate(spark):
    a = F.array(*[F.lit(x) for x in (5, 1, 4, 2, 3, 9)])
    one = spark.range(1).select(stats.nearest_rank(a, 0.5).alias("p50"), stats.nearest_rank(a, 0.95).alias("p95"), stats.median(a).alias("m"), *[stats.cosine_rate(F.lit(s)).alias(f"r{s}") for s in (0, 1, 8, 240)]).first()
    assert (one["p50"], one["p95"], one["m"]) == (3, 9, 3.5)
    assert abs(one["r1"] - 2e-4 / 8) < 1e-15 and one["r0"] == 0 and abs(one["r8"] - 2e-4) < 1e-15 and abs(one["r240"]) < 1e-15
