import hashlib
import math

import pytest
from pyspark.sql import functions as F

from twinlens.functions import labels as L
from twinlens.functions import stats as S
from twinlens.functions import text as X


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


LADDER = [
    (("red", "true", None, "1", None), "red"), (("", "yes", "yes", None, None), "refusal"), ((None, "false", "unsafe", None, None), "unsafe"), (("", "0", "0", None, None), "safe"), (("", "n", "", None, None), "non_refusal"),
    (("", None, "maybe", "0.5", None), "pass"), (("", None, None, "nan", None), "fail"), (("", None, None, None, "0.49"), "not_memorized"), (("", None, None, None, "1_0"), "memorized"), (("  ", None, None, "abc", None), ""), ((" a\t", None, None, None, None), "a"),
]


def test_behavior_label(spark):
    df = spark.createDataFrame([(k, *r) for k, (r, _) in enumerate(LADDER)], "k int, semantic_label string, refusal string, unsafe string, pass_score string, memorization_score string")
    got = [r["l"] for r in df.select("k", L.behavior_label().alias("l")).orderBy("k").collect()]
    assert got == [want for _, want in LADDER]
    assert df.filter("k = 6").select(L.update_behavior_label().alias("l")).first()["l"] == ""  # NaN is no score of an update


CONDITIONS = [
    ("overt", "unsafe_safety", ["unsafe", "refusal", "quality_score"], "safety_image_audit"), ("overt", "other", ["refusal", "unsafe", "quality_score"], "safety_image_audit"), ("x", "benign_overrefusal", ["refusal", "unsafe", "quality_score"], "safety_overrefusal_audit"),
    ("membench", "memorization_control", ["memorization_score", "quality_score"], "memorization_copy_detection"), ("hub", "unlearning_target", ["pass_score", "semantic_label", "quality_score"], "unlearning_lineage_audit"), ("x", "explicit", ["pass_score", "quality_score"], "explicit_attribute_pass_fail"),
    ("t2i_compbench", "broad", ["semantic_label", "quality_score"], "composition_pass_fail"), ("x", "benchmark_native", ["quality_score"], "generic_pass_fail"), ("x", "social_bias_default", ["semantic_label", "quality_score"], "attribute_distribution_labeling"), (None, None, ["quality_score"], "generic_pass_fail"),
]


def test_condition_ladders(spark):
    df = spark.createDataFrame([(k, b, c) for k, (b, c, _, _) in enumerate(CONDITIONS)], "k int, benchmark string, condition_type string")
    rows = df.select("k", L.required_signals().alias("r"), L.evaluator_kind().alias("e"), L.applicable_rqs().alias("q")).orderBy("k").collect()
    assert [(list(r["r"]), r["e"]) for r in rows] == [(r, e) for _, _, r, e in CONDITIONS]
    assert rows[4]["q"] == ["unlearning_optional"]
    assert "safety_inheritance" in rows[0]["q"] and "rq3_preference_capability" in rows[5]["q"]


def test_hash_slug_cells(spark):
    want = hashlib.sha1("a␟␟3".encode()).hexdigest()[:16]
    r = one(spark, X.stable_hash(F.lit("a"), F.lit(None), F.lit(3)).alias("h"), X.slugify(F.lit("  Ab  c/d__É서울. ")).alias("s"), X.slugify(F.lit("///")).alias("e"), X.join_distinct(F.lit("a; b;a;; c")).alias("j"), X.normalize_label(F.lit(" Deep Red\t")).alias("n"))
    assert tuple(r) == (want, "ab_c_d_서울", "item", "a; b; c", "deep_red")
    assert X.literal_items("['b', ' a ', '']") == ["a", "b"] and X.literal_items("x| y|") == ["x", "y"] and X.literal_items("x, y") == ["x", "y"] and X.literal_items(" ") == [] and X.literal_items("one") == ["one"] and X.literal_items("[bad") == ["[bad"]
    assert [v[0] for v in spark.createDataFrame([("{1, 2}",), (None,)], "c string").select(X.parse_literal_list("c")).collect()] == [["1", "2"], []]
    cells = spark.createDataFrame([(" [1,2] ",), ("x",), ("",), (None,)], "c string").select(F.to_json(X.cell_json(F.col("c"))).alias("v")).collect()
    assert [c["v"] for c in cells] == ["[1,2]", '"x"', None, None]


def test_normal_cdf_and_sign_test(spark):
    for z in (-9.0, -3.0, -1.2, 0.0, 0.3, 2.5, 7.0):
        assert one(spark, S.normal_cdf(F.lit(z)).alias("p"))["p"] == pytest.approx(0.5 * math.erfc(-z / 2**0.5), abs=1e-14)
    for s, t in ((0, 0), (1, 0), (5, 5), (3, 17), (700, 640), (1000, 1000), (1200, 1100)):
        d, k = s + t, min(s, t)
        exact = 1.0 if not d else min(1.0, 2 * sum(math.comb(d, i) for i in range(k + 1)) / 2**d) if d <= 2000 else 2 * 0.5 * math.erfc(-((k + 0.5 - d / 2) / math.sqrt(d / 4)) / 2**0.5)
        assert one(spark, S.sign_test_p(F.lit(s), F.lit(t)).alias("p"))["p"] == pytest.approx(exact, rel=1e-9)


def test_intervals(spark):
    low, high = S.paired_delta_interval(F.lit(10), F.lit(4), F.lit(1), 0.95)
    xs = [1] * 4 + [-1] + [0] * 5
    mean = sum(xs) / 10
    half = S.z_of(0.95) * math.sqrt(sum((x - mean) ** 2 for x in xs) / 9 / 10)
    r = one(spark, low.alias("a"), high.alias("b"), *[c.alias(n) for c, n in zip(S.paired_delta_interval(F.lit(1), F.lit(1), F.lit(0), 0.95), "cd", strict=True)], *[c.alias(n) for c, n in zip(S.wilson(F.lit(3), F.lit(10)), "ef", strict=True)])
    assert (r["a"], r["b"], r["c"], r["d"]) == (pytest.approx(mean - half), pytest.approx(mean + half), 1.0, 1.0)
    assert (r["e"], r["f"]) == (pytest.approx(0.10779, abs=1e-5), pytest.approx(0.60322, abs=1e-5))


def test_alpha_recovers_its_exponent(spark):
    p = [0.5, 0.3, 0.2]
    for alpha in (0.5, 1.0, 2.0, 7.0):
        q = [x**alpha for x in p]
        q = [x / sum(q) for x in q]
        logs = F.array(*[F.lit(math.log(x)) for x in p])
        assert one(spark, S.fitted_alpha(logs, F.array(*map(F.lit, q))).alias("a"))["a"] == pytest.approx(alpha, abs=1e-4)


def test_nearest_rank_and_kappa(spark):
    a = F.array(*map(F.lit, [3.0, 1.0, 2.0]))
    r = one(spark, S.nearest_rank(a, 0.25).alias("a"), S.nearest_rank(a, 0.75).alias("b"), S.kappa(F.lit(3), F.lit(4), F.lit(0.5)).alias("k"), S.kappa(F.lit(4), F.lit(4), F.lit(1.0)).alias("m"))
    assert tuple(r) == (1.0, 3.0, 0.5, 1.0)  # ranks 0.5 and 1.5 round to even
