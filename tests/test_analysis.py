import numpy as np
import pytest
from pyspark.sql import functions as F

from twinlens.operators import analysis as A
from twinlens.operators import models

SCHEMA = "ord bigint, model_id string, benchmark string, axis_id string, condition_type string, image_prompt_uid string, seed string, eval_uid string, complexity_level string, target_behavior string, candidate_behaviors string, semantic_label string, pass_score string, quality_score string, refusal string, unsafe string, memorization_score string"
PAIRS = "comparison_id string, family string, teacher_model_id string, student_model_id string"


def rows_of(spark, cells):
    """cells: (model, image, label, quality)."""
    return spark.createDataFrame([(k, m, "hueform", "a", "broad", i, "1", f"e{i}", "atomic", "", '["x", "y", "z"]', label, None, q, None, None, None) for k, (m, i, label, q) in enumerate(cells)], SCHEMA)


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([("c", "f", "T", "S")], PAIRS)


def test_quality_and_last_row_wins(spark, pairs):
    rows = rows_of(spark, [("T", 1, "x", "3"), ("T", 1, "y", "4"), ("S", 1, "x", "2.9"), ("S", 1, "refusal", "1"), ("T", 2, "x", "nan"), ("S", 2, "x", None), ("S", 3, "", "5")])
    labels = A.labelled(rows)
    assert labels.count() == 6
    assert sorted(r["ord"] for r in A.kept_rows(labels).collect()) == [0, 1, 3, 4]
    balance = A.quality_pair_balance(labels, pairs).collect()
    assert len(balance) == 1 and balance[0]["mean_abs_quality_delta"] == 3.0 and balance[0]["exceeds_config_delta"] == "true"


def test_distances_are_symmetric_and_zero_on_equal(spark, pairs):
    rows = rows_of(spark, [("T", k, "xxy"[k % 3], "5") for k in range(9)] + [("S", k, "xyz"[k % 3], "5") for k in range(9)])
    hist = A.histogram(A.labelled(rows))
    r = A.pairwise_shift(A.facing(hist, pairs)).first()
    swapped = spark.createDataFrame([("c", "f", "S", "T")], PAIRS)
    s = A.pairwise_shift(A.facing(hist, swapped)).first()
    for m in ("total_variation", "js_divergence", "hellinger"):
        assert r[m] == pytest.approx(s[m]) and r[m] > 0
    same = spark.createDataFrame([("c", "f", "T", "T")], PAIRS)
    z = A.pairwise_shift(A.facing(hist, same)).collect()
    assert not z or z[0]["total_variation"] == 0


def test_paired_outcomes_support_and_counts(spark, pairs):
    rows = rows_of(spark, [("T", k, "x", "5") for k in range(6)] + [("S", k, "xxyyyw"[k], "5") for k in range(6)])
    out = {r["outcome_label"]: r for r in A.paired_outcomes(A.labelled(rows), pairs).collect()}
    assert set(out) == {"x", "y", "z", "w"}  # z only as a candidate
    x = out["x"]
    assert (x["both_positive"], x["teacher_only"], x["student_only"], x["both_negative"]) == (2, 4, 0, 0)
    assert out["z"]["both_negative"] == 6 and out["z"]["exact_sign_p_value"] == 1.0
    assert all(r["p_value_bh_fdr"] >= r["exact_sign_p_value"] and r["p_value_bonferroni"] >= r["p_value_bh_fdr"] for r in out.values())


def test_benjamini_hochberg(spark):
    ps = [0.01, 0.04, 0.04, 0.03, float("nan"), 0.5, 0.002]
    df = spark.createDataFrame(list(enumerate(ps)), "k int, p double")
    got = {r["k"]: r["p_value_bh_fdr"] for r in A.multiple_testing(df, "p").collect()}
    clean = [1.0 if p != p else p for p in ps]
    order = sorted(range(len(ps)), key=lambda k: clean[k])
    want, low = {}, 1.0
    for rank in range(len(ps), 0, -1):
        low = min(low, clean[order[rank - 1]] * len(ps) / rank)
        want[order[rank - 1]] = low
    assert got == pytest.approx(want)


def test_regression_equals_numpy(spark, pairs):
    rng = np.random.default_rng(1)
    data = [("c", "f", "ab"[k % 2], "ax", "broad", ["atomic", "relational", "implicit"][k % 3], f"l{k}", float(t), float(s), float(s / t), 50, 40) for k, (t, s) in enumerate(zip(rng.uniform(0.05, 0.9, 30), rng.uniform(0, 0.9, 30), strict=True))]
    schema = "comparison_id string, family string, benchmark string, axis_id string, condition_type string, complexity_level string, behavior string, teacher_frequency double, student_frequency double, retention_ratio double, teacher_n bigint, student_n bigint"
    out = {r["term"]: r for r in models.survival_regression(spark.createDataFrame(data, schema)).collect()}
    rank = {"atomic": 0, "relational": 1, "implicit": 3}
    x = np.array([[1, d[7], rank[d[5]], d[2] == "b"] for d in data], float)
    y = np.log(np.maximum([d[8] for d in data], 1e-12) / np.array([d[7] for d in data]))
    w = np.maximum(1, 40 * x[:, 1])
    inv = np.linalg.inv(x.T @ (w[:, None] * x))
    beta = inv @ x.T @ (w * y)
    sse = (w * (y - x @ beta) ** 2).sum()
    for k, term in enumerate(("intercept", "teacher_frequency", "complexity_rank", "benchmark:b")):
        assert out[term]["coefficient"] == pytest.approx(beta[k], rel=1e-6)
        assert out[term]["std_error"] == pytest.approx((sse / 26 * inv[k, k]) ** 0.5, rel=1e-6)
    few = models.survival_regression(spark.createDataFrame(data[:2], schema)).collect()
    assert few[0]["status"] == "insufficient_variation"


def test_bootstrap_is_repeatable_and_brackets(spark, pairs):
    rows = rows_of(spark, [("T", k, "xxxy"[k % 4], "5") for k in range(80)] + [("S", k, "xy"[k % 2], "5") for k in range(80)])
    faced = A.facing(A.histogram(A.labelled(rows)), pairs)
    a, b = (models.bootstrap_shift(faced.repartition(n), 400).first() for n in (1, 5))
    assert a == b
    assert a["total_variation_ci_low"] < 0.25 < a["total_variation_ci_high"]
    assert models.bootstrap_shift(faced, 1).first()["hellinger_ci_high"] == 0


def test_empty_tables(spark, pairs):
    labels = A.labelled(rows_of(spark, [("T", 1, "x", "5")])).limit(0)
    assert A.paired_outcomes(labels, pairs).count() == A.residual_transport(labels, pairs).count() == A.preference_capability(labels, pairs).count() == 0
    assert A.sharpening_fits(A.facing(A.histogram(labels), pairs)).count() == 0


def test_complexity_tie_goes_to_the_first(spark):
    rows = rows_of(spark, [("T", k, "x", "5") for k in range(4)]).withColumn("complexity_level", F.expr("case when ord in (1, 2) then 'b' else 'z' end"))
    assert A.complexity_by_axis(A.labelled(rows)).first()["complexity_level"] == "z"
