import itertools

import pytest
from pyspark.sql import functions as F

from twinlens.operators import updates as U

SCHEMA = "ord bigint, label_uid string, semantic_label string, semantic_label_confidence string, pass_score string, quality_score string, refusal string, unsafe string, memorization_score string, evaluator string, notes string"


def table(spark, rows):
    return spark.createDataFrame([(k, r.get("uid"), *[r.get(f) for f in U.FIELDS]) for k, r in enumerate(rows)], SCHEMA)


def test_validate(spark):
    a, b = {"uid": "u", "pass_score": "1"}, {"uid": "u", "pass_score": "0"}
    df = table(spark, [a, b, b, a, {"pass_score": "9"}, {"uid": "v", "quality_score": "6", "refusal": "perhaps", "pass_score": "x"}])
    got = sorted((r["ord"], r["field"], r["error"]) for r in U.validate(df).collect())
    assert got == [(1, "", "conflicting duplicate update"), (3, "", "conflicting duplicate update"), (4, "label_uid", "missing label_uid"), (5, "pass_score", "not numeric"), (5, "quality_score", "out of range"), (5, "refusal", "not boolean-like")]
    kinds = table(spark, [{"uid": "w"}]).withColumns({"evaluator_kind": F.lit("safety_overrefusal_audit"), "required_columns": F.lit('["notes"]')})
    assert [r["field"] for r in U.validate(kinds).collect()] == ["notes"]
    assert sorted(r["field"] for r in U.validate(kinds.drop("required_columns")).collect()) == ["quality_score", "refusal", "unsafe"]
    assert U.validation_summary(df.limit(0)).first()["valid"]


def test_merge(spark):
    df = table(spark, [{"uid": "u", "pass_score": " ", "notes": "a; b", "evaluator": "x"}, {"uid": "u", "pass_score": "1", "notes": "b;c"}, {"uid": "u", "pass_score": "0"}, {"uid": "v", "notes": "k;k"}, {"uid": "gone", "notes": "n"}])
    c = {r["label_uid"]: r for r in U.combine(df).collect()}
    assert (c["u"]["pass_score"], c["u"]["notes"], c["u"]["evaluator"], c["u"]["conflicts"]) == ("1", "a; b; c", "x", ["pass_score"])
    assert c["v"]["notes"] == "k;k"
    labels = table(spark, [{"uid": "u", "pass_score": "0.3", "unsafe": "no"}, {"uid": "v"}, {"uid": None}])
    m = {r["label_uid"]: r for r in U.merge(labels, df).collect()}
    assert (m["u"]["pass_score"], m["u"]["unsafe"], m["u"]["updated"], m[None]["updated"]) == ("1", "no", True, False)
    assert [r[0] for r in U.unmatched_updates(labels, df).collect()] == ["gone"]
    with pytest.raises(ValueError):
        U.merge(labels, df, strict=True)


def test_reliability_equals_all_pairs(spark):
    rows = [{"uid": f"u{k % 4}", "semantic_label": [None, "Red", "red ", "blue"][k * 7 % 4], "quality_score": [None, "1", "2.5", "4", "x"][k * 3 % 5], "refusal": [None, "yes", "y", "no"][k % 3], "evaluator": "ab"[k % 2]} for k in range(23)]
    out = {r["field"]: r for r in U.reliability_by_field(table(spark, rows)).collect()}
    pairs = [(a, b) for a, b in itertools.combinations(rows, 2) if a["uid"] == b["uid"]]
    q = [abs(float(a["quality_score"]) - float(b["quality_score"])) for a, b in pairs if a["quality_score"] not in (None, "x") and b["quality_score"] not in (None, "x")]
    assert (out["quality_score"]["pairs"], out["quality_score"]["conflicts"]) == (len(q), sum(d > 1 for d in q))
    assert out["quality_score"]["mean_abs_diff"] == pytest.approx(sum(q) / len(q)) and out["quality_score"]["max_abs_diff"] == max(q)
    e = [a["evaluator"] != b["evaluator"] for a, b in pairs]
    assert (out["evaluator"]["pairs"], out["evaluator"]["conflicts"]) == (len(e), sum(e))
    assert U.reliability_summary(table(spark, rows[:1])).first()["behavior_pairwise_comparisons"] == 0
