import pytest
from pyspark.sql import functions as F

from twinlens import pipeline, queries_study
from twinlens.config import Settings
from twinlens.operators import audits, planning, report
from twinlens.session import table

JOBS = "ord bigint, job_id string, model_id string, benchmark string, device string, image_prompt_uid string, seed int"


def jobs_of(spark, models):
    return spark.createDataFrame([(k, f"j{k}", m, "b", "cuda:2", "i", 1) for k, m in enumerate(models)], JOBS)


def brute(models, n, respect):
    out, size, last = [], 0, None
    shard = 0
    for k, m in enumerate(models):
        if k and (size == n or (respect and m != last)):
            shard, size = shard + 1, 0
        out.append(shard)
        size, last = size + 1, m
    return out


@pytest.mark.parametrize("respect", [False, True])
def test_shards(spark, respect):
    models = list("aaaaabbbaacccccccb") + ["d"] * 11
    got = planning.assign_shards(jobs_of(spark, models), 3, respect).orderBy("ord").collect()
    assert [r["shard"] for r in got] == brute(models, 3, respect)
    assert planning.assign_shards(jobs_of(spark, models).limit(0), 3, respect).count() == 0
    with pytest.raises(ValueError):
        planning.assign_shards(jobs_of(spark, models), 0)


def test_progress_and_queue(spark):
    shards = spark.createDataFrame([(k, 2) for k in range(4)], "shard bigint, jobs bigint")
    events = spark.createDataFrame([(0, "a", "success"), (0, "b", "success"), (1, "c", "failure"), (1, "c", "success"), (2, "d", "failure")], "shard bigint, job_id string, status string")
    p = {r["shard"]: (r["succeeded"], r["failed"], r["status"]) for r in planning.shard_progress(shards, events).collect()}
    assert p == {0: (2, 0, "done_by_logs"), 1: (1, 0, "partial"), 2: (0, 1, "partial"), 3: (0, 0, "pending")}
    q = planning.queue_shards(planning.shard_progress(shards, events), gpus=("cuda:2", "3")).orderBy("queue_no").collect()
    assert [(r["shard"], r["device"]) for r in q] == [(1, "cuda:2"), (2, "cuda:3"), (3, "cuda:2")]
    with pytest.raises(ValueError):
        planning.queue_shards(planning.shard_progress(shards, events), gpus=())


def test_tasks_hide_safety_prompts(spark, sf_dir):
    rows = planning.task_rows(table(spark, sf_dir, "label_rows"), mode="always")
    assert rows.filter("evaluator_kind in ('safety_image_audit', 'safety_overrefusal_audit') and prompt_text <> '<redacted>'").count() == 0
    assert planning.task_rows(table(spark, sf_dir, "label_rows"), mode="never").filter("prompt_text <> '<redacted>'").count() == 0
    text = planning.task_rows(table(spark, sf_dir, "label_rows")).select(planning.instruction({"explicit_attribute_pass_fail": ("g", "r")}).alias("t")).filter("t like '%Goal: g%'").first()["t"]
    assert "Target behavior" in text and "Required output columns: pass_score, quality_score." in text


def test_power(spark):
    planned = spark.createDataFrame([("rq2_residual_transport", "c", "f", "b", n) for n in (50, 400, 20_000)] + [("unlearning_optional", "c", "f", "b", 9)], "rq string, comparison_id string, family string, benchmark string, planned_matched_cells bigint")
    cells = audits.power_cells(planned)
    assert [r["design_resolution"] for r in cells.orderBy("planned_matched_cells").collect()] == ["underpowered", "coarse", "fine"]
    one = audits.power_summary(cells).first()
    assert (one["benchmark_tests"], one["underpowered_cells"], one["median_planned_matched_cells"]) == (3, 1, 400.0)
    assert {r["gate"]: r["pass"] for r in audits.power_gates(cells, True).collect()} == {"design_audit_passed": True, "minimum_matched_cells": False, "inferential_cells_present": True}
    with pytest.raises(ValueError):
        audits.power_cells(planned, alpha=2)


def test_whole_chain(spark, sf_dir, tmp_path):
    from twinlens.queries_study import DEVICE, SEEDS, _pairs, policy

    t = lambda n: table(spark, sf_dir, n)
    out = pipeline.post_label(t("prompt_bank"), t("generation_jobs"), t("label_rows"), _pairs(spark, sf_dir), policy(spark), ["hueform"], DEVICE, SEEDS, t("label_updates"), str(tmp_path), strict=False, s=Settings(iterations=50))
    assert out["status"] == "design_or_power_failed" and set(out["claims"]) == {"rq1", "rq2", "rq3", "rq4"}
    assert (tmp_path / "claim_report.md").read_text().startswith("# Claim report")
    assert (tmp_path / "tables" / "residual_transport").is_dir()
    # The report is the same when it is made again from the results.
    again = pipeline.report_from(spark, str(tmp_path), _pairs(spark, sf_dir), Settings(iterations=50))
    assert (again["status"], again["gates"], again["action_items"]) == (out["status"], out["gates"], out["action_items"])
    assert {k: c["status"] for k, c in again["claims"].items()} == {k: c["status"] for k, c in out["claims"].items()}
    assert again["safety"]["status"] == out["safety"]["status"]
    assert (tmp_path / "power_audit.md").is_file() and (tmp_path / "readiness").is_dir()
    stopped = pipeline.post_label(t("prompt_bank"), t("generation_jobs"), t("label_rows"), _pairs(spark, sf_dir), policy(spark), ["hueform"], DEVICE, SEEDS, t("label_updates"))
    assert stopped["status"] == "invalid_updates"


def test_two_configurations_give_two_results(spark):
    sf_dir = "/root/testdata/sf0.01"  # the smaller tables have too few cells for every part
    from twinlens.config import settings
    from twinlens.queries_study import _pairs

    base = {"quality_controls": {"minimum_quality_score": 2.0, "quality_match_delta": 0.01, "retain_refusal_rows": True}, "bootstrap": {"iterations": 10, "seed": 1}, "fit_sharpening_on": ["hueform"], "transfer_alpha_to": ["knotwork"], "dissociation_thresholds": {"broad_drop_min": 0.0, "explicit_loss_min": 0.0, "explicit_recovery_tolerance": -2}}
    other = base | {"quality_controls": {"minimum_quality_score": 4.0}, "fit_sharpening_on": ["stagecraft"], "transfer_alpha_to": ["lorecheck"], "dissociation_thresholds": {"broad_drop_min": 2.0}, "required_primary_rqs": ["rq2_residual_transport"], "require_rq3_dissociation_bridge": False}
    got = []
    for a in (base, other):
        s = settings({"analysis": a})
        tables, counts = pipeline.analyze(table(spark, sf_dir, "label_rows"), _pairs(spark, sf_dir), s)
        names = lambda t, c: {r[0] for r in t.select(c).distinct().collect()}
        got.append((counts["usable_label_rows"], names(tables["sharpening_fits"], "benchmark"), names(tables["sharpening_transfer"], "benchmark"), names(tables["preference_capability"], "classification"), names(tables["quality_pair_balance"], "exceeds_config_delta"), s.required_rqs, s.require_bridge))
    one, two = got
    assert one[0] > two[0] > 0
    assert (one[1], one[2]) == ({"hueform"}, {"knotwork"}) and two[1] <= {"stagecraft"} and two[2] <= {"lorecheck"}
    assert "capability_or_information_loss" in one[3] and two[3] == {"stable_or_ambiguous"}
    assert "true" in one[4]
    assert (two[5], two[6]) == (("rq2_residual_transport",), False)


def test_statuses():
    gates = dict.fromkeys(report.ACTIONS, True)
    assert report.overall_status(gates, ["x_detected"]) == "interpretable_results_available"
    assert report.overall_status(gates, ["pending"]) == "analysis_complete_no_strong_claims"
    assert report.overall_status(gates | {"label_quality": False}, []) == "label_quality_review_needed"
    assert report.overall_status(gates | {"label_readiness": False, "label_quality": False}, []) == "pending_labels"
    assert len(report.action_items(gates | {"label_readiness": False, "label_quality": False})) == 1
    assert report.sharpening_claim({"sharpening_fits": {"rows": 1, "median_alpha": 2.0}, "sharpening_transfer": {"rows": 1, "median_tv": 0.01}})["status"] == "simple_sharpening_consistent"
    assert "| a |" in report.table_markdown([{"a": 1.5}])


def test_update_stream(spark, sf_dir, tmp_path):
    from twinlens.operators.updates import FIELDS
    from twinlens.streaming.updates import event_rates, read_update_stream, store_updates

    table(spark, sf_dir, "label_updates").select("ord", "label_uid", *FIELDS, "submitted_at").repartition(3).write.json(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        store_updates(read_update_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == table(spark, sf_dir, "label_updates").select("label_uid").distinct().count()
    assert event_rates(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))).count() > 0


def test_task_index_holds_all_loads_before_the_last(spark, sf_dir):
    rows = table(spark, sf_dir, "label_rows").filter("trim(label_uid) <> ''")
    last = rows.agg(F.max("load_id")).first()[0]
    late = rows.groupBy("label_uid").agg(F.min("load_id").alias("first")).filter(F.col("first") == last).count()
    assert late > 0
    assert {r["error"]: r["rows"] for r in queries_study.evaluator_task_errors(spark, sf_dir).collect()}["label_uid absent from task index"] == late
