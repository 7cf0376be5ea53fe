import json

import pytest

from tests.test_sources import put
from twinlens import __main__ as command_line
from twinlens.__main__ import COMMANDS, main

CONFIG = {
    "default_device": "cuda:2", "model_pairs": [{"comparison_id": "c", "family": "f", "priority": "primary", "teacher": {"model_id": "T"}, "student": {"model_id": "S"}}], "seed_sets": {"matched_4": [1, 2]},
    "benchmark_plan": {"t2isafety": {"analysis_layers": ["x"], "seed_keys": {}}},
}


def test_chain_of_files(spark, tmp_path, capsys):
    t = str(tmp_path)
    put(t, "config.json", CONFIG)
    put(t, "root/T2ISafety_eval/fairness.jsonl", '{"prompt": "a nurse"}\n{"prompt": "a pilot"}\n')
    put(t, "root/T2ISafety_eval/safety.jsonl", '{"prompt": "s", "category": "arms"}\n')

    def run(*args):
        capsys.readouterr()
        assert main([str(a) for a in args], spark) == 0
        text = capsys.readouterr().out
        return json.loads(text) if text else None

    conf = ("--config", f"{t}/config.json")
    assert run("build-prompt-bank", *conf, "--root", f"{t}/root", "--out", f"{t}/bank")[0]["records"] == 3
    assert {r["value"]: r["rows"] for r in run("build-generation-manifest", *conf, "--bank", f"{t}/bank", "--out", f"{t}/jobs")}["T"] == 6
    run("build-label-template", "--bank", f"{t}/bank", "--jobs", f"{t}/jobs", "--out", f"{t}/labels")
    assert [s["jobs"] for s in run("split-manifest", "--jobs", f"{t}/jobs", "--out", f"{t}/shards", "--size", 4, "--by-model")] == [4, 2, 4, 2]
    assert sum(r["rows"] for r in run("build-evaluator-plan", "--labels", f"{t}/labels", "--out", f"{t}/tasks")) == 12
    assert [b["rows"] for b in run("plan-evaluator-batches", "--labels", f"{t}/labels", "--size", 5)] == [5, 4, 3]
    uid = spark.read.option("header", True).csv(f"{t}/labels").first()["label_uid"]
    put(t, "u.jsonl", json.dumps({"label_uid": uid, "semantic_label": "x", "quality_score": 4}) + "\n")
    assert run("validate-label-updates", "--updates", f"{t}/u.jsonl")["summary"][0]["valid"]
    assert run("merge-label-updates", "--labels", f"{t}/labels", "--updates", f"{t}/u.jsonl", "--out", f"{t}/merged", "--strict") == [{"rows_updated": 1, "rows_written": 12}]
    gates = {g["gate"]: g["pass"] for g in run("audit-design-matrix", *conf, "--bank", f"{t}/bank", "--jobs", f"{t}/jobs", "--labels", f"{t}/merged")}
    failed = {g for g, ok in gates.items() if not ok}
    assert failed <= {"rq_pair_design", "rq3_dissociation_bridge", "safety_memorization_coverage"}, failed
    assert run("audit-rq-readiness", *conf, "--labels", f"{t}/merged")[0]["comparison_id"] == "c"
    assert run("analyze-labels", *conf, "--labels", f"{t}/merged", "--out", f"{t}/tables")["usable_label_rows"] == 1
    put(t, "index.json", {"shards": [{"shard_id": "s0", "jobs": 2, "jobs_by_model": {"T": 2}}, {"shard_id": "s1", "jobs": 1}]})
    put(t, "events.jsonl", '{"shard": "s0", "job_id": "j", "status": "success"}\n')
    assert [q["device"] for q in run("plan-generation-queue", "--index", f"{t}/index.json", "--events", f"{t}/events.jsonl", "--gpus", "0", "1")] == ["cuda:0", "cuda:1"]
    assert len(COMMANDS) >= 20


def test_results_are_whole_or_fail(spark, tmp_path, capsys, monkeypatch):
    t = str(tmp_path)
    put(t, "labels.csv", "label_uid,benchmark,condition_type\n" + "".join(f"u{k},b,c{k % 5}\n" for k in range(20)))
    put(t, "index.json", {"shards": [{"shard_id": f"s{k}", "jobs": 1} for k in range(5)]})
    put(t, "events.jsonl", '{"shard": "s0", "job_id": "j", "status": "x"}\n')
    monkeypatch.setattr(command_line, "MAX_PRINTED", 3)
    for args in (["plan-evaluator-batches", "--labels", f"{t}/labels.csv"], ["plan-generation-queue", "--index", f"{t}/index.json", "--events", f"{t}/events.jsonl", "--limit", "5"]):
        with pytest.raises(ValueError, match="more than 3 rows"):
            main(args, spark)
        capsys.readouterr()
        assert main([*args, "--out", f"{t}/out"], spark) == 0
        assert json.loads(capsys.readouterr().out)["rows"] == 5
        assert spark.read.option("header", True).csv(f"{t}/out").count() == 5
