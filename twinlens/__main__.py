"""Command line: python -m twinlens COMMAND --help. Inputs are the study's files (JSONL, CSV) or Parquet tables with ``ord``."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlens import config as C
from twinlens import pipeline
from twinlens.operators import audits, evaluator_audit, planning, report, updates
from twinlens.session import local_session, materialize, ship
from twinlens.sources import benchmarks, files

#: Rows of a result that is printed.
MAX_PRINTED = 10_000
COMMANDS: dict[str, tuple[Callable[..., Any], tuple[str, ...]]] = {}


def command(*options: str):
    def add(f: Callable[..., Any]) -> Callable[..., Any]:
        COMMANDS[f.__name__.replace("_", "-")] = (f, options)
        return f

    return add


def _rows(df: DataFrame) -> list[dict[str, Any]]:
    """A small result, printed: reports and summaries; too many rows are an error."""
    rows = df.limit(MAX_PRINTED + 1).collect()
    if len(rows) > MAX_PRINTED:
        raise ValueError(f"more than {MAX_PRINTED} rows to print")
    return [r.asDict(recursive=True) for r in rows]


def _listed(df: DataFrame, path: str | None, order: str) -> Any:
    """A result of any size: a CSV file at the path, of which the number of rows is printed; without a path it is printed itself."""
    if not path:
        return _rows(df.orderBy(order))
    df = materialize(df, "listed")
    files.write_csv(df.orderBy(order), path, df.columns)
    return {"rows": df.count(), "out": path}


def _pairs(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return C.selected_pairs(C.pairs_table(spark, C.load_config(a.config)), a.scope)


def _models(spark: SparkSession, conf: dict[str, Any], scope: str) -> DataFrame:
    """The models of the chosen pairs, in the order in which they first occur."""
    seen: dict[str, int] = {}
    for p in conf["model_pairs"]:
        if scope in ("all", p.get("priority", "primary")):
            for role in ("teacher", "student"):
                seen.setdefault(p[role]["model_id"], len(seen))
    return spark.createDataFrame([(k, m, conf.get("default_device", "")) for m, k in seen.items()], "model_no int, model_id string, device string")


def _default_seeds(conf: dict[str, Any]) -> list[int]:
    return C.seed_values(conf, C.DEFAULT_SEEDS)


@command("config", "root", "out", "benchmarks", "gated")
def build_prompt_bank(spark, a):
    bank = materialize(benchmarks.prompt_records(spark, C.load_config(a.config), a.root, a.benchmarks, a.gated), "bank")
    files.write_jsonl(bank.drop("ord"), a.out)
    return _rows(audits.prompt_bank_audit(bank))


@command("config", "bank", "out", "gated", "benchmarks", "limit", "order")
def build_generation_manifest(spark, a):
    conf = C.load_config(a.config)
    prompts = planning.generation_prompts(files.read_bank(spark, a.bank), a.gated, a.benchmarks, a.limit or None)
    jobs = planning.generation_jobs(prompts, _models(spark, conf, a.scope), C.seed_policy(spark, conf), _default_seeds(conf), a.order, conf.get("image_output_root", "outputs/images"), conf.get("image_format", "png"))
    jobs = materialize(jobs, "jobs")
    files.write_jsonl(jobs.orderBy("ord1", "ord2", "ord3").drop("ord1", "ord2", "ord3"), a.out)
    return _rows(planning.summarize_jobs(jobs))


@command("bank", "jobs", "out", "gated")
def build_label_template(spark, a):
    rows = planning.label_template(files.read_bank(spark, a.bank), files.read_jobs(spark, a.jobs), a.gated)
    files.write_csv(rows.orderBy("job_ord", "record_ord"), a.out, rows.drop("job_ord", "record_ord").columns)


@command("jobs", "out", "size", "by_model", "index_out")
def split_manifest(spark, a):
    sharded = materialize(planning.assign_shards(files.read_jobs(spark, a.jobs), a.size, a.by_model), "shards")
    planning.write_shards(sharded, a.out)
    return _listed(planning.shard_index(sharded), a.index_out, "shard")


@command("labels", "out")
def build_evaluator_plan(spark, a):
    rows = files.read_label_rows(spark, a.labels)
    files.write_csv(planning.task_rows(rows), a.out, planning.task_rows(rows).columns)
    return _rows(planning.evaluator_plan(rows))


@command("labels", "size", "out")
def plan_evaluator_batches(spark, a):
    return _listed(planning.evaluator_batches(files.read_label_rows(spark, a.labels), a.size), a.out, "batch_no")


@command("labels", "out", "limit", "start", "benchmarks")
def export_evaluator_batch(spark, a):
    files.write_jsonl(planning.export_batch(files.read_label_rows(spark, a.labels), a.limit or 100, a.start, benchmarks=a.benchmarks or ()), a.out)


@command("bank", "jobs", "out", "seeds", "limit")
def build_preflight_package(spark, a):
    picked = planning.preflight_prompts(files.read_bank(spark, a.bank), a.limit or 2)
    files.write_jsonl(planning.preflight_jobs(files.read_jobs(spark, a.jobs), picked, a.seeds), a.out)


@command("updates")
def validate_label_updates(spark, a):
    given = files.read_updates(spark, a.updates)
    return {"summary": _rows(updates.validation_summary(given)), "errors": _rows(updates.validate(given).orderBy("ord").limit(100))}


@command("labels", "updates", "out", "strict")
def merge_label_updates(spark, a):
    rows = files.read_label_rows(spark, a.labels)
    merged = materialize(updates.merge(rows, files.read_updates(spark, a.updates), a.strict), "merged")
    files.write_csv(merged.orderBy("ord"), a.out, [c for c in rows.columns if c != "ord"])
    return _rows(merged.agg(F.count("*").alias("rows_written"), F.count_if("updated").alias("rows_updated")))


@command("config", "labels", "out")
def analyze_labels(spark, a):
    tables, counts = pipeline.analyze(files.read_label_rows(spark, a.labels), _pairs(spark, a), C.settings(C.load_config(a.config)))
    pipeline.write_analysis(tables, a.out)
    return report.evidence(tables, counts)


@command("config", "bank", "jobs", "labels", "index")
def audit_design_matrix(spark, a):
    conf = C.load_config(a.config)
    s = C.settings(conf)
    sources = report.gate_of("benchmark_sources_available", all(audits.source_gate(C.source_paths(conf, C.expected_benchmarks(conf))).values()))
    gates = audits.design_gates(files.read_bank(spark, a.bank), files.read_jobs(spark, a.jobs), files.read_label_rows(spark, a.labels), _pairs(spark, a), C.seed_policy(spark, conf), C.expected_benchmarks(conf), conf.get("default_device", ""), _default_seeds(conf), s.required_rqs, s.require_bridge, files.shard_table(spark, files.read_document(a.index)) if a.index else None, s.roles)
    return [sources, *_rows(gates)]


@command("config", "bank", "jobs", "labels")
def audit_experiment_state(spark, a):
    return _rows(audits.experiment_gates(files.read_bank(spark, a.bank), files.read_jobs(spark, a.jobs), files.read_label_rows(spark, a.labels) if a.labels else None, C.load_config(a.config).get("default_device", "")))


@command("labels", "updates")
def audit_label_quality(spark, a):
    rows = files.read_label_rows(spark, a.labels)
    overlap, conflicts = 0, 0
    if a.updates:
        given = files.read_updates(spark, a.updates)
        overlap = updates.reliability_summary(given).first()["overlap_label_uids"]
        conflicts = sum(r["conflicts"] for r in updates.reliability_by_field(given).collect())
    groups = materialize(audits.label_quality_by_group(rows), "quality")
    return {"gates": _rows(audits.label_quality_gates(groups, overlap, conflicts, audits.missing_header(rows))), "groups": _rows(groups)}


@command("config", "labels")
def audit_rq_readiness(spark, a):
    s = C.settings(C.load_config(a.config))
    return _rows(audits.readiness(files.read_label_rows(spark, a.labels), _pairs(spark, a), s.minimum_quality, not a.partial, s.roles))


@command("config", "labels")
def audit_statistical_power(spark, a):
    cells = audits.power_cells(materialize(audits.planned_cells(files.read_label_rows(spark, a.labels), _pairs(spark, a), C.settings(C.load_config(a.config)).roles), "planned"))
    return {"cells": _rows(cells), "summary": _rows(audits.power_summary(cells))}


@command("labels")
def audit_evaluator_plan(spark, a):
    rows = files.read_label_rows(spark, a.labels)
    return _rows(evaluator_audit.gates(rows, planning.task_rows(rows)))


@command("config", "bank", "jobs", "labels", "updates", "out")
def run_post_label_pipeline(spark, a):
    conf = C.load_config(a.config)
    given = files.read_updates(spark, a.updates) if a.updates else None
    return pipeline.post_label(files.read_bank(spark, a.bank), files.read_jobs(spark, a.jobs), files.read_label_rows(spark, a.labels), _pairs(spark, a), C.seed_policy(spark, conf), C.expected_benchmarks(conf), conf.get("default_device", ""), _default_seeds(conf), given, a.out, s=C.settings(conf))


@command("config", "results", "out")
def build_claim_report(spark, a):
    """The report from the folder that run-post-label-pipeline wrote."""
    out = pipeline.report_from(spark, a.results, _pairs(spark, a), C.settings(C.load_config(a.config)))
    files.write_document(f"{a.out}/claim_report.json", out)
    files.write_text(f"{a.out}/claim_report.md", report.report_markdown(out))
    return {"status": out["status"], "out": a.out}


@command("config", "bank", "out")
def summarize_prompt_bank(spark, a):
    conf, bank = C.load_config(a.config), files.read_bank(spark, a.bank)
    return {"benchmarks": _rows(planning.benchmark_summary(bank, C.seed_policy(spark, conf), _models(spark, conf, a.scope).count())), "axes": _listed(planning.axis_summary(bank), a.out, "axis_id")}


@command("index", "events")
def summarize_generation_progress(spark, a):
    """events: JSONL of shard, job_id and status."""
    shards = files.shard_table(spark, files.read_document(a.index))
    return _rows(planning.shard_progress(shards, files.read_jsonl(spark, a.events, "shard string, job_id string, status string")))


@command("index", "events", "gpus", "limit", "out")
def plan_generation_queue(spark, a):
    shards = files.shard_table(spark, files.read_document(a.index))
    progress = planning.shard_progress(shards, files.read_jsonl(spark, a.events, "shard string, job_id string, status string"))
    return _listed(planning.queue_shards(progress, gpus=a.gpus, most=a.limit), a.out, "queue_no")


_OPTIONS: dict[str, dict[str, Any]] = {
    "benchmarks": {"nargs": "*"}, "updates": {"nargs": "*"}, "seeds": {"nargs": "+", "type": int, "default": [0]}, "gpus": {"nargs": "+", "default": ["0"]}, "limit": {"type": int, "default": 0}, "start": {"type": int, "default": 0}, "size": {"type": int, "default": 5000},
    "gated": {"action": "store_true"}, "strict": {"action": "store_true"}, "by_model": {"action": "store_true"}, "order": {"choices": ("model_major", "prompt_major"), "default": "model_major"},
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="twinlens")
    subs = top.add_subparsers(dest="command", required=True)
    for name, (f, options) in COMMANDS.items():
        sub = subs.add_parser(name, help=(f.__doc__ or "").strip())
        for o in options:
            sub.add_argument(f"--{o.replace('_', '-')}", dest=o, **_OPTIONS.get(o, {}))
        sub.add_argument("--scope", default="primary")
        sub.add_argument("--partial", action="store_true")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.getActiveSession() or local_session()
    ship(spark)
    out = COMMANDS[a.command][0](spark, a)
    if out is not None:
        json.dump(out, sys.stdout, ensure_ascii=False, indent=2, sort_keys=True, default=str)
        print()
    return 0


if __name__ == "__main__":
    sys.exit(main())
