"""Entry points that run whole chains: label rows to analysis tables, and updates to claim report."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from twinlens.config import Settings
from twinlens.operators import analysis as A
from twinlens.operators import audits, models, report, updates
from twinlens.session import materialize
from twinlens.sources.files import read_document, write_csv, write_document, write_text


def analyze(rows: DataFrame, pairs: DataFrame, s: Settings = Settings()) -> tuple[dict[str, DataFrame], dict[str, int]]:  # noqa: B008
    """All analysis tables and the row counts. The cleaned labels and the paired histograms are written once and shared."""
    labels = materialize(A.labelled(rows), "labels")
    kept = materialize(A.kept_rows(labels, s.minimum_quality, s.retain_refusals), "kept")
    hist = materialize(A.histogram(kept), "hist")
    faced = materialize(A.facing(hist, pairs), "faced")
    fits = materialize(A.sharpening_fits(faced, s.roles), "fits")
    features = materialize(A.survival_features(faced, A.complexity_by_axis(kept)), "features")
    key = [*A.PAIR, *A.AXIS]
    tables = {
        "quality_by_model_benchmark": A.quality_by_model(labels, s.minimum_quality, s.retain_refusals), "quality_pair_balance": A.quality_pair_balance(labels, pairs, s.quality_match_delta), "distribution_summary": A.distribution_summary(hist), "pairwise_shift": A.pairwise_shift(faced).join(models.bootstrap_shift(faced, s.iterations, s.confidence, s.seed), key),
        "paired_outcomes": A.paired_outcomes(kept, pairs, s.confidence), "sharpening_fits": fits, "sharpening_transfer": A.sharpening_transfer(faced, A.alpha_by_pair(fits), s.roles), "residual_transport": A.residual_transport(kept, pairs, s.confidence), "preference_capability": A.preference_capability(kept, pairs, s.broad_drop_min, s.explicit_loss_min, s.recovery_tolerance),
        "survival_features": features, "survival_summary": A.survival_summary(features), "survival_regression": models.survival_regression(features),
    }
    tables = {name: materialize(df, name) for name, df in tables.items()}
    return tables, {"input_label_rows": rows.count(), "usable_label_rows_before_quality": labels.count(), "usable_label_rows": kept.count()}


def write_analysis(tables: dict[str, DataFrame], folder: str) -> None:
    """The tables as CSV folders, and their schemas, with which read_analysis reads them."""
    for name, df in tables.items():
        write_csv(df, f"{folder}/{name}", df.columns)
    write_document(f"{folder}/schemas.json", {name: df.schema.jsonValue() for name, df in tables.items()})


def read_analysis(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    schemas = read_document(f"{folder}/schemas.json")
    return {name: spark.read.schema(T.StructType.fromJson(s)).options(header=True, quote='"', escape='"', mode="FAILFAST").csv(f"{folder}/{name}").fillna("") for name, s in schemas.items()}


def report_from(spark: SparkSession, folder: str, pairs: DataFrame, s: Settings = Settings()) -> dict[str, Any]:  # noqa: B008
    """The claim report made again from the results that post_label wrote."""
    summary = read_document(f"{folder}/post_label.json")
    return report.claim_report(read_analysis(spark, f"{folder}/tables"), summary["counts"], summary["gates"], pairs, s.roles)


def post_label(bank: DataFrame, jobs: DataFrame, rows: DataFrame, pairs: DataFrame, policy: DataFrame, benchmarks: Sequence[str], device: str, seeds: Sequence[int], update_rows: DataFrame | None = None, folder: str | None = None, strict: bool = True, s: Settings = Settings()) -> dict[str, Any]:  # noqa: B008
    """Validate and merge updates, audit design, power, label quality and readiness, analyze, report.

    Invalid updates stop the chain before anything is merged.
    """
    conflicts = overlap = 0
    if update_rows is not None:
        summary = updates.validation_summary(update_rows).first().asDict()
        if strict and not summary["valid"]:
            return {"status": "invalid_updates", "validation": summary}
        rows = materialize(updates.merge(rows, update_rows).drop("updated"), "merged")
        agreement = updates.reliability_summary(update_rows).first()
        overlap = agreement["overlap_label_uids"]
        conflicts = sum(r["conflicts"] for r in updates.reliability_by_field(update_rows).collect())
    ok = lambda gates: all(r["pass"] for r in gates)
    design = audits.design_gates(bank, jobs, rows, pairs, policy, benchmarks, device, seeds, s.required_rqs, s.require_bridge, roles=s.roles).collect()
    cells = audits.power_cells(materialize(audits.planned_cells(rows, pairs, s.roles), "planned"))
    power = audits.power_gates(cells, ok(design)).collect()
    groups = materialize(audits.label_quality_by_group(rows), "quality")
    quality = audits.label_quality_gates(groups, overlap, conflicts, audits.missing_header(rows)).collect()
    per_pair = materialize(audits.readiness(rows, pairs, s.minimum_quality, roles=s.roles), "ready")
    ready = audits.readiness_summary(per_pair).collect()
    state = audits.experiment_gates(bank, jobs, rows, device).collect()
    tables, counts = analyze(rows, pairs, s)
    gates = {"design_matrix": ok(design), "statistical_power": ok(power), "label_quality": ok(quality), "label_readiness": all(r["ready"] for r in ready), "experiment_state": ok(state)}
    out = report.claim_report(tables, counts, gates, pairs, s.roles)
    if folder:
        write_analysis(tables, f"{folder}/tables")
        write_document(f"{folder}/claim_report.json", out)
        write_text(f"{folder}/claim_report.md", report.report_markdown(out))
        write_document(f"{folder}/post_label.json", {"counts": counts, "gates": gates})
        write_csv(cells, f"{folder}/power_cells", cells.columns)
        write_csv(groups, f"{folder}/label_quality", groups.columns)
        write_csv(per_pair, f"{folder}/readiness", per_pair.columns)
        for title, rows_of in (("Design audit", design), ("Power audit", power), ("Label quality audit", quality), ("Experiment audit", state)):
            write_text(f"{folder}/{title.lower().replace(' ', '_')}.md", report.gates_markdown(title, [r.asDict() for r in rows_of]))
        write_text(f"{folder}/readiness.md", "# Readiness\n\n" + report.table_markdown([r.asDict() for r in ready]) + "\n")
    return out
