"""Audits of prompt records, jobs and labels: counts first, then one row of gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens.functions import labels as L
from twinlens.functions import stats as S
from twinlens.functions.text import normalize_label, stable_hash, text
from twinlens.operators.analysis import CELL, PAIR
from twinlens.config import pair_models, pair_sides
from twinlens.plans.prefix import with_previous
from twinlens.plans.skew import MAX_SMALL, small

# Markers of a retired prompt family; fields a job and a label row must have.
RETIRED_MARKERS = ("h1_prompt", "h2_prompt", "h1/h2", "diversity_h1", "diversity_h2")
JOB_FIELDS = ("job_id", "model_id", "benchmark", "condition_type", "image_prompt_uid", "eval_uids", "seed", "prompt_text", "output_path", "device", "num_inference_steps")
LABEL_FIELDS = (
    "label_uid", "job_id", "eval_uid", "model_id", "benchmark", "axis_id", "condition_type", "image_prompt_uid", "seed", "image_path", "target_behavior", "candidate_behaviors",
    "semantic_label", "pass_score", "quality_score", "refusal", "unsafe", "memorization_score", "evaluator",
)


def _key(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def missing_header(df: DataFrame, fields: Sequence[str] = LABEL_FIELDS) -> list[str]:
    return [f for f in fields if f not in df.columns]


def histograms(df: DataFrame, *columns: str) -> DataFrame:
    """(field, value, rows) for several columns in one pass over the data."""
    cells = F.array(*[F.struct(F.lit(c).alias("field"), _key(c).alias("value")) for c in columns])
    return df.select(F.explode(cells).alias("c")).groupBy("c.field", "c.value").agg(F.count("*").alias("rows"))


def prompt_bank_audit(bank: DataFrame) -> DataFrame:
    """One row of totals."""
    marker = F.lower(F.concat(_key("source"), F.lit(" "), _key("source_path")))
    retired = F.lit(False)
    for m in RETIRED_MARKERS:
        retired = retired | marker.contains(m)
    return bank.agg(
        F.count("*").alias("records"), F.countDistinct(_key("image_prompt_uid")).alias("unique_image_prompts"), F.countDistinct(_key("axis_id")).alias("axis_count"), F.countDistinct(_key("eval_uid")).alias("eval_uids"),
        (F.count("*") - F.countDistinct(_key("eval_uid"))).alias("duplicate_eval_uids"), F.count_if(F.coalesce("requires_valid_lineage", F.lit(False))).alias("requires_valid_lineage_records"), F.count_if(retired).alias("retired_prompt_records"),
    )


def conditions_by_benchmark(bank: DataFrame) -> DataFrame:
    return bank.select(_key("benchmark").alias("benchmark"), _key("condition_type").alias("condition_type")).distinct().groupBy("benchmark").agg(F.sort_array(F.collect_set("condition_type")).alias("conditions"))


def manifest_audit(jobs: DataFrame, expected_device: str) -> DataFrame:
    """One row of totals; model switches are counted between neighbours in file order."""
    device, model = _key("device"), _key("model_id")
    blanks = [F.count_if(F.size("eval_uids") <= 0 if f == "eval_uids" else F.col(f).isNull() if f in ("seed", "num_inference_steps") else text(F.col(f)) == "").alias(f"missing_{f}") for f in JOB_FIELDS]
    totals = jobs.agg(
        F.count("*").alias("jobs"), (F.count("*") - F.countDistinct(_key("job_id"))).alias("duplicate_job_ids"), (F.count("*") - F.countDistinct(_key("output_path"))).alias("duplicate_output_paths"),
        F.count_if(device != expected_device).alias("unexpected_device_jobs"), F.coalesce(F.sum(F.greatest(F.size("eval_uids"), F.lit(0))), F.lit(0)).cast("bigint").alias("expected_label_rows"), *blanks,
    )
    steps = with_previous(jobs.select("ord", model.alias("model_id")), ["ord"], ["model_id"], "switches")
    return totals.crossJoin(F.broadcast(steps.agg(F.count_if(F.col("model_id") != F.col("previous_model_id")).alias("model_switches"))))


def label_signal_gaps(rows: DataFrame) -> DataFrame:
    """(condition_type, column_name, required, missing): required signals and how many are blank."""
    need = rows.select("*", F.explode(L.required_signals()).alias("column_name"))
    blank = F.lit(False)
    for s in L.SIGNALS:
        blank = blank | ((F.col("column_name") == s) & (text(F.col(s)) == ""))
    return need.groupBy(_key("condition_type").alias("condition_type"), "column_name").agg(F.count("*").alias("required"), F.count_if(blank).alias("missing"))


def label_audit(rows: DataFrame) -> DataFrame:
    label = L.behavior_label()
    return rows.agg(
        F.count("*").alias("rows"), F.count_if(label != "").alias("filled_rows"), F.coalesce(F.try_divide(F.count_if(label != ""), F.count("*")), F.lit(0.0)).alias("filled_fraction"), (F.count("*") - F.countDistinct(_key("label_uid"))).alias("duplicate_label_uids")
    )


def pair_coverage(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per pair the labelled cells with both models, one, or neither.

    Cells meet only the pairs of their own models; neither is the number of all cells less those met.
    """
    by_cell = labels.select("model_id", *CELL).distinct()
    total = by_cell.select(*CELL).distinct().agg(F.count("*").alias("cells"))
    met = by_cell.join(small(pair_models(pairs)), "model_id")
    cell = met.groupBy("comparison_id", *CELL).agg(F.bool_or(F.col("role") == "teacher").alias("t"), F.bool_or(F.col("role") == "student").alias("s"))
    counts = cell.groupBy("comparison_id").agg(F.count_if(F.expr("t and s")).alias("matched_labeled_cells"), F.count_if(F.expr("t and not s")).alias("teacher_only_labeled_cells"), F.count_if(F.expr("s and not t")).alias("student_only_labeled_cells"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    out = pairs.select("comparison_id").join(counts, "comparison_id", "left").crossJoin(F.broadcast(total))
    names = ("matched_labeled_cells", "teacher_only_labeled_cells", "student_only_labeled_cells")
    return out.select("comparison_id", *[zero(c).alias(c) for c in names], (F.col("cells") - sum((zero(c) for c in names[1:]), zero(names[0]))).alias("neither_labeled_cells"))


QUALITY_COUNTS = ("rows", "filled_rows", "missing_required_values", "numeric_range_errors", "bool_errors", "missing_quality_rows", "low_quality_rows", "low_confidence_rows", "out_of_vocab_semantic_labels")


def label_quality_by_group(rows: DataFrame, min_quality: float = 3.0, min_confidence: float = 0.60) -> DataFrame:
    """Error counters per benchmark and condition."""
    semantic, norm = text(F.col("semantic_label")), normalize_label(F.col("semantic_label"))
    quality, confidence = L.float_no_nan(F.col("quality_score")), L.float_no_nan(F.col("semantic_label_confidence"))
    total = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0)).cast("bigint")
    return rows.groupBy(_key("benchmark").alias("benchmark"), _key("condition_type").alias("condition_type")).agg(
        F.count("*").alias("rows"), F.count_if(L.behavior_label() != "").alias("filled_rows"), total(L.missing_signals(L.required_signals())).alias("missing_required_values"), total(L.range_errors()).alias("numeric_range_errors"), total(L.bool_errors()).alias("bool_errors"),
        F.count_if(text(F.col("quality_score")) == "").alias("missing_quality_rows"), F.count_if(quality < min_quality).alias("low_quality_rows"), F.count_if((semantic != "") & (confidence < min_confidence) & ~L.is_abstention(norm)).alias("low_confidence_rows"),
        F.count_if(L.out_of_vocabulary(norm, L.candidate_list(F.col("candidate_behaviors")))).alias("out_of_vocab_semantic_labels"),
    )


def label_quality_gates(groups: DataFrame, overlap_uids: int = 0, conflicting_cells: int = 0, header: Sequence[str] = ()) -> DataFrame:
    """(gate, pass) over the sums of label_quality_by_group."""
    sums = groups.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in QUALITY_COUNTS])
    some = F.col("rows") > 0
    gates = {
        "schema": F.lit(not header), "required_values": some & (F.col("missing_required_values") == 0), "numeric_ranges": F.col("numeric_range_errors") == 0, "boolean_values": F.col("bool_errors") == 0,
        "quality_scores": some & (F.col("missing_quality_rows") == 0), "semantic_confidence": F.col("low_confidence_rows") == 0, "semantic_vocabulary": F.col("out_of_vocab_semantic_labels") == 0, "overlap_agreement": F.lit(not overlap_uids or not conflicting_cells),
    }
    return unpivot_gates(sums, gates)


def unpivot_gates(one_row: DataFrame, gates: Mapping[str, Column]) -> DataFrame:
    return one_row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("gate"), F.coalesce(c, F.lit(False)).alias("pass")) for n, c in gates.items()])).alias("g")).select("g.*")


def _with_roles(rows: DataFrame, pairs: DataFrame, roles: L.Roles) -> DataFrame:
    """Every row with each pair its model belongs to and the research questions it counts for."""
    keyed = rows.select("*", L.applicable_rqs(roles).alias("rqs"), *[_key(c).alias(f"k_{c}") for c in CELL], _key("model_id").alias("k_model"))
    met = keyed.join(small(pair_sides(pairs).withColumnRenamed("model_id", "k_model")), "k_model")
    return met.withColumn("rq", F.explode("rqs"))


_RQ_CELL = ["rq", *PAIR, *[f"k_{c}" for c in CELL]]


def readiness(rows: DataFrame, pairs: DataFrame, min_quality: float = 3.0, strict: bool = True, roles: L.Roles = L.ROLES) -> DataFrame:
    """Per research question and pair: expected and ready matched cells, gaps, status. Rows are summed per cell on the map side, then cells per pair."""
    spark = rows.sparkSession
    missing = L.missing_signals(L.required_signals(roles))
    low = F.coalesce(L.float_no_nan(F.col("quality_score")) < min_quality, F.lit(False))
    has = L.behavior_label() != ""
    state = _with_roles(rows.select("model_id", *CELL, F.size(missing).alias("gaps"), low.alias("low"), has.alias("has")).withColumn("ok", F.expr("gaps = 0 and not low and has")), pairs, roles)
    cell = state.groupBy(*_RQ_CELL).agg(
        F.count("*").alias("n"), F.count_if("ok").alias("ok_n"), F.sum("gaps").alias("gaps"), F.count_if("low").alias("low"), F.count_if(~F.col("has")).alias("blank"), F.bool_or("is_teacher").alias("t"), F.bool_or(~F.col("is_teacher")).alias("s"),
        F.coalesce(F.bool_or(F.col("is_teacher") & F.col("ok")), F.lit(False)).alias("rt"), F.coalesce(F.bool_or(~F.col("is_teacher") & F.col("ok")), F.lit(False)).alias("rs"),
    )
    sums = cell.groupBy("rq", "comparison_id").agg(
        F.sum("n").alias("row_count"), F.sum("ok_n").alias("ready_row_count"), F.count_if(F.expr("t and s")).alias("expected_matched_cells"), F.count_if(F.expr("rt and rs")).alias("ready_matched_cells"), F.sum("gaps").alias("missing_required_values"), F.sum("low").alias("low_quality_rows"), F.sum("blank").alias("missing_behavior_rows")
    )
    spine = pairs.select(*PAIR).crossJoin(F.broadcast(spark.createDataFrame([(r,) for r in L.RQS], "rq string")))
    names = ("row_count", "ready_row_count", "expected_matched_cells", "ready_matched_cells", "missing_required_values", "low_quality_rows", "missing_behavior_rows")
    out = spine.join(sums, ["rq", "comparison_id"], "left").select("rq", *PAIR, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in names])
    expected, done = F.col("expected_matched_cells"), F.col("ready_matched_cells")
    status = F.when(expected == 0, F.when(F.col("rq") == "unlearning_optional", "not_applicable").otherwise("missing_expected_cells")).when(F.lit(strict) & (done < expected), "incomplete").when(done == 0, "missing_ready_cells").otherwise("ready")
    return out.withColumns({"status": status, "readiness_fraction": F.coalesce(F.try_divide(done, expected), F.lit(0.0))})


def readiness_summary(per_pair: DataFrame) -> DataFrame:
    ready = F.col("status").isin("ready", "not_applicable")
    return per_pair.groupBy("rq").agg(F.bool_and(ready).alias("ready"), F.sum("ready_matched_cells").alias("matched_ready_cells"), F.sum("expected_matched_cells").alias("expected_matched_cells"))


def label_manifest_join(rows: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row: labels without a job, fields that differ from the job, evaluations foreign to it, and label ids that are no hash of their parts. Of repeated job ids the last job counts."""
    fields = ("model_id", "benchmark", "condition_type", "image_prompt_uid", "seed")
    index = jobs.groupBy(_key("job_id").alias("job_id")).agg(F.max_by(F.struct(*[_key(f).alias(f) for f in fields], _key("output_path").alias("image_path"), "eval_uids"), "ord").alias("j"))
    joined = rows.select(_key("job_id").alias("job_id"), *[_key(f).alias(f) for f in (*fields, "image_path", "label_uid", "eval_uid")]).join(index, "job_id", "left")
    found = F.col("j").isNotNull()
    differs = [F.count_if(found & (F.col(f) != F.col(f"j.{f}"))).alias(f"{f}_mismatches") for f in (*fields, "image_path")]
    foreign = found & ~F.coalesce(F.array_contains("j.eval_uids", F.col("eval_uid")), F.lit(False))
    return joined.agg(F.count("*").alias("rows"), F.count_if(~found).alias("missing_job_references"), *differs, F.count_if(foreign).alias("eval_uid_not_in_manifest_job"), F.count_if(F.col("label_uid") != stable_hash(F.col("job_id"), F.col("eval_uid"))).alias("label_uid_mismatches"))


def planned_cells(rows: DataFrame, pairs: DataFrame, roles: L.Roles = L.ROLES) -> DataFrame:
    """Planned matched cells per research question, pair and benchmark."""
    cell = _with_roles(rows.select("model_id", *CELL), pairs, roles).groupBy(*_RQ_CELL).agg(F.count("*").alias("n"), F.bool_or("is_teacher").alias("t"), F.bool_or(~F.col("is_teacher")).alias("s"))
    return cell.groupBy("rq", *PAIR, F.col("k_benchmark").alias("benchmark")).agg(F.sum("n").alias("row_count"), F.count_if(F.expr("t and s")).alias("planned_matched_cells"))


def rq_design(planned: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per research question and pair the planned cells and whether the design has any."""
    spine = pairs.select(*PAIR).crossJoin(F.broadcast(planned.sparkSession.createDataFrame([(r,) for r in L.RQS], "rq string")))
    sums = planned.groupBy("rq", "comparison_id").agg(F.sum("row_count").alias("row_count"), F.sum("planned_matched_cells").alias("planned_matched_cells"))
    out = spine.join(sums, ["rq", "comparison_id"], "left").select("rq", *PAIR, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("row_count", "planned_matched_cells")])
    return out.withColumn("status", F.when(F.col("planned_matched_cells") > 0, "planned").when(F.col("rq") == "unlearning_optional", "not_applicable").otherwise("missing_design"))


def dissociation_bridges(rows: DataFrame) -> DataFrame:
    """Per benchmark the axes, and axis targets, that have both a broad and an explicit side."""
    axis = [_key("benchmark").alias("benchmark"), _key("axis_id").alias("axis_id")]
    broad = rows.filter(F.col("condition_type").isin(*L.BROAD_SIDE)).select(*axis).distinct()
    targets = rows.filter(F.col("condition_type").isin(*L.EXPLICIT_SIDE) & (text(F.col("target_behavior")) != "")).select(*axis, text(F.col("target_behavior")).alias("target")).distinct()
    return targets.join(broad, ["benchmark", "axis_id"], "left_semi").groupBy("benchmark").agg(F.countDistinct("axis_id").alias("axis_bridges"), F.count("*").alias("axis_target_bridges"))


def seed_compliance(jobs: DataFrame, policy: DataFrame, default: Sequence[int] | None = None) -> DataFrame:
    """Per benchmark and condition: groups of (model, image prompt) whose seeds are, or are not, those planned.

    The seeds of a group are compared by counts (hits among the planned, extra ones), not gathered into a list.
    """
    keys = ["model_id", "benchmark", "condition_type", "image_prompt_uid"]
    seen = jobs.select(*[_key(k).alias(k) for k in keys], F.col("seed").cast("int").alias("seed")).distinct()
    plan = small(policy.select("benchmark", "condition_type", F.array_distinct("seeds").alias("seeds")))
    with_plan = seen.join(plan, ["benchmark", "condition_type"], "left")
    if default is not None:
        with_plan = with_plan.withColumn("seeds", F.coalesce("seeds", F.array(*map(F.lit, default))))
    group = with_plan.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.array_contains("seeds", F.col("seed"))).alias("hits"), F.max(F.size("seeds")).alias("planned"))
    good = F.coalesce((F.col("n") == F.col("hits")) & (F.col("hits") == F.col("planned")), F.lit(False))
    unknown = F.coalesce(F.col("planned") < 0, F.lit(True))
    return group.groupBy("benchmark", "condition_type").agg(F.count("*").alias("groups"), F.count_if(good).alias("compliant_groups"), F.count_if(~good).alias("noncompliant_groups"), F.count_if(unknown).alias("unknown_policy_groups"))


def power_cells(planned: DataFrame, alpha: float = 0.05, power: float = 0.80, baseline: float = 0.50, least: int = 100) -> DataFrame:
    """Detectable differences per planned cell, nominal and Bonferroni over all cells. The number of cells is taken first: it sets a quantile."""
    for name, x in (("alpha", alpha), ("power", power), ("baseline", baseline)):
        if not 0 < x < 1:
            raise ValueError(f"{name} must lie between 0 and 1")
    cells = planned.filter((F.col("planned_matched_cells") > 0) & (F.col("rq") != "unlearning_optional")).select("rq", *PAIR, "benchmark", "planned_matched_cells")
    tests = max(1, cells.count())
    n = F.col("planned_matched_cells")
    out = cells.withColumns(
        {"ci_half_width_p50": S.proportion_half_width(n, alpha, baseline), "two_proportion_mde_nominal": S.detectable_difference(n, alpha, power, baseline), "two_proportion_mde_bonferroni": S.detectable_difference(n, alpha / tests, power, baseline)}
    )
    return out.withColumn("design_resolution", S.resolution(F.col("two_proportion_mde_nominal"), n, least))


def power_summary(cells: DataFrame, least: int = 100) -> DataFrame:
    n = F.col("planned_matched_cells")
    return cells.groupBy("rq").agg(
        F.count("*").alias("benchmark_tests"), F.min(n).alias("min_planned_matched_cells"), F.median(n).alias("median_planned_matched_cells"), F.max(n).alias("max_planned_matched_cells"), F.max("two_proportion_mde_nominal").alias("worst_nominal_mde"), F.max("two_proportion_mde_bonferroni").alias("worst_bonferroni_mde"), F.count_if(n < least).alias("underpowered_cells")
    )


def power_gates(cells: DataFrame, design_passed: bool, least: int = 100) -> DataFrame:
    one = cells.agg(F.count("*").alias("cells"), F.min("planned_matched_cells").alias("fewest"))
    return unpivot_gates(one, {"design_audit_passed": F.lit(design_passed), "minimum_matched_cells": F.coalesce(F.col("fewest") >= least, F.lit(True)), "inferential_cells_present": F.col("cells") > 0})


def experiment_gates(bank: DataFrame, jobs: DataFrame, rows: DataFrame | None, expected_device: str, excluded: Sequence[str] = ("geneval2",)) -> DataFrame:
    """(gate, pass): excluded benchmarks absent, one device, unique ids, equal jobs per model, and labels complete."""
    counts = jobs.groupBy("model_id").agg(F.count("*").alias("n")).agg(F.min("n").alias("least"), F.max("n").alias("most"))
    out = F.col("benchmark").isin(*excluded)
    j = jobs.agg(F.count("*").alias("jobs"), F.count_if(out).alias("bad_jobs"), F.count_if(_key("device") != expected_device).alias("off_device"), F.countDistinct(_key("job_id")).alias("ids"), F.countDistinct(_key("output_path")).alias("paths"))
    b = bank.agg(F.count_if(out).alias("bad_records"))
    one = j.crossJoin(F.broadcast(counts)).crossJoin(F.broadcast(b))
    gates = {
        "excluded_benchmarks": F.expr("bad_jobs = 0 and bad_records = 0"), "device": F.col("off_device") == 0, "unique_job_ids": F.col("ids") == F.col("jobs"), "unique_output_paths": F.col("paths") == F.col("jobs"), "model_balance": F.col("least") == F.col("most"),
    }
    if rows is not None:
        gaps = F.size(L.missing_signals(L.required_signals()))
        one = one.crossJoin(F.broadcast(rows.agg(F.count_if(L.behavior_label() != "").alias("filled"), F.coalesce(F.sum(gaps), F.lit(0)).alias("gaps"))))
        gates |= {"label_schema": F.lit(not missing_header(rows)), "labels_complete": F.expr("filled > 0 and gaps = 0")}
    return unpivot_gates(one, gates)


def design_gates(bank: DataFrame, jobs: DataFrame, rows: DataFrame, pairs: DataFrame, policy: DataFrame, expected_benchmarks: Sequence[str], device: str, seeds: Sequence[int], required_rqs: Sequence[str], require_bridge: bool = True, shards: DataFrame | None = None, roles: L.Roles = L.ROLES) -> DataFrame:
    """(gate, pass) for the whole design; single_model_shards only where shards are given. Each table is summed on its own; only one-row results meet."""
    from twinlens.config import unique_models

    models = sorted(r[0] for r in unique_models(pairs).limit(MAX_SMALL + 1).collect())
    if len(models) > MAX_SMALL:
        raise ValueError(f"more than {MAX_SMALL} models")
    names = lambda df, c: F.sort_array(F.collect_set(_key(c)))
    arr = lambda xs: F.array(*map(F.lit, sorted(xs))) if xs else F.array().cast("array<string>")
    one = prompt_bank_audit(bank).crossJoin(bank.agg(names(bank, "benchmark").alias("bank_b"))).select("retired_prompt_records", "bank_b")
    one = one.crossJoin(manifest_audit(jobs, device).drop("jobs")).crossJoin(jobs.agg(names(jobs, "benchmark").alias("job_b"), names(jobs, "model_id").alias("job_m")))
    one = one.crossJoin(rows.agg(names(rows, "benchmark").alias("label_b"), names(rows, "model_id").alias("label_m"), names(rows, "condition_type").alias("label_c"), F.countDistinct(_key("label_uid")).alias("uids")))
    one = one.crossJoin(label_manifest_join(rows, jobs))
    balance = lambda df, n: df.groupBy(_key("model_id").alias("m")).agg(F.count("*").alias("n")).filter(F.col("m").isin(*models)).agg(F.expr(f"count(*) = {len(models)} and min(n) = max(n)").alias(n))
    one = one.crossJoin(balance(jobs, "jobs_even")).crossJoin(balance(rows, "labels_even"))
    one = one.crossJoin(seed_compliance(jobs, policy, seeds).agg(F.coalesce(F.sum("noncompliant_groups"), F.lit(0)).alias("off_seed"), F.coalesce(F.sum("unknown_policy_groups"), F.lit(0)).alias("no_policy")))
    design = rq_design(planned_cells(rows, pairs, roles), pairs)
    one = one.crossJoin(design.filter(F.col("rq").isin(*required_rqs)).agg(F.count_if(F.col("planned_matched_cells") == 0).alias("unplanned"))).crossJoin(dissociation_bridges(rows).agg(F.coalesce(F.sum("axis_target_bridges"), F.lit(0)).alias("bridges")))
    every = F.array_union(F.array_union("bank_b", "job_b"), "label_b")
    want = arr(expected_benchmarks)
    inside = lambda a, b: F.size(F.array_except(a, b)) == 0
    off = sum((F.col(f"{f}_mismatches") for f in ("benchmark", "condition_type", "image_prompt_uid", "seed", "image_path")), F.col("model_id_mismatches"))
    gates = {
        "excluded_benchmarks_absent": ~F.array_contains(every, "geneval2"), "required_benchmarks_present": inside(want, F.col("bank_b")) & inside(want, F.col("job_b")) & inside(want, F.col("label_b")), "no_unexpected_benchmarks": inside(every, want),
        "prompt_sources_independent": F.col("retired_prompt_records") == 0, "primary_models_present": (F.col("job_m") == arr(models)) & (F.col("label_m") == arr(models)), "primary_model_job_balance": F.col("jobs_even"), "primary_label_row_balance": F.col("labels_even"),
        "manifest_device": F.col("unexpected_device_jobs") == 0, "model_major_manifest": F.col("model_switches") <= len(models) - 1, "seed_policy": F.expr("off_seed = 0 and no_policy = 0"),
        "manifest_label_join": (F.col("rows") == F.col("expected_label_rows")) & (F.col("missing_job_references") == 0) & (off == 0) & (F.col("eval_uid_not_in_manifest_job") == 0), "label_uid_integrity": (F.col("uids") == F.col("rows")) & (F.col("label_uid_mismatches") == 0),
        "label_schema": F.lit(not missing_header(rows)), "rq_pair_design": F.col("unplanned") == 0, "rq3_dissociation_bridge": F.lit(not require_bridge) | (F.col("bridges") > 0), "safety_memorization_coverage": inside(arr([*L.SAFETY_COVERAGE, *L.MEMORIZATION]), F.col("label_c")),
    }
    if shards is not None:
        one = one.crossJoin(shards.agg(F.count_if(F.col("models") > 1).alias("mixed"), F.sum("jobs").alias("sharded")).crossJoin(jobs.agg(F.count("*").alias("all_jobs"))))
        gates["single_model_shards"] = F.expr("mixed = 0 and sharded = all_jobs")
    return unpivot_gates(one, gates)


def source_gate(bank_paths: Sequence[str]) -> dict[str, bool]:
    """Which configured source paths exist; a driver-side look at names only."""
    from pathlib import Path

    return {p: Path(p).exists() for p in bank_paths}
