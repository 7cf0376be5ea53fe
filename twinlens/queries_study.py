"""Queries of audits, planning and label updates, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlens import config
from twinlens import sql_parts as Q
from twinlens.functions import labels as L
from twinlens.functions import stats as S
from twinlens.functions.text import join_distinct, slugify, stable_hash
from twinlens.operators import analysis as A
from twinlens.operators import audits, planning, updates
from twinlens.operators import evaluator_audit as EA
from twinlens.queries_analysis import rounded
from twinlens.session import materialize, table

DEVICE = "cuda:2"
SEEDS = (101, 102)
#: Planned seeds that are not the default ones.
POLICY = (("hueform", "broad", [101, 102, 103]), ("stagecraft", "broad", [101, 102, 103]))


def policy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(POLICY), "benchmark string, condition_type string, seeds array<int>")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config.selected_pairs(table(spark, sf_dir, "model_pairs"), "all")


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = config.unique_models(_pairs(spark, sf_dir))
    return named.select((F.rank().over(A.Window.orderBy("model_id")) - 1).alias("model_no"), "model_id")  # one row per model


def prompt_bank_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.prompt_bank_audit(table(spark, sf_dir, "prompt_bank"))


def prompt_bank_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.histograms(table(spark, sf_dir, "prompt_bank"), "benchmark", "condition_type", "source")


def conditions_by_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.conditions_by_benchmark(table(spark, sf_dir, "prompt_bank")).withColumn("conditions", F.array_join("conditions", ";"))


def manifest_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.manifest_audit(table(spark, sf_dir, "generation_jobs"), DEVICE)


def label_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audits.label_audit(table(spark, sf_dir, "label_rows")))


def label_signal_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.label_signal_gaps(table(spark, sf_dir, "label_rows"))


def pair_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.pair_coverage(A.labelled(table(spark, sf_dir, "label_rows")), _pairs(spark, sf_dir))


def label_quality_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.label_quality_by_group(table(spark, sf_dir, "label_rows"))


def label_quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "label_rows")
    return audits.label_quality_gates(audits.label_quality_by_group(rows), header=audits.missing_header(rows))


def rq_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audits.readiness(table(spark, sf_dir, "label_rows"), _pairs(spark, sf_dir)))


def rq_readiness_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.readiness_summary(audits.readiness(table(spark, sf_dir, "label_rows"), _pairs(spark, sf_dir)))


def label_manifest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.label_manifest_join(table(spark, sf_dir, "label_rows"), table(spark, sf_dir, "generation_jobs"))


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.planned_cells(table(spark, sf_dir, "label_rows"), _pairs(spark, sf_dir))


def planned_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planned(spark, sf_dir)


def rq_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.rq_design(_planned(spark, sf_dir), _pairs(spark, sf_dir))


def dissociation_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.dissociation_bridges(table(spark, sf_dir, "label_rows"))


def seed_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.seed_compliance(table(spark, sf_dir, "generation_jobs"), policy(spark), SEEDS)


def power_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the Bonferroni column, whose quantile SQL cannot compute; power_summary has it."""
    return rounded(audits.power_cells(materialize(_planned(spark, sf_dir), "planned"))).drop("two_proportion_mde_bonferroni")


def power_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audits.power_summary(audits.power_cells(materialize(_planned(spark, sf_dir), "planned"))))


def experiment_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.experiment_gates(table(spark, sf_dir, "prompt_bank"), table(spark, sf_dir, "generation_jobs"), table(spark, sf_dir, "label_rows"), DEVICE)


def design_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmarks = ["echoplate", "harborline", "hueform", "knotwork", "lorecheck", "mirrorcast", "softgate", "stagecraft"]
    rqs = [r for r in L.RQS if r != "unlearning_optional"]
    return audits.design_gates(table(spark, sf_dir, "prompt_bank"), table(spark, sf_dir, "generation_jobs"), table(spark, sf_dir, "label_rows"), _pairs(spark, sf_dir), policy(spark), benchmarks, DEVICE, SEEDS, rqs)


def generation_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.generation_prompts(table(spark, sf_dir, "prompt_bank")).withColumn("eval_uids", F.array_join("eval_uids", ","))


def generation_prompts_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.generation_prompts(table(spark, sf_dir, "prompt_bank"), limit_per_benchmark=25).select("image_prompt_uid", "first_ord", "benchmark", F.size("eval_uids").alias("evals"))


def generation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = planning.generation_jobs(planning.generation_prompts(table(spark, sf_dir, "prompt_bank")), _models(spark, sf_dir), policy(spark), SEEDS)
    return jobs.select("job_id", "model_id", "benchmark", "condition_type", "image_prompt_uid", "seed", "output_path", "requires_valid_lineage")


def job_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.summarize_jobs(table(spark, sf_dir, "generation_jobs"))


def label_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = planning.label_template(table(spark, sf_dir, "prompt_bank"), table(spark, sf_dir, "generation_jobs"))
    return rows.select("job_ord", "record_ord", "label_uid", "job_id", "eval_uid", "model_id", "benchmark", "axis_id", "condition_type", "image_prompt_uid", "seed", "image_path", "evaluator")


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.shard_index(planning.assign_shards(table(spark, sf_dir, "generation_jobs"), 200))


def shards_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.shard_index(planning.assign_shards(table(spark, sf_dir, "generation_jobs"), 200, True))


def evaluator_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.evaluator_plan(table(spark, sf_dir, "label_rows"))


def evaluator_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.evaluator_batches(table(spark, sf_dir, "label_rows"), 500)


def evaluator_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.task_rows(table(spark, sf_dir, "label_rows")).select("ord", "label_uid", "evaluator_kind", "required_columns", "prompt_text", "prompt_chars")


def evaluator_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "label_rows")
    return EA.group_rows(rows, planning.task_rows(rows), planning.evaluator_batches(rows, 500))


def evaluator_mapping_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EA.mapping_errors(table(spark, sf_dir, "label_rows"))


def evaluator_task_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels against a task index that was planned before the last load. The SQL plans it from the first three loads only."""
    rows = table(spark, sf_dir, "label_rows")
    last = rows.agg(F.max("load_id").alias("last_load"))
    return EA.task_errors(rows, planning.task_rows(rows.join(F.broadcast(last), F.col("load_id") < F.col("last_load")).drop("last_load")))


def evaluator_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "label_rows")
    return EA.gates(rows, planning.task_rows(rows))


def export_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = planning.export_batch(table(spark, sf_dir, "label_rows"), 100, 50, kinds=("attribute_distribution_labeling",))
    return rows.select("ord", "label_uid", "evaluator_kind", "prompt_text")


def preflight_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = planning.preflight_prompts(table(spark, sf_dir, "prompt_bank"))
    return planning.preflight_jobs(table(spark, sf_dir, "generation_jobs"), picked, [101]).select("ord", "job_id", "model_id", "image_prompt_uid", "seed")


def prompt_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.benchmark_summary(table(spark, sf_dir, "prompt_bank"), policy(spark), 10)


def axis_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.axis_summary(table(spark, sf_dir, "prompt_bank"))


def update_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return updates.validate(table(spark, sf_dir, "label_updates"))


def update_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return updates.validation_summary(table(spark, sf_dir, "label_updates"))


def merged_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return updates.combine(table(spark, sf_dir, "label_updates")).withColumn("conflicts", F.array_join("conflicts", ","))


def merged_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return updates.merge(table(spark, sf_dir, "label_rows"), table(spark, sf_dir, "label_updates")).select("ord", "label_uid", *updates.FIELDS, "updated")


def update_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(updates.reliability_by_field(table(spark, sf_dir, "label_updates")))


def update_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(updates.reliability_summary(table(spark, sf_dir, "label_updates")))


def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "prompt_bank")
    return rows.select("ord", stable_hash(F.col("benchmark"), F.col("source_row_id"), F.col("target_behavior")).alias("hash"), slugify(F.col("prompt_text")).alias("slug"), join_distinct(F.concat_ws(";", "evaluator", "source", "evaluator")).alias("joined"))


QUERIES = {
    f.__name__: f
    for f in (
        prompt_bank_audit, prompt_bank_histograms, conditions_by_benchmark, manifest_audit, label_audit, label_signal_gaps, pair_coverage, label_quality_by_group, label_quality_gates, rq_readiness, rq_readiness_summary,
        label_manifest_join, planned_cells, rq_design, dissociation_bridges, seed_compliance, power_cells, power_summary, experiment_gates, design_gates, generation_prompts, generation_prompts_first, generation_plan, job_summary,
        label_template, shards, shards_by_model, evaluator_plan, evaluator_batches, evaluator_tasks, evaluator_groups, evaluator_mapping_errors, evaluator_task_errors, evaluator_gates, export_batch, preflight_jobs, prompt_summary, axis_summary, update_errors, update_validation, merged_updates, merged_labels,
        update_reliability, update_agreement, text_functions,
    )
}

_R = L.ROLES
_IN = Q.in_list
_REQ = f"""case when {_IN("condition_type", L.SAFETY)} then ['unsafe', 'refusal', 'quality_score'] when {_IN("benchmark", _R.overrefusal)} or condition_type = 'benign_overrefusal' then ['refusal', 'unsafe', 'quality_score']
  when {_IN("condition_type", L.MEMORIZATION)} then ['memorization_score', 'quality_score'] when starts_with(condition_type, 'unlearning_') then ['pass_score', 'semantic_label', 'quality_score'] when {_IN("condition_type", L.PASS_FAIL)} then ['pass_score', 'quality_score']
  when {_IN("condition_type", L.DISTRIBUTION)} then ['semantic_label', 'quality_score'] else ['quality_score'] end"""
_KIND = f"""case when {_IN("benchmark", _R.unlearning)} or starts_with(condition_type, 'unlearning_') then 'unlearning_lineage_audit' when {_IN("condition_type", L.MEMORIZATION)} or {_IN("benchmark", _R.memorization)} then 'memorization_copy_detection'
  when condition_type = 'benign_overrefusal' then 'safety_overrefusal_audit' when {_IN("benchmark", _R.overrefusal)} or {_IN("condition_type", L.SAFETY)} then 'safety_image_audit' when condition_type = 'explicit' then 'explicit_attribute_pass_fail'
  when {_IN("benchmark", _R.composition)} or condition_type = 'compositional_native' then 'composition_pass_fail' when {_IN("benchmark", _R.knowledge)} or condition_type in ('implicit_knowledge', 'knowledge_native', 'knowledge_injected') then 'knowledge_checklist_pass_fail'
  when condition_type in ('broad', 'social_bias_default') then 'attribute_distribution_labeling' else 'generic_pass_fail' end"""
_RULES = (
    f"{_IN('benchmark', _R.fit_on)} and condition_type in ('broad', 'benchmark_native')", _IN("benchmark", _R.transfer_to), "not starts_with(condition_type, 'unlearning_')", _IN("condition_type", (*L.BROAD_SIDE, *L.EXPLICIT_SIDE)), "not starts_with(condition_type, 'unlearning_')",
    f"{_IN('condition_type', (*L.SAFETY, 'benign_overrefusal'))} or {_IN('benchmark', _R.overrefusal)}", f"{_IN('benchmark', _R.memorization)} or {_IN('condition_type', L.MEMORIZATION)}", f"{_IN('benchmark', _R.unlearning)} or starts_with(condition_type, 'unlearning_')",
)
_RQS = "list_filter([" + ", ".join(f"case when {rule} then '{name}' end" for name, rule in zip(L.RQS, _RULES, strict=True)) + "], lambda x: x is not null)"
_RQ_TABLE = "(select unnest([" + ", ".join(f"'{r}'" for r in L.RQS) + "]) as rq)"
_BLANK = "[" + ", ".join(f"case when {Q.text(s)} = '' then '{s}' end" for s in L.SIGNALS) + "]"
_K = ", ".join(f"coalesce({c}, '') as {c}" for c in ("model_id", "benchmark", "axis_id", "condition_type", "image_prompt_uid", "seed", "eval_uid"))
_RAW = f"raw as (select * replace ({_K}) from label_rows)"
_GAPS = f"len(list_filter({_REQ}, lambda x: list_contains({_BLANK}, x)))"
_NONAN = lambda c: f"(case when isnan({Q.number(c)}) then null else {Q.number(c)} end)"
_LABELLED = f"lb as (select *, {Q.ladder('sem')} as label from (select *, {Q.text('semantic_label')} as sem, {Q.flag('refusal')} as rf, {Q.flag('unsafe')} as us, {Q.number('pass_score')} as ps, {Q.number('memorization_score')} as ms from raw))"
_NORM = lambda c: f"replace(lower({Q.text(c)}), ' ', '_')"
_RANGE_ERR = " + ".join(f"(case when {Q.text(c)} <> '' and not coalesce({_NONAN(c)} between {lo} and {hi}, false) then 1 else 0 end)" for c, (lo, hi) in L.RANGES.items())
_BOOL_ERR = " + ".join(f"(case when {Q.text(c)} <> '' and {Q.flag(c)} is null then 1 else 0 end)" for c in ("refusal", "unsafe"))
_OOV = f"""nl <> '' and len(cand) > 0 and not {_IN("nl", L.GENERIC_LABELS)} and not list_bool_or(list_transform(cand, lambda c: c = nl or starts_with(c, nl) or starts_with(nl, c)))"""
_QUALITY = f"""with {_RAW}, {_LABELLED},
x as (select *, {_NORM("semantic_label")} as nl, list_transform({Q.json_list("candidate_behaviors")}, lambda c: replace(lower({Q.text("c")}), ' ', '_')) as cand from lb),
grp as (select benchmark, condition_type, count(*) as rows, count_if(label <> '') as filled_rows, sum({_GAPS})::bigint as missing_required_values, sum({_RANGE_ERR})::bigint as numeric_range_errors, sum({_BOOL_ERR})::bigint as bool_errors, count_if({Q.text("quality_score")} = '') as missing_quality_rows,
  count_if({_NONAN("quality_score")} < 3.0) as low_quality_rows, count_if(sem <> '' and {_NONAN("semantic_label_confidence")} < 0.6 and not (nl in ('unclear', 'ambiguous', 'other') or contains(nl, 'unclear'))) as low_confidence_rows, count_if({_OOV}) as out_of_vocab_semantic_labels from x group by all)"""
_MET = f"met as (select r.*, comparison_id, family, model_id = teacher_model_id as is_t, unnest({_RQS}) as rq from st r join model_pairs on model_id in (teacher_model_id, student_model_id))"
_CELL = f"rq, comparison_id, family, {Q.CELL}"
_PLANNED = f"""{_RAW}, st as (select * from raw), {_MET},
cl as (select {_CELL}, count(*) as n, bool_or(is_t) as t, bool_or(not is_t) as s from met group by all),
planned as (select rq, comparison_id, family, benchmark, sum(n)::bigint as row_count, count_if(t and s) as planned_matched_cells from cl group by all)"""
_READY = f"""with {_RAW}, {_LABELLED},
st as (select *, {_GAPS} as gaps, coalesce({_NONAN("quality_score")} < 3.0, false) as low, label <> '' as has from lb), {_MET},
cl as (select {_CELL}, count(*) as n, count_if(gaps = 0 and not low and has) as okn, sum(gaps) as gaps, count_if(low) as low, count_if(not has) as blank, bool_or(is_t) as t, bool_or(not is_t) as s, bool_or(is_t and gaps = 0 and not low and has) as rt, bool_or(not is_t and gaps = 0 and not low and has) as rs from met group by all),
sm as (select rq, comparison_id, sum(n) as n, sum(okn) as okn, count_if(t and s) as e, count_if(rt and rs) as r, sum(gaps) as gaps, sum(low) as low, sum(blank) as blank from cl group by all),
rd as (select rq, comparison_id, family, coalesce(n, 0)::bigint as row_count, coalesce(okn, 0)::bigint as ready_row_count, coalesce(e, 0)::bigint as expected_matched_cells, coalesce(r, 0)::bigint as ready_matched_cells, coalesce(gaps, 0)::bigint as missing_required_values, coalesce(low, 0)::bigint as low_quality_rows,
  coalesce(blank, 0)::bigint as missing_behavior_rows from {_RQ_TABLE} cross join model_pairs left join sm using (rq, comparison_id)),
ready as (select *, case when expected_matched_cells = 0 then case when rq = 'unlearning_optional' then 'not_applicable' else 'missing_expected_cells' end when ready_matched_cells < expected_matched_cells then 'incomplete' when ready_matched_cells = 0 then 'missing_ready_cells' else 'ready' end as status,
  round(coalesce(ready_matched_cells / nullif(expected_matched_cells, 0), 0.0), 9) as readiness_fraction from rd)"""
_POLICY = "pol as (select * from (values " + ", ".join(f"('{b}', '{c}', {s})" for b, c, s in POLICY) + ") as p(benchmark, condition_type, seeds))"
_GATES = lambda gates: "select unnest([" + ", ".join(f"'{g}'" for g in gates) + "]) as gate, unnest([" + ", ".join(f"coalesce({c}, false)" for c in gates.values()) + "]) as pass"
_ZA, _ZP = S.NormalDist().inv_cdf(0.975), S.NormalDist().inv_cdf(0.8)
_JOBS_MISSING = ", ".join(f"count_if({'len(eval_uids) is null or len(eval_uids) = 0' if f == 'eval_uids' else f'{f} is null' if f in ('seed', 'num_inference_steps') else Q.text(f) + ' = ' + chr(39) * 2}) as missing_{f}" for f in audits.JOB_FIELDS)
_PAYLOAD = "[" + ", ".join(Q.text(f) for f in updates.FIELDS) + "]"
_UERR = [("uid <> '' and prev is not null and prev <> payload", "", "conflicting duplicate update"), ("uid = ''", "label_uid", "missing label_uid")]
for _c, (_lo, _hi) in L.RANGES.items():
    _UERR += [(f"uid <> '' and {Q.text(_c)} <> '' and {Q.number(_c)} is null", _c, "not numeric"), (f"uid <> '' and {Q.number(_c)} is not null and not isnan({Q.number(_c)}) and ({Q.number(_c)} < {_lo} or {Q.number(_c)} > {_hi})", _c, "out of range")]
_UERR += [(f"uid <> '' and {Q.text(c)} <> '' and {Q.flag(c)} is null", c, "not boolean-like") for c in ("refusal", "unsafe")]
_UPD = f"upd as (select *, {Q.text('label_uid')} as uid, {_PAYLOAD} as payload from label_updates), lagged as (select *, lag(payload) over (partition by uid order by ord) as prev from upd)"
_ERRORS = f"with {_UPD}, errs as (" + " union all ".join(f"select ord, uid as label_uid, '{f}' as field, '{e}' as error from lagged where {w}" for w, f, e in _UERR) + ")"
_PLAIN = [f for f in updates.FIELDS if f not in updates.JOINED]
_COMBINED = f"""{_UPD},
firsts as (select uid, count(*) as updates, {", ".join(f"arg_min({f}, ord) filter ({Q.text(f)} <> '') as {f}" for f in updates.FIELDS)}, {", ".join(f"count(distinct {f}) filter ({Q.text(f)} <> '') > 1 as n_{f}" for f in _PLAIN)},
  {", ".join(f"list({f} order by ord) filter ({Q.text(f)} <> '') as l_{f}" for f in updates.JOINED)} from upd where uid <> '' group by uid),
comb as (select uid as label_uid, updates, {", ".join(_PLAIN)}, {", ".join(f"case when updates > 1 and l_{f} is not null then array_to_string(list_filter(p_{f}, lambda x, i: list_position(p_{f}, x) = i), '; ') else {f} end as {f}" for f in updates.JOINED)},
  array_to_string(list_filter([{", ".join(f"case when n_{f} then '{f}' end" for f in _PLAIN)}], lambda x: x is not null), ',') as conflicts
  from (select *, {", ".join(f"list_filter(list_transform(string_split(array_to_string(l_{f}, ';'), ';'), lambda x: {Q.strip('x')}), lambda x: x <> '') as p_{f}" for f in updates.JOINED)} from firsts))"""
_BEHAVIOR = f"beh as (select ord, {Q.text('label_uid')} as uid, {_NORM('semantic_label')} as nl, {Q.flag('refusal')} as rf, {Q.flag('unsafe')} as us, {_NONAN('pass_score')} as ps, {_NONAN('memorization_score')} as ms from label_updates), bl as (select ord, uid, {Q.ladder('nl')} as v from beh)"
_MILLIONTHS = lambda c: f"round({_NONAN(c)} * 1000000)::bigint"
_VALUES = " union all ".join(
    [f"select ord, {Q.text('label_uid')} as uid, '{f}' as field, {Q.text(f)} as v, null::bigint as x from label_updates" for f in ("semantic_label", "evaluator", "notes")]
    + [f"select ord, {Q.text('label_uid')}, '{f}', cast({Q.flag(f)} as varchar), null from label_updates" for f in ("refusal", "unsafe")]
    + ["select ord, uid, 'behavior_label', v, null from bl"]
    + [f"select ord, {Q.text('label_uid')}, '{f}', case when {_NONAN(f)} is not null then 'n' end, {_MILLIONTHS(f)} from label_updates" for f in L.RANGES]
)
_SCHEMAS = "schemas as (select * from (values " + ", ".join(f"('{k}', {list(v)})" for k, v in L.KIND_OUTPUTS.items()) + ") as s(evaluator_kind, outputs))"

SQL = {
    "prompt_bank_audit": """select count(*) as records, count(distinct coalesce(image_prompt_uid, '')) as unique_image_prompts, count(distinct coalesce(axis_id, '')) as axis_count, count(distinct coalesce(eval_uid, '')) as eval_uids, count(*) - count(distinct coalesce(eval_uid, '')) as duplicate_eval_uids,
  count_if(requires_valid_lineage) as requires_valid_lineage_records, count_if(regexp_matches(lower(coalesce(source, '') || ' ' || coalesce(source_path, '')), 'h1_prompt|h2_prompt|h1/h2|diversity_h1|diversity_h2')) as retired_prompt_records from prompt_bank""",
    "prompt_bank_histograms": " union all ".join(f"select '{c}' as field, coalesce({c}, '') as value, count(*) as rows from prompt_bank group by all" for c in ("benchmark", "condition_type", "source")),
    "conditions_by_benchmark": "select coalesce(benchmark, '') as benchmark, string_agg(distinct coalesce(condition_type, ''), ';' order by coalesce(condition_type, '')) as conditions from prompt_bank group by all",
    "manifest_audit": f"""with o as (select *, lag(coalesce(model_id, '')) over (order by ord) as pm from generation_jobs)
select count(*) as jobs, count(*) - count(distinct coalesce(job_id, '')) as duplicate_job_ids, count(*) - count(distinct coalesce(output_path, '')) as duplicate_output_paths, count_if(coalesce(device, '') <> '{DEVICE}') as unexpected_device_jobs, coalesce(sum(len(eval_uids)), 0)::bigint as expected_label_rows, {_JOBS_MISSING},
  count_if(pm is not null and pm <> coalesce(model_id, '')) as model_switches from o""",
    "label_audit": f"with {_RAW}, {_LABELLED} select count(*) as rows, count_if(label <> '') as filled_rows, round(coalesce(count_if(label <> '') / nullif(count(*), 0), 0.0), 9) as filled_fraction, count(*) - count(distinct coalesce(label_uid, '')) as duplicate_label_uids from lb",
    "label_signal_gaps": f"with {_RAW}, e as (select condition_type, unnest({_REQ}) as column_name, {_BLANK} as blank from raw) select condition_type, column_name, count(*) as required, count_if(list_contains(blank, column_name)) as missing from e group by all",
    "pair_coverage": f"""with {Q.LAB}, c as (select distinct model_id, {Q.CELL} from labelled), a as (select count(*) as n from (select distinct {Q.CELL} from c)),
m as (select comparison_id, {Q.CELL}, bool_or(model_id = teacher_model_id) as t, bool_or(model_id = student_model_id) as s from c cross join model_pairs group by all)
select comparison_id, count_if(t and s) as matched_labeled_cells, count_if(t and not s) as teacher_only_labeled_cells, count_if(s and not t) as student_only_labeled_cells, count_if(not t and not s) as neither_labeled_cells from m group by all""",
    "label_quality_by_group": f"{_QUALITY} select * from grp",
    "label_quality_gates": f"""{_QUALITY}, sm as (select coalesce(sum(rows), 0) as rows, sum(missing_required_values) as a, sum(numeric_range_errors) as b, sum(bool_errors) as c, sum(missing_quality_rows) as d, sum(low_confidence_rows) as e, sum(out_of_vocab_semantic_labels) as f from grp)
{_GATES({"schema": "true", "required_values": "rows > 0 and a = 0", "numeric_ranges": "b = 0", "boolean_values": "c = 0", "quality_scores": "rows > 0 and d = 0", "semantic_confidence": "e = 0", "semantic_vocabulary": "f = 0", "overlap_agreement": "true"})} from sm""",
    "rq_readiness": f"{_READY} select * from ready",
    "rq_readiness_summary": f"{_READY} select rq, bool_and(status in ('ready', 'not_applicable')) as ready, sum(ready_matched_cells)::bigint as matched_ready_cells, sum(expected_matched_cells)::bigint as expected_matched_cells from ready group by all",
    "label_manifest_join": f"""with j as (select coalesce(job_id, '') as job_id, arg_max(struct_pack(model_id := coalesce(model_id, ''), benchmark := coalesce(benchmark, ''), condition_type := coalesce(condition_type, ''), image_prompt_uid := coalesce(image_prompt_uid, ''), seed := coalesce(cast(seed as varchar), ''), image_path := coalesce(output_path, ''), eval_uids := eval_uids), ord) as j from generation_jobs group by all),
l as (select coalesce(l.job_id, '') as job_id, {", ".join(f"coalesce(l.{c}, '') as {c}" for c in ("model_id", "benchmark", "condition_type", "image_prompt_uid", "seed", "image_path", "label_uid", "eval_uid"))}, j.j as j from label_rows l left join j on coalesce(l.job_id, '') = j.job_id)
select count(*) as rows, count_if(j is null) as missing_job_references, {", ".join(f"count_if(j is not null and {c} <> j.{c}) as {c}_mismatches" for c in ("model_id", "benchmark", "condition_type", "image_prompt_uid", "seed", "image_path"))},
  count_if(j is not null and not coalesce(list_contains(j.eval_uids, eval_uid), false)) as eval_uid_not_in_manifest_job, count_if(label_uid <> substr(sha1(job_id || '␟' || eval_uid), 1, 16)) as label_uid_mismatches from l""",
    "planned_cells": f"with {_PLANNED} select * from planned",
    "rq_design": f"""with {_PLANNED}, sm as (select rq, comparison_id, sum(row_count) as n, sum(planned_matched_cells) as c from planned group by all)
select rq, comparison_id, family, coalesce(n, 0)::bigint as row_count, coalesce(c, 0)::bigint as planned_matched_cells, case when coalesce(c, 0) > 0 then 'planned' when rq = 'unlearning_optional' then 'not_applicable' else 'missing_design' end as status from {_RQ_TABLE} cross join model_pairs left join sm using (rq, comparison_id)""",
    "dissociation_bridges": f"""with {_RAW}, b as (select distinct benchmark, axis_id from raw where {_IN("condition_type", L.BROAD_SIDE)}), t as (select distinct benchmark, axis_id, {Q.text("target_behavior")} as t from raw where {_IN("condition_type", L.EXPLICIT_SIDE)} and {Q.text("target_behavior")} <> '')
select benchmark, count(distinct axis_id) as axis_bridges, count(*) as axis_target_bridges from t semi join b using (benchmark, axis_id) group by all""",
    "seed_compliance": f"""with {_POLICY}, g as (select coalesce(model_id, '') as m, coalesce(benchmark, '') as benchmark, coalesce(condition_type, '') as condition_type, coalesce(image_prompt_uid, '') as i, list_sort(list(distinct seed)) as got from generation_jobs group by all),
w as (select benchmark, condition_type, got = list_sort(coalesce(seeds, {list(SEEDS)})) as ok from g left join pol using (benchmark, condition_type))
select benchmark, condition_type, count(*) as groups, count_if(ok) as compliant_groups, count_if(not ok) as noncompliant_groups, 0::bigint as unknown_policy_groups from w group by all""",
    "experiment_gates": f"""with {_RAW}, {_LABELLED}, l as (select count_if(label <> '') as filled, sum({_GAPS}) as gaps from lb), m as (select min(n) as lo, max(n) as hi from (select model_id, count(*) as n from generation_jobs group by all)),
j as (select count(*) as n, count_if(benchmark = 'geneval2') as bad, count_if(coalesce(device, '') <> '{DEVICE}') as off, count(distinct coalesce(job_id, '')) as ids, count(distinct coalesce(output_path, '')) as paths from generation_jobs)
{_GATES({"excluded_benchmarks": "bad = 0", "device": "off = 0", "unique_job_ids": "ids = n", "unique_output_paths": "paths = n", "model_balance": "lo = hi", "label_schema": "true", "labels_complete": "filled > 0 and gaps = 0"})} from l, m, j""",
    "generation_prompts": """select image_prompt_uid, min(ord) as first_ord, arg_min(struct_pack(v := benchmark), ord).v as benchmark, arg_min(struct_pack(v := condition_type), ord).v as condition_type, arg_min(struct_pack(v := prompt_text), ord).v as prompt_text, arg_min(struct_pack(v := requires_valid_lineage), ord).v as requires_valid_lineage,
  string_agg(eval_uid, ',' order by ord) as eval_uids from prompt_bank where not coalesce(requires_valid_lineage, false) group by image_prompt_uid""",
    "generation_prompts_first": """with f as (select benchmark, image_prompt_uid, min(ord) as fo from prompt_bank where not coalesce(requires_valid_lineage, false) and benchmark is not null group by benchmark, image_prompt_uid qualify row_number() over (partition by benchmark order by fo) <= 25)
select image_prompt_uid, min(ord) as first_ord, arg_min(benchmark, ord) as benchmark, count(*)::int as evals from prompt_bank semi join f using (benchmark, image_prompt_uid) where not coalesce(requires_valid_lineage, false) group by image_prompt_uid""",
    "generation_plan": f"""with {_POLICY}, m as (select distinct unnest([teacher_model_id, student_model_id]) as model_id from model_pairs),
p as (select image_prompt_uid, arg_min(struct_pack(b := benchmark, c := condition_type, r := requires_valid_lineage), ord) as h from prompt_bank where not coalesce(requires_valid_lineage, false) group by image_prompt_uid),
s as (select image_prompt_uid, h.b as benchmark, h.c as condition_type, h.r as requires_valid_lineage, unnest(coalesce(seeds, {list(SEEDS)})) as seed from p left join pol on h.b = pol.benchmark and h.c = pol.condition_type)
select substr(sha1(model_id || '␟' || image_prompt_uid || '␟' || seed), 1, 16) as job_id, model_id, benchmark, condition_type, image_prompt_uid, seed::int as seed,
  'outputs/images/' || model_id || '/' || benchmark || '/' || left(regexp_replace(regexp_replace(regexp_replace(lower(trim(image_prompt_uid)), '[^a-z0-9가-힣._-]+', '_', 'g'), '_+', '_', 'g'), '^[_.]+|[_.]+$', '', 'g'), 80) || '__seed' || seed || '.png' as output_path, requires_valid_lineage from s cross join m""",
    "job_summary": " union all ".join(f"select '{c}' as field, coalesce({c}, '') as value, count(*) as rows from generation_jobs group by all" for c in ("model_id", "benchmark", "device")),
    "label_template": """select j.ord as job_ord, r.ord as record_ord, substr(sha1(job_id || '␟' || r.eval_uid), 1, 16) as label_uid, job_id, r.eval_uid, j.model_id, r.benchmark, r.axis_id, r.condition_type, r.image_prompt_uid, j.seed, j.output_path as image_path, coalesce(r.evaluator, '') as evaluator
from generation_jobs j join prompt_bank r using (image_prompt_uid) where not coalesce(r.requires_valid_lineage, false)""",
    "shards": """with s as (select *, (row_number() over (order by ord) - 1) // 200 as shard from generation_jobs)
select shard, count(*) as jobs, arg_min(job_id, ord) as first_job_id, arg_max(job_id, ord) as last_job_id, count(distinct coalesce(model_id, '')) as models, count(distinct benchmark) as benchmarks from s group by all""",
    "shards_by_model": """with o as (select *, coalesce(model_id, '') as m, row_number() over (order by ord) as place from generation_jobs), l as (select *, case when m <> lag(m) over (order by place) then 1 else 0 end as turn from o),
r as (select *, sum(turn) over (order by place) as run from l), s as (select *, (row_number() over (partition by run order by place) - 1) // 200 as k from r), d as (select *, dense_rank() over (order by run, k) - 1 as shard from s)
select shard, count(*) as jobs, arg_min(job_id, ord) as first_job_id, arg_max(job_id, ord) as last_job_id, count(distinct m) as models, count(distinct benchmark) as benchmarks from d group by all""",
    "evaluator_plan": f"with {_RAW}, r as (select benchmark, condition_type, {_KIND} as evaluator_kind, {_REQ} as req from raw) select benchmark, condition_type, evaluator_kind, count(*) as rows, array_to_string(list_sort(list_distinct(flatten(list(req)))), ',') as required_columns from r group by all",
    "evaluator_batches": f"""with {_RAW}, r as (select ord, {_KIND} as evaluator_kind, benchmark, condition_type from raw), b as (select *, (row_number() over (partition by evaluator_kind, benchmark, condition_type order by ord) - 1) // 500 as batch_in_group from r),
i as (select evaluator_kind, benchmark, condition_type, batch_in_group, count(*) as rows, min(ord) as first_ord, max(ord) as last_ord from b group by all)
select row_number() over (order by first_ord) - 1 as batch_no, * from i""",
    "evaluator_tasks": f"""with {_RAW}, r as (select *, {_KIND} as kind, {_REQ} as req from raw)
select ord, label_uid, kind as evaluator_kind, array_to_string(req, ',') as required_columns, case when {_IN("kind", L.PROMPT_KINDS)} and not {_IN("kind", L.SAFETY_KINDS)} then coalesce(prompt_text, '') else '<redacted>' end as prompt_text, length(coalesce(prompt_text, ''))::int as prompt_chars from r""",
    "evaluator_groups": f"""with {_RAW}, r as (select *, {_KIND} as evaluator_kind, {_REQ} as req from raw)
select benchmark, condition_type, evaluator_kind, count_if({Q.text("label_uid")} <> '') as label_rows, count(*) as task_index_rows, count(*) as batch_rows, array_to_string(list_sort(list_distinct(flatten(list(req)))), ',') as required_columns from r group by all""",
    "evaluator_mapping_errors": f"""with {_RAW}, {_SCHEMAS}, r as (select *, {_KIND} as evaluator_kind, {_REQ} as req, {Q.text("label_uid")} as uid from raw), j as (select * from r left join schemas using (evaluator_kind)),
e as (select 'missing label_uid' as error, count_if(uid = '') as rows from j union all select 'missing schema', count_if(uid <> '' and outputs is null) from j union all select 'required outputs missing from schema', count_if(uid <> '' and len(list_filter(req, lambda x: not list_contains(outputs, x))) > 0) from j
  union all select 'quality_score not required', count_if(uid <> '' and not list_contains(req, 'quality_score')) from j union all select 'duplicate label_uid', count_if(uid <> '') - count(distinct uid) filter (uid <> '') from j)
select * from e where rows > 0""",
    "evaluator_task_errors": f"""with {_RAW}, r as (select ord, load_id, {Q.text("label_uid")} as uid, {_KIND} as kind, list_sort({_REQ}) as req from raw),
w as (select uid, arg_max(kind, ord) as kind, arg_max(req, ord) as req from r where uid <> '' group by uid), h as (select uid, kind as hk, req as hr from r where load_id < (select max(load_id) from label_rows)), f as (select * from h full join w using (uid)),
e as (select 'label_uid absent from labels' as error, count_if(hk is not null and kind is null) as rows from f union all select 'label_uid absent from task index', count_if(hk is null) from f union all select 'evaluator_kind mismatch', count_if(hk <> kind) from f union all select 'required_columns mismatch', count_if(hr <> req) from f)
select * from e where rows > 0""",
    "export_batch": f"""with {_RAW}, r as (select *, {_KIND} as kind from raw) select ord, label_uid, kind as evaluator_kind, '<redacted>' as prompt_text from r where kind = 'attribute_distribution_labeling' and ord >= 50 order by ord limit 100""",
    "preflight_jobs": """with f as (select coalesce(benchmark, '') as b, coalesce(condition_type, '') as c, image_prompt_uid, min(ord) as fo from prompt_bank where not coalesce(requires_valid_lineage, false) group by b, c, image_prompt_uid qualify row_number() over (partition by b, c order by fo) <= 2)
select ord, job_id, model_id, image_prompt_uid, seed from generation_jobs semi join f using (image_prompt_uid) where seed = 101""",
    "prompt_summary": f"""with {_POLICY}, p as (select benchmark, condition_type, count(*) as records, count(distinct image_prompt_uid) as images from prompt_bank group by all),
e as (select p.*, coalesce(len(seeds), 1) as k from p left join pol using (benchmark, condition_type)),
d as (select benchmark, count(distinct image_prompt_uid) as image_prompts, count(distinct axis_id) as axes from prompt_bank group by all)
select benchmark, sum(records)::bigint as records, sum(images * k * 10)::bigint as generation_jobs, sum(records * k * 10)::bigint as label_rows, string_agg(distinct coalesce(condition_type, ''), ';' order by coalesce(condition_type, '')) as conditions, any_value(image_prompts) as image_prompts, any_value(axes) as axes from e join d using (benchmark) group by benchmark""",
    "axis_summary": """select coalesce(benchmark, '') as benchmark, coalesce(condition_type, '') as condition_type, coalesce(axis_id, '') as axis_id, count(*) as records, count(distinct image_prompt_uid) as image_prompts, string_agg(distinct coalesce(complexity_level, ''), ';' order by coalesce(complexity_level, '')) as complexity_levels from prompt_bank group by all""",
    "update_errors": f"{_ERRORS} select * from errs",
    "update_validation": f"""{_ERRORS}, t as (select count(*) as rows, count(distinct uid) filter (uid <> '') as u, count_if(uid <> '') as n from upd), e as (select count(*) as c, count_if(error = 'conflicting duplicate update') as d from errs)
select rows, u as unique_label_uids, n - u as duplicate_label_uids, d as conflicting_duplicate_label_uids, c as error_count, c = 0 as valid from t, e""",
    "merged_updates": f"with {_COMBINED} select * from comb",
    "merged_labels": f"with {_COMBINED} select l.ord, l.label_uid, {', '.join(f'coalesce(c.{f}, l.{f}) as {f}' for f in updates.FIELDS)}, c.label_uid is not null as updated from label_rows l left join comb c on {Q.text('l.label_uid')} = c.label_uid",
    "update_reliability": f"""with {_BEHAVIOR}, vals as ({_VALUES}), pr as (select a.field, a.v as va, b.v as vb, abs(a.x - b.x) as d from vals a join vals b on a.uid = b.uid and a.field = b.field and a.ord < b.ord where a.uid <> '' and a.v <> '' and b.v <> '')
select field, count(*) as pairs, count_if(case when d is not null then d > case when field = 'quality_score' then 1000000 else 250000 end else va <> vb end) as conflicts, round(avg(d) / 1000000, 9) as mean_abs_diff, round(max(d) / 1000000, 9) as max_abs_diff from pr group by all""",
    "update_agreement": f"""with {_BEHAVIOR}, pr as (select a.v as va, b.v as vb from bl a join bl b on a.uid = b.uid and a.ord < b.ord where a.uid <> '' and a.v <> '' and b.v <> ''),
u as (select count(*) as n, count_if(k > 1) as o from (select uid, count(*) as k from bl where uid <> '' group by all)), p as (select count(*) as t, count_if(va = vb) as a from pr),
c as (select sum(k * k)::double / pow(sum(k), 2) as pe from (select v, count(*) as k from (select va as v from pr union all select vb from pr) group by all))
select n as unique_label_uids, o as overlap_label_uids, t as behavior_pairwise_comparisons, round(a / nullif(t, 0), 9) as behavior_pairwise_agreement, round(case when t > 0 then case when pe >= 1 then case when a >= t then 1.0 else 0.0 end else (a / t - pe) / (1 - pe) end end, 9) as behavior_pairwise_kappa from u, p, c""",
    "power_cells": f"""with {_PLANNED}, cc as (select rq, comparison_id, family, benchmark, planned_matched_cells from planned where planned_matched_cells > 0 and rq <> 'unlearning_optional')
select *, round({_ZA} * sqrt(0.25 / planned_matched_cells), 9) as ci_half_width_p50, round({_ZA + _ZP} * sqrt(0.5 / planned_matched_cells), 9) as two_proportion_mde_nominal, case when planned_matched_cells < 100 then 'underpowered' when {_ZA + _ZP} * sqrt(0.5 / planned_matched_cells) <= 0.02 then 'fine' when {_ZA + _ZP} * sqrt(0.5 / planned_matched_cells) <= 0.05 then 'moderate' else 'coarse' end as design_resolution from cc""",
    "text_functions": f"""select ord, substr(sha1(coalesce(benchmark, '') || '␟' || coalesce(source_row_id, '') || '␟' || coalesce(target_behavior, '')), 1, 16) as hash,
  left(case when b = '' then 'item' else b end, 80) as slug, array_to_string(list_filter(ps, lambda x, i: list_position(ps, x) = i), '; ') as joined
from (select *, regexp_replace(regexp_replace(regexp_replace(lower({Q.strip("prompt_text")}), '[^a-z0-9가-힣._-]+', '_', 'g'), '_+', '_', 'g'), '^[_.]+|[_.]+$', '', 'g') as b, list_filter(list_transform(string_split(concat_ws(';', evaluator, source, evaluator), ';'), lambda x: {Q.strip("x")}), lambda x: x <> '') as ps from prompt_bank)""",
}
