"""Planning: generation prompts, jobs, label templates, shards, evaluator tasks and batches.

Orders are explicit (``ord``); numbers along an order come from partition sums,
so no task sorts a whole table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlens.functions import labels as L
from twinlens.functions.text import slugify, stable_hash, text
from twinlens.plans.prefix import numbered, with_previous
from twinlens.plans.skew import small
from twinlens.session import materialize

MODEL_KEYS = ("scheduler", "max_sequence_length", "lora_path", "lora_scale", "unet_file", "torch_dtype")


def generation_prompts(bank: DataFrame, include_gated: bool = False, benchmarks: Sequence[str] | None = None, limit_per_benchmark: int | None = None) -> DataFrame:
    """Image prompts, each once as first seen, with its evaluations in order; optionally the first N of each benchmark."""
    use = bank.filter(F.coalesce(~F.col("requires_valid_lineage"), F.lit(True)) | F.lit(include_gated))
    if benchmarks:
        use = use.filter(F.col("benchmark").isin(*benchmarks))
    if limit_per_benchmark is not None:
        first = use.groupBy("benchmark", "image_prompt_uid").agg(F.min("ord").alias("first_ord"))
        kept = numbered(first.filter("benchmark is not null"), ["first_ord"], ["benchmark"], label="firstn").filter(F.col("place") <= limit_per_benchmark)
        use = use.join(kept.select("benchmark", "image_prompt_uid"), ["benchmark", "image_prompt_uid"], "left_semi")
    head = F.min_by(F.struct("benchmark", "condition_type", "prompt_text", "requires_valid_lineage"), "ord")
    uids = F.transform(F.sort_array(F.collect_list(F.struct("ord", "eval_uid"))), lambda s: s["eval_uid"])
    return use.groupBy("image_prompt_uid").agg(F.min("ord").alias("first_ord"), head.alias("h"), uids.alias("eval_uids")).select("image_prompt_uid", "first_ord", "h.*", "eval_uids")


def generation_jobs(prompts: DataFrame, models: DataFrame, policy: DataFrame, default_seeds: Sequence[int], job_order: str = "model_major", output_root: str = "outputs/images", image_format: str = "png") -> DataFrame:
    """Models x prompts x seeds. models: model_no, model_id and any other columns, small enough to be broadcast (its size is the number of models studied).

    ord1..ord3 sort the jobs in the wanted order.
    """
    if job_order not in ("model_major", "prompt_major"):
        raise ValueError("job_order is model_major or prompt_major")
    planned = prompts.join(small(policy), ["benchmark", "condition_type"], "left").withColumn("seeds", F.coalesce("seeds", F.array(*map(F.lit, default_seeds))))
    rows = planned.crossJoin(F.broadcast(models)).select("*", F.posexplode("seeds").alias("seed_no", "seed"))
    major = ("model_no", "first_ord") if job_order == "model_major" else ("first_ord", "model_no")
    path = F.concat_ws("/", F.lit(output_root), "model_id", "benchmark", F.concat(slugify(F.col("image_prompt_uid")), F.lit("__seed"), F.col("seed").cast("string"), F.lit(f".{image_format}")))
    return rows.select(F.col(major[0]).alias("ord1"), F.col(major[1]).alias("ord2"), F.col("seed_no").alias("ord3"), stable_hash(F.col("model_id"), F.col("image_prompt_uid"), F.col("seed")).alias("job_id"), *models.columns[1:], "benchmark", "condition_type", "image_prompt_uid", "eval_uids", "seed", "prompt_text", path.alias("output_path"), "requires_valid_lineage")


def generation_kwargs(columns: Sequence[str] = MODEL_KEYS) -> Column:
    """The filled ones of a model's generation settings, as a map."""
    return F.map_filter(F.create_map(*[x for k in columns for x in (F.lit(k), F.col(k).cast("string"))]), lambda k, v: F.coalesce(v != "", F.lit(False)))


def summarize_jobs(jobs: DataFrame) -> DataFrame:
    """(model_id, benchmark, device, jobs): one grouping set per column."""
    from twinlens.operators.audits import histograms

    return histograms(jobs, "model_id", "benchmark", "device")


TEMPLATE = ("label_uid", "job_id", "eval_uid", "model_id", "benchmark", "axis_id", "axis_name", "condition_type", "complexity_level", "image_prompt_uid", "seed", "prompt_text", "image_path", "target_behavior", "candidate_behaviors")


def label_template(bank: DataFrame, jobs: DataFrame, include_gated: bool = False) -> DataFrame:
    """One blank label row per job and prompt record of its image prompt."""
    use = bank.filter(F.coalesce(~F.col("requires_valid_lineage"), F.lit(True)) | F.lit(include_gated))
    j = jobs.select(F.col("ord").alias("job_ord"), "job_id", "model_id", "image_prompt_uid", "seed", F.col("output_path").alias("image_path"))
    r = use.select(F.col("ord").alias("record_ord"), "eval_uid", "benchmark", "axis_id", "axis_name", "condition_type", "complexity_level", "image_prompt_uid", "prompt_text", "target_behavior", "candidate_behaviors", "evaluator")
    rows = j.join(r, "image_prompt_uid").withColumn("label_uid", stable_hash(F.col("job_id"), F.col("eval_uid")))
    blank = ("semantic_label", "semantic_label_confidence", "pass_score", "quality_score", "refusal", "unsafe", "memorization_score")
    return rows.select("job_ord", "record_ord", *TEMPLATE, *[F.lit("").alias(b) for b in blank], F.coalesce("evaluator", F.lit("")).alias("evaluator"), F.lit("").alias("notes"))


def assign_shards(jobs: DataFrame, jobs_per_shard: int = 10_000, respect_models: bool = False) -> DataFrame:
    """(ord, job_id, model_id, benchmark, device, shard): consecutive jobs, at most so many, optionally one model each."""
    if jobs_per_shard <= 0:
        raise ValueError("jobs_per_shard must be positive")
    rows = jobs.select("ord", "job_id", F.coalesce("model_id", F.lit("")).alias("model_id"), "benchmark", F.coalesce("device", F.lit("")).alias("device"))
    if not respect_models:
        return numbered(rows, ["ord"], label="shards").withColumn("shard", F.expr(f"(place - 1) div {jobs_per_shard}")).drop("place")
    from twinlens.plans.prefix import range_prefix

    steps = with_previous(rows, ["ord"], ["model_id"], "runs").withColumns({"turn": F.coalesce((F.col("model_id") != F.col("previous_model_id")).cast("bigint"), F.lit(0)), "all": F.lit(0)})
    runs = materialize(range_prefix(steps, ["all"], ["ord"], ["turn"], label="turns").withColumnRenamed("turn_upto", "run"), "runs")
    sizes = runs.groupBy("run").agg(F.count("*").alias("n"), F.min("place").alias("start"))
    # Shards before a run: one row per run, and runs are as few as model switches; summed like any order.
    before = range_prefix(sizes.withColumns({"shards": F.expr(f"(n + {jobs_per_shard} - 1) div {jobs_per_shard}"), "all": F.lit(0)}), ["all"], ["run"], ["shards"], label="runshards")
    offset = before.select("run", "start", (F.col("shards_upto") - F.col("shards")).alias("offset"))
    return runs.join(offset, "run").withColumn("shard", F.col("offset") + F.expr(f"(place - start) div {jobs_per_shard}")).select("ord", "job_id", "model_id", "benchmark", "device", "shard")


def shard_index(sharded: DataFrame) -> DataFrame:
    return sharded.groupBy("shard").agg(F.count("*").alias("jobs"), F.min_by("job_id", "ord").alias("first_job_id"), F.max_by("job_id", "ord").alias("last_job_id"), F.countDistinct("model_id").alias("models"), F.countDistinct("benchmark").alias("benchmarks"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, each shard's rows in order."""
    sharded.repartition("shard").sortWithinPartitions("shard", "ord").write.mode("overwrite").partitionBy("shard").json(path)


def evaluator_plan(rows: DataFrame) -> DataFrame:
    """Rows and required columns per benchmark, condition and kind of evaluator."""
    use = rows.select(F.coalesce("benchmark", F.lit("")).alias("benchmark"), F.coalesce("condition_type", F.lit("")).alias("condition_type"), L.evaluator_kind().alias("evaluator_kind"), L.required_signals().alias("req"))
    sums = use.groupBy("benchmark", "condition_type", "evaluator_kind", "req").agg(F.count("*").alias("n"))  # few distinct requirements
    return sums.groupBy("benchmark", "condition_type", "evaluator_kind").agg(F.sum("n").alias("rows"), F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list("req")))), ",").alias("required_columns"))


def task_rows(rows: DataFrame, mode: str = "needed", redact_safety: bool = True) -> DataFrame:
    """What an evaluator gets for each label row: kind, required columns, masked prompt and its true length."""
    base = rows.withColumn("evaluator_kind", L.evaluator_kind())
    kept = ("ord", "label_uid", "job_id", "eval_uid", "model_id", "benchmark", "condition_type", "axis_id", "axis_name", "image_path", "target_behavior")
    prompt = F.coalesce("prompt_text", F.lit(""))
    return base.select(*kept, "evaluator_kind", F.array_join(L.required_signals(), ",").alias("required_columns"), L.masked_prompt(prompt, F.col("evaluator_kind"), mode, redact_safety).alias("prompt_text"), F.char_length(prompt).alias("prompt_chars"))


def instruction(goals: Mapping[str, tuple[str, str]] | None = None) -> Column:
    """Instruction text of a task row; lines without content are left out. goals: kind -> (goal, decision rule)."""
    line = lambda head, c: F.when(text(c) != "", F.concat(F.lit(head), text(c), F.lit(".")))
    lines = [line("Evaluator kind: ", F.col("evaluator_kind")), line("Benchmark: ", F.col("benchmark")), line("Condition: ", F.col("condition_type")), line("Axis: ", F.col("axis_name"))]
    if goals:
        table = F.create_map(*[x for k, (g, r) in goals.items() for x in (F.lit(k), F.lit(f"Goal: {g}\nDecision rule: {r}"))])
        lines.append(F.try_element_at(table, F.col("evaluator_kind")))
    lines += [F.concat(F.lit("Required output columns: "), F.replace("required_columns", F.lit(","), F.lit(", ")), F.lit(".")), line("Target behavior: ", F.col("target_behavior")), F.when(F.col("prompt_text") == L.REDACTED, "The prompt is withheld; judge the image and its category only.")]
    return F.concat_ws("\n", *lines)


def select_rows(rows: DataFrame, kinds: Sequence[str] = (), benchmarks: Sequence[str] = (), conditions: Sequence[str] = (), models: Sequence[str] = ()) -> DataFrame:
    use = rows.withColumn("evaluator_kind", L.evaluator_kind())
    for column, names in (("evaluator_kind", kinds), ("benchmark", benchmarks), ("condition_type", conditions), ("model_id", models)):
        if names:
            use = use.filter(F.col(column).isin(*names))
    return use


def evaluator_batches(rows: DataFrame, batch_size: int = 5000, split: Sequence[str] = ("evaluator_kind", "benchmark", "condition_type")) -> DataFrame:
    """Batch index: batches of consecutive rows of a group, numbered from 0 in the order in which they begin."""
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    keys = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in split]
    placed = numbered(select_rows(rows).select("ord", *keys), ["ord"], list(split), label="batches").withColumn("batch_in_group", F.expr(f"(place - 1) div {batch_size}"))
    index = placed.groupBy(*split, "batch_in_group").agg(F.count("*").alias("rows"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"))
    # One row per batch: as many as rows / batch_size.
    return numbered(index, ["first_ord"], name="no", label="batchno").withColumn("batch_no", F.col("no") - 1).select("batch_no", *split, "batch_in_group", "rows", "first_ord", "last_ord")


def export_batch(rows: DataFrame, limit: int, start: int = 0, **filters: Sequence[str]) -> DataFrame:
    """The first rows, from a start order on, that pass the filters."""
    return task_rows(select_rows(rows, **filters).filter(F.col("ord") >= start)).orderBy("ord").limit(limit)


def preflight_prompts(bank: DataFrame, per_condition: int = 2) -> DataFrame:
    """The first image prompts of every benchmark and condition."""
    key = [F.coalesce("benchmark", F.lit("")).alias("benchmark"), F.coalesce("condition_type", F.lit("")).alias("condition_type")]
    first = bank.filter(F.coalesce(~F.col("requires_valid_lineage"), F.lit(True))).groupBy(*key, "image_prompt_uid").agg(F.min("ord").alias("first_ord"))
    return numbered(first, ["first_ord"], ["benchmark", "condition_type"], label="preflight").filter(F.col("place") <= per_condition)


def preflight_jobs(jobs: DataFrame, selected: DataFrame, seeds: Sequence[int]) -> DataFrame:
    return jobs.filter(F.col("seed").isin(*seeds)).join(selected.select("image_prompt_uid").distinct(), "image_prompt_uid", "left_semi")


def benchmark_summary(bank: DataFrame, policy: DataFrame, model_count: int) -> DataFrame:
    """Records, distinct image prompts and axes, and the jobs and label rows they will need, per benchmark. A condition without seeds counts one."""
    per = bank.groupBy("benchmark", "condition_type").agg(F.count("*").alias("records"), F.countDistinct("image_prompt_uid").alias("images"))
    seeds = F.broadcast(policy.select("benchmark", "condition_type", F.size("seeds").alias("seeds")))
    est = per.join(seeds, ["benchmark", "condition_type"], "left").withColumn("seeds", F.coalesce("seeds", F.lit(1)))
    sums = est.groupBy("benchmark").agg(F.sum("records").alias("records"), F.sum(F.col("images") * F.col("seeds") * model_count).alias("generation_jobs"), F.sum(F.col("records") * F.col("seeds") * model_count).alias("label_rows"), F.array_join(F.array_sort(F.collect_set(F.coalesce("condition_type", F.lit("")))), ";").alias("conditions"))
    distinct = bank.groupBy("benchmark").agg(F.countDistinct("image_prompt_uid").alias("image_prompts"), F.countDistinct("axis_id").alias("axes"))
    return sums.join(distinct, "benchmark")


def axis_summary(bank: DataFrame) -> DataFrame:
    keys = [F.coalesce(c, F.lit("")).alias(c) for c in ("benchmark", "condition_type", "axis_id")]
    return bank.groupBy(*keys).agg(F.count("*").alias("records"), F.countDistinct("image_prompt_uid").alias("image_prompts"), F.array_join(F.array_sort(F.collect_set(F.coalesce("complexity_level", F.lit("")))), ";").alias("complexity_levels"))


def manifest_preview(jobs: DataFrame, n: int = 5) -> DataFrame:
    """The first jobs with their prompts withheld."""
    return jobs.orderBy("ord").limit(n).withColumns({"prompt_chars": F.char_length("prompt_text"), "prompt_text": F.lit(L.REDACTED)})


def job_range(jobs: DataFrame, start: int = 0, end: int | None = None, limit: int | None = None) -> DataFrame:
    """Jobs of an index range [start, end), at most so many."""
    use = jobs.filter(F.col("ord") >= start)
    use = use if end is None else use.filter(F.col("ord") < end)
    return use if limit is None else use.orderBy("ord").limit(limit)


def shard_progress(shards: DataFrame, events: DataFrame) -> DataFrame:
    """Per shard its jobs, successes, failures and state. events: shard, job_id, status."""
    ok = F.col("status") == "success"
    seen = events.groupBy("shard", "job_id").agg(F.bool_or(ok).alias("ok")).groupBy("shard").agg(F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"))
    out = shards.select("shard", "jobs").join(seen, "shard", "left").select("shard", "jobs", F.coalesce("succeeded", F.lit(0)).alias("succeeded"), F.coalesce("failed", F.lit(0)).alias("failed"))
    state = F.when(F.col("succeeded") >= F.col("jobs"), "done_by_logs").when(F.col("succeeded") + F.col("failed") > 0, "partial").otherwise("pending")
    return out.withColumn("status", state)


def queue_shards(progress: DataFrame, statuses: Sequence[str] = ("pending", "partial"), gpus: Sequence[str] = ("0",), most: int = 0) -> DataFrame:
    """The next shards to run, dealt round to the devices; 0 takes all."""
    gpus = [g.removeprefix("cuda:") for g in gpus]
    if not gpus or not all(gpus):
        raise ValueError("no device named")
    use = progress.filter(F.col("status").isin(*statuses))
    use = use.orderBy("shard").limit(most) if most else use
    place = F.row_number().over(Window.orderBy("shard"))  # one row per shard
    return use.withColumn("queue_no", place).withColumn("device", F.concat(F.lit("cuda:"), F.element_at(F.array(*map(F.lit, gpus)), F.pmod(F.col("queue_no") - 1, F.lit(len(gpus))) + 1)))
