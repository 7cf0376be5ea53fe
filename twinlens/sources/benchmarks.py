"""Prompt records from published benchmark layouts.

Every loader is a scan, an explode and one projection; ``_record`` makes the
canonical 17 columns and both keys. Rows are numbered in file order.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlens.functions import labels as L
from twinlens.functions.text import parse_literal_list, stable_hash, strip
from twinlens.plans.prefix import numbered
from twinlens.sources.files import placed, read_csv

COLUMNS = (
    "eval_uid", "image_prompt_uid", "benchmark", "source", "source_path", "source_row_id", "prompt_text", "axis_id", "axis_name", "condition_type", "analysis_layers", "complexity_level", "target_behavior",
    "candidate_behaviors", "evaluator", "requires_valid_lineage", "metadata",
)
_EMPTY = F.array
Config = Mapping[str, Any]


def _text(x: Column | str) -> Column:
    return F.lit(x) if isinstance(x, str) else x.cast("string")


def _record(df: DataFrame, benchmark: str, path: Column | str, row: Column, prompt: Column, axis_id: Column | str, axis_name: Column | str, condition: Column | str, complexity: Column | str, source: Column | str, evaluator: str, layers: Sequence[str], order: Sequence[Column], image: Column | None = None, target: Column | str = "", candidates: Column | None = None, gated: bool = False, **metadata: Column | str) -> DataFrame:
    """The canonical projection. A prompt that is empty stops the read. image: what tells image prompts of one file apart, the row unless given."""
    row, path, target = _text(row), _text(path), F.coalesce(_text(target), F.lit(""))
    words = strip(prompt)
    checked = F.when(F.coalesce(words, F.lit("")) == "", F.raise_error(F.concat(F.lit(f"empty prompt in {benchmark}: "), path))).otherwise(words)
    key = _text(image) if image is not None else row
    uid = lambda *parts: F.concat(F.lit(f"{benchmark}:"), stable_hash(*parts))
    base = df.select(
        *[c.alias(f"_o{k}") for k, c in enumerate(order)], row.alias("source_row_id"), path.alias("source_path"), checked.alias("prompt_text"), _text(axis_id).alias("axis_id"), _text(axis_name).alias("axis_name"), _text(condition).alias("condition_type"), target.alias("target_behavior"), key.alias("_image"),
        F.coalesce(candidates, F.array().cast("array<string>")).alias("candidate_behaviors") if candidates is not None else F.array().cast("array<string>").alias("candidate_behaviors"), _text(complexity).alias("complexity_level"), _text(source).alias("source"),
        F.to_json(F.struct(*[_text(metadata[k]).alias(k) for k in sorted(metadata)])).alias("metadata"),
    )
    c = F.col
    out = base.withColumns(
        {
            "benchmark": F.lit(benchmark), "image_prompt_uid": uid(c("source_path"), c("_image"), c("prompt_text")), "eval_uid": uid(c("source_path"), c("source_row_id"), c("axis_id"), c("condition_type"), c("target_behavior")),
            "analysis_layers": F.array(*map(F.lit, layers)) if layers else F.array().cast("array<string>"), "evaluator": F.lit(evaluator), "requires_valid_lineage": F.lit(gated),
        }
    )
    return out.select(*COLUMNS, *[f"_o{k}" for k in range(len(order))])


def _indexed(df: DataFrame) -> DataFrame:
    """A file scan with ``_name`` and ``_idx``, the row's number in its file from 0."""
    scan = placed(df).withColumn("_name", F.element_at(F.split("_file", "/"), -1))
    return numbered(scan, ["_block", "_row"], ["_file"], name="_idx", label="rows").withColumn("_idx", F.col("_idx") - 1)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines of text files, numbered without the blank ones."""
    return _indexed(spark.read.text(path).filter(strip(F.col("value")) != ""))


def _json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return _indexed(spark.read.schema(schema).option("mode", "FAILFAST").json(path))


def _documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole JSON files, one row each: _name and the parsed document d. Benchmark documents are a few MB at most."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("_name"), F.from_json("value", schema, {"mode": "FAILFAST"}).alias("d"))


def _join(*parts: Column | str) -> Column:
    return F.concat(*[_text(p) for p in parts])


def load_grade(spark: SparkSession, root: str, cfg: Config) -> DataFrame:
    path = f"{root}/GRADE/datasets/grade_dataset.csv"
    c, rows = F.col, _indexed(read_csv(spark, path))
    concept, attribute = strip(c("concept")), strip(c("attribute"))
    return _record(
        rows, "grade", path, c("_idx"), c("prompt"), _join("grade/", c("concept_id"), "/", c("attribute_id")), _join(concept, ":", attribute), "broad", "atomic", "official_grade_dataset", "GRADE VQA attribute extraction", cfg["analysis_layers"], [c("_idx")],
        image=c("prompt_id"), candidates=parse_literal_list(c("attribute_values")), concept_id=c("concept_id"), concept=concept, prompt_id=c("prompt_id"), attribute_id=c("attribute_id"), attribute=attribute,
    )


def load_dimcim(spark: SparkSession, root: str, cfg: Config) -> DataFrame:
    base, c = f"{root}/DIMCIM/COCO-DIMCIM", F.col
    dense = _documents(spark, f"{base}/dense_prompts/*_dense_prompts.json", "concept string, coarse_dense_prompts array<struct<coarse_prompt:string,coco_seed_caption:string,dense_prompts:array<struct<attribute_type:string,attribute:string,dense_prompt:string>>>>")
    dense = dense.select("_name", "d.concept", F.posexplode("d.coarse_dense_prompts").alias("i", "r"))
    attributes = _documents(spark, f"{base}/seed_captions_attributes/*_seed_captions_attributes.json", "attributes map<string,array<string>>").select(F.regexp_replace("_name", "_seed_captions_attributes.json$", "").alias("concept"), c("d.attributes").alias("attributes"))
    rows = dense.join(attributes, "concept", "left")
    path, caption = _join(f"{base}/dense_prompts/", c("_name")), F.coalesce("r.coco_seed_caption", F.lit(""))
    broad = rows.select("*", F.posexplode(F.array_sort(F.map_entries("attributes"))).alias("j", "e")).withColumns({"kind": c("e.key"), "values": c("e.value")})
    axis = lambda kind: (_join("dimcim/", c("concept"), "/", kind), _join(c("concept"), ":", kind))
    a = _record(
        broad, "dimcim", path, _join(c("i"), ":broad:", c("kind")), c("r.coarse_prompt"), *axis(c("kind")), "broad", "atomic", "official_coco_dimcim_coarse_prompt", "DIM VQAScore", cfg["analysis_layers"], [c("_name"), c("i"), F.lit(0), c("j")],
        image=_join(c("i"), ":broad"), candidates=c("values"), concept=c("concept"), attribute_type=c("kind"), coco_seed_caption=caption,
    )
    explicit = rows.select("*", F.posexplode("r.dense_prompts").alias("j", "e"))
    b = _record(
        explicit, "dimcim", path, _join(c("i"), ":explicit:", c("j")), c("e.dense_prompt"), *axis(c("e.attribute_type")), "explicit", "atomic", "official_coco_dimcim_dense_prompt", "CIM VQAScore", cfg["analysis_layers"], [c("_name"), c("i"), F.lit(1), c("j")],
        image=_join(c("i"), ":explicit:", c("j")), target=c("e.attribute"), candidates=F.try_element_at("attributes", c("e.attribute_type")), concept=c("concept"), attribute_type=c("e.attribute_type"), attribute=c("e.attribute"), coco_seed_caption=caption,
    )
    return a.unionByName(b)


def load_geneval2(spark: SparkSession, root: str, cfg: Config) -> DataFrame:
    path, c = f"{root}/GenEval2/geneval2_data.jsonl", F.col
    rows = _json_lines(spark, path, "prompt string, atom_count int, vqa_list array<array<string>>, skills array<string>")
    n = F.least(F.size("vqa_list"), F.size("skills"))  # the longer list's rest has no partner
    rows = rows.select("*", F.posexplode(F.slice(F.arrays_zip("vqa_list", "skills"), F.lit(1), F.greatest(n, F.lit(0)))).alias("j", "e")).withColumns({"question": F.get("e.vqa_list", F.lit(0)), "answer": F.get("e.vqa_list", F.lit(1)), "skill": c("e.skills")})
    return _record(
        rows, "geneval2", path, _join(c("_idx"), ":atom:", c("j")), c("prompt"), _join("geneval2/", c("skill")), c("skill"), "benchmark_native", L.complexity_from_atoms(c("atom_count")), "official_geneval2_atom", "Soft-TIFA VQA", cfg["analysis_layers"], [c("_idx"), c("j")],
        image=c("_idx"), target=c("answer"), prompt_index=c("_idx"), atom_index=c("j"), atom_count=c("atom_count"), question=c("question"), answer=c("answer"), skill=c("skill"),
    )


# Axis and complexity of each prompt file.
COMPOSITION_FILES = {
    "color": ("color_binding", "atomic"), "shape": ("shape_binding", "atomic"), "texture": ("texture_binding", "atomic"), "spatial": ("2d_spatial", "relational"), "3d_spatial": ("3d_spatial", "relational"),
    "non_spatial": ("non_spatial_relation", "relational"), "numeracy": ("numeracy", "relational"), "complex": ("complex_composition", "compositional"), "new_objects": ("new_object_generalization", "atomic"),
}


def load_t2i_compbench(spark: SparkSession, root: str, cfg: Config) -> DataFrame:
    base, c = f"{root}/T2I-CompBench/examples/dataset", F.col
    parts = []
    for k, name in enumerate(cfg["prompt_files"]):
        stem = Path(name).stem
        axis, complexity = COMPOSITION_FILES.get(stem, (stem, "compositional"))
        rows = _lines(spark, f"{base}/{name}")
        parts.append(_record(rows, "t2i_compbench", f"{base}/{name}", c("_idx"), c("value"), f"t2i_compbench/{axis}", axis, "compositional_native", complexity, "official_t2i_compbench_prompt", "T2I-CompBench++ native metrics", cfg["analysis_layers"], [F.lit(k), c("_idx")], file=name, prompt_index=c("_idx")))
    return _union(parts)


def load_worldgenbench(spark: SparkSession, root: str, cfg: Config) -> DataFrame:
    c, parts = F.col, []
    for k, domain in enumerate(("humanities", "nature")):
        path = f"{root}/WorldGenBench/{domain}_en.json"
        rows = _documents(spark, path, "array<struct<class:string,prompt_en:string,checklist:array<string>>>").select(F.posexplode("d").alias("i", "r")).select("i", "r.*", F.posexplode("r.checklist").alias("j", "item"))
        kind = F.coalesce("class", F.lit(domain))
        parts.append(
            _record(
                rows, "worldgenbench", path, _join(c("i"), ":checklist:", c("j")), c("prompt_en"), _join(f"worldgenbench/{domain}/", kind), _join(f"{domain}:", kind), "implicit_knowledge", "implicit", "official_worldgenbench_checklist", "Knowledge Checklist VLM judge", cfg["analysis_layers"],
                [F.lit(k), c("i"), c("j")], image=c("i"), target="checklist_satisfied", domain=domain, checklist_index=c("j"), checklist_item=c("item"), **{"class": kind},
            )
        )
    return _union(parts)


def load_t2i_factualbench(spark: SparkSession, root: str, cfg: Config) -> DataFrame:
    c, parts = F.col, []
    for variant, folder, condition in (("native", "", "knowledge_native"), ("text_injection", "text_injection/", "knowledge_injected")):
        for level in ("SKCM", "SKCI", "MKCC"):
            path = f"{root}/T2I-FactualBench/data/prompts/{folder}{level}/prompt.jsonl"
            rows = _json_lines(spark, path, "sentence string, concept string, type string, task string, reference_image string, addition string")
            kind, blank = F.coalesce("type", F.lit("unknown")), lambda n: F.coalesce(c(n), F.lit(""))
            parts.append(
                _record(
                    rows, "t2i_factualbench", path, c("_idx"), c("sentence"), _join(f"t2i_factualbench/{level}/", kind), _join(f"{level}:", kind), condition, L.factual_complexity(F.lit(level)), f"official_t2i_factualbench_{variant}", "T2I-FactualBench multi-round VQA", cfg["analysis_layers"],
                    [F.lit(len(parts)), c("_idx")], target=blank("concept"), level=level, type=kind, knowledge_variant=variant, **{n: blank(n) for n in ("concept", "task", "reference_image", "addition")},
                )
            )
    return _union(parts)


def load_overt(spark: SparkSession, root: str, cfg: Config) -> DataFrame:
    c, full, unsafe = F.col, f"{root}/OVERT/data/OVERT_full.csv", f"{root}/OVERT/data/OVERT_unsafe.csv"

    def kind_of(df: DataFrame) -> Column:
        return F.coalesce("generation_type", F.lit("")) if "generation_type" in df.columns else F.lit("")

    category = strip(c("category"))
    rows = _indexed(read_csv(spark, full))
    one = _record(rows, "overt", full, c("_idx"), c("image_prompt"), _join("overt/", category), category, "benign_overrefusal", "safety_benign", "official_overt_full_benign", "refusal detector + safety VLM", cfg["analysis_layers"], [F.lit(0), c("_idx"), F.lit(0)], target="non_refusal", category=category, generation_type=kind_of(rows))
    side = lambda *x: F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(n) for n, v in zip(("condition", "prompt", "aim", "level"), x, strict=True)])
    raw = _indexed(read_csv(spark, unsafe))
    two = raw.select("*", F.posexplode(F.array(side("unsafe_safety", c("unsafe_image_prompt"), "refusal_or_safe_response", "safety_unsafe"), side("safety_counterfactual_benign", c("benign_image_prompt"), "non_refusal", "safety_benign"))).alias("j", "s"))
    pairs = _record(two, "overt", unsafe, _join(c("_idx"), ":", c("s.condition")), c("s.prompt"), _join("overt/", category), category, c("s.condition"), c("s.level"), "official_overt_unsafe_pair", "refusal detector + safety VLM", cfg["analysis_layers"], [F.lit(1), c("_idx"), c("j")], target=c("s.aim"), category=category, generation_type=kind_of(raw))
    return one.unionByName(pairs)


def load_t2i_riskyprompt(spark: SparkSession, root: str, cfg: Config) -> DataFrame:
    path, c = f"{root}/T2I-RiskyPrompt/T2I-RiskyPrompt.json", F.col
    rows = _documents(spark, path, "map<string,struct<prompt:string,label:map<string,string>>>").select(F.posexplode("d").alias("i", "row_id", "r")).select("i", "row_id", "r.prompt", F.posexplode("r.label").alias("j", "risk", "reasons"))
    primary = F.substring_index("risk", "--", 1)
    sub = F.when(F.col("risk").contains("--"), F.expr("substring(risk, instr(risk, '--') + 2)")).otherwise("")
    return _record(
        rows, "t2i_riskyprompt", path, c("row_id"), c("prompt"), _join("t2i_riskyprompt/", primary, "/", sub), _join(primary, ":", sub), "risky_safety", "safety_unsafe", "official_t2i_riskyprompt", "reason-driven risky image detector", cfg["analysis_layers"], [c("i"), c("j")],
        target="risk_not_realized", primary_category=primary, subcategory=sub, risk_reasons=c("reasons"),
    )


def load_t2isafety(spark: SparkSession, root: str, cfg: Config) -> DataFrame:
    c, fair, safety = F.col, f"{root}/T2ISafety_eval/fairness.jsonl", f"{root}/T2ISafety_eval/safety.jsonl"
    a = _record(
        _json_lines(spark, fair, "prompt string, category string"), "t2isafety", fair, c("_idx"), c("prompt"), "t2isafety/fairness/demographic_distribution", "fairness_demographic_distribution", "social_bias_default", "bias", "official_t2isafety_fairness_eval", "ImageGuard + demographic classifier", cfg["analysis_layers"],
        [F.lit(0), c("_idx")], domain="fairness",
    )
    category = F.coalesce("category", F.lit("unknown"))
    b = _record(
        _json_lines(spark, safety, "prompt string, category string"), "t2isafety", safety, c("_idx"), c("prompt"), _join("t2isafety/safety/", category), category, "safety_native", "safety_unsafe", "official_t2isafety_safety_eval", "ImageGuard", cfg["analysis_layers"], [F.lit(1), c("_idx")],
        target="safe_or_refused", domain="safety", category=category,
    )
    return a.unionByName(b)


def load_membench(spark: SparkSession, root: str, cfg: Config) -> DataFrame:
    c, path, folder = F.col, f"{root}/MemBench/SD1_final.csv", f"{root}/MemBench/MemAttn/prompt"
    rows = _indexed(read_csv(spark, path))
    blank = lambda n: F.coalesce(c(n), F.lit("")) if n in rows.columns else F.lit("")
    goal = "not_memorized_reference"
    a = _record(rows, "membench", path, c("_idx"), c("prompt"), "membench/trigger_replication", "trigger_replication", "memorization_trigger", "memorization", "official_membench_trigger_prompts", "SSCD copy-detection similarity", cfg["analysis_layers"], [F.lit(0), F.lit(""), c("_idx")], target=goal, urls=blank("urls"), row_id=F.coalesce(c("_c0") if "_c0" in rows.columns else F.lit(None), c("_idx").cast("string")))
    lines = _lines(spark, f"{folder}/*.txt").withColumn("stem", F.regexp_replace("_name", r"\.txt$", ""))
    condition = F.when(c("stem").contains("mem") & ~c("stem").contains("nomem"), "memorization_trigger").otherwise("memorization_control")
    b = _record(lines, "membench", _join(f"{folder}/", c("_name")), c("_idx"), c("value"), _join("membench/", c("stem")), c("stem"), condition, "memorization", "official_memattn_prompt", "MemAttn + SSCD", cfg["analysis_layers"], [F.lit(1), c("_name"), c("_idx")], target=goal, prompt_file=c("_name"))
    return a.unionByName(b)


def sniffed_prompts(text: str) -> list[str]:
    """Prompts of a CSV of unknown dialect: the first column whose name holds 'prompt', else the first column."""
    try:
        dialect: Any = csv.Sniffer().sniff(text[:4096])
    except csv.Error:
        dialect = csv.excel
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), dialect) if r]
    at = next((k for k, name in enumerate(rows[0]) if "prompt" in name.lower()), None) if rows else None
    if at is None:
        return [t for r in rows if (t := r[0].strip()) and t.lower() != "prompt"]
    return [t for r in rows[1:] if len(r) > at and (t := r[at].strip())]


def text_leaves(data: Any) -> list[str]:
    """All non-blank texts in a JSON value, in document order."""
    stack, out = [data], []
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out += [x] if x.strip() else []
        elif isinstance(x, (list, dict)):
            stack.extend(reversed(list(x.values()) if isinstance(x, dict) else x))
    return out


def concept_prompts(data: Any) -> list[tuple[str, str]]:
    """(concept, prompt) of a list of {concept: prompt or prompts}."""
    items = [kv for x in data if isinstance(x, dict) for kv in x.items()] if isinstance(data, list) else []
    return [(str(k), str(p)) for k, v in items for p in ([v] if isinstance(v, str) else v if isinstance(v, list) else []) if isinstance(v, str) or str(p).strip()]


def _parsed_files(spark: SparkSession, path: str, parse: Callable[[str], Sequence[tuple[str, str]]]) -> DataFrame:
    """(_name, _folder, _idx, concept, prompt) of whole small files parsed in Python, a file a row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(path, k, *pair) for path, text in zip(frame["path"], frame["value"], strict=True) for k, pair in enumerate(parse(text))]
            yield pd.DataFrame(rows, columns=["path", "_idx", "concept", "prompt"])

    whole = spark.read.text(path, wholetext=True).select(F.url_decode("_metadata.file_path").alias("path"), "value")
    parts = F.split("path", "/")
    return whole.mapInPandas(run, "path string, _idx int, concept string, prompt string").select(F.element_at(parts, -1).alias("_name"), F.element_at(parts, -2).alias("_folder"), "_idx", "concept", "prompt")


# Condition and axis of each task folder; condition and metric of each prompt file.
HUB_TASKS = {"target_image": ("unlearning_target", "target_proportion"), "pinpoint_ness": ("unlearning_retain", "pinpoint_ness"), "attack_robustness": ("unlearning_robustness", "attack_robustness"), "multilingual_robustness": ("unlearning_robustness", "multilingual_robustness")}
EMMA_FILES = {
    "1_name": ("unlearning_explicit", "erasing_name"), "2_prefix": ("unlearning_explicit", "erasing_prefix"), "3_variant": ("unlearning_implicit", "erasing_variant"), "4_short": ("unlearning_implicit", "erasing_short"), "5_long": ("unlearning_implicit", "erasing_long"),
    "6_random": ("unlearning_retain", "retain_random"), "7_hard": ("unlearning_retain", "retain_hard"),
}


def load_hub(spark: SparkSession, root: str, cfg: Config) -> DataFrame:
    c, base, parts = F.col, f"{root}/HUB/prompts", []
    for k, (task, (condition, axis)) in enumerate(HUB_TASKS.items()):
        rows = _parsed_files(spark, f"{base}/{task}/[!.]*.csv", lambda t: [("", p) for p in sniffed_prompts(t)])
        target = F.replace(F.regexp_replace("_name", r"\.csv$", ""), F.lit("_"), F.lit(" "))
        parts.append(_record(rows, "hub", _join(f"{base}/{task}/", c("_name")), c("_idx"), c("prompt"), _join(f"hub/{axis}/", target), _join(f"{axis}:", target), condition, "unlearning", "official_hub_prompt", "HUB task-specific detector", cfg["analysis_layers"], [F.lit(k), c("_name"), c("_idx")], target=target, gated=True, task=task))
        parts[-1] = parts[-1].withColumn("metadata", F.to_json(F.struct(c("target_behavior").alias("target"), F.lit(task).alias("task"))))
    rows = _parsed_files(spark, f"{base}/selective_alignment/*.json", lambda t: [("", p) for p in text_leaves(json.loads(t))])
    target = F.regexp_replace("_name", r"\.json$", "")
    parts.append(_record(rows, "hub", _join(f"{base}/selective_alignment/", c("_name")), c("_idx"), c("prompt"), _join("hub/selective_alignment/", target), _join("selective_alignment:", target), "unlearning_retain", "unlearning", "official_hub_selective_alignment_prompt", "HUB selective-alignment detector", cfg["analysis_layers"], [F.lit(9), c("_name"), c("_idx")], target=target, gated=True, task="selective_alignment"))
    return _union(parts)


def load_emma(spark: SparkSession, root: str, cfg: Config) -> DataFrame:
    c, base = F.col, f"{root}/EMMA/prompts"
    rows = _parsed_files(spark, f"{base}/*/*.json", lambda t: concept_prompts(json.loads(t))).withColumn("stem", F.regexp_replace("_name", r"\.json$", ""))
    table = lambda at: F.create_map(*[x for k, v in EMMA_FILES.items() for x in (F.lit(k), F.lit(v[at]))])
    rows = rows.withColumns({"condition": F.coalesce(F.try_element_at(table(0), c("stem")), F.lit("unlearning_implicit")), "metric": F.coalesce(F.try_element_at(table(1), c("stem")), c("stem"))})
    return _record(
        rows, "emma", _join(f"{base}/", c("_folder"), "/", c("_name")), _join(c("concept"), ":", stable_hash(c("prompt"), length=8)), c("prompt"), _join("emma/", c("_folder"), "/", c("metric"), "/", c("concept")), _join(c("_folder"), ":", c("metric"), ":", c("concept")), c("condition"), "unlearning", "official_emma_prompt",
        "EMMA domain-specific classifier", cfg["analysis_layers"], [c("_folder"), c("_name"), c("_idx")], target=c("concept"), gated=True, domain=c("_folder"), metric=c("metric"), concept=c("concept"),
    )


LOADERS: dict[str, Callable[[SparkSession, str, Config], DataFrame]] = {
    "grade": load_grade, "dimcim": load_dimcim, "geneval2": load_geneval2, "t2i_compbench": load_t2i_compbench, "worldgenbench": load_worldgenbench, "t2i_factualbench": load_t2i_factualbench, "overt": load_overt, "t2i_riskyprompt": load_t2i_riskyprompt, "t2isafety": load_t2isafety, "membench": load_membench,
    "hub": load_hub, "emma": load_emma,
}


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def prompt_records(spark: SparkSession, config: Config, root: str, benchmarks: Sequence[str] | None = None, include_gated: bool = False) -> DataFrame:
    """Records of the chosen benchmarks (by default the enabled ones) with ``ord``, their place in loader and file order."""
    plan = config["benchmark_plan"]
    wanted = list(benchmarks) if benchmarks else [b for b in LOADERS if b in plan and plan[b].get("enabled", True) is not False]
    unknown = [b for b in wanted if b not in LOADERS or b not in plan]
    if unknown:
        raise KeyError(f"no loader or plan for {unknown}")
    parts = []
    for no, name in enumerate(LOADERS):
        if name not in wanted or (plan[name].get("requires_valid_lineage") and not include_gated):
            continue
        rows = LOADERS[name](spark, root, {"analysis_layers": [], **plan[name]})
        order = sorted(c for c in rows.columns if c.startswith("_o"))
        # One sortable text per row stands for the loader's order columns; numbers are padded.
        key = F.concat_ws("\x01", *[F.lpad(F.col(c).cast("string"), 12, "0") if t in ("int", "bigint") else F.col(c) for c, t in rows.select(*order).dtypes])
        parts.append(rows.select(*COLUMNS, F.lit(no).alias("_loader"), key.alias("_order")))
    if not parts:
        raise ValueError("no benchmark chosen")
    return numbered(_union(parts), ["_loader", "_order"], name="ord", label="bank").select("ord", *COLUMNS)
