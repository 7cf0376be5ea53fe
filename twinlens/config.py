"""Study configuration: driver-side document and the small tables made from it."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, replace
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlens.functions.labels import ROLES, RQS, Roles

REQUIRED = ("model_pairs", "benchmark_plan", "seed_sets")
PAIR_SCHEMA = "comparison_id string, family string, priority string, teacher_model_id string, student_model_id string"
#: Seed set of a condition that names none.
DEFAULT_SEEDS = "matched_4"


class ConfigError(ValueError):
    """A configuration that cannot be used, with every reason found."""


def load_config(path: str | Path) -> dict[str, Any]:
    config = json.loads(Path(path).read_text(encoding="utf-8"))
    check_config(config)
    return config


def check_config(config: Mapping[str, Any]) -> None:
    """All missing keys and dangling seed sets at once, before any work."""
    wrong = [f"missing key {k}" for k in REQUIRED if k not in config]
    if not wrong:
        sets = config["seed_sets"]
        wrong = [f"{bench}/{cond}: unknown seed set {name}" for bench, plan in config["benchmark_plan"].items() for cond, name in plan.get("seed_keys", {}).items() if name not in sets]
    if wrong:
        raise ConfigError("; ".join(wrong))


def pairs_table(spark: SparkSession, config: Mapping[str, Any]) -> DataFrame:
    rows = [(p["comparison_id"], p["family"], p.get("priority", "primary"), p["teacher"]["model_id"], p["student"]["model_id"]) for p in config["model_pairs"]]
    return spark.createDataFrame(rows, PAIR_SCHEMA)


def selected_pairs(pairs: DataFrame, scope: str = "primary") -> DataFrame:
    """Pairs of a scope: 'all', or those of one priority."""
    chosen = pairs if scope == "all" else pairs.filter(F.col("priority") == scope)
    return chosen.select("comparison_id", "family", "teacher_model_id", "student_model_id")


def pair_models(pairs: DataFrame) -> DataFrame:
    """(comparison_id, family, role, model_id): two rows per pair."""
    return pairs.select("comparison_id", "family", F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"{r}_model_id").alias("model_id")) for r in ("teacher", "student")])).alias("m")).select("comparison_id", "family", "m.*")


def pair_sides(pairs: DataFrame) -> DataFrame:
    """(comparison_id, family, model_id, is_teacher): the rows by which tables meet the pairs of their models in an equi-join. A model paired with itself is a teacher."""
    sides = F.filter(F.array(*[F.struct(F.col(f"{r}_model_id").alias("model_id"), F.lit(r == "teacher").alias("is_teacher")) for r in ("teacher", "student")]), lambda s: s["is_teacher"] | ~F.col("teacher_model_id").eqNullSafe(F.col("student_model_id")))
    return pairs.select("comparison_id", "family", F.explode(sides).alias("m")).select("comparison_id", "family", "m.*")


def unique_models(pairs: DataFrame) -> DataFrame:
    """Every model of the pairs once."""
    return pair_models(pairs).select("model_id").distinct()


def benchmark_config(config: Mapping[str, Any], benchmark: str) -> Mapping[str, Any]:
    if benchmark not in config["benchmark_plan"]:
        raise KeyError(f"benchmark {benchmark!r} is not planned")
    return config["benchmark_plan"][benchmark]


def seed_values(config: Mapping[str, Any], name: str) -> list[int]:
    if name not in config["seed_sets"]:
        raise KeyError(f"seed set {name!r} is not defined")
    return [int(s) for s in config["seed_sets"][name]]


def seeds_for_condition(config: Mapping[str, Any], benchmark: str, condition: str) -> list[int]:
    return seed_values(config, benchmark_config(config, benchmark).get("seed_keys", {}).get(condition, DEFAULT_SEEDS))


def seed_policy(spark: SparkSession, config: Mapping[str, Any]) -> DataFrame:
    """(benchmark, condition_type, seeds) as planned; conditions not listed use the default set."""
    rows = [(b, c, seed_values(config, n)) for b, plan in config["benchmark_plan"].items() for c, n in plan.get("seed_keys", {}).items()]
    schema = T.StructType([T.StructField("benchmark", T.StringType()), T.StructField("condition_type", T.StringType()), T.StructField("seeds", T.ArrayType(T.IntegerType()))])
    return spark.createDataFrame(rows, schema)


def expected_benchmarks(config: Mapping[str, Any], include_gated: bool = False) -> list[str]:
    """Enabled benchmarks, gated ones only on request."""
    return sorted(b for b, plan in config["benchmark_plan"].items() if plan.get("enabled", True) is not False and (include_gated or not plan.get("requires_valid_lineage")))


def source_paths(config: Mapping[str, Any], benchmarks: list[str]) -> list[str]:
    return sorted({p for b in benchmarks for p in config["benchmark_plan"].get(b, {}).get("source_paths", [])})


@dataclass(frozen=True)
class Settings:
    """What the ``analysis`` section of a configuration sets."""

    minimum_quality: float = 3.0
    quality_match_delta: float = 0.25
    retain_refusals: bool = True
    iterations: int = 2000
    confidence: float = 0.95
    seed: int = 20260904
    broad_drop_min: float = 0.15
    explicit_loss_min: float = 0.15
    recovery_tolerance: float = 0.10
    require_bridge: bool = True
    required_rqs: tuple[str, ...] = tuple(r for r in RQS if r != "unlearning_optional")
    roles: Roles = ROLES


def settings(config: Mapping[str, Any]) -> Settings:
    """The settings of a configuration. A key that is not there has its own default: no minimum quality, a match delta of 1, refusals not retained; the fields of Settings else."""
    given, base = config.get("analysis", {}), Settings()
    quality, boot, limits = given.get("quality_controls", {}), given.get("bootstrap", {}), given.get("dissociation_thresholds", {})
    named = {field: tuple(given[key]) for field, key in (("fit_on", "fit_sharpening_on"), ("transfer_to", "transfer_alpha_to")) if key in given}
    if quality.get("quality_score_column", "quality_score") != "quality_score":
        raise ConfigError("quality_score_column must be quality_score")
    return Settings(
        float(quality.get("minimum_quality_score", 0.0)), float(quality.get("quality_match_delta", 1.0)), bool(quality.get("retain_refusal_rows", False)), int(boot.get("iterations", base.iterations)), float(boot.get("confidence", base.confidence)), int(boot.get("seed", base.seed)),
        float(limits.get("broad_drop_min", base.broad_drop_min)), float(limits.get("explicit_loss_min", base.explicit_loss_min)), float(limits.get("explicit_recovery_tolerance", base.recovery_tolerance)), bool(given.get("require_rq3_dissociation_bridge", True)), tuple(required_rqs(config)), replace(base.roles, **named),
    )


def required_rqs(config: Mapping[str, Any]) -> list[str]:
    asked = config.get("analysis", {}).get("required_primary_rqs")
    return [r for r in asked if r in RQS] if asked else [r for r in RQS if r != "unlearning_optional"]
