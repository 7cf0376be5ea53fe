"""Whether evaluator tasks and batches agree with the label rows they were made from."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.functions import labels as L
from twinlens.functions.text import text
from twinlens.operators.audits import unpivot_gates

GROUP = ["benchmark", "condition_type", "evaluator_kind"]
#: Rows of a batch that are looked into.
SAMPLE_ROWS = 5


def _expected(rows: DataFrame) -> DataFrame:
    key = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return rows.select("ord", text(F.col("label_uid")).alias("label_uid"), key("benchmark"), key("condition_type"), L.evaluator_kind().alias("evaluator_kind"), F.sort_array(L.required_signals()).alias("required"))


def mapping_errors(rows: DataFrame, outputs: Mapping[str, Sequence[str]] = L.KIND_OUTPUTS) -> DataFrame:
    """(error, rows): label rows without id or with a repeated one, of a kind without schema, or asking for columns their kind does not give."""
    named = _expected(rows)
    schema = F.create_map(*[x for k, v in outputs.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]) if outputs else F.lit(None).cast("map<string,array<string>>")
    given = F.try_element_at(schema, F.col("evaluator_kind"))
    some = F.col("label_uid") != ""
    error = lambda cond, what: F.when(F.coalesce(cond, F.lit(False)), F.lit(what))
    found = F.array_compact(
        F.array(
            error(~some, "missing label_uid"), error(some & given.isNull(), "missing schema"), error(some & (F.size(F.array_except("required", given)) > 0), "required outputs missing from schema"), error(some & ~F.array_contains("required", "quality_score"), "quality_score not required")
        )
    )
    repeated = named.filter(some).groupBy("label_uid").agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).filter("rows > 0").select(F.lit("duplicate label_uid").alias("error"), "rows")
    return named.select(F.explode(found).alias("error")).groupBy("error").agg(F.count("*").alias("rows")).unionByName(repeated)


def task_errors(rows: DataFrame, tasks: DataFrame, outputs: Mapping[str, Sequence[str]] = L.KIND_OUTPUTS) -> DataFrame:
    """(error, rows): tasks without label row, of another kind, asking for other columns or without schema; and labels without task. tasks: label_uid, evaluator_kind, required_columns (comma list).

    Of repeated label ids the last row counts.
    """
    want = _expected(rows).filter("label_uid <> ''").groupBy("label_uid").agg(F.max_by(F.struct("evaluator_kind", "required"), "ord").alias("want"))
    have = tasks.select(text(F.col("label_uid")).alias("label_uid"), F.struct(F.col("evaluator_kind"), F.sort_array(F.filter(F.split(F.coalesce("required_columns", F.lit("")), ","), lambda x: x != "")).alias("required")).alias("have"))
    both = have.join(want, "label_uid", "full")
    a, b = F.col("have"), F.col("want")
    found = F.array_compact(
        F.array(
            F.when(b.isNull(), "label_uid absent from labels"), F.when(a.isNull(), "label_uid absent from task index"), F.when(a["evaluator_kind"] != b["evaluator_kind"], "evaluator_kind mismatch"),
            F.when(a["required"] != b["required"], "required_columns mismatch"), F.when(a.isNotNull() & ~F.coalesce(a["evaluator_kind"].isin(*outputs), F.lit(False)), "missing schema"),
        )
    )
    return both.select(F.explode(found).alias("error")).groupBy("error").agg(F.count("*").alias("rows"))


def group_rows(rows: DataFrame, tasks: DataFrame, batches: DataFrame) -> DataFrame:
    """Rows of labels, tasks and batches per group, groups of any of the three. tasks: the group columns; batches: the group columns and rows."""
    labels = _expected(rows).filter("label_uid <> ''").groupBy(*GROUP, "required").agg(F.count("*").alias("n"))
    labels = labels.groupBy(*GROUP).agg(F.sum("n").alias("label_rows"), F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list("required")))), ",").alias("required_columns"))
    keys = [F.coalesce(c, F.lit("")).alias(c) for c in GROUP]
    t = tasks.groupBy(*keys).agg(F.count("*").alias("task_index_rows"))
    b = batches.groupBy(*keys).agg(F.sum("rows").alias("batch_rows"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return labels.join(t, GROUP, "full").join(b, GROUP, "full").select(*GROUP, zero("label_rows"), zero("task_index_rows"), zero("batch_rows"), F.coalesce("required_columns", F.lit("")).alias("required_columns"))


def batch_errors(batch_rows: DataFrame, redact_safety: bool = True) -> DataFrame:
    """(error, rows) in the first rows of every batch. batch_rows: batch_no, row_no (from 1), expected_kind, evaluator_kind, prompt_text, instruction."""
    use = batch_rows.filter(F.col("row_no") <= SAMPLE_ROWS)
    safety = F.col("evaluator_kind").isin(*L.SAFETY_KINDS)
    found = F.array_compact(
        F.array(
            F.when(~F.col("evaluator_kind").eqNullSafe(F.col("expected_kind")), "evaluator_kind mismatch"), F.when(~F.coalesce(F.col("instruction").contains("Required output columns"), F.lit(False)), "instruction incomplete"),
            F.when(F.lit(redact_safety) & safety & ~F.col("prompt_text").eqNullSafe(F.lit(L.REDACTED)), "safety prompt not redacted"),
        )
    )
    return use.select(F.explode(found).alias("error")).groupBy("error").agg(F.count("*").alias("rows"))


def schema_errors(schemas: Mapping[str, Mapping[str, object]]) -> list[str]:
    """Kinds without schema, and empty parts of those there are; a driver-side look at a small document."""
    missing = [f"missing {k}" for k in L.KIND_OUTPUTS if k not in schemas]
    return missing + [f"{k}: missing {part}" for k, s in schemas.items() for part in ("goal", "outputs", "decision_rule") if not s.get(part)]


def gates(rows: DataFrame, tasks: DataFrame, batch_rows: DataFrame | None = None, schemas: Mapping[str, Mapping[str, object]] | None = None) -> DataFrame:
    """(gate, pass); the gates of batches and of schemas only where those are given."""
    count = lambda df, name: df.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias(name))
    one = count(mapping_errors(rows), "mapping").crossJoin(count(task_errors(rows, tasks), "tasks")).crossJoin(rows.agg(F.count("*").alias("label_rows"))).crossJoin(tasks.agg(F.count("*").alias("task_rows")))
    found = {"label_mapping_complete": F.col("mapping") == 0, "task_index_consistent": F.expr("tasks = 0 and label_rows = task_rows")}
    if batch_rows is not None:
        one = one.crossJoin(count(batch_errors(batch_rows), "batches"))
        found |= dict.fromkeys(("batch_index_consistent", "batch_instruction_quality"), F.col("batches") == 0)
    if schemas is not None:
        found["schema_complete"] = F.lit(not schema_errors(schemas))
    return unpivot_gates(one, found)
