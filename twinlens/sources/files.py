"""Readers and writers of the study's files."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlens.functions.text import serialize_cell
from twinlens.operators.updates import FIELDS
from twinlens.plans.prefix import numbered


def read_document(path: str | Path) -> Any:
    """A small JSON document (configuration, index) on the driver."""
    return json.loads(Path(path).read_text(encoding="utf-8"))


def write_document(path: str | Path, data: Any) -> None:
    """One sorted, indented JSON document with a final newline; folders are made."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(json.dumps(data, ensure_ascii=False, indent=2, sort_keys=True) + "\n", encoding="utf-8")


def write_text(path: str | Path, text: str) -> None:
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text, encoding="utf-8")


def with_ord(df: DataFrame, name: str = "ord") -> DataFrame:
    """Adds the place of each row in file order (from 0): files by name, rows by position. df needs _file, _block and _row."""
    return numbered(df, ["_file", "_block", "_row"], name=name, label="fileorder").withColumn(name, F.col(name) - 1).drop("_file", "_block", "_row")


def placed(df: DataFrame) -> DataFrame:
    """A file scan with the columns that with_ord needs."""
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One object per line, blank lines skipped; a line that is no object fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object per row, keys sorted, NULL fields kept."""
    line = F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Appends event rows."""
    df.write.mode("append").json(path)


def has_broken_lines(spark: SparkSession, path: str) -> bool:
    """Whether a quoted cell may hold a line break: then some line has an odd number of quotes. A scan of lines, in splits, that stops at the first."""
    odd = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).filter(odd % 2 == 1).isEmpty()


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header; every column a text. The header is read first, so that no schema is inferred.

    Files without line breaks in cells are read in splits; only those with them are read whole, one task a file.
    """
    options = {"header": True, "multiLine": has_broken_lines(spark, path), "escape": '"', "mode": "PERMISSIVE", "inferSchema": False}
    return spark.read.options(**options).csv(path)


def write_csv(df: DataFrame, path: str, fields: Sequence[str]) -> None:
    """The given columns in order; columns that are missing are blank, others are dropped, nested cells are JSON."""
    kinds = {f.name: f.dataType for f in df.schema}
    cells = [serialize_cell(F.col(f"`{f}`"), kinds[f]).alias(f) if f in kinds else F.lit("").alias(f) for f in fields]
    df.select(*cells).write.mode("overwrite").options(header=True, emptyValue="", nullValue="", quote='"', escape='"').csv(path)


def read_updates(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Update files of either kind as one table of texts with ``ord``: files in the given order, then rows as they stand. Extra columns are kept."""
    whole = None
    for no, path in enumerate(paths):
        if path.lower().endswith(".csv"):
            part = read_csv(spark, path)
        else:
            part = spark.read.option("mode", "FAILFAST").option("primitivesAsString", True).json(path)
        part = placed(part).withColumn("_file", F.lit(f"{no:09d}"))
        part = part.select(*[F.col(c).cast("string").alias(c) if c not in ("_file", "_block", "_row") else F.col(c) for c in part.columns])
        whole = part if whole is None else whole.unionByName(part, allowMissingColumns=True)
    if whole is None:
        raise ValueError("no update files")
    for c in ("label_uid", *FIELDS):
        if c not in whole.columns:
            whole = whole.withColumn(c, F.lit(None).cast("string"))
    return with_ord(whole)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """A label CSV as a table of texts with ``ord``."""
    return with_ord(placed(read_csv(spark, path)))


def count_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, lines): non-blank lines per file."""
    return spark.read.text(path).filter(F.trim("value") != "").groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("lines"))


def image_status(paths: DataFrame, column: str, root: str, verify: bool = False) -> DataFrame:
    """Adds image_status to a table of relative image paths: missing, empty, present, verified or unreadable.

    Workers look at the files under root, a folder they share; only with verify are contents read. (The file
    source for binaries leaves out empty files, so it cannot tell empty from missing.)
    """
    import pandas as pd

    def look(path: str | None) -> str:
        file = Path(root, path or "")
        if not path or not file.is_file():
            return "missing"
        if not file.stat().st_size:
            return "empty"
        if not verify:
            return "present"
        from PIL import Image

        try:
            with Image.open(file) as image:
                image.verify()
            return "verified"
        except Exception:
            return "unreadable"

    def status(batch):
        return batch.map(look)

    status.__annotations__ = {"batch": pd.Series, "return": pd.Series}
    return paths.withColumn("image_status", F.pandas_udf(status, "string")(F.col(column)))


def shard_table(spark: SparkSession, index: Mapping[str, Any]) -> DataFrame:
    """The shards of an index document as a table: shard, jobs, models."""
    rows = [(str(s.get("shard_id", k)), int(s.get("jobs", 0)), len(s.get("jobs_by_model", {}))) for k, s in enumerate(index.get("shards", []))]
    return spark.createDataFrame(rows, "shard string, jobs bigint, models int")


BANK_SCHEMA = (
    "eval_uid string, image_prompt_uid string, benchmark string, source string, source_path string, source_row_id string, prompt_text string, axis_id string, axis_name string, condition_type string, analysis_layers array<string>, "
    "complexity_level string, target_behavior string, candidate_behaviors array<string>, evaluator string, requires_valid_lineage boolean, metadata string"
)
JOB_SCHEMA = (
    "job_id string, model_id string, display_name string, family string, runner string, hf_model string, base_model string, checkpoint string, num_inference_steps int, guidance_scale double, device string, benchmark string, condition_type string, "
    "image_prompt_uid string, eval_uids array<string>, seed int, prompt_text string, output_path string, requires_valid_lineage boolean, generation_kwargs string"
)


def read_bank(spark: SparkSession, path: str) -> DataFrame:
    """Prompt records from JSONL, or from Parquet that has ``ord``."""
    return spark.read.parquet(path) if path.endswith(".parquet") else with_ord(placed(read_jsonl(spark, path, BANK_SCHEMA)))


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Generation jobs from JSONL, or from Parquet that has ``ord``."""
    return spark.read.parquet(path) if path.endswith(".parquet") else with_ord(placed(read_jsonl(spark, path, JOB_SCHEMA)))


def read_label_rows(spark: SparkSession, path: str) -> DataFrame:
    """Label rows from a CSV file, or from Parquet that has ``ord``."""
    return spark.read.parquet(path) if path.endswith(".parquet") else read_labels(spark, path)
