"""Records that differ only in how they are written.

Each record is brought to one writing (letters and digits of its text, its JSON
with sorted keys, other columns as they are) and hashed to 128 bits. Counts and
smallest keys are aggregated per hash with map-side combining, so only one
narrow row per distinct record and task is shuffled. A second, independent
64-bit hash and the length of the writing are carried as minimum and maximum:
where they differ within a group, two writings share the 128 bits, and those
groups are told apart by the writing itself.

NULL and the empty text are different values of exact columns and of JSON; a
NULL text counts as the empty one. Repeated rows are copies. Of equal keys one
is the first. An empty table gives no groups.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlens.llm.text_forms import canonical_json, letters_and_digits
from twinlens.plans.skew import join_groups
from twinlens.session import materialize

MARK = "␟"


@F.pandas_udf(T.StringType())
def _letters(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(letters_and_digits, na_action="ignore")


@F.pandas_udf(T.StringType())
def _json(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(canonical_json, na_action="ignore")


def same_letters(c: Column) -> Column:
    """letters_and_digits: ASCII texts stay in the JVM, only the others go to Python."""
    ascii_only = c.rlike(r"\A[\x00-\x7F]*\z")
    return F.when(ascii_only, F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))).otherwise(_letters(F.when(~ascii_only, c)))


def written_alike(df: DataFrame, key: str, exact: Sequence[str], texts: Sequence[str], jsons: Sequence[str]) -> DataFrame:
    """(key, writing): the canonical writing of each record."""
    part = lambda c: F.coalesce(F.concat(F.lit("v"), c), F.lit("n"))
    col = lambda n: F.col(f"`{n}`").cast("string")
    parts = [part(col(n)) for n in exact] + [part(same_letters(F.coalesce(col(n), F.lit("")))) for n in texts] + [part(_json(col(n))) for n in jsons]
    # Lengths before the parts keep a mark inside a value from shifting the fields.
    writing = F.concat(F.concat_ws(",", *[F.length(p).cast("string") for p in parts]), F.lit(MARK), F.concat_ws(MARK, *parts))
    return df.select(F.col(f"`{key}`").alias("key"), writing.alias("writing"))


def hashed(written: DataFrame, digest: Column | None = None) -> DataFrame:
    """(key, digest, check, size), written once: the writings themselves are not."""
    digest = F.md5("writing") if digest is None else digest
    return materialize(written.select("key", digest.alias("digest"), F.xxhash64("writing").alias("check"), F.length("writing").alias("size")), "hashed")


def copy_groups(marks: DataFrame, written: DataFrame) -> DataFrame:
    """One row per distinct record: group_id, first_key, copies. marks: hashed(written).

    Groups are formed on the digest; those that fail the collision check are formed again on the writings, which are made anew for their records.
    """
    groups = marks.groupBy(F.col("digest").alias("group_id")).agg(
        F.min("key").alias("first_key"), F.count("*").alias("copies"), F.min("check").alias("lo"), F.max("check").alias("hi"), F.min("size").alias("short"), F.max("size").alias("long")
    )
    groups = materialize(groups, "groups")
    clean = (F.col("lo") == F.col("hi")) & (F.col("short") == F.col("long"))
    good = groups.filter(clean).select("group_id", "first_key", "copies")
    mixed = groups.filter(~clean)
    if not mixed.limit(1).count():  # two writings under one digest are all but impossible
        return good
    parted = _mixed(marks, written, mixed.select("group_id")).groupBy("group_id").agg(F.min("key").alias("first_key"), F.count("*").alias("copies"))
    return good.unionByName(parted)


def _mixed(marks: DataFrame, written: DataFrame, mixed: DataFrame) -> DataFrame:
    """(group_id, key) of the records whose digest stands for several writings: the group is the writing."""
    keys = marks.join(mixed, marks["digest"] == mixed["group_id"], "left_semi").select("key").distinct()
    bad = mixed.select(F.col("group_id").alias("digest"))
    again = written.join(keys, "key", "left_semi").select("key", F.concat(F.lit("w:"), F.col("writing")).alias("group_id"), F.xxhash64("writing").alias("check"), F.length("writing").alias("size"))
    wanted = marks.join(bad, "digest", "left_semi").select("key", "check", "size").distinct()  # a key may have other records too
    return again.join(wanted, ["key", "check", "size"], "left_semi").select("group_id", "key")


def copies_of(marks: DataFrame, written: DataFrame) -> DataFrame:
    """One row for every record but the first of its group: first_key, key. Hot groups stay where they are."""
    groups = materialize(copy_groups(marks, written).filter("copies > 1"), "copies")
    by_writing = F.col("group_id").startswith("w:")
    out = join_groups(marks.select(F.col("digest").alias("group_id"), "key"), groups.filter(~by_writing), "group_id", "copies")
    if groups.filter(by_writing).limit(1).count():
        checks = marks.groupBy("digest").agg(F.min("check").alias("lo"), F.max("check").alias("hi"), F.min("size").alias("short"), F.max("size").alias("long"))
        mixed = checks.filter("lo <> hi or short <> long").select(F.col("digest").alias("group_id"))
        out = out.unionByName(join_groups(_mixed(marks, written, mixed), groups.filter(by_writing), "group_id", "copies"))
    return out.filter(F.col("key") != F.col("first_key")).select("first_key", "key")
