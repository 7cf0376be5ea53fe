"""Joining rows to a table of groups when a few groups hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group is hot when it holds more than one row in HOT_SHARE; so there are fewer than HOT_SHARE hot groups, whatever the data.
HOT_SHARE = 1000
#: Rows of a table of the study's design (pairs, models, seed policies) that is broadcast; a larger one is joined by shuffle.
MAX_SMALL = 10_000


def small(df: DataFrame) -> DataFrame:
    """The table to be broadcast, if it has at most MAX_SMALL rows; else as it is."""
    return F.broadcast(df) if df.limit(MAX_SMALL + 1).count() <= MAX_SMALL else df


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of rows to groups on ``key``; ``size`` holds each group's number of rows.

    Hot groups, fewer than HOT_SHARE by construction, are broadcast, so that their rows
    stay where they are; the others are joined by shuffle. Keys must not be NULL.
    """
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0)).alias("_total"))
    marked = groups.crossJoin(F.broadcast(total)).withColumn("_hot", F.col(size) * HOT_SHARE > F.col("_total")).drop("_total")
    hot = F.broadcast(marked.filter("_hot").drop("_hot"))
    cold = marked.filter("not _hot").drop("_hot")
    hot_keys = F.broadcast(marked.filter("_hot").select(key))
    return rows.join(hot, key).unionByName(rows.join(hot_keys, key, "left_anti").join(cold, key))
