"""Running sums inside groups of any size, without one task per group.

Rows are placed by a range partitioning on group and order, and the placement
is written to the shared folder (a second evaluation would sample other range
bounds). A window then runs inside each (partition, group), and the sums of
the partitions before it, at most one row per partition and group, are added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinlens.session import materialize, width


def place(df: DataFrame, keys: Sequence[str], parts: int | None = None, label: str = "range") -> DataFrame:
    """Writes the rows range-partitioned and sorted by keys; ``_part`` is the partition and ``_pos`` rises along the order."""
    n = parts or width(df.sparkSession)
    return materialize(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumns({"_part": F.spark_partition_id(), "_pos": F.monotonically_increasing_id()}), label)


def prefix_sums(placed: DataFrame, group: Sequence[str], order: Sequence[str], sums: Sequence[str], totals: Sequence[str] = (), peers: Sequence[str] = ()) -> DataFrame:
    """Adds to placed rows ``<s>_upto``, the sum of s over the rows of the group up to this one, rows of equal order included;
    ``<t>_total``, the sum over the whole group; and ``<p>_here``, the sum over the group's rows of equal order.

    Along the order of a group ``_part`` must not fall. Rows of one group with equal order must be few and in one part.
    """
    inside = Window.partitionBy("_part", *group).orderBy(*order)
    upto, here = inside.rangeBetween(Window.unboundedPreceding, Window.currentRow), inside.rangeBetween(Window.currentRow, Window.currentRow)
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("_part", *group).agg(*[F.sum(s).alias(s) for s in dict.fromkeys([*sums, *totals])])
    # One row per part and group, so a window over a group holds at most as many rows as there are parts.
    offsets = parts.select("_part", *group, *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"{s}_before") for s in sums], *[F.sum(t).over(whole).alias(f"{t}_total") for t in totals])
    run = placed.withColumns({f"{s}_upto": F.sum(s).over(upto) for s in sums} | {f"{p}_here": F.sum(p).over(here) for p in peers})
    joined = run.join(offsets.hint("merge"), ["_part", *group])  # the rows are sorted for this already
    return joined.select(*placed.columns, *[(F.col(f"{s}_upto") + F.col(f"{s}_before")).alias(f"{s}_upto") for s in sums], *[f"{t}_total" for t in totals], *[f"{p}_here" for p in peers])


def range_prefix(df: DataFrame, group: Sequence[str], order: Sequence[str], sums: Sequence[str], parts: int | None = None, label: str = "range") -> DataFrame:
    """prefix_sums over any rows, placed by group and order. Group columns must not be NULL; add a tie breaker to ``order`` where many rows of a group are equal."""
    return prefix_sums(place(df, [*group, *order], parts, label).drop("_pos"), group, order, sums).drop("_part")


def running_least(df: DataFrame, order: str, value: str, parts: int | None = None, label: str = "least") -> DataFrame:
    """Adds ``<value>_least``: the smallest value of this row and all rows of greater order, over the whole table, without one task for it.

    Orders must be distinct.
    """
    n = parts or width(df.sparkSession)
    placed = materialize(df.repartitionByRange(n, order).withColumn("_part", F.spark_partition_id()), label)
    rest = Window.partitionBy("_part").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    floors = placed.groupBy("_part").agg(F.min(value).alias("_low")).select("_part", F.min("_low").over(later).alias("_floor"))
    out = placed.withColumn("_own", F.min(value).over(rest)).join(F.broadcast(floors), "_part")
    return out.select(*df.columns, F.least("_own", "_floor").alias(f"{value}_least"))


def numbered(df: DataFrame, order: Sequence[str], group: Sequence[str] = (), name: str = "place", label: str = "numbered") -> DataFrame:
    """Adds the place of each row (from 1) in its group, or in the whole table; no task holds a whole group. Orders must be distinct within a group."""
    base = df.withColumns({"_one": F.lit(1).cast("bigint"), "_whole": F.lit(0)})
    return range_prefix(base, [*group] or ["_whole"], list(order), ["_one"], label=label).withColumnRenamed("_one_upto", name).drop("_one", "_whole")


def with_previous(df: DataFrame, order: Sequence[str], columns: Sequence[str], label: str = "previous") -> DataFrame:
    """Adds ``place`` and ``previous_<c>``: the values of the row before in the order of the whole table, NULL for the first. Neighbours meet by an equi-join on their place, not in one window."""
    placed = materialize(numbered(df, order, label=label), label)
    before = placed.select((F.col("place") + 1).alias("place"), *[F.col(c).alias(f"previous_{c}") for c in columns])
    return placed.join(before, "place", "left")
