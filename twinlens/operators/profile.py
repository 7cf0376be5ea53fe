"""Data quality profile of text columns, per load.

Values are unpivoted and counted per (column, load, value) on the map side.
The distinct values are range-sorted by column; running counts of a load and
of the load before it, merged in one order, give exact quantiles, distinct
counts and the exact Kolmogorov-Smirnov distance between the two loads.

Numbers sort before texts, by value; texts sort by their code units. A missing
value (NULL, empty or plain spaces) has no place in the order. An empty table
gives an empty profile; columns not named are ignored, whatever their names.
A load that is NULL is kept as its own load, first in order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlens.functions.values import filled, number, truth
from twinlens.plans.prefix import place, prefix_sums

QUANTILES = (0.25, 0.5, 0.75)
#: Up to so many loads (two numbers each) are broadcast; more are joined by shuffle.
MAX_LOADS = 10_000


@dataclass(frozen=True)
class Form:
    """What a value of a column must look like: a number (in a closed range), a truth word, or a pattern to be matched whole."""

    kind: str = "text"
    low: float | None = None
    high: float | None = None
    pattern: str | None = None

    def wrong(self, text: Column, num: Column) -> Column:
        if self.kind == "number":
            return num.isNull()
        if self.kind == "truth":
            return truth(text).isNull()
        if self.pattern is not None:
            return ~text.rlike(rf"\A(?:{self.pattern})\z")
        return F.lit(False)

    def outside(self, num: Column) -> Column:
        out = F.lit(False)
        if self.low is not None:
            out = out | F.coalesce(num < self.low, F.lit(False))
        if self.high is not None:
            out = out | F.coalesce(num > self.high, F.lit(False))
        return out


def unpivot(df: DataFrame, columns: Sequence[str], forms: Mapping[str, Form], load: str, key: str | None = None) -> DataFrame:
    """One row per cell: column_name, load_id, row_key, value (NULL when missing), num, wrong, outside."""
    cells = []
    for name in columns:
        text = F.col(f"`{name}`").cast("string")
        form, num = forms.get(name, Form()), number(text)
        value = F.when(filled(text), text)
        cells.append(F.struct(F.lit(name).alias("column_name"), value.alias("value"), num.alias("num"), F.coalesce(value.isNotNull() & form.wrong(text, num), F.lit(False)).alias("wrong"), form.outside(num).alias("outside")))
    cell = df.select(F.col(f"`{load}`").cast("bigint").alias("load_id"), (F.col(f"`{key}`") if key else F.lit(None)).cast("bigint").alias("row_key"), F.explode(F.array(*cells)).alias("cell"))
    return cell.select("load_id", "row_key", "cell.*")


def bad_cells(df: DataFrame, columns: Sequence[str], forms: Mapping[str, Form], load: str, key: str) -> DataFrame:
    """The cells of wrong form or outside their range: column_name, load_id, row_key, value."""
    return unpivot(df, columns, forms, load, key).filter("wrong or outside").select("column_name", "load_id", "row_key", "value")


def profile(df: DataFrame, columns: Sequence[str], load: str, forms: Mapping[str, Form] | None = None, parts: int | None = None) -> DataFrame:
    """One row per column and load.

    rows, missing_values, distinct_values, numbers, wrong_form, out_of_range, valid (numbers in range), mean_valid,
    top_valid (rows of the most frequent valid number), min_number, q25, q50, q75, max_number (nearest rank among
    numbers), min_text, max_text (among values that are no numbers) and ks_previous, the distance of the value
    distribution from the load before it (NULL when either has no values).
    """
    forms = forms or {}
    text = lambda name: F.col(f"`{name}`").cast("string")
    cells = F.array(*[F.struct(F.lit(name).alias("column_name"), F.when(filled(text(name)), text(name)).alias("value")) for name in columns])
    runs = df.select(F.col(f"`{load}`").cast("bigint").alias("load_id"), F.explode(cells).alias("cell")).groupBy("load_id", "cell.column_name", "cell.value").agg(F.count("*").alias("n"))
    # Form and range are judged once per run, not per cell.
    runs = runs.withColumn("num", number(F.col("value")))
    judged = lambda judge: F.coalesce(*[F.when(F.col("column_name") == name, judge(form)) for name, form in forms.items()], F.lit(False))
    runs = runs.withColumns({"wrong": F.col("value").isNotNull() & judged(lambda f: f.wrong(F.col("value"), F.col("num"))), "outside": judged(lambda f: f.outside(F.col("num")))})
    runs = runs.withColumn("load_key", F.coalesce("load_id", F.lit(-(2**63))))
    loads = df.select(F.coalesce(F.col(f"`{load}`").cast("bigint"), F.lit(-(2**63))).alias("of_key")).distinct()
    follows = loads.withColumn("next_key", F.lead("of_key").over(Window.orderBy("of_key")))
    if loads.limit(MAX_LOADS + 1).count() <= MAX_LOADS:
        follows = F.broadcast(follows)
    # All loads together are range-sorted by column and value, each run once.
    ranked = runs.withColumns({"rank": F.when(F.col("value").isNull(), 2).when(F.col("num").isNull(), 1).otherwise(0), "sort_num": F.coalesce("num", F.lit(0.0)), "sort_text": F.when(F.col("num").isNull(), F.col("value"))})
    placed = place(ranked.drop("load_id", "value", "num"), ["column_name", "rank", "sort_num", "sort_text"], parts, "profile")
    group, order = ["column_name", "load_key"], ["rank", "sort_num", "sort_text"]
    zero = F.lit(0).cast("bigint")
    # Each run counts in its own load and, as the load before, in the next one.
    side = F.explode(
        F.array(
            F.struct(F.col("load_key").alias("at"), F.col("n").alias("own"), zero.alias("prev")),
            F.struct(F.col("next_key").alias("at"), zero.alias("own"), F.when(F.col("rank") < 2, F.col("n")).otherwise(zero).alias("prev")),
        )
    )
    slim = placed.join(follows, F.col("load_key") == F.col("of_key")).select("_part", "column_name", "rank", "sort_num", "sort_text", "wrong", "outside", side.alias("side"))
    pairs = slim.filter("side.at is not null and side.own + side.prev > 0").select("_part", "column_name", F.col("side.at").alias("load_key"), "rank", "sort_num", "sort_text", "wrong", "outside", F.col("side.own").alias("own"), F.col("side.prev").alias("prev"))
    own, rank = F.col("own"), F.col("rank")
    part = lambda cond, c=own: F.when(cond, c).otherwise(0)
    run = prefix_sums(pairs.withColumns({"numbers": part(rank == 0), "values": part(rank < 2)}), group, order, ["own", "prev"], ["numbers", "values", "prev"], ["own"])
    valid, seen, total = (rank == 0) & ~F.col("outside"), own > 0, lambda c: F.col(f"{c}_total")
    quantile = lambda q: F.min(F.when((rank == 0) & (F.col("own_upto") >= F.ceil(F.lit(q) * total("numbers"))), F.col("sort_num")))
    apart = F.abs(F.col("own_upto") / total("values") - F.col("prev_upto") / total("prev"))
    number_seen, text_seen = F.when(seen & (rank == 0), F.col("sort_num")), F.when(seen & (rank == 1), F.col("sort_text"))
    whole = run.groupBy(*group).agg(
        F.sum(own).alias("rows"), F.sum(part(rank == 2)).alias("missing_values"), F.count_if(seen & (rank < 2)).alias("distinct_values"), F.sum(part(rank == 0)).alias("numbers"), F.sum(part(F.col("wrong"))).alias("wrong_form"), F.sum(part(F.col("outside"))).alias("out_of_range"),
        F.sum(part(valid)).alias("valid"), F.sum(F.when(valid & seen, own * F.col("sort_num"))).alias("sum_valid"), F.max(part(valid, F.col("own_here"))).alias("top_valid"), F.min(number_seen).alias("min_number"), *[quantile(q).alias(f"q{round(q * 100)}") for q in QUANTILES], F.max(number_seen).alias("max_number"),
        F.min(text_seen).alias("min_text"), F.max(text_seen).alias("max_text"), F.max(F.when((rank < 2) & (total("values") > 0) & (total("prev") > 0), apart)).alias("ks_previous"),
    ).filter("rows > 0")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return whole.select(
        "column_name", F.when(F.col("load_key") != -(2**63), F.col("load_key")).alias("load_id"), "rows", "missing_values", count("distinct_values"), count("numbers"), count("wrong_form"), count("out_of_range"), count("valid"),
        F.when(F.col("valid") > 0, F.col("sum_valid") / F.col("valid")).alias("mean_valid"), count("top_valid"), "min_number", *[f"q{round(q * 100)}" for q in QUANTILES], "max_number", "min_text", "max_text", "ks_previous",
    )


def departures(profiled: DataFrame, baseline: DataFrame, missing_tolerance: float = 0.12, mean_tolerance: float = 0.1, top_tolerance: float = 0.3, least_valid: int = 20) -> DataFrame:
    """The (column_name, load_id) of a profile that depart from the accepted baseline (column_name, valid_low, valid_high, missing_share, mean_value, top_share)."""
    b = baseline.select("column_name", "valid_low", "valid_high", "missing_share", "mean_value", "top_share")
    p = profiled.join(b, "column_name")
    enough = F.col("valid") >= least_valid
    odd = (
        (F.abs(F.col("missing_values") / F.col("rows") - F.col("missing_share")) > missing_tolerance)
        | (enough & (F.abs(F.col("mean_valid") - F.col("mean_value")) > mean_tolerance * (F.col("valid_high") - F.col("valid_low"))))
        | (enough & (F.col("top_valid") / F.col("valid") > F.col("top_share") + top_tolerance))
    )
    return p.filter(odd).select("column_name", "load_id")
