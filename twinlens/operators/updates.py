"""Label updates: validation, merging into label rows, and agreement between repeated updates.

Pairs of updates of one label are never listed: agreement, conflicts and large
differences of all pairs follow from counts per label and value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlens.functions import labels as L
from twinlens.functions import stats as S
from twinlens.functions.text import json_list, strip, text
from twinlens.plans.prefix import with_previous

FIELDS = ("semantic_label", "semantic_label_confidence", "pass_score", "quality_score", "refusal", "unsafe", "memorization_score", "evaluator", "notes")
JOINED = ("evaluator", "notes")
#: Scores are compared in steps of a millionth.
STEP = 1_000_000


def required_columns(updates: DataFrame) -> Column:
    """Columns an update must fill: those it names, else those of its evaluator kind, else none."""
    none = F.array().cast("array<string>")
    named = json_list(F.col("required_columns")) if "required_columns" in updates.columns else none
    if "evaluator_kind" not in updates.columns:
        return named
    kinds = F.create_map(*[x for k, names in L.KIND_OUTPUTS.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in names if n in FIELDS]))])
    return F.when(F.size(named) > 0, named).otherwise(F.coalesce(F.try_element_at(kinds, F.col("evaluator_kind")), none))


def validate(updates: DataFrame) -> DataFrame:
    """One row per error: ord, label_uid, field, error. A repeated label is compared with its previous update."""
    uid = text(F.col("label_uid"))
    payload = F.struct(*[text(F.col(f)).alias(f) for f in FIELDS])
    base = updates.select("ord", uid.alias("uid"), *FIELDS, required_columns(updates).alias("required"), payload.alias("payload"))
    # The update before is the neighbour in the order of label and arrival; no task holds all updates of a label.
    named = base.filter("uid <> ''")
    steps = with_previous(named, ["uid", "ord"], ["uid", "payload"], "updates")
    checked = steps.withColumn("previous", F.when(F.col("previous_uid") == F.col("uid"), F.col("previous_payload")))
    error = lambda cond, field, what: F.when(cond, F.struct(F.lit(field).alias("field"), F.lit(what).alias("error")))
    found = [error(F.col("previous").isNotNull() & (F.col("previous") != F.col("payload")), "", "conflicting duplicate update")]
    found += [error(F.array_contains("required", f) & (text(F.col(f)) == ""), f, "missing required value") for f in FIELDS]
    for c, (lo, hi) in L.RANGES.items():
        x, has = L.float_text(F.col(c)), text(F.col(c)) != ""
        found += [error(has & x.isNull(), c, "not numeric"), error(has & ~F.isnan(x) & ((x < lo) | (x > hi)), c, "out of range")]
    found += [error((text(F.col(c)) != "") & L.bool_text(F.col(c)).isNull(), c, "not boolean-like") for c in ("refusal", "unsafe")]
    rows = checked.select("ord", F.col("uid").alias("label_uid"), F.explode(F.array_compact(F.array(*found))).alias("e")).select("ord", "label_uid", "e.*")
    return rows.unionByName(base.filter("uid = ''").select("ord", F.lit("").alias("label_uid"), F.lit("label_uid").alias("field"), F.lit("missing label_uid").alias("error")))


def validation_summary(updates: DataFrame) -> DataFrame:
    uid = text(F.col("label_uid"))
    totals = updates.agg(F.count("*").alias("rows"), F.countDistinct(F.when(uid != "", uid)).alias("unique_label_uids"), F.count_if(uid != "").alias("named"))
    errors = validate(updates).agg(F.count("*").alias("error_count"), F.count_if(F.col("error") == "conflicting duplicate update").alias("conflicting_duplicate_label_uids"))
    return totals.crossJoin(F.broadcast(errors)).select("rows", "unique_label_uids", (F.col("named") - F.col("unique_label_uids")).alias("duplicate_label_uids"), "conflicting_duplicate_label_uids", "error_count", (F.col("error_count") == 0).alias("valid"))


def combine(updates: DataFrame) -> DataFrame:
    """One update per label: of each field the first value that is not blank; annotators and notes of repeated updates joined in order. conflicts: fields with a later, different value."""
    uid = text(F.col("label_uid"))
    keyed = updates.select(uid.alias("label_uid"), "ord", *FIELDS).filter("label_uid <> ''")
    full = lambda f: text(F.col(f)) != ""
    given = lambda f: F.when(full(f), F.col(f))
    plain = [f for f in FIELDS if f not in JOINED]
    first = keyed.groupBy("label_uid").agg(
        F.count("*").alias("updates"), *[F.min_by(given(f), F.when(full(f), F.col("ord"))).alias(f) for f in FIELDS], *[(F.min(given(f)) != F.max(given(f))).alias(f"n_{f}") for f in plain]
    )
    # Parts of annotators and notes: each distinct part of a label once, where it first occurs; only those are gathered.
    lists = F.array(*[F.struct(F.lit(f).alias("field"), F.split(F.col(f), ";").alias("parts")) for f in JOINED])
    parts = keyed.select("label_uid", "ord", F.explode(lists).alias("l")).select("label_uid", "ord", "l.field", F.posexplode("l.parts").alias("pos", "part")).withColumn("part", strip(F.col("part"))).filter("part <> ''")
    once = parts.groupBy("label_uid", "field", "part").agg(F.min(F.struct("ord", "pos")).alias("at"))
    lines = once.groupBy("label_uid").agg(*[F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("field") == f, F.struct("at", "part")))), lambda s: s["part"]), "; ").alias(f"j_{f}") for f in JOINED])
    both = first.join(lines, "label_uid", "left")
    joined = [F.when((F.col("updates") > 1) & (F.col(f"j_{f}") != ""), F.col(f"j_{f}")).otherwise(F.col(f)).alias(f) for f in JOINED]
    conflict = F.array_compact(F.array(*[F.when(F.col(f"n_{f}"), f) for f in plain]))
    return both.select("label_uid", "updates", *plain, *joined, conflict.alias("conflicts"))


def merge(labels: DataFrame, updates: DataFrame, strict: bool = False) -> DataFrame:
    """Label rows with the non-blank fields of their updates. Strict: conflicts and unknown labels are errors, found before anything is returned."""
    combined = combine(updates)
    if strict:
        clash = combined.filter(F.size("conflicts") > 0).select("label_uid").limit(1).collect()
        unknown = combined.join(labels.select(text(F.col("label_uid")).alias("label_uid")), "label_uid", "left_anti").select("label_uid").limit(1).collect()
        if clash or unknown:
            raise ValueError(f"conflicting updates of {clash[0][0]}" if clash else f"update of unknown label {unknown[0][0]}")
    u = combined.select(F.col("label_uid").alias("u_uid"), *[F.col(f).alias(f"u_{f}") for f in FIELDS])
    joined = labels.join(u, text(F.col("label_uid")) == F.col("u_uid"), "left")
    return joined.select(*[F.coalesce(f"u_{c}", c).alias(c) if c in FIELDS else F.col(f"`{c}`") for c in labels.columns], F.col("u_uid").isNotNull().alias("updated"))


def unmatched_updates(labels: DataFrame, updates: DataFrame) -> DataFrame:
    return updates.select(text(F.col("label_uid")).alias("label_uid")).filter("label_uid <> ''").distinct().join(labels.select(text(F.col("label_uid")).alias("label_uid")), "label_uid", "left_anti")


def _value_pairs(counts: DataFrame, per: Sequence[str], value: str) -> DataFrame:
    """From counts n per (per, value): pairs in all and pairs of equal values, per ``per``."""
    n = F.col("n")
    return counts.groupBy(*per).agg(F.sum("n").alias("m"), F.sum(n * (n - 1) / 2).alias("same")).select(*per, (F.col("m") * (F.col("m") - 1) / 2).cast("bigint").alias("pairs"), F.col("same").cast("bigint").alias("same"))


def reliability_by_field(updates: DataFrame, numeric_step: float = 0.25, quality_step: float = 1.0) -> DataFrame:
    """Per field, over all pairs of updates of one label with both values: pairs, conflicts, and for scores mean and largest difference.

    Scores conflict when they differ by more than their threshold, flags when their meaning differs, texts when they differ at all;
    'behavior_label' compares the derived labels.
    """
    uid = text(F.col("label_uid")).alias("label_uid")
    flags = {f: L.bool_text(F.col(f)).cast("string") for f in ("refusal", "unsafe")}
    texts = {f: text(F.col(f)) for f in ("semantic_label", "evaluator", "notes")} | {"behavior_label": L.update_behavior_label()}
    cells = F.array(*[F.struct(F.lit(f).alias("field"), c.alias("value")) for f, c in (flags | texts).items()])
    said = updates.select(uid, F.explode(cells).alias("c")).select("label_uid", "c.*").filter("label_uid <> '' and value <> ''")
    pairs = _value_pairs(said.groupBy("label_uid", "field", "value").agg(F.count("*").alias("n")), ["label_uid", "field"], "value")
    words = pairs.groupBy("field").agg(F.sum("pairs").alias("pairs"), F.sum(F.col("pairs") - F.col("same")).alias("conflicts")).filter("pairs > 0")
    scores = F.array(*[F.struct(F.lit(f).alias("field"), F.round(L.float_no_nan(F.col(f)) * STEP).try_cast("bigint").alias("x")) for f in L.RANGES])
    given = updates.select(uid, F.explode(scores).alias("c")).select("label_uid", "c.*").filter("label_uid <> '' and x is not null").groupBy("label_uid", "field", "x").agg(F.count("*").alias("n"))
    group = ["label_uid", "field"]
    order = Window.partitionBy(*group).orderBy("x")  # one row per distinct score of a label
    lower = order.rowsBetween(Window.unboundedPreceding, -1)
    wide = given.withColumns({"below_n": F.coalesce(F.sum("n").over(lower), F.lit(0)), "below_sum": F.coalesce(F.sum(F.col("n") * F.col("x")).over(lower), F.lit(0))})
    apart = [F.coalesce(F.sum("n").over(order.rangeBetween(Window.unboundedPreceding, -(int(round(t * STEP)) + 1))), F.lit(0)) for t in (numeric_step, quality_step)]
    wide = wide.withColumn("far", F.when(F.col("field") == "quality_score", apart[1]).otherwise(apart[0]))
    n, x = F.col("n"), F.col("x")
    sums = wide.groupBy(*group).agg(F.sum("n").alias("m"), F.sum(n * (x * F.col("below_n") - F.col("below_sum"))).alias("diff"), F.sum(n * F.col("far")).alias("far"), (F.max("x") - F.min("x")).alias("spread")).filter("m > 1")
    numbers = sums.groupBy("field").agg(F.sum((F.col("m") * (F.col("m") - 1) / 2).cast("bigint")).alias("pairs"), F.sum("far").alias("conflicts"), F.sum("diff").alias("diff"), F.max("spread").alias("spread"))
    numbers = numbers.select("field", "pairs", "conflicts", (F.col("diff") / F.col("pairs") / STEP).alias("mean_abs_diff"), (F.col("spread") / STEP).alias("max_abs_diff"))
    return words.select("field", "pairs", "conflicts", F.lit(None).cast("double").alias("mean_abs_diff"), F.lit(None).cast("double").alias("max_abs_diff")).unionByName(numbers)


def reliability_summary(updates: DataFrame) -> DataFrame:
    """One row: overlapping labels, pairwise agreement of derived labels and kappa with pooled marginals."""
    uid = text(F.col("label_uid")).alias("label_uid")
    per_uid = updates.select(uid).filter("label_uid <> ''").groupBy("label_uid").agg(F.count("*").alias("n"))
    totals = per_uid.agg(F.count("*").alias("unique_label_uids"), F.count_if(F.col("n") > 1).alias("overlap_label_uids"))
    said = updates.select(uid, L.update_behavior_label().alias("value")).filter("label_uid <> '' and value <> ''").groupBy("label_uid", "value").agg(F.count("*").alias("n"))
    size = F.sum("n").over(Window.partitionBy("label_uid"))  # one row per label value of an item
    sized = said.withColumn("m", size).filter("m > 1")
    agree = _value_pairs(sized, ["label_uid"], "value").agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("comparisons"), F.coalesce(F.sum("same"), F.lit(0)).alias("agreeing"))
    # A label value stands in as many pairs as its item has other updates.
    pooled = sized.groupBy("value").agg(F.sum(F.col("n") * (F.col("m") - 1)).alias("c"))
    chance = pooled.agg(F.sum(F.col("c") * F.col("c")).cast("double").alias("cc"), F.sum("c").cast("double").alias("ct"))
    one = totals.crossJoin(F.broadcast(agree)).crossJoin(F.broadcast(chance))
    rate = F.try_divide("agreeing", "comparisons")
    return one.select("unique_label_uids", "overlap_label_uids", F.col("comparisons").alias("behavior_pairwise_comparisons"), rate.alias("behavior_pairwise_agreement"), F.when(F.col("comparisons") > 0, S.kappa(F.col("agreeing"), F.col("comparisons"), F.col("cc") / (F.col("ct") * F.col("ct")))).alias("behavior_pairwise_kappa"))
