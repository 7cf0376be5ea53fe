"""The analysis tables of paired models, from label rows.

Labels are reduced to histograms or matched cells first; all tables derive from
those. A histogram counts every row; a matched cell keeps one row per model, the
last in order. Key columns that are NULL count as ''.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlens.functions import labels as L
from twinlens.functions import stats as S
from twinlens.functions.text import text
from twinlens.config import pair_models
from twinlens.plans.prefix import range_prefix, running_least
from twinlens.plans.skew import small
from twinlens.session import materialize

AXIS = ["benchmark", "axis_id", "condition_type"]
CELL = [*AXIS, "image_prompt_uid", "seed", "eval_uid"]
PAIR = ["comparison_id", "family"]


def typed(rows: DataFrame) -> DataFrame:
    """The columns the analyses use: keys, label, quality, target, candidates and pass score."""
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return rows.select(
        "ord", *[key(c) for c in ("model_id", *CELL, "complexity_level")], text(F.col("target_behavior")).alias("target"), L.candidate_list(F.col("candidate_behaviors")).alias("candidates"),
        L.behavior_label().alias("label"), L.float_text(F.col("quality_score")).alias("quality"), L.float_text(F.col("pass_score")).alias("passed"),
    )


def labelled(rows: DataFrame) -> DataFrame:
    return typed(rows).filter("label <> ''")


def kept_rows(labels: DataFrame, minimum: float = 3.0, retain_refusals: bool = True) -> DataFrame:
    """Rows of sufficient quality: a missing quality always drops the row, a low one unless the row is a retained refusal."""
    low = L.below(F.col("quality"), minimum)
    return labels.filter(F.col("quality").isNotNull() & (~low | (F.lit(retain_refusals) & (F.col("label") == "refusal"))))


def quality_by_model(labels: DataFrame, minimum: float = 3.0, retain_refusals: bool = True) -> DataFrame:
    q, low = F.col("quality"), L.below(F.col("quality"), minimum)
    kept = q.isNotNull() & (~low | (F.lit(retain_refusals) & (F.col("label") == "refusal")))
    return labels.groupBy("model_id", "benchmark", "condition_type").agg(
        F.count("*").alias("rows"), F.count_if(kept).alias("kept_rows"), F.count_if(q.isNull()).alias("missing_quality_rows"), F.count_if(low).alias("low_quality_rows"), F.coalesce(F.avg("quality"), F.lit(0.0)).alias("mean_quality")
    )


def cells(labels: DataFrame, *values: str) -> DataFrame:
    """One row per matched cell and model: the last in order."""
    return labels.groupBy("model_id", *CELL).agg(F.max_by(F.struct(*values), "ord").alias("v")).select("model_id", *CELL, "v.*")


def matched(by_model: DataFrame, pairs: DataFrame, *values: str) -> DataFrame:
    """Teacher and student of each pair in the same cell: t_<value>, s_<value>. One shuffle: cells meet on their key, pairs are a small broadcast table."""
    few = small(pairs)
    t = by_model.join(few, by_model["model_id"] == few["teacher_model_id"]).select(*PAIR, *CELL, *[F.col(v).alias(f"t_{v}") for v in values])
    s = by_model.join(few, by_model["model_id"] == few["student_model_id"]).select("comparison_id", *CELL, *[F.col(v).alias(f"s_{v}") for v in values])
    return t.join(s, ["comparison_id", *CELL])


def quality_pair_balance(labels: DataFrame, pairs: DataFrame, delta: float = 0.25) -> DataFrame:
    both = matched(cells(labels.filter("quality is not null"), "quality"), pairs, "quality")
    off = F.abs(F.col("t_quality") - F.col("s_quality"))
    return both.groupBy(*PAIR, "benchmark", "condition_type").agg(
        F.count("*").alias("matched_quality_cells"), F.avg("t_quality").alias("teacher_mean_quality"), F.avg("s_quality").alias("student_mean_quality"), F.avg(off).alias("mean_abs_quality_delta"), F.max(off).alias("max_abs_quality_delta")
    ).withColumn("exceeds_config_delta", F.when(F.col("mean_abs_quality_delta") > delta, "true").otherwise("false"))


def histogram(labels: DataFrame) -> DataFrame:
    return labels.groupBy("model_id", *AXIS, "label").agg(F.count("*").alias("count"))


def distribution_summary(hist: DataFrame) -> DataFrame:
    group = Window.partitionBy("model_id", *AXIS)  # one row per label
    p = F.col("count") / F.col("n")
    wide = hist.withColumn("n", F.sum("count").over(group)).withColumn("probability", p)
    entropy = S.normalized_entropy(F.sum(S.entropy_part(F.col("probability"))).over(group), F.count("*").over(group))
    return wide.select("model_id", *AXIS, "label", "count", "probability", "n", entropy.alias("normalized_entropy"))


def facing(hist: DataFrame, pairs: DataFrame) -> DataFrame:
    """Teacher and student histograms of each pair and axis side by side over their common support: t, s (counts, 0 where unseen), t_n, s_n, k (support size); only where both have labels."""
    n = F.col("count")
    sides = hist.join(small(pair_models(pairs)), "model_id")  # each side of a pair meets the histograms of its model
    mine, other = F.col("role") == "teacher", F.col("role") == "student"
    rows = sides.groupBy(*PAIR, *AXIS, "label").agg(F.sum(F.when(mine, n).otherwise(0)).alias("t"), F.sum(F.when(other, n).otherwise(0)).alias("s"))
    group = Window.partitionBy(*PAIR, *AXIS)
    return rows.withColumns({"t_n": F.sum("t").over(group), "s_n": F.sum("s").over(group), "k": F.count("*").over(group)}).filter("t_n > 0 and s_n > 0").withColumns({"p": F.col("t") / F.col("t_n"), "q": F.col("s") / F.col("s_n")})


def pairwise_shift(faced: DataFrame) -> DataFrame:
    p, q = F.col("p"), F.col("q")
    d = faced.groupBy(*PAIR, *AXIS).agg(
        F.max("t_n").alias("teacher_n"), F.max("s_n").alias("student_n"), F.max("k").alias("k"), F.sum(S.entropy_part(p)).alias("ht"), F.sum(S.entropy_part(q)).alias("hs"),
        F.sum(S.tv_part(p, q)).alias("total_variation"), F.sum(S.js_part(p, q)).alias("js_divergence"), F.sqrt(F.sum(S.hellinger_part(p, q))).alias("hellinger"),
    )
    d = d.withColumns({"teacher_entropy": S.normalized_entropy(F.col("ht"), F.col("k")), "student_entropy": S.normalized_entropy(F.col("hs"), F.col("k"))})
    return d.select(*PAIR, *AXIS, "teacher_n", "student_n", "teacher_entropy", "student_entropy", (F.col("student_entropy") - F.col("teacher_entropy")).alias("entropy_delta_student_minus_teacher"), "total_variation", "js_divergence", "hellinger")


def multiple_testing(df: DataFrame, p_field: str) -> DataFrame:
    """Bonferroni and Benjamini-Hochberg over all rows of a table. Ranks come from the counts of distinct p-values, so no task holds the table."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.isnan(p_field) | F.col(p_field).isNull(), 1.0).otherwise(F.col(p_field))))
    df = materialize(df.withColumn(p_field, p), "tests")  # read three times below
    counts = df.groupBy(F.col(p_field).alias("p")).agg(F.count("*").alias("n")).withColumn("all", F.lit(0))
    ranked = range_prefix(counts, ["all"], ["p"], ["n"], label="ranks")
    total = df.agg(F.count("*").alias("m"))
    scaled = ranked.crossJoin(F.broadcast(total)).select("p", "m", (F.col("p") * F.col("m") / F.col("n_upto")).alias("q"))
    adjusted = running_least(scaled, "p", "q", label="fdr").select(F.col("p").alias(p_field), "m", F.least(F.lit(1.0), "q_least").alias("p_value_bh_fdr"))
    flag = lambda c: F.when(c < 0.05, "true").otherwise("false")
    out = df.join(adjusted, p_field).withColumn("p_value_bonferroni", F.least(F.lit(1.0), F.col(p_field) * F.col("m")))
    return out.withColumns(
        {"significant_nominal_0_05": flag(F.col(p_field)), "significant_bonferroni_0_05": flag(F.col("p_value_bonferroni")), "significant_bh_fdr_0_05": flag(F.col("p_value_bh_fdr"))}
    ).select(*df.columns, "p_value_bonferroni", "p_value_bh_fdr", "significant_nominal_0_05", "significant_bonferroni_0_05", "significant_bh_fdr_0_05")


def paired_outcomes(labels: DataFrame, pairs: DataFrame, confidence: float = 0.95) -> DataFrame:
    """2 x 2 counts, sign test and interval per pair, axis and possible outcome.

    Cells are counted per (teacher label, student label); the outcomes of a group are its candidates, targets and
    labels, each gathered as distinct values. Outcomes meet the counted label pairs, not the cells.
    """
    both = matched(cells(labels, "label", "target", "candidates"), pairs, "label", "target", "candidates")
    group = [*PAIR, *AXIS]
    moves = both.groupBy(*group, "t_label", "s_label").agg(F.count("*").alias("n"))
    support = F.array_union(L.outcome_support(F.col("t_candidates"), F.col("t_target"), F.col("t_label")), L.outcome_support(F.col("s_candidates"), F.col("s_target"), F.col("s_label")))
    outcomes = both.select(*group, F.explode(support).alias("outcome_label")).distinct()
    # Every outcome needs the group's total and the moves that touch it; a move touches at most two outcomes.
    totals = moves.groupBy(*group).agg(F.sum("n").alias("paired_n"))
    t, s = F.col("t_label"), F.col("s_label")
    touched = moves.select(*group, "n", F.explode(F.when(t == s, F.array(F.struct(t.alias("outcome_label"), F.lit("both").alias("side")))).otherwise(F.array(F.struct(t.alias("outcome_label"), F.lit("t").alias("side")), F.struct(s.alias("outcome_label"), F.lit("s").alias("side"))))).alias("x"))
    part = lambda side: F.coalesce(F.sum(F.when(F.col("x.side") == side, F.col("n"))), F.lit(0))
    hits = touched.groupBy(*group, F.col("x.outcome_label").alias("outcome_label")).agg(part("both").alias("both_positive"), part("t").alias("teacher_only"), part("s").alias("student_only"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    rows = outcomes.join(totals, group).join(hits, [*group, "outcome_label"], "left").select(*group, "outcome_label", "paired_n", zero("both_positive"), zero("teacher_only"), zero("student_only"))
    n, so, to = F.col("paired_n"), F.col("student_only"), F.col("teacher_only")
    low, high = S.paired_delta_interval(n, so, to, confidence)
    rows = rows.withColumns({"both_negative": n - F.col("both_positive") - to - so, "teacher_successes": F.col("both_positive") + to, "student_successes": F.col("both_positive") + so})
    rows = rows.withColumns(
        {
            "teacher_rate": F.col("teacher_successes") / n, "student_rate": F.col("student_successes") / n, "delta_student_minus_teacher": (so - to) / n, "delta_ci_low": low, "delta_ci_high": high,
            "agreement_rate": (n - so - to) / n, "discordant_n": to + so, "exact_sign_p_value": S.sign_test_p(so, to), "effect_direction": F.when(so > to, "student_higher").when(so < to, "teacher_higher").otherwise("no_change"),
        }
    )
    return multiple_testing(rows, "exact_sign_p_value")


def residual_transport(labels: DataFrame, pairs: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Teacher to student label transitions against the student's marginal."""
    both = matched(cells(labels, "label"), pairs, "label")
    group = [*PAIR, *AXIS]
    moves = both.groupBy(*group, F.col("t_label").alias("teacher_label"), F.col("s_label").alias("student_label")).agg(F.count("*").alias("transition_count"))
    over = lambda *c: F.sum("transition_count").over(Window.partitionBy(*group, *c))
    wide = moves.withColumns({"teacher_label_count": over("teacher_label"), "of_student": over("student_label"), "total": over()})
    c, d, n = F.col("transition_count"), F.col("teacher_label_count"), F.col("total")
    m, g, r, se = F.col("m_ij"), F.col("student_marginal"), F.col("residual"), F.col("residual_se")
    wide = wide.withColumns({"m_ij": c / d, "student_marginal": F.col("of_student") / n}).withColumn("residual", m - g)
    wide = wide.withColumn("residual_se", F.sqrt(F.greatest(F.lit(0.0), m * (1 - m) / d + g * (1 - g) / n)))
    z = S.z_of(confidence)
    low, high = S.wilson(c, d, S.PARAMS.confidence)
    wide = wide.withColumns({"residual_ci_low": F.greatest(F.lit(-1.0), r - z * se), "residual_ci_high": F.least(F.lit(1.0), r + z * se), "residual_z": F.when(se > 0, r / se).otherwise(0.0), "teacher_label_wilson_low": low, "teacher_label_wilson_high": high})
    wide = wide.withColumn("residual_p_value", F.when(se > 0, S.two_sided_p(F.col("residual_z"))).otherwise(1.0))
    return multiple_testing(wide.drop("of_student", "total"), "residual_p_value")


def _distribution_arrays(faced: DataFrame) -> DataFrame:
    """Per pair and axis the two distributions as arrays in label order; as long as the axis has labels."""
    both = F.sort_array(F.collect_list(F.struct("label", "p", "q")))
    return faced.groupBy(*PAIR, *AXIS).agg(F.max("t_n").alias("teacher_n"), F.max("s_n").alias("student_n"), F.max("k").alias("support_size"), both.alias("d")).withColumns({"ps": F.col("d.p"), "qs": F.col("d.q")}).drop("d")


def _to_prediction(alpha: Column) -> dict[str, Column]:
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)
    raised = F.transform("ps", lambda x: F.pow(x, alpha))
    pred = F.transform(raised, lambda x: x / total(raised))
    part = lambda f: total(F.zip_with("qs", pred, f))
    return {"tv_student_to_pred": part(S.tv_part), "js_student_to_pred": part(S.js_part), "hellinger_student_to_pred": F.sqrt(part(S.hellinger_part))}


def sharpening_fits(faced: DataFrame, roles: L.Roles = L.ROLES, m: S.MetricParams = S.PARAMS) -> DataFrame:
    use = faced.filter(F.col("benchmark").isin(*roles.fit_on) & F.col("condition_type").isin("broad", "benchmark_native") & (F.col("k") >= 2) & (F.col("t_n") >= 4) & (F.col("s_n") >= 4))
    a = _distribution_arrays(use)
    floored = F.transform("ps", lambda x: F.greatest(x, F.lit(m.floor)))
    total = F.aggregate(floored, F.lit(0.0), lambda t, x: t + x)
    a = a.withColumn("logs", F.transform(floored, lambda x: F.log(x / total)))
    a = a.withColumn("alpha", S.fitted_alpha(F.col("logs"), F.col("qs"), m))
    raised = F.transform("logs", lambda x: F.exp(F.col("alpha") * x))
    norm = F.aggregate(raised, F.lit(0.0), lambda t, x: t + x)
    a = a.withColumn("pred", F.transform(raised, lambda x: x / norm))
    part = lambda f: F.aggregate(F.zip_with("qs", "pred", f), F.lit(0.0), lambda t, x: t + x)
    return a.select(*PAIR, *AXIS, "teacher_n", "student_n", "support_size", "alpha", part(S.kl_part).alias("kl_student_to_pred"), part(S.tv_part).alias("tv_student_to_pred"), part(S.js_part).alias("js_student_to_pred"), F.sqrt(part(S.hellinger_part)).alias("hellinger_student_to_pred"))


def alpha_by_pair(fits: DataFrame) -> DataFrame:
    return fits.groupBy("comparison_id").agg(F.median("alpha").alias("alpha_from_fit"))


def sharpening_transfer(faced: DataFrame, alphas: DataFrame, roles: L.Roles = L.ROLES) -> DataFrame:
    a = _distribution_arrays(faced.filter(F.col("benchmark").isin(*roles.transfer_to) & (F.col("k") >= 2))).join(small(alphas), "comparison_id")
    return a.select(*PAIR, *AXIS, "alpha_from_fit", "teacher_n", "student_n", "support_size", *[c.alias(n) for n, c in _to_prediction(F.col("alpha_from_fit")).items()])


def preference_capability(labels: DataFrame, pairs: DataFrame, broad_drop_min: float = 0.15, explicit_loss_min: float = 0.15, recovery_tolerance: float = 0.10) -> DataFrame:
    """Broad against explicit rates per pair, axis and target, and what a drop points to.

    Rows are first counted per (model, axis, side, target, label, success). A target's rates are sums over an axis that do not
    depend on it (rows, successes by score or by the label 'pass'), rows labelled with it, and rows aimed at it: targets meet
    only those sums, by equal keys, never all labels of their axis.
    """
    side = F.when(F.col("condition_type").isin(*L.BROAD_SIDE), "broad").when(F.col("condition_type").isin(*L.EXPLICIT_SIDE), "explicit")
    passed = F.when(F.col("passed").isNotNull(), L.at_least(F.col("passed"), 0.5))
    counted = labels.withColumn("side", side).filter("side is not null").groupBy("model_id", "benchmark", "axis_id", "side", "target", "label", passed.alias("ok")).agg(F.count("*").alias("n"))
    targets = labels.filter("target <> ''").select("benchmark", "axis_id", F.col("target").alias("target_behavior")).distinct()
    n, axis = F.col("n"), ["model_id", "benchmark", "axis_id"]
    pick = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0))
    broad, explicit, said_pass = F.col("side") == "broad", F.col("side") == "explicit", F.col("label") == "pass"
    counted = materialize(counted, "counted")  # read four times
    whole = counted.groupBy(*axis).agg(pick(broad).alias("broad_n"), pick(explicit).alias("all_n"), pick(explicit & F.coalesce("ok", said_pass)).alias("base_hit"))
    by_label = counted.groupBy(*axis, F.col("label").alias("target_behavior")).agg(pick(broad).alias("broad_hit"), pick(explicit & F.col("ok").isNull() & ~said_pass).alias("label_hit"))
    by_target = counted.groupBy(*axis, F.col("target").alias("target_behavior")).agg(pick(explicit).alias("own_n"), pick(explicit & F.coalesce("ok", said_pass | (F.col("label") == F.col("target")))).alias("own_hit"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    met = whole.join(targets, ["benchmark", "axis_id"]).join(by_label, [*axis, "target_behavior"], "left").join(by_target, [*axis, "target_behavior"], "left")
    rates = met.select(*axis, "target_behavior", "broad_n", zero("broad_hit").alias("broad_hit"), "all_n", (F.col("base_hit") + zero("label_hit")).alias("all_hit"), zero("own_n").alias("own_n"), zero("own_hit").alias("own_hit"))
    has_own = F.col("own_n") > 0
    rates = rates.withColumns({"explicit_n": F.when(has_own, F.col("own_n")).otherwise(F.col("all_n")), "explicit_hit": F.when(has_own, F.col("own_hit")).otherwise(F.col("all_hit"))}).filter("broad_n > 0 and explicit_n > 0")
    rates = rates.select("model_id", "benchmark", "axis_id", "target_behavior", (F.col("broad_hit") / F.col("broad_n")).alias("broad_rate"), (F.col("explicit_hit") / F.col("explicit_n")).alias("explicit_rate"), "broad_n", "explicit_n")
    few, key = small(pairs), ["benchmark", "axis_id", "target_behavior"]
    value = ("broad_rate", "explicit_rate", "broad_n", "explicit_n")
    t = rates.join(few, F.col("model_id") == F.col("teacher_model_id")).select(*PAIR, *key, *[F.col(v).alias(f"teacher_{v}") for v in value])
    s = rates.join(few, F.col("model_id") == F.col("student_model_id")).select("comparison_id", *key, *[F.col(v).alias(f"student_{v}") for v in value])
    d = t.join(s, ["comparison_id", *key]).withColumns({"broad_drop": F.col("teacher_broad_rate") - F.col("student_broad_rate"), "explicit_drop": F.col("teacher_explicit_rate") - F.col("student_explicit_rate")})
    kind = F.when(F.col("broad_drop") >= broad_drop_min, F.when(F.col("explicit_drop") <= recovery_tolerance, "preference_shift").when(F.col("explicit_drop") >= explicit_loss_min, "capability_or_information_loss"))
    return d.withColumn("classification", F.coalesce(kind, F.lit("stable_or_ambiguous")))


def complexity_by_axis(labels: DataFrame) -> DataFrame:
    """The most frequent complexity level per axis; of equally frequent ones the first seen."""
    counts = labels.groupBy(*AXIS, "complexity_level").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    return counts.groupBy(*AXIS).agg(F.max_by("complexity_level", F.struct("n", (-F.col("first")).alias("first"))).alias("complexity_level"))


def survival_features(faced: DataFrame, complexity: DataFrame) -> DataFrame:
    ratio = F.when(F.col("p") > 0, F.col("q") / F.col("p")).otherwise(F.lit(float("nan")))
    return faced.join(complexity, AXIS).select(*PAIR, *AXIS, "complexity_level", F.col("label").alias("behavior"), F.col("p").alias("teacher_frequency"), F.col("q").alias("student_frequency"), ratio.alias("retention_ratio"), F.col("t_n").alias("teacher_n"), F.col("s_n").alias("student_n"))


def _rank_sums(df: DataFrame, x: str, y: str) -> DataFrame:
    """Per pair the Pearson correlation of average ranks, 0 where a side is constant."""

    def ranks(column: str) -> DataFrame:
        counts = df.groupBy("comparison_id", column).agg(F.count("*").alias("n"))
        upto = range_prefix(counts, ["comparison_id"], [column], ["n"], label="spearman")
        return upto.select("comparison_id", column, (F.col("n_upto") - (F.col("n") - 1) / 2).alias(f"rank_{column}"))

    r = df.join(ranks(x), ["comparison_id", x]).join(ranks(y), ["comparison_id", y])
    a, b = f"rank_{x}", f"rank_{y}"
    # Population covariance over spreads; corr() raises on a constant side.
    s = r.groupBy("comparison_id").agg(F.covar_pop(a, b).alias("c"), F.stddev_pop(a).alias("sa"), F.stddev_pop(b).alias("sb"))
    return s.select("comparison_id", F.when((F.col("sa") > 0) & (F.col("sb") > 0), F.try_divide("c", F.col("sa") * F.col("sb"))).otherwise(0.0).alias(f"spearman_{x}_vs_{y}"))


def survival_summary(features: DataFrame) -> DataFrame:
    """Per pair: cells, rank correlations of teacher frequency and complexity with retention."""
    use = features.filter(~F.isnan("retention_ratio")).select("comparison_id", "teacher_frequency", F.col("retention_ratio").alias("retention"), L.complexity_rank(F.col("complexity_level")).cast("double").alias("complexity"))
    n = use.groupBy("comparison_id").agg(F.count("*").alias("n_behavior_cells"))
    return n.join(_rank_sums(use, "teacher_frequency", "retention"), "comparison_id").join(_rank_sums(use, "complexity", "retention"), "comparison_id")


def retention_by_complexity(features: DataFrame) -> DataFrame:
    return features.filter(~F.isnan("retention_ratio")).groupBy("comparison_id", "complexity_level").agg(F.avg("retention_ratio").alias("mean_retention"))
