"""Queries of the paired-model analysis tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlens import config
from twinlens import sql_parts as Q
from twinlens.functions import labels as L
from twinlens.functions import stats as S
from twinlens.operators import analysis as A
from twinlens.session import materialize, table

DIGITS = 9
NUDGE = 1e-12


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


def pairs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config.selected_pairs(table(spark, sf_dir, "model_pairs"), "all")


def all_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.labelled(table(spark, sf_dir, "label_rows"))


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.kept_rows(all_labels(spark, sf_dir))


def faced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.facing(A.histogram(kept(spark, sf_dir)), pairs_of(spark, sf_dir))


def behavior_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.typed(table(spark, sf_dir, "label_rows"))
    return rows.groupBy("benchmark", "condition_type", "label").agg(F.count("*").alias("rows"))


def distribution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.distribution_summary(A.histogram(kept(spark, sf_dir))))


def quality_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.quality_by_model(all_labels(spark, sf_dir)))


def quality_pair_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.quality_pair_balance(all_labels(spark, sf_dir), pairs_of(spark, sf_dir)))


def pairwise_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.pairwise_shift(faced(spark, sf_dir)))


def pairwise_shift_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    from twinlens.operators.models import bootstrap_shift

    return bootstrap_shift(faced(spark, sf_dir))


def paired_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.paired_outcomes(kept(spark, sf_dir), pairs_of(spark, sf_dir))
    # Exact binomial tails lie halfway between two roundings; a nudge takes all of them up in either engine.
    return rounded(out.withColumns({c: F.col(c) + NUDGE for c in ("exact_sign_p_value", "p_value_bonferroni", "p_value_bh_fdr")}))


def residual_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.residual_transport(kept(spark, sf_dir), pairs_of(spark, sf_dir)))


def sharpening_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.sharpening_fits(faced(spark, sf_dir)), 6)


def sharpening_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = materialize(faced(spark, sf_dir), "faced")
    return rounded(A.sharpening_transfer(both, A.alpha_by_pair(A.sharpening_fits(both))), 6)


def preference_capability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.preference_capability(kept(spark, sf_dir), pairs_of(spark, sf_dir)))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(kept(spark, sf_dir), "kept")
    return A.survival_features(A.facing(A.histogram(rows), pairs_of(spark, sf_dir)), A.complexity_by_axis(rows))


def survival_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_features(spark, sf_dir))


def survival_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.survival_summary(materialize(_features(spark, sf_dir), "features")))


def retention_by_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.retention_by_complexity(_features(spark, sf_dir)))


def survival_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    from twinlens.operators.models import survival_regression as fit

    return rounded(fit(_features(spark, sf_dir)), 6)


QUERIES = {
    f.__name__: f
    for f in (
        behavior_labels, distribution_summary, quality_by_model, quality_pair_balance, pairwise_shift, pairwise_shift_ci, paired_outcomes, residual_transport, sharpening_fits, sharpening_transfer, preference_capability,
        survival_features, survival_summary, retention_by_complexity, survival_regression,
    )
}

_Z = S.z_of(0.95)
_DIST_PARTS = """sum(case when p > 0 then -p * ln(p) else 0 end) as ht, sum(case when q > 0 then -q * ln(q) else 0 end) as hs, sum(abs(p - q)) / 2 as tv,
  sum(case when p > 0 then p * ln(2 * p / (p + q)) / 2 else 0 end + case when q > 0 then q * ln(2 * q / (p + q)) / 2 else 0 end) as js, sqrt(sum(pow(sqrt(p) - sqrt(q), 2)) / 2) as hell"""
_TO_PRED = """round(sum(abs(q - pred)) / 2, 6) as tv_student_to_pred,
  round(sum(case when q > 0 then q * ln(2 * q / (pred + q)) / 2 else 0 end + case when pred > 0 then pred * ln(2 * pred / (pred + q)) / 2 else 0 end), 6) as js_student_to_pred, round(sqrt(sum(pow(sqrt(pred) - sqrt(q), 2)) / 2), 6) as hellinger_student_to_pred"""
_FIT = f"""with recursive {Q.LAB}, {Q.FACED},
use as (select *, greatest(p, 1e-12) as pf from faced where {Q.in_list("benchmark", L.ROLES.fit_on)} and condition_type in ('broad', 'benchmark_native') and k >= 2 and t_n >= 4 and s_n >= 4),
logs as (select *, ln(pf / sum(pf) over (partition by comparison_id, {Q.AXIS})) as lp from use),
start as (select comparison_id, {Q.AXIS}, list(lp order by label) as l, sum(q * lp) as target from logs group by all),
search as (select *, 0 as i, 0.05::double as lo, 20.0::double as hi from start
  union all select comparison_id, {Q.AXIS}, l, target, i + 1, case when low then mid else lo end, case when low then hi else mid end from (
    select *, list_sum(list_transform(l, lambda x: x * exp(mid * x))) / list_sum(list_transform(l, lambda x: exp(mid * x))) < target - 1e-9 as low from (select *, (lo + hi) / 2 as mid from search where i < 60))),
alphas as (select comparison_id, {Q.AXIS}, (lo + hi) / 2 as alpha from search where i = 60)"""
_RATES = """sum(case when side = 'broad' then 1 else 0 end) as bn, sum(case when side = 'broad' and label = tb then 1 else 0 end) as bh, sum(case when side = 'explicit' then 1 else 0 end) as an,
  sum(case when side = 'explicit' and ok then 1 else 0 end) as ah, sum(case when side = 'explicit' and target = tb then 1 else 0 end) as onn, sum(case when side = 'explicit' and target = tb and ok then 1 else 0 end) as oh"""
_FEATURES = f"""{Q.LAB}, {Q.FACED},
lev as (select {Q.AXIS}, complexity_level, count(*) as n, min(ord) as f from kept group by all),
cx as (select {Q.AXIS}, complexity_level from lev qualify row_number() over (partition by {Q.AXIS} order by n desc, f) = 1),
feat as (select comparison_id, family, benchmark, axis_id, condition_type, complexity_level, label as behavior, p, q, case when p > 0 then q / p else 'nan'::double end as ratio, t_n, s_n from faced join cx using ({Q.AXIS}))"""
_RANK = "case when complexity_level = 'atomic' then 0.0 when complexity_level in ('relational', 'safety_benign', 'bias') then 1.0 when complexity_level in ('compositional', 'safety_unsafe', 'memorization') then 2.0 else 3.0 end"


def _spearman(x: str, y: str) -> str:
    return f"case when stddev_pop({x}) > 0 and stddev_pop({y}) > 0 then covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) else 0.0 end"


SQL = {
    "behavior_labels": f"with {Q.LAB} select benchmark, condition_type, label, count(*) as rows from lab group by all",
    "distribution_summary": f"""with {Q.LAB}, {Q.HIST},
w as (select *, sum(n) over g as tot, count(*) over g as k from hist window g as (partition by model_id, {Q.AXIS}))
select model_id, {Q.AXIS}, label, n as count, round(n / tot, 9) as probability, tot::bigint as n, round(case when k > 1 then sum(-(n / tot) * ln(n / tot)) over (partition by model_id, {Q.AXIS}) / ln(k) else 0 end, 9) as normalized_entropy from w""",
    "quality_by_model": f"""with {Q.LAB}
select model_id, benchmark, condition_type, count(*) as rows, count_if(quality is not null and (not (quality < 3.0 and not isnan(quality)) or label = 'refusal')) as kept_rows, count_if(quality is null) as missing_quality_rows,
  count_if(quality < 3.0 and not isnan(quality)) as low_quality_rows, round(coalesce(avg(quality), 0.0), 9) as mean_quality from labelled group by all""",
    "quality_pair_balance": f"""with {Q.LAB}, qq as (select * from labelled where quality is not null), {Q.both("qq", "quality")},
a as (select comparison_id, family, benchmark, condition_type, count(*) as n, avg(t_quality) as tm, avg(s_quality) as sm, avg(abs(t_quality - s_quality)) as d, max(abs(t_quality - s_quality)) as dm from both_sides group by all)
select comparison_id, family, benchmark, condition_type, n as matched_quality_cells, round(tm, 9) as teacher_mean_quality, round(sm, 9) as student_mean_quality, round(d, 9) as mean_abs_quality_delta, round(dm, 9) as max_abs_quality_delta, case when d > 0.25 then 'true' else 'false' end as exceeds_config_delta from a""",
    "pairwise_shift": f"""with {Q.LAB}, {Q.FACED},
d as (select comparison_id, family, {Q.AXIS}, max(t_n)::bigint as teacher_n, max(s_n)::bigint as student_n, max(k) as k, {_DIST_PARTS} from faced group by all),
e as (select *, case when k > 1 then ht / ln(k) else 0 end as te, case when k > 1 then hs / ln(k) else 0 end as se from d)
select comparison_id, family, {Q.AXIS}, teacher_n, student_n, round(te, 9) as teacher_entropy, round(se, 9) as student_entropy, round(se - te, 9) as entropy_delta_student_minus_teacher, round(tv, 9) as total_variation, round(js, 9) as js_divergence, round(hell, 9) as hellinger from e""",
    "paired_outcomes": f"""with {Q.LAB}, {Q.both("kept", "label", "target", "candidates")},
g as (select comparison_id, family, {Q.AXIS}, count(*) as n from both_sides group by all),
sup as (select distinct comparison_id, family, {Q.AXIS}, {Q.strip("o")} as o from (select comparison_id, family, {Q.AXIS}, unnest(list_concat(t_candidates, s_candidates, [t_target, s_target, t_label, s_label])) as o from both_sides)),
cnt as (select g.comparison_id, g.family, g.benchmark, g.axis_id, g.condition_type, o as outcome_label, g.n as paired_n, count_if(t_label = o and s_label = o) as bp, count_if(t_label <> o and s_label <> o) as bn, count_if(t_label = o and s_label <> o) as too, count_if(t_label <> o and s_label = o) as so
  from g join sup using (comparison_id, family, {Q.AXIS}) join both_sides using (comparison_id, family, {Q.AXIS}) where o <> '' group by all),
st as (select *, too + so as d, least(too, so)::bigint as k, (so - too) / paired_n as delta from cnt),
pv as (select *, case when d = 0 then 1.0 when d <= 2000 then least(1.0, 2 * list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(d + 1) - lgamma(i + 1) - lgamma(d - i + 1) + d * ln(0.5))))) else least(1.0, 2 * {Q.cdf("((k + 0.5 - d / 2) / sqrt(d / 4))")}) end as pp,
  case when paired_n <= 1 then 0 else {_Z} * sqrt((so * pow(1 - delta, 2) + too * pow(1 + delta, 2) + (paired_n - so - too) * delta * delta) / (paired_n - 1) / paired_n) end as mg from st),
{Q.tested("pv", "pp")}
select comparison_id, family, {Q.AXIS}, outcome_label, paired_n, bp as both_positive, too as teacher_only, so as student_only, bn as both_negative, bp + too as teacher_successes, bp + so as student_successes, round((bp + too) / paired_n, 9) as teacher_rate, round((bp + so) / paired_n, 9) as student_rate,
  round(delta, 9) as delta_student_minus_teacher, round(greatest(-1.0, delta - mg), 9) as delta_ci_low, round(least(1.0, delta + mg), 9) as delta_ci_high, round((bp + bn) / paired_n, 9) as agreement_rate, d as discordant_n, round(pp + {NUDGE}, 9) as exact_sign_p_value,
  case when so > too then 'student_higher' when so < too then 'teacher_higher' else 'no_change' end as effect_direction, round(p_value_bonferroni + {NUDGE}, 9) as p_value_bonferroni, round(p_value_bh_fdr + {NUDGE}, 9) as p_value_bh_fdr, {Q.FLAGS.format(p="pp")} from fdr""",
    "residual_transport": f"""with {Q.LAB}, {Q.both("kept", "label")},
mv as (select comparison_id, family, {Q.AXIS}, t_label as teacher_label, s_label as student_label, count(*) as c from both_sides group by all),
w as (select *, sum(c) over (partition by comparison_id, {Q.AXIS}, teacher_label) as d, sum(c) over (partition by comparison_id, {Q.AXIS}, student_label) as os, sum(c) over (partition by comparison_id, {Q.AXIS}) as n from mv),
r as (select *, c / d as m, os / n as g, c / d - os / n as res from w),
e as (select *, sqrt(greatest(0.0, m * (1 - m) / d + g * (1 - g) / n)) as se from r),
z as (select *, case when se > 0 then res / se else 0.0 end as zz, (m + {_Z * _Z} / (2 * d)) as ctr, {_Z} * sqrt(m * (1 - m) / d + {_Z * _Z} / (4 * d * d)) as spr from e),
pz as (select *, case when se > 0 then 1 - {Q.erf("(abs(zz) / sqrt(2.0))")} else 1.0 end as pp from z),
{Q.tested("pz", "pp")}
select comparison_id, family, {Q.AXIS}, teacher_label, student_label, c as transition_count, d::bigint as teacher_label_count, round(m, 9) as m_ij, round(g, 9) as student_marginal, round(res, 9) as residual, round(se, 9) as residual_se, round(greatest(-1.0, res - {_Z} * se), 9) as residual_ci_low,
  round(least(1.0, res + {_Z} * se), 9) as residual_ci_high, round(zz, 9) as residual_z, round(greatest(0.0, (ctr - spr) / (1 + {_Z * _Z} / d)), 9) as teacher_label_wilson_low, round(least(1.0, (ctr + spr) / (1 + {_Z * _Z} / d)), 9) as teacher_label_wilson_high, round(pp, 9) as residual_p_value,
  round(p_value_bonferroni, 9) as p_value_bonferroni, round(p_value_bh_fdr, 9) as p_value_bh_fdr, {Q.FLAGS.format(p="pp")} from fdr""",
    "sharpening_fits": f"""{_FIT},
pr as (select l.*, alpha, exp(alpha * lp) / sum(exp(alpha * lp)) over (partition by comparison_id, {Q.AXIS}) as pred from logs l join alphas using (comparison_id, {Q.AXIS}))
select comparison_id, family, {Q.AXIS}, max(t_n)::bigint as teacher_n, max(s_n)::bigint as student_n, max(k) as support_size, round(max(alpha), 6) as alpha, round(sum(case when q > 0 then q * ln(q / pred) else 0 end), 6) as kl_student_to_pred, {_TO_PRED} from pr group by all""",
    "sharpening_transfer": f"""{_FIT},
med as (select comparison_id, median(alpha) as a from alphas group by all),
pr as (select f.*, a, pow(p, a) / sum(pow(p, a)) over (partition by comparison_id, {Q.AXIS}) as pred from faced f join med using (comparison_id) where k >= 2 and {Q.in_list("benchmark", L.ROLES.transfer_to)})
select comparison_id, family, {Q.AXIS}, round(max(a), 6) as alpha_from_fit, max(t_n)::bigint as teacher_n, max(s_n)::bigint as student_n, max(k) as support_size, {_TO_PRED} from pr group by all""",
    "preference_capability": f"""with {Q.LAB},
tg as (select distinct benchmark, axis_id, target as tb from kept where target <> ''),
x as (select model_id, benchmark, axis_id, tb, target, label, case when {Q.in_list("condition_type", L.BROAD_SIDE)} then 'broad' when {Q.in_list("condition_type", L.EXPLICIT_SIDE)} then 'explicit' end as side, case when ps is not null then ps >= 0.5 and not isnan(ps) else label = tb or label = 'pass' end as ok from kept join tg using (benchmark, axis_id)),
r as (select model_id, benchmark, axis_id, tb, {_RATES} from x where side is not null group by all),
v as (select model_id, benchmark, axis_id, tb, bn::bigint as bn, bh / bn as br, (case when onn > 0 then onn else an end)::bigint as en, case when onn > 0 then oh / onn else ah / an end as er from r where bn > 0 and an > 0),
d as (select comparison_id, family, t.benchmark, t.axis_id, t.tb, t.br as tbr, s.br as sbr, t.er as ter, s.er as ser, t.br - s.br as bd, t.er - s.er as ed, t.bn as tbn, s.bn as sbn, t.en as ten, s.en as sen
  from pairs join v t on t.model_id = teacher_model_id join v s on s.model_id = student_model_id and t.benchmark = s.benchmark and t.axis_id = s.axis_id and t.tb = s.tb)
select comparison_id, family, benchmark, axis_id, tb as target_behavior, round(tbr, 9) as teacher_broad_rate, round(ter, 9) as teacher_explicit_rate, tbn as teacher_broad_n, ten as teacher_explicit_n, round(sbr, 9) as student_broad_rate, round(ser, 9) as student_explicit_rate, sbn as student_broad_n, sen as student_explicit_n,
  round(bd, 9) as broad_drop, round(ed, 9) as explicit_drop, case when bd >= 0.15 and ed <= 0.10 then 'preference_shift' when bd >= 0.15 and ed >= 0.15 then 'capability_or_information_loss' else 'stable_or_ambiguous' end as classification from d""",
    "survival_features": f"""with {_FEATURES}
select comparison_id, family, benchmark, axis_id, condition_type, complexity_level, behavior, round(p, 9) as teacher_frequency, round(q, 9) as student_frequency, round(ratio, 9) as retention_ratio, t_n::bigint as teacher_n, s_n::bigint as student_n from feat""",
    "survival_summary": f"""with {_FEATURES},
u as (select comparison_id, p, ratio, {_RANK} as c from feat where not isnan(ratio)),
rk as (select comparison_id, rank() over (partition by comparison_id order by p) + (count(*) over (partition by comparison_id, p) - 1) / 2 as rp, rank() over (partition by comparison_id order by ratio) + (count(*) over (partition by comparison_id, ratio) - 1) / 2 as rr,
  rank() over (partition by comparison_id order by c) + (count(*) over (partition by comparison_id, c) - 1) / 2 as rc from u)
select comparison_id, count(*) as n_behavior_cells, round({_spearman("rp", "rr")}, 9) as spearman_teacher_frequency_vs_retention, round({_spearman("rc", "rr")}, 9) as spearman_complexity_vs_retention from rk group by all""",
    "retention_by_complexity": f"with {_FEATURES} select comparison_id, complexity_level, round(avg(ratio), 9) as mean_retention from feat where not isnan(ratio) group by all",
}
