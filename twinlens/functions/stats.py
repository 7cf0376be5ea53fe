"""Distances between distributions, test probabilities and intervals, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of the error function's series; exact to double precision for |z| up to 8, beyond which the tail is below 1e-15.
ERF_TERMS = 220


@dataclass(frozen=True)
class MetricParams:
    """Choices that the published definition leaves open, in one place."""

    alpha_low: float = 0.05
    alpha_high: float = 20.0
    floor: float = 1e-12
    bisections: int = 60
    flat: float = 1e-9  # slopes smaller than this are flat; of a flat stretch the smallest exponent is taken
    confidence: float = 0.95


PARAMS = MetricParams()


def z_of(confidence: float) -> float:
    return NormalDist().inv_cdf(0.5 + confidence / 2)


def erf_positive(x: Column) -> Column:
    """erf for x >= 0 by the all-positive series exp(-x^2) * sum x^(2n+1) / Gamma(n + 3/2), in the JVM."""
    start = F.struct((x * 1.1283791670955126).alias("term"), F.lit(0.0).alias("total"))
    out = F.aggregate(F.sequence(F.lit(1), F.lit(ERF_TERMS)), start, lambda a, n: F.struct((a["term"] * x * x / (n + 0.5)).alias("term"), (a["total"] + a["term"]).alias("total")))
    return F.when(x > 5.9, 1.0).otherwise(F.least(F.lit(1.0), F.exp(-x * x) * out["total"]))


def normal_cdf(z: Column) -> Column:
    tail = erf_positive(F.abs(z) / (2**0.5))
    return F.when(z >= 0, 0.5 + 0.5 * tail).otherwise(0.5 - 0.5 * tail)


def two_sided_p(z: Column) -> Column:
    """2 (1 - Phi(|z|))."""
    return 1 - erf_positive(F.abs(z) / (2**0.5))


def sign_test_p(student_only: Column, teacher_only: Column, exact_up_to: int = 2000) -> Column:
    """Two-sided sign test: the exact binomial tail, summed from its largest term down; a normal with continuity correction for many discordant pairs."""
    d, k = student_only + teacher_only, F.least(student_only, teacher_only).cast("int")
    steps = F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
    log_top = F.aggregate(steps, F.lit(0.0), lambda a, i: a + F.log((d - i + 1) / i)) + d * F.log(F.lit(0.5))
    down = F.aggregate(F.reverse(steps), F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")), lambda a, i: F.struct((a["term"] * i / (d - i + 1)).alias("term"), (a["total"] + a["term"] * i / (d - i + 1)).alias("total")))
    exact = F.exp(log_top) * down["total"]
    approximate = normal_cdf((k + 0.5 - d / 2) / F.sqrt(F.greatest(d, F.lit(1)) / 4))
    tail = F.when(d <= exact_up_to, exact).otherwise(approximate)
    return F.when(d == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * tail)))


def paired_delta_interval(n: Column, student_only: Column, teacher_only: Column, confidence: float) -> tuple[Column, Column]:
    """Wald interval of a paired difference of rates, inside [-1, 1]; the difference itself where n <= 1."""
    delta = F.coalesce(F.try_divide(student_only - teacher_only, n), F.lit(0.0))
    rest = n - student_only - teacher_only
    variance = F.try_divide(student_only * F.pow(1 - delta, F.lit(2)) + teacher_only * F.pow(1 + delta, F.lit(2)) + rest * delta * delta, n - 1)
    margin = z_of(confidence) * F.sqrt(variance / n)
    return F.when(n <= 1, delta).otherwise(F.greatest(F.lit(-1.0), delta - margin)), F.when(n <= 1, delta).otherwise(F.least(F.lit(1.0), delta + margin))


def wilson(count: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Wilson score interval of count / n, n > 0."""
    z = z_of(confidence)
    p = count / n
    centre, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.greatest(F.lit(0.0), (centre - spread) / (1 + z * z / n)), F.least(F.lit(1.0), (centre + spread) / (1 + z * z / n))


def entropy_part(p: Column) -> Column:
    """Summed over a distribution: its entropy in nats."""
    return F.when(p > 0, -p * F.log(p)).otherwise(0.0)


def normalized_entropy(entropy: Column, support: Column) -> Column:
    """Entropy over the logarithm of the support's size, zeros of the support included; 0 for one label."""
    return F.when(support > 1, entropy / F.log(support)).otherwise(0.0)


def tv_part(p: Column, q: Column) -> Column:
    return F.abs(p - q) / 2


def js_part(p: Column, q: Column) -> Column:
    """Summed: the Jensen-Shannon divergence in nats."""
    half = lambda a: F.when(a > 0, a * F.log(2 * a / (p + q)) / 2).otherwise(0.0)
    return half(p) + half(q)


def hellinger_part(p: Column, q: Column) -> Column:
    """Summed and rooted: the Hellinger distance."""
    return F.pow(F.sqrt(p) - F.sqrt(q), F.lit(2)) / 2


def kl_part(p: Column, q: Column) -> Column:
    return F.when(p > 0, p * F.log(p / q)).otherwise(0.0)


def fitted_alpha(logs: Column, weights: Column, m: MetricParams = PARAMS) -> Column:
    """The exponent of the teacher distribution that comes nearest to the student's (least KL), by bisection.

    logs: log teacher probabilities; weights: student probabilities, in the same order. The slope of the KL is the mean log under
    the sharpened teacher less the mean log under the student, and rises with alpha.
    """
    target = F.aggregate(F.zip_with(logs, weights, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)

    def mean_log(alpha: Column) -> Column:
        s = F.aggregate(logs, F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b")), lambda t, x: F.struct((t["a"] + x * F.exp(alpha * x)).alias("a"), (t["b"] + F.exp(alpha * x)).alias("b")))
        return s["a"] / s["b"]

    def step(bounds: Column, _: Column) -> Column:
        mid = (bounds["lo"] + bounds["hi"]) / 2
        low = mean_log(mid) < target - m.flat
        return F.struct(F.when(low, mid).otherwise(bounds["lo"]).alias("lo"), F.when(low, bounds["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(m.bisections)), F.struct(F.lit(m.alpha_low).alias("lo"), F.lit(m.alpha_high).alias("hi")), step)
    return (found["lo"] + found["hi"]) / 2


def proportion_half_width(n: Column, alpha: float, p: float) -> Column:
    return F.when(n > 0, NormalDist().inv_cdf(1 - alpha / 2) * F.sqrt(p * (1 - p) / n)).otherwise(F.lit(float("nan")))


def detectable_difference(n: Column, alpha: float, power: float, p: float) -> Column:
    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    return F.when(n > 0, z * F.sqrt(2 * p * (1 - p) / n)).otherwise(F.lit(float("nan")))


def resolution(mde: Column, n: Column, least: int) -> Column:
    return F.when((n < least) | F.isnan(mde), "underpowered").when(mde <= 0.02, "fine").when(mde <= 0.05, "moderate").otherwise("coarse")


def kappa(agree: Column, total: Column, chance: Column) -> Column:
    """Agreement beyond chance, chance from the pooled labels."""
    observed = agree / total
    return F.when(chance >= 1, F.when(observed >= 1, 1.0).otherwise(0.0)).otherwise((observed - chance) / (1 - chance))


def nearest_rank(values: Column, q: float) -> Column:
    """Value at the rank nearest to q (n - 1), halves to even; 0 for none."""
    return F.when(F.size(values) > 0, F.element_at(F.sort_array(values), F.bround(q * (F.size(values) - 1)).cast("int") + 1)).otherwise(0.0)
