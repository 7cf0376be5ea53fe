"""Resampling and regression on histograms: the parts that need Python, each on a bounded group."""

from __future__ import annotations

import hashlib
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.functions.labels import COMPLEXITY_RANK
from twinlens.functions.text import KEY_MARK
from twinlens.operators.analysis import AXIS, PAIR

METRICS = ("total_variation", "js_divergence", "hellinger", "entropy_delta")


def shift_metrics(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The four metrics of teacher rows p and student rows q, one row per pair of distributions."""
    with np.errstate(divide="ignore", invalid="ignore"):
        m = (p + q) / 2
        js = (np.where(p > 0, p * np.log(p / m), 0) + np.where(q > 0, q * np.log(q / m), 0)).sum(-1) / 2
        h = lambda x: -np.where(x > 0, x * np.log(x), 0).sum(-1)
        k = p.shape[-1]
        entropy = (h(q) - h(p)) / np.log(k) if k > 1 else np.zeros(p.shape[:-1])
    return np.stack([np.abs(p - q).sum(-1) / 2, js, np.sqrt(((np.sqrt(p) - np.sqrt(q)) ** 2).sum(-1) / 2), entropy], axis=-1)


def bootstrap_shift(faced: DataFrame, iterations: int = 2000, confidence: float = 0.95, seed: int = 20260904) -> DataFrame:
    """Percentile bootstrap intervals of the shift metrics, per pair and axis.

    Resampling n labels with replacement is a multinomial draw from the histogram, so a group is
    as large as its number of labels, whatever the number of rows. The generator is seeded
    from the seed and the group's name. At most one iteration gives 0 for every bound.
    """
    group = [*PAIR, *AXIS]
    names = [f"{m}_ci_{end}" for m in METRICS for end in ("low", "high")]

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("label")
        head = rows[group].iloc[[0]].reset_index(drop=True)
        bounds = np.zeros(len(names))
        if iterations > 1:
            salt = ":".join(head[c].iloc[0] for c in ("comparison_id", *AXIS))
            rng = np.random.default_rng(int(hashlib.sha1(f"{seed}{KEY_MARK}{salt}".encode()).hexdigest()[:8], 16))
            t, s = rows["t"].to_numpy(np.int64), rows["s"].to_numpy(np.int64)
            drawn = shift_metrics(rng.multinomial(t.sum(), t / t.sum(), iterations) / t.sum(), rng.multinomial(s.sum(), s / s.sum(), iterations) / s.sum())
            drawn.sort(axis=0)
            low = (1 - confidence) / 2
            at = [min(iterations - 1, max(0, round(q * (iterations - 1)))) for q in (low, 1 - low)]
            bounds = drawn[at].T.ravel()
        return pd.concat([head, pd.DataFrame([bounds], columns=names)], axis=1)

    schema = ", ".join([f"{c} string" for c in group] + [f"{n} double" for n in names])
    return faced.select(*group, "label", "t", "s").groupBy(*group).applyInPandas(draw, schema)


REGRESSION = "comparison_id string, family string, formula string, status string, term string, coefficient double, std_error double, t_stat double, p_value double, n bigint, df bigint, r_squared double, reference_benchmark string, interpretation string"


def fit_wls(gram: np.ndarray, moment: np.ndarray, yy: float, y: float, w: float, n: int) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Weighted least squares from its normal equations: coefficients, standard errors and R squared; None if singular or too few rows."""
    p = len(moment)
    if n <= p:
        return None
    try:
        if np.linalg.matrix_rank(gram) < p:
            return None
        inverse = np.linalg.inv(gram)
    except np.linalg.LinAlgError:
        return None
    beta = inverse @ moment
    sse = max(0.0, float(yy - 2 * beta @ moment + beta @ gram @ beta))
    sst = float(yy - y * y / w)
    return beta, np.sqrt(np.maximum(0, sse / (n - p) * np.diag(inverse))), 1 - sse / sst if sst > 0 else 0.0


#: What a coefficient says, by term and sign.
MEANING = {
    ("complexity_rank", False): "Complex behaviors survive less well than simple ones of the same frequency.",
    ("complexity_rank", True): "Complex behaviors survive at least as well as simple ones of the same frequency.",
    ("teacher_frequency", False): "Behaviors that the teacher shows often lose more than rare ones.",
    ("teacher_frequency", True): "Behaviors that the teacher shows often lose less than rare ones.",
    ("benchmark", False): "Survival on this benchmark is below the reference benchmark's.",
    ("benchmark", True): "Survival on this benchmark is not below the reference benchmark's.",
    ("intercept", False): "Log retention of a behavior of frequency and complexity 0 is negative.",
    ("intercept", True): "Log retention of a behavior of frequency and complexity 0 is not negative.",
}


def _meaning(term: str, beta: float, p: float) -> str:
    return f"{MEANING[term.split(':')[0], beta >= 0]} p = {p:.3g}."


def survival_regression(features: DataFrame) -> DataFrame:
    """Weighted regression of log retention on teacher frequency, complexity and benchmark, per pair.

    The rows are first summed in the JVM: per pair and benchmark the weighted moments of (1, frequency, complexity, y), so only
    pairs x benchmarks rows reach Python. While the equations are singular, the last benchmark term is dropped.
    """
    rank = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in COMPLEXITY_RANK.items() for x in (F.lit(k), F.lit(float(v)))]), F.col("complexity_level")), F.lit(3.0))
    f = F.col("teacher_frequency")
    use = features.filter((f > 0) & ~F.isnan("retention_ratio")).withColumns(
        {"one": F.lit(1.0), "c": rank, "f": f, "y": F.log(F.greatest(F.col("student_frequency"), F.lit(1e-12)) / F.greatest(f, F.lit(1e-12))), "w": F.greatest(F.lit(1.0), F.least("teacher_n", "student_n") * f)}
    )
    names = ("one", "f", "c", "y")
    products = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = use.groupBy(*PAIR, "benchmark").agg(F.count("*").alias("n"), *[F.sum(F.col("w") * F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in products])

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("benchmark")
        benchmarks = rows["benchmark"].tolist()
        total, n = rows.sum(numeric_only=True), int(rows["n"].sum())
        of = lambda a, b, r: float(r[f"{a}_{b}"] if f"{a}_{b}" in r else r[f"{b}_{a}"])
        dummies = benchmarks[1:]
        fitted, formula = None, "log_retention_ratio ~ teacher_frequency + complexity_rank + C(benchmark)"
        while True:
            columns = [("intercept", "one", None), ("teacher_frequency", "f", None), ("complexity_rank", "c", None)] + [(f"benchmark:{b}", "one", b) for b in dummies]
            gram = np.zeros((len(columns), len(columns)))
            moment = np.zeros(len(columns))
            per = {b: r for b, (_, r) in zip(benchmarks, rows.iterrows(), strict=True)}
            for i, (_, a, ba) in enumerate(columns):
                moment[i] = of(a, "y", total if ba is None else per[ba])
                for j, (_, b, bb) in enumerate(columns):
                    gram[i, j] = 0.0 if ba and bb and ba != bb else of(a, b, total if not (ba or bb) else per[ba or bb])
            fitted = fit_wls(gram, moment, of("y", "y", total), of("one", "y", total), of("one", "one", total), n)
            if fitted is not None or not dummies:
                break
            dummies = dummies[:-1]
            if not dummies:
                formula = "log_retention_ratio ~ teacher_frequency + complexity_rank"
        head = {"comparison_id": rows["comparison_id"].iloc[0], "family": rows["family"].iloc[0], "formula": formula, "n": n, "reference_benchmark": benchmarks[0]}
        if fitted is None:
            nothing = {"status": "insufficient_variation", "term": "model", "df": 0, "interpretation": "Not enough independent variation to estimate frequency-controlled survival regression."}
            return pd.DataFrame([head | nothing], columns=[c.split()[0] for c in REGRESSION.split(", ")])
        beta, errors, r2 = fitted
        out = []
        for (term, _, _), b, e in zip(columns, beta, errors, strict=True):
            t = b / e if e > 0 else 0.0
            p = 2 * (1 - NormalDist().cdf(abs(t)))
            out.append(head | {"status": "estimated", "term": term, "coefficient": b, "std_error": e, "t_stat": t, "p_value": p, "df": n - len(columns), "r_squared": r2, "interpretation": _meaning(term, b, p)})
        return pd.DataFrame(out)[[c.split()[0] for c in REGRESSION.split(", ")]]

    return sums.groupBy(*PAIR).applyInPandas(fit, REGRESSION)
