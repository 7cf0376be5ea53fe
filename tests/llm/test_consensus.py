import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinlens.llm import consensus as C

VOTES = "task string, item string, annotator string, label string, ord bigint"


def simulated(items=400, seed=3):
    rng = random.Random(seed)
    skill = {"good1": 0.95, "good2": 0.9, "good3": 0.85, "bad": 0.3, "worse": 0.2}
    truth, votes = {}, []
    for i in range(items):
        truth[f"i{i}"] = rng.choice("abcd")
        for who, p in skill.items():
            if rng.random() < 0.7:
                votes.append(("t", f"i{i}", who, truth[f"i{i}"] if rng.random() < p else rng.choice("abcd"), len(votes)))
    return truth, votes


def digamma(x):
    out = 0.0
    while x < 10:
        out -= 1 / x
        x += 1
    z = 1 / (x * x)
    return out + math.log(x) - 1 / (2 * x) - z * (1 / 12 - z * (1 / 120 - z / 252))


def brute(votes, rounds):
    """The same updates with dictionaries over all items."""
    by = defaultdict(list)
    for _, i, a, label, _ in votes:
        by[i].append((a, label))
    k_all = len({v[3] for v in votes})
    q = {i: {k: sum(x == k for _, x in vs) / len(vs) for k in {x for _, x in vs}} for i, vs in by.items()}
    for _ in range(rounds):
        n, row, cls = Counter(), Counter(), Counter()
        for i, vs in by.items():
            for k, p in q[i].items():
                cls[k] += p
                for a, x in vs:
                    n[a, k, x] += p
                    row[a, k] += p
        for i, vs in by.items():
            s = {}
            for k in q[i]:
                s[k] = digamma(cls[k] + C.CLASS_PRIOR)
                for a, x in vs:
                    prior = C.RIGHT_PRIOR if x == k else C.WRONG_PRIOR / max(1, k_all - 1)
                    s[k] += digamma(n[a, k, x] + prior) - digamma(row[a, k] + C.RIGHT_PRIOR + C.WRONG_PRIOR)
            top = max(s.values())
            z = sum(math.exp(v - top) for v in s.values())
            q[i] = {k: math.exp(v - top) / z for k, v in s.items()}
    return q


def test_equals_brute_force_and_beats_majority(spark):
    truth, votes = simulated()
    result = C.consensus(spark.createDataFrame(votes, VOTES), max_rounds=4, tolerance=-1)
    assert result.rounds == 4
    q = brute(votes, 4)
    items = {r["item"]: r for r in result.items.collect()}
    assert set(items) == set(q)
    for i, r in items.items():
        assert r["probability"] == pytest.approx(max(q[i].values()), abs=1e-9)
    right = sum(r["consensus"] == truth[i] for i, r in items.items())
    majority = sum(r["majority_label"] == truth[i] for i, r in items.items())
    assert right > majority
    who = {r["annotator"]: r for r in result.annotators.collect()}
    assert who["good1"]["reliability"] > 0.85 > 0.5 > who["worse"]["reliability"]
    assert all(r["reliability_low"] < r["reliability"] < r["reliability_high"] for r in who.values())


def test_standing_votes_and_forms(spark):
    schema = "ord bigint, label_uid string, semantic_label string, pass_score string, quality_score string, evaluator string, task string"
    rows = [(1, "u", "Deep Red", "0.5", "4.5", " Ann ", "x"), (2, "u", "deep_red ", "x", "9", "ANN", "x"), (3, "u", " ", "0.49", "1", "bob", "x"), (4, "u", "blue", None, None, " ", "x"), (5, None, "blue", "1", "1", "bob", "x")]
    votes = C.update_votes(spark.createDataFrame(rows, schema))
    got = {(r["task"], r["item"], r["annotator"], r["label"]) for r in C.standing(votes).collect()}
    assert got == {("semantic_label", "u", "ann", "deep_red"), ("pass_score", "u", "ann", "pass"), ("pass_score", "u", "bob", "fail"), ("quality_score", "u", "ann", "5"), ("quality_score", "u", "bob", "1")}


def test_krippendorff(spark):
    # Units of a published worked example (nominal alpha 0.743, interval 0.849).
    a = [1, 2, 3, 3, 2, 1, 4, 1, 2, None, None, None]
    b = [1, 2, 3, 3, 2, 2, 4, 1, 2, 5, None, 3]
    c = [None, 3, 3, 3, 2, 3, 4, 2, 2, 5, 1, None]
    d = [1, 2, 3, 3, 2, 4, 4, 1, 2, 5, 1, None]
    tally = Counter((k, str(x)) for row in (a, b, c, d) for k, x in enumerate(row) if x is not None)
    df = spark.createDataFrame([("t", str(k), x, n) for (k, x), n in tally.items()], "task string, item string, label string, n bigint")
    r = C.agreement(df).first()
    assert (r["alpha_nominal"], r["alpha_interval"]) == (pytest.approx(0.743, abs=1e-3), pytest.approx(0.849, abs=1e-3))


def test_empty_single_and_ties(spark):
    empty = C.consensus(spark.createDataFrame([], VOTES))
    assert empty.items.count() == empty.annotators.count() == empty.agreement.count() == 0
    one = C.consensus(spark.createDataFrame([("t", "i", "a", "x", 1)], VOTES))
    assert [(r["consensus"], r["probability"]) for r in one.items.collect()] == [("x", 1.0)]
    tie = C.consensus(spark.createDataFrame([("t", "i", "a", "y", 1), ("t", "i", "b", "x", 1), ("t", "i", "b", "x", 1)], VOTES)).items.first()
    assert (tie["consensus"], tie["votes"]) == ("x", 2)


def test_digamma_and_beta(spark):
    xs = [0.01, 0.5, 1.0, 3.7, 1000.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(C.digamma(F.col("x"))).collect()
    assert [g[0] for g in got] == pytest.approx([digamma(x) for x in xs], abs=1e-9)
    a, b = np.array([1.0, 2.0, 30.0]), np.array([1.0, 3.0, 4.0])
    for p in (0.025, 0.5, 0.975):
        assert C.beta_cdf(C.beta_quantile(p, a, b), a, b) == pytest.approx([p] * 3, abs=1e-9)
    assert C.beta_quantile(0.3, a[:1], b[:1])[0] == pytest.approx(0.3)
    assert C.beta_cdf(np.array([0.4]), a[1:2], b[1:2])[0] == pytest.approx(sum(math.comb(4, j) * 0.4**j * 0.6 ** (4 - j) for j in range(2, 5)))


def test_logs_joined_by_shuffle_give_the_same(spark, monkeypatch):
    _, votes = simulated(60)
    df = spark.createDataFrame(votes, VOTES)
    want = {r["item"]: r["probability"] for r in C.consensus(df, 3, -1).items.collect()}
    monkeypatch.setattr(C, "MAX_BROADCAST_ROWS", 0)
    assert {r["item"]: r["probability"] for r in C.consensus(df, 3, -1).items.collect()} == pytest.approx(want)


def brute_all(votes, rounds):
    """The same updates over all items and all labels of the task."""
    labels = sorted({v[3] for v in votes})
    by = defaultdict(list)
    for _, i, a, label, _ in votes:
        by[i].append((a, label))
    q = {i: {k: sum(x == k for _, x in vs) / len(vs) for k in labels} for i, vs in by.items()}
    for _ in range(rounds):
        n, row, cls = Counter(), Counter(), Counter()
        for i, vs in by.items():
            for k in labels:
                cls[k] += q[i][k]
                for a, x in vs:
                    n[a, k, x] += q[i][k]
                    row[a, k] += q[i][k]
        prior = lambda k, x: C.RIGHT_PRIOR if x == k else C.WRONG_PRIOR / max(1, len(labels) - 1)
        log = {(a, k, x): digamma(n[a, k, x] + prior(k, x)) - digamma(row[a, k] + C.RIGHT_PRIOR + C.WRONG_PRIOR) for a, k, x in n}
        for i, vs in by.items():
            s = {k: digamma(cls[k] + C.CLASS_PRIOR) + sum(log[a, k, x] for a, x in vs) for k in labels}
            top = max(s.values())
            z = sum(math.exp(v - top) for v in s.values())
            q[i] = {k: math.exp(v - top) / z for k, v in s.items()}
    return q


@pytest.mark.parametrize(("most", "solo"), [(C.MAX_BROADCAST_ROWS, C.SOLO_BYTES), (C.MAX_BROADCAST_ROWS, 0), (0, 0)])
def test_unvoted_labels_and_single_votes_are_iterated(spark, monkeypatch, most, solo):
    _, votes = simulated(60)
    votes += [("t", f"single{k}", "worse", "a", 1000 + k) for k in range(3)]
    monkeypatch.setattr(C, "MAX_BROADCAST_ROWS", most)
    monkeypatch.setattr(C, "SOLO_BYTES", solo)
    monkeypatch.setattr(C, "FAN_IN", 1)
    monkeypatch.setattr(C, "PART_VOTES", 50)
    items = {r["item"]: r for r in C.consensus(spark.createDataFrame(votes, VOTES), 3, -1, unvoted=True).items.collect()}
    q = brute_all(votes, 3)
    assert {i: r["probability"] for i, r in items.items()} == pytest.approx({i: max(p.values()) for i, p in q.items()}, abs=1e-9)
    assert all(q[i][r["consensus"]] == pytest.approx(r["probability"]) for i, r in items.items())
    assert items["single0"]["probability"] < 0.9


def test_rounds_go_on_until_no_probability_moves(spark):
    rng, votes = random.Random(5), []
    for i in range(80):
        truth = rng.choice("abcd")
        for who, p in {"w1": 0.4, "w2": 0.35, "w3": 0.3}.items():
            votes.append(("t", f"i{i}", who, truth if rng.random() < p else rng.choice("abcd"), len(votes)))
    items = {r["item"]: r for r in C.consensus(spark.createDataFrame(votes, VOTES), unvoted=True).items.collect()}
    q = brute_all(votes, 400)
    assert {i: r["probability"] for i, r in items.items()} == pytest.approx({i: max(p.values()) for i, p in q.items()}, abs=5e-3)


def many_labels(items=150, labels=70):
    rng, votes = random.Random(8), []
    for i in range(items):
        truth = rng.randrange(labels)
        for who, p in {"w1": 0.9, "w2": 0.8, "w3": 0.5, "w4": 0.3}.items():
            if rng.random() < 0.6:
                votes.append(("t", f"i{i}", who, f"l{truth if rng.random() < p else (truth + rng.randrange(4)) % labels:02d}", len(votes)))
    return votes


@pytest.mark.parametrize("negligible", [C.NEGLIGIBLE, 1000.0])
def test_classes_left_out_do_not_count(spark, monkeypatch, negligible):
    """With many labels most pairs of item and class are left out; with an impossible bound none is."""
    votes = many_labels()
    monkeypatch.setattr(C, "NEGLIGIBLE", negligible)
    result = C.consensus(spark.createDataFrame(votes, VOTES), 6, -1, unvoted=True)
    q = brute_all(votes, 6)
    assert {r["item"]: r["probability"] for r in result.items.collect()} == pytest.approx({i: max(p.values()) for i, p in q.items()}, abs=1e-9)
    got = {(r["item"], r["class"]): (r["probability"], r["class_votes"]) for r in result.posterior.collect()}
    given = Counter((v[1], v[3]) for v in votes)
    assert all(got[i, k] == (pytest.approx(q[i][k], abs=1e-9), n) for (i, k), n in given.items())


def test_a_task_that_breaks_the_bound_runs_with_all_classes(spark, monkeypatch):
    votes = many_labels()
    monkeypatch.setattr(C, "NEGLIGIBLE", 34.0)  # tried without, and broken by a round
    items = C.consensus(spark.createDataFrame(votes, VOTES), 4, -1, unvoted=True).items.collect()
    q = brute_all(votes, 4)
    assert {r["item"]: r["probability"] for r in items} == pytest.approx({i: max(p.values()) for i, p in q.items()}, abs=1e-9)


def test_reliability_counts_are_sums_of_the_posterior(spark):
    _, votes = simulated(80)
    result = C.consensus(spark.createDataFrame(votes, VOTES), 5, -1, unvoted=True)
    q, right = brute_all(votes, 5), Counter()
    for _, i, a, label, _ in votes:
        right[a] += q[i][label]
    assert {r["annotator"]: r["expected_right"] for r in result.annotators.collect()} == pytest.approx(right, abs=1e-9)
    top = Counter()
    for i in {v[1] for v in votes}:
        n = Counter(v[3] for v in votes if v[1] == i)
        label, most = n.most_common(1)[0]
        if sum(n.values()) >= 3 and 2 * most > sum(n.values()):
            top.update(v[2] for v in votes if v[1] == i and v[3] == label)
    assert {r["annotator"]: r["settled_right"] for r in result.annotators.collect()} == dict(top)
