import random
from collections import Counter, defaultdict

import pytest

from twinlens.llm import mixing as X

WEIGHTS = [("a", 0.5, 1), ("b_b", 0.3, 4), ("c", 0.2, 2), ("none", 0.1, 3)]


def tables(spark, docs, weights=WEIGHTS):
    return spark.createDataFrame([(*d, 0, 1) for d in docs], "doc_id bigint, source string, tokens int, one int, n int"), spark.createDataFrame(weights, "source string, target_share double, max_repeats int")


def run(spark, docs, weights=WEIGHTS, **kw):
    d, w = tables(spark, docs, weights)
    mixture, report = X.mix(d, "doc_id", "source", "tokens", w, **kw)
    return mixture.collect(), {r["source"]: r for r in report.collect()}


def corpus():
    rng = random.Random(2)
    return [(k, ["a", " A", "B-B", "b b", "c", None, "other"][k % 7], int(rng.lognormvariate(4, 1.5))) for k in range(4000)]


def test_shares_and_caps(spark):
    docs = corpus()
    mixture, report = run(spark, docs)
    assert not {r["doc_key"] for r in mixture} & {k for k, s, _ in docs if s in (None, "other")}
    times = Counter(r["doc_key"] for r in mixture)
    most = {"a": 1, "b_b": 4, "c": 2}
    by = defaultdict(set)
    for r in mixture:
        by[r["doc_key"]].add(r["copy_no"])
        assert times[r["doc_key"]] <= most[r["source"]]
    assert all(v == set(range(1, times[k] + 1)) for k, v in by.items())
    for s, r in report.items():
        e = r["expected_copies"]
        assert r["copies"] == pytest.approx(e * r["documents"], abs=1)
        assert r["tokens_mixed"] == pytest.approx(e * r["tokens_available"], rel=0.02)
        assert r["actual_share"] == pytest.approx(r["tokens_mixed"] / sum(x["tokens_mixed"] for x in report.values()))
    assert report["none"]["copies"] == 0 and report["none"]["expected_copies"] == 0
    for s in times:
        assert {times[k] for k, x, _ in docs if x == s} <= {int(report["a"]["expected_copies"]), int(report["a"]["expected_copies"]) + 1}


def test_targets_are_reached_without_caps(spark):
    mixture, report = run(spark, corpus(), [("a", 0.6, 10), ("c", 0.4, 10)])
    assert report["a"]["actual_share"] == pytest.approx(0.6, abs=0.01) and report["c"]["actual_share"] == pytest.approx(0.4, abs=0.01)


def test_exact_shares(spark):
    _, report = run(spark, corpus(), [("a", 0.2, 1), ("b_b", 0.5, 1), ("c", 0.3, 9), ("none", 0.1, 1)], exact=True)
    assert [report[s]["actual_share"] for s in ("a", "b_b", "c")] == pytest.approx([0.2, 0.5, 0.3], abs=0.01)
    assert report["a"]["expected_copies"] <= report["b_b"]["expected_copies"] == 1.0
    assert report["b_b"]["copies"] == report["b_b"]["documents"]


def test_repeatable_on_any_layout(spark):
    docs = corpus()
    d, w = tables(spark, docs)
    a, b = (Counter((r["doc_key"], r["copy_no"]) for r in X.mix(d.repartition(n), "doc_id", "source", "tokens", w)[0].collect()) for n in (1, 6))
    assert a == b


def test_plan():
    got = X.plan({"a": 100, "b": 10, "d": 0}, {"a": (0.5, 9), "b": (0.5, 2), "d": (0.5, 5), "e": (0.1, 1)}, 110)
    assert got == {"a": 0.9, "b": 2.0, "d": 0.0, "e": 0.0}
    assert X.plan({}, {"a": (1.0, 1)}) == {"a": 0.0}
    assert X.plan({"a": 5}, {"a": (1.0, 1)}, 50) == {"a": 1.0}


def test_empty_and_repeated(spark):
    mixture, report = run(spark, [])
    assert not mixture and report["a"]["copies"] == 0
    mixture, _ = run(spark, [(1, "a", 7)] * 30, [("a", 1.0, 1)])
    assert len(mixture) == 30
    assert run(spark, corpus()[:50], [])[0] == []


def test_few_large_documents_reach_their_share(spark):
    """A source of which a third is wanted and in which a tenth of the documents hold two fifths of the tokens."""
    rng = random.Random(4)
    docs = [(k, "a", 200 if k < 10 else rng.randrange(10, 60)) for k in range(100)] + [(k, "c", 50) for k in range(100, 400)]
    _, report = run(spark, docs, [("a", 0.1, 1), ("c", 0.9, 1)], exact=True)
    assert report["a"]["actual_share"] == pytest.approx(0.1, abs=0.01)
    assert report["a"]["planned_share"] == pytest.approx(0.1)
    assert sum(r["planned_share"] for r in report.values()) == pytest.approx(1.0)
