import random
from collections import defaultdict

from hypothesis import given
from hypothesis import strategies as st

from twinlens.llm import packing as P


def brute(sizes, capacity):
    """The rule itself: try every place, take the smallest sum of squares, of equal ones the fullest."""
    fill, out = [], []
    shut = capacity - min([s for s in sizes if s] or [1]) + 1
    for s in sizes:
        if s == 0:
            out.append(0)
            continue
        best = None
        for k in [*range(len(fill)), None]:
            level = fill[k] if k is not None else 0
            if level + s > capacity or (k is not None and level >= shut):
                continue
            after = [x for j, x in enumerate(fill) if j != k and x < shut] + ([level + s] if level + s < shut else [])
            cost = sum(after.count(x) ** 2 for x in set(after))
            if best is None or (cost, -level) < best[0]:
                best = ((cost, -level), k)
        k = best[1]
        if k is None:
            fill.append(0)
            k = len(fill) - 1
        fill[k] += s
        out.append(k)
    return out, fill


@given(st.lists(st.integers(0, 12), max_size=25), st.integers(12, 15))
def test_rule_equals_brute_force(sizes, capacity):
    got = P.sum_of_squares(sizes, capacity).tolist()
    _, fill = brute(sizes, capacity)
    load = defaultdict(int)
    for s, k in zip(sizes, got, strict=True):
        load[k] += s
    assert sorted(x for x in load.values() if x) == sorted(fill)


def run(spark, rows, capacity, block=P.BLOCK):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id bigint, tokens int, container_id string, whole int")
    return P.pack(df, "doc_id", "tokens", capacity, block)


def check(out, rows, capacity):
    sizes = defaultdict(list)
    load = defaultdict(int)
    for r in out:
        sizes[r["doc_key"]].append(r)
        load[r["container_id"]] += r["part_tokens"]
    for k, n in rows:
        parts = sorted(sizes[k], key=lambda r: r["part_no"])
        assert sum(p["part_tokens"] for p in parts) == (n or 0)
        assert len(parts) == max(1, -(-(n or 0) // capacity))
        assert [p["start_token"] for p in parts] == [capacity * j for j in range(len(parts))]
    assert all(v <= capacity for v in load.values())
    assert all(load[r["container_id"]] == r["filled"] for r in out)
    return len(load)


def test_every_document_once_and_little_waste(spark):
    rng = random.Random(5)
    rows = [(k, min(9000, int(rng.lognormvariate(5.5, 1.3)))) for k in range(6000)] + [(9001, None), (9002, 0), (9003, 2048), (9004, 4096), (9005, 6001)]
    for block in (20_000, 700):
        out = run(spark, rows, 2048, block).collect()
        used = check(out, rows, 2048)
        assert used <= 1.02 * -(-sum(n or 0 for _, n in rows) // 2048) + 2
    assert {(r["doc_key"], r["part_no"]) for r in run(spark, rows, 2048).collect()} == {(r["doc_key"], r["part_no"]) for r in out}


def test_layout_does_not_matter(spark):
    rng = random.Random(6)
    rows = [(k, rng.randrange(1, 900)) for k in range(500)]
    a, b = ({r["doc_key"]: r["container_id"] for r in run(spark, x, 1000, 200).collect()} for x in (rows, rows[::-1]))
    same = lambda m: sorted(sorted(k for k in m if m[k] == c) for c in set(m.values()))
    assert same(a) == same(b)


def test_repeated_keys_empty_and_report(spark):
    rows = [(1, 600)] * 5 + [(2, 400)]
    out = run(spark, rows, 1000).collect()
    assert len(out) == 6 and sum(r["part_tokens"] for r in out) == 3400
    assert run(spark, [], 10).count() == 0
    assert [r["filled"] for r in run(spark, [(1, 0), (2, None)], 10).collect()] == [0, 0]
    report = P.fill_report(run(spark, rows, 1000), 1000).first()
    assert (report["tokens"], report["fewest_containers"]) == (3400, 4)
    hot = run(spark, [(7, 3)] * 3000, 100, 500)
    assert hot.count() == 3000 and hot.select("container_id").distinct().count() <= 94
