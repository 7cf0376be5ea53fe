from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from twinlens.plans.prefix import numbered, range_prefix, running_least, with_previous
from twinlens.plans.skew import join_groups


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 9), st.integers(0, 5)), max_size=60))
def test_range_prefix_equals_brute_force(spark, rows):
    rows = [(*r, k) for k, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "g string, o int, n int, id int")
    got = {r["id"]: r["n_upto"] for r in range_prefix(df, ["g"], ["o"], ["n"], 3).collect()}
    assert got == {i: sum(m for h, p, m, _ in rows if h == g and p <= o) for g, o, _, i in rows}


def test_one_hot_group_is_split(spark):
    df = spark.range(2000).selectExpr("'x' as g", "id", "1 as one")
    out = range_prefix(df, ["g"], ["id"], ["one"], 4)
    assert out.filter("one_upto <> id + 1").count() == 0


def test_running_least(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 3.0), (3, 4.0), (4, 9.0)], "p int, q double")
    assert {r["p"]: r["q_least"] for r in running_least(df, "p", "q", 3).collect()} == {1: 3.0, 2: 3.0, 3: 4.0, 4: 9.0}


def test_numbered_and_previous(spark):
    df = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(20)], "ord int, m string")
    assert [r["place"] for r in numbered(df, ["ord"]).orderBy("ord").collect()] == list(range(1, 21))
    rows = with_previous(df, ["ord"], ["m"]).orderBy("ord").collect()
    assert rows[0]["previous_m"] is None
    assert [r["previous_m"] for r in rows[1:]] == ["ab"[k % 2] for k in range(19)]


def test_join_groups_keeps_hot_and_cold(spark):
    rows = spark.range(5000).selectExpr("case when id < 2000 then 'hot' else concat('k', id) end as key", "id")
    groups = rows.groupBy("key").count().withColumnRenamed("count", "n")
    out = join_groups(rows, groups, "key", "n")
    assert out.count() == 5000
    assert out.filter("key = 'hot'").select("n").distinct().collect()[0][0] == 2000
    assert join_groups(rows.limit(0), groups.limit(0), "key", "n").count() == 0
