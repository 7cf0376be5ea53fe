from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.compare import both
from twinlens import queries_core
from twinlens.operators.profile import Form, bad_cells, departures, profile

SCHEMA = "ord bigint, load_id int, v string, column_name string, num string"
FORMS = {"v": Form("number", 0.0, 10.0)}


def rows_of(spark, rows):
    return spark.createDataFrame([(k, load, v, "clash", "clash") for k, (load, v) in enumerate(rows)], SCHEMA)


def test_brute_force(spark):
    values = [None, "", "  ", " 1 ", "1.0", "01", "2", "x", "10", "11", "-1", "1e1", "nan", ".", "5.", "٣", "1\n"]
    rows = [(load, values[(load * 7 + k * k) % len(values)]) for load in range(3) for k in range(40)]
    out = {r["load_id"]: r for r in profile(rows_of(spark, rows), ["v"], "load_id", FORMS, 3).collect()}
    number = {" 1 ": 1.0, "1.0": 1.0, "01": 1.0, "2": 2.0, "10": 10.0, "11": 11.0, "-1": -1.0, "1e1": 10.0, "5.": 5.0}
    order = lambda v: (0, number[v], "") if v in number else (1, 0.0, v)
    for load in range(3):
        mine = [v for a, v in rows if a == load]
        full = [v for v in mine if v is not None and v.strip(" ")]
        nums = sorted(number[v] for v in full if v in number)
        valid = [x for x in nums if 0 <= x <= 10]
        r = out[load]
        assert (r["rows"], r["missing_values"], r["distinct_values"]) == (len(mine), len(mine) - len(full), len(set(full)))
        assert (r["numbers"], r["wrong_form"], r["out_of_range"]) == (len(nums), len(full) - len(nums), len(nums) - len(valid))
        assert r["top_valid"] == max(Counter(valid).values())
        assert r["mean_valid"] == pytest.approx(sum(valid) / len(valid))
        assert [r["q25"], r["q50"], r["q75"]] == [nums[-(-len(nums) * q // 4) - 1] for q in (1, 2, 3)]
        if load:
            before = [v for a, v in rows if a == load - 1 and v is not None and v.strip(" ")]
            cut = [order(v) for v in {*full, *before}]
            share = lambda vs, c: sum(order(v) <= c for v in vs) / len(vs)
            assert r["ks_previous"] == pytest.approx(max(abs(share(full, c) - share(before, c)) for c in cut))
        else:
            assert r["ks_previous"] is None


def test_bad_cells_and_empty(spark):
    df = rows_of(spark, [(1, "3"), (1, "11"), (1, "x"), (1, None), (1, " "), (None, "-0.5")])
    assert sorted(r["row_key"] for r in bad_cells(df, ["v"], FORMS, "load_id", "ord").collect()) == [1, 2, 5]
    assert profile(df.limit(0), ["v"], "load_id", FORMS).count() == 0
    assert {r["load_id"] for r in profile(df, ["v"], "load_id", FORMS).collect()} == {1, None}


def test_departures(spark):
    base = spark.createDataFrame([("v", 0.0, 10.0, 0.0, 5.0, 0.1)], "column_name string, valid_low double, valid_high double, missing_share double, mean_value double, top_share double")
    good = [(1, str(k % 10 + 0.5)) for k in range(100)]
    shifted = [(2, str(k % 5 + 5.5)) for k in range(100)]
    sticky = [(3, "5") for _ in range(45)] + [(3, str(k % 10 + 0.5)) for k in range(55)]
    gaps = [(4, None if k % 5 == 0 else str(k % 10 + 0.5)) for k in range(100)]
    few = [(5, "9")] * 19
    found = departures(profile(rows_of(spark, good + shifted + sticky + gaps + few), ["v"], "load_id", FORMS), base)
    assert sorted(r["load_id"] for r in found.collect()) == [2, 3, 4]


def test_every_column_of_label_rows_is_profiled(spark, sf_dir):
    rows = queries_core.table(spark, sf_dir, "label_rows")
    got, want = both(spark, sf_dir, queries_core.p1_profile, queries_core.SQL["p1_profile"])
    out = queries_core.p1_profile(spark, sf_dir).filter("column_name in ('ord', 'load_id')").collect()
    assert got == want and len(out) == 2 * rows.select("load_id").distinct().count()
    per_load = {r["load_id"]: r for r in rows.groupBy("load_id").agg(F.count("*").alias("n"), F.countDistinct("ord").alias("d"), F.min("ord").alias("low"), F.max("ord").alias("high")).collect()}
    assert {(r["load_id"], r["rows"], r["distinct_values"], r["min_number"], r["max_number"]) for r in out if r["column_name"] == "ord"} == {(k, r["n"], r["d"], r["low"], r["high"]) for k, r in per_load.items()}
    assert {(r["load_id"], r["min_number"], r["wrong_form"]) for r in out if r["column_name"] == "load_id"} == {(k, k, 0) for k in per_load}


def test_candidate_lists_have_a_form(spark):
    values = ["[]", '["a", "b\\"c"]', "a|b", '["a"', "[a]", '{"a": 1}', "", None]
    r = profile(rows_of(spark, [(1, v) for v in values]), ["v"], "load_id", {"v": queries_core.PROFILE_FORMS["candidate_behaviors"]}).first()
    assert r["wrong_form"] == 3
