import hashlib
import math

from twinlens.llm import growing_sample as G

SCHEMA = "cond string, uid string, load int, stratum int, priority string"


def rows_of(spark, rows):
    return spark.createDataFrame([(c, u, b, 0, "clash") for c, u, b in rows], SCHEMA)


def brute(rows, rate):
    norm = lambda c: "_".join((c or "").strip(" ").lower().replace("-", " ").split())
    chosen: dict[tuple[str, str], int] = {}
    for load in sorted({b for _, _, b in rows}):
        seen = {(norm(c), u) for c, u, b in rows if b <= load and u is not None}
        for s in {c for c, _ in seen}:
            keys = sorted((u for c, u in seen if c == s), key=lambda u: (hashlib.md5(f"1|{u}".encode()).hexdigest(), u))
            need = math.ceil(round(rate * len(keys), 6)) - sum((s, u) in chosen for u in keys)
            for u in [u for u in keys if (s, u) not in chosen][: max(0, need)]:
                chosen[s, u] = load
    return chosen


DATA = [(["Broad", " broad ", "b-c", "B C", None, ""][k % 6], f"u{k * 37 % 301}", 1 + k % 4) for k in range(900)] + [("hot", f"h{k}", 1 + k % 3) for k in range(700)] + [("x", None, 1)]


def test_equals_brute_force_on_any_layout(spark):
    want = brute(DATA, 0.13)
    for rows, parts in ((DATA, 3), (DATA[::-1], 7), (DATA + DATA[:50], 1)):
        out = G.replay(rows_of(spark, rows).repartition(parts), "cond", "uid", "load", 0.13)
        assert {(r["stratum"], r["sample_key"]): r["chosen_in"] for r in out.collect()} == want


def test_keys_stay_when_loads_are_added(spark):
    sizes = []
    kept: set = set()
    for last in (1, 2, 3, 4):
        out = {(r[0], r[1]) for r in G.replay(rows_of(spark, [d for d in DATA if d[2] <= last]), "cond", "uid", "load", 0.13).collect()}
        assert kept <= out
        kept = out
        sizes.append(len(out))
    assert sizes == sorted(sizes)


def test_a_stored_ledger_goes_on_in_another_session(spark, tmp_path):
    """Only the new load's rows are given; the ledger is opened anew each time."""
    want = brute(DATA, 0.13)
    for load in (1, 2, 3, 4):
        ledger = G.Ledger(spark, f"{tmp_path}/ledger", 0.13)
        ledger.grow(rows_of(spark, [d for d in DATA if d[2] == load]), "cond", "uid", load)
        ledger.grow(rows_of(spark, [("new", "late", load)]), "cond", "uid", load)  # the load is in the ledger: nothing changes
    assert {(r["stratum"], r["sample_key"]): r["chosen_in"] for r in G.Ledger(spark, f"{tmp_path}/ledger", 0.13).chosen().collect()} == want
    assert G.Ledger(spark, f"{tmp_path}/ledger", 0.13).loads() == [1, 2, 3, 4]
    # A table with all loads adds nothing; rows of an earlier load are refused.
    again = G.replay(rows_of(spark, DATA), "cond", "uid", "load", 0.13, path=f"{tmp_path}/ledger")
    assert {(r["stratum"], r["sample_key"]): r["chosen_in"] for r in again.collect()} == want
    try:
        G.Ledger(spark, f"{tmp_path}/ledger", 0.13).grow(rows_of(spark, DATA[:3]), "cond", "uid", 0)
        raise AssertionError
    except ValueError:
        pass


def test_empty_tie_and_long_keys(spark):
    assert G.replay(rows_of(spark, DATA[:1]).limit(0), "cond", "uid", "load", 0.5).count() == 0
    long = "k" * 100_000
    out = G.replay(rows_of(spark, [("a", long, 1), ("a", long, 1), ("a", long, 2)]), "cond", "uid", "load", 0.01)
    assert [(r["stratum"], r["chosen_in"]) for r in out.collect()] == [("a", 1)]
