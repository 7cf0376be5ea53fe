import csv
import io

from hypothesis import given
from hypothesis import strategies as st

from twinlens.operators.records import LABEL_UPDATE, Grammar, Layout, failed_records, parse_files, parse_lines, valid_records

G = Grammar(LABEL_UPDATE)
OK = '5cdfcf92cc0c1206,cast_iron,,0.41,3.57,false,unsafe,,ann_54,"line one\nline two"'


def reasons(line):
    return [e.reason for r in G.parse(line, single=True) for e in r.errors]


def test_single_lines():
    assert reasons(OK) == [] == reasons(OK + "\r")
    assert reasons("") == ["column_count"]
    assert reasons(",,,,,,,,,") == []
    assert reasons('a,"b') == reasons('a,"b"c') == reasons('a,b"c') == reasons('a, "b"') == ["quoting"]
    assert reasons("a,b") == ["column_count"]
    assert reasons("a,,,2,x,maybe,no,,,") == ["pass_score", "quality_score", "refusal"]
    assert reasons('a,,,"1"," 5 ",YES , Safe,,,"x, ""y"""') == []
    assert reasons("a,,,1.,5e0,n,y,,,") == []
    assert reasons("a,,,٣,nan,,,,,") == ["pass_score", "quality_score"]
    assert reasons('a,,,,,,,,,""\r\r') == ["quoting"]
    assert reasons("a,,,,,,,,,n\r\r") == []


@given(st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\r\n\x00"), max_size=12), min_size=1, max_size=12))
def test_round_trip_through_a_csv_writer(fields):
    out = io.StringIO()
    csv.writer(out, lineterminator="", quoting=csv.QUOTE_ALL).writerow(fields)
    record = next(iter(G.parse(out.getvalue(), single=True)))
    assert record.fields == fields


def test_recovery_at_the_next_validated_start():
    layout = Layout(("id", "a", "b"), anchor=r"[0-9a-f]{4},")
    text = '0001,x,"fine ""one"""\r\n0002,"open, y\nnot a start,"z\n0003,ok,1\n0004,bad\n0005,"q\nr",2\n'
    got = [(r.fields, [e.reason for e in r.errors]) for r in Grammar(layout).parse(text)]
    assert got[0] == (["0001", "x", 'fine "one"'], [])
    assert got[1][1] == ["quoting"]
    assert got[2:] == [(["0003", "ok", "1"], []), (["0004", "bad"], ["column_count"]), (["0005", "q\nr", "2"], [])]


def test_tables(spark):
    df = spark.createDataFrame([(1, OK, 0), (2, None, 0), (3, 'x,"', 0), (4, "a,,,7,9,,,,,", 0), (1, OK, 0)], "line_id bigint, raw_line string, errors int")
    parsed = parse_lines(df, "line_id", "raw_line")
    assert sorted((r["line_key"], r["reason"]) for r in failed_records(parsed).collect()) == [(2, "column_count"), (3, "quoting"), (4, "pass_score"), (4, "quality_score")]
    good = valid_records(parsed).collect()
    assert len(good) == 2
    assert (good[0]["pass_score"], good[0]["refusal"], good[0]["unsafe"], good[0]["memorization_score"]) == (0.41, False, True, None)
    assert parse_lines(df.limit(0), "line_id", "raw_line").count() == 0
    long = spark.createDataFrame([(1, "a" * 300_000 + ',"' + 'b"",' * 100_000 + '"')], "line_id bigint, raw_line string")
    assert [r["reason"] for r in failed_records(parse_lines(long, "line_id", "raw_line")).collect()] == ["column_count"]


def test_files_are_parsed_whole_and_recover(spark):
    uid = lambda k: f"{k:016x}"
    lines = [f"{uid(0)},x,,1,2,,,,ann,ok", f'{uid(1)},"open,,1,2,,,,ann,n', f'{uid(2)},"fine",,1,2,,,,"ann",n', f'"{uid(3)}",x,,1,2,,,,ann,"two\nlines"', f'{uid(4)},"cut,,1,2,,,,ann,n', f"{uid(5)},x,,7,2,,,,ann,n\r", f"{uid(6)},short", f'{uid(7)},"end', None]
    rows = [(k, "a" if k < 7 else "b", k, line, "clash") for k, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "id bigint, file string, no int, line string, fields string").repartition(3)
    want = [(1, "quoting"), (4, "quoting"), (5, "pass_score"), (6, "column_count"), (7, "quoting")]
    for block in (2000, 7):
        parsed = parse_files(df, "file", "no", "id", "line", block=block)
        assert sorted((r["line_key"], r["reason"]) for r in failed_records(parsed).collect() if r["line_key"] != 8) == want
        assert sorted(r["label_uid"] for r in valid_records(parsed).collect()) == [uid(0), uid(2), uid(3)]
    assert parse_files(df.limit(0), "file", "no", "id", "line").count() == 0


def test_a_quote_that_closes_by_chance():
    uid = lambda k: f"{k:016x}"
    text = f'{uid(1)},a,,1,2,,,,ann,"see next\n{uid(2)},"b",,1,2,,,,ann,n\n{uid(3)},"open,,1,2,,,,ann,n\n{uid(4)},b",,1,2,,,,ann,n\n{uid(5)},c,,1,2,,,,ann,n\n'
    got = [(r.fields[0] if not r.errors else None, [e.reason for e in r.errors]) for r in G.parse(text)]
    assert got == [(None, ["quoting"]), (uid(2), []), (None, ["quoting"]), (None, ["quoting"]), (uid(5), [])]
