import unicodedata

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinlens.llm import copies as C
from twinlens.llm.text_forms import canonical_json, letters_and_digits

SCHEMA = "ord bigint, benchmark string, axis_id string, prompt_text string, metadata string, digest string, copies int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 0) for r in rows], SCHEMA)


ROWS = [
    (5, "b", "x", "A  Café, 2 dogs!", '{"a": 1, "t": [1, 2]}'), (3, "b", "x", "a café 2 DOGS", '{ "t":[1,2],"a":1.0}'), (9, "b", "x", "ａ café2dogs​", '{"t": [1, 2], "a": 1}'), (4, "b", "x", "a cafe 2 dogs", '{"a": 1, "t": [1, 2]}'),
    (6, "b", "x", "a café 2 dogs", '{"a": 1, "t": [2, 1]}'), (7, "b", "y", "a café 2 dogs", '{"a": 1, "t": [1, 2]}'), (8, "b", "x", "a café 2 dogs", None), (10, "b", "x", "A café 2 dogs.", None), (11, None, None, None, None), (12, None, None, "", None), (12, None, None, " !", None),
    (13, "b", "x", "a café 2 dogs", ""), (14, "b", "x", "a café 2 dogs", "not json"), (15, "b", "x", "a  café 2 dogs", "not json"),
]


def found(written, digest=None):
    return sorted((r["first_key"], r["key"]) for r in C.copies_of(C.hashed(written, digest), written).collect())


def test_copies(spark):
    written = C.written_alike(table(spark, ROWS), "ord", ["benchmark", "axis_id"], ["prompt_text"], ["metadata"])
    want = [(3, 5), (3, 9), (8, 10), (11, 12), (11, 12), (14, 15)]
    assert found(written) == want
    for digest in (None, F.lit("0")):
        assert sum(r["copies"] for r in C.copy_groups(C.hashed(written, digest), written).collect()) == len(ROWS)
    # All records under one digest: the collision check has to part them by their writing.
    assert found(written, F.lit("0")) == want
    assert found(written.limit(0)) == []
    assert "writing" not in C.hashed(written).columns


def test_a_hot_group(spark):
    df = spark.range(3000).selectExpr("id as ord", "'b' as benchmark", "'x' as axis_id", "case when id % 3 = 0 then 'hot prompt' else concat('p', id) end as prompt_text", "cast(null as string) as metadata")
    written = C.written_alike(df, "ord", ["benchmark", "axis_id"], ["prompt_text"], ["metadata"])
    out = C.copies_of(C.hashed(written), written)
    assert out.count() == 999 and out.filter("first_key <> 0").count() == 0


def test_other_letters_are_other_records():
    for a, b in (("straße", "strasse"), ("ﬁne", "fine"), ("m²", "m2"), ("Ⅳ", "IV"), ("½ x", "12x"), ("é", "e"), ("①", "1")):
        assert letters_and_digits(a) != letters_and_digits(b)
    for a, b in (("ＡＢ１", "ab1"), ("É", "e\u0301"), ("ΟΔΟΣ", "οδος"), ("a\u200db", "AB"), ("Å", "a\u030a")):
        assert letters_and_digits(a) == letters_and_digits(b)


def test_json_values_have_types():
    same = [('{"a": 1, "b": {"y": [1.0], "x": null}}', '{"b":{"x":null,"y":[10e-1]},"a":1.00}'), ("0", "-0.0"), ("1" * 40 + ".0", "1" * 40)]
    other = [('{"a": 1}', '{"a": {"#": "1"}}'), ('{"a": 1}', '{"a": "1"}'), ('{"a": 1}', '{"a": "#1e0"}'), ("1" * 40, "1" * 39 + "2"), ("null", '"null"'), ("true", "1"), ("[1,2]", "[2,1]"), ("NaN", '"NaN"'), ("10", "100")]
    assert all(canonical_json(a) == canonical_json(b) for a, b in same)
    assert all(canonical_json(a) != canonical_json(b) for a, b in other)


@given(st.text(max_size=30))
def test_writing_does_not_matter(text):
    form = letters_and_digits(text)
    assert letters_and_digits(unicodedata.normalize("NFD", text)) == letters_and_digits(unicodedata.normalize("NFC", text)) == form
    assert letters_and_digits(" ".join(text)) == letters_and_digits(" ".join(unicodedata.normalize("NFC", text))) or not text.isascii()
    if text.isascii():
        assert letters_and_digits(text.upper()) == letters_and_digits(text.lower()) == form


def test_ascii_path_equals_python(spark):
    texts = ["", "A-b c1", "Straße", "x" * 50_000 + "Ü!", "a\nb\x00c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(C.same_letters(F.col("t"))).collect()] == [letters_and_digits(t) for t in texts]
    assert canonical_json('{"b": 1e0, "a": "\\u00e9"}') == canonical_json('{"a":"é","b":1}') != canonical_json('{"a":"é","b":"1"}')
