import pytest

from twinlens.llm import label_mapping as M

ENTRIES = [
    ("colour", 1, "crimson", ["deep red"]), ("colour", 2, "ivory", ["off-white"]), ("colour", 3, "copper_brown", []), ("pattern", 4, "plain", ["no pattern", "solid"]), ("pattern", 5, "tartan", ["plaid"]), ("view", 6, "eye_level", []),
    ("view", 7, "extreme_closeup", []), ("view", 8, "overhead", ["bird's eye"]), ("count", 9, "exact_pair", ["two of them"]), ("count", 10, "triplet", ["three of them"]), ("count", 11, "large_crowd", []), ("knowledge", 12, "not_depicted", []),
]
CASES = [
    ("colour", "Crimson", 1), ("colour", " deep-red!", 1), ("colour", "DEEP RED?", 1), ("colour", "crimsom", 1), ("colour", "crismon", 1), ("colour", "сrimson", 1), ("colour", "crímson​", 1), ("colour", "cr1mson", 1), ("colour", "mostly crimson", 1), ("colour", "off white", 2),
    ("colour", "Iv0ry", 2), ("colour", "brown, copper", 3), ("colour", "CopperBrown", 3), ("colour", "copper b", 3), ("colour", "copperbrwon", 3), ("colour", "coppe rbrown", 3), ("colour", "crimson I think", 1), ("colour", "crimson, sure", 1), ("colour", "crimson, deep red", 1),
    ("colour", "crimson or ivory", -1), ("colour", "crimson/ivroy", -1), ("colour", "ivory+copper brown", -1), ("colour", "not sure", -1), ("colour", "other", -1), ("colour", "", -1), ("colour", None, -1), ("colour", "plain", -1), ("colour", "volcano", -1), ("colour", "???", -1), (None, "crimson", -1),
    ("none", "crimson", -1), ("pattern", "plaid", 5), ("pattern", "plai", -1), ("pattern", "solid", 4), ("view", "level eye", 6), ("view", "birds eye", 8), ("view", "extreme_clseup", 7), ("view", "ｅｙｅ　ｌｅｖｅｌ", 6), ("count", "to of them", 9), ("count", "three of them", 10), ("count", "thre of thm", 10),
    ("knowledge", "not depicted", 12), ("knowledge", "- not depcited", 12), ("count", "quarterly budget", -1),
]


@pytest.fixture(scope="module")
def matcher():
    return M.Matcher((a, b, [c, *d]) for a, b, c, d in ENTRIES)


@pytest.mark.parametrize("axis,text,want", CASES)
def test_cases(matcher, axis, text, want):
    assert matcher.match(axis, text) == want


def test_long_text_is_read_whole(matcher):
    assert matcher.match("colour", "word " * 20_000 + "crimson") == 1
    assert matcher.match("colour", "crimson " + "word " * 20_000 + "ivory") == -1


def table(spark, rows):
    return spark.createDataFrame(rows, "ord bigint, axis_name string, semantic_label string, candidate_behaviors string, known string")


def vocab(spark):
    return spark.createDataFrame([(a, b, c, d or None) for a, b, c, d in ENTRIES], "axis_name string, behavior_id int, canonical_label string, aliases array<string>")


def test_tables(spark):
    df = table(spark, [(1, "colour", "crimson", '["ivory", "Crimson", null, ""]', "k"), (2, "colour", "Ivory ", "crimson|off-white||x", "k"), (3, None, "crimson", None, None), (4, "zzz", " ", "", None), (4, "colour", "nope", "[bad", None)])
    want = {(1, "candidate_behaviors", 2, 1), (1, "candidate_behaviors", 3, -1), (1, "candidate_behaviors", 4, -1), (2, "semantic_label", 0, 2), (2, "candidate_behaviors", 2, 2), (2, "candidate_behaviors", 3, -1), (2, "candidate_behaviors", 4, -1), (3, "semantic_label", 0, -1), (4, "semantic_label", 0, -1), (4, "candidate_behaviors", 1, -1)}
    args = ("ord", "axis_name", "semantic_label", "candidate_behaviors")
    for out in (M.map_values(df, vocab(spark), *args), M.map_values_in_blocks(df, vocab(spark), *args, most=3)):
        assert {(r["key"], r["field_name"], r["item_pos"], r["behavior_id"]) for r in out.collect()} == want
    assert M.map_values(df.limit(0), vocab(spark), *args).count() == 0
    nothing = M.map_values(df, vocab(spark).limit(0), *args)
    assert nothing.filter("behavior_id <> -1").count() == 0 and nothing.count() == 13
    assert {r["text"]: r["uses"] for r in M.unmatched_report(M.map_values(df, vocab(spark), *args)).collect()}["nope"] == 1


def test_edits():
    assert [M.edits(a, b, 3) for a, b in (("", "ab"), ("abc", "acb"), ("abc", "abc"), ("kitten", "sitting"), ("a", "abcdef"))] == [2, 1, 0, 3, 4]


def test_split_names_are_found_in_long_texts():
    m = M.Matcher([("view", 1, ["extreme_closeup"])])
    for filler in (10, 60):
        assert m.match("view", "word " * filler + "extr eme clo seup") == 1


def test_the_length_of_a_text_does_not_matter():
    m = M.Matcher([("a", 1, ["alpha beta gamma delta"]), ("a", 2, ["omega"])])
    for n in (0, 34, 40, 400):
        assert m.match("a", "word " * n + "alpha beta gamma dleta") == 1
    assert m.match("a", "word " * 50 + "omgea") == m.match("a", "omgea") == 2


def test_a_long_list_of_one_group(spark):
    """Longer than any list of literals; compared with all names for some misspelt ones."""
    names = [f"{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyzaeio'[k // 100 % 10]}{'bcdfghjklm'[k // 1000 % 10]}{'nprstvwxyz'[k // 10000 % 10]} item" for k in range(60_000)]
    vocabulary = spark.createDataFrame([("x", k, n, None) for k, n in enumerate(names)], "axis_name string, behavior_id int, canonical_label string, aliases array<string>")
    df = table(spark, [(1, "x", names[777].upper(), None, None), (2, "x", names[59_999], None, None), (3, "x", "zzzzz thing", None, None)])
    out = M.map_values(df, vocabulary, "ord", "axis_name", "semantic_label", "candidate_behaviors").collect()
    assert {(r["key"], r["behavior_id"]) for r in out} == {(1, 777), (3, -1)}
    n = M.Names([(k, tuple(x.split()), x.replace(" ", "")) for k, x in enumerate(names[:3000])])
    for joined in ("aku bni", "akubnitem", "bluxnitm", "jtoxz item", "xyz"):
        joined = joined.replace(" ", "")
        want = {x for x in names[:3000] if M.edits(joined, x.replace(" ", ""), 3) <= M.allowed(len(x) - 1)}
        assert want <= {" ".join(n.names[k][1]) for k in n.near(joined, False)}
