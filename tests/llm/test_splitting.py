import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from twinlens.llm import splitting as S
from twinlens.llm.tokens import VOCABULARY, count_tokens, encoder, token_starts

WORDS = "alpha beta. gamma, delta! naïve 서울 epsilon? 😀 zeta".split()


def text_of(n, seed=0, joint=(" ", "\n", "\n\n")):
    rng = random.Random(seed)
    return "".join(rng.choice(WORDS) + rng.choice(joint) for _ in range(n))


def check(text, limit, overlap):
    pieces = S.split(text, limit, overlap)
    n = count_tokens([text])[0]
    if n <= limit:
        assert not pieces
        return pieces
    assert pieces[0].start_token == pieces[0].start_char == 0 and pieces[-1].end_token == n and pieces[-1].end_char == len(text)
    for p in pieces:
        assert 0 < p.end_token - p.start_token < limit
        assert count_tokens([text[p.start_char : p.end_char]])[0] < limit
    for p, q in zip(pieces, pieces[1:], strict=False):
        assert q.start_token == p.end_token - overlap and q.end_token > p.end_token
    whole = text[: pieces[0].end_char] + "".join(text[p.end_char : q.end_char] for p, q in zip(pieces, pieces[1:], strict=False))
    assert whole == text
    return pieces


@pytest.mark.parametrize("limit,overlap", [(64, 8), (200, 0), (50, 20)])
def test_pieces(limit, overlap):
    for seed in range(4):
        assert check(text_of(400, seed), limit, overlap)


def test_boundaries_are_natural_where_there_are_any():
    text = "\n\n".join("one two three four five six seven." for _ in range(40))
    assert {p.cut for p in check(text, 64, 4)} == {"paragraph", "end"}
    assert {p.cut for p in check(text.replace("\n\n", " "), 64, 4)} == {"sentence", "end"}
    assert {p.cut for p in check("word " * 500, 64, 4)} == {"word", "end"}
    assert {p.cut for p in check("x" * 4000, 64, 4)} == {"hard", "end"}
    check("\n" * 3000, 64, 4)
    check("서" * 3000 + "𐍈" * 300, 64, 4)


@settings(max_examples=40, deadline=None)
@given(st.text(st.sampled_from("ab .\n\té서😀​"), min_size=0, max_size=400))
def test_any_text(text):
    check(text, 16, 3)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_offsets_tile_the_text(text):
    starts = token_starts(text)
    assert len(starts) == count_tokens([text])[0]
    assert (np.diff(starts) >= 0).all()
    if text.isprintable() and text:
        slow = [a for a, _ in encoder(VOCABULARY).encode_as_offset_mapping(text)["offsets"]]
        assert len(slow) == len(starts) and starts[0] == 0


def test_table(spark):
    rows = [(1, text_of(600), "k"), (2, "short", "k"), (3, None, "k"), (4, "", "k"), (1, text_of(600), "k"), (5, "y" * 200_000, "k")]
    df = spark.createDataFrame(rows, "doc_id bigint, body string, pieces string")
    out = S.split_texts(df, "doc_id", "body", 128, 16)
    got = out.collect()
    assert {r["piece_key"] for r in got} == {1, 5}
    assert sum(r["piece_no"] == 1 and r["piece_key"] == 1 for r in got) == 2
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        assert r["piece_text"] == texts[r["piece_key"]][r["start_char"] : r["end_char"]]
    assert S.split_texts(df.limit(0), "doc_id", "body", 128, 16).count() == 0
    with pytest.raises(ValueError):
        S.split_texts(df, "doc_id", "body", 10, 9)


def test_a_text_of_as_many_bytes_as_the_limit_may_be_too_long(spark):
    """Each of these characters is a token, and so is the blank put before the text."""
    text = "\n" * 64
    assert len(token_starts(text)) == 65
    df = spark.createDataFrame([(1, text), (2, "\n" * 63)], "k bigint, t string")
    assert {r["piece_key"] for r in S.split_texts(df, "k", "t", 64, 8).collect()} == {1}
