"""Cutting oversized texts into pieces at natural boundaries.

The token offsets of a text and, per kind, the sorted token positions of its
natural boundaries (paragraph, line, sentence, word) are arrays. From each piece's start the last
boundary under the limit is found by binary search, of the coarsest kind that
leaves the piece at least half full; without any, the cut is hard. The next
piece starts exactly ``overlap`` tokens before the cut.

Every piece has fewer tokens than the limit, also when its text is tokenized on
its own; only a piece that could not be shortened without losing the overlap (its
text has more tokens alone than within the whole) may have more then. Texts with at most ``limit`` tokens, NULL and empty ones give no rows;
repeated keys are cut each for itself. Texts of any length are read whole.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlens.llm.tokens import VOCABULARY, count_tokens, token_starts

#: Ends of the natural units, coarsest first: the boundary lies after the match.
UNITS = (
    ("paragraph", re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+|\f")),
    ("line", re.compile(r"\r\n|\n|\r| ")),
    ("sentence", re.compile(r"[.!?…。！？]+[\"'”’»)\]]*(?=\s|$)|[。！？]")),
    ("word", None),
)
_SPACES = np.array([ord(c) for c in map(chr, range(0x3001)) if c.isspace()], dtype=np.uint32)


class Piece(NamedTuple):
    start_token: int
    end_token: int
    start_char: int
    end_char: int
    cut: str


def boundaries(text: str, starts: np.ndarray) -> list[tuple[str, list[int]]]:
    """Per kind, the sorted token positions at which a natural unit has just ended."""
    out = []
    for kind, pattern in UNITS:
        if pattern is None:
            blank = np.isin(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), _SPACES)
            ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
        else:
            ends = np.fromiter((m.end() for m in pattern.finditer(text)), dtype=np.int64)
        at = np.searchsorted(starts, ends, "left")
        fits = at < len(starts)
        ends, at = ends[fits], at[fits]
        clean = starts[at] == ends
        for k in np.flatnonzero(~clean):
            clean[k] = not text[ends[k] : starts[at[k]]].strip()
        out.append((kind, np.unique(at[clean]).tolist()))
    return out


def split(text: str, limit: int, overlap: int, vocabulary: str = VOCABULARY) -> list[Piece]:
    """The pieces of one text; none if it has at most ``limit`` tokens."""
    starts = token_starts(text, vocabulary)
    n = len(starts)
    if n <= limit:
        return []
    chars = np.append(starts, len(text))
    units = boundaries(text, starts)
    pieces, at = [], 0
    begin = lambda k: int(chars[k]) if k else 0
    while True:
        most = limit - 1
        while True:
            end, cut = _cut(at, n, most, overlap, units)
            over = count_tokens([text[begin(at) : int(chars[end])]], vocabulary)[0] - (limit - 1)
            if over <= 0 or most - over <= overlap:
                break
            most = min(end - at, most) - over
        pieces.append(Piece(at, end, begin(at), int(chars[end]), cut))
        if end == n:
            return pieces
        at = end - overlap


def _cut(at: int, n: int, most: int, overlap: int, units: list[tuple[str, list[int]]]) -> tuple[int, str]:
    if n - at <= most:
        return n, "end"
    for kind, where in units:
        k = bisect_right(where, at + most) - 1
        if k >= 0 and where[k] > at + (overlap if kind == "word" else max(overlap, most // 2)):
            return where[k], kind
    return at + most, "hard"


def split_texts(df: DataFrame, key: str, text: str, limit: int, overlap: int, with_text: bool = True, vocabulary: str = VOCABULARY) -> DataFrame:
    """(piece_key, piece_no from 1, pieces, start_token, end_token, start_char, end_char, cut, piece_text) of every text with more than ``limit`` tokens.

    A token holds at least one byte of the text or of the blank put before it, so a text of fewer than ``limit`` bytes has at most ``limit`` tokens and is not tokenized.
    """
    if not 0 <= overlap < limit - 1:
        raise ValueError("the overlap must be smaller than the pieces")
    names = ["piece_key", "piece_no", "pieces", "start_token", "end_token", "start_char", "end_char", "cut"] + ["piece_text"] * with_text
    kinds = [pa.int64()] + [pa.int32()] * 6 + [pa.string()] * (1 + with_text)
    arrow = pa.schema(list(zip(names, kinds, strict=True)))
    schema = T.StructType([T.StructField(n, T.LongType() if k == pa.int64() else T.IntegerType() if k == pa.int32() else T.StringType()) for n, k in zip(names, kinds, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece_key, value in zip(batch.column(0), batch.column(1), strict=True):
                value = value.as_py()
                pieces = split(value, limit, overlap, vocabulary)
                rows = [(piece_key.as_py(), no, len(pieces), *p, *([value[p.start_char : p.end_char]] * with_text)) for no, p in enumerate(pieces, 1)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=arrow)

    long = df.select(F.col(f"`{key}`").cast("bigint").alias("piece_key"), F.col(f"`{text}`").cast("string").alias("piece_text")).filter(F.octet_length("piece_text") >= limit)
    return long.mapInArrow(run, schema)
