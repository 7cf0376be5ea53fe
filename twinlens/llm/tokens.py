"""Token counts and offsets of a public subword tokenizer, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vocabulary file; a parameter of every operator that counts tokens. Its offsets tile the text, white space included.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


@lru_cache(maxsize=4)
def encoder(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def count_tokens(texts: Sequence[str | None], path: str = VOCABULARY) -> list[int]:
    """Number of tokens of each text; NULL counts 0."""
    tok = encoder(path)
    return [len(tok.encode(t)) if t else 0 for t in texts]


@lru_cache(maxsize=4)
def token_lengths(path: str) -> np.ndarray:
    """Characters that each token of the vocabulary stands for; the bytes of a character that has no token count at its first byte."""
    tok = encoder(path)

    def length(k: int) -> int:
        if tok.is_byte(k):
            return int(not 0x80 <= int(tok.id_to_piece(k)[1:-1], 16) < 0xC0)
        return 1 if tok.is_unknown(k) else len(tok.id_to_piece(k))

    return np.array([length(k) for k in range(tok.vocab_size())], dtype=np.int64)


def token_starts(text: str, path: str = VOCABULARY) -> np.ndarray:
    """Character at which each token begins.

    Tokens tile the text, so their lengths add up; where a vocabulary changes the text and they do not, the tokenizer's own offsets are taken.
    """
    if not text:
        return np.zeros(0, dtype=np.int64)
    tok = encoder(path)
    lengths = token_lengths(path)[tok.encode(text)]
    lengths[0] -= 1  # the blank put before every text
    if lengths.sum() == len(text):
        return np.cumsum(lengths) - lengths
    return np.array([a for a, _ in tok.encode_as_offset_mapping(text)["offsets"]], dtype=np.int64)


def with_tokens(df: DataFrame, text: str, name: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """Replaces the text column by its number of tokens. Only the narrow row leaves Python."""
    kept = [c for c in df.columns if c != text]
    schema = df.select(*[F.col(f"`{c}`") for c in kept]).withColumn(name, F.lit(0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = pa.array(count_tokens(batch.column(len(kept)).to_pylist(), vocabulary), pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept))), counts], names=[*kept, name])

    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("_text")).mapInArrow(run, schema)
