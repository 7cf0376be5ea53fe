"""Column builders for cell texts: trimming, hashing, slugs, list and JSON cells."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the mark between the parts of a hashed key.
KEY_MARK = "␟"
_SPACE = r"[\s\x0B\p{Z}]"


def strip(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(c, f"^{_SPACE}+|{_SPACE}+$", "")


def text(c: Column) -> Column:
    """Stripped text, '' for NULL."""
    return F.coalesce(strip(c), F.lit(""))


def stable_hash(*parts: Column, length: int = 16) -> Column:
    """First hex digits of the SHA-1 of the parts joined by the key mark; NULL counts as ''."""
    return F.substring(F.sha1(F.concat_ws(KEY_MARK, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, length)


def slugify(c: Column, max_length: int = 80) -> Column:
    """Lower case; anything but Latin and Hangul letters, digits, '.', '_' and '-' becomes one '_'; no '_' or '.' at the ends; never empty."""
    runs = F.regexp_replace(F.regexp_replace(F.lower(strip(c)), "[^a-z0-9가-힣._-]+", "_"), "_+", "_")
    bare = F.regexp_replace(runs, r"^[_.]+|[_.]+$", "")
    return F.left(F.when(F.coalesce(bare, F.lit("")) == "", F.lit("item")).otherwise(bare), F.lit(max_length))


def normalize_label(c: Column) -> Column:
    return F.replace(F.lower(text(c)), F.lit(" "), F.lit("_"))


def join_distinct(c: Column, sep: str = ";") -> Column:
    """The distinct parts of a ';' list, in order, joined by '; '."""
    parts = F.filter(F.transform(F.split(c, sep), strip), lambda x: x != "")
    return F.array_join(F.array_distinct(parts), "; ")


def serialize_cell(c: Column, kind: T.DataType) -> Column:
    """NULL as '', nested values as JSON with sorted keys, others as text."""
    if isinstance(kind, T.MapType):
        return F.coalesce(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c)))), F.lit(""))
    if isinstance(kind, T.StructType):
        return F.coalesce(F.to_json(F.struct(*[c[n].alias(n) for n in sorted(kind.names)])), F.lit(""))
    if isinstance(kind, (T.ArrayType, T.VariantType)):
        return F.coalesce(F.to_json(c), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


def cell_json(c: Column) -> Column:
    """A JSON cell as variant; blank is NULL, what is no JSON is kept as a text."""
    t = F.when(text(c) != "", strip(c))
    return F.coalesce(F.try_parse_json(t), t.cast("variant"))


def json_list(c: Column) -> Column:
    """A JSON array of texts; anything else is the empty list."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def literal_items(value: str | None) -> list[str]:
    """A Python list, tuple or set written as text (sorted), else parts at '|', else at ',', else one item."""
    whole = (value or "").strip()
    if not whole:
        return []
    try:
        found = ast.literal_eval(whole)
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        found = None
    if isinstance(found, (list, tuple, set)):
        return sorted(t for t in (str(x).strip() for x in found) if t)
    for sep in "|,":
        if sep in whole:
            return [t for t in map(str.strip, whole.split(sep)) if t]
    return [whole]


@F.pandas_udf(T.ArrayType(T.StringType()))
def parse_literal_list(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for values in batches:
        yield values.map(literal_items)
