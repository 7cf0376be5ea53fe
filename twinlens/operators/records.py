"""Parsing delimited records whose rows may be broken.

A recursive-descent grammar reads a text:

    text    := record (newline record)*
    record  := field (delimiter field)*
    field   := quoted | plain
    quoted  := '"' (any character but '"', or '""')* '"'     followed by a delimiter, a newline or the end
    plain   := characters other than delimiter, quote and newline

A field that breaks the grammar is located (offset and field number) and the
parser recovers: it resumes at the first validated record start after the beginning
of that field, a line start at which the anchor pattern matches, so that one broken
quote cannot swallow the rows after it. A line inside a quoted field that begins like a
record is taken for one, and the record before it for broken. Without a later anchor the rest of the text is the broken record.

A text that is itself one undecoded record (``single=True``) may hold line
breaks anywhere; one final carriage return is dropped. NULL counts as the empty text: one
empty field. A record is checked in order: quoting, number of fields, then each
checked field; one error per bad field, one for the other two reasons.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from twinlens.functions.values import FALSE_WORDS, NUMBER, TRUE_WORDS

_NUMBER = re.compile(NUMBER.replace(r"\z", r"\Z"))
_WORDS = frozenset(TRUE_WORDS + FALSE_WORDS)


class Syntax(NamedTuple):
    """A located error."""

    reason: str
    offset: int
    field_no: int
    value: str | None


class Record(NamedTuple):
    start: int
    end: int
    fields: list[str]
    errors: list[Syntax]


class Broken(Exception):
    """Where the grammar fails, and where the failing field begins: a broken quote may have swallowed records since."""

    def __init__(self, offset: int, field_no: int, begin: int):
        super().__init__(offset, field_no, begin)
        self.offset, self.field_no, self.begin = offset, field_no, begin


@dataclass(frozen=True)
class Within:
    """Not missing means a number in [low, high]."""

    low: float
    high: float

    def __call__(self, text: str) -> bool:
        t = text.strip(" ")
        return not t or (bool(_NUMBER.match(t)) and self.low <= float(t) <= self.high)


@dataclass(frozen=True)
class Truth:
    """Not missing means one of the truth words."""

    def __call__(self, text: str) -> bool:
        t = text.strip(" ").lower()
        return not t or t in _WORDS


@dataclass(frozen=True)
class Layout:
    """Names of the fields in order, the checks by name, and the pattern that validates a record start."""

    names: Sequence[str]
    checks: dict[str, Callable[[str], bool]] = field(default_factory=dict)
    anchor: str = r"[0-9a-f]{16},"
    delimiter: str = ","


class Grammar:
    def __init__(self, layout: Layout):
        self.layout = layout
        self.sep = layout.delimiter
        self.anchor = re.compile(rf"(?:(?<=\n)|(?<=\r))(?={layout.anchor})")

    def parse(self, text: str, single: bool = False) -> Iterator[Record]:
        """All records of a text. ``single``: the whole text is one record."""
        if single and text.endswith("\r"):
            text = text[:-1]
        at, end = 0, len(text)
        while True:
            start = at
            fields: list[str] = []
            try:
                at = self._record(text, at, fields, single)
                stop, errors = at, self._check(fields, start)
                # An open quote that meets the quotes of a later record closes by chance: a record start inside a record tells.
                inner = None if single else self.anchor.search(text, start + 1, stop)
                if inner:
                    at = inner.start() - 1
                    stop, errors = at, [Syntax("quoting", start, 0, None)]
            except Broken as broken:
                again = None if single else self.anchor.search(text, broken.begin)
                at = end if again is None else again.start() - 1
                stop, errors = at, [Syntax("quoting", broken.offset, broken.field_no, None)]
            if not single and not errors and stop == start == end and start > 0:
                return  # the text ended with a newline
            yield Record(start, stop, fields, errors)
            if at >= end:
                return
            at += 1
            if at == end:
                return

    def _record(self, text: str, at: int, fields: list[str], single: bool) -> int:
        while True:
            at = self._field(text, at, fields, single)
            if at >= len(text) or text[at] != self.sep:
                return at
            at += 1

    def _field(self, text: str, at: int, fields: list[str], single: bool) -> int:
        return (self._quoted if text.startswith('"', at) else self._plain)(text, at, fields, single)

    def _quoted(self, text: str, at: int, fields: list[str], single: bool) -> int:
        begin, parts, at = at, [], at + 1
        while True:
            close = text.find('"', at)
            if close < 0:
                raise Broken(begin, len(fields) + 1, begin)
            parts.append(text[at:close])
            at = close + 1
            if not text.startswith('"', at):
                break
            parts.append('"')
            at += 1
        if at == len(text) or text[at] == self.sep or (not single and text[at] in "\r\n"):
            fields.append("".join(parts))
            return self._line_end(text, at, single)
        raise Broken(at, len(fields) + 1, begin)

    def _plain(self, text: str, at: int, fields: list[str], single: bool) -> int:
        stop = text.find(self.sep, at)
        stop = len(text) if stop < 0 else stop
        if not single:
            line = text.find("\n", at, stop)
            stop = stop if line < 0 else line
        quote = text.find('"', at, stop)
        if quote >= 0:
            raise Broken(quote, len(fields) + 1, at)
        value = text[at:stop]
        if not single and text.startswith("\n", stop) and value.endswith("\r"):
            value = value[:-1]
        fields.append(value)
        return stop

    @staticmethod
    def _line_end(text: str, at: int, single: bool) -> int:
        return at + 1 if not single and text.startswith("\r\n", at) else at

    def _check(self, fields: list[str], start: int) -> list[Syntax]:
        names = self.layout.names
        if len(fields) != len(names):
            return [Syntax("column_count", start, len(fields), None)]
        return [Syntax(name, start, k + 1, value) for k, (name, value) in enumerate(zip(names, fields, strict=True)) if name in self.layout.checks and not self.layout.checks[name](value)]


#: The ten fields of a label update, in file order.
LABEL_UPDATE = Layout(
    ("label_uid", "semantic_label", "semantic_label_confidence", "pass_score", "quality_score", "refusal", "unsafe", "memorization_score", "evaluator", "notes"),
    {"pass_score": Within(0, 1), "quality_score": Within(1, 5), "refusal": Truth(), "unsafe": Truth()},
    r'"?[0-9a-f]{16}(?![0-9A-Za-z])',
)

ERRORS = T.ArrayType(T.StructType([T.StructField("reason", T.StringType()), T.StructField("offset", T.IntegerType()), T.StructField("field_no", T.IntegerType()), T.StructField("value", T.StringType())]))


def parse_lines(df: DataFrame, key: str, text: str, layout: Layout = LABEL_UPDATE, single: bool = True) -> DataFrame:
    """One row per record: line_key, record_no (from 1), fields (array), errors (array of reason, offset, field_no, value).

    The text goes to Python in Arrow batches; each row is parsed on its own, so nothing is shuffled.
    """
    schema = T.StructType([T.StructField("line_key", T.LongType()), T.StructField("record_no", T.IntegerType()), T.StructField("fields", T.ArrayType(T.StringType())), T.StructField("errors", ERRORS)])
    error = pa.struct([("reason", pa.string()), ("offset", pa.int32()), ("field_no", pa.int32()), ("value", pa.string())])
    arrow = pa.schema([("line_key", pa.int64()), ("record_no", pa.int32()), ("fields", pa.list_(pa.string())), ("errors", pa.list_(error))])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(layout)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for line_key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for no, record in enumerate(grammar.parse(raw or "", single), 1):
                    for column, value in zip(out, (line_key, no, record.fields, [e._asdict() for e in record.errors]), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)

    return df.select(F.col(f"`{key}`").cast("bigint").alias("line_key"), F.col(f"`{text}`").cast("string").alias("line_text")).mapInArrow(parse, schema)


#: Lines of a file that are parsed as one text.
BLOCK_LINES = 2000


def parse_files(df: DataFrame, file: str, line_no: str, key: str, text: str, layout: Layout = LABEL_UPDATE, block: int = BLOCK_LINES) -> DataFrame:
    """parse_lines over whole files: their lines are joined in order, in blocks of lines, and the grammar finds the records in them.

    A record has the key of the line in which it starts; record_no counts the records of a block. A record may go over several lines;
    one that would go on in the next block ends with its own.
    """
    schema = T.StructType([T.StructField("line_key", T.LongType()), T.StructField("record_no", T.IntegerType()), T.StructField("fields", T.ArrayType(T.StringType())), T.StructField("errors", ERRORS)])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(layout)
        for batch in batches:
            for lines in batch.column(0).to_pylist():
                starts = list(accumulate((len(x["text"]) + 1 for x in lines), initial=0))
                rows = [
                    {"line_key": lines[min(bisect_right(starts, r.start), len(lines)) - 1]["key"], "record_no": no, "fields": r.fields, "errors": [e._asdict() for e in r.errors]}
                    for no, r in enumerate(grammar.parse("\n".join(x["text"] for x in lines) + "\n"), 1)
                ]
                yield pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(schema))

    line = F.struct(F.col(f"`{line_no}`").alias("no"), F.col(f"`{key}`").cast("bigint").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    blocks = df.groupBy(F.col(f"`{file}`").alias("file"), F.floor(F.col(f"`{line_no}`") / block).alias("block")).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    return blocks.select("lines").mapInArrow(parse, schema)


def valid_records(parsed: DataFrame, layout: Layout = LABEL_UPDATE) -> DataFrame:
    """The records without errors as columns; checked scores as double, truth words as boolean, missing ones NULL."""
    from twinlens.functions.values import filled, number, truth

    def typed(k: int, name: str):
        c = F.get("fields", F.lit(k))
        check = layout.checks.get(name)
        return (number(c) if isinstance(check, Within) else truth(c) if isinstance(check, Truth) else F.when(filled(c), c)).alias(name)

    return parsed.filter(F.size("errors") == 0).select("line_key", "record_no", *[typed(k, name) for k, name in enumerate(layout.names)])


def failed_records(parsed: DataFrame) -> DataFrame:
    """One row per error: line_key, record_no, reason, offset, field_no, value."""
    return parsed.filter(F.size("errors") > 0).select("line_key", "record_no", F.explode("errors").alias("e")).select("line_key", "record_no", "e.*")
