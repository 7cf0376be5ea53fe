"""Mapping free-typed values to the entries of a canonical list.

A multi-pattern automaton over the names and aliases of all entries finds the
mentions in the folded tokens of a value; of overlapping mentions the longest
stands. Values without a mention go to a token-set similarity that forgives
typing errors, order, joined or split words and cut-off ends. The names a window of
tokens can be near to are found by length and by counts of letters: an error changes
the length by at most one and the counts by at most two, so no name is missed and
few are compared letter by letter.

The result is the entry's id; UNMATCHED when the value names no entry of its
group, or more than one. Blank and NULL values and groups without entries are
unmatched. Repeated values and ties: equal texts get equal results; two entries
equally near a text make it unmatched. Texts of any length are read whole.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens.llm.text_forms import plain

UNMATCHED = -1
#: The list goes to every worker, so its size is checked. A longer one is matched in blocks of whole groups.
MAX_ENTRIES = 500_000
#: Words around an answer that name nothing.
FILLERS = frozenset(
    "a an the is it its i think so im am be been was this that these those of to in on at by like looks look seems seem appears mostly mainly kind sort clearly definitely certainly probably possibly perhaps maybe "
    "rather quite very sure answer label value choice final result my me would say guess or and with more less only just some bit also most likely called".split()
)
#: Texts that say only that no decision could be made.
_JOINTS = re.compile(r"\s*(?:[,;/+&|]|\bor\b|\band\b|\bvs\b)\s*")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_TOKEN = re.compile(r"[^\W_]+")
_DIGIT_LOOK = str.maketrans("01345", "oleas")


def tokens(text: str, known: frozenset[str] | None = None, camel: bool = False) -> list[str]:
    """Folded word tokens; digits that stand for letters are read as letters unless the token is known."""
    text = plain(text).replace("'", "").replace("’", "")
    if camel:
        text = _CAMEL.sub(" ", text)
    out = _TOKEN.findall(text.lower())
    if known is not None:
        out = [t if t in known or t.isalpha() or not any(c.isalpha() for c in t) else t.translate(_DIGIT_LOOK) for t in out]
    return out


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours (optimal string alignment); most + 1 when it is greater."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        if min(now) > most:
            return most + 1
        before, row = row, now
    return row[-1]


def allowed(length: int) -> int:
    """Typing errors forgiven in a name of so many letters."""
    return 0 if length < 3 else 1 if length < 5 else 2 if length < 11 else 3


def letter_counts(text: str) -> np.ndarray:
    """Counts of 32 classes of characters."""
    return np.bincount([ord(c) % 32 for c in text], minlength=32).astype(np.int16)


class Names:
    """The names of a group, sorted by length of their letters, and again by letters."""

    def __init__(self, names: list[tuple[int, tuple[str, ...], str]]):
        self.names = sorted(names, key=lambda n: len(n[2]))
        self.lengths = np.array([len(n[2]) for n in self.names])
        self.most = np.array([allowed(k) for k in range(int(self.lengths[-1]) + 1)])[self.lengths]
        self.counts = np.stack([letter_counts(n[2]) for n in self.names])
        self.order = sorted(range(len(self.names)), key=lambda k: self.names[k][2])
        self.letters = [self.names[k][2] for k in self.order]
        #: Tokens of a window: as many as the longest name has and one more, in case a word was split; at least five.
        self.window = max(5, 1 + max(len(n[1]) for n in self.names))

    def near(self, joined: str, strict: bool) -> list[int]:
        """Names that can be made of the letters with the errors forgiven."""
        a, b = np.searchsorted(self.lengths, [len(joined) - 3, len(joined) + 4])
        most = np.minimum(self.most[a:b], 1) if strict else self.most[a:b]
        fits = (np.abs(self.lengths[a:b] - len(joined)) <= most) & (np.abs(self.counts[a:b] - letter_counts(joined)).sum(axis=1) <= 2 * most)
        return (np.flatnonzero(fits) + a).tolist()

    def begun(self, joined: str) -> list[int]:
        """Names whose letters go on after these."""
        at = bisect_right(self.letters, joined)
        out = []
        while at < len(self.letters) and self.letters[at].startswith(joined):
            out.append(self.order[at])
            at += 1
        return out


class Matcher:
    def __init__(self, entries: Iterable[tuple[str, int, Sequence[str]]], fillers: frozenset[str] = FILLERS):
        """entries: (group, id, names); fillers: words around an answer, none of the list."""
        self.automaton = ahocorasick.Automaton()
        listed: dict[str, list[tuple[int, tuple[str, ...], str]]] = defaultdict(list)
        patterns: dict[str, list[tuple[str, int]]] = defaultdict(list)
        known: set[str] = set()
        for group, entry, names in entries:
            for name in names:
                if toks := tuple(tokens(name)):
                    listed[group].append((entry, toks, "".join(toks)))
                    patterns[" " + " ".join(toks) + " "].append((group, entry))
                    known.update(toks)
        self.names = {group: Names(n) for group, n in listed.items()}
        self.known = frozenset(known)
        self.fillers = fillers - self.known
        for pattern, owners in patterns.items():
            self.automaton.add_word(pattern, (len(pattern), owners))
        if patterns:
            self.automaton.make_automaton()
        self.match = lru_cache(maxsize=200_000)(self._match)

    def mentions(self, group: str, toks: Sequence[str]) -> tuple[set[int], list[str]]:
        """Ids mentioned, longest non-overlapping first, and the tokens left over."""
        text = " " + " ".join(toks) + " "
        found = [(end - length + 1, end, entry) for end, (length, owners) in self.automaton.iter(text) for g, entry in owners if g == group] if self.names else []
        taken: list[tuple[int, int]] = []
        ids: set[int] = set()
        for start, end, entry in sorted(found, key=lambda m: (m[0] - m[1], m[0])):
            if all(end <= s or start >= e for s, e in taken) or (start, end) in taken:
                taken.append((start, end))
                ids.add(entry)
        left, at = [], 0
        for start, end in sorted(set(taken)):
            left += text[at:start].split()
            at = end
        return ids, left + text[at:].split()

    def similar(self, group: str, toks: Sequence[str], strict: bool = False) -> int:
        """The entry most similar to the tokens, by token set and letters; UNMATCHED if none or two."""
        telling = [t for t in toks if t not in self.fillers]
        if len("".join(telling)) < 3:
            return UNMATCHED
        names, best, told = self.names[group], {}, set(telling)
        windows = dict.fromkeys(tuple(toks[i:j]) for i in range(len(toks)) for j in range(i + 1, min(i + names.window, len(toks)) + 1))
        windows = [w for w in windows if any(t in told for t in w)]
        if telling != list(toks):
            windows.append(tuple(telling))
        low: dict[int, int] = {}
        for window in windows:
            joined = "".join(window)
            for at in names.near(joined, strict):
                _, name, letters = names.names[at]
                most = min(allowed(len(letters)), 1) if strict else allowed(len(letters))
                d = edits(joined, letters, most)
                if len(window) > 1 and d and len(name) > 1:
                    d = min(d, edits("".join(sorted(window)), "".join(sorted(name)), most), self._set_distance(window, name, most))
                if d <= most and d < low.get(at, most + 1):
                    low[at] = d
        near = {at for at, d in low.items() if not (d and d * 3 > len(names.names[at][2]) and len(names.names[at][2]) > 3)}
        for at in near:
            entry = names.names[at][0]
            best[entry] = min(best.get(entry, 99.0), low[at])
        if not strict:
            for at in names.begun("".join(telling)):
                entry, name, letters = names.names[at]
                if at not in near and self._cut_off(telling, name, letters):
                    best[entry] = min(best.get(entry, 99.0), 3.5)
        if not best:
            return UNMATCHED
        least = min(best.values())
        first = [e for e, d in best.items() if d == least]
        return first[0] if len(first) == 1 else UNMATCHED

    @staticmethod
    def _set_distance(window: Sequence[str], name: Sequence[str], most: int) -> int:
        """Errors of the cheapest pairing of the tokens of two equally large sets, greedily."""
        if len(window) != len(name):
            return most + 1
        rest, total = list(name), 0
        for t in window:
            d, k = min((edits(t, n, most), k) for k, n in enumerate(rest))
            total += d
            if total > most:
                return most + 1
            rest.pop(k)
        return total

    @staticmethod
    def _cut_off(toks: Sequence[str], name: Sequence[str], letters: str) -> bool:
        """The tokens are the beginning of the name: at least four letters, or its first words."""
        joined = "".join(toks)
        return joined != letters and letters.startswith(joined) and (len(joined) >= 4 or joined == name[0])

    def _named(self, group: str, toks: Sequence[str]) -> set[int]:
        """Entries that a piece of text names: none, one or more."""
        ids, left = self.mentions(group, toks)
        if not ids:
            one = self.similar(group, toks)
            return {one} - {UNMATCHED}
        other = self.similar(group, left, strict=True)
        return ids | ({other} - {UNMATCHED})

    def _match(self, group: str | None, text: str | None) -> int:
        if not text or group not in self.names:
            return UNMATCHED
        found: set[int] = set()
        for camel in (False, True):
            toks = tokens(text, self.known, camel)
            if camel and toks == first:
                break
            first = toks
            ids, left = self.mentions(group, toks)
            if len(ids) > 1:
                return UNMATCHED
            found |= ids
        if not found:
            whole = self.similar(group, first)
            if whole != UNMATCHED and not self._several(group, text):
                return whole
            if whole == UNMATCHED:
                found = set().union(*(self._named(group, tokens(p, self.known)) for p in _JOINTS.split(plain(text)))) or self._named(group, first)
                return found.pop() if len(found) == 1 else UNMATCHED
            return UNMATCHED
        if len(found) > 1 or self._several(group, text):
            return UNMATCHED
        return found.pop()

    def _several(self, group: str, text: str) -> bool:
        """Whether the parts of a text between commas, slashes, 'or' and the like name different entries."""
        parts = [tokens(p, self.known, True) for p in _JOINTS.split(plain(text))]
        parts = [p for p in parts if p]
        if len(parts) < 2:
            return False
        return len(set().union(*(self._named(group, p) for p in parts))) > 1


def canonical_of(vocab: DataFrame) -> list[tuple[str, int, str, list[str]]]:
    """The reference list on the driver, its size checked."""
    rows = vocab.select("axis_name", "behavior_id", "canonical_label", "aliases").limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"the reference list has more than {MAX_ENTRIES} entries; map it in blocks of whole axes with map_values_in_blocks")
    return [(r[0], r[1], r[2], [a for a in r[3] or [] if a]) for r in rows if r[0] is not None and r[2]]


def listed_items(c: Column) -> Column:
    """Items of a list cell: a JSON array, or an older bar-separated list; a missing cell has none."""
    return F.when(F.trim(c) == "", None).when(F.ltrim(c).startswith("["), F.coalesce(F.from_json(c, "array<string>"), F.split(c, r"\|"))).otherwise(F.split(c, r"\|"))


def map_values(df: DataFrame, vocab: DataFrame, key: str, group: str, value: str, items: str) -> DataFrame:
    """One row (key, field_name, item_pos, text, behavior_id) per value of ``value`` (position 0) and item of the list ``items`` (from 1) that is not exactly a canonical name of its group.

    Exact names are set aside in the JVM by a join to the list, whose size is checked; only the others go to Python, in Arrow batches. Nothing is shuffled.
    """
    entries = canonical_of(vocab)
    base = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{group}`").cast("string").alias("axis"), F.col(f"`{value}`").cast("string").alias("value"), listed_items(F.col(f"`{items}`").cast("string")).alias("items"))
    cells = "array<struct<field_name:string,item_pos:int,text:string>>"
    cell = lambda field, pos, text: F.struct(F.lit(field).alias("field_name"), pos.cast("int").alias("item_pos"), text.alias("text"))
    single = F.when(F.trim("value") != "", F.array(cell(value, F.lit(0), F.col("value")))).otherwise(F.array().cast(cells))
    listed = F.coalesce(F.transform("items", lambda x, i: cell(items, i + 1, x)), F.array().cast(cells))
    every = base.select("key", "axis", F.explode(F.concat(single, listed)).alias("c")).select("key", "axis", "c.*")
    exact = df.sparkSession.createDataFrame([(axis, label) for axis, _, label, _ in entries], "axis string, text string").distinct()
    odd = every.join(F.broadcast(exact), ["axis", "text"], "left_anti")
    given = df.sparkSession.sparkContext.broadcast([(axis, entry, [label, *aliases]) for axis, entry, label, aliases in entries])

    @F.pandas_udf("int")
    def meant(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        matcher = Matcher(given.value)
        for axis, text in batches:
            yield pd.Series([matcher.match(a, t) for a, t in zip(axis, text, strict=True)], dtype="int32")

    return odd.select("key", "axis", "field_name", "item_pos", "text").withColumn("behavior_id", meant("axis", "text"))


def map_values_in_blocks(df: DataFrame, vocab: DataFrame, key: str, group: str, value: str, items: str, most: int = MAX_ENTRIES) -> DataFrame:
    """map_values for a reference list of more than MAX_ENTRIES entries: blocks of whole groups, one after another, each over the rows of its groups."""
    sizes = [(r[0], r[1]) for r in vocab.filter("axis_name is not null").groupBy("axis_name").count().orderBy("axis_name").collect()]
    blocks: list[list[str]] = [[]]
    load = 0
    for axis, n in sizes:
        if load + n > most and blocks[-1]:
            blocks.append([])
            load = 0
        blocks[-1].append(axis)
        load += n
    name = F.col(f"`{group}`").cast("string")
    parts = [map_values(df.filter(name.isin(b)), vocab.filter(F.col("axis_name").isin(b)), key, group, value, items) for b in blocks if b]
    rest = map_values(df.filter(F.coalesce(~name.isin([a for a, _ in sizes]), F.lit(True))), vocab.limit(0), key, group, value, items)
    for part in parts:
        rest = rest.unionByName(part)
    return rest


def unmatched_report(mapped: DataFrame) -> DataFrame:
    """The unmatched texts with their number: axis, text, uses."""
    return mapped.filter(F.col("behavior_id") == UNMATCHED).groupBy("axis", "text").agg(F.count("*").alias("uses"))


def brute_force(entries: Sequence[tuple[str, int, str, list[str]]], rows: Iterable[tuple[str, str]]) -> Counter:
    """Exact names only, for tests: the number of rows per id of texts that are a name or alias in other case and spacing."""
    out: Counter = Counter()
    for axis, text in rows:
        ids = {e for a, e, label, aliases in entries if a == axis for n in [label, *aliases] if tokens(n) == tokens(text or "")}
        out[ids.pop() if len(ids) == 1 else UNMATCHED] += 1
    return out
