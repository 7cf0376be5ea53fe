"""Consensus labels, agreement and annotator reliability from disagreeing votes.

Mean-field variational inference of the confusion model: an item has a true
class, an annotator turns true class k into label l with a probability of their
own. Dirichlet priors lie on the class shares and on every annotator's row of
every class, with more weight on the right label. In turn, expected counts are
summed by group-bys and turned into expected logarithms by digamma, and the
items' class probabilities follow from the sums of those over their votes.
With ``unvoted`` the true class of an item may be any label of its task, and
every item is iterated, those with one vote too; items with the same votes are
computed once. Without it, it is taken to be one of the labels voted for the
item, so that items with one label have it for certain.

Only the last of several votes of an annotator on an item stands (greatest
``ord``; of equal ones the greatest label). Votes without item, annotator or
label are none. Equal probabilities are resolved towards more votes, then the smaller label. Empty
tables give empty results. Tasks (different label columns) are kept apart.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlens.functions.values import filled, number
from twinlens.plans.skew import join_groups
from twinlens.session import materialize, width

#: Prior votes: per class, on an annotator's right label, and on all wrong labels together.
CLASS_PRIOR, RIGHT_PRIOR, WRONG_PRIOR = 1.0, 4.0, 1.0
#: The rounds of a task end when no class probability of any item moves by more from one round to the next; this is looked at every few rounds.
MAX_ROUNDS, TOLERANCE, CHECK_EVERY = 2000, 1e-4, 5
#: Up to so many rows (about 100 bytes each) the expected logarithms are broadcast; beyond that they are joined by shuffle, hot ones apart.
MAX_BROADCAST_ROWS = 100_000
#: Up to so many (annotator, label, class) the model is held as arrays; beyond that as tables.
MAX_CELLS = 8_000_000
#: Votes whose class probabilities are computed at once, votes in a task of a round (fewer would cost more for the task than for them), and partial counts sent to the driver.
CHUNK_VOTES, PART_VOTES, FAN_IN = 50_000, 1_000_000, 16
#: Up to so many bytes of vote numbers (four for each vote and possible class) the rounds of a task run in one Spark task: a job a round would cost more than the round. Beyond that every round is a job over all items.
SOLO_BYTES = 32_000_000
#: Probabilities as near as this are equal. A class whose score is this far below an item's best is left out (a probability under 1e-13).
EQUAL, NEGLIGIBLE = 1e-12, 30.0
POSTERIOR = "task string, item string, class string, probability double, class_votes bigint, chosen boolean, votes bigint, labels bigint, majority_label string, majority_votes bigint"


def compared(c: Column) -> Column:
    """The form in which labels are compared: no outer plain spaces, lower case, inner spaces as '_'."""
    return F.when(filled(c), F.replace(F.lower(F.trim(c)), F.lit(" "), F.lit("_")))


def digamma(x: Column) -> Column:
    """Digamma for x > 0: eight steps up, then the asymptotic series."""
    y = x + 8
    steps = sum((1 / (x + k) for k in range(1, 8)), 1 / x)
    z = 1 / (y * y)
    return F.log(y) - 1 / (2 * y) - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z / 240))) - steps


def update_votes(df: DataFrame, tasks: tuple[str, ...] = ("semantic_label", "pass_score", "quality_score")) -> DataFrame:
    """Votes (task, item, annotator, label, ord) from label updates: labels in the compared form, pass scores as pass or fail at 0.5, quality scores rounded to 1..5; unusable values are no votes."""
    quality, passed = number(F.col("quality_score")), number(F.col("pass_score"))
    label = {
        "semantic_label": compared(F.col("semantic_label")),
        "pass_score": F.when(passed.between(0, 1), F.when(passed >= 0.5, "pass").otherwise("fail")),
        "quality_score": F.when(quality.between(1, 5), F.floor(quality + 0.5).cast("string")),
    }
    base = df.select(F.col("label_uid").alias("item"), F.when(filled(F.col("evaluator")), F.lower(F.trim("evaluator"))).alias("annotator"), F.col("ord"), F.explode(F.array(*[F.struct(F.lit(t).alias("task"), label[t].alias("label")) for t in tasks])).alias("v"))
    return base.select("v.task", "item", "annotator", "v.label", "ord").filter("item is not null and annotator is not null and label is not null")


def standing(votes: DataFrame) -> DataFrame:
    """The vote that stands per task, item and annotator."""
    return votes.groupBy("task", "item", "annotator").agg(F.max(F.struct("ord", "label")).alias("last")).select("task", "item", "annotator", "last.label")


@dataclass(frozen=True)
class Consensus:
    """posterior: task, item, class, probability, class_votes, chosen, votes, labels, majority_label, majority_votes; per item the voted classes and the chosen one.
    items: task, item, consensus, probability, votes, labels, majority_label, majority_votes.
    annotators: task, annotator, votes, expected_right, reliability, reliability_low, reliability_high, settled_votes, settled_right.
    agreement: task, items, votes, alpha_nominal, alpha_interval (Krippendorff; the latter where labels are numbers)."""

    posterior: DataFrame
    annotators: DataFrame
    agreement: DataFrame
    rounds: int

    @property
    def items(self) -> DataFrame:
        return self.posterior.filter("chosen").select("task", "item", F.col("class").alias("consensus"), "probability", "votes", "labels", "majority_label", "majority_votes")


def _split(votes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per item and label the votes, and per item its totals and majority."""
    tally = votes.groupBy("task", "item", "label").agg(F.count("*").alias("n"))
    totals = tally.groupBy("task", "item").agg(F.sum("n").alias("votes"), F.count("*").alias("labels"), F.max("n").alias("majority_votes"), F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("m"))
    return tally, totals.select("task", "item", "votes", "labels", F.col("m.label").alias("majority_label"), "majority_votes")


def consensus(votes: DataFrame, max_rounds: int = MAX_ROUNDS, tolerance: float = TOLERANCE, level: float = 0.95, settled_votes: int = 3, unvoted: bool = False) -> Consensus:
    """Runs the model over votes (task, item, annotator, label, ord); unvoted: an item's class may be a label of its task that nobody voted for it."""
    votes = materialize(standing(votes), "votes")
    tally, totals = _split(votes)
    item = ["task", "item"]
    cells = votes.select("task", "annotator", "label").distinct().limit(MAX_BROADCAST_ROWS + 1).toPandas()
    fits = len(cells) <= MAX_BROADCAST_ROWS and (cells["task"].map(cells.groupby("task")["label"].nunique()).sum() if len(cells) else 0) <= MAX_CELLS
    posterior, rates, rounds = (_by_arrays(votes, cells, max_rounds, tolerance, unvoted) if fits else _by_tables(votes, tally, materialize(totals, "totals"), max_rounds, tolerance, unvoted))
    settled = totals.filter((F.col("votes") >= settled_votes) & (2 * F.col("majority_votes") > F.col("votes"))).select(*item, "majority_label")
    on_settled = votes.join(settled, item).groupBy("task", "annotator").agg(F.count("*").alias("settled_votes"), F.count_if(F.col("label") == F.col("majority_label")).alias("settled_right"))
    cast = votes.groupBy("task", "annotator").agg(F.count("*").alias("votes"))
    annotators = cast.join(rates, ["task", "annotator"]).join(on_settled, ["task", "annotator"], "left").withColumn("interval", _interval(level)("right", F.col("all") - F.col("right")))
    annotators = annotators.select(
        "task", "annotator", "votes", F.col("right").alias("expected_right"), ((F.col("right") + RIGHT_PRIOR) / (F.col("all") + RIGHT_PRIOR + WRONG_PRIOR)).alias("reliability"), F.col("interval.low").alias("reliability_low"), F.col("interval.high").alias("reliability_high"),
        F.coalesce("settled_votes", F.lit(0)).alias("settled_votes"), F.coalesce("settled_right", F.lit(0)).alias("settled_right"),
    )
    return Consensus(posterior, annotators, agreement(tally), rounds)


def _unfinished(rounds: int, tolerance: float) -> None:
    if tolerance >= 0:
        warnings.warn(f"consensus: class probabilities still move by more than {tolerance} after {rounds} rounds", stacklevel=3)


def _digamma(x: np.ndarray) -> np.ndarray:
    y = x + 8
    steps = sum((1 / (x + k) for k in range(1, 8)), 1 / x)
    z = 1 / (y * y)
    return np.log(y) - 1 / (2 * y) - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z / 240))) - steps


@dataclass(frozen=True)
class _Task:
    """A task: the annotator and label of each of its cells (annotator, label), its classes, and as keys the (cell, class) that can be expected at all, cell x classes + class."""

    first: int
    who: np.ndarray
    label: np.ndarray
    classes: list[str]
    keys: np.ndarray | None = None

    @property
    def far(self) -> float:
        """The most that a class outside the keys can score at an item, its class's share apart: one of the votes has no expected count under it."""
        none, row = _digamma(np.array([WRONG_PRIOR / max(len(self.classes) - 1, 1), RIGHT_PRIOR + WRONG_PRIOR]))
        return float(none - row)

    def supported(self) -> np.ndarray:
        out = np.zeros(len(self.who) * len(self.classes), dtype=bool)
        out[self.keys] = True
        return out.reshape(len(self.who), len(self.classes))

    def logs(self, counts: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected logarithms per key and per class after a round's expected counts."""
        k = len(self.classes)
        cell, to = np.divmod(self.keys, k)
        row = self.who[cell] * k + to
        rows = _digamma(np.bincount(row, counts) + RIGHT_PRIOR + WRONG_PRIOR)
        prior = np.where(self.label[cell] == to, RIGHT_PRIOR, WRONG_PRIOR / max(k - 1, 1))
        return _digamma(counts + prior) - rows[row], _digamma(classes + CLASS_PRIOR)


@dataclass(frozen=True)
class _Items:
    """Rows of votes (items, or sets of items with the same votes) and their possible classes as flat arrays.

    Pairs are (row, class), in order of row; entries are (pair, vote of the row), in order of pair.
    """

    weight: np.ndarray
    pairs: np.ndarray
    to: np.ndarray
    votes: np.ndarray
    given: np.ndarray
    key: np.ndarray

    def held(self, model: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, float]:
        """Class probability of each pair, and the lowest score of a row's best class, class shares apart. Without a model, vote shares."""
        if model is None:
            return self.given / self.votes, math.inf
        logs, shares = model
        s = np.add.reduceat(logs[self.key], np.cumsum(self.votes) - self.votes) + shares[self.to]
        at = np.cumsum(self.pairs) - self.pairs
        most = np.maximum.reduceat(s, at)
        e = np.exp(s - np.repeat(most, self.pairs))
        return e / np.repeat(np.add.reduceat(e, at), self.pairs), float(most.min() - shares.max())


_FLAT = {"weight": np.float64, "pairs": np.int32, "to": np.int32, "votes": np.int32, "given": np.int32, "key": np.int32}


def _chunks(batch: pd.DataFrame, tasks: Mapping[int, _Task]) -> Iterator[tuple[int, pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]]:
    """Per task and up to about CHUNK_VOTES votes: task number, rows, their cells in the task, and the number and the start of each row's."""
    for no, rows in batch.groupby("no", sort=False):
        sizes = rows["cells"].map(len).to_numpy()
        part = np.cumsum(sizes) // CHUNK_VOTES
        for p in np.unique(part):
            some, n = rows[part == p], sizes[part == p]
            yield int(no), some, np.concatenate(some["cells"].to_list()) - tasks[int(no)].first, n, np.cumsum(n) - n


def _voted(task: _Task, cell: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Votes per row and class."""
    k = len(task.classes)
    return np.bincount(np.repeat(np.arange(len(n)), n) * k + task.label[cell], minlength=len(n) * k).reshape(-1, k)


def _items(task: _Task, supported: np.ndarray, weight: np.ndarray, cell: np.ndarray, n: np.ndarray, starts: np.ndarray, unvoted: bool) -> _Items:
    """A class is possible for a row if every vote of the row can be expected under it."""
    voted = _voted(task, cell, n)
    row, to = np.nonzero(np.logical_and.reduceat(supported[cell], starts, axis=0) if unvoted else voted)
    votes = n[row]
    entry = np.arange(votes.sum()) - np.repeat(np.cumsum(votes) - votes, votes) + np.repeat(starts[row], votes)
    key = np.searchsorted(task.keys, cell[entry].astype(np.int64) * len(task.classes) + np.repeat(to, votes))
    return _Items(weight, np.bincount(row, minlength=len(n)), to, votes, voted[row, to], key)


def _by_arrays(votes: DataFrame, cells: pd.DataFrame, max_rounds: int, tolerance: float, unvoted: bool) -> tuple[DataFrame, DataFrame, int]:
    """(posterior; task, annotator, right, all; rounds): every worker has the whole model, items are read in every round.

    A class is left out for an item if a voter's label there was never given where anybody voted for the class: it starts with no
    expected count and stays below e^-NEGLIGIBLE of the item's best class. That bound is checked in every round; where it fails,
    or would with few classes, a task is run with all its classes for all items.
    """
    spark = votes.sparkSession
    cells = cells.sort_values(["task", "annotator", "label"], ignore_index=True)
    names, tasks = sorted(set(cells["task"])), {}
    for no, name in enumerate(names):
        mine = cells[cells["task"] == name]
        classes = sorted(set(mine["label"]))
        place = {c: k for k, c in enumerate(classes)}
        tasks[no] = _Task(mine.index[0], mine["annotator"].factorize()[0], mine["label"].map(place).to_numpy(), classes)
    numbered = cells.assign(no=cells["task"].map({n: k for k, n in enumerate(names)}).astype("int32"), cell=cells.index.astype("int32"))
    numbered = spark.createDataFrame(numbered, "task string, annotator string, label string, no int, cell int")
    per_item = votes.join(F.broadcast(numbered), ["task", "annotator", "label"]).groupBy("no", "item").agg(F.sort_array(F.collect_list("cell")).alias("cells"))  # one vote per annotator and item
    per_item = materialize(per_item, "cells")
    parts = max(1, min(width(spark), -(-int(per_item.agg(F.sum(F.size("cells"))).first()[0] or 0) // PART_VOTES)))
    alike = materialize(per_item.groupBy("no", "cells").agg(F.count("*").alias("n")).repartition(parts), "alike")
    start = _start(alike, tasks)
    whole = {no for no, m in tasks.items() if unvoted and m.far > -2 * NEGLIGIBLE}
    fits: dict[int, _Fit] = {}
    while left := [no for no in tasks if no not in fits]:
        for no in left:
            n = start[no][0]
            tasks[no] = replace(tasks[no], keys=np.arange(len(n)) if no in whole else np.flatnonzero(n))
        now = {no: tasks[no] for no in left}
        first = {no: (start[no][0][m.keys], start[no][1]) for no, m in now.items()}
        flat = _flat(alike, now, unvoted)
        rest = (now, first, max_rounds, tolerance, whole if unvoted else set(now))
        small = flat.agg(F.sum(F.octet_length("key"))).first()[0] or 0
        fits |= _solo(flat, *rest) if small <= SOLO_BYTES and max_rounds else _fitted(lambda models, flat=flat: _round(flat, parts, models), *rest)
        whole |= set(left)
    rounds = max((f.rounds for f in fits.values()), default=0)
    if any(f.change > tolerance for f in fits.values()):
        _unfinished(rounds, tolerance)
    rates = [(names[no], a, float(r), float(t)) for no, m in tasks.items() for a, r, t in _right(m, fits[no].counts, cells)]
    return _posterior(per_item, names, tasks, fits, unvoted), spark.createDataFrame(rates, "task string, annotator string, right double, all double"), rounds


def _right(task: _Task, counts: np.ndarray, cells: pd.DataFrame) -> list[tuple[str, float, float]]:
    """Per annotator the expected number of right votes and of all."""
    cell, to = np.divmod(task.keys, len(task.classes))
    who = task.who[cell]
    right = np.bincount(who, np.where(task.label[cell] == to, counts, 0.0))
    return list(zip(cells["annotator"].iloc[task.first : task.first + len(task.who)].drop_duplicates(), right, np.bincount(who, counts), strict=True))


@dataclass(frozen=True)
class _Fit:
    model: tuple[np.ndarray, np.ndarray] | None
    counts: np.ndarray
    rounds: int
    change: float


def _start(alike: DataFrame, tasks: Mapping[int, _Task]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per task the counts per (cell, class) and per class when vote shares stand for probabilities; only those that occur leave the workers."""
    model = alike.sparkSession.sparkContext.broadcast(dict(tasks))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for no, rows, cell, n, _ in _chunks(batch, model.value):
                m, weight = model.value[no], rows["n"].to_numpy(float)
                k = len(m.classes)
                voted = _voted(m, cell, n)
                row, to = np.nonzero(voted)
                q = voted[row, to] / n[row] * weight[row]
                per_row = np.bincount(row, minlength=len(n))
                times = np.repeat(per_row, n)  # classes that each vote meets
                at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(np.repeat(np.cumsum(per_row) - per_row, n), times)
                keys, place = np.unique(np.repeat(cell, times).astype(np.int64) * k + to[at], return_inverse=True)
                yield pd.DataFrame({"no": [no], "keys": [keys.tobytes()], "counts": [np.bincount(place, q[at]).tobytes()], "classes": [np.bincount(to, q, minlength=k).tobytes()]})

    given = {no: (np.zeros(len(m.who) * len(m.classes)), np.zeros(len(m.classes))) for no, m in tasks.items()}
    for r in alike.mapInPandas(count, "no int, keys binary, counts binary, classes binary").toLocalIterator():
        counts, classes = given[r["no"]]
        counts[np.frombuffer(r["keys"], np.int64)] += np.frombuffer(r["counts"])
        classes += np.frombuffer(r["classes"])
    model.destroy()
    return given


def _flat(alike: DataFrame, tasks: Mapping[int, _Task], unvoted: bool) -> DataFrame:
    """The items as flat arrays, one row per chunk; written once and read in every round."""
    model = alike.sparkSession.sparkContext.broadcast(dict(tasks))

    def lay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        supported = {no: m.supported() for no, m in model.value.items()}
        for batch in batches:
            for no, rows, cell, n, starts in _chunks(batch[batch["no"].isin(list(supported))], model.value):
                items = _items(model.value[no], supported[no], rows["n"].to_numpy(float), cell, n, starts, unvoted)
                yield pd.DataFrame({"no": [no]} | {name: [getattr(items, name).astype(kind).tobytes()] for name, kind in _FLAT.items()})

    return materialize(alike.mapInPandas(lay, "no int, " + ", ".join(f"{name} binary" for name in _FLAT)), "flat")


Models = Mapping[int, tuple[int, tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray] | None]]
Sums = dict[int, tuple[np.ndarray, np.ndarray, float, float]]


def _fitted(step: Callable[[Models], Sums], tasks: Mapping[int, _Task], counts: dict[int, tuple[np.ndarray, np.ndarray]], max_rounds: int, tolerance: float, whole: set[int]) -> dict[int, _Fit]:
    """The tasks whose rounds ended; those that broke the bound are left out. ``step`` gives the expected counts under the models."""
    models: dict[int, tuple[np.ndarray, np.ndarray] | None] = dict.fromkeys(tasks)
    moving, fits, counts = set(tasks), {}, dict(counts)
    if max_rounds == 0:
        return {no: _Fit(None, counts[no][0], 0, 0.0) for no in tasks}
    for rounds in range(1, max_rounds + 1):
        look = rounds > 1 and (rounds % CHECK_EVERY == 0 or rounds == max_rounds)
        before = {no: models[no] for no in moving}
        models |= {no: tasks[no].logs(*counts[no]) for no in moving}
        for no, (n, classes, change, least) in step({no: (len(tasks[no].keys), models[no], before[no] if look else None) for no in moving}).items():
            counts[no] = n, classes
            if no not in whole and least < tasks[no].far + NEGLIGIBLE:
                moving.discard(no)
            elif rounds == max_rounds or (look and change <= tolerance):
                fits[no] = _Fit(models[no], n, rounds, change)
                moving.discard(no)
        if not moving:
            break
    return fits


def _add(out: dict, no: int, counts: np.ndarray, classes: np.ndarray, change: float, least: float) -> None:
    had = out.get(no)
    out[no] = (counts, classes, change, least) if had is None else (had[0] + counts, had[1] + classes, max(had[2], change), min(had[3], least))


def _expect(some: Iterable[tuple[int, _Items]], models: Models) -> Sums:
    """Per task the expected counts per key and per class, the largest change of a probability, and the lowest score of an item's best class."""
    out: Sums = {}
    for no, items in some:
        if no in models:
            keys, now, before = models[no]
            q, least = items.held(now)
            change = float(np.abs(q - items.held(before)[0]).max()) if before else 0.0
            q = q * np.repeat(items.weight, items.pairs)
            _add(out, no, np.bincount(items.key, np.repeat(q, items.votes), minlength=keys), np.bincount(items.to, q, minlength=len(now[1])), change, least)
    return out


def _read(batches: Iterable[pd.DataFrame]) -> Iterator[tuple[int, _Items]]:
    for batch in batches:
        for r in batch.itertuples(index=False):
            yield r.no, _Items(**{name: np.frombuffer(getattr(r, name), kind) for name, kind in _FLAT.items()})


def _round(flat: DataFrame, parts: int, models: Models) -> Sums:
    """_expect over all items, on the workers."""
    model = flat.sparkSession.sparkContext.broadcast(dict(models))

    def rows(out: Sums) -> Iterator[pd.DataFrame]:
        for no, (counts, classes, change, least) in out.items():
            yield pd.DataFrame([(no, counts.tobytes(), classes.tobytes(), change, least)], columns=["no", "counts", "classes", "change", "least"])

    def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from rows(_expect(_read(batches), model.value))

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: Sums = {}
        for batch in batches:
            for r in batch.itertuples(index=False):
                _add(out, r.no, np.frombuffer(r.counts), np.frombuffer(r.classes), r.change, r.least)
        yield from rows(out)

    schema = "no int, counts binary, classes binary, change double, least double"
    sums = flat.filter(F.col("no").isin(*models)).mapInPandas(expect, schema)
    if parts > FAN_IN:  # the driver gets a few models, not one per part
        sums = sums.repartition(FAN_IN).mapInPandas(combine, schema)
    given: Sums = {}
    for r in sums.collect():
        _add(given, r["no"], np.frombuffer(r["counts"]), np.frombuffer(r["classes"]), r["change"], r["least"])
    model.destroy()
    return given


def _solo(flat: DataFrame, tasks: Mapping[int, _Task], counts: Mapping[int, tuple[np.ndarray, np.ndarray]], *rest) -> dict[int, _Fit]:
    """The same rounds, all of a task's in one Spark task; for items of a checked size."""
    given = flat.sparkSession.sparkContext.broadcast((dict(tasks), dict(counts)))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, first = given.value
        some = list(_read(batches))
        here = {no: of[no] for no, _ in some}
        for no, fit in _fitted(lambda models: _expect(some, models), here, {no: first[no] for no in here}, *rest).items():
            logs, shares = fit.model
            yield pd.DataFrame([(no, logs.tobytes(), shares.tobytes(), fit.counts.tobytes(), fit.rounds, fit.change)], columns=["no", "logs", "shares", "counts", "rounds", "change"])

    solved = flat.repartition(len(tasks), "no").mapInPandas(solve, "no int, logs binary, shares binary, counts binary, rounds int, change double").collect()
    given.destroy()
    return {r["no"]: _Fit((np.frombuffer(r["logs"]), np.frombuffer(r["shares"])), np.frombuffer(r["counts"]), r["rounds"], r["change"]) for r in solved}


def _posterior(per_item: DataFrame, names: list[str], tasks: Mapping[int, _Task], fits: Mapping[int, _Fit], unvoted: bool) -> DataFrame:
    model = per_item.sparkSession.sparkContext.broadcast((dict(tasks), {no: f.model for no, f in fits.items()}))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, models = model.value
        supported = {no: m.supported() for no, m in of.items()}
        for batch in batches:
            for no, rows, cell, n, starts in _chunks(batch, of):
                m = of[no]
                items = _items(m, supported[no], np.ones(len(n)), cell, n, starts, unvoted)
                q, _ = items.held(models[no])
                row = np.repeat(np.arange(len(n)), items.pairs)
                most = np.maximum.reduceat(q, np.cumsum(items.pairs) - items.pairs)
                order = np.lexsort((items.to, -items.given, q < most[row] - EQUAL, row))
                chosen = np.zeros(len(q), dtype=bool)
                chosen[order[np.searchsorted(row[order], np.arange(len(n)))]] = True
                kept = chosen | (items.given > 0)
                row, voted, classes = row[kept], _voted(m, cell, n), np.array(m.classes, dtype=object)
                yield pd.DataFrame({
                    "task": names[no], "item": rows["item"].to_numpy()[row], "class": classes[items.to[kept]], "probability": q[kept], "class_votes": items.given[kept], "chosen": chosen[kept],
                    "votes": n[row], "labels": (voted > 0).sum(axis=1)[row], "majority_label": classes[voted.argmax(axis=1)][row], "majority_votes": voted.max(axis=1)[row],
                })

    return per_item.mapInPandas(run, POSTERIOR)


def _by_tables(votes: DataFrame, tally: DataFrame, totals: DataFrame, max_rounds: int, tolerance: float, unvoted: bool) -> tuple[DataFrame, DataFrame, int]:
    """The same for a model of any size: joins and group-bys only."""
    item = ["task", "item"]
    contested = totals.filter(F.lit(unvoted) | (F.col("labels") > 1)).select(*item)
    # Without unvoted labels, unanimous items have their class for certain: their counts are summed once.
    certain = totals.filter(~F.lit(unvoted) & (F.col("labels") == 1))
    sure = votes.join(certain.select(*item), item, "left_semi")
    sure_counts = materialize(sure.groupBy("task", "annotator", F.col("label").alias("class"), "label").agg(F.count("*").cast("double").alias("n")), "sure")
    sure_classes = materialize(certain.groupBy("task", F.col("majority_label").alias("class")).agg(F.count("*").cast("double").alias("n")), "sureclass")
    open_tally = tally.join(contested, item, "left_semi").withColumnRenamed("label", "class")
    if unvoted:
        every = totals.select(*item).join(votes.select("task", F.col("label").alias("class")).distinct(), "task")
        open_tally = every.join(open_tally, [*item, "class"], "left").fillna(0, ["n"])
    open_tally = materialize(open_tally, "tally")
    open_votes = votes.join(contested, item, "left_semi")
    pairs = materialize(open_votes.join(open_tally.select(*item, "class"), item), "pairs")  # every vote with every class of its item
    sizes = votes.groupBy("task").agg(F.countDistinct("label").cast("double").alias("k"))
    held = open_tally.join(totals.select(*item, "votes"), item).select(*item, "class", (F.col("n") / F.col("votes")).alias("q"))
    held = materialize(held, "q")
    rounds = 0
    for rounds in range(1, max_rounds + 1):
        counts, classes = _expected_counts(pairs, held, sure_counts, sure_classes)
        logs = materialize(_row_logs(counts, sizes), "logs")
        shares = classes.select("task", "class", digamma(F.col("n") + CLASS_PRIOR).alias("class_log"))
        before, held = held, materialize(_responsibilities(pairs, logs, shares), "q")
        if rounds % CHECK_EVERY == 0 or rounds == max_rounds:
            change = held.join(before.withColumnRenamed("q", "p"), [*item, "class"]).agg(F.max(F.abs(F.col("q") - F.col("p")))).first()[0]
            if change is None or change <= tolerance:
                break
    else:
        _unfinished(rounds, tolerance)
    counts, _ = _expected_counts(pairs, held, sure_counts, sure_classes)
    rates = counts.groupBy("task", "annotator").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("class") == F.col("label"), F.col("n")).otherwise(0.0)).alias("right"))
    sure = certain.select(*item, F.col("majority_label").alias("class"), F.lit(1.0).alias("q"), F.col("votes").alias("n"))
    each = held.join(open_tally, [*item, "class"]).select(*item, "class", "q", "n").unionByName(sure)
    rank = F.struct((-F.col("q")).alias("q"), (-F.col("n")).alias("n"), "class")
    each = each.withColumn("chosen", rank == F.min(rank).over(Window.partitionBy(*item))).filter("chosen or n > 0")  # one row per class of an item
    posterior = each.join(totals, item).select(*item, "class", F.col("q").alias("probability"), F.col("n").alias("class_votes"), "chosen", "votes", "labels", "majority_label", "majority_votes")
    return posterior, rates, rounds


def _expected_counts(pairs: DataFrame, held: DataFrame, sure_counts: DataFrame, sure_classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    keys = ["task", "annotator", "class", "label"]
    soft = pairs.join(held, ["task", "item", "class"]).groupBy(*keys).agg(F.sum("q").alias("n"))
    counts = soft.unionByName(sure_counts.select(*keys, "n")).groupBy(*keys).agg(F.sum("n").alias("n"))
    classes = held.groupBy("task", "class").agg(F.sum("q").alias("n")).unionByName(sure_classes).groupBy("task", "class").agg(F.sum("n").alias("n"))
    return counts, classes


def _row_logs(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """Expected logarithm of each confusion probability; votes: rows that use it, about."""
    row = Window.partitionBy("task", "annotator", "class")  # one row per label that the annotator used
    wrong = WRONG_PRIOR / F.greatest(F.col("k") - 1, F.lit(1.0))
    prior = F.when(F.col("class") == F.col("label"), F.lit(RIGHT_PRIOR)).otherwise(wrong)
    wide = counts.join(F.broadcast(sizes), "task").withColumn("row_n", F.sum("n").over(row))
    return wide.select("task", "annotator", "class", "label", (digamma(F.col("n") + prior) - digamma(F.col("row_n") + RIGHT_PRIOR + WRONG_PRIOR)).alias("log_p"), F.ceil("n").alias("votes"))


def _responsibilities(pairs: DataFrame, logs: DataFrame, shares: DataFrame) -> DataFrame:
    keys = ["task", "annotator", "class", "label"]
    if logs.count() <= MAX_BROADCAST_ROWS:
        scored = pairs.join(F.broadcast(logs), keys)
    else:
        struct = F.struct(*keys).alias("cell")
        scored = join_groups(pairs.select(struct, "item"), logs.select(struct, "log_p", "votes"), "cell", "votes").select("cell.*", "item", "log_p")
    scores = scored.groupBy("task", "item", "class").agg(F.sum("log_p").alias("s")).join(shares, ["task", "class"])
    each = Window.partitionBy("task", "item")  # one row per label voted for the item
    lifted = scores.withColumn("s", F.col("s") + F.col("class_log")).withColumn("e", F.exp(F.col("s") - F.max("s").over(each)))
    return lifted.select("task", "item", "class", (F.col("e") / F.sum("e").over(each)).alias("q"))


def agreement(tally: DataFrame) -> DataFrame:
    """Krippendorff's alpha per task from the votes per item and label; items with one vote do not count. NULL where nothing can disagree."""
    n = F.col("n")
    x = F.col("label").try_cast("double")
    per_item = Window.partitionBy("task", "item")
    used = tally.withColumn("m", F.sum("n").over(per_item)).filter("m > 1")
    item = used.groupBy("task", "item").agg(F.max("m").alias("m"), F.sum(n * n).alias("same"), F.sum(n * x).alias("sx"), F.sum(n * x * x).alias("sxx"))
    observed = item.groupBy("task").agg(
        F.count("*").alias("items"), F.sum("m").alias("votes"), F.sum((F.col("m") * F.col("m") - F.col("same")) / (F.col("m") - 1)).alias("do"), F.sum(2 * (F.col("m") * F.col("sxx") - F.col("sx") * F.col("sx")) / (F.col("m") - 1)).alias("do_x")
    )
    value = used.groupBy("task", "label").agg(F.sum("n").alias("n"))
    expected = value.groupBy("task").agg(F.sum(n * n).alias("same"), F.sum(n * x).alias("sx"), F.sum(n * x * x).alias("sxx"), F.sum("n").alias("all"), F.count_if(x.isNull()).alias("texts"))
    joined = observed.join(expected, "task")
    nominal = 1 - F.try_divide((F.col("all") - 1) * F.col("do"), F.col("all") * F.col("all") - F.col("same"))
    interval = 1 - F.try_divide((F.col("all") - 1) * F.col("do_x"), 2 * (F.col("all") * F.col("sxx") - F.col("sx") * F.col("sx")))
    return joined.select("task", "items", "votes", nominal.alias("alpha_nominal"), F.when(F.col("texts") == 0, interval).alias("alpha_interval"))


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularized incomplete beta function by its continued fraction."""
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    ln_beta = np.array([math.lgamma(i) + math.lgamma(j) - math.lgamma(i + j) for i, j in zip(p, q, strict=True)])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(p * np.log(y) + q * np.log1p(-y) - ln_beta) / p
    tiny = 1e-300
    c, d = np.ones_like(y), 1 / np.where(np.abs(1 - (p + q) * y / (p + 1)) < tiny, tiny, 1 - (p + q) * y / (p + 1))
    h = d.copy()
    for m in range(1, 300):
        for step in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    out = np.nan_to_num(front * h)
    return np.where(swap, 1 - out, out)


def beta_quantile(p: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low, high = np.zeros_like(a), np.ones_like(a)
    for _ in range(50):
        mid = (low + high) / 2
        under = beta_cdf(mid, a, b) < p
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return (low + high) / 2


def _interval(level: float):
    @F.pandas_udf("low double, high double")
    def interval(right: pd.Series, wrong: pd.Series) -> pd.DataFrame:
        a, b = right.to_numpy(float) + RIGHT_PRIOR, np.maximum(wrong.to_numpy(float), 0) + WRONG_PRIOR
        return pd.DataFrame({"low": beta_quantile((1 - level) / 2, a, b), "high": beta_quantile((1 + level) / 2, a, b)})

    return interval
