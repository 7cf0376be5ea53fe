"""Mixing sources to target shares of all tokens.

Each source gets the same expected number of copies for each of its documents:
its target tokens over the tokens it has, at most its allowed repeats. Tokens that a
capped source cannot supply are shared out among the others by their targets; or,
with ``exact``, the mixture is made as small as it takes for all sources with
documents to reach their targets in proportion, whatever that leaves unused.
Within a source the expected copies are summed up over the documents in order of size,
ties by a hash, one random offset per source is added, and a document is emitted once
for each whole number its stretch of the sum crosses: every document appears the
expected number of times rounded up or down, all sizes alike. Of OFFSETS random offsets a
source takes the one that brings its tokens nearest to what is expected, which matters where
few documents, or a few large ones, make up a source. The report names the share that the plan
aims at beside the one reached.

The running sum of a source of any size is made from partition sums; no source is
held in one task. Documents of unlisted or missing sources are left out; listed
sources without documents appear in the report with 0. Source names are compared without outer
space, in lower case, with '-' and blanks as '_'. Empty texts have size 0 and are
sampled like others. Repeated rows are separate documents. Empty tables give an
empty mixture.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens.plans.prefix import range_prefix
from twinlens.session import materialize

#: Sources are planned on the driver, so their number is checked.
MAX_SOURCES = 10_000
#: Random offsets tried per source.
OFFSETS = 16


def source_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), r"[\s\-]+", "_")


def plan(tokens: dict[str, int], weights: dict[str, tuple[float, int]], total: float | None = None, exact: bool = False) -> dict[str, float]:
    """Expected copies per document of each source. tokens: what each source has; weights: target share and allowed repeats; total: tokens wanted, by default all there are; exact: no more than keeps the shares."""
    free = {s for s, (share, most) in weights.items() if tokens.get(s, 0) > 0 and share > 0 and most > 0}
    copies = dict.fromkeys(weights, 0.0)
    left = float(sum(tokens[s] for s in free)) if total is None else float(total)
    if exact and free:
        left = min(left, min(tokens[s] * weights[s][1] / weights[s][0] for s in free) * sum(weights[s][0] for s in free))
        return copies | {s: min(float(weights[s][1]), left * weights[s][0] / sum(weights[x][0] for x in free) / tokens[s]) for s in free}
    while free:
        shares = sum(weights[s][0] for s in free)
        want = {s: left * weights[s][0] / shares / tokens[s] for s in free}
        capped = {s for s in free if want[s] >= weights[s][1]}
        if not capped:
            return copies | want
        for s in capped:
            copies[s] = float(weights[s][1])
            left -= tokens[s] * weights[s][1]
        free -= capped
    return copies


def offset(source: str, seed: str) -> float:
    """A random offset of a source, in [0, 1): 20 bits, so that adding it to whole numbers of copies is exact for billions of documents."""
    return int.from_bytes(hashlib.sha256(f"{seed}|{source}".encode()).digest()[:4]) % 2**20 / 2**20


def weights_of(weights: DataFrame) -> dict[str, tuple[float, int]]:
    rows = weights.filter("source is not null and target_share is not null").groupBy(source_name(F.col("source")).alias("source")).agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("most")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    return {r["source"]: (float(r["share"]), int(r["most"] or 0)) for r in rows}


def mix(sized: DataFrame, key: str, source: str, tokens: str, weights: DataFrame, total: float | None = None, seed: str = "1", exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(mixture, report).

    mixture: doc_key, source, copy_no (from 1), tokens; one row per emitted copy.
    report: per listed source its target_share, max_repeats, documents, tokens_available, expected_copies, copies, tokens_mixed, actual_share, planned_share.
    """
    spark = sized.sparkSession
    listed = weights_of(weights)
    narrow = sized.select(F.col(f"`{key}`").cast("bigint").alias("doc_key"), source_name(F.col(f"`{source}`").cast("string")).alias("source"), F.coalesce(F.col(f"`{tokens}`").cast("bigint"), F.lit(0)).alias("tokens"))
    docs = materialize(narrow.filter(F.col("source").isin(list(listed))).withColumn("row_no", F.monotonically_increasing_id()), "sized")
    has = {r["source"]: (r["n"], r["t"]) for r in docs.groupBy("source").agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).collect()}
    expected = plan({s: t for s, (_, t) in has.items()}, listed, total, exact)
    rates = spark.createDataFrame([(s, r, [offset(s, f"{seed}|{k}") for k in range(OFFSETS)]) for s, r in expected.items() if r > 0], "source string, rate double, shifts array<double>")
    order = docs.withColumns({"tie": F.xxhash64(F.lit(seed), "doc_key"), "one": F.lit(1).cast("bigint")})
    ranked = range_prefix(order, ["source"], ["tokens", "tie", "doc_key", "row_no"], ["one"], label="mix").join(F.broadcast(rates), "source")
    ranked = materialize(ranked, "ranked")
    upto = F.col("one_upto")
    copies = lambda shift: (F.floor(shift + upto * F.col("rate")) - F.floor(shift + (upto - 1) * F.col("rate"))).cast("int")
    tried = ranked.groupBy("source").agg(F.first("shifts").alias("shifts"), F.sum(F.col("tokens") * F.col("rate")).alias("wanted"), F.array(*[F.sum(F.col("tokens") * copies(F.get("shifts", F.lit(k)))) for k in range(OFFSETS)]).alias("got"))
    misses = F.zip_with("got", "shifts", lambda g, s: F.struct(F.abs(g - F.col("wanted")).alias("miss"), s.alias("shift")))
    chosen = tried.select("source", F.array_min(misses)["shift"].alias("shift"))  # one row per listed source
    mixture = ranked.join(F.broadcast(chosen), "source").withColumn("n", copies(F.col("shift"))).filter("n > 0").select("doc_key", "source", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy_no"), "tokens")
    mixture = materialize(mixture, "mixture")
    reached = mixture.groupBy("source").agg(F.count("*").alias("copies"), F.sum("tokens").alias("tokens_mixed"))
    aim = {s: has.get(s, (0, 0))[1] * r for s, r in expected.items()}
    rows = [(s, share, most, *has.get(s, (0, 0)), expected.get(s, 0.0), aim[s] / (sum(aim.values()) or 1.0)) for s, (share, most) in listed.items()]
    base = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, documents bigint, tokens_available bigint, expected_copies double, planned_share double")
    whole = reached.agg(F.sum("tokens_mixed").alias("whole"))
    report = base.join(reached, "source", "left").crossJoin(F.broadcast(whole)).select(
        *base.columns, F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("tokens_mixed", F.lit(0)).alias("tokens_mixed"), F.coalesce(F.try_divide("tokens_mixed", "whole"), F.lit(0.0)).alias("actual_share")
    )
    return mixture, report
