"""A sample that stays the same as data grows.

A ledger in storage names the keys chosen so far. For the next load every ledger
key is kept by a join, the quota of each stratum is raised to its share of the keys
seen so far, and the difference is filled with the keys not in the ledger that have
the lowest hash. The hash depends on seed and key only, so rerunning, repartitioning
or reordering changes nothing.

The ledger's folder has one folder per load: the keys it brought, the keys chosen
in it, and the counts of keys and chosen keys per stratum and hash bucket after it.
A load is written beside and moved into place whole, so a broken run leaves the ledger
as it was. A run reads only the rows of its load, the last counts, and of earlier
keys those of the load's own keys and of the buckets in which the quota ends.

Whole buckets below the quota are taken, and only keys of the bucket in
which the quota ends are ranked. Ties of the hash are ordered by the key. NULL keys cannot
be chosen and are left out; a NULL stratum is the stratum ''. Repeated rows
count once; an empty load changes nothing. Rows whose load is NULL come with the first load.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinlens.session import materialize, shared_dir

#: Buckets are the first hex digits of the hash: 16^3 counts per stratum.
BUCKET_DIGITS = 3
CHOSEN = "stratum string, sample_key string, priority string, chosen_in int"
SEEN = "stratum string, sample_key string, priority string"
COUNTS = "stratum string, bucket string, keys bigint, chosen bigint"


def stratum_name(c: Column) -> Column:
    """Outer space, letter case and inner blanks do not make another stratum; missing is ''."""
    return F.coalesce(F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_"), F.lit(""))


def candidates(df: DataFrame, stratum: str, key: str, seed: str = "1") -> DataFrame:
    """One row per stratum and key, with its hash priority."""
    keyed = df.select(stratum_name(F.col(f"`{stratum}`").cast("string")).alias("stratum"), F.col(f"`{key}`").cast("string").alias("sample_key")).filter("sample_key is not null").distinct()
    return keyed.withColumn("priority", F.md5(F.concat(F.lit(seed), F.lit("|"), F.col("sample_key"))))


class Ledger:
    """The stored ledger of one sample: a folder that outlives the session, and the rate and seed of the sample."""

    def __init__(self, spark: SparkSession, path: str, rate: float, seed: str = "1"):
        self.spark, self.path, self.rate, self.seed = spark, path.rstrip("/"), rate, seed
        jvm = spark.sparkContext._jvm
        self._of = jvm.org.apache.hadoop.fs.Path
        self._files = self._of(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def loads(self) -> list[int]:
        """The loads in the ledger, in order."""
        if not self._files.exists(self._of(self.path)):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._of(self.path))]
        return sorted(int(n.removeprefix("load=")) for n in names if n.startswith("load="))

    def _read(self, part: str, loads: Sequence[int], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/load={n}/{part}" for n in loads]) if loads else self.spark.createDataFrame([], schema)

    def chosen(self) -> DataFrame:
        """stratum, sample_key, priority, chosen_in: the sample."""
        return self._read("chosen", self.loads(), CHOSEN)

    def grow(self, rows: DataFrame, stratum: str, key: str, load: int) -> None:
        """Adds the rows of a new load. Loads must come in rising order; one that is in the ledger already is left as it is."""
        done = self.loads()
        if load in done:
            return
        if done and load < done[-1]:
            raise ValueError(f"load {load} comes after load {done[-1]}; give its rows with a later load")
        draft = f"{self.path}/_draft-{uuid.uuid4().hex}"
        seen, chosen = self._read("seen", done, SEEN), self.chosen().select("stratum", "sample_key", F.lit(True).alias("chosen"))
        same = ["stratum", "sample_key"]
        bucket = F.substring("priority", 1, BUCKET_DIGITS).alias("bucket")
        fresh = candidates(rows, stratum, key, self.seed).join(seen.select(*same), same, "left_anti")
        fresh.repartitionByRange("priority").sortWithinPartitions("priority").write.parquet(f"{draft}/seen")
        fresh = self.spark.read.schema(SEEN).parquet(f"{draft}/seen")
        counts = self._read("counts", done[-1:], COUNTS).unionByName(fresh.groupBy("stratum", bucket).agg(F.count("*").alias("keys")).withColumn("chosen", F.lit(0).cast("bigint")))
        need = materialize(self._need(counts.groupBy("stratum", "bucket").agg(F.sum("keys").alias("keys"), F.sum("chosen").alias("chosen"))), "need")
        span = need.filter("take > 0").agg(F.min("bucket").alias("low"), F.max("bucket").alias("high")).first()
        pool = seen.unionByName(fresh)
        # Files are sorted by hash: outside the buckets that give keys nothing is read.
        pool = pool.filter(F.col("priority").between(span["low"], span["high"] + "g") if span["low"] is not None else F.lit(False))
        unseen = pool.join(chosen, same, "left_anti").withColumn("bucket", F.substring("priority", 1, BUCKET_DIGITS)).join(need.filter("take > 0").select("stratum", "bucket", "take", "unseen"), ["stratum", "bucket"])
        whole = unseen.filter("take = unseen").select("stratum", "sample_key", "priority")
        place = F.row_number().over(Window.partitionBy("stratum", "bucket").orderBy("priority", "sample_key"))
        last = unseen.filter("take < unseen").withColumn("place", place).filter("place <= take").select("stratum", "sample_key", "priority")
        whole.unionByName(last).withColumn("chosen_in", F.lit(load).cast("int")).write.parquet(f"{draft}/chosen")
        need.select("stratum", "bucket", "keys", (F.col("chosen") + F.col("take")).alias("chosen")).coalesce(1).write.parquet(f"{draft}/counts")
        if not self._files.rename(self._of(draft), self._of(f"{self.path}/load={load}")):
            raise OSError(f"the ledger's load {load} could not be moved into place")

    def _need(self, counts: DataFrame) -> DataFrame:
        """Per stratum and bucket the unseen keys and how many of them are taken; one row per stratum and bucket, so at most 16^3 rows in a window."""
        whole = Window.partitionBy("stratum")
        upto = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        unseen = F.col("keys") - F.col("chosen")
        open_ = counts.withColumns({"unseen": unseen, "need": F.ceil(F.round(F.lit(self.rate) * F.sum("keys").over(whole), 6)) - F.sum("chosen").over(whole), "before": F.coalesce(F.sum(unseen).over(upto), F.lit(0))})
        return open_.withColumn("take", F.greatest(F.lit(0), F.least("unseen", F.col("need") - F.col("before"))))


def grow_all(df: DataFrame, ledger: Ledger, stratum: str, key: str, load: str) -> DataFrame:
    """Brings a ledger up to a table: every load of the table that is later than the ledger's last is added, in order; returns the sample."""
    at = F.col(f"`{load}`").cast("int")
    done = ledger.loads()
    first = df.agg(F.min(at)).first()[0]
    number = F.coalesce(at, F.lit(first if first is not None else 0))
    new = df.select(number.alias("_load"), F.col(f"`{stratum}`").alias("_stratum"), F.col(f"`{key}`").alias("_key"))
    if done:
        new = new.filter(F.col("_load") > done[-1])
    loads = [n for (n,) in new.select("_load").distinct().orderBy("_load").toLocalIterator()]
    if len(loads) > 1:  # one folder per load, so that each step reads its own rows only
        path = f"{shared_dir(df.sparkSession)}/twinlens-loads-{uuid.uuid4().hex}"
        new.write.partitionBy("_load").parquet(path)
        new = df.sparkSession.read.schema(new.schema).parquet(path)
    for n in loads:
        ledger.grow(new.filter(F.col("_load") == n), "_stratum", "_key", n)
    return ledger.chosen()


def replay(df: DataFrame, stratum: str, key: str, load: str, rate: float, seed: str = "1", path: str | None = None) -> DataFrame:
    """grow_all with the ledger at ``path``; without a path, with a new ledger in the shared folder."""
    spark = df.sparkSession
    return grow_all(df, Ledger(spark, path or f"{shared_dir(spark)}/twinlens-ledger-{uuid.uuid4().hex}", rate, seed), stratum, key, load)
