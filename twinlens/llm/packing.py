"""Packing documents into containers of fixed capacity.

Sum-of-squares packing: let N(h) be the number of open containers filled to h.
Each document goes where the sum of N(h)^2 becomes smallest: into an open
container or a new one; of equal places the fullest is taken. Keeping every gap
rare keeps some fitting gap at hand for any size that is still to come. A
container whose gap is smaller than the smallest document is closed and counts
nothing.

Documents are dealt to blocks by a hash of their key, so a block is a bounded,
random sample of all sizes; blocks are packed side by side, largest documents
first. The containers left open by all blocks are then packed once more in the
same way, as wholes, so that blocks do not leave half-empty containers behind.

A document larger than the capacity fills containers of its own and its rest is
packed like any document; no other is split. Empty and NULL texts have size 0 and
join the first container of their block. Repeated keys are packed as separate
documents. An empty table gives an empty assignment.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.plans.prefix import range_prefix
from twinlens.plans.skew import HOT_SHARE
from twinlens.session import materialize

#: Documents in a block, about; one block is held in one task's memory as two numbers a document.
BLOCK = 20_000


def sum_of_squares(sizes: Sequence[int], capacity: int) -> np.ndarray:
    """Container number of each size, in the given order. Sizes are at most the capacity; size 0 goes to container 0."""
    out = np.zeros(len(sizes), dtype=np.int64)
    count = np.zeros(capacity + 1, dtype=np.int64)  # count[h]: open containers filled to h; count[0] and those of closed levels stay 0
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    made = 0
    closed = capacity - min((int(s) for s in sizes if s > 0), default=1) + 1  # levels from here on can take nothing more
    far = np.iinfo(np.int64).max
    for i, s in enumerate(sizes):
        s = int(s)
        if s == 0:
            continue
        # Growth of the sum when the document goes to level h: leave h, enter h + s.
        after = 2 * count[s:] + 1
        after[max(0, closed - s) :] = 0
        gain = after + 1 - 2 * count[: capacity - s + 1]
        gain[count[: capacity - s + 1] == 0] = far
        gain[0] = after[0]
        h = capacity - s - int(np.argmin(gain[::-1]))
        if h == 0:
            number, made = made, made + 1
        else:
            number = open_at[h].pop()
            count[h] -= 1
        if h + s < closed:
            open_at[h + s].append(number)
            count[h + s] += 1
        out[i] = number
    return out


def _packed(items: DataFrame, item: str, size: str, tie: str, capacity: int) -> DataFrame:
    """(item, size, container): each block packed on its own, largest first, equal sizes in the order of ``tie``."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "tie", "item"], ascending=[False, True, True])
        # The container's number is made of the block's and its own.
        rows["container"] = (np.int64(rows["block"].iloc[0]) << 32) + sum_of_squares(rows["size"].to_numpy(), capacity)
        return rows[["item", "size", "container"]]

    narrow = items.select(F.col(item).alias("item"), F.col(size).cast("bigint").alias("size"), F.col(tie).alias("tie"), F.col("block").cast("bigint").alias("block"))
    return narrow.groupBy("block").applyInPandas(pack, "item bigint, size bigint, container bigint")


def _blocks(items: DataFrame, keys: Sequence[str], count: int, block: int) -> DataFrame:
    n = max(1, -(-count // block))
    return items.withColumn("block", F.pmod(F.xxhash64(*keys), F.lit(n)))


def pack(sizes: DataFrame, key: str, tokens: str, capacity: int, block: int = BLOCK) -> DataFrame:
    """(doc_key, part_no, start_token, part_tokens, container_id, filled): one row per document, or per part of an oversized one."""
    if capacity < 1:
        raise ValueError("the capacity must be at least one token")
    size = F.coalesce(F.col(f"`{tokens}`").cast("bigint"), F.lit(0))
    parts = sizes.select(F.col(f"`{key}`").cast("bigint").alias("doc_key"), size.alias("whole")).withColumn("row_no", F.monotonically_increasing_id())
    parts = materialize(parts, "sizes")  # row_no must not change between uses
    large = parts.filter(F.col("whole") > capacity).withColumns({"_all": F.lit(0), "filled_up": F.expr(f"whole div {capacity}")})
    # Containers filled by one document's parts are numbered one after the other: negative numbers, unlike those of the blocks.
    full = range_prefix(large, ["_all"], ["row_no"], ["filled_up"], label="full").select("doc_key", "row_no", (F.col("filled_up_upto") - F.col("filled_up")).alias("before"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("filled_up"))).alias("part_no"))
    full = full.select("doc_key", F.col("part_no").cast("int"), ((F.col("part_no") - 1) * capacity).alias("start_token"), F.lit(capacity).cast("bigint").alias("part_tokens"), (-F.col("before") - F.col("part_no")).alias("container_id"), F.lit(capacity).cast("bigint").alias("filled"))
    rest = parts.filter((F.col("whole") <= capacity) | (F.col("whole") % capacity > 0)).withColumn("size", F.when(F.col("whole") > capacity, F.col("whole") % capacity).otherwise(F.col("whole")))
    n = rest.count()
    # A key that holds more than one row in HOT_SHARE would overfill a block; its rows, and only those, are dealt one by one.
    hot = rest.groupBy("doc_key").agg(F.count("*").alias("n")).filter((F.col("n") > 1) & (F.col("n") * HOT_SHARE > n)).select("doc_key", F.lit(True).alias("hot"))
    dealt = rest.join(F.broadcast(hot), "doc_key", "left").withColumn("salt", F.when(F.col("hot"), F.col("row_no")))
    first = materialize(_packed(_blocks(dealt, ["doc_key", "salt"], n, block), "row_no", "size", "doc_key", capacity), "packed")
    levels = first.groupBy("container").agg(F.sum("size").alias("level"))
    opened = materialize(levels.filter(F.col("level") < capacity), "open")
    again = _packed(_blocks(opened, ["container"], opened.count(), block), "container", "level", "container", capacity)
    # The second packing's numbers start where those of the blocks end.
    moved = again.select(F.col("item").alias("container"), (F.col("container") + (1 << 62)).alias("to"))
    first = first.join(moved, "container", "left").select("item", "size", F.coalesce("to", "container").alias("container"))
    first = materialize(first, "repacked")
    levels = first.groupBy("container").agg(F.sum("size").alias("level"))
    placed = first.join(levels, "container").join(rest.select(F.col("row_no").alias("item"), "doc_key", "whole"), "item")
    part = F.when(F.col("whole") > capacity, F.expr(f"whole div {capacity}")).otherwise(F.lit(0))
    placed = placed.select("doc_key", (part + 1).cast("int").alias("part_no"), (part * capacity).alias("start_token"), F.col("size").alias("part_tokens"), F.col("container").alias("container_id"), F.col("level").alias("filled"))
    return placed.unionByName(full)


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, fewest_containers (no packing can do with less), unused_share."""
    boxes = packed.groupBy("container_id").agg(F.sum("part_tokens").alias("level"))
    total = boxes.agg(F.count("*").alias("containers"), F.coalesce(F.sum("level"), F.lit(0)).alias("tokens"), F.coalesce(F.max("level"), F.lit(0)).alias("fullest"))
    return total.select("containers", "tokens", "fullest", F.ceil(F.col("tokens") / capacity).alias("fewest_containers"), F.when(F.col("containers") > 0, 1 - F.col("tokens") / (F.col("containers") * capacity)).alias("unused_share"))
