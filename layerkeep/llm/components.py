"""Connected components of a table of links, by local contraction and alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import leaving_tidy, written

MOST_ROUNDS = 60
#: Links that one task contracts at a time, which bounds its memory.
PART_LINKS = 200_000

SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least node of its component, node) for all other nodes of some links."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = list(range(len(nodes)))
    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            root[max(x, y)] = min(x, y)
    own = np.array(root, np.int64)
    while (own[own] != own).any():
        own = own[own]
    other = np.flatnonzero(own != np.arange(len(own)))
    return nodes[own[other]], nodes[other]


def _contracted(batches):
    """The stars of every ``PART_LINKS`` links: no more links than there were, and the same components."""
    held, size = [], 0

    def flushed():
        both = pa.Table.from_batches(held)
        a, b = _stars(both["a"].to_numpy(), both["b"].to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=SCHEMA)

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= PART_LINKS:
            yield flushed()
            held, size = [], 0
    if held:
        yield flushed()


def _met(rows: DataFrame, least: Column) -> DataFrame:
    """``rows`` (u, v) with the least of each u as m.

    The least ones are few and dealt anew, so both sides of the join are plain
    exchanges, which adaptive execution splits where a hub has many rows.
    """
    groups = rows.groupBy("u").agg(least.alias("m")).select((F.col("u") + 0).alias("w"), "m")
    return rows.join(groups.hint("merge"), F.col("u") == F.col("w"))


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours meet the least of its neighbours and itself."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return _met(both, F.least(F.min("v"), F.col("u"))).filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours meet the least of those."""
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    # a node meets the least one itself in the row where that one stands
    return _met(down, F.min("v")).select(F.col("m").alias("a"), F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("b"))


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) for every node of ``links`` (a, b); links of a node with itself are left out.

    Tasks contract the links that they hold to stars. Where one task holds all,
    that is the result; otherwise rounds of stars over all links follow, which
    grow with the logarithm of a component's size. Both halves of a round are
    written to the shared folder, so lineage stays short and a lost executor
    repeats half a round at most.
    """
    now = written(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "links")
    mark = now.count(), None
    for _ in range(MOST_ROUNDS):
        parts = max(1, -(-mark[0] // PART_LINKS))
        now = written(now.coalesce(parts).mapInArrow(leaving_tidy(_contracted), "a long, b long"), "links")
        if parts == 1:
            break
        now = written(_small_star(written(_large_star(now), "links")).distinct(), "links")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return stars.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
