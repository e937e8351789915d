"""Helpers shared by the training-data operators: names, distributed ranks, joins with hot keys, connected components."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalog.scratch import cut, scratch_path, shared_dir

__all__ = ["BROADCAST_ROWS", "bounded_batches", "column_or_null", "connected_components", "cut", "distributed_rank", "fresh", "join_hot", "rank_buckets", "scratch_path", "shared_dir", "small", "table"]

#: A frame of a few numbers a row is broadcast up to so many rows, beyond that it is shuffled.
BROADCAST_ROWS = 250_000
#: Rows of one bucket of a distributed rank, about, and the fewest and most buckets.
BUCKET_ROWS, FEWEST_BUCKETS, MOST_BUCKETS = 2048, 256, 1 << 20
#: A key is hot beyond so many rows and one in so many of all; so there are at most ``HOT_SHARE`` hot keys.
HOT_ROWS, HOT_SHARE = 256, 10_000


#: Bytes of a batch of rows that is sent to Python, where the session does not set its own.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Send rows to Python in batches of a few megabytes: several copies of a batch are held at once, and texts may be long."""
    conf = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(conf).removesuffix("b") == str(64 << 20):
        spark.conf.set(conf, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    """The column cast to ``kind``, or a null of that type where the frame has no such column."""
    return F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)


def fresh(taken: Iterable[str], *stems: str) -> list[str]:
    """Column names made of the stems that clash with none of ``taken``, whatever the case."""
    used, out = {t.lower() for t in taken}, []
    for stem in stems:
        name, k = f"_{stem}", 0
        while name.lower() in used:
            k += 1
            name = f"_{stem}_{k}"
        used.add(name.lower())
        out.append(name)
    return out


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The frame, marked for broadcast if it has at most ``limit`` rows. It is counted: pass a cut one."""
    return F.broadcast(df) if df.count() <= limit else df


def rank_buckets(rows: int) -> int:
    """A power of two of buckets for a distributed rank over so many rows."""
    wanted = max(FEWEST_BUCKETS, min(MOST_BUCKETS, rows // BUCKET_ROWS))
    return 1 << (wanted - 1).bit_length()


def distributed_rank(
    df: DataFrame, group: list[str], order: list[str], bucket: Column, out: str, total: str | None = None
) -> DataFrame:
    """Add the 0-based rank of each row in its group, without sorting a whole group in one task.

    ``bucket`` must rise with ``order`` (equal order, equal bucket) and take a bounded number of values.
    Rows are counted by (group, bucket), the counts are summed up over the buckets of a group, and only
    the rows of one bucket are numbered together. ``total`` names a column for the group's row count.
    """
    b, n, row, before, whole_n, *ks = fresh([*df.columns, out, total or ""], "bucket", "n", "row", "before", "total", *(f"k{i}" for i in range(len(group) + 1)))
    tagged = df.withColumn(b, bucket)
    keys = [*group, b]
    counts = tagged.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    whole = Window.partitionBy(*group) if group else Window.partitionBy()
    earlier = whole.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(k).alias(ks[i]) for i, k in enumerate(keys)],
        F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before),
        F.sum(n).over(whole).alias(whole_n),
    )
    numbered = tagged.withColumn(row, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    match = [F.col(k).eqNullSafe(F.col(ks[i])) for i, k in enumerate(keys)]
    joined = numbered.join(offsets, match, "inner").withColumn(out, F.col(before) + F.col(row))
    if total:
        joined = joined.withColumn(total, F.col(whole_n))
    return joined.drop(b, row, before, whole_n, n, *ks)


def join_hot(rows: DataFrame, key: str, keyed: DataFrame, counted: str, total: int, limit: int = 0) -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, which holds each value of ``key`` once and its row count in ``counted``.

    Keys with more than ``HOT_ROWS`` rows and more than one row in ``HOT_SHARE`` of all ``total`` are joined by
    broadcast, of which there are at most ``HOT_SHARE``; only the others are shuffled. Up to ``limit`` rows of
    ``keyed``, which is counted for that, all are broadcast. Null keys find nothing.
    """
    if limit and keyed.count() <= limit:
        return rows.join(F.broadcast(keyed.drop(counted)), key).select(*rows.columns, *[c for c in keyed.columns if c not in (key, counted)])
    bound = max(HOT_ROWS, total // HOT_SHARE)
    hot = F.broadcast(keyed.where(F.col(counted) > bound).drop(counted))
    names = [*rows.columns, *[c for c in keyed.columns if c not in (key, counted)]]
    one = rows.join(hot, key).select(*names)
    rest = rows.join(hot.select(key), key, "left_anti").join(keyed.where(F.col(counted) <= bound).drop(counted), key)
    return one.unionByName(rest.select(*names))


def _components_at_once(batches):
    """(node, component) of all edges (a, b), in this task."""
    found = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
    if not found:
        return
    a, b = (np.concatenate(ends) for ends in zip(*found, strict=True))
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    root = list(range(len(nodes)))  # nodes are in order, so the smallest place is the smallest node
    for i, j in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        while root[i] != i:
            root[i] = i = root[root[i]]
        while root[j] != j:
            root[j] = j = root[root[j]]
        root[max(i, j)] = min(i, j)
    for i, r in enumerate(root):  # a root is never behind what hangs on it
        root[i] = root[r]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "component"])


def connected_components(edges: DataFrame, max_rounds: int = 60, at_once: int = BROADCAST_ROWS) -> DataFrame:
    """(node, component) for every node of the edges (a, b): component is the smallest node reachable.

    Up to ``at_once`` edges between longs, a few megabytes, are joined in one task: the rounds would start
    thousands of tasks for them, each with files and messages of its own. More are joined in rounds.

    These alternate large-star and small-star steps: each replaces an edge by one to the smallest neighbour, so
    the edge count never grows and the number of rounds grows with the logarithm of the longest path. Of
    a neighbourhood only the minimum is aggregated, combined before the shuffle; the edges of a hub find
    it by broadcast (``join_hot``), so they are never gathered in one task.
    """
    current = cut(
        edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    total = current.count()
    if total <= at_once and {kind for _, kind in current.dtypes} == {"bigint"}:
        return cut(current.coalesce(1).mapInArrow(_components_at_once, "node long, component long"))
    for _ in range(max_rounds):
        if not total:
            break
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            current.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("deg"))
        large = (
            join_hot(both.where(F.col("v") > F.col("u")), "u", least, "deg", 2 * total)
            .select(F.col("m").alias("a"), F.col("v").alias("b"))
            .where("a != b")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .distinct()
        )
        large = cut(large)
        lowest = large.groupBy("b").agg(F.min("a").alias("m"), F.count(F.lit(1)).alias("deg"))
        small_star = (
            join_hot(large, "b", lowest, "deg", total)
            .select(F.explode(F.array(F.struct("m", F.col("a").alias("x")), F.struct("m", F.col("b").alias("x")))).alias("e"))
            .select(F.col("e.m").alias("a"), F.col("e.x").alias("b"))
            .where("a != b")
            .distinct()
        )
        current = cut(small_star)
        # settled when every node hangs on one root and no root hangs on anything
        total, hanging = current.agg(F.count(F.lit(1)), F.countDistinct("b")).first()
        if total == hanging and current.join(current.select(F.col("b").alias("x")), F.col("a") == F.col("x"), "left_semi").isEmpty():
            break
    else:
        raise RuntimeError("connected components did not settle")
    nodes = current.select(F.col("b").alias("node"), F.col("a").alias("component"))
    roots = current.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return nodes.unionByName(roots)
