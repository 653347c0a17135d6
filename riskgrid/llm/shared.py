"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import sys

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from riskgrid.session import cut_lineage, release

#: A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def ship(module: str) -> None:
    """Send this module's functions to the executors by value, so they need no copy of the package."""
    register_pickle_by_value(sys.modules[module])


ship(__name__)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_bytes(column: str = "text") -> Column:
    """UTF-8 bytes of a text; a null counts as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def remainder(column: str, modulus: int) -> Column:
    """crc32 of a column's decimal text modulo ``modulus``."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str = "rank", rows_per_block: int = 20_000, least_blocks: int = 1024) -> DataFrame:
    """Number the rows of each group of ``keys`` from 0, without a group ever meeting in one task.

    Rows are dealt to hash blocks (at least ``least_blocks``, more as the table grows), numbered within a block by
    ``order``, and shifted by the rows of the group's earlier blocks. The numbers depend on the rows alone. ``df`` is
    read three times, so it should be stored.
    """
    blocks = max(least_blocks, df.count() // rows_per_block)
    dealt = df.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    local = dealt.withColumn("_at", F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(*order)) - 1)
    counts = dealt.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_b"), before.alias("_shift"))
    same = F.col("_block") == F.col("_b")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return local.join(shifts, same).withColumn(name, (F.col("_at") + F.col("_shift")).cast("long")).drop("_block", "_at", "_b", "_shift", *[f"_k{i}" for i in range(len(keys))])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b): one row (node, component) per node, component the smallest node.

    Alternates the two star contractions: each node hangs its larger neighbours, then its smaller ones, below the
    smallest it knows. Every step is a minimum per node (combined before the shuffle) joined back to the edges, so a
    node with many edges is split like any skewed join. Edges are stored in the shared checkpoint folder each round, and
    those of the round before go.
    """
    edges = cut_lineage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    seen = None
    for _ in range(rounds):
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a and b <> m").select(F.col("m").alias("a"), "b").distinct()
        # now a < b on every edge; a node's smaller neighbours move below the smallest of them
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(low, "b")
        small = joined.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")).unionAll(joined.select(F.col("m").alias("a"), "b"))
        old, edges = edges, cut_lineage(small.distinct())
        release(old)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionAll(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
