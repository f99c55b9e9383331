"""Connected components of a distributed graph by alternating large-star and small-star steps (Kiveris et al., 2014).

Edges never leave the executors; each round is written to the shared folder, so that lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, scratch, tidy


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Rows (node, component) for the nodes of the edges (a, b): component is the smallest node that can be reached.

    Self loops and repeated edges do no harm; a graph without edges gives an empty result.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, mark, path = _settled(e)
    for _ in range(rounds):
        if not mark[0]:
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        before = path
        e, now, path = _settled(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        discard(edges.sparkSession, before)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("the components have not settled")
    return e.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _settled(e: DataFrame) -> tuple[DataFrame, tuple, str]:
    """The edges, written, marks by which equal sets of edges are told, and where they are."""
    spark, path = e.sparkSession, scratch(e.sparkSession, "edges")
    with tidy(spark):
        e.write.parquet(path)
    e = spark.read.schema(e.schema).parquet(path)
    return e, tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)"))).first()), path
