"""Consolidate pairwise matches into groups.

The giant component is peeled off by a frontier breadth-first search from the
vertex of the highest degree; an anti-join removes it and minimum propagation
with pointer jumping labels what is left.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorequarry.session import Stored

#: The frontier search goes on for as long as a round finds at least one vertex for so many that are
#: visited. So its rounds grow with the logarithm of the component; a long tail (a chain, say) is left
#: to the propagation, in which the visited part counts as one vertex. The result is the same.
GROWTH = 8
#: How often a label is followed to its own label in one round.
JUMPS = 1


def clean_kind(col):
    """A link kind without surrounding blanks and case, ``_`` for ``-``."""
    return F.translate(F.lower(F.regexp_replace(col, r"(?U)^\s+|\s+$", "")), "-", "_")


def same_as_edges(links: DataFrame, vertices: DataFrame, kind: str = "same_as") -> DataFrame:
    """Distinct undirected edges (u < v) of one kind whose ends are both vertices."""
    ids = vertices.where("id is not null").select("id").distinct()
    e = links.where((clean_kind(F.col("kind")) == kind) & (F.col("a") != F.col("b")))
    e = e.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    return e.join(ids.withColumnRenamed("id", "u"), "u", "left_semi").join(
        ids.withColumnRenamed("id", "v"), "v", "left_semi"
    ).select("u", "v")


def components(spark: SparkSession, edges: DataFrame, growth: int = GROWTH) -> DataFrame:
    """(group_id, vertex) for every vertex of ``edges(u, v)``; group_id is the smallest vertex.

    Null ends and loops are ignored, repeated and reversed pairs are as one,
    an empty input gives an empty result. Every join is on the vertex, of
    which each side holds one row (labels) or its neighbours (edges): a hub is
    split by adaptive skew handling, and the minimum is pre-aggregated.
    """
    und = edges.where("u is not null and v is not null and u <> v").select("u", "v")
    sym = Stored(spark, und.union(und.select("v", "u")).distinct(), "edges")
    top = (
        sym.df.groupBy("u").count().orderBy(F.desc("count"), F.asc("u")).limit(1).collect()
    )
    if not top:
        return sym.df.select(F.col("u").alias("group_id"), F.col("v").alias("vertex"))
    root = top[0]["u"]
    seen = Stored(spark, sym.df.where(F.col("u") == root).select("u").distinct().withColumn("depth", F.lit(0)), "seen")
    layers, depth, visited, found = [seen], 0, 1, 1
    while found * growth >= visited and found:
        front, depth = layers[-1].df.select("u"), depth + 1
        seen_all = spark.read.schema(seen.schema).parquet(*[s.path for s in layers])
        new = (
            sym.df.join(front, "u", "left_semi").select(F.col("v").alias("u")).distinct()
            .join(seen_all.select("u"), "u", "left_anti").withColumn("depth", F.lit(depth))
        )
        layers.append(Stored(spark, new, "seen"))
        found = layers[-1].df.count()
        visited += found
    open_ends = found > 0
    giant = spark.read.schema(seen.schema).parquet(*[s.path for s in layers]).select("u")
    rest = sym.df.join(giant, "u", "left_anti")
    if open_ends:  # the visited part goes on as one vertex, its root
        mark = giant.withColumnRenamed("u", "v").withColumn("inside", F.lit(True))
        out = rest.join(mark, "v", "left").select("u", F.when(F.col("inside"), F.lit(root)).otherwise(F.col("v")).alias("v"))
        rest = out.union(out.where(F.col("v") == root).select("v", "u")).distinct()
    left = Stored(spark, rest, "rest")
    small = _propagate(spark, left)
    low = giant.agg(F.min("u")).collect()[0][0]
    joined = small.df.where(F.col("u") == root).select("label").collect() if open_ends else []
    tail = joined[0][0] if joined else None
    label = low if tail is None else min(low, tail)
    a = giant.select(F.lit(label).alias("group_id"), F.col("u").alias("vertex"))
    b = small.df.where(F.col("u") != root).select(
        (F.when(F.col("label") == tail, F.lit(label)).otherwise(F.col("label")) if tail is not None else F.col("label")).alias("group_id"),
        F.col("u").alias("vertex"),
    )
    out = Stored(spark, a.union(b), "groups")
    for t in (sym, *layers, left, small):
        t.drop()
    return out.df


def _propagate(spark: SparkSession, edges: Stored) -> Stored:
    """(u, label): the smallest vertex of each component by minimum propagation with jumps."""
    labels = Stored(spark, edges.df.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")), "labels")
    while True:
        l = labels.df
        near = edges.df.join(l.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        seen = l.join(near, "u").select("u", "label", F.least("label", "near").alias("near"))
        # what a vertex sees is handed to its label too, so whole trees move at once
        hook = seen.groupBy(F.col("label").alias("u")).agg(F.min("near").alias("hook"))
        step = seen.join(hook, "u", "left").select("u", F.col("label").alias("old"), F.least("near", "hook").alias("label"))
        for _ in range(JUMPS):
            jump = l.select(F.col("u").alias("label"), F.col("label").alias("beyond"))
            step = step.join(jump, "label", "left").select("u", "old", F.least("label", "beyond").alias("label"))
        nxt = Stored(spark, step, "labels")
        changed = nxt.df.where("label < old").limit(1).count()
        labels.drop()
        labels = nxt
        if not changed:
            return labels


def group_concepts(spark: SparkSession, links: DataFrame, concepts: DataFrame) -> DataFrame:
    """(group_id, concept_id) of every concept in a same-as group of two or more."""
    g = components(spark, same_as_edges(links, concepts))
    return g.select("group_id", F.col("vertex").alias("concept_id"))
