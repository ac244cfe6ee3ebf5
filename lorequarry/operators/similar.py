"""Vectors that are near each other: exact, without comparing all with all.

Unit vectors fall into the cell of the nearest of a bounded number of pivots.
Two vectors at most an angle apart, of which one lies at the angle r at most from
its pivot, are at most that angle plus r from this pivot: so a vector is compared
with the cells that this bound leaves. Cells with many rows are cut into parts
that meet part by part, on several tasks. Null, empty, zero and non-finite
vectors, and those of another length than most pivots have, take no part.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorequarry.functions import vectors as V
from lorequarry.session import Stored

#: Pivots are drawn by hash order; so many unit vectors go to all workers.
PIVOTS = 64
#: Rows of a cell that one task compares with as many others.
PART_ROWS = 8_192
_SLACK = 1e-6


def near_pairs(spark: SparkSession, items: DataFrame, least: float, block: str | None = None, pivots: int = PIVOTS) -> DataFrame:
    """(a, b, cosine), a < b, of ``items(id, embedding)`` with a cosine of at least ``least``, of one block if one is named."""
    x = items.select(F.col("id"), (F.col(block).cast("string") if block else F.lit("")).alias("block"), F.col("embedding").cast("array<double>").alias("e"))
    x = x.where(F.col("id").isNotNull() & F.col("block").isNotNull() & (F.size("e") > 0) & ~F.exists("e", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & (V.norm("e") > 0))
    kind = x.schema["id"].dataType.simpleString()
    out = f"a {kind}, b {kind}, cosine double"
    rows = x.orderBy(F.xxhash64("id"), "id").limit(pivots).select("e").collect()  # a bounded sample
    if not rows:
        return spark.createDataFrame([], out)
    dims = [len(r["e"]) for r in rows]
    dim = max(set(dims), key=dims.count)
    p = np.array([r["e"] for r in rows if len(r["e"]) == dim])
    centre = spark.sparkContext.broadcast(p / np.linalg.norm(p, axis=1, keepdims=True))
    theta = math.acos(max(-1.0, min(1.0, least)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centre.value
        for b in batches:
            v = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            v = np.ascontiguousarray(v / np.linalg.norm(v, axis=1, keepdims=True))
            angle = np.arccos(np.clip(v @ c.T, -1, 1))
            cell = angle.argmin(axis=1) if len(v) else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([r.tobytes() for r in v], pa.binary()), pa.array(cell, pa.int32()), pa.array(angle.min(axis=1) if len(v) else [], pa.float64())],
                ["id", "block", "v", "cell", "angle"],
            )

    placed = Stored(spark, x.where(F.size("e") == dim).mapInArrow(place, f"id {kind}, block string, v binary, cell int, angle double"), "placed")
    cells = Stored(spark, placed.df.groupBy("block", "cell").agg(F.max("angle").alias("radius"), F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts")), "cells")
    wide = spark.sparkContext.broadcast({r["cell"]: r["r"] for r in cells.df.groupBy("cell").agg(F.max("radius").alias("r")).collect()})  # one value a pivot

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, radii = centre.value, wide.value
        r = np.array([radii.get(i, -math.inf) for i in range(len(c))])
        for b in batches:
            v = np.frombuffer(b"".join(b.column(2).to_pylist()), dtype=np.float64).reshape(-1, dim)
            row, cell = np.nonzero(np.arccos(np.clip(v @ c.T, -1, 1)) <= theta + r + _SLACK)
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(row)) for i in range(3)), pa.array(cell, pa.int32())], ["id", "block", "v", "cell"])

    share = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    have = placed.df.select("id", "block", "v", "cell").join(cells.df.select("block", "cell", "parts"), ["block", "cell"])
    ask = placed.df.select("id", "block", "v").mapInArrow(reach, f"id {kind}, block string, v binary, cell int").join(cells.df.select("block", "cell", "parts"), ["block", "cell"])
    grid = lambda df, own, other: df.withColumn(own, share(F.col("parts"))).withColumn(other, F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    m = grid(have, "mp", "qp").withColumn("asks", F.lit(False))
    q = grid(ask, "qp", "mp").withColumn("asks", F.lit(True))

    def meet(key, table):
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        ids = table.column("id").combine_chunks()
        v = np.frombuffer(b"".join(table.column("v").to_pylist()), dtype=np.float64).reshape(-1, dim)
        mi, qi = np.flatnonzero(~asks), np.flatnonzero(asks)
        left, right, cos = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        for at in range(0, len(qi) if len(mi) else 0, 2048):
            s = v[qi[at : at + 2048]] @ v[mi].T
            a, b = np.nonzero(s >= least)
            left.append(qi[at + a]), right.append(mi[b]), cos.append(s[a, b])
        a, b = ids.take(pa.array(np.concatenate(left))), ids.take(pa.array(np.concatenate(right)))
        return pa.table({"a": a, "b": b, "cosine": pa.array(np.concatenate(cos))})

    hits = m.unionByName(q).groupBy("block", "cell", "mp", "qp").applyInArrow(meet, out)
    return hits.where("a < b").groupBy("a", "b").agg(F.max("cosine").alias("cosine"))


def before(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, cosine) with a before b in the order of (created_at, id)."""
    o = items.select("id", "created_at")
    j = pairs.join(o.select(F.col("id").alias("a"), F.col("created_at").alias("ta")), "a").join(o.select(F.col("id").alias("b"), F.col("created_at").alias("tb")), "b")
    swap = F.col("tb") < F.col("ta")
    return j.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"), "cosine")


def prior_duplicates(spark: SparkSession, items: DataFrame, history: DataFrame, least: float = 0.92) -> DataFrame:
    """(id, dup_of, cosine): rows of ``items`` with a near row in ``history``, the nearest one, of equal ones the smallest id."""
    both = items.select("id", "embedding").unionByName(history.join(items.select("id"), "id", "left_anti").select("id", "embedding"))
    p = near_pairs(spark, both, least)
    p = p.select("a", "b", "cosine").union(p.select("b", "a", "cosine"))
    new, old = items.select(F.col("id").alias("a")), history.select(F.col("id").alias("b")).distinct()
    j = p.join(new, "a", "left_semi").join(old, "b", "left_semi").join(items.select(F.col("id").alias("b")), "b", "left_anti")
    best = j.groupBy("a").agg(F.min(F.struct((-F.round("cosine", 6)).alias("d"), "b")).alias("m"))
    return best.select(F.col("a").alias("id"), F.col("m.b").alias("dup_of"), (-F.col("m.d")).alias("cosine"))


def dedupe_windows(spark: SparkSession, items: DataFrame, history: DataFrame, least: float = 0.92) -> DataFrame:
    """(id, state, dup_of) of new windows(id, created_at, embedding): ``prior`` and ``batch`` duplicates are dropped, others kept.

    A window near one of the history is dropped; of the others each is kept
    unless an earlier kept one is near. One without a vector is kept.
    """
    from lorequarry.operators import facts as FA

    prior = Stored(spark, prior_duplicates(spark, items, history, least).select("id", "dup_of"), "prior")
    rest = Stored(spark, items.join(prior.df, "id", "left_anti").select("id", "created_at", "embedding"), "rest")
    lead = FA.leaders(spark, rest.df, before(rest.df, near_pairs(spark, rest.df, least)).select("a", "b"))
    own = F.col("leader") == F.col("id")
    batch = lead.select("id", F.when(own, "kept").otherwise("batch").alias("state"), F.when(~own, F.col("leader")).alias("dup_of"))
    return prior.df.select("id", F.lit("prior").alias("state"), "dup_of").unionByName(batch)


def flag_duplicates(labels: DataFrame, dups: DataFrame) -> DataFrame:
    """Labels(window_id, rationale, …) whose window is in dups(id, dup_of) get a mark behind their rationale."""
    j = labels.join(dups.select(F.col("id").alias("window_id"), "dup_of"), "window_id", "left")
    mark = F.concat(F.coalesce("rationale", F.lit("")), F.lit(" [dup_of:"), F.col("dup_of"), F.lit("]"))
    return j.withColumn("rationale", F.when(F.col("dup_of").isNotNull(), mark).otherwise(F.col("rationale"))).drop("dup_of")


def unmarked(labels: DataFrame) -> DataFrame:
    """Labels without those that are marked as duplicates."""
    return labels.where(~F.coalesce(F.col("rationale").rlike(r"\[dup_of:[^\]]+\]"), F.lit(False)))


def semantic_pairs(spark: SparkSession, concepts: DataFrame, least: float = 0.78, most: int = 200) -> DataFrame:
    """(a, b, cosine): the ``most`` nearest pairs of concepts(id, project_id, embedding) of different projects."""
    p = near_pairs(spark, concepts.select("id", "embedding"), least)
    o = concepts.select("id", "project_id")
    j = p.join(o.select(F.col("id").alias("a"), F.col("project_id").alias("pa")), "a").join(o.select(F.col("id").alias("b"), F.col("project_id").alias("pb")), "b").where("pa <> pb")
    return j.select("a", "b", F.round("cosine", 6).alias("cosine")).orderBy(F.desc("cosine"), "a", "b").limit(most)


def semantic_links(judged: DataFrame) -> DataFrame:
    """(a, b, kind, score) of judged(a, b, cosine, relation, confidence): relations that hold, at cosine times confidence."""
    return judged.where((F.col("relation") != "none") & (F.col("confidence") >= 0.5)).select("a", "b", F.col("relation").alias("kind"), F.round(F.col("cosine") * F.col("confidence"), 6).alias("score"))
