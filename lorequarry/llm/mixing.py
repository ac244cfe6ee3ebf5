"""Mix sources to target weights by capped water-filling.

Each source is to contribute its target share of the tokens. A source that would
need more repetitions than it may have is clamped at its cap, and the excess is
handed to the others in proportion to their weights, until all fit. What a
source contributes is then whole passes over its documents and a seeded part.

Defined cases: spellings of a source that differ in case, blanks or ``-`` for
``_`` are one source; documents of a source without a target, of a null source or
without tokens are not used; a target without documents gets nothing and its
share goes to the others; a null target_share or max_repeats counts as 0.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorequarry.llm.tokens import token_counts
from lorequarry.session import Stored

#: Documents fall into this many seeded buckets a source; the part of a pass is cut by bucket.
BUCKETS = 4096


def clean_source(col: Column) -> Column:
    """A source's name without differences of case, blanks and ``-``."""
    return F.translate(F.lower(F.regexp_replace(col, r"(?U)^\s+|\s+$", "")), "- ", "__")


#: A table of settings (targets, limits, known people) may have this many rows; a larger one is refused.
SETTINGS_ROWS = 100_000


def settings(table: DataFrame) -> list:
    """The rows of a small table of settings; one that is not small is an error, never cut."""
    rows = table.limit(SETTINGS_ROWS + 1).collect()
    if len(rows) > SETTINGS_ROWS:
        raise ValueError(f"a table of settings with more than {SETTINGS_ROWS} rows")
    return rows


def water_fill(total: float, weights: dict[str, float], caps: dict[str, float]) -> dict[str, float]:
    """The share of ``total`` that each source gets: its weight's part, at most its cap."""
    out = {s: 0.0 for s in weights}
    free = {s for s, w in weights.items() if w > 0 and caps.get(s, 0) > 0}
    left = min(total, sum(caps[s] for s in free))
    while free:
        unit = left / sum(weights[s] for s in free)
        full = {s for s in free if weights[s] * unit >= caps[s]}
        if not full:
            return out | {s: weights[s] * unit for s in free}
        for s in full:
            out[s] = caps[s]
            left -= caps[s]
        free -= full
    return out


def _parts(spark: SparkSession, docs: DataFrame, targets: DataFrame, total: int | None, seed: int, path: str | None):
    """The counted documents, the plan per source (a driver-side table as small as ``targets``) and its frame."""
    per = targets.where("source is not null").groupBy(clean_source(F.col("source")).alias("s")).agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap"))
    goal = {r["s"]: (r["share"] or 0.0, r["cap"] or 0) for r in settings(per)}
    named = docs.select("doc_id", "text", clean_source(F.col("source")).alias("source")).where(F.col("source").isin(list(goal)) & F.col("text").isNotNull())
    counted = token_counts(named, ["doc_id", "source"], path).where("n_tokens > 0")
    store = Stored(spark, counted.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(BUCKETS)).cast("int")), "token-counts")
    have = {r["source"]: r["n"] for r in store.df.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    want = total if total is not None else sum(have.values())
    got = water_fill(want, {s: g[0] for s, g in goal.items()}, {s: have.get(s, 0) * g[1] for s, g in goal.items()})
    rows = []
    for s, (share, cap) in sorted(goal.items()):
        n = have.get(s, 0)
        whole = min(int(got[s] // n), cap) if n else 0
        rows.append((s, float(share), int(cap), int(n), int(whole), int(round(got[s] - whole * n)) if n and whole < cap else 0))
    plan = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, available_tokens long, passes int, part long")
    return store, F.broadcast(plan), plan


def mix(spark: SparkSession, docs: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 17, path: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, copies): how often each selected document is used.

    ``total`` is the size of the mix in tokens, by default what the sources with
    a target hold. Token counts are summed by (source, bucket) first; only the
    one bucket in which a source's part ends is put in order.
    """
    store, small, _ = _parts(spark, docs, targets, total, seed, path)
    per = store.df.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))
    cuts = per.withColumn("upto", upto).join(small, "source")
    cut = cuts.where(F.col("upto") <= F.col("part")).groupBy("source").agg(F.max("bucket").alias("last"), F.max("upto").alias("below"))
    d = store.df.join(small, "source").join(F.broadcast(cut), "source", "left")  # a row a source
    last, below = F.coalesce("last", F.lit(-1)), F.coalesce("below", F.lit(0))
    # the next bucket that holds documents is where the part ends
    nxt = per.join(F.broadcast(cut), "source", "left").where(F.col("bucket") > last).groupBy("source").agg(F.min("bucket").alias("edge"))
    d = d.join(F.broadcast(nxt), "source", "left")
    cols = ["doc_id", "source", "n_tokens", "bucket", "passes", "part", "below", "edge"]
    d = d.select("doc_id", "source", "n_tokens", "bucket", "passes", "part", last.alias("last"), below.alias("below"), "edge")
    in_edge = F.col("bucket") == F.col("edge")
    run = F.sum("n_tokens").over(Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id"))
    edge = d.where(in_edge & (F.col("part") > 0)).withColumn("run", run)
    # take a document if that brings the sum nearer to the part than leaving it
    edge = edge.withColumn("extra", (F.col("below") + F.col("run") - F.col("n_tokens") / 2 <= F.col("part")).cast("int"))
    rest = d.where(~F.coalesce(in_edge & (F.col("part") > 0), F.lit(False))).withColumn("extra", ((F.col("part") > 0) & (F.col("bucket") <= F.col("last"))).cast("int"))
    every = edge.select(*cols, "extra").unionByName(rest.select(*cols, "extra"))
    return every.select("doc_id", "source", "n_tokens", (F.col("passes") + F.col("extra")).alias("copies")).where("copies > 0")


def shares(spark: SparkSession, docs: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 17, path: str | None = None) -> DataFrame:
    """Per source: its target, what there was, what the mix took and the share reached."""
    picked = mix(spark, docs, targets, total, seed, path)
    took = picked.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    goal = targets.where("source is not null").groupBy(clean_source(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    j = goal.join(took, "source", "left").na.fill(0, ["tokens", "documents", "most_copies"])
    whole = F.sum("tokens").over(Window.partitionBy())  # a row a source
    return j.withColumn("actual_share", F.when(whole > 0, F.col("tokens") / whole).otherwise(F.lit(0.0)))
