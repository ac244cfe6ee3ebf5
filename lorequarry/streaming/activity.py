"""Streams: windows of sessions as they come, and activity per user."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorequarry.operators import windows as W
from lorequarry.session import remove, shared_path


#: Turns are stored by so many ranges of sessions; a batch reads those of its own sessions.
RANGES = 64


def debounced_segments(turns: DataFrame, out: str, checkpoint: str, seconds: int | None = None):
    """Segment the sessions that each micro-batch touches, whole; see ``current_windows`` for what holds.

    ``turns`` is a stream. A batch's turns and windows go to a folder of its own,
    so a batch that is tried again replaces what it wrote before. Of the turns
    before it only the ranges are read in which its sessions lie. ``seconds``
    None drains and stops.
    """

    def batch(df: DataFrame, k: int) -> None:
        spark, store = df.sparkSession, f"{out}/turns"
        df = df.withColumn("range", F.pmod(F.xxhash64("session_id"), F.lit(RANGES)).cast("int")).withColumn("batch", F.lit(k).cast("long"))
        df.drop("batch").write.mode("overwrite").partitionBy("range").parquet(f"{store}/batch={k}")
        ranges = [r[0] for r in df.select("range").distinct().collect()]  # at most RANGES
        old = spark.read.schema(df.schema).parquet(store).where(F.col("range").isin(ranges) & (F.col("batch") <= k))
        every = old.join(df.select("session_id").distinct(), "session_id", "left_semi").drop("range", "batch").distinct()
        W.segment(every).write.mode("overwrite").parquet(f"{out}/windows/batch={k}")

    w = turns.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=f"{seconds} seconds") if seconds else w.trigger(availableNow=True)).start()


def current_windows(spark: SparkSession, out: str) -> DataFrame:
    """The windows that hold: of each session those of the last batch that touched it, so an exchange that grew is there once."""
    w = spark.read.parquet(f"{out}/windows")
    last = w.groupBy("session_id").agg(F.max("batch").alias("batch"))
    return w.join(last, ["session_id", "batch"], "left_semi").drop("batch")


def session_activity(events: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """(user_id, started, ended, events): activity sessions, closed by a gap; rows without a time or user take no part."""
    e = events.where("ts is not null and user_id is not null")
    e = e.withWatermark("ts", lateness) if e.isStreaming else e
    g = e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return g.select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")


def hourly(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """(hour, event_type, n, total): tumbling windows."""
    e = events.where("ts is not null")
    e = e.withWatermark("ts", lateness) if e.isStreaming else e
    g = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def drain(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream until its input is used up; the result as a table in the shared folder."""
    out, ck = shared_path(spark, "drained"), shared_path(spark, "drained-state")
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    remove(spark, ck)
    return spark.read.schema(stream.schema).parquet(out)


def hourly_complete(spark: SparkSession, events: DataFrame) -> DataFrame:
    """``hourly`` of a stream that is drained, each batch's whole result replacing the last."""
    out, ck = shared_path(spark, "hourly"), shared_path(spark, "hourly-state")
    e = events.where("ts is not null").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    h = e.select(F.col("w.start").alias("hour"), "event_type", "n", "total")
    last: list[str] = []

    def put(df: DataFrame, k: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/{k}")
        last[:] = [f"{out}/{k}"]

    q = h.writeStream.foreachBatch(put).option("checkpointLocation", ck).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    remove(spark, ck)
    return spark.read.schema(h.schema).parquet(last[0]) if last else spark.createDataFrame([], h.schema)
