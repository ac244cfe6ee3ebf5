"""Rebuild conversations from message rows with keyed streaming state.

Turn rows are buffered by (session, chunk); a chunk holds a bounded range of idx
(or of ts where idx is null), so that a session with a third of all rows is
spread over many chunks. The streaming state is keyed by shards of chunks, each
of some thousand rows, as a key of its own for a chunk costs more than its rows.
Late rows wait in the state until the event-time watermark closes the chunk;
then its ordered rows and a summary come out. Summaries of one session are
merged in order, as a monoid, into a verdict.

Defined cases: exact repeats of a row count once; a null session_id belongs to
no conversation; a null or unknown role, a null idx beside a written one, a gap
or repeat of idx, and a null or repeated ts where idx is null break a
conversation; null, empty and blank texts carry no message.
"""
from __future__ import annotations

import pickle

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lorequarry.session import remove, shared_path

ROLES = ["user", "assistant", "tool", "system"]
#: Width of a chunk in idx, and in ms of ts (more rows than ms means a repeated ts).
CHUNK_IDX, CHUNK_MS = 2048, 3_600_000
#: Rows that a shard of the state should hold.
SHARD_ROWS = 4_000
_ORDER_IDX, _ORDER_TS, _ORDER_NONE = 0, 1, 2

LIGHT = (
    "shard int, session_id string, by int, chunk long, pos long, id string, role int, says int, row_key long, event_time timestamp, close boolean"
)
OUT = (
    "session_id string, by int, chunk long, n long, lo long, hi long, broken boolean, bad_role boolean, "
    "users long, assistants long, unanswered boolean, first int, last int, ids array<string>, roles array<string>"
)
OUT_NAMES = [f.split()[0] for f in OUT.split(", ")]
STATE = "buffers binary"


def light_rows(turns: DataFrame, shards: int) -> DataFrame:
    """The columns that order and validate, without texts: what the stream carries."""
    role = F.lower(F.regexp_replace("role", r"(?U)^\s+|\s+$", ""))
    code = F.coalesce(F.array_position(F.array(*[F.lit(r) for r in ROLES]), role).cast("int"), F.lit(0))
    by = F.when(F.col("idx").isNotNull(), _ORDER_IDX).when(F.col("ts").isNotNull(), _ORDER_TS).otherwise(_ORDER_NONE)
    pos = F.coalesce(F.col("idx").cast("long"), F.col("ts"), F.lit(0))
    width = F.when(F.col("idx").isNotNull(), CHUNK_IDX).otherwise(CHUNK_MS)
    cols = sorted(turns.columns)
    chunk = F.floor(pos / width).cast("long")
    return turns.where("session_id is not null").select(
        F.pmod(F.xxhash64("session_id", by, chunk), F.lit(shards)).cast("int").alias("shard"),
        "session_id", by.alias("by"), chunk.alias("chunk"), pos.alias("pos"),
        "id", code.alias("role"),
        (F.col("text").isNotNull() & F.col("text").rlike(r"(?U)\S")).cast("int").alias("says"),
        F.xxhash64(*[F.struct(F.col(c).isNull(), F.col(c)) for c in cols]).alias("row_key"),
        # null and out-of-range times are clamped to 1970-01-02 ... 2069 (the first watermark is 1970-01-01, at which a row is late)
        F.timestamp_millis(F.greatest(F.lit(86_400_000).cast("long"), F.least(F.coalesce(F.col("ts"), F.lit(0).cast("long")), F.lit(3_124_224_000_000)))).alias("event_time"),
        F.lit(False).alias("close"),
    )


def _summary(key: tuple, rows: list, broken: bool, bad_role: bool, n: int) -> dict:
    rows.sort(key=lambda r: r[0])
    said = [r[2] for r in rows if r[3] and r[2] in (1, 2)]
    unanswered = any(a == 1 and b != 2 for a, b in zip(said, said[1:]))
    return dict(
        session_id=key[0], by=key[1], chunk=key[2], n=n,
        lo=rows[0][0] if rows else None, hi=rows[-1][0] if rows else None, broken=broken, bad_role=bad_role,
        users=said.count(1), assistants=said.count(2), unanswered=unanswered,
        first=said[0] if said else None, last=said[-1] if said else None,
        ids=[] if broken else [r[1] for r in rows], roles=[] if broken else [ROLES[r[2] - 1] if r[2] else None for r in rows],
    )


class _Buffer:
    """The rows of one chunk so far."""

    __slots__ = ("rows", "at", "broken", "bad_role", "n", "latest")

    def __init__(self):
        self.rows, self.at, self.broken, self.bad_role, self.n, self.latest = {}, set(), False, False, 0, 0

    def add(self, by: int, pos: int, id_: str, role: int, says: int, key: int, ms: int) -> None:
        if ms > self.latest:
            self.latest = ms
        if key in self.rows:
            return
        self.n += not self.broken
        self.bad_role |= role == 0
        if by == _ORDER_NONE or pos in self.at:
            self.broken = True  # what broke a chunk needs no more rows than one
        if not self.broken or not self.rows:
            self.rows[key] = (pos, id_, role, says)
            self.at.add(pos)

    def packed(self):
        return self.rows, self.broken, self.bad_role, self.n, self.latest

    @classmethod
    def unpacked(cls, x):
        b = cls()
        b.rows, b.broken, b.bad_role, b.n, b.latest = x
        b.at = {r[0] for r in b.rows.values()}
        return b


def _advance(key, pdfs, state: GroupState):
    """Buffer a shard's rows, late ones too; emit the chunks that the watermark has closed."""
    buffers = {k: _Buffer.unpacked(x) for k, x in pickle.loads(state.get[0]).items()} if state.exists else {}
    if state.hasTimedOut:
        mark = state.getCurrentWatermarkMs()
        done = [k for k, b in buffers.items() if b.latest <= mark]
        out = [_summary(k, list(buffers[k].rows.values()), buffers[k].broken, buffers[k].bad_role, buffers[k].n) for k in done]
        for k in done:
            del buffers[k]
        if out:
            yield pd.DataFrame(out, columns=OUT_NAMES)
    else:
        for pdf in pdfs:
            ms = pdf["event_time"].astype("datetime64[ms]").astype("int64")
            cols = [pdf[c].tolist() for c in ("session_id", "by", "chunk", "pos", "id", "role", "says", "row_key", "close")]
            for s, by, chunk, pos, id_, role, says, row_key, close, t in zip(*cols, ms.tolist()):
                if not close:
                    k = (s, by, chunk)
                    b = buffers.get(k)
                    if b is None:
                        b = buffers[k] = _Buffer()
                    b.add(by, pos, id_, role, says, row_key, t)
    if buffers:
        state.update((pickle.dumps({k: b.packed() for k, b in buffers.items()}),))
        state.setTimeoutTimestamp(max(min(b.latest for b in buffers.values()), state.getCurrentWatermarkMs()) + 1)
    elif state.exists:
        state.remove()


def chunk_stream(light: DataFrame, lateness: str) -> DataFrame:
    """The stateful operator over a streaming ``light_rows`` frame."""
    return (
        light.withWatermark("event_time", lateness)
        .groupBy("shard")
        .applyInPandasWithState(_advance, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )


def chunks(spark: SparkSession, turns: DataFrame, lateness: str = "36500 days") -> DataFrame:
    """Run the stream over all rows of a stored table until it is drained.

    The rows of a stored table come in no useful order, so nothing may count as
    too late: the delay spans them all, and a closing row beyond it, written
    last, makes the watermark pass every chunk. On a live feed give the lateness
    that the feed really has.
    """
    src, out, ck = (shared_path(spark, f"stream-{x}") for x in ("in", "out", "state"))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns.count() // SHARD_ROWS))
    light_rows(turns, shards).write.parquet(src)
    spark.range(1).selectExpr(
        "-1 shard", "cast(null as string) session_id", "-1 by", "cast(0 as bigint) chunk", "cast(0 as bigint) pos", "cast(null as string) id",
        "0 role", "0 says", "cast(0 as bigint) row_key", "timestamp'2200-01-01' event_time", "true close",
    ).coalesce(1).write.mode("append").parquet(src)
    q = (
        chunk_stream(spark.readStream.schema(LIGHT).parquet(src), lateness)
        .writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
        .outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    remove(spark, src)
    remove(spark, ck)
    return spark.read.schema(OUT).parquet(out).where("session_id is not null")


def verdicts(parts: DataFrame) -> DataFrame:
    """(session_id, valid) from the chunk summaries, merged in order of (by, chunk).

    Each summary looks back to the last one before it that holds a message: a
    user turn that ends one must be answered where the next begins.
    """
    w = Window.partitionBy("session_id").orderBy("by", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.last("last", ignorenulls=True).over(w)
    p = parts.withColumn("seam", F.coalesce((seen == 1) & (F.col("first") != 2), F.lit(False)))
    place = F.when(F.col("last").isNotNull(), F.struct("by", "chunk"))
    agg = p.groupBy("session_id").agg(
        F.sum("n").alias("n"), (F.bool_or("broken") | F.bool_or("bad_role") | F.bool_or("unanswered") | F.bool_or("seam")).alias("bad"),
        F.sum("users").alias("users"), F.sum("assistants").alias("assistants"), F.min("by").alias("by_lo"), F.max("by").alias("by_hi"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max_by("last", place).alias("end"),
    )
    mixed = (F.col("by_lo") == _ORDER_IDX) & (F.col("by_hi") != _ORDER_IDX)
    gaps = (F.col("by_lo") == _ORDER_IDX) & ((F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1))
    bad = F.col("bad") | (F.col("by_hi") == _ORDER_NONE) | mixed | gaps | (F.col("users") == 0) | (F.col("assistants") == 0) | (F.col("end") == 1)
    return agg.select("session_id", (~F.coalesce(bad, F.lit(True))).alias("valid"))


def broken_sessions(spark: SparkSession, turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id) of every sessions.id whose conversation is missing or not valid."""
    ok = verdicts(chunks(spark, turns)).where("valid")
    ids = sessions.where("id is not null").select(F.col("id").alias("session_id")).distinct()
    return ids.join(ok, "session_id", "left_anti")


def conversations(spark: SparkSession, turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, position, turn_id, role): the ordered turns of every valid conversation.

    A chunk's offset is the sum of the counts of the chunks before it, so no
    task ever sorts the rows of a whole session.
    """
    parts = chunks(spark, turns)
    ok = verdicts(parts).where("valid").select("session_id")
    ids = sessions.where("id is not null").select(F.col("id").alias("session_id")).distinct()
    before = parts.select("session_id", "by", "chunk", "n").withColumn(
        "start", F.sum("n").over(Window.partitionBy("session_id").orderBy("by", "chunk").rowsBetween(Window.unboundedPreceding, -1))
    ).drop("n")
    whole = parts.join(ok, "session_id", "left_semi").join(ids, "session_id", "left_semi").join(before, ["session_id", "by", "chunk"])
    rows = whole.select("session_id", F.coalesce("start", F.lit(0)).alias("start"), F.posexplode(F.arrays_zip("ids", "roles")).alias("k", "t"))
    return rows.select("session_id", (F.col("start") + F.col("k")).cast("int").alias("position"), F.col("t.ids").alias("turn_id"), F.col("t.roles").alias("role"))
