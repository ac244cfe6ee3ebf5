"""Conversation windows: from turns to exchanges, their texts, ids and briefs."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorequarry.functions import text as T


#: Turns are numbered by chunks of so many idx, or of so many ms where idx is null, so no task sorts a whole session.
CHUNK_IDX, CHUNK_MS = 2_048, 3_600_000


def exchanges(turns: DataFrame) -> DataFrame:
    """Turns with ``n``, their place in the session, ``exchange``, the user turns up to there, and ``idx`` where it was null.

    Order is by idx, of turns that share one by id. Turns without idx come after
    those of their session that have one, by ts and id, and count on from them (a
    session that has none from 0). A chunk is numbered by itself; the counts of
    the chunks before it are added.
    """
    late = F.col("idx").isNull()
    at = F.when(~late, F.floor(F.col("idx") / CHUNK_IDX)).otherwise(F.coalesce(F.floor(F.col("ts") / CHUNK_MS), F.lit(2**62)))
    t = turns.withColumn("late", late).withColumn("chunk", at.cast("long")).withColumn("asks", (F.lower(T.strip("role")) == "user").cast("int"))
    key = ["session_id", "late", "chunk"]
    w = Window.partitionBy(*key).orderBy(F.col("idx").asc_nulls_last(), F.when(F.col("late"), F.col("ts")).asc_nulls_last(), "id")
    t = t.withColumn("n", F.row_number().over(w)).withColumn("exchange", F.sum("asks").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    per = t.groupBy(*key).agg(F.count("*").alias("rows"), F.sum("asks").alias("users"), F.max("idx").alias("top"))
    before = Window.partitionBy("session_id").orderBy("late", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    sum_ = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    per = per.select(*key, sum_("rows").alias("n0"), sum_("users").alias("e0"), sum_(F.when(F.col("late"), F.col("rows"))).alias("l0"), F.coalesce(F.max("top").over(before), F.lit(-1)).alias("top"))
    j = t.join(per, key)
    return j.select(
        *[c for c in turns.columns if c != "idx"], F.coalesce("idx", (F.col("top") + F.col("l0") + F.col("n")).cast("int")).alias("idx"),
        (F.col("n") + F.col("n0")).alias("n"), (F.col("exchange") + F.col("e0")).alias("exchange"),
    )


def segment(turns: DataFrame, max_turns: int = 12, max_chars: int = 8000) -> DataFrame:
    """(window_id, session_id, start_idx, end_idx, n_turns, text_hash, text) of each exchange.

    An exchange is a user turn and what follows it. Turns past ``max_turns`` and
    those that begin past ``max_chars`` are left out, and so is an exchange
    without an answer or tool turn, and what comes before the first user turn.
    Null texts count as empty; exact repeats are the caller's to drop. Roles count
    without blanks and case, the text shows them as they are.
    """
    t = turns.where("session_id is not null").select("id", "session_id", "idx", "ts", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    w = Window.partitionBy("session_id", "exchange").orderBy("n")
    # the first turns of each exchange, cut before the shuffle: an exchange may hold a third of all rows
    t = exchanges(t).where("exchange > 0").withColumn("k", F.row_number().over(w)).where(F.col("k") <= max_turns)
    t = t.withColumn("before", F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    part = F.struct("n", F.concat(F.lit("["), "role", F.lit("] "), "text").alias("line"))
    g = t.where(F.col("before") < max_chars).groupBy("session_id", "exchange").agg(
        F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx"), F.count("*").alias("n_turns"),
        F.bool_or(F.lower(T.strip("role")).isin("assistant", "tool")).alias("answered"), F.array_sort(F.collect_list(part)).alias("parts"),
    ).where("answered")
    text = T.strip(F.array_join(F.transform("parts", lambda p: p["line"]), "\n\n"))
    g = g.withColumn("text", text).withColumn("text_hash", F.sha1("text"))
    return g.select(T.sha_id("session_id", "start_idx", "end_idx", "text_hash").alias("window_id"), "session_id", "start_idx", "end_idx", "n_turns", "text_hash", "text")


def brief(windows: DataFrame, quotes: int = 8, quote_chars: int = 400) -> DataFrame:
    """(window_id, opening, closing, quotes, tickets, paths): the ends, blockquotes and anchors of a window's text."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 0)
    quoted = F.transform(F.slice(F.filter(lines, lambda x: x.rlike(r"^(?:>|- )")), 1, quotes), lambda x: F.substring(x, 1, quote_chars))
    return windows.select(
        "window_id", F.substring(F.element_at(lines, 1), 1, 280).alias("opening"), F.substring(F.element_at(lines, -1), 1, 400).alias("closing"),
        quoted.alias("quotes"), F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b([A-Z][A-Z0-9]{1,9}-\d+)\b"), 1))).alias("tickets"),
        F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?<![\w/])((?:[\w.\-]+/){1,8}[\w\-]+\.[a-zA-Z0-9]{1,8})(?![\w/])"), 1))).alias("paths"),
    )


def routes(labels: DataFrame) -> DataFrame:
    """(window_id, extractor): which extractors a labelled window goes to, by domain, quality, activity and document."""
    d, q, a, doc = F.col("domain"), F.col("quality"), F.coalesce("activity", F.lit("")), F.coalesce("is_doc", F.lit(False))
    eng, arch = ("architecture", "implementation", "business_logic", "debugging"), ("business_logic", "architecture")
    rules = {
        "decision": doc | (d.isin(*eng, "devops") & q.isin("signal", "decision_grade")) | a.isin("feature", "planning", "bugfix"),
        "business_logic": doc | d.isin(*arch) | a.isin("feature", "planning"),
        "requirements": doc | d.isin(*arch, "meta_process") | a.isin("feature", "planning", "info_request"),
        "intent": doc | d.isin(*eng) | a.isin("feature", "planning", "todo"),
        "problem_solution": d.isin("debugging", "implementation") | (a == "bugfix"),
    }
    return labels.select("window_id", F.explode(F.array_compact(F.array(*[F.when(c, n) for n, c in rules.items()]))).alias("extractor"))


def keep_label(labels: DataFrame) -> DataFrame:
    """Labels with ``kept``: dropped are confident ones that are noise, off topic, unrelated or idle talk."""
    idle = (F.col("relevance") == "chitchat") & (F.col("quality") != "decision_grade")
    drop = (F.col("confidence") >= 0.6) & ((F.col("quality") == "noise") | (F.col("relevance") == "off_topic") | (F.col("linkage") == "unrelated") | idle)
    return labels.withColumn("kept", ~F.coalesce(drop, F.lit(False)))


def ingestible(sessions: DataFrame, now_ms: int, skip: tuple[str, ...] = (), limit: int = 200, days: int = 365, min_bytes: int = 256) -> DataFrame:
    """Sessions(id, agent, started_at, ingested_at, bytes) that may be read.

    Their agent is not skipped, they are large and young enough, and of these the
    first ``limit`` in order of arrival, over all agents. A null size is too small.
    """
    ok = sessions.dropDuplicates(["id"]).where((F.coalesce("started_at", "ingested_at") >= now_ms - days * 86_400_000) & (F.col("bytes") >= min_bytes))
    ok = ok.where(~F.coalesce("agent", F.lit("")).isin(*skip)) if skip else ok
    return ok.orderBy(F.col("ingested_at").asc_nulls_last(), "id").limit(limit)


def serialize(briefs: DataFrame, limit: int = 2500) -> DataFrame:
    """(window_id, payload): a brief as one bounded text; over the limit its two ends are kept."""
    line = lambda name, c, n: F.when(F.size(c) > 0, F.concat(F.lit(f"{name}: "), F.array_join(F.slice(c, 1, n), ", ")))
    quotes = F.when(F.size("quotes") > 0, F.concat(F.lit("VERBATIM EVIDENCE:\n"), F.array_join(F.transform("quotes", lambda q: F.concat(F.lit("- "), q)), "\n")))
    body = F.concat_ws("\n", F.concat(F.lit("WINDOW "), "window_id"), line("TICKETS", "tickets", 1000), line("PATHS", "paths", 12), quotes, F.lit("NARRATIVE:"), "opening", "closing")
    half = (limit - 32) // 2
    cut = F.concat(F.substring(body, 1, half), F.lit("\n...[trimmed]...\n"), F.substring(body, -half, half))
    return briefs.select("window_id", F.when(F.length(body) > limit, cut).otherwise(body).alias("payload"))


def untriaged(windows: DataFrame, labels: DataFrame) -> DataFrame:
    """Windows that have no label."""
    return windows.join(labels.select("window_id"), "window_id", "left_anti")
