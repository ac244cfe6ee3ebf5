"""Agent transcripts: four JSON dialects into turns, and tailing of growing files."""
from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from lorequarry.functions import text as T

_BLOCK = "type string, text string, name string, tool string, input string, args string, content string"
_ENTRY = (
    f"type string, role string, text string, body string, ts string, timestamp string, name string, arguments string, output string, "
    f"message struct<role:string,text:string,content:string>, content string, response string"
)


def _role(c: Column) -> Column:
    r = F.lower(F.trim(c))
    r = F.when(r == "human", "user").when(r.isin("ai", "model"), "assistant").when(r.isin("function", "tool_result"), "tool").otherwise(r)
    return F.when(r.isin("user", "assistant", "tool", "system"), r)


def _joined(content: Column) -> Column:
    """The text of a content that is a string, or an array of blocks with a text each."""
    blocks = F.from_json(content, f"array<struct<{_BLOCK.replace(' string', ':string')}>>")
    texts = F.filter(F.transform(blocks, lambda b: b["text"]), lambda t: t.isNotNull())
    return T.strip(F.when(blocks.isNotNull(), F.array_join(texts, "\n")).otherwise(content))


def parse_entries(lines: DataFrame, column: str = "value") -> DataFrame:
    """The rows of ``lines`` and (role, body, tool, ts_ms, dialect) of each JSON entry.

    Message blocks (``message.content``), typed messages (``type`` message with
    input and output texts), function calls and their outputs, request pairs and
    locator/body pairs are told apart by their keys. Times are numbers or ISO
    texts. A null, cut-off or other JSON gives nulls; a tool output is cut to
    4000 characters as tools' outputs are excerpts.
    """
    e = F.from_json(F.col(column), _ENTRY)
    df = lines.withColumn("_e", e)
    x = lambda n: F.col(f"_e.{n}")
    dialect = (
        F.when(x("type") == "message", "typed").when(x("type").isin("function_call", "function_call_output"), "function")
        .when(x("message.content").isNotNull(), "blocks").when(x("message.text").isNotNull(), "pair").when(x("body").isNotNull(), "document")
        .when(x("content").isNotNull(), "blocks")
    )
    role = (
        F.when(x("type") == "function_call", "assistant").when(x("type") == "function_call_output", "tool")
        .when(dialect == "document", "assistant").otherwise(_role(F.coalesce(x("message.role"), x("role"), x("type"))))
    )
    text = (
        F.when(dialect == "typed", _joined(x("content"))).when(x("type") == "function_call_output", F.substring(x("output"), 1, 4000))
        .when(dialect == "function", "").when(dialect == "pair", x("message.text")).when(dialect == "document", x("body"))
        .otherwise(_joined(F.coalesce(x("message.content"), x("content"))))
    )
    when = F.coalesce(x("ts"), x("timestamp"))
    ts = F.coalesce(F.expr("try_cast(coalesce(_e.ts, _e.timestamp) as bigint)"), F.unix_millis(F.try_to_timestamp(when)))
    return df.select(*lines.columns, dialect.alias("dialect"), role.alias("entry_role"), text.alias("body"), F.when(x("type") == "function_call", x("name")).alias("tool"), ts.alias("ts_ms"))


def parse_requests(docs: DataFrame, column: str = "value") -> DataFrame:
    """(path, idx, role, text): the turns of whole-file JSON with ``requests`` or ``history``; others give none."""
    req = "requests array<struct<message:struct<text:string>,response:struct<value:string,text:string>>>, history array<struct<role:string,text:string,content:string>>"
    d = docs.withColumn("_j", F.from_json(column, req))
    pair = lambda r: F.array(
        F.struct(F.lit("user").alias("role"), r["message"]["text"].alias("text")),
        F.struct(F.lit("assistant").alias("role"), F.coalesce(r["response"]["value"], r["response"]["text"]).alias("text")),
    )
    turns = F.concat(
        F.coalesce(F.flatten(F.transform("_j.requests", pair)), F.array().cast("array<struct<role:string,text:string>>")),
        F.coalesce(F.transform("_j.history", lambda h: F.struct(_role(h["role"]).alias("role"), F.coalesce(h["text"], h["content"]).alias("text"))), F.array().cast("array<struct<role:string,text:string>>")),
    )
    ok = F.filter(turns, lambda t: t["role"].isNotNull() & (F.length(t["text"]) > 0))
    return d.select("path", F.posexplode(ok).alias("idx", "t")).select("path", "idx", F.col("t.role").alias("role"), F.col("t.text").alias("text"))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): the lines of all .jsonl files below a folder."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(path).select(F.col("_metadata.file_path").alias("path"), "value")


def project_slug(path) -> Column:
    """A path as transcript folders spell it: runs of other characters than letters and digits as ``-``."""
    return F.regexp_replace(F.regexp_replace(T.col(path), r"[^A-Za-z0-9]+", "-"), r"^-+|-+$", "")


# ---- tailing ----


class _Span(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


#: Bytes of a file that one task reads, and that are looked at at a time for the last line break.
SPAN_BYTES, BLOCK_BYTES = 64 << 20, 64 << 10


def _last_line_end(path: str) -> int:
    """The offset behind the last line break; a line still being written waits. Only the end of the file is read."""
    with open(path, "rb") as f:
        at = f.seek(0, os.SEEK_END)
        while at:
            start = max(0, at - BLOCK_BYTES)
            f.seek(start)
            k = f.read(at - start).rfind(b"\n")
            if k >= 0:
                return start + k + 1
            at = start
    return 0


class _TailReader(DataSourceStreamReader):
    """Offsets are bytes per file, so a file that grew is read from where it ended."""

    def __init__(self, root: str):
        self.root = root

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for base, _, names in os.walk(self.root):
            for n in names:
                if n.endswith(".jsonl"):
                    p = os.path.join(base, n)
                    out[p] = _last_line_end(p)
        return out

    def partitions(self, start: dict, end: dict) -> list[_Span]:
        """Spans of at most SPAN_BYTES: a line belongs to the span in which it begins."""
        return [_Span(p, a, min(a + SPAN_BYTES, e)) for p, e in sorted(end.items()) for a in range(start.get(p, 0), e, SPAN_BYTES)]

    def read(self, s: _Span) -> Iterator[tuple]:
        with open(s.path, "rb") as f:
            at = s.start
            if at:
                f.seek(at - 1)
                at += len(f.readline()) - 1  # what is left of a line that began before
            while at < s.end:
                line = f.readline()
                if not line.endswith(b"\n"):
                    return
                at += len(line)
                yield (s.path, at, line.decode("utf-8", "replace").rstrip("\n"))


class JsonlTail(DataSource):
    """``spark.readStream.format("jsonl_tail").load(folder)``: lines appended to .jsonl files of a shared folder."""

    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> str:
        return "path string, offset_after long, value string"

    def streamReader(self, schema) -> _TailReader:
        return _TailReader(self.options["path"])


def lenient_json(text: str | None):
    """JSON from a reply: as it is, from a fence, or from the first brace to the last; None if there is none."""
    if not text:
        return None
    fence = text.split("```")
    tries = [text, *(p.split("\n", 1)[-1] for p in fence[1::2]), text[text.find("{") : text.rfind("}") + 1]]
    for t in tries:
        try:
            return json.loads(t)
        except ValueError:
            continue
    return None
