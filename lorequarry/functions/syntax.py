"""Written artifacts in a text: code blocks, commands, links, paths, tickets, errors and stack frames, with their spans.

Spark's pattern functions give no positions, so texts go through one Arrow
function; each text is read whole. Links, paths, tickets and prompt commands
count outside fences only, paths also outside links; errors and frames count
everywhere. A null text has no artifacts, and a fence that is not closed is
ordinary text.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorequarry.functions import text as T

# What the artifacts look like.
FENCE = r"```([a-zA-Z0-9_+\-]*)\n([\s\S]*?)```"
URL = r"\bhttps?://[^\s)>\]]+"
PATH = r"(?<![\w/])((?:\.{1,2}/|/|[a-zA-Z]:\\)?[\w.\-]+(?:[/\\][\w.\-]+){1,8}(?:\.[a-zA-Z0-9]{1,8})(?::\d+(?::\d+)?)?)(?![\w/])"
TICKET = r"\b([A-Z][A-Z0-9]{1,9}-\d+)\b"
PROMPT = r"^[ \t]*\$\s+(.+)$"
ERROR = r"^(?:[A-Z][A-Za-z]+(?:Error|Exception|Warning|Failure))(?::\s.*)?$"
FRAME = r"^\s+at\s+[\w$.<>]+\s+\(?[^\s]+:\d+(?::\d+)?\)?"
SHELLS = ("bash", "sh", "zsh", "shell", "console")
#: Longest summary and evidence that are kept of an artifact.
SUMMARY_CHARS, EVIDENCE_CHARS = 1_000, 4_000

_FENCE, _URL, _PATH, _TICKET = (re.compile(p, re.A) for p in (FENCE, URL, PATH, TICKET))
_PROMPT, _ERROR, _FRAME = (re.compile(p, re.A | re.M) for p in (PROMPT, ERROR, FRAME))
Artifact = tuple[str, str, str, str, int | None, int | None]


def redact(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with blanks in place of the spans; line breaks stay, so do all positions."""
    out, at = [], 0
    for a, b in sorted(spans):
        if b > at:
            out += [text[at : max(a, at)], re.sub(r"[^\n]", " ", text[max(a, at) : b])]
            at = b
    return "".join(out) + text[at:]


def artifacts_of(text: str) -> list[Artifact]:
    """(kind, title, summary, evidence, start, stop) of one text, in code points; commands in a fence have no span."""
    out: list[Artifact] = []
    fences = list(_FENCE.finditer(text))
    for m in fences:
        lang, body = m[1].lower(), m[2]
        out.append(("code_block", f"code block ({lang})" if lang else "code block", body[:500], body, *m.span()))
        if lang in SHELLS:
            commands = (re.sub(r"^\s*\$?\s*", "", line).strip() for line in body.split("\n"))
            out += [("shell_command", "shell command", c[:200], c, None, None) for c in commands if c]
    prose = redact(text, [m.span() for m in fences])
    links = list(_URL.finditer(prose))
    out += [("url", "url", m[0], m[0], *m.span()) for m in links]
    once: dict[tuple[str, str], Artifact] = {}  # of a path and of a ticket the first mention
    for m in _PATH.finditer(redact(prose, [m.span() for m in links])):
        once.setdefault(("path", m[0]), ("path_mention", "path mention", re.sub(r":\d+(?::\d+)?$", "", m[0]), m[0], *m.span()))
    for m in _TICKET.finditer(prose):
        once.setdefault(("ticket", m[0]), ("ticket_id", "ticket id", m[0], m[0], *m.span()))
    out += once.values()
    out += [("shell_command", "shell command", m[1].strip()[:200], m[1].strip(), *m.span()) for m in _PROMPT.finditer(prose) if m[1].strip()]
    for kind, rx in (("error_message", _ERROR), ("stack_trace", _FRAME)):
        out += [(kind, kind.replace("_", " "), m[0].strip(), m[0], *m.span()) for m in rx.finditer(text)]
    return out


def artifacts(windows: DataFrame) -> DataFrame:
    """(id, window_id, kind, title, summary, evidence, start, stop) of ``windows(window_id, text)``."""
    kinds = [pa.string()] * 5 + [pa.int32()] * 2
    names = ["window_id", "kind", "title", "summary", "evidence", "start", "stop"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(w, *a) for w, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for a in artifacts_of(t)]
            cols = zip(*rows) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names)

    a = windows.select(F.col("window_id").cast("string").alias("window_id"), "text").mapInArrow(run, "window_id string, kind string, title string, summary string, evidence string, start int, stop int")
    return a.select(
        T.sha_id("kind", "window_id", "evidence").alias("id"), "window_id", "kind", "title",
        F.substring("summary", 1, SUMMARY_CHARS).alias("summary"), F.substring("evidence", 1, EVIDENCE_CHARS).alias("evidence"), "start", "stop",
    )
