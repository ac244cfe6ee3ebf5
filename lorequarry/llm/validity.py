"""Flag source files that do not parse, and report rates per repository and language.

Each text is parsed whole by a packrat grammar of the language that its path's
extension stands for; the furthest position reached and a cause come with the
flag. ``files.errors`` and ``files.language`` are not relied on.

Defined cases: a null source or an unknown extension is not judged (null flag);
an empty source or one of comments only is valid; of a path's index rows the one
with the largest indexed_at counts, exact repeats once; a file below no
project's path has a null repository; nesting of any depth is parsed.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorequarry.llm.grammars import EXTENSIONS, grammar

#: A part of a scan (128 MB by default) takes minutes to parse, so it is handed on in smaller shares.
TASKS_A_PART = 8
_MARKER = re.compile(r"^(?:<{7}|={7}|>{7}|\|{7})(?:[ \r]|$)", re.M)
_NAME = re.compile(r"\.(\w+)$")


def language_of(path: str | None) -> str | None:
    """The language that a path's extension stands for, in any case."""
    m = _NAME.search(path or "")
    return EXTENSIONS.get(m.group(1).lower()) if m else None


def judge(source: str, language: str, causes: bool = True) -> tuple[bool, int, int, str | None]:
    """(invalid, furthest position, its line, cause) of one source; without ``causes`` the cause is null."""
    at = grammar(language).parse(source)
    if at < 0:
        return False, -1, -1, None
    if not causes:
        return True, at, grammar(language).line_at(at, source), None
    g = grammar(language)
    line = g.line_at(at, source)
    begin = source.rfind("\n", 0, max(0, sum(map(len, source.splitlines(True)[: line - 1])))) + 1
    near = "\n".join(source[begin:].split("\n")[:4])
    if _MARKER.search(near):
        cause = "merge conflict"
    elif line >= source.rstrip().count("\n") + 1:
        cause = "truncation"
    elif any(o != language and grammar(o).parse(source) < 0 for o in ("python", "go", "rust", "java", "csharp", "tsx", "typescript", "sql")):
        cause = "wrong extension"
    else:
        cause = "syntax"
    return True, at, line, cause


def check_sources(sources: DataFrame, causes: bool = True) -> DataFrame:
    """(path, language, invalid, position, line, cause) of ``sources(path, source)``; causes only if asked for."""
    schema = "path string, language string, invalid boolean, position int, line int, cause string"
    kinds = [pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in kinds]
            for path, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                lang = language_of(path)
                bad, at, line, cause = judge(source, lang, causes) if lang and source is not None else (None, None, None, None)
                for c, v in zip(cols, (path, lang, bad, at if bad else None, line if bad else None, cause)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [f.split()[0] for f in schema.split(", ")])

    # parsing costs far more than reading: each part of the scan is spread over TASKS_A_PART tasks, and no core is left idle
    cores = sources.sparkSession.sparkContext.defaultParallelism
    n = max(2 * cores, TASKS_A_PART * sources.rdd.getNumPartitions())
    return sources.select("path", "source").repartition(n, "path").mapInArrow(run, schema)


def file_flags(files: DataFrame, sources: DataFrame, projects: DataFrame) -> DataFrame:
    """(path, repository, language, invalid, position, line, cause) for each file of the index."""
    newest = files.where("path is not null").groupBy("path").agg(F.max("indexed_at").alias("indexed_at"))
    flags = newest.join(check_sources(sources), "path", "left")
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.concat_ws("/", F.slice(parts, F.lit(1), i)))
    roots = projects.where("path is not null").select(F.regexp_replace("path", "/+$", "").alias("root")).distinct()
    repo = newest.select("path", F.explode(above).alias("root")).join(roots, "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("repository"))
    return flags.join(repo, "path", "left").select("path", "repository", "language", "invalid", "position", "line", "cause")


def rates(files: DataFrame, sources: DataFrame, projects: DataFrame) -> DataFrame:
    """(repository, language, files, invalid_files, rate, conflicts, truncations, wrong_extensions)."""
    f = file_flags(files, sources, projects).where("invalid is not null")
    cause = lambda c: F.count_if(F.col("cause") == c)
    return f.groupBy("repository", "language").agg(
        F.count("*").alias("files"), F.count_if("invalid").alias("invalid_files"),
        (F.count_if("invalid") / F.count("*")).alias("rate"),
        cause("merge conflict").alias("conflicts"), cause("truncation").alias("truncations"), cause("wrong extension").alias("wrong_extensions"),
    )
