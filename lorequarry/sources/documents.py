"""Documents and diagrams: sections of markdown, labels of drawings."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorequarry.functions import text as T


def read_files(spark: SparkSession, path: str, glob: str, most_bytes: int = 262_144) -> DataFrame:
    """(path, content) of the files below a folder that match and are not too large."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    skip = r"/(?:node_modules|\.git|dist|build|vendor|target|\.venv)/"
    return df.where((F.col("length") <= most_bytes) & ~F.col("path").rlike(skip)).select("path", F.decode("content", "utf-8").alias("content"))


def sections(docs: DataFrame, key: str = "doc_id", column: str = "text", limit: int = 6000, least: int = 40) -> DataFrame:
    """(key, n, heading, body): markdown cut at headings and, where a section is over the limit, behind the line that reaches it.

    A fold over the lines with a struct as state, so it stays in the JVM.
    Null and empty texts and pieces under ``least`` characters give no rows.
    """
    empty = F.array().cast("array<struct<heading:string,body:string>>")
    lines = F.split(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), "\r\n", "\n"), "\n")
    start = F.struct(empty.alias("out"), F.lit(None).cast("string").alias("heading"), F.lit("").alias("buf"), F.lit(0).alias("n"))

    def put(acc):
        body = T.strip(acc["buf"])
        return F.when(F.length(body) >= least, F.concat(acc["out"], F.array(F.struct(acc["heading"].alias("heading"), body.alias("body"))))).otherwise(acc["out"])

    def step(acc, line):
        head = line.rlike(r"^#{1,6}\s+")
        grown = F.struct(acc["out"].alias("out"), acc["heading"].alias("heading"), F.concat(acc["buf"], line, F.lit("\n")).alias("buf"), (acc["n"] + F.length(line) + 1).alias("n"))
        title = F.substring(T.strip(F.regexp_replace(line, r"^#{1,6}\s+", "")), 1, 160)
        cut = F.struct(put(acc).alias("out"), title.alias("heading"), F.lit("").alias("buf"), F.lit(0).alias("n"))
        full = F.struct(put(grown).alias("out"), acc["heading"].alias("heading"), F.lit("").alias("buf"), F.lit(0).alias("n"))
        return F.when(head, cut).when(grown["n"] >= limit, full).otherwise(grown)

    return docs.select(key, F.posexplode(F.aggregate(lines, start, step, put)).alias("n", "s")).select(key, "n", F.col("s.heading").alias("heading"), F.col("s.body").alias("body"))


def drawio_labels(c):
    """The distinct labels of a draw.io file, one a line."""
    raw = F.regexp_extract_all(T.col(c), F.lit('value="([^"]*)"'), 1)
    labels = F.filter(F.transform(raw, lambda v: F.trim(T.strip_tags(T.strip_tags(v)))), lambda v: v != "")
    return F.array_join(F.array_distinct(labels), "\n")


def excalidraw_text(c):
    """The distinct texts of an excalidraw file, one a line; '' if it is no JSON."""
    els = F.from_json(T.col(c), "elements array<struct<type:string,text:string>>")["elements"]
    texts = F.filter(F.transform(els, lambda e: F.trim(e["text"])), lambda t: t.isNotNull() & (t != ""))
    return F.coalesce(F.array_join(F.array_distinct(texts), "\n"), F.lit(""))
