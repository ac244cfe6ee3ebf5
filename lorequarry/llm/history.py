"""Check each new batch for (near-)duplicates against everything accepted before.

A text is a sparse binary vector over its shingles (hashed word triples). The
index is an inverted file that is kept in a folder: a cell per coordinate lists
the vectors that have it among their first coordinates in a fixed order (rare
ones first), and the full vectors lie beside the cells. A query probes the cells
of its own coordinates in that order. After i cells, a vector met in fewer than
MEETINGS of them can share at most n - i + MEETINGS - 1 of the query's n
coordinates, so probing ends as soon as that bound on the distance rules out
every nearer vector; the bound on a single candidate follows from the positions
at which the two meet. What was met often enough is ranked by exact Jaccard
similarity, and the batch is appended to the cells.

A query first meets the one oldest vector of each of its cells, and leaves if
the one it meets most often is near; only the others go on to all members. So a
family of near copies, of one batch or of many, is not compared pair by pair.

Each row of a cell has a sketch of its vector: the parities of its coordinates
in 256 classes, or 128 for small vectors. Two sketches differ in no more bits
than the vectors differ in coordinates, so a pair that meets is left where it
meets if its sketches differ too much: of the pairs of a cell, which grow with
its square, next to none is shuffled. The cells are gone through in rounds of
some ranges each, so what is shuffled of them at once is a part.

The folder holds a manifest (settings), the order, and one entry an ``accept``:
its vectors, its cells, its result and, written last, a mark that it is complete.
An index is opened with the settings and the order it was made with; an entry
without a mark is no part of it, and accepting an entry again gives its result.

Defined cases: a null text, one of fewer than ``min_words`` words, a role other
than user and assistant, or a session not in sessions takes no part; turns of
one batch do not count against each other; exact repeats share one vector; an
entry may hold many batches, but none that is not later than all before it.
"""
from __future__ import annotations

import json
import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorequarry.session import Stored, exists, input_bytes, remove, shared_path

WORD = re.compile(r"[^\W_]+")
#: The order of coordinates is by counts in this many buckets, so its size does not grow with the data.
ORDER_BUCKETS = 1 << 20
_CHUNK = 4096
#: In how many probed cells a query and a vector must meet (in all they can share, if that is less).
MEETINGS = 3
#: A new index spreads its cells and vectors over this many ranges; a batch reads only the ranges it probes.
RANGES = 32
#: A cell with more vectors than this is split over several tasks.
CELL_ROWS = 4_096
#: Rows of cells that one task should hold.
TASK_CELLS = 250_000
#: Bytes of vectors of which one task writes the cells.
TASK_BYTES = 32 << 20
#: Rows of cells that one round should hold, as far as there are ranges.
ROUND_CELLS = 2_000_000
#: Vectors of up to this many coordinates have a sketch of 128 bits, others one of 256.
SKETCH_SMALL = 128
SKETCH = ("x0", "x1", "x2", "x3")
#: Candidate ids up to this number are broadcast to the scan of the vectors (16 bytes an id); more are joined by a shuffle.
IDS_BROADCAST = 1_000_000
#: Sessions up to this number are broadcast beside the turns (about 64 bytes a row); more are joined by a shuffle.
SESSIONS_BROADCAST = 500_000


def shingle_vector(text: str, shingle: int, min_words: int, cache: dict[str, int]) -> np.ndarray | None:
    """The sorted distinct 63-bit hashes of a text's word n-grams; None if it has too few words."""
    words = WORD.findall(text.lower())
    if len(words) < max(min_words, shingle):
        return None
    try:
        h = np.array([cache[w] for w in words], dtype=np.uint64)
    except KeyError:
        if len(cache) > 500_000:
            cache.clear()
        for w in words:
            if w not in cache:
                cache[w] = xxhash.xxh64_intdigest(w)
        h = np.array([cache[w] for w in words], dtype=np.uint64)
    n = len(h) - shingle + 1
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(shingle):
            out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return np.unique(out >> np.uint64(1)).astype(np.int64)


def sketches(flat: np.ndarray, lens: np.ndarray) -> list[pa.Array]:
    """The sketch of each vector as columns of 64 bits; the last two are null for small vectors, folded into the first."""
    at = np.repeat(np.arange(len(lens), dtype=np.int64) * 256, lens) + ((flat >> 32) & 255)
    odd = (np.bincount(at, minlength=256 * len(lens)) & 1).astype(np.uint8)
    x = np.packbits(odd).view(np.int64).reshape(-1, 4)
    small = lens <= SKETCH_SMALL
    x[small, :2] ^= x[small, 2:]
    return [pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(x[:, 2], mask=small), pa.array(x[:, 3], mask=small)]


def vectors(docs: DataFrame, shingle: int = 3, min_words: int = 30) -> DataFrame:
    """(doc_id, batch, set_id, n, vec) of the rows of ``docs(doc_id, batch, text)`` that are long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for b in batches:
            keep, vecs = [], []
            for i, t in enumerate(b.column(2).to_pylist()):
                v = shingle_vector(t, shingle, min_words, cache)
                if v is not None:
                    keep.append(i), vecs.append(v)
            sel = b.take(pa.array(keep, pa.int64()))
            lens = np.array([len(v) for v in vecs], dtype=np.int32)
            flat = np.concatenate(vecs) if vecs else np.empty(0, dtype=np.int64)
            offs = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
            ids = [xxhash.xxh3_128_digest(v.tobytes()) for v in vecs]
            yield pa.RecordBatch.from_arrays(
                [sel.column(0), sel.column(1), pa.array(ids, pa.binary()), pa.array(lens), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))],
                ["doc_id", "batch", "set_id", "n", "vec"],
            )

    return docs.where("text is not null and batch is not null").select("doc_id", F.col("batch").cast("long").alias("batch"), "text").mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, batch long, set_id binary, n int, vec array<long>"
    )


def coordinate_order(vecs: DataFrame) -> DataFrame:
    """(chunk, n): how often the coordinates of each bucket occur, a fixed order for as long as the index lives."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ORDER_BUCKETS, dtype=np.int32)
        for b in batches:
            flat = b.column(0).flatten().to_numpy()
            for at in range(0, len(flat), 1 << 20):
                total += np.bincount(flat[at : at + (1 << 20)] % ORDER_BUCKETS, minlength=ORDER_BUCKETS).astype(np.int32)
        parts = total.reshape(-1, _CHUNK)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["chunk", "n"])

    def add(table):
        n = sum((np.frombuffer(x, dtype=np.int32).astype(np.int64) for x in table.column("n").to_pylist()), np.zeros(_CHUNK, dtype=np.int64))
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "n": pa.array([np.minimum(n, 2**31 - 1).astype(np.int32).tobytes()], pa.binary())})

    # the scan's parts are read as they lie; each sends one array of counts in chunks
    return vecs.select("vec").mapInArrow(count, "chunk int, n binary").groupBy("chunk").applyInArrow(add, "chunk int, n binary")


@contextmanager
def _tidy(spark: SparkSession):
    """Shuffle files of the jobs in here go as soon as each job has ended; its result is in a table then."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


class HistoryIndex:
    """The cells and full vectors of everything accepted, kept in a folder."""

    SETTINGS = ("shingle", "min_words", "percent", "ranges")
    FORMAT = 2  # cells with sketches
    SETS = "set_id binary, sid long, batch long, n int, vec array<long>"
    CELLS = "cell int, sid long, n int, pos int, batch long, x0 long, x1 long, x2 long, x3 long"

    def __init__(self, spark: SparkSession, path: str | None = None, **settings: int):
        """Open the index of ``path``, or begin one there (in the shared folder if no path is given).

        Settings are those of the folder; what is passed must agree with them.
        """
        self.spark, self.path = spark, path or shared_path(spark, "history")
        unknown = set(settings) - set(self.SETTINGS)
        if unknown:
            raise TypeError(f"unknown settings {sorted(unknown)}")
        if exists(spark, f"{self.path}/manifest"):
            self.settings = json.loads(spark.read.text(f"{self.path}/manifest").collect()[0][0])
            wrong = {k for k, v in settings.items() if v != self.settings[k]}
            if wrong:
                raise ValueError(f"the index was made with other {sorted(wrong)}")
            if self.settings.get("format") != self.FORMAT:
                raise ValueError("the index was made with cells of another format")
        else:
            self.settings = {"shingle": 3, "min_words": 30, "percent": 70, "ranges": RANGES} | settings | {"format": self.FORMAT}
            spark.range(1).select(F.lit(json.dumps(self.settings)).alias("value")).coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest")
        self._order = None

    # ---- the folder ----

    def entries(self) -> list[str]:
        """The complete entries."""
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/complete")
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []

    def _complete(self, entry: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/complete/{entry}")
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)

    def _table(self, what: str, entries: list[str], ranges: list[int] | None = None) -> DataFrame:
        """Rows of some entries; of some ranges only, whose files alone are read."""
        schema = {"sets": self.SETS, "cells": self.CELLS}[what]
        paths = [f"{self.path}/{what}/entry={e}" for e in entries]
        if not paths:
            return self.spark.createDataFrame([], f"{schema}, range int")
        df = self.spark.read.schema(f"{schema}, range int").option("basePath", f"{self.path}/{what}").parquet(*paths).drop("entry")
        return df if ranges is None else df.where(F.col("range").isin(ranges))

    def _placed(self, rows: DataFrame, key: str) -> DataFrame:
        """Rows with the range of their key, each range in one task or, if there are more tasks than ranges, in some."""
        n = self.settings["ranges"]
        tasks = -(-int(self.spark.conf.get("spark.sql.shuffle.partitions")) // n)
        r = rows.withColumn("range", self._range(F.col(key))).withColumn("share", F.pmod(F.col(key), F.lit(tasks)))
        return r.repartition(n * tasks, "range", "share")

    def _write(self, placed: DataFrame, what: str, entry: str) -> None:
        """The rows of an entry by ranges; what an attempt before left there goes."""
        names = [c.split()[0] for c in {"sets": self.SETS, "cells": self.CELLS}[what].split(", ")]
        placed.select(*names, "range").write.mode("overwrite").partitionBy("range").parquet(f"{self.path}/{what}/entry={entry}")

    def _range(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.settings["ranges"])).cast("int")

    def _ranges(self, keys: DataFrame, key: str) -> list[int]:
        """The ranges in which keys fall: at most as many as there are."""
        return sorted(r[0] for r in keys.select(self._range(F.col(key))).distinct().collect())

    def order(self):
        """The broadcast order of the coordinates."""
        if self._order is None:
            out = np.zeros((ORDER_BUCKETS // _CHUNK, _CHUNK), dtype=np.int32)
            for r in self.spark.read.parquet(f"{self.path}/order").collect():  # of one size, whatever the data
                out[r["chunk"]] = np.frombuffer(bytes(r["n"]), dtype=np.int32)
            self._order = self.spark.sparkContext.broadcast(out.reshape(-1))
        return self._order

    # ---- probing ----

    def _near(self, same: Column | int, a: Column, b: Column) -> Column:
        """Whether ``same`` shared coordinates are enough for sets of a and b ones."""
        p = self.settings["percent"]
        return (100 + p) * same >= p * (a + b)

    def _probed(self, sets: DataFrame) -> DataFrame:
        """The rows of CELLS: the coordinates that have to be probed before the bound rules out the rest.

        A cell is 32 bits of its coordinate; two coordinates in one cell make candidates, which are compared exactly.
        """
        order, percent = self.order(), self.settings["percent"]

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            o = order.value
            for b in batches:
                flat, offs = b.column(3).flatten().to_numpy(), b.column(3).offsets.to_numpy()
                offs = offs - offs[0]
                marks = sketches(flat, np.diff(offs))
                out = []
                for i in range(b.num_rows):
                    v = flat[offs[i] : offs[i + 1]]
                    m = len(v) - -(-percent * len(v) // 100) + MEETINGS
                    out.append(v[np.lexsort((v, o[v % ORDER_BUCKETS]))[:m]])
                lens = [len(v) for v in out]
                cells = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)), pa.array((np.concatenate(out) if out else np.empty(0, np.int64)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*b.columns[:3], *marks, cells], ["sid", "batch", "n", *SKETCH, "cells"])

        s = sets.select("sid", "batch", "n", "vec").mapInArrow(first, "sid long, batch long, n int, x0 long, x1 long, x2 long, x3 long, cells array<int>")
        return s.select(F.posexplode("cells").alias("pos", "cell"), "sid", "n", "batch", *SKETCH).select("cell", "sid", "n", "pos", "batch", *SKETCH)

    def _can(self, q: str, h: str) -> Column:
        """Whether two vectors that meet in a cell can be near, by their sizes and their positions in the order."""
        p, qn, hn, qp, hp = self.settings["percent"], F.col(f"{q}n"), F.col(f"{h}n"), F.col(f"{q}p"), F.col(f"{h}p")
        rest = F.least(qp, hp) + F.least(qn - qp, hn - hp)  # coordinates before this cell, and from it on
        return (100 * hn >= p * qn) & (100 * qn >= p * hn) & self._near(rest, qn, hn)

    def _alike(self, q: str, h: str) -> Column:
        """Whether two vectors can be near by their sketches; one of 256 bits is folded to meet one of 128."""
        x, y = ([F.col(f"{w}{c}") for c in SKETCH] for w in (q, h))
        fold = lambda c, i: c[i].bitwiseXOR(F.coalesce(c[i + 2], F.lit(0).cast("long")))
        differ = lambda pairs: sum((F.bit_count(a.bitwiseXOR(b)) for a, b in pairs), F.lit(0))
        least = F.coalesce(differ(zip(x, y)), differ((fold(x, i), fold(y, i)) for i in (0, 1)))  # null where one is small
        n = F.col(f"{q}n") + F.col(f"{h}n")
        return self._near((n - least) / 2, F.col(f"{q}n"), F.col(f"{h}n"))

    def _often(self, met: DataFrame, h: str) -> DataFrame:
        """(q, h, met): the pairs that meet in as many probed cells as near ones must.

        Of what two vectors share, what does not meet in probed cells lies behind
        the probed coordinates of one of them; of n coordinates all but
        ceil(percent * n / 100) - MEETINGS are probed.
        """
        p = self.settings["percent"]
        qn, hn = F.col("qn"), F.col(f"{h}n")
        needed = F.ceil(p * (qn + hn) / (100 + p))
        behind = F.greatest(F.ceil(p * F.greatest(qn, hn) / 100) - MEETINGS, F.lit(0))
        least = F.greatest(F.least(F.lit(MEETINGS), needed), needed - behind).cast("int")
        return met.groupBy("q", "h").agg(F.count("*").alias("met"), F.first(least).alias("least")).where("met >= least").drop("least")

    def _verified(self, pairs: Stored, entries: list[str]) -> Stored:
        """(q) of the pairs (q, h) of sids whose full vectors are near; q is the set_id."""
        ids = pairs.df.select(F.col("q").alias("sid")).union(pairs.df.select("h"))
        v = self._table("sets", entries, self._ranges(ids, "sid")).select("sid", "set_id", "vec")
        few = ids.distinct()
        v = v.join(F.broadcast(few) if pairs.df.count() * 2 <= IDS_BROADCAST else few, "sid", "left_semi")
        j = pairs.df.join(v.select(F.col("sid").alias("h"), F.col("vec").alias("hv")), "h").join(v.select(F.col("sid").alias("q"), F.col("set_id").alias("id"), F.col("vec").alias("qv")), "q")
        near = j.where(self._near(F.size(F.array_intersect("qv", "hv")), F.size("qv"), F.size("hv")))
        return Stored(self.spark, near.select("q", F.col("id").alias("set_id")).distinct(), "near")

    def _repeats(self, entry: str, before: list[str]) -> DataFrame:
        """(set_id) of the entry's new vectors that have a near one in an earlier batch."""
        spark, ranges, every = self.spark, self.settings["ranges"], [*before, entry]
        rows = self._table("cells", [entry]).count()
        rounds = min(ranges, rows // ROUND_CELLS + 1)
        tasks = max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), rows // rounds // TASK_CELLS + 1)
        mark = lambda w: [F.col(c).alias(f"{w}{c}") for c in SKETCH]

        def cells(k: int) -> DataFrame:
            """The cells of a round that have new rows."""
            some = list(range(k, ranges, rounds))
            own = self._table("cells", [entry], some).withColumn("new", F.lit(True))
            if not before:
                return own
            touched = own.select("cell").distinct()
            return own.unionByName(self._table("cells", before, some).join(touched, "cell", "left_semi").withColumn("new", F.lit(False)))

        def gone_through(step, tag: str) -> tuple[list[Stored], DataFrame]:
            done = [Stored(spark, step(cells(k)), tag) for k in range(rounds)]
            return done, spark.read.schema(done[0].schema).parquet(*[d.path for d in done])

        def eldest(pool: DataFrame) -> DataFrame:
            """(q, qn, h, fn) for the oldest row of each cell; (parts) for the last row of a heavy one."""
            # conditions on both sides of the join, so that none goes below the shuffle, which both read
            pool = pool.select("cell", F.col("sid").alias("q"), F.col("n").alias("qn"), F.col("pos").alias("qp"), "batch", "new", *mark("q")).repartition(tasks, "cell")
            oldest = F.min(F.struct("batch", F.col("q").alias("h"), F.col("qn").alias("fn"), F.col("qp").alias("fp"), *[F.col(f"q{c}").alias(f"f{c}") for c in SKETCH])).alias("oldest")
            alive = pool.groupBy("cell").agg(oldest, F.count("*").alias("size"), F.max("q").alias("last"), F.max(F.when(F.col("new"), F.col("batch"))).alias("latest")).where("oldest.batch < latest")
            asks = pool.join(alive.select("cell", "size", "last", F.col("oldest.batch").alias("fb"), *[f"oldest.{c}" for c in ("h", "fn", "fp", *[f"f{c}" for c in SKETCH])]), "cell")
            asks = asks.withColumn("parts", F.when((F.col("size") > CELL_ROWS) & (F.col("q") == F.col("last")), F.floor((F.col("size") - 1) / CELL_ROWS) + 1).cast("int"))
            asks = asks.withColumn("met", F.when(F.col("new"), F.col("batch") > F.col("fb")) & self._can("q", "f") & self._alike("q", "f"))
            return asks.where("met or parts is not null").select(F.coalesce("met", F.lit(False)).alias("met"), "q", "qn", "h", "fn", "cell", "parts")

        # first the oldest vector that a query meets in most of its cells, if it meets it often
        steps, met = gone_through(eldest, "oldest-met")
        first = Stored(spark, self._often(met.where("met"), "f").groupBy("q").agg(F.max_by("h", F.struct("met", "h")).alias("h")), "first-pairs")
        found = self._verified(first, every)

        def small(df: DataFrame) -> DataFrame:
            return F.broadcast(df) if df.count() <= IDS_BROADCAST else df

        near, hot = small(found.df.select("q").distinct()), small(met.where("parts is not null").select("cell", "parts").distinct())
        heavy_cells = not hot.isEmpty()

        def members(pool: DataFrame) -> DataFrame:
            """(q, qn, h, hn) of the rows of a cell, for the queries that are left."""
            left = pool.where("new").select("cell", F.col("sid").alias("q"), F.col("n").alias("qn"), F.col("pos").alias("qp"), F.col("batch").alias("qb"), *mark("q")).join(near, "q", "left_anti")
            have = pool.select("cell", F.col("sid").alias("h"), F.col("n").alias("hn"), F.col("pos").alias("hp"), "batch", *mark("h"))
            light = [x.join(hot, "cell", "left_anti") if heavy_cells else x for x in (have, left)]
            both = light[0].repartition(tasks, "cell").join(light[1].repartition(tasks, "cell"), "cell")
            if heavy_cells:
                split = left.join(hot, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
                both = both.unionByName(have.join(hot, "cell").withColumn("part", F.pmod(F.xxhash64("h"), F.col("parts")).cast("int")).drop("parts").join(split, ["cell", "part"]).drop("part"))
            return both.where((F.col("batch") < F.col("qb")) & self._can("q", "h") & self._alike("q", "h")).select("q", "qn", "h", "hn")

        # then all vectors of the cells
        more_steps, met = gone_through(members, "met")
        rest = Stored(spark, self._often(met, "h").select("q", "h"), "pairs")
        self.pairs = (first.df.count(), rest.df.count())
        more = self._verified(rest, every)
        out = Stored(spark, found.df.union(more.df).select("set_id").distinct(), "near-sets")
        for s in (*steps, *more_steps, first, found, rest, more):
            s.drop()
        self._left.append(out)
        return out.df

    def accept(self, entry: str, docs: DataFrame) -> DataFrame:
        """(doc_id) of ``docs(doc_id, batch, text)`` that repeat an earlier batch; they are appended as one entry."""
        if not re.fullmatch(r"[\w.\-]+", entry):
            raise ValueError("an entry is named by letters, digits, _, . and -")
        spark, result, before = self.spark, f"{self.path}/repeats/entry={entry}", self.entries()
        kind = docs.schema["doc_id"].dataType.simpleString()
        if entry in before:
            return spark.read.schema(f"doc_id {kind}").parquet(result)
        self._left: list[Stored] = []
        with _tidy(spark):
            raw = Stored(spark, vectors(docs, self.settings["shingle"], self.settings["min_words"]), "vectors")
            light = Stored(spark, raw.df.select("doc_id", "batch", "set_id"), "vector-ids")
            if not before:
                coordinate_order(raw.df).write.mode("overwrite").parquet(f"{self.path}/order")
                self._order = None
            # put where they are written to, then one of each: so the vectors are shuffled once
            placed = self._placed(raw.df.withColumn("sid", F.xxhash64("set_id")), "sid")
            sets = placed.groupBy("range", "share", "set_id", "sid").agg(F.min("batch").alias("batch"), F.any_value("n").alias("n"), F.any_value("vec").alias("vec"))
            status = None
            if before:
                new = light.df.select("set_id", F.xxhash64("set_id").alias("sid")).distinct()
                old = self._table("sets", before, self._ranges(new, "sid")).select("set_id", "batch")
                known = Stored(spark, old.join(new, "set_id", "left_semi"), "known-sets")
                self._left.append(known)
                last = self._table("sets", before).agg(F.max("batch")).collect()[0][0]
                low = light.df.agg(F.min("batch")).collect()[0][0]
                if last is not None and low is not None and low <= last:
                    raise ValueError(f"batch {low} is not later than {last}, which was accepted before")
                sets, status = sets.join(known.df, "set_id", "left_anti"), known.df.withColumn("near", F.lit(False))
            self._write(sets, "sets", entry)
            raw.drop()
            fresh = self._table("sets", [entry])
            # each task writes to all ranges, so the cells, which are more than the vectors, are not shuffled to be written
            few = max(spark.sparkContext.defaultParallelism, input_bytes(spark, f"{self.path}/sets/entry={entry}") // TASK_BYTES + 1)
            self._write(self._probed(fresh.coalesce(few)).withColumn("range", self._range(F.col("cell"))), "cells", entry)
            near = self._repeats(entry, before).withColumn("near", F.lit(True))
            own = fresh.select("set_id", "batch").join(near, "set_id", "left").select("set_id", "batch", F.coalesce("near", F.lit(False)).alias("near"))
            status = own if status is None else status.unionByName(own)
            again = light.df.withColumnRenamed("batch", "at").join(status, "set_id").where(F.col("near") | (F.col("at") > F.col("batch")))
            again.select("doc_id").distinct().write.mode("overwrite").parquet(result)
            for s in (light, *self._left):
                s.drop()
        self._complete(entry)
        return spark.read.schema(f"doc_id {kind}").parquet(result)


def batches_of(turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """(doc_id, batch, text) of the user and assistant turns of known sessions; of a session read twice the earliest batch."""
    first = sessions.where("id is not null and ingested_at is not null").groupBy(F.col("id").alias("session_id")).agg(F.min("ingested_at").alias("batch"))
    if first.count() <= SESSIONS_BROADCAST:
        first = F.broadcast(first)
    role = F.lower(F.regexp_replace("role", r"(?U)^\s+|\s+$", ""))
    t = turns.where(role.isin("user", "assistant") & (F.length("text") >= 59)).select("id", "session_id", "text")  # 30 words take 59 characters
    return t.join(first, "session_id").select(F.col("id").alias("doc_id"), "batch", "text")


def repeated_turns(spark: SparkSession, turns: DataFrame, sessions: DataFrame, shingle: int = 3, min_words: int = 30, percent: int = 70, path: str | None = None) -> DataFrame:
    """(turn_id) of the turns that repeat, or nearly repeat, one of an earlier batch.

    All batches of the table make one entry of a new index, in which a turn
    meets earlier batches only; what comes later is given to ``accept``, on the
    same folder, and reads the ranges that it probes.
    """
    index = HistoryIndex(spark, path, shingle=shingle, min_words=min_words, percent=percent)
    return index.accept("all", batches_of(turns, sessions)).select(F.col("doc_id").alias("turn_id"))
