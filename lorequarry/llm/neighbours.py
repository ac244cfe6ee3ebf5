"""The k most similar vectors of every vector.

A forest of random-projection trees is fitted on a bounded sample; every row is
put into one leaf of each tree. A query visits the leaves in the order in which
one priority queue shared by all trees gives them out (the least margin on the
path from the root), and the candidates found there are ranked by exact cosines.
The hyperplanes that go to all workers are bounded, so leaves grow with the
table; a grown leaf is searched in the same way by a forest of its own, fitted
where the leaf lies. So a query meets a number of rows that does not grow.

Defined cases: of an id the row with the largest ``updated_at`` counts (a null
is the oldest); a null, empty, all-zero, non-finite or otherwise sized vector
takes no part; equal cosines go by the smaller id; exact copies of a vector are
searched for once and share the result; an empty table gives no rows.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorequarry.session import Stored

#: A forest is fitted on at most this many vectors, and has a leaf for every eight of them at most.
FIT_ROWS = 20_000
TREES, LEAF_ROWS, PROBES = 10, 256, 30
#: Trees and visited leaves of the forest of a leaf that has more than twice LEAF_ROWS rows.
LEAF_TREES, LEAF_PROBES = 4, 8
#: A leaf with more rows than this is searched in blocks, on several tasks.
BLOCK_ROWS = 131_072


def usable(df: DataFrame, dim: int = 64) -> DataFrame:
    """(id, v): the newest vector of each id, packed as float32 bytes, if it can be compared."""
    latest = (
        df.where("id is not null")
        .groupBy("id")
        .agg(F.max_by("embedding", F.struct(F.coalesce("updated_at", F.lit(-(2**63)).cast("long")), F.xxhash64("embedding"))).alias("embedding"))
        .where(F.size("embedding") == dim)
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, emb = b.column(0), b.column(1)
            x = np.asarray(emb.flatten().to_numpy(zero_copy_only=False), dtype=np.float32).reshape(-1, dim)
            ok = np.isfinite(x).all(axis=1) & (np.abs(x).sum(axis=1) > 0)
            x = np.ascontiguousarray(x[ok])
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(ok)), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "v"])

    return latest.mapInArrow(pack, "id string, v binary")


def unit(raw: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors, in double precision, of packed ones."""
    x = np.frombuffer(b"".join(raw), dtype=np.float32).reshape(-1, dim).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Forest:
    """Trees of hyperplanes, each midway between two rows of its node's sample."""

    def __init__(self, sample: np.ndarray, trees: int, leaves: int, seed: int = 7):
        self.rng, self.leaves, self.depth = np.random.default_rng(seed), 0, 0
        self.normals: list[np.ndarray] = []
        self.offsets: list[float] = []
        self.children: list[list[int]] = []  # of each inner node; a leaf is ~number
        least = max(2, len(sample) // max(1, leaves))
        self.roots = [self._grow(sample, np.arange(len(sample)), least, 0) for _ in range(trees)]
        self.w = np.array(self.normals, dtype=np.float32).reshape(len(self.normals), -1)
        self.b = np.array(self.offsets, dtype=np.float32)
        self.sides = np.array(self.children, dtype=np.int32).reshape(-1, 2)
        self.normals = self.offsets = self.children = None  # what is sent to the workers is in the arrays

    def _leaf(self, depth: int) -> int:
        self.leaves += 1
        self.depth = max(self.depth, depth)
        return ~(self.leaves - 1)

    def _grow(self, x: np.ndarray, rows: np.ndarray, least: int, depth: int) -> int:
        if len(rows) <= least or depth > 40:
            return self._leaf(depth)
        for attempt in range(6):
            p, q = x[self.rng.choice(rows, 2, replace=False)]
            n = p - q
            if attempt > 3 or not n.any():
                n = self.rng.standard_normal(x.shape[1])
            n = n / np.linalg.norm(n)
            proj = x[rows] @ n
            at = float(np.median(proj)) if attempt > 3 else float((p @ n + q @ n) / 2)
            right = proj > at
            if 0.1 <= right.mean() <= 0.9:
                break
        if not 0 < right.sum() < len(rows):
            return self._leaf(depth)
        k = len(self.normals)
        self.normals.append(n), self.offsets.append(at), self.children.append([0, 0])
        self.children[k] = [self._grow(x, rows[~right], least, depth + 1), self._grow(x, rows[right], least, depth + 1)]
        return k

    def visit(self, x: np.ndarray, probes: int) -> np.ndarray:
        """(rows, leaves): the leaves of each row as the queue gives them out; -1 where there are no more.

        The queue is run for all rows at once. It holds nodes by the largest
        margin by which their path leaves the row's side; the row's own leaf of
        each tree comes first, in the order of the trees.
        """
        x, m, trees = np.ascontiguousarray(x, dtype=np.float32), len(x), len(self.roots)
        k = min(max(probes, trees), self.leaves)
        out = np.full((m, k), -1, dtype=np.int32)
        keys = np.full((m, k * max(1, self.depth)), np.inf, dtype=np.float32)
        nodes, size, every = np.zeros(keys.shape, dtype=np.int32), np.zeros(m, dtype=np.int64), np.arange(m)

        def descend(rows: np.ndarray, node: np.ndarray, key: np.ndarray) -> np.ndarray:
            on = np.flatnonzero(node >= 0)
            while len(on):
                r, n = rows[on], node[on]
                margin = np.einsum("ij,ij->i", x[r], self.w[n]) - self.b[n]
                side = (margin > 0).astype(np.int64)
                at = size[r]
                keys[r, at], nodes[r, at] = np.maximum(key[on], np.abs(margin)), self.sides[n, 1 - side]
                size[r] += 1
                node[on] = self.sides[n, side]
                on = on[node[on] >= 0]
            return ~node

        for t, root in enumerate(self.roots):
            out[:, t] = descend(every, np.full(m, root, dtype=np.int64), np.full(m, -np.inf, dtype=np.float32))
        for j in range(trees, k):
            if not m or not size.max():
                break
            first = keys[:, : size.max()].argmin(axis=1)
            key = keys[every, first]
            r = np.flatnonzero(np.isfinite(key))
            keys[r, first[r]] = np.inf
            out[r, j] = descend(r, nodes[r, first[r]].astype(np.int64), key[r])
        return out


def _fit(spark: SparkSession, vecs: DataFrame, n: int, dim: int, trees: int, leaf_rows: int, fit_rows: int) -> Forest:
    rows = vecs.orderBy(F.xxhash64("id"), "id").limit(fit_rows).select("v").collect()
    x = unit([bytes(r["v"]) for r in rows], dim)
    return Forest(x, trees, max(1, min(-(-n // leaf_rows), len(x) // 8)))


def _closest(q: np.ndarray, m: np.ndarray, same: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in q, in m) of the pairs that can be among the k closest of q and at least ``floor``."""
    s = q @ m.T
    s[same] = -2  # not itself
    kk = min(k, s.shape[1])
    low = np.partition(s, -kk, axis=1)[:, -kk] if kk < s.shape[1] else np.full(len(q), -2.0, dtype=np.float32)
    return np.nonzero((s >= np.maximum(low, floor)[:, None] - 1e-5) & (s > -1.5))


def _search_leaf(x: np.ndarray, y: np.ndarray, xi: np.ndarray, yi: np.ndarray, k: int, floor: float, leaf_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (query, member) of the closest members of a leaf; xi and yi number the ids of queries x and members y."""
    got: list[tuple[np.ndarray, np.ndarray]] = []

    def meet(qs: np.ndarray, ms: np.ndarray) -> None:
        for at in range(0, len(qs), 2048):
            rows = qs[at : at + 2048]
            a, b = _closest(x[rows], y[ms], xi[rows][:, None] == yi[ms][None, :], k, floor)
            got.append((rows[a], ms[b]))

    if len(y) <= 2 * leaf_rows:
        meet(np.arange(len(x)), np.arange(len(y)))
    else:
        rng = np.random.default_rng(len(y))
        sample = y if len(y) <= FIT_ROWS else y[rng.choice(len(y), FIT_ROWS, replace=False)]
        f = Forest(sample, LEAF_TREES, max(1, min(-(-len(y) // leaf_rows), len(sample) // 8)))
        own = np.concatenate([f.visit(y[at : at + 4096], LEAF_TREES)[:, :LEAF_TREES] for at in range(0, len(y), 4096)])
        by, leaves = np.argsort(own, axis=None, kind="stable"), np.sort(own, axis=None)
        ends = np.searchsorted(leaves, np.arange(f.leaves + 1))
        members = {i: by[ends[i] : ends[i + 1]] // own.shape[1] for i in range(f.leaves)}
        for at in range(0, len(x), 4096):
            seen = f.visit(x[at : at + 4096], LEAF_PROBES)
            order, where = np.argsort(seen, axis=None, kind="stable"), np.sort(seen, axis=None)
            for leaf in np.unique(where[where >= 0]):
                lo, hi = np.searchsorted(where, leaf, "left"), np.searchsorted(where, leaf, "right")
                ms = members[int(leaf)]
                if len(ms):
                    meet(at + order[lo:hi] // seen.shape[1], ms)
    if not got:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
    pair = np.unique(a.astype(np.int64) * len(y) + b)
    return pair // len(y), pair % len(y)


def neighbours(
    spark: SparkSession, vecs: DataFrame, k: int = 5, min_cosine: float = -1.0, dim: int = 64,
    trees: int = TREES, leaf_rows: int = LEAF_ROWS, probes: int = PROBES, fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """(id, other, cosine): up to k most similar others of each row of ``vecs(id, v)``, at least ``min_cosine``.

    Rows of ``vecs`` are distinct vectors. The forest (a bounded number of
    hyperplanes) is broadcast; rows meet in (leaf, block) groups only.
    """
    schema = "id string, other string, cosine double"
    n = vecs.count()
    if n < 2:
        return spark.createDataFrame([], schema)
    forest = _fit(spark, vecs, n, dim, trees, leaf_rows, fit_rows)
    model = spark.sparkContext.broadcast(forest)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = model.value
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                seen = f.visit(unit(b.column(1).to_pylist(), dim), probes)
                own = seen[:, : len(f.roots)]
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).ravel())) for x in (own, seen)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], ["id", "v", "own", "seen"])

    routed = Stored(spark, vecs.mapInArrow(route, "id string, v binary, own array<int>, seen array<int>"), "routed")
    m = routed.df.select(F.explode("own").alias("leaf"), "id", "v", F.lit(False).alias("asks"))
    q = routed.df.select(F.explode("seen").alias("leaf"), "id", "v", F.lit(True).alias("asks")).where("leaf >= 0")
    heavy = m.groupBy("leaf").count().where(F.col("count") > BLOCK_ROWS)
    parts = Stored(spark, heavy.select("leaf", F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("parts")), "heavy-leaves")  # at most one row a leaf
    if parts.df.limit(1).count():
        split = lambda df: df.join(F.broadcast(parts.df), "leaf", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        m = split(m).withColumn("block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
        q = split(q).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    else:
        m, q = m.withColumn("block", F.lit(0)), q.withColumn("block", F.lit(0))

    def rank(key, table):
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        x = unit(table.column("v").to_pylist(), dim)
        code = table.column("id").combine_chunks().dictionary_encode()
        number, names = code.indices.to_numpy(), code.dictionary
        mi, qi = np.flatnonzero(~asks), np.flatnonzero(asks)
        a = b = np.empty(0, np.int64)
        if len(mi) and len(qi):
            flat = x.astype(np.float32)
            a, b = _search_leaf(flat[qi], flat[mi], number[qi], number[mi], k, min_cosine, leaf_rows)
        c = np.einsum("ij,ij->i", x[qi[a]], x[mi[b]])  # exact
        ok = c >= min_cosine
        return pa.table({"id": names.take(pa.array(number[qi[a[ok]]])), "other": names.take(pa.array(number[mi[b[ok]]])), "cosine": pa.array(c[ok], pa.float64())})

    hits = m.unionByName(q).groupBy("leaf", "block").applyInArrow(rank, schema)
    best = hits.groupBy("id", "other").agg(F.max("cosine").alias("cosine"))
    top = best.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("d"), "other"))), 1, k).alias("t"))
    return top.select("id", F.explode("t").alias("t")).select("id", F.col("t.other").alias("other"), (-F.col("t.d")).alias("cosine"))


def _first_ids(rows: DataFrame, n: int) -> DataFrame:
    """(rep, ids): the n smallest ids of each rep, reduced on every partition before the shuffle."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[str, list[str]] = {}
        for b in batches:
            for r, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                low[r] = sorted({*low.get(r, ()), i})[:n]
        yield pa.RecordBatch.from_arrays([pa.array(list(low), pa.string()), pa.array(list(low.values()), pa.list_(pa.string()))], ["rep", "ids"])

    part = rows.select("rep", "id").mapInArrow(reduce, "rep string, ids array<string>")
    return part.groupBy("rep").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, n).alias("ids"))


def similar_pairs(spark: SparkSession, concepts: DataFrame, k: int = 5, min_cosine: float = 0.86, dim: int = 64, **forest) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of which one is among the k most similar of the other."""
    base = Stored(spark, usable(concepts, dim), "vectors")
    reps = Stored(spark, base.df.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")), "distinct-vectors")
    near = neighbours(spark, reps.df.select("id", "v"), k, min_cosine, dim, **forest)
    if not reps.df.where("n > 1").limit(1).count():
        found = near.select("id", "other")
    else:
        members = base.df.join(reps.df.where("n > 1").select("v", F.col("id").alias("rep")), "v").select("rep", "id")
        first = _first_ids(members, k + 1)
        near = Stored(spark, near, "near").df
        here = reps.df.select(F.col("id").alias("rep")).join(first, "rep", "left").select("rep", F.coalesce("ids", F.array("rep")).alias("ids"))
        cand = near.join(here.select(F.col("rep").alias("other"), "ids"), "other").select(F.col("id").alias("rep"), "cosine", F.explode("ids").alias("other"))
        cand = cand.unionByName(here.select("rep", F.lit(1.0).alias("cosine"), F.explode("ids").alias("other")))
        lists = cand.groupBy("rep").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("d"), "other"))), 1, k + 1).alias("t"))
        everyone = base.df.join(reps.df.select("v", F.col("id").alias("rep")), "v").select("rep", "id")
        own = everyone.join(lists, "rep").select("id", F.filter("t", lambda t: t["other"] != F.col("id")).alias("t"))
        found = own.select("id", F.explode(F.slice("t", 1, k)).alias("t")).select("id", F.col("t.other").alias("other"))
    return found.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
