"""Facts: anchors, upserts, duplicates, clusters, verification."""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorequarry import schema as S
from lorequarry.functions import text as T
from lorequarry.functions import vectors as V
from lorequarry.session import Stored


def anchor_gate(facts: DataFrame, least: float = 0.45, most: int = 8) -> DataFrame:
    """Facts worth keeping, at most ``most`` a window by confidence.

    Core kinds always pass, anchored kinds need a file, symbol, ticket or path,
    others pass. A null confidence fails; ties go by the smaller id.
    """
    anchored = (F.size("anchors") > 0) & F.col("anchors").isNotNull()
    ok = facts.where((F.col("confidence") >= least) & (~F.col("kind").isin(*S.ANCHORED_KINDS) | anchored))
    w = Window.partitionBy("window_id").orderBy(F.desc("confidence"), "id")
    return ok.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).drop("k")


def clusterable(facts: DataFrame) -> DataFrame:
    """Facts that can belong to a concept: all but evidence, zones and incident records."""
    return facts.where(~F.col("kind").isin(*S.EVIDENCE_KINDS))


# ---- writes ----


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = (), if_set: tuple[str, ...] = ()) -> DataFrame:
    """Old rows overlaid by new ones: ``keep`` columns survive, ``if_set`` ones change only to a value, others always.

    The result is to be written to a new place; reading and overwriting one
    path in a plan would lose data.
    """
    new = new.dropDuplicates(keys).withColumn("_new", F.lit(True))
    o, n = old.alias("o"), new.alias("n")
    j = o.join(n, keys, "full_outer")

    def value(c: str):
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in keep:
            return F.coalesce(a, b).alias(c)
        if c in if_set:
            return F.coalesce(b, a).alias(c)
        return F.when(F.col("n._new"), b).otherwise(a).alias(c)

    return j.select(*[F.col(k) if k in keys else value(k) for k in old.columns])


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows whose key is not there yet, one a key."""
    return new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")


def redirect(edges: DataFrame, survivors: DataFrame) -> DataFrame:
    """Edges (src, dst, kind) with duplicates' ends moved to their survivors (dup, survivor), without loops and repeats."""
    a = survivors.select(F.col("dup").alias("src"), F.col("survivor").alias("s1"))
    b = survivors.select(F.col("dup").alias("dst"), F.col("survivor").alias("s2"))
    j = edges.join(a, "src", "left").join(b, "dst", "left")
    return j.select(F.coalesce("s1", "src").alias("src"), F.coalesce("s2", "dst").alias("dst"), "kind").where("src <> dst").distinct()


def replace_files(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """Rows of the files that were read again come from ``new``, the others from ``old``."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def cascade(child: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """A child table without the rows of deleted parents (id)."""
    return child.join(gone.select(F.col("id").alias(key)), key, "left_anti")


# ---- duplicates ----


def leaders(spark: SparkSession, items: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, leader): each row is a leader unless an earlier leader is adjacent; then it belongs to the earliest.

    ``edges(a, b)`` point from earlier to later. In rounds, undecided rows
    without an undecided earlier neighbour that is not beaten become leaders and
    beat their later neighbours: the same set as a walk in order.
    """
    order = items.select("id", F.struct(F.col("created_at"), F.col("id")).alias("ord"))
    e = Stored(spark, edges.distinct(), "edges")
    lead = Stored(spark, items.select("id").limit(0), "leaders")
    found, open_ = [lead], Stored(spark, items.select("id").distinct(), "open")
    while open_.df.limit(1).count():
        live = e.df.join(open_.df.withColumnRenamed("id", "a"), "a", "left_semi").join(open_.df.withColumnRenamed("id", "b"), "b", "left_semi")
        new = Stored(spark, open_.df.join(live.select(F.col("b").alias("id")), "id", "left_anti"), "leaders")
        beaten = e.df.join(new.df.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id"))
        nxt = Stored(spark, open_.df.join(new.df.union(beaten), "id", "left_anti"), "open")
        open_.drop()
        found.append(new)
        open_ = nxt
    all_leaders = spark.read.schema(lead.schema).parquet(*[f.path for f in found])
    mine = e.df.join(all_leaders.withColumnRenamed("id", "a"), "a", "left_semi").join(order.withColumnRenamed("id", "a"), "a")
    member = mine.groupBy("b").agg(F.min_by("a", "ord").alias("leader")).withColumnRenamed("b", "id")
    own = all_leaders.withColumn("leader", F.col("id"))
    return own.unionByName(member.join(all_leaders, "id", "left_anti").select("id", "leader"))


def survivors(facts: DataFrame, groups: DataFrame) -> DataFrame:
    """(dup, survivor, corroborated): of a leader's group the best grounded, then oldest row survives."""
    f = facts.join(groups, "id")
    best = F.struct((-S.rank(F.col("grounding"), S.SURVIVOR_RANK)).alias("r"), "created_at", "id")
    g = f.groupBy("leader").agg(
        F.min_by("id", best).alias("survivor"), F.count("*").alias("n"),
        (F.bool_or(F.coalesce("grounding", F.lit("stated")) == "structural") & F.bool_or(F.coalesce("grounding", F.lit("stated")) == "stated")).alias("corroborated"),
    ).where("n > 1")
    return f.join(g, "leader").where("id <> survivor").select(F.col("id").alias("dup"), "survivor", "corroborated")


# ---- concepts ----


def centroids(members: DataFrame, key: str) -> DataFrame:
    """(key, n, centroid): the mean of the members' vectors, element by element."""
    x = members.where(F.size("embedding") > 0).select(key, F.posexplode("embedding").alias("pos", "x"))
    m = x.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    return m.groupBy(key).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))


class _Concepts:
    """The vector sums of a project's concepts, in order of founding, a matrix for each vector length.

    All concepts are screened in single precision, for a wave of vectors at
    once; those that its rounding cannot rule out are compared exactly.
    """

    def __init__(self):
        self.at: dict[str, tuple[int, int]] = {}  # the length and row of a concept
        self.names: dict[int, list[str | None]] = {}  # by rows; None: merged into another
        self.sums: dict[int, np.ndarray] = {}
        self.unit: dict[int, np.ndarray] = {}
        self.moved: dict[int, set[int]] = {}  # rows that are new or other since the last screening

    def add(self, concept: str, v: np.ndarray) -> None:
        """Add a vector to a concept, which is founded if it is not there."""
        d = len(v)
        if concept not in self.at:
            names = self.names.setdefault(d, [])
            if len(names) == len(self.sums.get(d, ())):  # full: twice the room
                for of, kind in ((self.sums, np.float64), (self.unit, np.float32)):
                    room = np.zeros((max(16, 2 * len(names)), d), kind)
                    room[: len(names)] = of.get(d, room[:0])
                    of[d] = room
            self.at[concept] = d, len(names)
            names.append(concept)
        d, k = self.at[concept]
        self._set(d, k, self.sums[d][k] + v)

    def merge(self, into: str, gone: str) -> None:
        d, k = self.at.pop(gone)
        self.add(into, self.sums[d][k])
        self.names[d][k] = None
        self._set(d, k, np.zeros(d))

    def _set(self, d: int, k: int, s: np.ndarray) -> None:
        n = np.linalg.norm(s)
        self.sums[d][k], self.unit[d][k] = s, s / n if 0 < n < np.inf else 0
        self.moved.setdefault(d, set()).add(k)

    def screen(self, vs: list[np.ndarray], least: float) -> list[np.ndarray]:
        """For each vector the rows of its length that can have a cosine of at least ``least``."""
        self.moved.clear()
        out = [np.empty(0, np.int64)] * len(vs)
        for d in {len(v) for v in vs} & self.names.keys():
            mine = [i for i, v in enumerate(vs) if len(v) == d]
            q = np.stack([vs[i] / max(np.abs(vs[i]).max(), 1e-300) for i in mine])
            q /= np.linalg.norm(q, axis=1, keepdims=True)
            can = self.unit[d][: len(self.names[d])] @ q.T.astype(np.float32) >= least - (d + 8) * 2.0**-23
            for j, i in enumerate(mine):
                out[i] = np.flatnonzero(can[:, j])
        return out

    def nearest(self, v: np.ndarray, rows: np.ndarray, least: float, most: int) -> list[tuple[str, float]]:
        """The nearest concepts, exactly, of the screened rows and those that moved since."""
        d = len(v)
        if self.moved.get(d):
            rows = np.union1d(rows, list(self.moved[d]))
        if not len(rows):
            return []
        m = self.sums[d][rows]
        c = m @ v / (np.linalg.norm(m, axis=1) * np.linalg.norm(v) + 1e-300)
        names = self.names[d]
        near = [(names[rows[i]], float(c[i])) for i in np.flatnonzero(c >= least) if names[rows[i]] is not None]
        return sorted(near, key=lambda x: -x[1])[:most]


#: What decides on a fact between ``attach`` and ``offer``: (kind, [(concept, cosine), …]) to ("attach", concept), ("merge", a, b) or ("create",).
Judge = Callable[[str, list[tuple[str, float]]], tuple]


def nearest_or_new(kind: str, offered: list[tuple[str, float]]) -> tuple:
    """The offline judge: the nearest concept if it is near enough, else a new one."""
    return ("attach", offered[0][0]) if offered[0][1] >= 0.85 else ("create",)


def online_clusters(facts: DataFrame, attach: float = 0.88, offer: float = 0.60, recheck: float = 0.85, wave: int = 4, offers: int = 5, judge: Judge = nearest_or_new) -> DataFrame:
    """(project_id, id, concept): facts of a project, in order, in waves, join a concept or found one.

    The ``offers`` nearest concepts with a cosine of at least ``offer`` are read
    at the beginning of a wave. A fact at ``attach`` or more joins the nearest, one
    without an offer founds; the judge decides on the others, after those. What
    the judge names must have been offered and still be there, else the fact
    founds; and a fact that founds joins a concept that is by then at ``recheck``
    or nearer. Each decision moves the centroid. Facts without a vector go to a
    bucket of their kind. So a project is one sequence; other projects run beside.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["created_at", "id"])
        concepts = _Concepts()
        into: dict[str, str] = {}  # merged concepts
        out: dict[str, str] = {}

        def place(id_: str, v: np.ndarray, rows: np.ndarray, concept: str | None) -> None:
            if concept not in concepts.at:
                live = concepts.nearest(v, rows, recheck, 1)
                concept = live[0][0] if live else id_
            concepts.add(concept, v)
            out[id_] = concept

        facts_ = list(zip(pdf["id"], pdf["kind"], pdf["embedding"]))
        for at in range(0, len(facts_), wave):
            usable = []
            for id_, kind, emb in facts_[at : at + wave]:
                v = None if emb is None or not len(emb) else np.asarray(emb, dtype=np.float64)
                if v is None or not np.isfinite(v).all() or not v.any():
                    out[id_] = f"{kind} (uncategorized)"
                else:
                    usable.append((id_, kind, v))
            sure, open_ = [], []
            for (id_, kind, v), rows in zip(usable, concepts.screen([v for _, _, v in usable], min(offer, recheck))):
                got = concepts.nearest(v, rows, offer, offers)
                if got and got[0][1] < attach:
                    open_.append((id_, kind, v, rows, got))
                else:
                    sure.append((id_, v, rows, got[0][0] if got else None))
            for id_, v, rows, concept in sure:
                place(id_, v, rows, concept)
            for id_, kind, v, rows, got in open_:
                told, offered = judge(kind, got), {c for c, _ in got}
                concept = None
                if told[0] == "attach" and told[1] in offered:
                    concept = told[1]
                elif told[0] == "merge" and {told[1], told[2]} <= offered & concepts.at.keys() and told[1] != told[2]:
                    concepts.merge(told[1], told[2])
                    into[told[2]] = concept = told[1]
                place(id_, v, rows, concept)

        def now(c: str) -> str:
            while c in into:
                c = into[c]
            return c

        return pd.DataFrame({"project_id": pdf["project_id"], "id": pdf["id"], "concept": [now(out[i]) for i in pdf["id"]]})

    return facts.select("project_id", "id", "kind", "created_at", "embedding").groupBy("project_id").applyInPandas(run, "project_id string, id string, concept string")


def dominant(members: DataFrame, key: str) -> DataFrame:
    """(key, scope, grounding): the commonest written scope (ties: the smaller) and the strongest grounding."""
    s = members.where("scope is not null").groupBy(key, "scope").count()
    scope = s.groupBy(key).agg(F.min_by("scope", F.struct(-F.col("count"), "scope")).alias("scope"))
    g = members.groupBy(key).agg(F.max_by(F.coalesce("grounding", F.lit("stated")), S.rank(F.col("grounding"), S.CONCEPT_RANK)).alias("grounding"))
    return g.join(scope, key, "left").select(key, "scope", "grounding")


def prune(facts: DataFrame, edges: DataFrame, below: float = 0.25) -> DataFrame:
    """Facts without weak orphans: low confidence, no cluster and no edge at either end."""
    linked = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).where("id is not null")
    weak = facts.where((F.col("confidence") < below) & F.col("cluster_id").isNull()).join(linked, "id", "left_anti")
    return facts.join(weak.select("id"), "id", "left_anti")


def pairs_to_verify(facts: DataFrame, most: int = 5) -> DataFrame:
    """(cluster_id, kind, a, b): the first pairs of one kind in each cluster, in order of both rows' places.

    Only a cluster's first ``most`` + 1 rows of a kind can take part, so the
    pairs are made of those: no cluster is paired with itself whole.
    """
    w = Window.partitionBy("cluster_id", "kind").orderBy("created_at", "id")
    f = facts.where("cluster_id is not null").withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most + 1)
    a, b = f.alias("a"), f.alias("b")
    j = a.join(b, (F.col("a.cluster_id") == F.col("b.cluster_id")) & (F.col("a.kind") == F.col("b.kind")) & (F.col("a.pos") < F.col("b.pos")))
    k = Window.partitionBy("a.cluster_id", "a.kind").orderBy("a.pos", "b.pos")
    j = j.withColumn("k", F.row_number().over(k)).where(F.col("k") <= most)
    return j.select(F.col("a.cluster_id").alias("cluster_id"), F.col("a.kind").alias("kind"), F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def searched(facts: DataFrame) -> list[str]:
    """The columns of a fact in which full text is searched; evidence if there is any."""
    return [c for c in ("id", "title", "summary", "evidence") if c in facts.columns]


def recall(facts: DataFrame, query: str, kinds: tuple[str, ...] = (), scope: str | None = None, enrichment: bool = False, limit: int = 20) -> DataFrame:
    """Facts that hold all terms of a query, best first; filters reach the scan, the order is total."""
    f = facts.where(T.matches(searched(facts), query))
    if kinds:
        f = f.where(F.col("kind").isin(*kinds))
    if scope:
        f = f.where(F.col("scope") == scope)
    if not enrichment:
        f = f.where(~F.coalesce("grounding", F.lit("stated")).isin("external", "model"))
    return f.orderBy(F.desc("confidence"), F.desc("updated_at"), "id").limit(limit)
