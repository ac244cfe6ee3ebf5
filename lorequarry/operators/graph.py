"""Groups, relations and views of the knowledge graph: all by joins on keys, in rounds where a result feeds itself."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorequarry import schema as S
from lorequarry.functions import text as T
from lorequarry.session import Stored


def linked_groups(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(group_id, member) of all that links(a, b) connect, directly or not; group_id is the smallest member.

    Each round hands a label to the neighbours and follows labels to their own
    labels; null ends and loops are ignored.
    """
    e = links.where("a is not null and b is not null and a <> b").select("a", "b")
    sym = Stored(spark, e.union(e.select("b", "a")).distinct(), "links")
    at = Stored(spark, sym.df.groupBy(F.col("a").alias("member")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    changed = True
    while changed:
        seen = sym.df.join(at.df.select(F.col("member").alias("b"), "label"), "b").groupBy(F.col("a").alias("member")).agg(F.min("label").alias("near"))
        step = at.df.join(seen, "member").select("member", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = at.df.select(F.col("member").alias("label"), F.col("label").alias("beyond"))
        step = step.join(jump, "label", "left").select("member", "old", F.least("label", "beyond").alias("label"))
        nxt = Stored(spark, step, "labels")
        changed = nxt.df.where("label < old").limit(1).count() > 0
        at.drop()
        at = nxt
    sym.drop()
    return at.df.select(F.col("label").alias("group_id"), "member")


def suggested_groups(spark: SparkSession, links: DataFrame, least: float = 2.0) -> DataFrame:
    """Groups of projects whose links(a, b, weight) weigh at least ``least``."""
    return linked_groups(spark, links.where(F.col("weight") >= least))


def project_links(links: DataFrame, concepts: DataFrame) -> DataFrame:
    """(a, b, weight), a < b: how many different concept links(a, b) join two projects."""
    p = concepts.select("id", "project_id")
    j = links.select("a", "b").distinct().join(p.select(F.col("id").alias("a"), F.col("project_id").alias("pa")), "a").join(p.select(F.col("id").alias("b"), F.col("project_id").alias("pb")), "b").where("pa <> pb")
    pair = j.select(F.least("pa", "pb").alias("pa"), F.greatest("pa", "pb").alias("pb"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pair.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").cast("double").alias("weight"))


def owned_relations(keys: DataFrame, fields: DataFrame, entities: DataFrame) -> DataFrame:
    """(src, dst): foreign keys(source, target) between entities(node, entity); a field stands for the table that has it.

    ``fields(child, parent)``; what leads to no entity, or back to itself, is left out.
    """
    e = entities.select("node", "entity")
    own = keys.join(e.select(F.col("node").alias("source"), F.col("entity").alias("direct")), "source", "left")
    own = own.join(fields.select(F.col("child").alias("source"), "parent").dropDuplicates(["source"]), "source", "left")
    own = own.join(e.select(F.col("node").alias("parent"), F.col("entity").alias("by_field")), "parent", "left")
    to = own.join(e.select(F.col("node").alias("target"), F.col("entity").alias("dst")), "target")
    return to.select(F.coalesce("direct", "by_field").alias("src"), "dst").where("src <> dst").distinct()


def ids_by_title(facts: DataFrame, titles: DataFrame) -> DataFrame:
    """(title, id): the fact that titles(title) name in any case; of several the smallest id."""
    f = facts.where("title is not null").groupBy(F.lower("title").alias("key")).agg(F.min("id").alias("id"))
    return titles.distinct().join(f, F.lower("title") == F.col("key")).select("title", "id")


def with_evidence(claims: DataFrame, facts: DataFrame, texts: DataFrame) -> DataFrame:
    """claims(src, dst, evidence, text_id) whose two ends are titles of facts, and whose evidence is in their text."""
    known = facts.where("title is not null").select(F.lower("title").alias("k")).distinct()
    c = claims.join(known, F.lower("src") == F.col("k"), "left_semi").join(known, F.lower("dst") == F.col("k"), "left_semi")
    j = c.join(texts.select("text_id", "text"), "text_id")
    return j.where(F.contains(F.lower("text"), F.lower("evidence")) & (F.length("evidence") > 0)).drop("text")


def level_edges(levels: DataFrame) -> DataFrame:
    """(parent, child, kind) between neighbouring levels(project_id, level, name) of each project."""
    l = levels.where("name is not null and project_id is not null").distinct()
    a, b = l.alias("a"), l.alias("b")
    j = a.join(b, (F.col("a.project_id") == F.col("b.project_id")) & (F.col("a.level") + 1 == F.col("b.level")))
    kind = F.concat(F.col("a.level").cast("string"), F.lit("-"), F.col("b.level").cast("string"))
    return j.select(F.col("a.name").alias("parent"), F.col("b.name").alias("child"), kind.alias("kind")).distinct()


def knowledge_graph(facts: DataFrame, edges: DataFrame, concepts: DataFrame, nodes: int = 1500, most: int = 3000) -> tuple[DataFrame, DataFrame]:
    """Nodes(id, kind, label), zones and entities first, then concepts as far as there is room; edges(source, target, kind) between them."""
    first = F.when(F.col("kind") == "business_domain", 0).when(F.col("kind") == "tech_domain", 1).when(F.col("kind") == "entity", 2).otherwise(3)
    f = facts.where(F.col("kind").isin(*S.GRAPH_KINDS)).select("id", "kind", F.col("title").alias("label"), first.alias("p"), (-F.coalesce("updated_at", F.lit(0))).alias("o"))
    c = concepts.select("id", F.lit("concept").alias("kind"), F.col("name").alias("label"), F.lit(4).alias("p"), (-F.coalesce("member_count", F.lit(0))).cast("long").alias("o"))
    n = f.unionByName(c).orderBy("p", "o", "id").limit(nodes).select("id", "kind", "label")
    at = facts.where(F.col("kind").isin(*S.GRAPH_KINDS) & F.col("cluster_id").isNotNull()).select(F.col("id").alias("source"), F.col("cluster_id").alias("target"), F.lit("in_concept").alias("kind"))
    e = edges.where(F.col("kind").isin(*S.GRAPH_EDGE_KINDS)).select(F.col("src").alias("source"), F.col("dst").alias("target"), "kind").unionByName(at)
    e = e.where("source <> target").join(n.select(F.col("id").alias("source")), "source", "left_semi").join(n.select(F.col("id").alias("target")), "target", "left_semi")
    return n, e.select("source", "target", "kind").distinct().orderBy(F.col("kind") == "in_concept", "source", "target", "kind").limit(most)


def workspaces(projects: DataFrame) -> DataFrame:
    """(project_id, workspace_id, name, source, confidence) of projects(id, path, configured, remote).

    What is configured comes first, then the owner of the remote, then the parent
    folder unless it is a generic one; projects with none of them are left out.
    """
    parent = F.regexp_extract(F.regexp_replace("path", "/+$", ""), r"([^/]+)/[^/]+$", 1)
    folder = F.when((parent != "") & ~F.lower(parent).isin(*S.GENERIC_FOLDERS), parent)
    set_, org = F.nullif(T.strip("configured"), F.lit("")), T.org_of_remote("remote")
    name = F.coalesce(set_, org, folder)
    source = F.when(set_.isNotNull(), "config").when(org.isNotNull(), "git-org").otherwise("path")
    w = projects.select(F.col("id").alias("project_id"), name.alias("name"), source.alias("source")).where("name is not null").distinct()
    sure = F.when(F.col("source") == "config", 1.0).when(F.col("source") == "git-org", 0.8).otherwise(0.4)
    return w.select("project_id", F.concat(F.lit("ws:"), F.substring(F.sha1(F.lower("name")), 1, 16)).alias("workspace_id"), "name", "source", sure.alias("confidence"))


def folder_layers(analysis: DataFrame, most: int = 30) -> DataFrame:
    """(dir, layer, files, total): the commonest layer of each folder of analysis(dir, layer), the largest folders first."""
    n = analysis.where("layer is not null and dir is not null").groupBy("dir", "layer").agg(F.count("*").alias("files"))
    g = n.groupBy("dir").agg(F.min(F.struct((-F.col("files")).alias("f"), "layer")).alias("m"), F.sum("files").alias("total"))
    return g.select("dir", F.col("m.layer").alias("layer"), (-F.col("m.f")).alias("files"), "total").orderBy(F.desc("total"), "dir").limit(most)


def first_windows(provenance: DataFrame, windows: DataFrame, sessions: DataFrame) -> DataFrame:
    """(fact_id, window_id, session_id, agent): one window of each fact, the smallest, with where it comes from."""
    one = provenance.groupBy("fact_id").agg(F.min("window_id").alias("window_id"))
    s = sessions.select(F.col("id").alias("session_id"), "agent").dropDuplicates(["session_id"])
    return one.join(windows.select("window_id", "session_id"), "window_id").join(s, "session_id", "left").select("fact_id", "window_id", "session_id", "agent")


def spread(provenance: DataFrame, windows: DataFrame, sessions: DataFrame) -> DataFrame:
    """(fact_id, sources, corroborated): a fact found both in documents and in a conversation corroborates itself."""
    s = sessions.select(F.col("id").alias("session_id"), "agent").distinct()
    j = provenance.join(windows.select("window_id", "session_id"), "window_id").join(s, "session_id")
    docs = F.col("agent") == "docs"
    return j.groupBy("fact_id").agg(F.countDistinct("session_id").alias("sources"), (F.bool_or(docs) & F.bool_or(~docs)).alias("corroborated"))


def count_up(counters: DataFrame, more: DataFrame) -> DataFrame:
    """(counter, n): counters raised by what a run adds."""
    return counters.unionByName(more).groupBy("counter").agg(F.sum("n").alias("n"))


def incident_chains(incidents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts(id, kind, title, summary, evidence, window_id) and edges(src, dst, kind) of incidents(window_id, problem, root_cause, resolution, evidence)."""
    i = incidents.where("problem is not null and root_cause is not null")
    key = lambda kind, *parts: T.sha_id(F.lit(kind), F.lower(F.concat_ws("|", *parts)))
    i = i.withColumn("incident", key("incident", "problem")).withColumn("cause", key("root_cause", "problem", "root_cause")).withColumn("fix", F.when(F.col("resolution").isNotNull(), key("solution", "problem", "resolution")))
    node = lambda id_, kind, title, summary: F.struct(F.col(id_).alias("id"), F.lit(kind).alias("kind"), F.col(title).alias("title"), summary.alias("summary"))
    none = F.lit(None).cast("string")
    facts = i.select("window_id", "evidence", F.explode(F.array(node("incident", "incident", "problem", F.concat(F.lit("Resolved: "), "resolution")), node("cause", "root_cause", "root_cause", none), node("fix", "solution", "resolution", none))).alias("f"))
    facts = facts.where("f.id is not null").select("f.*", "evidence", "window_id").dropDuplicates(["id"])
    edge = lambda a, b, kind: i.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(kind).alias("kind"))
    return facts, edge("incident", "cause", "caused_by").unionByName(edge("fix", "incident", "resolves")).where("src is not null").distinct()


def verdict_edges(verdicts: DataFrame, least: float = 0.6) -> DataFrame:
    """(src, dst, kind) of verdicts(a, b, verdict, confidence) that are sure enough: contradictions and what replaces what."""
    v = verdicts.where(F.col("confidence") >= least)
    back = F.col("verdict") == "superseded_by"
    e = v.where(F.col("verdict").isin("contradicts", "supersedes", "superseded_by"))
    return e.select(F.when(back, F.col("b")).otherwise(F.col("a")).alias("src"), F.when(back, F.col("a")).otherwise(F.col("b")).alias("dst"), F.when(back, "supersedes").otherwise(F.col("verdict")).alias("kind")).distinct()

