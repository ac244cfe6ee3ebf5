"""Data sets of the views and the two roll-ups over all projects: organization and wisdom."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorequarry import schema as S
from lorequarry.functions import text as T
from lorequarry.operators import graph as G
from lorequarry.operators import links as L

TIMELINE = ("decision", "business_rule", "constraint", "pattern", "problem", "solution", "intent")
BUSINESS = ("business_rule", "entity", "constraint", "pattern")
LEVEL_RANK = {"expert": 5, "proficient": 4, "competent": 3, "advanced_beginner": 2, "novice": 1}


def triage_audit(labels: DataFrame, windows: DataFrame, chars: int = 600) -> DataFrame:
    """Labels with session, place and the beginning of their window's text."""
    return labels.join(windows.select("window_id", "session_id", "start_idx", F.substring("text", 1, chars).alias("excerpt")), "window_id")


def project_map(concepts: DataFrame, facts: DataFrame, code_links: DataFrame) -> DataFrame:
    """(id, name, member, kind, title, files): each fact of each concept as a row; a concept without facts has one with nulls."""
    files = code_links.groupBy(F.col("fact_id").alias("member")).agg(F.array_sort(F.collect_set("path")).alias("files"))
    m = facts.where("cluster_id is not null").select("cluster_id", F.col("id").alias("member"), "kind", "title").join(files, "member", "left")
    j = concepts.select("id", "name").join(m, F.col("id") == F.col("cluster_id"), "left")
    return j.select("id", "name", "member", "kind", "title", F.coalesce("files", F.array().cast("array<string>")).alias("files"))


def decision_timeline(facts: DataFrame, code_links: DataFrame, origins: DataFrame) -> DataFrame:
    """(id, kind, title, ts, session_id, files) of decisions and the like; rows carry their time, readers order by it."""
    files = code_links.groupBy(F.col("fact_id").alias("id")).agg(F.array_sort(F.collect_set("path")).alias("files"))
    f = facts.where(F.col("kind").isin(*TIMELINE)).select("id", "kind", "title", F.col("created_at").alias("ts"))
    j = f.join(files, "id", "left").join(origins.select(F.col("fact_id").alias("id"), "session_id"), "id", "left")
    return j.select("id", "kind", "title", "ts", "session_id", F.coalesce("files", F.array().cast("array<string>")).alias("files"))


def cross_project(concepts: DataFrame, links: DataFrame) -> DataFrame:
    """(id, name, others, best): concepts linked with concepts of other projects."""
    n = L.neighbours(links)
    p = concepts.select("id", "project_id")
    j = n.join(p, "id").join(p.select(F.col("id").alias("other"), F.col("project_id").alias("there")), "other").where("project_id <> there")
    g = j.groupBy("id").agg(F.countDistinct("other").alias("others"), F.max("score").alias("best"))
    return concepts.select("id", "name").join(g, "id").select("id", "name", "others", "best")


def business_logic(concepts: DataFrame, facts: DataFrame) -> DataFrame:
    """(id, name, rules): concepts with business facts and how many of each kind, as ``kind=n``."""
    n = facts.where(F.col("kind").isin(*BUSINESS) & F.col("cluster_id").isNotNull()).groupBy("cluster_id", "kind").agg(F.count("*").alias("n"))
    g = n.groupBy(F.col("cluster_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "kind", F.col("n").cast("string")))), ",").alias("rules"))
    return concepts.select("id", "name").join(g, "id").select("id", "name", "rules")


def snapshot_index(**tables: DataFrame) -> DataFrame:
    """(layer, id, label): one search index over tables(id, label)."""
    out = None
    for name, t in tables.items():
        part = t.where("id is not null").select(F.lit(name).alias("layer"), F.col("id").cast("string").alias("id"), F.coalesce("label", F.lit("")).alias("label")).distinct()
        out = part if out is None else out.unionByName(part)
    return out


def export_json(df: DataFrame) -> DataFrame:
    """(line): each row as one JSON object, nulls written out; ``df.write.text`` of it is the export."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("line"))


# ---- organization ----


def areas(skills: DataFrame) -> DataFrame:
    """(area, level, n, rank): skills(name, kind, weight, project_count) rolled up, the fullest area first."""
    m = F.create_map(*[F.lit(x) for kv in S.AREAS.items() for x in kv])
    s = skills.withColumn("area", F.coalesce(m[F.lower("kind")], F.lit(S.OTHER_AREA)))
    g = s.groupBy("area").agg(F.sum("weight").alias("weight"), F.max("project_count").alias("projects"), F.count("*").alias("n"))
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "area")) - 1  # a row an area
    return g.select("area", T.level("weight", "projects").alias("level"), "n", rank.alias("rank"))


def organized_projects(activity: DataFrame, topics: DataFrame) -> DataFrame:
    """(project, status, focus) from activity(project, idle_days) and topics(project, topic): the first three topics in order."""
    t = topics.where("topic is not null").groupBy("project").agg(F.slice(F.array_sort(F.collect_set("topic")), 1, 3).alias("t"))
    j = activity.join(t, "project", "left")
    focus = F.when(F.size("t") > 0, F.concat(F.lit("Works across "), F.array_join("t", ", "), F.lit("."))).otherwise("Indexed project.")
    return j.select("project", T.project_status("idle_days").alias("status"), focus.alias("focus"))


def topics_of(domains: DataFrame, concepts: DataFrame) -> DataFrame:
    """(subject, topic, kind, name): domains(name, kind) as topics, with the concepts(name, domain) that name them."""
    d = domains.select(F.when(F.col("kind") == "tech", "Technical Domains").otherwise("Business & Industry").alias("subject"), F.col("name").alias("topic"), T.skill_name("name").alias("key")).distinct()
    own = d.select("subject", "topic", F.lit("domain").alias("kind"), F.col("topic").alias("name"))
    c = concepts.where("name is not null").select("name", T.skill_name("domain").alias("key"))
    inside = d.join(c, "key").select("subject", "topic", F.lit("concept").alias("kind"), "name")
    orphans = c.where("key is null").select(F.lit("Concepts & Patterns").alias("subject"), F.lit("Recurring concepts").alias("topic"), F.lit("concept").alias("kind"), "name")
    return own.unionByName(inside).unionByName(orphans).distinct()


# ---- wisdom ----


def open_gaps(facts: DataFrame, per_project: int = 50, most: int = 30) -> DataFrame:
    """(title, project_id): knowledge gaps, at most ``per_project`` of a project, one of each title in any case, the first ``most``."""
    w = Window.partitionBy("project_id").orderBy("id")
    g = facts.where((F.col("kind") == "knowledge_gap") & F.col("title").isNotNull()).withColumn("k", F.row_number().over(w)).where(F.col("k") <= per_project)
    one = g.groupBy(F.lower(T.strip("title")).alias("key")).agg(F.min(F.struct("project_id", "id", "title")).alias("m"))
    return one.orderBy("m.project_id", "m.id").limit(most).select("m.title", "m.project_id")


def insights(skills: DataFrame, most: int = 6) -> DataFrame:
    """(title, body, evidence): what recurs in more than one project, from skills(name, project_count)."""
    top = skills.where("project_count > 1").orderBy(F.desc("project_count"), "name").limit(most)
    g = top.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("project_count")).alias("p"), "name"))), lambda x: x["name"]).alias("names"))
    return g.where(F.size("names") > 0).select(
        F.lit("Consistent cross-project strengths").alias("title"), F.concat(F.array_join("names", ", "), F.lit(" recur across multiple projects.")).alias("body"),
        F.concat(F.size("names").cast("string"), F.lit(" skill(s) evidenced in 2+ projects")).alias("evidence"),
    )


def headline(areas_: DataFrame, industries: DataFrame, projects: int) -> DataFrame:
    """(headline, narrative) from areas(area, level) and industries(name, projects)."""
    rank = F.create_map(*[F.lit(x) for kv in LEVEL_RANK.items() for x in kv])
    a = areas_.agg(F.count("*").alias("n"), F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-rank[F.col("level")]).alias("r"), "rank", "area"))), 1, 3), lambda x: x["area"]).alias("top"))
    i = industries.agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("projects")).alias("p"), "name"))), 1, 3), lambda x: x["name"]).alias("ind"))
    where = F.when(F.size("ind") > 0, F.array_join("ind", ", ")).otherwise("multiple domains")
    head = F.when(F.size("top") > 0, F.concat(F.lit("Engineer working across "), where, F.lit(", strongest in "), F.array_join(F.slice("top", 1, 2), " and "), F.lit("."))).otherwise("Cross-project knowledge profile.")
    led = F.when(F.size("top") > 0, F.concat(F.lit(", led by "), F.array_join("top", ", "), F.lit("."))).otherwise(".")
    j = a.withColumn("one", F.lit(1)).join(i.withColumn("one", F.lit(1)), "one")  # one row each
    return j.select(head.alias("headline"), F.concat(F.lit(f"Across {projects} project(s): "), F.col("n").cast("string"), F.lit(" competency area(s)"), led).alias("narrative"))


def core_pack(facts: DataFrame, kinds: tuple[str, ...] = ("decision", "constraint", "business_rule", "entity"), per_kind: int = 20, chars: int = 3000) -> DataFrame:
    """(pack): the surest facts of each kind as one bounded text."""
    w = Window.partitionBy("kind").orderBy(F.desc_nulls_last("confidence"), "id")
    f = facts.where(F.col("kind").isin(*kinds) & F.col("title").isNotNull()).withColumn("k", F.row_number().over(w)).where(F.col("k") <= per_kind)
    per = f.groupBy("kind").agg(F.concat(F.col("kind"), F.lit(": "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "title"))), lambda x: x["title"]), "; ")).alias("line"))
    body = F.array_join(F.array_sort(F.collect_list("line")), "\n")
    return per.agg(body.alias("b")).select(F.when(F.length("b") > chars, F.concat(F.substring("b", 1, chars), F.lit("…"))).otherwise(F.col("b")).alias("pack"))
