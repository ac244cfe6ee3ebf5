"""The query API: one method a tool, each a DataFrame over the store's tables."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorequarry.functions import text as T
from lorequarry.operators import facts as FA
from lorequarry.operators import links as L

DECISIONS, BUSINESS = ("decision", "constraint", "pattern"), ("business_rule", "entity", "constraint", "pattern")
PRODUCT = ("requirement", "feature", "actor", "process", "metric", "intent")
SECTIONS = {"intent": "intents", "problem": "problems", "constraint": "constraints", "decision": "decisions", "solution": "solutions"}


@dataclass
class Knowledge:
    """Tables of one store; those that a tool doesn't use may be None.

    facts(id, kind, title, summary, confidence, scope, grounding, cluster_id, window_id, created_at, updated_at),
    edges(src, dst, kind), code_links(fact_id, path), nodes(id, name, kind, path), files(path, content_hash, …),
    analysis(path, content_hash), concepts(id, project_id, name, summary, domain, member_count), links(a, b, kind, score),
    labels(window_id, relevance, …, kept, produced_at), runs(agent_name, ok, produced_at), skills, projects(id, name, workspace).
    """

    facts: DataFrame | None = None
    edges: DataFrame | None = None
    code_links: DataFrame | None = None
    nodes: DataFrame | None = None
    files: DataFrame | None = None
    analysis: DataFrame | None = None
    concepts: DataFrame | None = None
    links: DataFrame | None = None
    labels: DataFrame | None = None
    runs: DataFrame | None = None
    skills: DataFrame | None = None
    industries: DataFrame | None = None
    projects: DataFrame | None = None

    # ---- code ----

    def search(self, query: str, kind: str | None = None, limit: int = 10) -> DataFrame:
        n = self.nodes.where(T.holds("name", query))
        n = n.where(F.col("kind") == kind) if kind else n
        return n.orderBy(F.length("name"), "name", "id").limit(limit)

    def node(self, name: str) -> DataFrame:
        return self.nodes.where(F.col("name") == name).orderBy("kind", "id").limit(1)

    # ---- facts ----

    def recall(self, query: str, kinds: tuple[str, ...] = (), scope: str | None = None, enrichment: bool = False, limit: int = 20) -> DataFrame:
        return FA.recall(self.facts, query, kinds, scope, enrichment, limit)

    def context(self, task: str) -> tuple[DataFrame, DataFrame]:
        return self.recall(task, limit=12), self.search(task, limit=8)

    def ask(self, query: str, inferred: bool = False, limit: int = 25) -> DataFrame:
        ok = ("structural", "corroborated", "stated") + (("external", "model") if inferred else ())
        f = self.facts.where(T.matches(FA.searched(self.facts), query, every=False) & F.coalesce("grounding", F.lit("stated")).isin(*ok))
        return f.orderBy(F.desc("confidence"), "id").limit(limit)

    def for_file(self, path: str, kinds: tuple[str, ...] = (), limit: int = 20) -> DataFrame:
        """Facts linked to a file, newest first; kinds are filtered after the limit, as callers expect."""
        ids = self.code_links.where(F.col("path") == path).select(F.col("fact_id").alias("id")).distinct()
        f = self.facts.join(ids, "id", "left_semi").orderBy(F.desc("updated_at"), "id").limit(limit)
        return f.where(F.col("kind").isin(*kinds)) if kinds else f

    def decisions(self, topic: str | None = None, path: str | None = None, limit: int = 20) -> DataFrame:
        return self.for_file(path, DECISIONS, limit) if path else self.recall(topic or "", DECISIONS, limit=limit)

    def business_logic(self, topic: str | None = None, path: str | None = None, limit: int = 20) -> DataFrame:
        return self.for_file(path, BUSINESS, limit) if path else self.recall(topic or "", BUSINESS, limit=limit)

    def requirements(self, query: str | None = None, limit: int = 60) -> DataFrame:
        f = self.facts.where(F.col("kind").isin(*PRODUCT))
        f = f.where(T.holds("title", query) | T.holds("summary", query)) if query else f
        return f.orderBy("kind", F.desc("updated_at"), "id").limit(limit)

    def gaps(self, limit: int = 100) -> DataFrame:
        return self.facts.where("kind = 'knowledge_gap'").orderBy(F.desc("created_at"), "id").limit(limit)

    def learn(self, limit: int = 40) -> DataFrame:
        return self.facts.where((F.col("scope") == "industry") & F.col("grounding").isin("model", "external")).orderBy(F.desc("grounding"), "title", "id").limit(limit)

    def incidents(self, query: str | None = None, limit: int = 40) -> DataFrame:
        """Each incident with one cause and one fix, the first by id."""
        f = self.facts.where("kind = 'incident'")
        f = f.where(T.holds("title", query) | T.holds("summary", query)) if query else f
        name = self.facts.select("id", "title")
        cause = self.edges.where("kind = 'caused_by'").join(name.withColumnRenamed("id", "dst"), "dst").groupBy("src").agg(F.min_by("title", "dst").alias("cause"))
        fix = self.edges.where("kind = 'resolves'").join(name.withColumnRenamed("id", "src"), "src").groupBy("dst").agg(F.min_by("title", "src").alias("fix"))
        j = f.join(cause.withColumnRenamed("src", "id"), "id", "left").join(fix.withColumnRenamed("dst", "id"), "id", "left")
        return j.select("id", "title", "cause", "fix", "updated_at").orderBy(F.desc("updated_at"), "id").limit(limit)

    def domain_model(self, entity: str | None = None, limit: int = 60) -> DataFrame:
        """Entities with the relations that leave them and the files they come from."""
        e = self.facts.where("kind = 'entity'")
        e = e.where(T.holds("title", entity)) if entity else e
        to = self.edges.join(self.facts.select(F.col("id").alias("dst"), F.col("title").alias("target")), "dst")
        rel = to.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set(F.concat_ws(" ", "kind", "target"))).alias("relations"))
        at = self.code_links.groupBy(F.col("fact_id").alias("id")).agg(F.array_sort(F.collect_set("path")).alias("files"))
        return e.join(rel, "id", "left").join(at, "id", "left").select("id", "title", "summary", "relations", "files").orderBy("title", "id").limit(limit)

    # ---- concepts ----

    def concepts_list(self, domain: str | None = None, limit: int = 30) -> DataFrame:
        c = self.concepts.where(F.col("domain") == domain) if domain else self.concepts
        return c.orderBy(F.desc("member_count"), "id").limit(limit)

    def members(self, concept_id: str) -> DataFrame:
        return self.facts.where(F.col("cluster_id") == concept_id).orderBy(F.desc("updated_at"), "id")

    def explain(self, concept_id: str) -> DataFrame:
        m = self.facts.where((F.col("cluster_id") == concept_id) & F.col("kind").isin(*SECTIONS))
        s = F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv])[F.col("kind")]
        return m.withColumn("section", s).groupBy("cluster_id").pivot("section", sorted(SECTIONS.values())).agg(F.array_sort(F.collect_list("title")))

    def link(self, concept_id: str, limit: int = 20) -> DataFrame:
        n = L.neighbours(self.links).where(F.col("id") == concept_id)
        other = self.concepts.select(F.col("id").alias("other"), "name", "project_id")
        mine = self.concepts.where(F.col("id") == concept_id).select(F.col("project_id").alias("own"))
        j = n.join(other, "other").join(F.broadcast(mine.limit(1)), F.col("project_id") != F.col("own"))
        return j.select("other", "name", "project_id", "kind", "score").orderBy(F.desc("score"), "other").limit(limit)

    # ---- projects and upkeep ----

    def skills_list(self, scope: str | None = None, cross: bool = False, limit: int = 80) -> DataFrame:
        s = self.skills.where(F.col("scope") == scope) if scope else self.skills
        s = s.where("project_count > 1") if cross else s
        return s.orderBy(F.desc("weight"), "name").limit(limit)

    def profile(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        i = self.industries.groupBy("name").agg(F.countDistinct("project_id").alias("projects"), F.avg("confidence").alias("confidence"))
        return self.projects.agg(F.countDistinct("id").alias("projects")), i.orderBy(F.desc("projects"), "name"), self.skills_list(limit=25)

    def workspace(self, project_id: str, limit: int = 15) -> tuple[DataFrame, DataFrame]:
        """Projects of the same workspace, and those most linked with it."""
        own = self.projects.where(F.col("id") == project_id).select(F.col("workspace").alias("w")).limit(1)
        sib = self.projects.join(F.broadcast(own), F.col("workspace") == F.col("w")).where(F.col("id") != project_id).select("id", "name")
        rel = L.neighbours(self.links).where(F.col("id") == project_id).groupBy("other").agg(F.sum("score").alias("weight")).orderBy(F.desc("weight"), "other").limit(limit)
        return sib.orderBy("name", "id"), rel

    def triage_audit(self, dropped: bool = False, limit: int = 50) -> DataFrame:
        lab = self.labels.where("not kept") if dropped else self.labels
        return lab.orderBy(F.desc("produced_at"), "window_id").limit(limit)

    def status(self) -> DataFrame:
        """(layer, n): rows of each table there is."""
        out = None
        for name in ("files", "nodes", "facts", "edges", "code_links", "concepts", "links", "labels", "skills", "industries", "projects", "runs"):
            t = getattr(self, name)
            if t is not None:
                row = t.agg(F.lit(name).alias("layer"), F.count("*").alias("n"))
                out = row if out is None else out.unionByName(row)
        return out

    def doctor(self, now_ms: int) -> DataFrame:
        """(check, n): facts without a concept, concepts without a summary, files to analyse, runs that failed within a day."""
        f = self.facts.agg(F.lit("unclustered").alias("check"), F.count_if(F.col("cluster_id").isNull()).alias("n"))
        c = self.concepts.agg(F.lit("no_summary").alias("check"), F.count_if(F.coalesce("summary", F.lit("")) == "").alias("n"))
        p = self.files.join(self.analysis, ["path", "content_hash"], "left_anti").agg(F.lit("pending_files").alias("check"), F.count("*").alias("n"))
        r = self.runs.agg(F.lit("failed_runs").alias("check"), F.count_if(~F.col("ok") & (F.col("produced_at") >= now_ms - 86_400_000)).alias("n"))
        return f.unionByName(c).unionByName(p).unionByName(r)
