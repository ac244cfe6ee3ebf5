"""Composite pipelines: each stage is a function of DataFrames, each boundary a stored table."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorequarry.functions import text as T
from lorequarry.operators import facts as FA
from lorequarry.operators import graph as G
from lorequarry.operators import links as L
from lorequarry.operators import windows as W
from lorequarry.plans import agents as A
from lorequarry.session import Stored
from lorequarry.sources import code as C


def ingest(spark: SparkSession, turns: DataFrame, now_ms: int, cache: DataFrame | None = None) -> dict[str, DataFrame]:
    """Turns to windows, labels and facts: segment, triage, keep, extract, gate."""
    windows = Stored(spark, W.segment(turns.withColumn("text", T.clean_turn("text"))), "windows")
    labelled, runs = A.run_agent(windows.df.withColumn("payload", F.to_json(F.struct("text"))), A.TRIAGE, cache, now_ms)
    lab = F.from_json("output", "relevance string, domain string, quality string, linkage string, activity string, confidence double")
    labels = Stored(spark, W.keep_label(labelled.select("window_id", lab.alias("l")).select("window_id", "l.*")), "labels")
    kept = windows.df.join(labels.df.where("kept").select("window_id"), "window_id", "left_semi")
    got, _ = A.run_agent(kept.withColumn("payload", F.to_json(F.struct("text"))), A.EXTRACT, None, now_ms)
    f = got.select("window_id", F.explode(F.from_json("output", "facts array<struct<kind:string,title:string,confidence:double,anchors:array<string>>>")["facts"]).alias("f"))
    facts = f.select(T.sha_id("window_id", "f.kind", "f.title").alias("id"), "window_id", "f.kind", "f.title", "f.confidence", "f.anchors")
    return {"windows": windows.df, "labels": labels.df, "runs": runs, "facts": FA.anchor_gate(facts)}


def pending_files(files: DataFrame, analysis: DataFrame) -> DataFrame:
    """Files whose content has not been analysed: anti-join on (path, hash)."""
    return files.join(analysis.select("path", "content_hash"), ["path", "content_hash"], "left_anti")


def to_analyse(files: DataFrame, profile: str, most: int = 500) -> DataFrame:
    """lean: none; standard: entry files; deep: all but tests and generated ones, at most ``most``."""
    f = files.withColumn("tier", T.file_tier("path"))
    f = {"lean": f.where("false"), "standard": f.where("tier = 1"), "deep": f.where("tier > 0")}[profile]
    return f.orderBy("tier", "path").limit(most)


def file_layers(files: DataFrame, analysis: DataFrame) -> DataFrame:
    """(path, layer): every file, with ``other`` where it has not been analysed."""
    return files.select("path").join(analysis.select("path", "layer"), "path", "left").select("path", F.coalesce("layer", F.lit("other")).alias("layer"))


def vote_layers(analysis: DataFrame) -> DataFrame:
    """Layers of files (path, dir, layer); those without one take their directory's commonest."""
    n = analysis.where("layer <> 'other'").groupBy("dir", "layer").count()
    best = n.groupBy("dir").agg(F.max_by("layer", F.struct("count", "layer")).alias("voted"))
    j = analysis.join(best, "dir", "left")
    return j.select("path", "dir", F.when(F.col("layer") == "other", F.coalesce("voted", F.lit("other"))).otherwise(F.col("layer")).alias("layer"))


def fingerprint(facts: DataFrame) -> DataFrame:
    """(fingerprint): changes when facts are added or updated, so enrichment can be skipped."""
    return facts.agg(F.sha1(F.concat_ws("|", F.count("*").cast("string"), F.coalesce(F.max("updated_at"), F.lit(0)).cast("string"))).alias("fingerprint"))


def organize(skills: DataFrame, domains: DataFrame) -> DataFrame:
    """(area, skill, weight, level, rank): skills grouped by kind, heaviest first within their area."""
    area = F.initcap(F.coalesce("kind", F.lit("general")))
    w = Window.partitionBy("area").orderBy(F.desc("weight"), "name")
    s = skills.withColumn("area", area).withColumn("level", T.level("weight", "project_count"))
    return s.select("area", F.col("name").alias("skill"), "weight", "level", (F.row_number().over(w) - 1).alias("rank"))


def activity(sessions: DataFrame, now_ms: int, recent_days: int = 30) -> DataFrame:
    """(project, total_sessions, recent_sessions, idle_days, status) from sessions(project, at)."""
    g = sessions.groupBy("project").agg(F.count("*").alias("total_sessions"), F.count_if(F.col("at") >= now_ms - recent_days * 86_400_000).alias("recent_sessions"), F.max("at").alias("last"))
    g = g.withColumn("idle_days", T.idle_days("last", now_ms))
    return g.select("project", "total_sessions", "recent_sessions", "idle_days", T.project_status("idle_days").alias("status"))


def cost_plan(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """(phase, calls, tokens, cost, seconds): calls(phase, agent, calls) times what a call of an agent takes."""
    j = calls.join(F.broadcast(prices.limit(10_000)), "agent")  # a table of settings
    tok_in, tok_out = F.col("calls") * F.col("tokens_in"), F.col("calls") * F.col("tokens_out")
    cost = (tok_in * F.col("price_in") + tok_out * F.col("price_out")) / 1e6
    return j.groupBy("phase").agg(F.sum("calls").alias("calls"), F.sum(tok_in + tok_out).alias("tokens"), F.round(F.sum(cost), 6).alias("cost"), F.sum(F.col("calls") * F.col("ms") / 1000).alias("seconds"))


def extract_routed(windows: DataFrame, labels: DataFrame, now_ms: int) -> DataFrame:
    """(id, window_id, kind, title, confidence, anchors, extractor): each kept window goes to the extractors that its label asks for."""
    to = W.routes(labels.where("kept")).join(windows.select("window_id", "text"), "window_id")
    out = None
    for name, agent in A.EXTRACTORS.items():
        rows = to.where(F.col("extractor") == name).withColumn("payload", F.to_json(F.struct("text")))
        got, _ = A.run_agent(rows, agent, None, now_ms)
        f = got.select("window_id", F.explode(F.from_json("output", "facts array<struct<kind:string,title:string,confidence:double,anchors:array<string>>>")["facts"]).alias("f"))
        f = f.select(T.sha_id(F.lit(name), "window_id", "f.kind", "f.title").alias("id"), "window_id", "f.kind", "f.title", "f.confidence", "f.anchors", F.lit(name).alias("extractor"))
        out = f if out is None else out.unionByName(f)
    return FA.anchor_gate(out)


def incidents(windows: DataFrame, labels: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """Facts and edges of the incidents in windows that are labelled as bug fixes."""
    fixes = labels.where("activity = 'bugfix'").select("window_id")
    got, _ = A.run_agent(windows.join(fixes, "window_id", "left_semi").withColumn("payload", F.to_json(F.struct("text"))), A.INCIDENT, None, now_ms)
    row = F.from_json("output", "incidents array<struct<problem:string,root_cause:string,resolution:string,evidence:string>>")["incidents"]
    return G.incident_chains(got.select("window_id", F.explode(row).alias("i")).select("window_id", "i.*"))


def classify_sources(windows: DataFrame, sessions: DataFrame, labelled: DataFrame, now_ms: int) -> DataFrame:
    """(window_id, doc_kind, topics) of windows from documents that have no source label yet."""
    docs = sessions.where("agent = 'docs'").select(F.col("id").alias("session_id")).distinct()
    todo = windows.join(docs, "session_id", "left_semi").join(labelled.select("window_id"), "window_id", "left_anti")
    got, _ = A.run_agent(todo.withColumn("payload", F.to_json(F.struct("text"))), A.DOC_KIND, None, now_ms)
    o = F.from_json("output", "doc_kind string, topics array<string>")
    return got.select("window_id", o.alias("o")).select("window_id", "o.*")


def sync(old_symbols: DataFrame, indexed: DataFrame, files: DataFrame, sources: DataFrame, full: bool = False) -> tuple[DataFrame, DataFrame]:
    """(symbols, call states) after an index run: only files(path, content_hash) that changed are read, those that are gone go."""
    todo = files if full else files.join(indexed.select("path", "content_hash"), ["path", "content_hash"], "left_anti")
    read = todo.select("path").distinct()
    fresh = C.symbols(sources.join(read, "path", "left_semi"))
    kept = old_symbols.join(read, "path", "left_anti").join(files.select("path").distinct(), "path", "left_semi")
    every = kept.unionByName(fresh)
    return every, L.resolve_calls(*C.calls(every))


def verify(facts: DataFrame, edges: DataFrame, now_ms: int, below: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """Facts without weak orphans, and edges with the verdicts on pairs of each concept."""
    kept = FA.prune(facts, edges, below)
    text = lambda c: facts.select(F.col("id").alias(c), F.concat_ws(" ", "title", "summary").alias(f"t{c}"))
    pairs = FA.pairs_to_verify(kept).join(text("a"), "a").join(text("b"), "b")
    got, _ = A.run_agent(pairs.withColumn("payload", F.to_json(F.struct(F.col("ta").alias("a"), F.col("tb").alias("b")))), A.VERIFY, None, now_ms)
    o = F.from_json("output", "verdict string, confidence double")
    new = G.verdict_edges(got.select("a", "b", o.alias("o")).select("a", "b", "o.*"))
    return kept, edges.unionByName(new).distinct()


def enrich(spark: SparkSession, sources: DataFrame, rules: DataFrame, stated: DataFrame, last: str | None = None, facts: DataFrame | None = None) -> dict[str, DataFrame] | None:
    """Entities, relations, gaps and matches with stated(id, name); None if the facts are as they were at fingerprint ``last``."""
    if last is not None and facts is not None and fingerprint(facts).collect()[0][0] == last:
        return None
    ents, rel = L.entities_from_code(*C.ddl_entities(sources))
    made = ents.where("not external").select(T.sha_id(F.lit("entity"), "name").alias("id"), "name", F.lit(0).alias("created_at"))
    return {"entities": ents, "relations": rel, "gaps": L.gaps(spark, ents, rel, rules), "matches": L.reconcile(stated, made)}


def summarize(facts: DataFrame, concepts: DataFrame, now_ms: int, titles: int = 20, stable: int = 3) -> DataFrame:
    """(id, name, summary) of concepts(id, member_count, summary) whose summary may have changed: small ones that have one are left."""
    todo = concepts.where(~((F.col("member_count") <= stable) & (F.length(F.coalesce("summary", F.lit(""))) > 0))).select("id")
    w = Window.partitionBy("cluster_id").orderBy(F.desc_nulls_last("updated_at"), "id")
    top = facts.join(todo.withColumnRenamed("id", "cluster_id"), "cluster_id", "left_semi").withColumn("k", F.row_number().over(w)).where(F.col("k") <= titles)
    per = top.groupBy(F.col("cluster_id").alias("id")).agg(F.array_sort(F.collect_list("title")).alias("titles"))
    got, _ = A.run_agent(per.withColumn("payload", F.to_json(F.struct("titles"))), A.SUMMARIZE, None, now_ms)
    o = F.from_json("output", "name string, summary string")
    return got.select("id", o.alias("o")).select("id", "o.*")


def analyse(files: DataFrame, analysis: DataFrame, profile: str, now_ms: int) -> DataFrame:
    """(path, dir, layer): files of the profile that are not analysed yet, by the file agent and their folder's vote."""
    todo = to_analyse(pending_files(files, analysis), profile)
    got, _ = A.run_agent(todo.withColumn("payload", F.to_json(F.struct("path"))), A.LAYER, None, now_ms)
    return vote_layers(got.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("dir"), F.get_json_object("output", "$.layer").alias("layer")))


def update(spark: SparkSession, turns: DataFrame, sessions: DataFrame, now_ms: int) -> dict[str, DataFrame]:
    """A project from its turns: ingest, routed facts, incidents, source kinds, and the health of the run."""
    got = ingest(spark, turns, now_ms)
    w, lab = got["windows"], got["labels"].withColumn("is_doc", F.lit(False))
    facts, edges = incidents(w, lab, now_ms)
    failed = got["runs"].agg((F.count_if(~F.col("ok")) / F.greatest(F.count("*"), F.lit(1))).alias("failed"))
    return got | {"routed": extract_routed(w, lab, now_ms), "incidents": facts, "incident_edges": edges, "sources": classify_sources(w, sessions, w.limit(0).select("window_id"), now_ms), "health": failed.select("failed", (F.col("failed") > 0.5).alias("unhealthy"))}


def register(projects: DataFrame, seen: DataFrame, now_ms: int) -> DataFrame:
    """The registry after projects(path, name) were seen: ids by path, first and last time."""
    new = seen.select(T.sha_id("path").alias("id"), "name", "path", F.lit(now_ms).cast("long").alias("registered_at"), F.lit(now_ms).cast("long").alias("last_seen_at"))
    return FA.upsert(projects.select(new.columns), new, ["id"], keep=("registered_at",))


def rebuild_global(concepts: DataFrame, keys: DataFrame, evidence: DataFrame) -> dict[str, DataFrame]:
    """All projects in one pass: same-name links, emergent links, skills."""
    return {"links": L.same_name_links(concepts), "emergent": L.emergent_links(keys), "skills": L.synthesize_skills(evidence)}
