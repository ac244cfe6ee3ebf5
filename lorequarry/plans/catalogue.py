"""The registered queries over whole tables, and the SQL each is checked with."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorequarry import schema as S
from lorequarry.functions import text as T
from lorequarry.functions import vectors as V
from lorequarry.operators import facts as FA
from lorequarry.operators import links as L
from lorequarry.operators import windows as W
from lorequarry.plans import agents as A
from lorequarry.plans import pipelines as P
from lorequarry.plans.api import Knowledge
from lorequarry.session import load
from lorequarry.sources import code as C
from lorequarry.sources import documents as D
from lorequarry.sources import transcripts as TR
from lorequarry.streaming import activity as ST

NOW = 1_746_000_000_000  # the injected clock
Query = Callable[[SparkSession, str], DataFrame]
Q: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def docs_as_facts(spark: SparkSession, d: str) -> DataFrame:
    """Documents in the shape of facts: the catalogue's stand-in for the fact store."""
    x = load(spark, d, "documents")
    src = T.strip(F.lower("source"))
    kind = F.when(src == "adr", "decision").when(src == "runbook", "process").when(src == "glossary", "entity").when(src == "postmortem", "incident").when(src == "transcript", "intent").otherwise("requirement")
    return x.select(
        F.col("doc_id").cast("string").alias("id"), kind.alias("kind"), F.col("title"), F.col("text").alias("summary"),
        (F.coalesce(F.col("n_chars"), F.lit(0)) % 100 / 100.0).alias("confidence"), F.when(F.col("doc_id") % 3 == 0, "industry").otherwise("technical").alias("scope"),
        F.when(F.col("doc_id") % 5 == 0, "model").when(F.col("doc_id") % 5 == 1, "structural").alias("grounding"),
        F.col("project_id").alias("cluster_id"), F.unix_millis("collected_at").alias("created_at"), F.unix_millis("collected_at").alias("updated_at"),
    )


FACTS = """facts AS (SELECT CAST(doc_id AS VARCHAR) AS id,
 CASE trim(lower(source)) WHEN 'adr' THEN 'decision' WHEN 'runbook' THEN 'process' WHEN 'glossary' THEN 'entity' WHEN 'postmortem' THEN 'incident' WHEN 'transcript' THEN 'intent' ELSE 'requirement' END AS kind,
 title, text AS summary, coalesce(n_chars, 0) % 100 / 100.0 AS confidence, CASE WHEN doc_id % 3 = 0 THEN 'industry' ELSE 'technical' END AS scope,
 CASE WHEN doc_id % 5 = 0 THEN 'model' WHEN doc_id % 5 = 1 THEN 'structural' END AS "grounding", project_id AS cluster_id,
 epoch_ms(collected_at) AS created_at, epoch_ms(collected_at) AS updated_at FROM documents)"""

# ---- windows ----

_WINDOWS_CTE = r"""t AS (SELECT DISTINCT id, session_id, idx, ts, coalesce(role, '') AS role, coalesce(text, '') AS text, lower(regexp_replace(coalesce(role, ''), '^\s+|\s+$', '', 'g')) AS who FROM turns WHERE session_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY idx NULLS LAST, CASE WHEN idx IS NULL THEN ts END NULLS LAST, id) AS n,
  coalesce(max(idx) OVER (PARTITION BY session_id), -1) AS top, count(idx) OVER (PARTITION BY session_id) AS given FROM t),
x AS (SELECT *, coalesce(idx, top + n - given) AS place, sum(CASE WHEN who = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY n) AS ex FROM o),
y AS (SELECT *, row_number() OVER (PARTITION BY session_id, ex ORDER BY n) AS k,
  coalesce(sum(length(text)) OVER (PARTITION BY session_id, ex ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x WHERE ex > 0),
g AS (SELECT session_id, min(place) AS start_idx, max(place) AS end_idx, count(*) AS n_turns, bool_or(who IN ('assistant', 'tool')) AS answered,
  regexp_replace(string_agg('[' || role || '] ' || text, chr(10) || chr(10) ORDER BY n), '^\s+|\s+$', '', 'g') AS text
  FROM y WHERE k <= {turns} AND before < {chars} GROUP BY session_id, ex),
w AS (SELECT substr(sha1(session_id || '|' || start_idx || '|' || end_idx || '|' || sha1(text)), 1, 16) AS window_id, session_id, start_idx, end_idx, n_turns, sha1(text) AS text_hash, text FROM g WHERE answered)"""
_WINDOWS = f"WITH {_WINDOWS_CTE} SELECT * EXCLUDE (text) FROM w"


def _turns(spark, d):
    """All turns, exact repeats as one."""
    return load(spark, d, "turns").select("id", "session_id", "idx", "role", "text", "ts").distinct()


@query(_WINDOWS.format(turns=12, chars=8000))
def segment_windows(spark, d):
    return W.segment(_turns(spark, d)).drop("text")


@query(_WINDOWS.format(turns=2, chars=150))
def segment_windows_small_caps(spark, d):
    return W.segment(_turns(spark, d), 2, 150).drop("text")


@query()
def window_briefs(spark, d):
    return W.brief(W.segment(_turns(spark, d)))


@query(r"""WITH a AS (SELECT DISTINCT id, text, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '(?is)```(?:thinking|thought).*?```', '', 'g'), '^\s+|\s+$', '', 'g'), chr(10)) AS l FROM turns),
b AS (SELECT id, text, list_filter(l, lambda x, i: i = 1 OR NOT regexp_matches(regexp_replace(x, '\s+$', ''), '^[-+]{3,}$')) AS l FROM a),
c AS (SELECT id, text, list_filter(l, lambda x, i: i = 1 OR NOT (length(regexp_replace(x, '\s+$', '')) > 20 AND regexp_replace(x, '\s+$', '') = regexp_replace(l[i - 1], '\s+$', ''))) AS l FROM b),
e AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(array_to_string(l, chr(10)), '^\s+|\s+$', '', 'g'), '^(?:I''ll |I will |Let me |Sure[,!]? |Okay[,!]? )', '', 'i'), '^\s+|\s+$', '', 'g') AS t FROM c)
SELECT id, CASE WHEN length(t) > 12000 THEN left(t, 5980) || chr(10) || chr(10) || '...[trimmed ' || (length(t) - 12000) || ' chars]...' || chr(10) || chr(10) || right(t, 5980) ELSE t END AS cleaned FROM e""")
def clean_turns(spark, d):
    return load(spark, d, "turns").select("id", "text").distinct().select("id", T.clean_turn("text").alias("cleaned"))


@query("SELECT lower(trim(role)) AS role, count(*) AS n, count(DISTINCT session_id) AS sessions, sum(length(text)) AS chars FROM turns GROUP BY 1")
def turn_role_counts(spark, d):
    return load(spark, d, "turns").groupBy(F.lower(F.trim("role")).alias("role")).agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("sessions"), F.sum(F.length("text")).alias("chars"))


@query("""SELECT session_id, max(idx) + 1 AS next_idx, max(ts) AS ended_at, min(ts) AS started_at FROM turns WHERE session_id IS NOT NULL GROUP BY session_id""")
def session_bounds(spark, d):
    return load(spark, d, "turns").where("session_id is not null").groupBy("session_id").agg((F.max("idx") + 1).alias("next_idx"), F.max("ts").alias("ended_at"), F.min("ts").alias("started_at"))


@query("""WITH l AS (SELECT DISTINCT id AS window_id, text, CASE WHEN length(text) < 20 THEN 'chitchat' WHEN length(text) % 11 = 0 THEN 'off_topic' ELSE 'on_topic' END AS relevance,
 CASE WHEN length(text) % 7 = 0 THEN 'noise' WHEN length(text) % 7 = 1 THEN 'decision_grade' ELSE 'signal' END AS quality, CASE WHEN length(text) % 13 = 0 THEN 'unrelated' ELSE 'linked' END AS linkage, length(text) % 10 / 10.0 AS confidence FROM turns WHERE text IS NOT NULL)
SELECT relevance, quality, count(*) FILTER (NOT (confidence >= 0.6 AND (quality = 'noise' OR relevance = 'off_topic' OR linkage = 'unrelated' OR (relevance = 'chitchat' AND quality <> 'decision_grade')))) AS kept, count(*) AS n FROM l GROUP BY 1, 2""")
def triage_keep_rule(spark, d):
    n = F.length("text")
    t = load(spark, d, "turns").where("text is not null").select("id", "text").distinct().select(
        F.col("id").alias("window_id"), F.when(n < 20, "chitchat").when(n % 11 == 0, "off_topic").otherwise("on_topic").alias("relevance"),
        F.when(n % 7 == 0, "noise").when(n % 7 == 1, "decision_grade").otherwise("signal").alias("quality"), F.when(n % 13 == 0, "unrelated").otherwise("linked").alias("linkage"), (n % 10 / 10.0).alias("confidence"),
    )
    return W.keep_label(t).groupBy("relevance", "quality").agg(F.count_if("kept").alias("kept"), F.count("*").alias("n"))


@query("""WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS window_id, CASE doc_id % 4 WHEN 0 THEN 'architecture' WHEN 1 THEN 'debugging' WHEN 2 THEN 'business_logic' ELSE 'meta_process' END AS domain,
 CASE WHEN doc_id % 2 = 0 THEN 'signal' ELSE 'noise' END AS quality, CASE WHEN doc_id % 5 = 0 THEN 'bugfix' WHEN doc_id % 5 = 1 THEN 'todo' END AS activity, doc_id % 10 = 0 AS is_doc FROM documents),
r AS (SELECT window_id, unnest(['decision', 'business_logic', 'requirements', 'intent', 'problem_solution']) AS extractor,
 unnest([is_doc OR (domain IN ('architecture','implementation','business_logic','debugging','devops') AND quality IN ('signal','decision_grade')) OR coalesce(activity,'') IN ('feature','planning','bugfix'),
  is_doc OR domain IN ('business_logic','architecture') OR coalesce(activity,'') IN ('feature','planning'), is_doc OR domain IN ('business_logic','architecture','meta_process') OR coalesce(activity,'') IN ('feature','planning','info_request'),
  is_doc OR domain IN ('architecture','implementation','business_logic','debugging') OR coalesce(activity,'') IN ('feature','planning','todo'), domain IN ('debugging','implementation') OR coalesce(activity,'') = 'bugfix']) AS ok FROM l)
SELECT extractor, count(*) AS n FROM r WHERE ok GROUP BY 1""")
def extractor_routes(spark, d):
    i = F.col("doc_id")
    l = load(spark, d, "documents").select(
        i.cast("string").alias("window_id"), F.when(i % 4 == 0, "architecture").when(i % 4 == 1, "debugging").when(i % 4 == 2, "business_logic").otherwise("meta_process").alias("domain"),
        F.when(i % 2 == 0, "signal").otherwise("noise").alias("quality"), F.when(i % 5 == 0, "bugfix").when(i % 5 == 1, "todo").alias("activity"), (i % 10 == 0).alias("is_doc"),
    )
    return W.routes(l).groupBy("extractor").agg(F.count("*").alias("n"))


# ---- documents and text ----


@query()
def doc_sections(spark, d):
    return D.sections(load(spark, d, "documents"))


@query(f"""WITH {FACTS} SELECT id, kind, confidence FROM facts WHERE (contains(' ' || trim(regexp_replace(lower(coalesce(title,'')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ', ' cache ') OR contains(' ' || trim(regexp_replace(strip_accents(lower(coalesce(summary,''))), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ', ' cache '))
 AND (contains(' ' || trim(regexp_replace(lower(coalesce(title,'')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ', ' index ') OR contains(' ' || trim(regexp_replace(strip_accents(lower(coalesce(summary,''))), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ', ' index '))
 AND coalesce("grounding", 'stated') NOT IN ('external', 'model') ORDER BY confidence DESC, updated_at DESC NULLS LAST, id LIMIT 20""")
def fts_recall_and(spark, d):
    return Knowledge(facts=docs_as_facts(spark, d)).recall("cache index").select("id", "kind", "confidence")


@query(f"""WITH {FACTS} SELECT id, confidence FROM facts WHERE regexp_matches(' ' || trim(regexp_replace(strip_accents(lower(coalesce(title,'') || ' . ' || coalesce(summary,''))), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ', ' (?:throttle|cursor) ')
 AND coalesce("grounding", 'stated') IN ('structural', 'corroborated', 'stated') ORDER BY confidence DESC, id LIMIT 25""")
def fts_ask_or(spark, d):
    return Knowledge(facts=docs_as_facts(spark, d)).ask("throttle cursor").select("id", "confidence")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a') ORDER BY length(p_name), p_name, p_partkey LIMIT 10")
def literal_contains_search(spark, d):
    n = load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return Knowledge(nodes=n.withColumn("kind", F.lit("part"))).search("a").select(F.col("id").alias("p_partkey"), F.col("name").alias("p_name"))


@query(f"""WITH {FACTS} SELECT id, kind FROM facts WHERE kind IN ('requirement','feature','actor','process','metric','intent') AND (contains(lower(title), 'note') OR contains(lower(summary), 'note')) ORDER BY kind, updated_at DESC NULLS LAST, id LIMIT 60""")
def requirements_search(spark, d):
    return Knowledge(facts=docs_as_facts(spark, d)).requirements("note").select("id", "kind")


@query(f"""WITH {FACTS} SELECT id, title FROM facts WHERE scope = 'industry' AND "grounding" IN ('model', 'external') ORDER BY "grounding" DESC, title NULLS FIRST, id LIMIT 40""")
def learn_list(spark, d):
    f = docs_as_facts(spark, d)
    return Knowledge(facts=f).learn().select("id", "title")


@query(r"""SELECT ticket, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\b([A-Z][A-Z0-9]{1,9})-\d+\b', 1)) AS ticket FROM (SELECT DISTINCT id, text FROM turns)) GROUP BY 1 ORDER BY n DESC, ticket LIMIT 12""")
def ticket_prefixes(spark, d):
    t = load(spark, d, "turns").select("id", "text").distinct()
    e = t.select(F.explode(F.regexp_extract_all("text", F.lit(r"\b([A-Z][A-Z0-9]{1,9})-\d+\b"), 1)).alias("ticket"))
    return e.groupBy("ticket").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ticket").limit(12)


@query(r"""SELECT doc_id, len(regexp_extract_all(text, 'https?://[^\s)>\]]+')) AS urls, len(regexp_extract_all(text, '```')) AS fences FROM documents WHERE text IS NOT NULL""")
def syntax_counts(spark, d):
    x = load(spark, d, "documents").where("text is not null")
    return x.select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"https?://[^\s)>\]]+"), 0)).alias("urls"), F.size(F.regexp_extract_all("text", F.lit("```"), 0)).alias("fences"))


@query(r"""SELECT doc_id, CASE WHEN length(n) > 3 AND suffix(n, 's') THEN n[:-2] ELSE n END AS entity FROM (SELECT doc_id, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS n FROM documents)""")
def entity_names(spark, d):
    return load(spark, d, "documents").select("doc_id", T.entity_name("title").alias("entity"))


@query("""SELECT event_type, json_extract_string(props, '$.' || k) IS NOT NULL AS has_key, count(*) AS n FROM (SELECT event_type, props, json_keys(props)[1] AS k FROM events) GROUP BY 1, 2""")
def json_props_keys(spark, d):
    e = load(spark, d, "events")
    k = F.element_at(F.json_object_keys("props"), 1)
    return e.groupBy("event_type", k.isNotNull().alias("has_key")).agg(F.count("*").alias("n"))


# ---- transcripts and code ----


@query()
def parse_transcripts(spark, d):
    return TR.parse_entries(load(spark, d, "turns").select("id", "raw"), "raw").select("id", "dialect", "entry_role", "body", "tool", "ts_ms")


@query("""SELECT count(*) AS n, count(*) FILTER (regexp_replace(raw, '\\s', '', 'g') LIKE '{"type":"message"%') AS typed FROM (SELECT DISTINCT id, raw FROM turns) WHERE json_valid(raw)""")
def transcript_dialects(spark, d):
    p = TR.parse_entries(load(spark, d, "turns").select("id", "raw").distinct(), "raw").where("try_parse_json(raw) is not null")
    return p.agg(F.count("*").alias("n"), F.count_if(F.col("dialect") == "typed").alias("typed"))


@query()
def code_symbols(spark, d):
    return C.symbols(load(spark, d, "source_files"))


@query(r"""SELECT lower(regexp_extract(path, '\.(\w+)$', 1)) AS ext, count(*) AS files, sum(length(source)) AS chars FROM source_files GROUP BY 1""")
def source_languages(spark, d):
    return load(spark, d, "source_files").groupBy(F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).alias("ext")).agg(F.count("*").alias("files"), F.sum(F.length("source")).alias("chars"))


@query(r"""SELECT tier, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(path, '/__tests__/|/__mocks__/|/fixtures?/|\.(?:test|spec)\.[cm]?[jt]sx?$|\.generated\.|/vendor/') THEN 0 WHEN regexp_matches(path, '(?:^|/)(?:index|main|app|server|cli)\.[cm]?[jt]sx?$') THEN 1 ELSE 2 END AS tier FROM files WHERE path IS NOT NULL) GROUP BY 1""")
def file_tiers(spark, d):
    return load(spark, d, "files").where("path is not null").groupBy(T.file_tier("path").alias("tier")).agg(F.count("*").alias("n"))


@query("""SELECT DISTINCT f.path, f.content_hash FROM files f WHERE NOT EXISTS (SELECT 1 FROM files g WHERE g.path = f.path AND g.content_hash = f.content_hash AND g.node_count > 10)""")
def pending_files_anti(spark, d):
    f = load(spark, d, "files")
    return P.pending_files(f.select("path", "content_hash").distinct(), f.where("node_count > 10").distinct())


@query("""WITH n AS (SELECT path, max(indexed_at) AS at FROM files GROUP BY path) SELECT f.path, max(f.size) AS size, max(f.node_count) AS node_count FROM files f JOIN n ON n.path = f.path AND n.at = f.indexed_at GROUP BY f.path""")
def newest_files(spark, d):
    f = load(spark, d, "files").groupBy("path", "indexed_at").agg(F.max("size").alias("size"), F.max("node_count").alias("node_count"))
    return f.groupBy("path").agg(F.max_by(F.struct("size", "node_count"), "indexed_at").alias("s")).select("path", "s.size", "s.node_count")


@query("""WITH p AS (SELECT DISTINCT path FROM source_files), m AS (SELECT DISTINCT regexp_extract(path, '[^/]+$') AS mention FROM p)
SELECT m.mention, min(p.path) AS path FROM m JOIN p ON suffix(p.path, '/' || m.mention) GROUP BY m.mention HAVING count(*) = 1""")
def unique_suffix_resolve(spark, d):
    p = load(spark, d, "source_files").select("path")
    return L.resolve_paths(p.select(F.regexp_extract("path", r"[^/]+$", 0).alias("mention")), p)


# ---- facts ----


@query("""WITH f AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS window_id, CASE o_orderstatus WHEN 'O' THEN 'decision' WHEN 'F' THEN 'intent' ELSE 'other' END AS kind, o_orderkey % 100 / 100.0 AS confidence, o_orderpriority LIKE '1%' AS anchored FROM orders),
g AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY confidence DESC, id) AS k FROM f WHERE confidence >= 0.45 AND (kind <> 'intent' OR anchored))
SELECT window_id, id, kind, confidence FROM g WHERE k <= 8""")
def anchor_gate_topk(spark, d):
    o = load(spark, d, "orders")
    st = F.col("o_orderstatus")
    f = o.select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("window_id"), F.when(st == "O", "decision").when(st == "F", "intent").otherwise("other").alias("kind"),
        (F.col("o_orderkey") % 100 / 100.0).alias("confidence"), F.when(F.col("o_orderpriority").startswith("1"), F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("anchors"),
    )
    return FA.anchor_gate(f).select("window_id", "id", "kind", "confidence")


@query("""WITH a AS (SELECT text, min(doc_id) AS survivor, count(*) AS n FROM documents WHERE text IS NOT NULL AND text <> '' GROUP BY text HAVING count(*) > 1) SELECT d.doc_id AS dup, a.survivor FROM documents d JOIN a ON a.text = d.text WHERE d.doc_id <> a.survivor""")
def exact_duplicate_docs(spark, d):
    x = load(spark, d, "documents").where("text is not null and text <> ''").select("doc_id", F.sha2("text", 256).alias("h"))
    g = x.groupBy("h").agg(F.min("doc_id").alias("survivor"), F.count("*").alias("n")).where("n > 1")
    return x.join(g, "h").where("doc_id <> survivor").select(F.col("doc_id").alias("dup"), "survivor")


@query("""SELECT label, max(n) AS n, list(m ORDER BY pos) AS centroid FROM (SELECT label, pos, count(*) AS n, round(avg(x), 4) AS m FROM (SELECT label, unnest(range(1, len(embedding) + 1)) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY label, pos) GROUP BY label""")
def centroid_by_label(spark, d):
    c = FA.centroids(load(spark, d, "embeddings"), "label")
    return c.select("label", "n", F.transform("centroid", lambda x: F.round(x, 4)).alias("centroid"))


@query("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0), p AS (SELECT q.vec_id AS id, e.vec_id AS other, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 5) AS cosine FROM q JOIN embeddings e ON e.vec_id <> q.vec_id)
SELECT id, other, cosine FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, other) AS k FROM p) WHERE k <= 5""")
def nearest_topk(spark, d):
    e = load(spark, d, "embeddings")
    # the stated query set against all rows; its size is that of the queries, which are counted before they are sent out
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    q = F.broadcast(q) if q.count() <= 100_000 else q
    j = e.join(q, F.col("vec_id") != F.col("id")).select("id", F.col("vec_id").alias("other"), F.round(V.cosine("embedding", "v"), 5).alias("cosine"))
    w = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
    return j.withColumn("k", F.row_number().over(w)).where("k <= 5").drop("k")


@query()
def online_concepts(spark, d):
    c = load(spark, d, "concepts_global").groupBy("id").agg(F.max_by(F.struct("project_id", "domain", "embedding"), "updated_at").alias("s"), F.max("updated_at").alias("created_at"))
    f = c.select("s.project_id", "id", F.coalesce("s.domain", F.lit("none")).alias("kind"), "created_at", "s.embedding")
    return FA.online_clusters(f)


@query("""WITH m AS (SELECT project_id AS k, lower(trim(scope)) AS scope, count(*) AS n FROM concepts_global WHERE scope IS NOT NULL GROUP BY 1, 2) SELECT k AS project_id, scope FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, scope) AS r FROM m) WHERE r = 1""")
def dominant_scope(spark, d):
    c = load(spark, d, "concepts_global").select("project_id", F.lower(F.trim("scope")).alias("scope"), F.lit(None).cast("string").alias("grounding"))
    return FA.dominant(c, "project_id").where("scope is not null").select("project_id", "scope")


@query("""WITH f AS (SELECT l_orderkey AS cluster_id, l_returnflag AS kind, l_linenumber AS id, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS pos FROM lineitem),
p AS (SELECT a.cluster_id, a.kind, a.id AS a, b.id AS b, row_number() OVER (PARTITION BY a.cluster_id, a.kind ORDER BY a.pos, b.pos) AS k FROM f a JOIN f b ON a.cluster_id = b.cluster_id AND a.kind = b.kind AND a.pos < b.pos)
SELECT cluster_id, kind, a, b FROM p WHERE k <= 5""")
def pair_cap_per_group(spark, d):
    l = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("cluster_id"), F.col("l_returnflag").alias("kind"), F.col("l_linenumber").alias("id"), F.lit(0).alias("created_at"))
    return FA.pairs_to_verify(l)


@query("""SELECT c_custkey AS id FROM customer c WHERE NOT (c_acctbal < 0 AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey))""")
def prune_orphans(spark, d):
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") < 0, 0.1).otherwise(0.9).alias("confidence"), F.lit(None).cast("string").alias("cluster_id"))
    e = load(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.lit(None).cast("bigint").alias("dst"))
    return FA.prune(c, e).select("id")


@query("""SELECT s_suppkey AS id, coalesce(n.s_name, s.s_name) AS name, CASE WHEN n.s_suppkey IS NOT NULL THEN n.s_acctbal ELSE s.s_acctbal END AS balance FROM supplier s LEFT JOIN (SELECT s_suppkey, 'new ' || s_name AS s_name, s_acctbal + 1 AS s_acctbal FROM supplier WHERE s_suppkey % 2 = 0) n USING (s_suppkey)""")
def upsert_by_key(spark, d):
    s = load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    new = s.where("id % 2 = 0").select("id", F.concat(F.lit("new "), "name").alias("name"), (F.col("balance") + 1).alias("balance"))
    return FA.upsert(s, new, ["id"], if_set=("name",))


# ---- links and graph ----


@query("""WITH c AS (SELECT id, project_id, lower(name) AS k, domain FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS r FROM concepts_global) WHERE r = 1 AND name IS NOT NULL)
SELECT a.id AS a, b.id AS b, round(0.6 + CASE WHEN a.domain = b.domain THEN 0.2 ELSE 0 END, 2) AS score FROM c a JOIN c b ON a.k = b.k AND a.project_id <> b.project_id AND a.id < b.id""")
def same_name_links(spark, d):
    c = load(spark, d, "concepts_global").groupBy("id").agg(F.max_by(F.struct("project_id", "name", "domain"), "updated_at").alias("s")).select("id", "s.*")
    return L.same_name_links(c)


@query("""WITH l AS (SELECT a, b, lower(trim(kind)) AS kind, score FROM concept_links WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b), n AS (SELECT a AS id, b AS other, kind, score FROM l UNION ALL SELECT b, a, kind, score FROM l)
SELECT id, count(DISTINCT other) AS others, round(max(score), 4) AS best FROM n GROUP BY id""")
def bidirectional_neighbours(spark, d):
    l = load(spark, d, "concept_links").select("a", "b", F.lower(F.trim("kind")).alias("kind"), "score")
    return L.neighbours(l).groupBy("id").agg(F.countDistinct("other").alias("others"), F.round(F.max("score"), 4).alias("best"))


_KEYS = """k AS (SELECT DISTINCT 'business' AS signal, lower(CAST(c_nationkey AS VARCHAR) || c_mktsegment) AS key, CAST(c_custkey % 40 AS VARCHAR) AS project_id FROM customer UNION SELECT 'skill', lower(CAST(s_nationkey AS VARCHAR)), CAST(s_suppkey % 40 AS VARCHAR) FROM supplier)"""


def _keys(spark, d):
    c, s = load(spark, d, "customer"), load(spark, d, "supplier")
    a = c.select(F.lit("business").alias("signal"), F.concat(F.col("c_nationkey").cast("string"), "c_mktsegment").alias("key"), (F.col("c_custkey") % 40).cast("string").alias("project_id"))
    return a.union(s.select(F.lit("skill"), F.col("s_nationkey").cast("string"), (F.col("s_suppkey") % 40).cast("string")))


@query(f"""WITH {_KEYS}, p AS (SELECT a.project_id AS a, b.project_id AS b, a.signal, count(*) AS n FROM k a JOIN k b ON a.signal = b.signal AND a.key = b.key AND a.project_id < b.project_id GROUP BY 1, 2, 3)
SELECT a, b, floor(sum(n * CASE signal WHEN 'business' THEN 3.0 ELSE 0.5 END) * 100 + 0.5) / 100 AS weight, string_agg(signal || '=' || n, ',' ORDER BY signal) AS signals FROM p GROUP BY a, b ORDER BY weight DESC, a, b LIMIT 5000""")
def emergent_links(spark, d):
    return L.emergent_links(_keys(spark, d))


@query("""WITH e AS (SELECT DISTINCT trim(regexp_replace(lower(p_brand), '\\s+', ' ', 'g')) AS name, p_type AS kind, l_suppkey % 7 AS project_id, l_quantity AS w FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT 'technical' AS scope, name, min(kind) AS kind, floor(sum(w) * 100 + 0.5) / 100 AS weight, count(DISTINCT project_id) AS project_count FROM e GROUP BY name""")
def skill_synthesis(spark, d):
    j = load(spark, d, "lineitem").join(load(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    e = j.select(T.skill_name("p_brand").alias("name"), F.col("p_type").alias("kind"), (F.col("l_suppkey") % 7).alias("project_id"), F.col("l_quantity").alias("weight")).distinct()
    return L.synthesize_skills(e.select(F.lit("technical").alias("scope"), "name", "kind", "project_id", "weight", F.lit("structural").alias("grounding"))).drop("grounding")


@query("""SELECT CASE WHEN w >= 12 OR p >= 4 THEN 'expert' WHEN w >= 6 OR p >= 3 THEN 'proficient' WHEN w >= 3 OR p >= 2 THEN 'competent' WHEN w >= 1 THEN 'advanced_beginner' ELSE 'novice' END AS level, count(*) AS n FROM (SELECT p_size / 4.0 AS w, p_partkey % 5 AS p FROM part) GROUP BY 1""")
def level_buckets(spark, d):
    x = load(spark, d, "part").select((F.col("p_size") / 4.0).alias("w"), (F.col("p_partkey") % 5).alias("p"))
    return x.groupBy(T.level("w", "p").alias("level")).agg(F.count("*").alias("n"))


@query("""SELECT language, least(3.0, 1 + log10(n + 1)) AS weight FROM (SELECT lower(trim(language)) AS language, count(*) AS n FROM files WHERE language IS NOT NULL GROUP BY 1) WHERE language <> 'unknown'""")
def language_weights(spark, d):
    f = load(spark, d, "files").where("language is not null").groupBy(F.lower(F.trim("language")).alias("language")).agg(F.count("*").alias("n"))
    return f.where("language <> 'unknown'").select("language", T.language_weight("n").alias("weight"))


@query("""WITH n AS (SELECT 'r' || r_regionkey AS id FROM region UNION SELECT 'n' || n_nationkey FROM nation UNION SELECT 'c' || c_custkey FROM customer WHERE c_acctbal > 0),
e AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child, 'region_nation' AS kind FROM nation UNION SELECT 'n' || c_nationkey, 'c' || c_custkey, 'nation_customer' FROM customer)
SELECT parent, child, kind FROM e WHERE parent IN (SELECT id FROM n) AND child IN (SELECT id FROM n) ORDER BY parent, child, kind LIMIT 4000""")
def hierarchy_edges(spark, d):
    r, n, c = (load(spark, d, x) for x in ("region", "nation", "customer"))
    key = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    nodes = r.select(key("r", "r_regionkey").alias("id")).union(n.select(key("n", "n_nationkey"))).union(c.where("c_acctbal > 0").select(key("c", "c_custkey")))
    edges = n.select(key("r", "n_regionkey").alias("parent"), key("n", "n_nationkey").alias("child"), F.lit("region_nation").alias("kind")).union(c.select(key("n", "c_nationkey"), key("c", "c_custkey"), F.lit("nation_customer")))
    return L.hierarchy(nodes, edges)


_DDL_SQL = r"""t AS (SELECT lower(t) AS name FROM (SELECT unnest(regexp_extract_all(regexp_replace(source, '--[^\n]*', '', 'g'), 'create\s+table\s+(?:if\s+not\s+exists\s+)?([\w.]+)', 1, 'i')) AS t FROM source_files WHERE regexp_matches(lower(path), '\.(sql|ddl)$')))"""


@query(rf"""WITH {_DDL_SQL}, e AS (SELECT DISTINCT name FROM t),
v AS (SELECT lower(s) AS src FROM (SELECT unnest(regexp_extract_all(regexp_replace(source, '--[^\n]*', '', 'g'), 'from\s+([a-z_]+)\s+as', 1, 'i')) AS s FROM source_files WHERE regexp_matches(lower(path), '\.(sql|ddl)$')))
SELECT 'external_ref' AS kind, src AS entity, count(*) AS n FROM v WHERE src NOT IN (SELECT name FROM e) GROUP BY src""")
def external_refs(spark, d):
    s = load(spark, d, "source_files").where(F.lower("path").rlike(r"\.(?:sql|ddl)$"))
    names = C.ddl_tables(load(spark, d, "source_files")).select(F.col("table_name").alias("entity")).distinct()
    v = s.select(F.explode(F.regexp_extract_all(F.regexp_replace("source", r"--[^\n]*", ""), F.lit(r"(?i)from\s+([a-z_]+)\s+as"), 1)).alias("e")).select(F.lower("e").alias("entity"))
    return v.join(names, "entity", "left_anti").groupBy("entity").agg(F.count("*").alias("n")).select(F.lit("external_ref").alias("kind"), "entity", "n")


@query("""WITH a AS (SELECT c_custkey AS id, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS k FROM customer), b AS (SELECT regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') AS k, min(s_suppkey) AS sid FROM supplier GROUP BY 1)
SELECT a.id AS stated_id, b.sid AS structural_id FROM a JOIN b ON replace(a.k, 'customer', 'supplier') = b.k""")
def reconcile_names(spark, d):
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.replace(F.lower("c_name"), F.lit("customer"), F.lit("supplier")).alias("name"))
    s = load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit(0).alias("created_at"))
    return L.reconcile(c, s)


@query("""SELECT path, calls, calls >= (SELECT quantile_disc(calls, 0.85) FROM (SELECT count(*) AS calls FROM lineitem GROUP BY l_partkey)) AS hot FROM (SELECT CAST(l_partkey AS VARCHAR) AS path, count(*) AS calls FROM lineitem GROUP BY l_partkey)""")
def fan_in_hot(spark, d):
    return L.fan_in(load(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("dst_path")))


@query("""SELECT o_custkey AS c, o_orderkey AS src, nxt AS dst FROM (SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt FROM orders) WHERE nxt IS NOT NULL""")
def ordered_successor_edges(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = load(spark, d, "orders").withColumn("dst", F.lead("o_orderkey").over(w)).where("dst is not null")
    return o.select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("src"), "dst")


@query("""SELECT user_id AS project, count(*) AS total_sessions, count(*) FILTER (epoch_ms(ts) >= 1706572800000 - 30 * 86400000::BIGINT) AS recent_sessions,
 greatest(0, floor((1706572800000 - max(epoch_ms(ts))) / 86400000.0 + 0.5))::BIGINT AS idle_days, CASE WHEN greatest(0, floor((1706572800000 - max(epoch_ms(ts))) / 86400000.0 + 0.5)) <= 90 THEN 'active' ELSE 'archived' END AS status FROM events GROUP BY user_id""")
def activity_recency(spark, d):
    e = load(spark, d, "events").select(F.col("user_id").alias("project"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    return P.activity(e, 1_706_572_800_000)


@query("""SELECT lower(c.name) AS name, count(DISTINCT c.project_id) AS projects, min(c.summary) AS summary FROM concepts_global c JOIN projects p ON p.id = c.project_id WHERE c.name IS NOT NULL GROUP BY 1 HAVING count(DISTINCT c.project_id) > 1""")
def concept_spread(spark, d):
    c = load(spark, d, "concepts_global").where("name is not null")
    p = load(spark, d, "projects").select(F.col("id").alias("project_id"))
    j = c.join(p, "project_id", "left_semi")
    return j.groupBy(F.lower("name").alias("name")).agg(F.countDistinct("project_id").alias("projects"), F.min("summary").alias("summary")).where("projects > 1")


@query("""SELECT agent, count(DISTINCT s.id) AS sessions, count(DISTINCT t.id) AS turns FROM (SELECT DISTINCT id, agent FROM sessions) s JOIN turns t ON t.session_id = s.id GROUP BY agent""")
def agent_volume(spark, d):
    s = load(spark, d, "sessions").select(F.col("id").alias("session_id"), "agent").distinct()
    return load(spark, d, "turns").select("session_id", "id").join(s, "session_id").groupBy("agent").agg(F.countDistinct("session_id").alias("sessions"), F.countDistinct("id").alias("turns"))


@query("""WITH p AS (SELECT DISTINCT id, path, regexp_replace(regexp_replace(path, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM projects), s AS (SELECT DISTINCT id, source_path FROM sessions)
SELECT p.id AS project_id, count(*) AS sessions FROM p JOIN s ON contains(regexp_replace(s.source_path, '[^A-Za-z0-9]+', '-', 'g'), p.slug) GROUP BY p.id""")
def workspace_discovery(spark, d):
    p = load(spark, d, "projects").select(F.col("id").alias("project_id"), TR.project_slug("path").alias("slug")).distinct()
    s = load(spark, d, "sessions").select("id", F.regexp_replace("source_path", "[^A-Za-z0-9]+", "-").alias("at")).distinct()
    p = F.broadcast(p) if p.count() <= 10_000 else p  # a fixed table
    return s.join(p, F.contains("at", F.col("slug"))).groupBy("project_id").agg(F.count("*").alias("sessions"))


@query("""SELECT phase, sum(calls) AS calls, sum(calls * (2600 + 2500)) AS tokens, round(sum((calls * 2600 * 0.5 + calls * 2500 * 1.5) / 1e6), 6) AS cost FROM (SELECT event_type AS phase, count(*) AS calls FROM events GROUP BY 1) GROUP BY phase""")
def cost_plan_phases(spark, d):
    c = load(spark, d, "events").groupBy(F.col("event_type").alias("phase")).agg(F.count("*").alias("calls")).withColumn("agent", F.lit("triage"))
    p = spark.createDataFrame([("triage", 2600, 2500, 9000, 0.5, 1.5)], "agent string, tokens_in long, tokens_out long, ms long, price_in double, price_out double")
    return P.cost_plan(c, p).drop("seconds")


@query()
def triage_agent(spark, d):
    w = W.segment(_turns(spark, d)).withColumn("payload", F.to_json(F.struct("text")))
    r, _ = A.run_agent(w, A.TRIAGE, None, NOW)
    return r.select("window_id", "ok", F.get_json_object("output", "$.domain").alias("domain"), F.get_json_object("output", "$.quality").alias("quality"))


@query()
def ingest_facts(spark, d):
    return P.ingest(spark, _turns(spark, d), NOW)["facts"]


@query("""SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS events FROM (SELECT *, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL)) GROUP BY user_id, g""")
def session_activity(spark, d):
    e = load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    a = ST.session_activity(e)
    return a.select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), F.col("ended").cast("timestamp_ntz").alias("ended"), "events")


@query("""SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2""")
def hourly_stream(spark, d):
    """Tumbling windows through the streaming engine, drained; the result is that of the batch."""
    p = f"{d}/events.parquet"
    schema = load(spark, d, "events").schema
    import os

    folder, glob = (p, "*.parquet") if os.path.isdir(p) else (d, "events.parquet")
    s = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    # the table is in no order and a watermark over all of it would never close: the drained state comes out complete
    out = ST.hourly_complete(spark, s)
    return out.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 3).alias("total"))


def queries() -> dict[str, Query]:
    from lorequarry.plans import catalogue_store  # noqa: F401  registers its queries

    return dict(Q)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
