"""Registered queries of the knowledge store: the graph, vectors, data sets and roll-ups."""
from __future__ import annotations

from pyspark.sql import functions as F

from lorequarry.functions import syntax as SX
from lorequarry.functions import text as T
from lorequarry.operators import facts as FA
from lorequarry.operators import graph as G
from lorequarry.operators import links as L
from lorequarry.operators import similar as SM
from lorequarry.operators import windows as W
from lorequarry.plans import datasets as DS
from lorequarry.plans import pipelines as P
from lorequarry.plans.api import Knowledge
from lorequarry.plans.catalogue import _WINDOWS_CTE, FACTS, NOW, _turns, docs_as_facts, query
from lorequarry.session import load
from lorequarry.sources import code as C

WINDOWS = _WINDOWS_CTE.format(turns=12, chars=8000)
CONCEPTS = """n AS (SELECT id, project_id, name, summary, domain, scope, embedding, updated_at FROM concepts_global WHERE id IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) = 1)"""
LINKS = """l AS (SELECT DISTINCT a, b, replace(lower(regexp_replace(kind, '^\\s+|\\s+$', '', 'g')), '-', '_') AS kind, score FROM concept_links WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b)"""
VECTORS = """v AS (SELECT *, CAST(embedding AS DOUBLE[]) AS e FROM n WHERE len(embedding) = 64 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0)"""


def concepts(spark, d):
    """The newest row of each concept."""
    cols = ["project_id", "name", "summary", "domain", "scope", "embedding", "updated_at"]
    return load(spark, d, "concepts_global").where("id is not null").groupBy("id").agg(F.max_by(F.struct(*cols), F.coalesce("updated_at", F.lit(-1))).alias("s")).select("id", "s.*")


def links(spark, d):
    """Concept links with clean kinds, without loops, null ends and repeats."""
    kind = F.translate(F.lower(T.strip("kind")), "-", "_")
    return load(spark, d, "concept_links").where("a is not null and b is not null and a <> b").select("a", "b", kind.alias("kind"), "score").distinct()


def vectors(spark, d):
    """Concepts whose vector can be compared."""
    return concepts(spark, d).where(F.size("embedding") == 64).where("exists(embedding, x -> x <> 0)")


# ---- artifacts ----

_PROSE = r"""p AS (SELECT window_id, text, regexp_replace(text, '```[a-zA-Z0-9_+\-]*\n(?:[^`]|`[^`]|``[^`])*?```', ' ', 'g') AS prose FROM w)"""


@query(rf"""WITH {WINDOWS}, {_PROSE}
SELECT kind, count(*) AS n, count(DISTINCT window_id) AS windows FROM (
 SELECT window_id, 'code_block' AS kind, unnest(regexp_extract_all(text, '```[a-zA-Z0-9_+\-]*\n(?:[^`]|`[^`]|``[^`])*?```')) AS x FROM p
 UNION ALL SELECT window_id, 'url', unnest(regexp_extract_all(prose, '\bhttps?://[^\s)>\]]+')) FROM p
 UNION ALL SELECT window_id, 'ticket_id', unnest(list_distinct(regexp_extract_all(prose, '\b[A-Z][A-Z0-9]{{1,9}}-\d+\b'))) FROM p
 UNION ALL SELECT window_id, 'error_message', unnest(regexp_extract_all(text, '(?m)^[A-Z][A-Za-z]+(?:Error|Exception|Warning|Failure)(?::[\s].*)?$')) FROM p) GROUP BY kind""")
def syntax_artifacts(spark, d):
    a = SX.artifacts(W.segment(_turns(spark, d))).where(F.col("kind").isin("code_block", "url", "ticket_id", "error_message"))
    return a.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("window_id").alias("windows"))


@query()
def syntax_spans(spark, d):
    return SX.artifacts(W.segment(_turns(spark, d)))


@query(rf"""WITH {WINDOWS}, {_PROSE}, a AS (SELECT window_id, unnest(list_distinct(regexp_extract_all(prose, '\b[A-Z][A-Z0-9]{{1,9}}-\d+\b'))) AS x FROM p), s AS (SELECT DISTINCT id, agent FROM sessions)
SELECT agent, count(*) AS tickets, count(DISTINCT w.session_id) AS sessions FROM a JOIN w USING (window_id) JOIN s ON s.id = w.session_id GROUP BY agent""")
def artifact_agents(spark, d):
    w = W.segment(_turns(spark, d))
    a = SX.artifacts(w).where("kind = 'ticket_id'").select(F.col("id").alias("fact_id"), "window_id")
    o = G.first_windows(a, w, load(spark, d, "sessions")).where("agent is not null")
    return o.groupBy("agent").agg(F.count("*").alias("tickets"), F.countDistinct("session_id").alias("sessions"))


@query(rf"""WITH {WINDOWS}, {_PROSE}, a AS (SELECT window_id, unnest(list_distinct(regexp_extract_all(prose, '\b[A-Z][A-Z0-9]{{1,9}}-\d+\b'))) AS x FROM p), s AS (SELECT DISTINCT id, agent FROM sessions)
SELECT x AS fact_id, count(DISTINCT w.session_id) AS sources, bool_or(agent = 'docs') AND bool_or(agent <> 'docs') AS corroborated FROM a JOIN w USING (window_id) JOIN s ON s.id = w.session_id GROUP BY x""")
def corroborated_tickets(spark, d):
    w = W.segment(_turns(spark, d))
    a = SX.artifacts(w).where("kind = 'ticket_id'").select(F.col("summary").alias("fact_id"), "window_id").distinct()
    return G.spread(a, w, load(spark, d, "sessions"))


@query(f"""WITH {WINDOWS} SELECT w.window_id, left(text, 600) AS excerpt, start_idx FROM w JOIN (SELECT DISTINCT id, ended_at FROM sessions WHERE ended_at IS NULL) s ON s.id = w.session_id""")
def audit_excerpts(spark, d):
    w = W.segment(_turns(spark, d))
    open_ = load(spark, d, "sessions").where("ended_at is null").select(F.col("id").alias("session_id")).distinct()
    labels = w.join(open_, "session_id", "left_semi").select("window_id")
    return DS.triage_audit(labels, w).select("window_id", "excerpt", "start_idx")


@query(f"""WITH {WINDOWS} SELECT window_id FROM w WHERE session_id NOT IN (SELECT id FROM sessions WHERE ended_at IS NOT NULL AND id IS NOT NULL)""")
def untriaged_windows(spark, d):
    w = W.segment(_turns(spark, d))
    done = load(spark, d, "sessions").where("ended_at is not null").select(F.col("id").alias("session_id")).distinct()
    return W.untriaged(w, w.join(done, "session_id", "left_semi").select("window_id")).select("window_id")


@query(rf"""WITH {WINDOWS}, b AS (SELECT window_id, list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0) AS l FROM w)
SELECT window_id, left(l[1], 280) AS opening, left(l[-1], 400) AS closing, list_transform(list_filter(l, lambda x: regexp_matches(x, '^(?:>|- )'))[1:8], lambda x: left(x, 400)) AS quotes FROM b""")
def brief_ends(spark, d):
    return W.brief(W.segment(_turns(spark, d))).select("window_id", "opening", "closing", "quotes")


@query()
def serialized_briefs(spark, d):
    return W.serialize(W.brief(W.segment(_turns(spark, d))))


@query("""WITH b AS (SELECT session_id, sum(length(raw)) AS bytes FROM (SELECT DISTINCT id, session_id, raw FROM turns) GROUP BY 1),
s AS (SELECT id, arg_min(agent, ingested_at) AS agent, arg_min(started_at, ingested_at) AS started_at, min(ingested_at) AS ingested_at FROM sessions WHERE id IS NOT NULL GROUP BY id)
SELECT s.id, agent FROM s JOIN b ON b.session_id = s.id WHERE bytes >= 256 AND coalesce(started_at, ingested_at) >= 1746000000000 - 365::BIGINT * 86400000 AND coalesce(agent, '') NOT IN ('docs') ORDER BY ingested_at NULLS LAST, s.id LIMIT 200""")
def ingestible_sessions(spark, d):
    b = load(spark, d, "turns").select("id", "session_id", "raw").distinct().groupBy(F.col("session_id").alias("id")).agg(F.sum(F.length("raw")).alias("bytes"))
    s = load(spark, d, "sessions").where("id is not null").groupBy("id").agg(F.min_by("agent", "ingested_at").alias("agent"), F.min_by("started_at", "ingested_at").alias("started_at"), F.min("ingested_at").alias("ingested_at"))
    return W.ingestible(s.join(b, "id"), NOW, ("docs",)).select("id", "agent")


# ---- vectors ----


@query(f"""WITH {CONCEPTS}, {VECTORS}, p AS (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.e, b.e), 6) AS cosine FROM v a JOIN v b ON a.id < b.id AND a.project_id <> b.project_id)
SELECT a, b, cosine FROM p WHERE cosine >= 0.78 ORDER BY cosine DESC, a, b LIMIT 200""")
def semantic_pairs(spark, d):
    return SM.semantic_pairs(spark, vectors(spark, d))


@query(f"""WITH {CONCEPTS}, {VECTORS}, p AS (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.e, b.e), 6) AS c FROM v a JOIN v b ON a.id < b.id AND a.project_id <> b.project_id),
q AS (SELECT * FROM p WHERE c >= 0.78 ORDER BY c DESC, a, b LIMIT 200)
SELECT a, b, CASE WHEN c >= 0.92 THEN 'same_as' ELSE 'variant_of' END AS kind, round(c * round(c, 2), 6) AS score FROM q""")
def semantic_links(spark, d):
    from lorequarry.plans import agents as A

    p = SM.semantic_pairs(spark, vectors(spark, d))
    r, _ = A.run_agent(p.withColumn("payload", F.to_json(F.struct("cosine"))), A.LINK, None, NOW)
    j = r.select("a", "b", "cosine", F.get_json_object("output", "$.relation").alias("relation"), F.get_json_object("output", "$.confidence").cast("double").alias("confidence"))
    return SM.semantic_links(j)


_CUT = 1_738_000_000_000


@query(f"""WITH {CONCEPTS}, {VECTORS}, p AS (SELECT a.id, b.id AS dup_of, round(list_cosine_similarity(a.e, b.e), 6) AS c FROM v a JOIN v b ON a.updated_at >= {_CUT} AND b.updated_at < {_CUT} WHERE list_cosine_similarity(a.e, b.e) >= 0.92)
SELECT id, dup_of, c AS cosine FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY c DESC, dup_of) = 1""")
def prior_duplicates(spark, d):
    c = vectors(spark, d)
    return SM.prior_duplicates(spark, c.where(F.col("updated_at") >= _CUT), c.where(F.col("updated_at") < _CUT))


_LEADERS = """adj AS (SELECT i.id, list(x.a) FILTER (x.a IS NOT NULL) AS adj FROM i LEFT JOIN x ON x.b = i.id GROUP BY i.id),
o AS (SELECT i.id, row_number() OVER (ORDER BY i.t, i.id) AS pos, coalesce(adj, []) AS adj FROM i JOIN adj USING (id)),
r(n, leaders) AS (SELECT 0, CAST([] AS {kind}[]) UNION ALL SELECT n + 1, CASE WHEN list_has_any(leaders, o.adj) THEN leaders ELSE list_append(leaders, o.id) END FROM r JOIN o ON o.pos = n + 1),
z AS (SELECT leaders FROM r ORDER BY n DESC LIMIT 1)"""


@query(f"""WITH RECURSIVE {CONCEPTS}, {VECTORS}, new AS (SELECT id, updated_at AS t, e FROM v WHERE updated_at >= {_CUT}), old AS (SELECT id, e FROM v WHERE updated_at < {_CUT}),
prior AS (SELECT a.id, b.id AS dup_of FROM new a JOIN old b ON list_cosine_similarity(a.e, b.e) >= 0.92 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.e, b.e), 6) DESC, b.id) = 1),
i AS (SELECT id, t, e FROM new WHERE id NOT IN (SELECT id FROM prior)),
x AS (SELECT a.id AS a, b.id AS b FROM i a JOIN i b ON (a.t < b.t OR (a.t = b.t AND a.id < b.id)) AND list_cosine_similarity(a.e, b.e) >= 0.92),
{_LEADERS.format(kind='VARCHAR')}
SELECT id, 'prior' AS state, dup_of FROM prior UNION ALL
SELECT i.id, CASE WHEN list_contains(z.leaders, i.id) THEN 'kept' ELSE 'batch' END,
 CASE WHEN NOT list_contains(z.leaders, i.id) THEN (SELECT x.a FROM x JOIN i k ON k.id = x.a WHERE x.b = i.id AND list_contains(z.leaders, x.a) ORDER BY k.t, k.id LIMIT 1) END FROM i, z""")
def window_dedupe(spark, d):
    c = vectors(spark, d).withColumn("created_at", F.col("updated_at"))
    return SM.dedupe_windows(spark, c.where(F.col("updated_at") >= _CUT), c.where(F.col("updated_at") < _CUT))


@query(f"""WITH RECURSIVE i AS (SELECT vec_id AS id, 0 AS t, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
x AS (SELECT a.id AS a, b.id AS b FROM i a JOIN i b ON a.label = b.label AND a.id < b.id AND list_cosine_similarity(a.e, b.e) >= 0.35),
{_LEADERS.format(kind='BIGINT')}
SELECT i.id, CASE WHEN list_contains(z.leaders, i.id) THEN i.id ELSE (SELECT min(x.a) FROM x WHERE x.b = i.id AND list_contains(z.leaders, x.a)) END AS leader FROM i, z""")
def leader_dedupe(spark, d):
    e = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.lit(0).alias("created_at"), "embedding")
    return FA.leaders(spark, e, SM.near_pairs(spark, e, 0.35, "label").select("a", "b"))


@query("""SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.4""")
def similar_edges_by_label(spark, d):
    return SM.near_pairs(spark, load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding"), 0.4, "label").select("a", "b")


@query(f"""WITH {CONCEPTS}, {VECTORS} SELECT coalesce(domain, 'none') AS domain, count(*) AS n, round(avg(sqrt(list_dot_product(e, e))), 4) AS norm FROM v GROUP BY 1""")
def vectors_by_domain(spark, d):
    from lorequarry.functions import vectors as V

    c = vectors(spark, d)
    return c.groupBy(F.coalesce("domain", F.lit("none")).alias("domain")).agg(F.count("*").alias("n"), F.round(F.avg(V.norm("embedding")), 4).alias("norm"))


# ---- groups and relations ----


@query(f"""WITH RECURSIVE {CONCEPTS}, {LINKS}, j AS (SELECT DISTINCT least(x.project_id, y.project_id) AS a, greatest(x.project_id, y.project_id) AS b, least(l.a, l.b) AS u, greatest(l.a, l.b) AS v FROM l JOIN n x ON x.id = l.a JOIN n y ON y.id = l.b WHERE x.project_id <> y.project_id),
w AS (SELECT a, b FROM j GROUP BY a, b HAVING count(*) >= 2), s AS (SELECT a AS x, b AS y FROM w UNION SELECT b, a FROM w), r(x, y) AS (SELECT x, x FROM s UNION SELECT r.x, s.y FROM r JOIN s ON s.x = r.y)
SELECT min(y) AS group_id, x AS member FROM r GROUP BY x""")
def suggested_groups(spark, d):
    return G.suggested_groups(spark, G.project_links(links(spark, d), concepts(spark, d)))


@query(f"""WITH {CONCEPTS}, {LINKS}, m AS (SELECT a AS id, b AS other, score FROM l UNION ALL SELECT b, a, score FROM l)
SELECT m.id, x.name, count(DISTINCT other) AS others, round(max(score), 4) AS best FROM m JOIN n x ON x.id = m.id JOIN n y ON y.id = m.other WHERE x.project_id <> y.project_id GROUP BY m.id, x.name""")
def cross_project_view(spark, d):
    return DS.cross_project(concepts(spark, d), links(spark, d)).withColumn("best", F.round("best", 4))


@query(f"""WITH {CONCEPTS}, {LINKS}, f AS (SELECT id, kind, title FROM (SELECT id, CASE WHEN scope = 'industry' THEN 'business_domain' WHEN scope = 'technical' THEN 'tech_domain' ELSE 'entity' END AS kind, name AS title, updated_at FROM n)
 ORDER BY CASE kind WHEN 'business_domain' THEN 0 WHEN 'tech_domain' THEN 1 ELSE 2 END, coalesce(updated_at, 0) DESC, id LIMIT 1500)
SELECT a AS source, b AS target, kind FROM (SELECT DISTINCT a, b, CASE WHEN kind = 'same_as' THEN 'relates_to' ELSE kind END AS kind FROM l) WHERE kind IN ('part_of', 'relates_to', 'depends_on') AND a IN (SELECT id FROM f) AND b IN (SELECT id FROM f) ORDER BY a, b, kind LIMIT 3000""")
def knowledge_graph_edges(spark, d):
    kind = F.when(F.col("scope") == "industry", "business_domain").when(F.col("scope") == "technical", "tech_domain").otherwise("entity")
    f = concepts(spark, d).select("id", kind.alias("kind"), F.col("name").alias("title"), "updated_at", F.lit(None).cast("string").alias("cluster_id"))
    e = links(spark, d).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.when(F.col("kind") == "same_as", "relates_to").otherwise(F.col("kind")).alias("kind"))
    none = f.limit(0).select("id", F.col("title").alias("name"), F.lit(0).alias("member_count"))
    return G.knowledge_graph(f, e, none)[1]


@query(f"""WITH {CONCEPTS}, lv AS (SELECT DISTINCT project_id, 0 AS level, coalesce(scope, 'none') AS name FROM n UNION SELECT project_id, 1, domain FROM n WHERE domain IS NOT NULL UNION SELECT project_id, 2, project_id FROM n)
SELECT DISTINCT a.name AS parent, b.name AS child, a.level || '-' || b.level AS kind FROM lv a JOIN lv b ON a.project_id = b.project_id AND a.level + 1 = b.level""")
def level_edges(spark, d):
    c = concepts(spark, d)
    row = lambda k, x: c.select("project_id", F.lit(k).alias("level"), x.alias("name"))
    return G.level_edges(row(0, F.coalesce("scope", F.lit("none"))).unionByName(row(1, F.col("domain"))).unionByName(row(2, F.col("project_id"))))


_STMT = r"""st AS (SELECT unnest(string_split(regexp_replace(source, '--[^\n]*|/\*(?:[^*]|\*+[^*/])*\*+/|''(?:[^'']|'''')*''', ' ', 'g'), ';')) AS s FROM source_files WHERE regexp_matches(lower(path), '\.(?:sql|ddl)$')),
tb AS (SELECT lower(regexp_replace(replace(replace(regexp_extract(s, '(?i)^\s*create\s+(?:or\s+replace\s+)?(?:(?:temp|temporary|unlogged|materialized)\s+)*(?:table|view)\s+(?:if\s+not\s+exists\s+)?([\w."`]+)', 1), '"', ''), '`', ''), '^.*\.', '')) AS name, regexp_matches(s, '(?i)^\s*create\s+(?:or\s+replace\s+)?(?:(?:temp|temporary|materialized)\s+)*view\s') AS view, s FROM st),
ta AS (SELECT name, view, s FROM tb WHERE name <> ''),
fk AS (SELECT name AS src, lower(regexp_replace(unnest(regexp_extract_all(s, CASE WHEN view THEN '(?i)\b(?:from|join)\s+([\w.]+)' ELSE '(?i)\breferences\s+([\w.]+)' END, 1)), '^.*\.', '')) AS dst FROM ta)"""


@query(rf"""WITH {_STMT} SELECT name, bool_and(stub) AS external FROM (SELECT name, false AS stub FROM ta UNION ALL SELECT dst, true FROM fk) GROUP BY name""")
def code_entities(spark, d):
    return L.entities_from_code(*C.ddl_entities(load(spark, d, "source_files")))[0]


@query(rf"""WITH {_STMT} SELECT DISTINCT src, dst FROM fk WHERE src <> dst""")
def owned_relations(spark, d):
    x = C.ddl(load(spark, d, "source_files"))
    keys = x.where("kind in ('foreign_key', 'reads')").select(F.col("name").alias("source"), F.col("of").alias("target"))
    fields = x.where("kind = 'column'").select(F.concat_ws(".", "of", "name").alias("child"), F.col("of").alias("parent"))
    tables, _ = C.ddl_entities(load(spark, d, "source_files"))
    return G.owned_relations(keys, fields, tables.select(F.col("name").alias("node"), F.col("name").alias("entity")).distinct())


@query(rf"""WITH {_STMT}, e AS (SELECT name, bool_and(stub) AS external FROM (SELECT name, false AS stub FROM ta UNION ALL SELECT dst, true FROM fk) GROUP BY name), rl AS (SELECT DISTINCT src, dst FROM fk),
rule AS (SELECT lower(coalesce(text, '')) AS t FROM documents WHERE trim(lower(source)) IN ('adr', 'runbook', 'glossary')),
c AS (SELECT DISTINCT x FROM (SELECT src AS x FROM rl UNION SELECT dst FROM rl) JOIN e ON e.name = x AND NOT external)
SELECT 'external_ref' AS kind, dst AS entity, string_agg(DISTINCT src, ', ' ORDER BY src) AS detail FROM rl JOIN e ON e.name = dst AND external GROUP BY dst
UNION ALL SELECT 'ungoverned', x, '' FROM c WHERE NOT EXISTS (SELECT 1 FROM rule WHERE contains(t, x))""")
def domain_gaps(spark, d):
    ents, rel = L.entities_from_code(*C.ddl_entities(load(spark, d, "source_files")))
    rules = load(spark, d, "documents").where(F.trim(F.lower("source")).isin("adr", "runbook", "glossary")).select("text")
    return L.gaps(spark, ents, rel, rules)


@query("""WITH nm AS (SELECT DISTINCT lower(name) AS name FROM concepts_global WHERE name <> ''), tx AS (SELECT DISTINCT lower(text) AS t FROM documents WHERE trim(lower(source)) IN ('adr', 'postmortem', 'glossary', 'runbook') AND text IS NOT NULL)
SELECT name FROM nm WHERE EXISTS (SELECT 1 FROM tx WHERE contains(t, name))""")
def mentioned_names(spark, d):
    x = load(spark, d, "documents").where(F.trim(F.lower("source")).isin("adr", "postmortem", "glossary", "runbook"))
    return L.mentioned(spark, load(spark, d, "concepts_global").select(F.lower("name").alias("name")), x)


@query(f"""WITH {FACTS} SELECT title, min(id) AS id FROM (SELECT t.title, f.id FROM (SELECT DISTINCT title FROM documents WHERE title IS NOT NULL AND trim(lower(source)) = 'readme') t JOIN facts f ON lower(f.title) = lower(t.title)) GROUP BY title""")
def ids_by_title(spark, d):
    t = load(spark, d, "documents").where((F.trim(F.lower("source")) == "readme") & F.col("title").isNotNull()).select("title")
    return G.ids_by_title(docs_as_facts(spark, d), t)


@query("""WITH d AS (SELECT doc_id, title, text, CASE WHEN doc_id % 2 = 0 THEN substr(text, 3, 15) ELSE title END AS evidence FROM documents)
SELECT d.doc_id AS text_id, d.evidence FROM d WHERE length(d.title) > 0 AND length(d.evidence) > 0 AND contains(lower(d.text), lower(d.evidence)) AND lower(d.title) IN (SELECT lower(title) FROM documents WHERE trim(lower(source)) IN ('design_note', 'adr'))""")
def claims_with_evidence(spark, d):
    x = load(spark, d, "documents")
    known = x.where(F.trim(F.lower("source")).isin("design_note", "adr")).select("title")
    claims = x.where(F.length("title") > 0).select(F.col("title").alias("src"), F.col("title").alias("dst"), F.when(F.col("doc_id") % 2 == 0, F.substring("text", 3, 15)).otherwise(F.col("title")).alias("evidence"), F.col("doc_id").alias("text_id"))
    return G.with_evidence(claims, known, x.select(F.col("doc_id").alias("text_id"), "text")).select("text_id", "evidence")


@query(r"""WITH p AS (SELECT DISTINCT id, path, NULL AS configured, CASE WHEN length(id) % 2 = 0 THEN NULL END AS remote, regexp_extract(regexp_replace(path, '/+$', ''), '([^/]+)/[^/]+$', 1) AS parent FROM projects)
SELECT id AS project_id, 'ws:' || substr(sha1(lower(parent)), 1, 16) AS workspace_id, parent AS name, 'path' AS source, 0.4 AS confidence FROM p WHERE parent <> '' AND lower(parent) NOT IN ('workspace', 'workspaces', 'projects', 'project', 'repos', 'repositories', 'code', 'src', 'dev', 'work', 'documents', 'desktop', 'git', 'github', 'sites')""")
def workspaces_by_path(spark, d):
    p = load(spark, d, "projects").select("id", "path", F.lit(None).cast("string").alias("configured"), F.lit(None).cast("string").alias("remote"))
    return G.workspaces(p)


@query(r"""WITH r AS (SELECT id, CASE WHEN id < '8' THEN 'git@host.example:' || name || '/core.git' ELSE 'https://host.example/' || name || '/core' END AS remote, CASE WHEN id < '2' THEN '  Umbrella ' END AS configured FROM (SELECT DISTINCT id, name FROM projects))
SELECT id AS project_id, 'ws:' || substr(sha1(lower(w)), 1, 16) AS workspace_id, w AS name, CASE WHEN configured IS NOT NULL THEN 'config' ELSE 'git-org' END AS source, CASE WHEN configured IS NOT NULL THEN 1.0 ELSE 0.8 END AS confidence FROM (SELECT *, coalesce(trim(configured), regexp_extract(remote, '[:/]([^/:]+)/core', 1)) AS w FROM r)""")
def workspaces_by_remote(spark, d):
    p = load(spark, d, "projects").select("id", "name", "path").distinct()
    remote = F.when(F.col("id") < "8", F.concat(F.lit("git@host.example:"), "name", F.lit("/core.git"))).otherwise(F.concat(F.lit("https://host.example/"), "name", F.lit("/core")))
    return G.workspaces(p.select("id", "path", F.when(F.col("id") < "2", "  Umbrella ").alias("configured"), remote.alias("remote")))


@query(r"""WITH a AS (SELECT DISTINCT path, regexp_replace(path, '/[^/]*$', '') AS dir, lower(trim(language)) AS layer FROM files WHERE path IS NOT NULL AND language IS NOT NULL), c AS (SELECT dir, layer, count(*) AS files FROM a GROUP BY 1, 2)
SELECT dir, layer, files, total FROM (SELECT *, sum(files) OVER (PARTITION BY dir) AS total, row_number() OVER (PARTITION BY dir ORDER BY files DESC, layer) AS k FROM c) WHERE k = 1 ORDER BY total DESC, dir LIMIT 30""")
def folder_layers(spark, d):
    f = load(spark, d, "files").where("path is not null and language is not null").select("path", F.regexp_replace("path", "/[^/]*$", "").alias("dir"), F.lower(F.trim("language")).alias("layer")).distinct()
    return G.folder_layers(f)


@query("""SELECT counter, sum(n) AS n FROM (SELECT event_type AS counter, 10 AS n FROM (SELECT DISTINCT event_type FROM events) UNION ALL SELECT event_type, count(*) FROM events GROUP BY 1) GROUP BY counter""")
def audit_counters(spark, d):
    e = load(spark, d, "events").groupBy(F.col("event_type").alias("counter")).agg(F.count("*").alias("n"))
    return G.count_up(e.select("counter", F.lit(10).cast("long").alias("n")), e)


# ---- the store's queries ----


@query("""WITH m AS (SELECT DISTINCT a, b, replace(lower(trim(kind)), '-', '_') AS kind FROM concept_links WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b), s AS (SELECT a AS dup, min(b) AS survivor FROM m WHERE kind = 'supersedes' GROUP BY a)
SELECT DISTINCT coalesce(x.survivor, m.a) AS src, coalesce(y.survivor, m.b) AS dst, m.kind FROM m LEFT JOIN s x ON x.dup = m.a LEFT JOIN s y ON y.dup = m.b WHERE coalesce(x.survivor, m.a) <> coalesce(y.survivor, m.b)""")
def redirect_edges(spark, d):
    l = links(spark, d)
    m = l.where("kind = 'supersedes'").groupBy(F.col("a").alias("dup")).agg(F.min("b").alias("survivor"))
    return FA.redirect(l.select(F.col("a").alias("src"), F.col("b").alias("dst"), "kind"), m)


@query(f"""WITH {FACTS} SELECT list(title ORDER BY title) FILTER (kind = 'decision' AND title IS NOT NULL) AS decisions, cluster_id FROM facts WHERE kind IN ('intent', 'problem', 'constraint', 'decision', 'solution') AND cluster_id = (SELECT min(cluster_id) FROM facts WHERE kind = 'decision') GROUP BY cluster_id""")
def pivot_sections(spark, d):
    f = docs_as_facts(spark, d)
    one = f.where("kind = 'decision'").agg(F.min("cluster_id")).collect()[0][0]
    return Knowledge(facts=f).explain(one or "").select("cluster_id", "decisions")


@query("""SELECT 'files' AS layer, count(*) AS n FROM files UNION ALL SELECT 'links', count(*) FROM concept_links UNION ALL SELECT 'concepts', count(*) FROM concepts_global UNION ALL SELECT 'projects', count(*) FROM projects UNION ALL SELECT 'facts', count(*) FROM documents""")
def layer_counts(spark, d):
    return Knowledge(files=load(spark, d, "files"), links=load(spark, d, "concept_links"), concepts=load(spark, d, "concepts_global"), projects=load(spark, d, "projects"), facts=docs_as_facts(spark, d)).status()


@query(rf"""SELECT path, lower(regexp_replace(t, '^.*\.', '')) AS table_name FROM (SELECT path, regexp_extract(s, '(?i)^\s*create\s+(?:or\s+replace\s+)?table\s+(?:if\s+not\s+exists\s+)?([\w.]+)', 1) AS t FROM (SELECT path, unnest(string_split(regexp_replace(source, '--[^\n]*|/\*(?:[^*]|\*+[^*/])*\*+/|''(?:[^'']|'''')*''', ' ', 'g'), ';')) AS s FROM source_files WHERE regexp_matches(lower(path), '\.(sql|ddl)$'))) WHERE t <> ''""")
def ddl_table_names(spark, d):
    return C.ddl(load(spark, d, "source_files")).where("kind = 'table'").select("path", F.col("name").alias("table_name"))


@query(f"""WITH {FACTS}, f AS (SELECT id, title, updated_at FROM facts WHERE cluster_id = (SELECT min(cluster_id) FROM facts)) SELECT id, title FROM f""")
def concept_members(spark, d):
    f = docs_as_facts(spark, d)
    return Knowledge(facts=f).members(f.agg(F.min("cluster_id")).collect()[0][0] or "").select("id", "title")


@query(f"""WITH {FACTS} SELECT id, kind FROM facts WHERE kind IN ('decision', 'constraint', 'pattern') AND contains(' ' || trim(regexp_replace(strip_accents(lower(coalesce(title, '') || ' . ' || coalesce(summary, ''))), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ', ' cache ') AND coalesce("grounding", 'stated') NOT IN ('external', 'model') ORDER BY confidence DESC, updated_at DESC NULLS LAST, id LIMIT 20""")
def decisions_about(spark, d):
    return Knowledge(facts=docs_as_facts(spark, d)).decisions("cache").select("id", "kind")


@query("""WITH one AS (SELECT min(path) AS p FROM files WHERE node_count > 2)
SELECT DISTINCT content_hash AS id FROM files WHERE path = (SELECT p FROM one)""")
def facts_of_file(spark, d):
    f = load(spark, d, "files")
    one = f.where("node_count > 2").agg(F.min("path")).collect()[0][0] or ""
    facts = f.select(F.col("content_hash").alias("id"), F.lit("decision").alias("kind"), F.col("indexed_at").alias("updated_at")).dropDuplicates(["id"])
    return Knowledge(facts=facts, code_links=f.select(F.col("content_hash").alias("fact_id"), "path")).for_file(one, limit=100).select("id")


@query(f"""WITH {LINKS}, {CONCEPTS}, f AS (SELECT id, name AS title, updated_at FROM n),
c AS (SELECT l.a AS id, arg_min(f.title, f.id) AS cause FROM l JOIN f ON f.id = l.b WHERE l.kind = 'same_as' GROUP BY l.a), x AS (SELECT l.b AS id, arg_min(f.title, f.id) AS fix FROM l JOIN f ON f.id = l.a WHERE l.kind = 'variant_of' GROUP BY l.b)
SELECT f.id, c.cause, x.fix FROM f LEFT JOIN c ON c.id = f.id LEFT JOIN x ON x.id = f.id ORDER BY f.updated_at DESC, f.id LIMIT 40""")
def incidents_with_cause(spark, d):
    f = concepts(spark, d).select("id", F.lit("incident").alias("kind"), F.col("name").alias("title"), "summary", "updated_at")
    kind = F.when(F.col("kind") == "same_as", "caused_by").when(F.col("kind") == "variant_of", "resolves")
    e = links(spark, d).select(F.col("a").alias("src"), F.col("b").alias("dst"), kind.alias("kind")).where("kind is not null")
    return Knowledge(facts=f, edges=e).incidents().select("id", "cause", "fix")


@query(f"""WITH {LINKS}, {CONCEPTS}, r AS (SELECT l.a AS id, list(DISTINCT concat_ws(' ', l.kind, n.name) ORDER BY concat_ws(' ', l.kind, n.name)) AS relations FROM l JOIN n ON n.id = l.b GROUP BY l.a)
SELECT n.id, r.relations FROM n LEFT JOIN r ON r.id = n.id ORDER BY n.name NULLS FIRST, n.id LIMIT 60""")
def domain_model(spark, d):
    f = concepts(spark, d).select("id", F.lit("entity").alias("kind"), F.col("name").alias("title"), "summary")
    e = links(spark, d).select(F.col("a").alias("src"), F.col("b").alias("dst"), "kind")
    none = e.limit(0).select(F.col("src").alias("fact_id"), F.col("dst").alias("path"))
    return Knowledge(facts=f, edges=e, code_links=none).domain_model().select("id", "relations")


@query(f"""WITH {LINKS}, {CONCEPTS}, m AS (SELECT a AS id, b AS other, kind, score FROM l UNION ALL SELECT b, a, kind, score FROM l), one AS (SELECT min(id) AS id FROM (SELECT m.id FROM m JOIN n x ON x.id = m.id JOIN n y ON y.id = m.other WHERE x.project_id <> y.project_id))
SELECT m.other, y.project_id, m.kind, m.score FROM m JOIN one USING (id) JOIN n x ON x.id = m.id JOIN n y ON y.id = m.other WHERE x.project_id <> y.project_id ORDER BY score DESC, other LIMIT 20""")
def linked_concepts(spark, d):
    c, l = concepts(spark, d), links(spark, d)
    one = DS.cross_project(c, l).agg(F.min("id")).collect()[0][0] or ""
    return Knowledge(concepts=c, links=l).link(one).select("other", "project_id", "kind", "score")


@query("""WITH c AS (SELECT coalesce(domain, 'none') AS id, min(domain) AS domain, count(*) AS member_count FROM concepts_global GROUP BY 1) SELECT id, member_count FROM c ORDER BY member_count DESC, id LIMIT 30""")
def concepts_by_size(spark, d):
    c = load(spark, d, "concepts_global").groupBy(F.coalesce("domain", F.lit("none")).alias("id")).agg(F.min("domain").alias("domain"), F.count("*").alias("member_count"))
    return Knowledge(concepts=c).concepts_list().select("id", "member_count")


@query("""SELECT 'unclustered' AS "check", count(*) FILTER (project_id IS NULL) AS n FROM documents UNION ALL SELECT 'no_summary', count(*) FILTER (coalesce(summary, '') = '') FROM concepts_global
UNION ALL SELECT 'pending_files', count(*) FROM files f WHERE NOT EXISTS (SELECT 1 FROM files g WHERE g.path = f.path AND g.content_hash = f.content_hash AND g.node_count > 10)
UNION ALL SELECT 'failed_runs', count(*) FILTER (event_type = 'click' AND epoch_ms(ts) >= 1706572800000 - 86400000) FROM events""")
def doctor(spark, d):
    f = load(spark, d, "files")
    runs = load(spark, d, "events").select((F.col("event_type") != "click").alias("ok"), F.unix_millis(F.col("ts").cast("timestamp")).alias("produced_at"))
    return Knowledge(facts=docs_as_facts(spark, d), concepts=load(spark, d, "concepts_global"), files=f, analysis=f.where("node_count > 10").select("path", "content_hash").distinct(), runs=runs).doctor(1_706_572_800_000)


@query("""SELECT 'concepts' AS layer, id, coalesce(name, '') AS label FROM (SELECT DISTINCT id, name FROM concepts_global WHERE id IS NOT NULL) UNION ALL SELECT 'projects', id, coalesce(name, '') FROM (SELECT DISTINCT id, name FROM projects) UNION ALL SELECT 'documents', CAST(doc_id AS VARCHAR), coalesce(title, '') FROM documents""")
def search_index(spark, d):
    c, p, x = load(spark, d, "concepts_global"), load(spark, d, "projects"), load(spark, d, "documents")
    return DS.snapshot_index(concepts=c.select("id", F.col("name").alias("label")), projects=p.select("id", F.col("name").alias("label")), documents=x.select(F.col("doc_id").alias("id"), F.col("title").alias("label")))


@query("""SELECT '{"id":"' || id || '","agent":' || coalesce('"' || agent || '"', 'null') || ',"started_at":' || coalesce(CAST(started_at AS VARCHAR), 'null') || '}' AS line FROM (SELECT DISTINCT id, agent, started_at FROM sessions WHERE id IS NOT NULL)""")
def export_json(spark, d):
    return DS.export_json(load(spark, d, "sessions").where("id is not null").select("id", "agent", "started_at").distinct())


@query(f"""WITH {FACTS}, p AS (SELECT id, list(DISTINCT path ORDER BY path) AS files FROM projects GROUP BY id) SELECT f.id, kind, created_at AS ts, coalesce(p.files, []) AS files FROM facts f LEFT JOIN p ON p.id = f.cluster_id WHERE kind IN ('decision', 'business_rule', 'constraint', 'pattern', 'problem', 'solution', 'intent')""")
def decision_timeline(spark, d):
    f = docs_as_facts(spark, d)
    at = f.select(F.col("id").alias("fact_id"), "cluster_id").join(load(spark, d, "projects").select(F.col("id").alias("cluster_id"), "path"), "cluster_id")
    return DS.decision_timeline(f, at, f.limit(0).select(F.col("id").alias("fact_id"), F.col("title").alias("session_id"))).select("id", "kind", "ts", "files")


@query("""WITH fc AS (SELECT DISTINCT content_hash AS id, language AS kind, regexp_extract(path, '^/srv/code/[^/]+') AS cid FROM files), c AS (SELECT DISTINCT path AS id, name FROM projects), fl AS (SELECT content_hash AS id, list(DISTINCT path ORDER BY path) AS files FROM files GROUP BY 1)
SELECT c.id, c.name, fc.id AS member, fc.kind, coalesce(fl.files, []) AS files FROM c LEFT JOIN fc ON fc.cid = c.id LEFT JOIN fl ON fl.id = fc.id""")
def project_map(spark, d):
    f, p = load(spark, d, "files"), load(spark, d, "projects")
    facts = f.select(F.col("content_hash").alias("id"), F.col("language").alias("kind"), F.lit("").alias("title"), F.regexp_extract("path", "^/srv/code/[^/]+", 0).alias("cluster_id")).distinct()
    return DS.project_map(p.select(F.col("path").alias("id"), "name").distinct(), facts, f.select(F.col("content_hash").alias("fact_id"), "path")).drop("title")


@query(f"""WITH {FACTS}, g AS (SELECT cluster_id, kind, count(*) AS n FROM facts WHERE kind IN ('business_rule', 'entity', 'constraint', 'pattern') AND cluster_id IS NOT NULL GROUP BY 1, 2)
SELECT p.id, p.name, string_agg(kind || '=' || n, ',' ORDER BY kind || '=' || n) AS rules FROM (SELECT DISTINCT id, name FROM projects) p JOIN g ON g.cluster_id = p.id GROUP BY p.id, p.name""")
def business_logic_view(spark, d):
    return DS.business_logic(load(spark, d, "projects").select("id", "name").distinct(), docs_as_facts(spark, d))


# ---- organization and wisdom ----

_SKILLS = """sk AS (SELECT DISTINCT lower(trim(language)) AS name, 'language' AS kind FROM files WHERE language IS NOT NULL UNION SELECT DISTINCT domain, 'domain' FROM concepts_global WHERE domain IS NOT NULL UNION SELECT DISTINCT agent, 'tool' FROM sessions WHERE agent IS NOT NULL),
ks AS (SELECT name, kind, CAST(length(name) AS DOUBLE) AS weight, length(name) % 5 AS project_count FROM sk)"""


def _skills(spark, d):
    lang = load(spark, d, "files").where("language is not null").select(F.lower(F.trim("language")).alias("name"), F.lit("language").alias("kind"))
    dom = load(spark, d, "concepts_global").where("domain is not null").select(F.col("domain").alias("name"), F.lit("domain").alias("kind"))
    tool = load(spark, d, "sessions").where("agent is not null").select(F.col("agent").alias("name"), F.lit("tool").alias("kind"))
    return lang.union(dom).union(tool).distinct().select("name", "kind", F.length("name").cast("double").alias("weight"), (F.length("name") % 5).alias("project_count"))


_AREA = """ar AS (SELECT CASE kind WHEN 'language' THEN 'Languages' WHEN 'domain' THEN 'Domain Knowledge' ELSE 'Tooling & Infrastructure' END AS area, sum(weight) AS w, max(project_count) AS p, count(*) AS n FROM ks GROUP BY 1),
al AS (SELECT area, n, CASE WHEN w >= 12 OR p >= 4 THEN 'expert' WHEN w >= 6 OR p >= 3 THEN 'proficient' WHEN w >= 3 OR p >= 2 THEN 'competent' WHEN w >= 1 THEN 'advanced_beginner' ELSE 'novice' END AS level, row_number() OVER (ORDER BY n DESC, area) - 1 AS rank FROM ar)"""


@query(f"WITH {_SKILLS}, {_AREA} SELECT area, level, n, rank FROM al")
def organized_areas(spark, d):
    return DS.areas(_skills(spark, d))


@query(f"""WITH {_SKILLS} SELECT CASE kind WHEN 'language' THEN 'Language' WHEN 'domain' THEN 'Domain' ELSE 'Tool' END AS area, name AS skill, weight,
 CASE WHEN weight >= 12 OR project_count >= 4 THEN 'expert' WHEN weight >= 6 OR project_count >= 3 THEN 'proficient' WHEN weight >= 3 OR project_count >= 2 THEN 'competent' WHEN weight >= 1 THEN 'advanced_beginner' ELSE 'novice' END AS level,
 row_number() OVER (PARTITION BY kind ORDER BY weight DESC, name) - 1 AS rank FROM ks""")
def organized_skills(spark, d):
    s = _skills(spark, d)
    return P.organize(s, s)


@query("""WITH a AS (SELECT s.source_path AS project, max(coalesce(ended_at, started_at, ingested_at)) AS last FROM (SELECT DISTINCT regexp_extract(source_path, '[^/]+/[^/]+$') AS source_path, ended_at, started_at, ingested_at FROM sessions) s GROUP BY 1)
SELECT project, CASE WHEN greatest(0, floor((1746000000000 - last) / 86400000.0 + 0.5)) <= 90 THEN 'active' ELSE 'archived' END AS status, 'Indexed project.' AS focus FROM a""")
def organized_projects(spark, d):
    s = load(spark, d, "sessions").select(F.regexp_extract("source_path", "[^/]+/[^/]+$", 0).alias("project"), F.coalesce("ended_at", "started_at", "ingested_at").alias("at"))
    return DS.organized_projects(P.activity(s, NOW).select("project", "idle_days"), s.limit(0).select("project", F.lit("").alias("topic")))


@query(f"""WITH {CONCEPTS}, ds AS (SELECT DISTINCT domain AS name, CASE WHEN domain < 'm' THEN 'tech' ELSE 'business' END AS kind FROM n WHERE domain IS NOT NULL), sb AS (SELECT CASE kind WHEN 'tech' THEN 'Technical Domains' ELSE 'Business & Industry' END AS subject, name AS topic FROM ds)
SELECT subject, topic, 'domain' AS kind, topic AS name FROM sb UNION SELECT subject, topic, 'concept', n.name FROM sb JOIN n ON n.domain = sb.topic WHERE n.name IS NOT NULL UNION SELECT 'Concepts & Patterns', 'Recurring concepts', 'concept', name FROM n WHERE domain IS NULL AND name IS NOT NULL""")
def subject_topics(spark, d):
    c = concepts(spark, d)
    return DS.topics_of(c.where("domain is not null").select(F.col("domain").alias("name"), F.when(F.col("domain") < "m", "tech").otherwise("business").alias("kind")).distinct(), c)


@query(f"""WITH {_SKILLS}, t AS (SELECT * FROM ks WHERE project_count > 1 ORDER BY project_count DESC, name LIMIT 6)
SELECT 'Consistent cross-project strengths' AS title, string_agg(name, ', ' ORDER BY project_count DESC, name) || ' recur across multiple projects.' AS body, count(*) || ' skill(s) evidenced in 2+ projects' AS evidence FROM t HAVING count(*) > 0""")
def wisdom_insights(spark, d):
    return DS.insights(_skills(spark, d))


@query(f"""WITH {_SKILLS}, {_AREA}, x AS (SELECT list(area ORDER BY CASE level WHEN 'expert' THEN 5 WHEN 'proficient' THEN 4 WHEN 'competent' THEN 3 WHEN 'advanced_beginner' THEN 2 ELSE 1 END DESC, rank, area)[1:3] AS top, count(*) AS n FROM al),
i AS (SELECT list(name ORDER BY p DESC, name)[1:3] AS ind FROM (SELECT domain AS name, count(DISTINCT project_id) AS p FROM concepts_global WHERE domain IS NOT NULL GROUP BY 1))
SELECT 'Engineer working across ' || array_to_string(ind, ', ') || ', strongest in ' || array_to_string(top[1:2], ' and ') || '.' AS headline, 'Across 60 project(s): ' || n || ' competency area(s), led by ' || array_to_string(top, ', ') || '.' AS narrative FROM x, i""")
def wisdom_headline(spark, d):
    i = load(spark, d, "concepts_global").where("domain is not null").groupBy(F.col("domain").alias("name")).agg(F.countDistinct("project_id").alias("projects"))
    return DS.headline(DS.areas(_skills(spark, d)), i, 60)


@query(f"""WITH {FACTS}, g AS (SELECT id, title, cluster_id AS project_id, row_number() OVER (PARTITION BY cluster_id ORDER BY id) AS k FROM facts WHERE kind = 'requirement' AND title IS NOT NULL),
o AS (SELECT lower(trim(title)) AS key, min((project_id, id, title)) AS m FROM g WHERE k <= 50 AND project_id IS NOT NULL GROUP BY 1) SELECT m[3] AS title, m[1] AS project_id FROM o ORDER BY m[1], m[2] LIMIT 30""")
def wisdom_gaps(spark, d):
    f = docs_as_facts(spark, d).where("kind = 'requirement' and cluster_id is not null").select("id", F.lit("knowledge_gap").alias("kind"), "title", F.col("cluster_id").alias("project_id"))
    return DS.open_gaps(f)


@query(f"""WITH {FACTS}, k AS (SELECT kind, title, row_number() OVER (PARTITION BY kind ORDER BY confidence DESC NULLS LAST, id) AS r FROM facts WHERE kind IN ('decision', 'constraint', 'business_rule', 'entity') AND title IS NOT NULL), l AS (SELECT kind || ': ' || string_agg(title, '; ' ORDER BY r) AS line FROM k WHERE r <= 20 GROUP BY kind), b AS (SELECT string_agg(line, chr(10) ORDER BY line) AS b FROM l)
SELECT CASE WHEN length(b) > 3000 THEN left(b, 3000) || '…' ELSE b END AS pack FROM b""")
def core_pack(spark, d):
    return DS.core_pack(docs_as_facts(spark, d))


@query("""SELECT source, round(avg(n_chars), 4) AS chars, count(DISTINCT project_id) AS projects FROM (SELECT trim(lower(source)) AS source, n_chars, project_id FROM documents) GROUP BY source""")
def averages_by_source(spark, d):
    x = load(spark, d, "documents").groupBy(F.trim(F.lower("source")).alias("source"))
    return x.agg(F.round(F.avg("n_chars"), 4).alias("chars"), F.countDistinct("project_id").alias("projects"))


@query(f"""WITH {FACTS} SELECT kind, count(*) AS n FROM facts WHERE kind NOT IN ('path_mention', 'code_block', 'shell_command', 'error_message', 'stack_trace', 'ticket_id', 'url', 'dependency', 'tool', 'knowledge_gap', 'business_domain', 'tech_domain', 'incident', 'root_cause') GROUP BY kind""")
def clusterable_kinds(spark, d):
    return FA.clusterable(docs_as_facts(spark, d)).groupBy("kind").agg(F.count("*").alias("n"))


@query("""SELECT f.path, coalesce(g.layer, 'other') AS layer FROM (SELECT DISTINCT path FROM files WHERE path IS NOT NULL) f LEFT JOIN (SELECT path, min(lower(trim(language))) AS layer FROM files WHERE node_count > 5 GROUP BY path) g ON g.path = f.path""")
def file_layers(spark, d):
    f = load(spark, d, "files").where("path is not null")
    return P.file_layers(f.select("path").distinct(), f.where("node_count > 5").groupBy("path").agg(F.min(F.lower(F.trim("language"))).alias("layer")))


@query(f"""WITH {FACTS} SELECT DISTINCT id, title FROM facts WHERE id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM documents WHERE trim(lower(source)) = 'adr')""")
def cascade_delete(spark, d):
    f = docs_as_facts(spark, d)
    gone = load(spark, d, "documents").where(F.trim(F.lower("source")) == "adr").select(F.col("doc_id").cast("string").alias("id"))
    return FA.cascade(f.select("id", "title").distinct(), "id", gone)


@query("""WITH n AS (SELECT path, max(indexed_at) AS at FROM files WHERE path IS NOT NULL GROUP BY path), new AS (SELECT DISTINCT f.path, content_hash FROM files f JOIN n ON n.path = f.path AND n.at = f.indexed_at WHERE node_count > 3)
SELECT path, content_hash FROM new UNION ALL SELECT DISTINCT path, content_hash FROM files WHERE path IS NOT NULL AND path NOT IN (SELECT path FROM new)""")
def replaced_files(spark, d):
    f = load(spark, d, "files").where("path is not null")
    top = f.groupBy("path").agg(F.max("indexed_at").alias("indexed_at"))
    new = f.join(top, ["path", "indexed_at"]).where("node_count > 3").select("path", "content_hash").distinct()
    return FA.replace_files(f.select("path", "content_hash").distinct(), new)


@query("""SELECT id, agent FROM (SELECT id, min(agent) AS agent FROM sessions WHERE id IS NOT NULL GROUP BY id) WHERE id NOT IN (SELECT session_id FROM turns WHERE session_id IS NOT NULL)""")
def inserted_if_absent(spark, d):
    s = load(spark, d, "sessions").where("id is not null").groupBy("id").agg(F.min("agent").alias("agent"))
    return FA.insert_absent(load(spark, d, "turns").where("session_id is not null").select(F.col("session_id").alias("id")).distinct(), s, ["id"])


@query(f"""WITH {FACTS} SELECT sha1(count(*) || '|' || coalesce(max(updated_at), 0)) AS fingerprint FROM facts""")
def store_fingerprint(spark, d):
    return P.fingerprint(docs_as_facts(spark, d))


@query()
def call_resolution(spark, d):
    return L.resolve_calls(*C.calls(C.symbols(load(spark, d, "source_files")))).groupBy("state").agg(F.count("*").alias("n"))


@query()
def code_edges(spark, d):
    return C.code_edges(C.symbols(load(spark, d, "source_files")))


@query()
def routed_facts(spark, d):
    return P.update(spark, _turns(spark, d), load(spark, d, "sessions"), NOW)["routed"]


@query("""WITH s AS (SELECT DISTINCT '/srv/new/' || agent AS path, agent AS name FROM sessions WHERE agent IS NOT NULL), p AS (SELECT DISTINCT id, name, path, registered_at, last_seen_at FROM projects)
SELECT id, name, registered_at, last_seen_at FROM p UNION ALL SELECT substr(sha1(path), 1, 16), name, 1746000000000, 1746000000000 FROM s""")
def registered_projects(spark, d):
    p = load(spark, d, "projects").select("id", "name", "path", "registered_at", "last_seen_at").distinct()
    seen = load(spark, d, "sessions").where("agent is not null").select(F.concat(F.lit("/srv/new/"), "agent").alias("path"), F.col("agent").alias("name")).distinct()
    return P.register(p, seen, NOW).select("id", "name", "registered_at", "last_seen_at")
