"""Joins over code, concepts and projects: resolution, links, gaps, hierarchy."""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorequarry.functions import text as T
from lorequarry.session import Stored

# What a shared key of each kind counts.
SIGNAL_WEIGHTS = {"business": 3.0, "tech": 2.0, "concept": 1.0, "industry": 1.0, "skill": 0.5}


def resolve_paths(mentions: DataFrame, files: DataFrame) -> DataFrame:
    """(mention, path): the file that a mention names exactly, or as the only one that ends in it.

    Every suffix of a path becomes a row and is joined by equality, in place of
    a scan of all files for each mention.
    """
    m = mentions.select("mention").distinct()
    f = files.select("path").distinct()
    exact = m.join(f, F.col("mention") == F.col("path")).select("mention", "path")
    parts = F.split("path", "/")
    tails = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    suffix = f.where(F.size(parts) > 1).select("path", F.explode(tails).alias("mention"))
    hit = m.join(exact, "mention", "left_anti").join(suffix, "mention")
    unique = hit.groupBy("mention").agg(F.min("path").alias("path"), F.count("*").alias("n")).where("n = 1").select("mention", "path")
    return exact.unionByName(unique)


def resolve_symbols(mentions: DataFrame, nodes: DataFrame, most: int = 5) -> DataFrame:
    """(mention, node_id): up to ``most`` nodes of that name, in any case."""
    n = nodes.select(F.lower("name").alias("key"), F.col("id").alias("node_id"))
    j = mentions.select("mention").distinct().join(n, F.lower("mention") == F.col("key"))
    w = Window.partitionBy("mention").orderBy("node_id")
    return j.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).select("mention", "node_id")


def resolve_calls(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """(caller, callee_name, target, state): one match is an edge, 2 to 5 are candidates, others stay open."""
    n = nodes.where(F.col("kind").isin("function", "method")).groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("one"))
    j = calls.join(n, calls["callee_name"] == n["name"], "left")
    state = F.when(F.col("n") == 1, "resolved").when(F.col("n").between(2, 5), "candidates").otherwise("open")
    return j.select("caller", "callee_name", F.when(F.col("n") == 1, F.col("one")).alias("target"), state.alias("state"))


def same_name_links(concepts: DataFrame) -> DataFrame:
    """(a, b, score): concepts of different projects with one name in any case; 0.6, or 0.8 in one domain.

    Names that more than one project uses are kept first, so a frequent name
    pairs only what can be linked.
    """
    c = concepts.where("name is not null").select("id", "project_id", F.lower("name").alias("key"), "domain")
    shared = c.groupBy("key").agg(F.countDistinct("project_id").alias("n")).where("n > 1").select("key")
    c = c.join(shared, "key", "left_semi")
    a, b = c.alias("a"), c.alias("b")
    j = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.project_id") != F.col("b.project_id")) & (F.col("a.id") < F.col("b.id")))
    score = F.lit(0.6) + F.when(F.col("a.domain") == F.col("b.domain"), 0.2).otherwise(0.0)
    return j.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.round(score, 2).alias("score"))


def neighbours(links: DataFrame) -> DataFrame:
    """(id, other, kind, score): links seen from both ends."""
    out = links.select(F.col("a").alias("id"), F.col("b").alias("other"), "kind", "score")
    return out.union(links.select(F.col("b").alias("id"), F.col("a").alias("other"), "kind", "score")).where("id is not null and other is not null and id <> other")


def emergent_links(keys: DataFrame, most: int = 5000) -> DataFrame:
    """(a, b, weight, signals): projects that share keys (signal, key, project_id), by summed weight."""
    w = F.create_map(*[F.lit(x) for kv in SIGNAL_WEIGHTS.items() for x in kv])
    k = keys.where("key is not null and project_id is not null").select("signal", F.lower("key").alias("key"), "project_id").distinct()
    a, b = k.alias("a"), k.alias("b")
    j = a.join(b, (F.col("a.signal") == F.col("b.signal")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.project_id") < F.col("b.project_id")))
    per = j.groupBy(F.col("a.project_id").alias("a"), F.col("b.project_id").alias("b"), F.col("a.signal").alias("signal")).agg(F.count("*").alias("n"))
    total = per.groupBy("a", "b").agg(F.sum(w[F.col("signal")] * F.col("n")).alias("weight"), F.array_sort(F.collect_list(F.concat_ws("=", "signal", F.col("n").cast("string")))).alias("signals"))
    return total.select("a", "b", T.round2("weight").alias("weight"), F.array_join("signals", ",").alias("signals")).orderBy(F.desc("weight"), "a", "b").limit(most)


def reconcile(stated: DataFrame, structural: DataFrame) -> DataFrame:
    """(stated_id, structural_id): entities that are one by normalised name; of several structural ones the first."""
    s = structural.select(T.entity_name("name").alias("key"), "id", "created_at").where("key <> ''")
    first = s.groupBy("key").agg(F.min_by("id", F.struct("created_at", "id")).alias("structural_id"))
    t = stated.select(T.entity_name("name").alias("key"), F.col("id").alias("stated_id"))
    return t.join(first, "key").select("stated_id", "structural_id")


def entities_from_code(tables: DataFrame, foreign_keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (name, external) from tables(name, stub) and relations (src, dst) from foreign_keys(src, dst)."""
    ents = tables.groupBy(F.lower("name").alias("name")).agg(F.bool_and("stub").alias("external"))
    rel = foreign_keys.select(F.lower("src").alias("src"), F.lower("dst").alias("dst")).distinct()
    rel = rel.join(ents.select(F.col("name").alias("src")), "src", "left_semi").join(ents.select(F.col("name").alias("dst")), "dst", "left_semi")
    return ents, rel


#: So many names make one automaton; more are looked for block by block, each in one pass over the texts.
NAMES_A_BLOCK = 200_000


def mentioned(spark: SparkSession, names: DataFrame, texts: DataFrame) -> DataFrame:
    """(name) of names(name), in lower case, that some text of texts(text) contains, in any case, inside words too.

    Names are compiled into automata that find all of them in one pass over a
    text. Null and empty names and texts take no part.
    """
    n = Stored(spark, names.select(F.lower("name").alias("name")).where("name <> ''").distinct(), "names")
    blocks = max(1, -(-n.df.count() // NAMES_A_BLOCK))
    t = texts.select(F.lower("text").alias("text")).where("text <> ''")

    def search(words: list[str]):
        sent = spark.sparkContext.broadcast(words)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            a = ahocorasick.Automaton()
            for w in sent.value:
                a.add_word(w, w)
            a.make_automaton()
            found: set[str] = set()
            for b in batches:
                new = {w for x in b.column(0).to_pylist() for _, w in a.iter(x)} - found
                found |= new
                yield pa.RecordBatch.from_arrays([pa.array(sorted(new), pa.string())], ["name"])

        return t.mapInArrow(run, "name string")

    out = n.df.limit(0)
    for k in range(blocks):  # a block is bounded, whatever the number of names
        words = [r[0] for r in n.df.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == k).collect()]
        if words:
            out = out.union(search(words))
    return out.distinct()


def gaps(spark: SparkSession, entities: DataFrame, relations: DataFrame, rules: DataFrame) -> DataFrame:
    """(kind, entity, detail): external targets, and related entities that no rule mentions.

    A rule mentions an entity whose name it contains in any case, names of
    several words too.
    """
    ext = relations.join(entities.where("external").select(F.col("name").alias("dst")), "dst", "left_semi")
    g1 = ext.groupBy("dst").agg(F.array_join(F.array_sort(F.collect_set("src")), ", ").alias("detail")).select(F.lit("external_ref").alias("kind"), F.col("dst").alias("entity"), "detail")
    ends = relations.select(F.col("src").alias("entity")).union(relations.select(F.col("dst").alias("entity"))).distinct()
    inside = ends.join(entities.where("not external").select(F.col("name").alias("entity")), "entity", "left_semi")
    told = mentioned(spark, inside.select(F.col("entity").alias("name")), rules).select(F.col("name").alias("entity"))
    g2 = inside.join(told, "entity", "left_anti").select(F.lit("ungoverned").alias("kind"), "entity", F.lit("").alias("detail"))
    return g1.unionByName(g2)


def hierarchy(nodes: DataFrame, edges: DataFrame, most: int = 4000) -> DataFrame:
    """Distinct edges (parent, child, kind) whose two ends are nodes (id), the first ``most`` in order."""
    ids = nodes.select("id").distinct()
    e = edges.join(ids.withColumnRenamed("id", "parent"), "parent", "left_semi").join(ids.withColumnRenamed("id", "child"), "child", "left_semi")
    return e.select("parent", "child", "kind").distinct().orderBy("parent", "child", "kind").limit(most)


def fan_in(edges: DataFrame, share: float = 0.85) -> DataFrame:
    """(path, calls, hot): inbound calls of each file, and whether it is at or above the percentile."""
    c = edges.groupBy(F.col("dst_path").alias("path")).agg(F.count("*").alias("calls"))
    cut = c.agg(F.expr(f"percentile_disc({share}) within group (order by calls)").alias("cut"))
    return c.join(F.broadcast(cut)).select("path", "calls", (F.col("calls") >= F.col("cut")).alias("hot"))


def synthesize_skills(evidence: DataFrame) -> DataFrame:
    """(scope, name, kind, weight, project_count, grounding): evidence of one skill in all projects, rolled up."""
    from lorequarry import schema as S

    g = F.max_by("grounding", S.rank(F.col("grounding"), S.CONCEPT_RANK, "model"))
    return evidence.groupBy("scope", T.skill_name("name").alias("name")).agg(
        F.min("kind").alias("kind"), T.round2(F.sum("weight")).alias("weight"), F.countDistinct("project_id").alias("project_count"), F.coalesce(g, F.lit("model")).alias("grounding")
    )
