"""Operators of the core on small fixtures, against plain loops where order matters."""
import json
import random

import pytest
from pyspark.sql import functions as F

from lorequarry.functions import text as T
from lorequarry.functions import vectors as V
from lorequarry.operators import facts as FA
from lorequarry.operators import links as L
from lorequarry.operators import windows as W
from lorequarry.plans import agents as A
from lorequarry.plans import pipelines as P
from lorequarry.plans.api import Knowledge
from lorequarry.sources import code as C
from lorequarry.sources import documents as D
from lorequarry.sources import transcripts as TR

TURN = "id string, session_id string, idx int, role string, text string, ts long, raw string"


def one(spark, col):
    return spark.range(1).select(col.alias("x")).collect()[0]["x"]


def loop_segments(turns, max_turns, max_chars):
    out, cur, n = [], [], 0

    def flush():
        nonlocal cur, n
        roles = {r for _, r, _ in cur}
        if "user" in roles and roles & {"assistant", "tool"}:
            out.append((cur[0][0], cur[-1][0]))
        cur, n = [], 0

    for t in turns:
        if t[1] == "user" and cur:
            flush()
        cur.append(t)
        n += len(t[2])
        if len(cur) >= max_turns or n >= max_chars:
            flush()
    flush()
    return out


def test_segmenter_matches_the_loop(spark):
    random.seed(3)
    rows, want = [], set()
    for s in range(60):
        turns = [(i, random.choice(["user", "assistant", "tool", "system"]), "x" * random.randint(0, 40)) for i in range(random.randint(0, 15))]
        rows += [(f"{s}-{i}", str(s), i, r, t, None, None) for i, r, t in turns]
        want |= {(str(s), a, b) for a, b in loop_segments(turns, 4, 70)}
    got = W.segment(spark.createDataFrame(rows, TURN), 4, 70)
    assert {(r.session_id, r.start_idx, r.end_idx) for r in got.collect()} == want


def test_segmenter_edges(spark):
    assert W.segment(spark.createDataFrame([], TURN)).count() == 0
    df = spark.createDataFrame([("a", "s", None, "user", "x", 1, None), ("b", None, 0, "user", "x", 1, None), ("c", "s", 0, "user", None, 1, None), ("d", "s", 1, "assistant", "y", 1, None)], TURN)
    r = W.segment(df.withColumn("text_hash", F.lit("clash"))).collect()
    assert [(x.start_idx, x.end_idx, x.text) for x in r] == [(0, 1, "[user] \n\n[assistant] y")]


def test_leaders_match_the_walk(spark):
    random.seed(5)
    n = 40
    adj = {(a, b) for a in range(n) for b in range(a + 1, n) if random.random() < 0.08}
    lead, want = [], {}
    for i in range(n):
        mine = [a for a in lead if (a, i) in adj]
        want[i] = mine[0] if mine else i
        if not mine:
            lead.append(i)
    items = spark.createDataFrame([(i, 0) for i in range(n)], "id int, created_at int")
    got = FA.leaders(spark, items, spark.createDataFrame(sorted(adj), "a int, b int"))
    assert {r.id: r.leader for r in got.collect()} == want


def test_clean_turn(spark):
    text = "```thinking\nsecret\n```Sure, a line that is longer than twenty\na line that is longer than twenty\na line that is longer than twenty\n---\nend"
    got = one(spark, T.clean_turn(F.lit(text)))
    assert "secret" not in got and got.count("longer") == 2 and "---" not in got and got.startswith("a line")
    assert one(spark, T.clean_turn(F.lit(None).cast("string"))) == ""
    long = one(spark, T.clean_turn(F.lit("a" * 20_000)))
    assert "trimmed 8000 chars" in long


@pytest.mark.parametrize("name,want", [("Accounts", "account"), ("gas", "gas"), ("User-Profiles", "userprofile"), ("", "")])
def test_entity_name(spark, name, want):
    assert one(spark, T.entity_name(F.lit(name))) == want


def test_full_text(spark):
    df = spark.createDataFrame([("Rédis cache",), ("redis_pool",), ("Sessions",), (None,)], "t string")
    assert df.where(T.matches(["t"], "redis")).count() == 2
    assert df.where(T.matches(["t"], "session")).count() == 0
    assert df.where(T.matches(["t"], "")).count() == 0


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0], [1.0, 2.0], 0.0), ([0.0, 0.0], [1.0, 0.0], 0.0), (None, [1.0], 0.0)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>, w double")
    assert all(r.c == pytest.approx(r.w) for r in df.select(V.cosine("a", "b").alias("c"), "w").collect())


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, created_at int, note string")
    new = spark.createDataFrame([("b", 9, None), ("c", 3, "z")], "id string, created_at int, note string")
    up = FA.upsert(old, new, ["id"], keep=("created_at",), if_set=("note",))
    want = {("a", 1, "x"), ("b", 2, "y"), ("c", 3, "z")}
    assert {tuple(r) for r in up.collect()} == want
    assert {tuple(r) for r in FA.upsert(up, new, ["id"], keep=("created_at",), if_set=("note",)).collect()} == want
    assert [r.id for r in FA.insert_absent(old, new, ["id"]).collect()] == ["c"]


def test_redirect_drops_loops(spark):
    e = spark.createDataFrame([("a", "b", "k"), ("c", "b", "k"), ("b", "c", "k")], "src string, dst string, kind string")
    s = spark.createDataFrame([("c", "b")], "dup string, survivor string")
    assert {tuple(r) for r in FA.redirect(e, s).collect()} == {("a", "b", "k")}


def test_anchor_gate(spark):
    f = spark.createDataFrame(
        [("1", "w", "decision", 0.9, None), ("2", "w", "intent", 0.8, []), ("3", "w", "intent", 0.8, ["OPS-1"]), ("4", "w", "decision", None, None), *[(f"d{i}", "v", "decision", 0.5 + i / 100, None) for i in range(12)]],
        "id string, window_id string, kind string, confidence double, anchors array<string>",
    )
    got = [r.id for r in FA.anchor_gate(f).collect()]
    assert {"1", "3"} <= set(got) and not {"2", "4"} & set(got) and sum(g.startswith("d") for g in got) == 8


def test_online_clusters(spark):
    f = spark.createDataFrame([("p", "a", "k", 1, [1.0, 0.0]), ("p", "b", "k", 2, [1.0, 0.01]), ("p", "c", "k", 3, [0.0, 1.0]), ("p", "d", "todo", 4, None)], "project_id string, id string, kind string, created_at int, embedding array<double>")
    assert {r.id: r.concept for r in FA.online_clusters(f).collect()} == {"a": "a", "b": "a", "c": "c", "d": "todo (uncategorized)"}


def test_survivors_and_dominant(spark):
    f = spark.createDataFrame([("a", "stated", 1, "meta"), ("b", "structural", 2, "meta"), ("c", None, 3, None)], "id string, `grounding` string, created_at int, scope string")
    g = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "id string, leader string")
    assert [tuple(r) for r in FA.survivors(f, g).collect()] == [("a", "b", True)]
    d = FA.dominant(f.withColumn("k", F.lit("x")), "k").collect()[0]
    assert (d.scope, d["grounding"]) == ("meta", "structural")


def test_resolve_paths(spark):
    files = spark.createDataFrame([("src/a.ts",), ("lib/a.ts",), ("src/b.ts",)], "path string")
    m = spark.createDataFrame([("src/a.ts",), ("a.ts",), ("b.ts",), ("c.ts",)], "mention string")
    assert {tuple(r) for r in L.resolve_paths(m, files).collect()} == {("src/a.ts", "src/a.ts"), ("b.ts", "src/b.ts")}


def test_gaps_and_entities(spark):
    t = spark.createDataFrame([("accounts", False), ("Tier", True), ("users", False)], "name string, stub boolean")
    fk = spark.createDataFrame([("accounts", "tier"), ("users", "accounts")], "src string, dst string")
    e, r = L.entities_from_code(t, fk)
    rules = spark.createDataFrame([("All accounts need a tier",)], "text string")
    assert {(x.kind, x.entity) for x in L.gaps(spark, e, r, rules).collect()} == {("external_ref", "tier"), ("ungoverned", "users")}


def test_ddl_and_symbols(spark):
    sql = "-- x\nCREATE TABLE accounts (id INT PRIMARY KEY, tier_id INT REFERENCES tier(id), note TEXT DEFAULT ');');\nCREATE INDEX i ON accounts (id);"
    got = C.ddl_objects(sql)
    assert ("table", "accounts", None) in got and ("foreign_key", "accounts", "tier") in got and ("column", "note", "accounts") in got and ("index", "i", "accounts") in got
    src = spark.createDataFrame([("a.py", "import os\ndef f():\n    g()\n"), ("b.go", "package x\n\nfunc Run() {\n}\n"), ("c.py", "def ("), ("d.txt", "x"), ("e.ts", None)], "path string, source string")
    s = {(r.path, r.kind, r.name) for r in C.symbols(src).collect()}
    assert {("a.py", "import", "os"), ("a.py", "function", "f"), ("a.py", "call", "g"), ("b.go", "function", "Run")} == s


def test_manifests(spark):
    m = spark.createDataFrame([("p/package.json", json.dumps({"dependencies": {"react": "1"}, "devDependencies": {"vite": "2"}})), ("p/Dockerfile", "FROM x"), ("q/requirements.txt", "React==1\nnumpy>=2\n")], "path string, content string")
    assert {(r.kind, r.name.lower()) for r in C.manifests(m).collect()} == {("dependency", "react"), ("dependency", "vite"), ("dependency", "numpy"), ("tool", "docker")}


def test_sections(spark):
    text = "# One\n" + "body line that is long enough to be kept, really\n" + "## Two\nshort\n## Three\n" + "x" * 50
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    assert [(r.doc_id, r.heading) for r in D.sections(df).orderBy("n").collect()] == [(1, "One"), (1, "Three")]


def test_diagram_labels(spark):
    assert one(spark, D.drawio_labels(F.lit('<a value="&lt;b&gt;Box&lt;/b&gt;"/><a value="Box"/><a value=""/>'))) == "Box"
    assert one(spark, D.excalidraw_text(F.lit('{"elements":[{"type":"text","text":"hi"},{"type":"rect"}]}'))) == "hi"
    assert one(spark, D.excalidraw_text(F.lit("no json"))) == ""


def test_transcripts(spark):
    rows = [
        '{"type":"message","role":"user","content":[{"type":"input_text","text":"hello"}]}', '{"type":"assistant","message":{"role":"assistant","content":[{"type":"text","text":"a"},{"type":"text","text":"b"}]},"timestamp":5}',
        '{"type":"function_call","name":"ls","arguments":"{}"}', '{"type":"function_call_output","output":"ok"}', '{"message":{"text":"q"},"response":[]}', '{"cut', None,
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "k int, value string")
    got = {r.k: (r.dialect, r.entry_role, r.body, r.tool) for r in TR.parse_entries(df).collect()}
    assert got[0] == ("typed", "user", "hello", None) and got[1][1:3] == ("assistant", "a\nb")
    assert got[2] == ("function", "assistant", "", "ls") and got[3][1:3] == ("tool", "ok") and got[4][2] == "q" and got[5][0] is None and got[6][0] is None


def test_jsonl_tail(spark, tmp_path):
    spark.dataSource.register(TR.JsonlTail)
    f = tmp_path / "a.jsonl"
    f.write_text("one\ntwo\npart")
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")

    def drain():
        q = spark.readStream.format("jsonl_tail").load(str(tmp_path)).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(once=True).start()
        q.awaitTermination()
        return sorted(r.value for r in spark.read.parquet(out).collect())

    assert drain() == ["one", "two"]
    with f.open("a") as h:
        h.write("ial\nthree\n")
    assert drain() == ["one", "partial", "three", "two"]


def test_agent_cache(spark):
    rows = spark.createDataFrame([(1, '{"text":"we decided to fix the bug in src/a.ts"}'), (2, "no json")], "k int, payload string")
    first, fresh = A.run_agent(rows, A.TRIAGE, None, 10)
    assert {r.k: r.ok for r in first.collect()} == {1: True, 2: False}
    cache = spark.createDataFrame(fresh.collect(), A.CACHE)
    _, again = A.run_agent(rows, A.TRIAGE, cache, 20)
    assert again.count() == 1  # only the failure is tried again
    assert A.expire(cache, "triage", 10 + 31 * 86_400_000).count() == 0


def test_api(spark):
    f = spark.createDataFrame(
        [("1", "decision", "Use redis", "cache", 0.9, "technical", None, "c", 1, 2), ("2", "incident", "Outage", "", 0.5, None, "stated", None, 1, 3), ("3", "problem", "Disk full", "", 0.5, None, "model", "c", 1, 1), ("4", "solution", "Add disk", "", 0.5, None, None, "c", 1, 1)],
        "id string, kind string, title string, summary string, confidence double, scope string, `grounding` string, cluster_id string, created_at long, updated_at long",
    )
    e = spark.createDataFrame([("2", "3", "caused_by"), ("4", "2", "resolves")], "src string, dst string, kind string")
    cl = spark.createDataFrame([("1", "src/a.ts")], "fact_id string, path string")
    k = Knowledge(facts=f, edges=e, code_links=cl)
    assert [r.id for r in k.recall("redis").collect()] == ["1"] and k.recall("disk").count() == 1 and k.recall("disk", enrichment=True).count() == 2
    assert [(r.cause, r.fix) for r in k.incidents().collect()] == [("Disk full", "Add disk")]
    assert [r.id for r in k.decisions(path="src/a.ts").collect()] == ["1"] and k.ask("redis outage").count() == 2
    x = k.explain("c").collect()[0]
    assert x.decisions == ["Use redis"] and x.problems == ["Disk full"] and x.solutions == ["Add disk"]
    assert {r.layer: r.n for r in k.status().collect()} == {"facts": 4, "edges": 2, "code_links": 1}


def test_layers_and_activity(spark):
    a = spark.createDataFrame([("a/x", "a", "ui"), ("a/y", "a", "other"), ("b/z", "b", "other")], "path string, dir string, layer string")
    assert {r.path: r.layer for r in P.vote_layers(a).collect()} == {"a/x": "ui", "a/y": "ui", "b/z": "other"}
    s = spark.createDataFrame([("p", 86_400_000 * 100), ("q", None)], "project string, at long")
    got = {r.project: (r.idle_days, r.status) for r in P.activity(s, 86_400_000 * 105).collect()}
    assert got == {"p": (5, "active"), "q": (None, "archived")}
