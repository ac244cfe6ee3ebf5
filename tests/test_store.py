"""Graph, vectors, artifacts and data sets on small tables, against brute force where there is one."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorequarry.functions import syntax as SX
from lorequarry.functions import text as T
from lorequarry.operators import facts as FA
from lorequarry.operators import graph as G
from lorequarry.operators import links as L
from lorequarry.operators import similar as SM
from lorequarry.operators import windows as W
from lorequarry.plans import datasets as DS

TURN = "id string, session_id string, idx int, role string, text string, ts long"


def test_artifacts_and_spans():
    text = "See src/a/b.py:12 and https://x.example/p/q.html, AB-12 then AB-12.\n```bash\n$ run it\nls src/in/fence.py\n```\n$ make all\nValueError: no\n    at f (x.js:1:2)\n"
    got = SX.artifacts_of(text)
    kinds = [a[0] for a in got]
    assert kinds.count("ticket_id") == 1 and kinds.count("shell_command") == 3 and kinds.count("code_block") == 1
    assert [a[2] for a in got if a[0] == "path_mention"] == ["src/a/b.py"]
    for kind, _, _, evidence, a, b in got:
        if a is not None and kind not in ("code_block", "shell_command"):
            assert text[a:b] == evidence
    red = SX.redact("a ```x\ny``` b", [(2, 11), (4, 6)])
    assert red == "a " + "    \n    " + " b" and len(red) == 13
    assert SX.artifacts_of("") == [] and SX.artifacts_of("``` open") == []


def test_artifact_frame(spark):
    df = spark.createDataFrame([("w", "AB-1 " * 3, 1), ("n", None, 1), ("e", "", 1)], "window_id string, text string, kind int")
    assert [(r.window_id, r.kind) for r in SX.artifacts(df).collect()] == [("w", "ticket_id")] and SX.artifacts(df.limit(0)).count() == 0


@pytest.mark.parametrize("least", [0.3, 0.78, 0.95])
def test_near_pairs_is_exact(spark, least, monkeypatch):
    monkeypatch.setattr(SM, "PART_ROWS", 16)
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(30, 8)), 5, axis=0) + 0.2 * rng.normal(size=(150, 8))
    rows = [(i, "ab"[i % 2], v.tolist(), 0) for i, v in enumerate(x)] + [(500, "a", None, 0), (501, "a", [], 0), (502, "a", [0.0] * 8, 0), (503, "a", [1.0] * 3, 0), (504, "b", [float("nan")] * 8, 0), (None, "a", [1.0] * 8, 0)]
    df = spark.createDataFrame(rows, "id long, block string, embedding array<double>, cosine int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if s[i, j] >= least}
    assert {(r.a, r.b) for r in SM.near_pairs(spark, df, least, pivots=7).collect()} == want
    assert {(r.a, r.b) for r in SM.near_pairs(spark, df, least, "block", pivots=7).collect()} == {p for p in want if p[0] % 2 == p[1] % 2}
    assert SM.near_pairs(spark, df.limit(0), least).count() == 0


def test_dedupe_flags_and_links(spark):
    v = lambda *x: [float(i) for i in x]
    items = spark.createDataFrame([("a", 1, v(1, 0)), ("b", 2, v(1, 0.01)), ("c", 3, v(0, 1)), ("d", 4, None)], "id string, created_at long, embedding array<double>")
    hist = spark.createDataFrame([("h", v(0.01, 1))], "id string, embedding array<double>")
    got = {r.id: (r.state, r.dup_of) for r in SM.dedupe_windows(spark, items, hist).collect()}
    assert got == {"a": ("kept", None), "b": ("batch", "a"), "c": ("prior", "h"), "d": ("kept", None)}
    labels = spark.createDataFrame([("c", "why"), ("a", None)], "window_id string, rationale string")
    f = SM.flag_duplicates(labels, SM.prior_duplicates(spark, items, hist))
    assert {r.window_id: r.rationale for r in f.collect()} == {"c": "why [dup_of:h]", "a": None} and [r.window_id for r in SM.unmarked(f).collect()] == ["a"]
    judged = spark.createDataFrame([("a", "b", 0.9, "same_as", 0.8), ("a", "c", 0.9, "none", 0.9), ("b", "c", 0.8, "variant_of", 0.4)], "a string, b string, cosine double, relation string, confidence double")
    assert [tuple(r) for r in SM.semantic_links(judged).collect()] == [("a", "b", "same_as", 0.72)]


def test_groups_match_union_find(spark):
    rnd = random.Random(4)
    e = [(f"{rnd.randrange(60):02}", f"{rnd.randrange(60):02}") for _ in range(45)] + [(f"c{i:02}", f"c{i + 1:02}") for i in range(20)] + [(None, "x"), ("y", "y")]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in e:
        if a and b and a != b:
            a, b = sorted((find(a), find(b)))
            up[b] = a
    df = spark.createDataFrame(e, "a string, b string")
    assert {(r.group_id, r.member) for r in G.linked_groups(spark, df).collect()} == {(find(x), x) for x in up}
    assert G.linked_groups(spark, df.limit(0)).count() == 0
    w = df.withColumn("weight", F.lit(1.0))
    assert G.suggested_groups(spark, w).count() == 0


def test_mentions_and_gaps(spark, monkeypatch):
    names = spark.createDataFrame([("users_accounts",), ("Order",), ("lost",), ("a",), ("",), (None,)], "name string")
    texts = spark.createDataFrame([("Every users_accounts row counts",), ("reORDERing",), (None,), ("",)], "text string")
    for block in (200_000, 2):
        monkeypatch.setattr(L, "NAMES_A_BLOCK", block)
        assert {r.name for r in L.mentioned(spark, names, texts).collect()} == {"users_accounts", "order", "a"}
    ents = spark.createDataFrame([("users_accounts", False), ("lost", False), ("tier", True)], "name string, external boolean")
    rel = spark.createDataFrame([("users_accounts", "tier"), ("lost", "users_accounts")], "src string, dst string")
    assert {tuple(r) for r in L.gaps(spark, ents, rel, texts).collect()} == {("external_ref", "tier", "users_accounts"), ("ungoverned", "lost", "")}


def test_relations_titles_and_evidence(spark):
    keys = spark.createDataFrame([("t1.c", "t2"), ("t1", "t2"), ("t2", "t2"), ("zz", "t1"), ("t1", "none")], "source string, target string")
    fields = spark.createDataFrame([("t1.c", "t1")], "child string, parent string")
    ents = spark.createDataFrame([("t1", "E1"), ("t2", "E2")], "node string, entity string")
    assert [tuple(r) for r in G.owned_relations(keys, fields, ents).collect()] == [("E1", "E2")]
    facts = spark.createDataFrame([("2", "Alpha"), ("1", "alpha"), ("3", None)], "id string, title string")
    assert [tuple(r) for r in G.ids_by_title(facts, spark.createDataFrame([("ALPHA",), ("x",), (None,)], "title string")).collect()] == [("ALPHA", "1")]
    claims = spark.createDataFrame([("Alpha", "alpha", "is here", 1), ("Alpha", "alpha", "absent", 1), ("Alpha", "Beta", "is here", 1), ("Alpha", "alpha", "", 1)], "src string, dst string, evidence string, text_id int")
    assert G.with_evidence(claims, facts, spark.createDataFrame([(1, "It IS HERE")], "text_id int, text string")).count() == 1


def test_incident_chains_and_verdicts(spark):
    i = spark.createDataFrame([("w", "Down", "Disk", "Grow it", "e"), ("w", "down", "disk", None, "e"), ("w", None, "x", "y", "e")], "window_id string, problem string, root_cause string, resolution string, evidence string")
    facts, edges = G.incident_chains(i)
    assert sorted(r.kind for r in facts.collect()) == ["incident", "root_cause", "solution"] and sorted(r.kind for r in edges.collect()) == ["caused_by", "resolves"]
    v = spark.createDataFrame([("a", "b", "superseded_by", 0.9), ("a", "c", "contradicts", 0.7), ("a", "d", "contradicts", 0.5), ("a", "e", "compatible", 0.9)], "a string, b string, verdict string, confidence double")
    assert {tuple(r) for r in G.verdict_edges(v).collect()} == {("b", "a", "supersedes"), ("a", "c", "contradicts")}


def test_text_functions(spark):
    one = spark.range(1)
    val = lambda c: one.select(c.alias("x")).collect()[0].x
    assert val(T.plain(F.lit("Škoda Łódź Ősz Ünï-x_y"))) == " skoda łodz osz uni x y "
    assert val(T.org_of_remote(F.lit("git@h.example:Org/repo.git"))) == "Org" and val(T.org_of_remote(F.lit("https://h.example/Org/repo/"))) == "Org" and val(T.org_of_remote(F.lit("nonsense"))) is None
    assert val(T.clamp(F.lit("x" * 100), 50)) == "x" * 9 + "\n...[trimmed]...\n" + "x" * 9 and val(T.clamp(F.lit("x"), 50)) == "x"
    assert val(T.known_level(F.lit(" Advanced-Beginner "))) == "advanced_beginner" and val(T.known_level(F.lit("guru"))) == "competent"
    assert val(T.written_fields(F.create_map(F.lit("a"), F.lit(" x "), F.lit("b"), F.lit(" ")))) == {"a": "x"}


def test_repeated_lines_match_a_loop(spark):
    rnd = random.Random(6)
    lines = ["a" * 25, "a" * 25 + "  ", "b" * 30, "---", "+++ ", "short", "", "c" * 21]
    texts = ["\n".join(rnd.choice(lines) for _ in range(rnd.randint(0, 14))) for _ in range(300)]

    def loop(t):
        kept, prev = [], ""
        for x in t.split("\n"):
            bare = x.rstrip()
            if (bare == prev and len(bare) > 20) or (len(bare) >= 3 and set(bare) <= set("-+") and kept):
                continue
            kept.append(x)
            prev = bare
        return "\n".join(kept)

    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.drop_repeated_lines("t").alias("x")).collect()
    assert {r.i: r.x for r in got} == {i: loop(t) for i, t in enumerate(texts)}


def test_segments_match_a_loop(spark, monkeypatch):
    monkeypatch.setattr(W, "CHUNK_IDX", 3)
    monkeypatch.setattr(W, "CHUNK_MS", 2)
    rnd = random.Random(8)
    rows = []
    for s in range(40):
        for k in range(rnd.randint(1, 14)):
            idx = rnd.choice([None, rnd.randint(0, 12)]) if s % 2 else k
            rows.append((f"{s}-{k}", f"s{s}", idx, rnd.choice(["user", " User", "assistant", "tool", None]), "t" * rnd.randint(0, 30), rnd.choice([None, rnd.randint(0, 9)])))
    want = set()
    for s in {r[1] for r in rows}:
        t = sorted((r for r in rows if r[1] == s), key=lambda r: (r[2] is None, r[2] or 0, r[2] is None and r[5] is None, (r[5] or 0) if r[2] is None else 0, r[0]))
        top = max((r[2] for r in t if r[2] is not None), default=-1)
        given = sum(r[2] is not None for r in t)
        at = [r[2] if r[2] is not None else top + n + 1 - given for n, r in enumerate(t)]
        begins = [n for n, r in enumerate(t) if (r[3] or "").strip().lower() == "user"]
        for a, b in zip(begins, [*begins[1:], len(t)]):
            kept, size = [], 0
            for n in range(a, b):
                if len(kept) < 4 and size < 40:
                    kept.append(n)
                size += len(t[n][4])
            if any((t[n][3] or "").strip().lower() in ("assistant", "tool") for n in kept):
                want.add((s, min(at[n] for n in kept), max(at[n] for n in kept), len(kept)))
    got = W.segment(spark.createDataFrame(rows, TURN), 4, 40)
    assert {(r.session_id, r.start_idx, r.end_idx, r.n_turns) for r in got.collect()} == want


def test_ingestible_is_one_limit_over_all(spark):
    s = spark.createDataFrame([("a", "x", 90, 1, 300), ("b", "y", 90, 2, 300), ("c", "x", None, 3, 300), ("d", "x", 90, 0, 10), ("e", "docs", 90, 0, 300), ("f", "x", 90, 0, None)], "id string, agent string, started_at long, ingested_at long, bytes long")
    assert [r.id for r in W.ingestible(s, 100, ("docs",), limit=2, days=1).collect()] == ["a", "b"]


def test_datasets(spark):
    skills = spark.createDataFrame([("Go", "language", 9.0, 2), ("Rust", "language", 4.0, 1), ("make", "tool", 0.5, 1), ("odd", None, 1.0, 1)], "name string, kind string, weight double, project_count int")
    a = DS.areas(skills)
    assert [(r.area, r.level, r.n) for r in a.orderBy("rank").collect()] == [("Languages", "expert", 2), ("Engineering Practices", "advanced_beginner", 1), ("Tooling & Infrastructure", "novice", 1)]
    h = DS.headline(a, spark.createDataFrame([], "name string, projects long"), 3).collect()[0]
    assert h.headline.startswith("Engineer working across multiple domains, strongest in Languages")
    assert DS.insights(skills).collect()[0].body.startswith("Go recur") and DS.insights(skills.limit(0)).count() == 0
    facts = spark.createDataFrame([("1", "knowledge_gap", " A ", "p"), ("2", "knowledge_gap", "a", "p"), ("3", "entity", "b", "p")], "id string, kind string, title string, project_id string")
    assert DS.open_gaps(facts).count() == 1 and FA.clusterable(facts).count() == 1
    assert [r.line for r in DS.export_json(facts.limit(1)).collect()] == ['{"id":"1","kind":"knowledge_gap","title":" A ","project_id":"p"}']


def test_online_waves_and_merges(spark):
    f = spark.createDataFrame([("p", "a", "k", 1, [1.0, 0.0]), ("p", "b", "k", 2, [0.7, 0.7]), ("p", "c", "k", 3, [0.9, 0.4]), ("p", "n", "k", 4, [float("nan"), 1.0])], "project_id string, id string, kind string, created_at int, embedding array<double>")
    run = lambda **kw: {r.id: r.concept for r in FA.online_clusters(f, **kw).collect()}
    assert run(wave=1) == {"a": "a", "b": "b", "c": "b", "n": "k (uncategorized)"}
    assert run(wave=1, attach=0.99, judge=lambda k, got: ("attach", "elsewhere")) == run(wave=1, attach=0.99, judge=lambda k, got: ("create",))
    merged = run(wave=1, attach=0.99, judge=lambda k, got: ("merge", got[0][0], got[1][0]) if len(got) > 1 else ("create",))
    assert merged["a"] == merged["b"] == merged["c"]


def test_symbols_outside_comments_and_strings(spark):
    from lorequarry.operators import links as LK
    from lorequarry.sources import code as C

    src = [
        ("a.ts", "// function gone() {}\nimport { x } from './m';\nfunction f(a) { g(\"h(1)\"); if (a) k.go(a) }\nconst s = `class No {}`;\n"),
        ("b.go", "package a\nimport \"fmt\"\n/* func no() {} */\nfunc G(x int) { fmt.Println('(') ; f(x) }\n"),
        ("c.rs", "use a::b;\nfn h<'a>(x: &'a str) { let c = '\"'; g(x) }\n"), ("d.java", "class D {\n  public int m(int a) { return n(a); } }"), ("e.ts", None),
    ]
    s = C.symbols(spark.createDataFrame(src, "path string, source string"))
    got = {(r.path, r.kind, r.name) for r in s.collect()}
    assert {("a.ts", "import", "./m"), ("a.ts", "function", "f"), ("a.ts", "call", "g"), ("a.ts", "call", "go"), ("b.go", "function", "G"), ("b.go", "call", "f"), ("c.rs", "function", "h"), ("c.rs", "call", "g"), ("d.java", "method", "m"), ("d.java", "call", "n"), ("b.go", "import", "fmt")} <= got
    assert not {n for _, _, n in got} & {"gone", "No", "no"} and ("a.ts", "call", "h") not in got and ("b.go", "call", "G") not in got and ("d.java", "call", "m") not in got
    states = {(r.caller, r.callee_name): (r.state, r.target) for r in LK.resolve_calls(*C.calls(s)).collect()}
    assert states["b.go", "f"] == ("resolved", "a.ts#f") and states["a.ts", "g"][0] == "open"
    assert {(r.src, r.kind) for r in C.code_edges(s).collect()} >= {("a.ts", "imports"), ("a.ts", "contains")}


def test_tail_spans(spark, tmp_path, monkeypatch):
    from lorequarry.sources import transcripts as TR

    monkeypatch.setattr(TR, "SPAN_BYTES", 7)
    monkeypatch.setattr(TR, "BLOCK_BYTES", 3)
    f = tmp_path / "a.jsonl"
    lines = ["x" * n for n in (0, 3, 6, 7, 20, 1)]
    f.write_text("\n".join(lines) + "\nunfinished")
    r = TR._TailReader(str(tmp_path))
    end = r.latestOffset()
    assert end == {str(f): sum(len(x) + 1 for x in lines)}
    assert [row[2] for p in r.partitions({}, end) for row in r.read(p)] == lines
    assert [row[2] for p in r.partitions({str(f): 5}, end) for row in r.read(p)] == lines[2:]
    (tmp_path / "b.jsonl").write_text("no break")
    assert r.latestOffset()[str(tmp_path / "b.jsonl")] == 0


def test_segments_as_turns_come(spark, tmp_path):
    from lorequarry.streaming import activity as ST

    (tmp_path / "in").mkdir()
    put = lambda rows: spark.createDataFrame(rows, TURN).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: ST.debounced_segments(spark.readStream.schema(TURN).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    first = [("1", "s", 0, "user", "q", 1), ("2", "s", 1, "assistant", "a", 2), ("3", "t", 0, "user", "q", 1), ("4", "t", 1, "tool", "a", 2)]
    more = [("5", "s", 2, "tool", "b", 3)]
    put(first), run(), put(more), run()
    got = {(r.session_id, r.start_idx, r.end_idx) for r in ST.current_windows(spark, f"{tmp_path}/out").collect()}
    assert got == {("s", 0, 2), ("t", 0, 1)}


def test_pipelines(spark):
    from lorequarry.plans import pipelines as P

    text = "The export fails because of a broken lock in src/a.ts. The fix is resolved in OPS-12 by a new lock."
    turns = spark.createDataFrame([("1", "s", 0, "user", text + " We decided to keep it.", 1), ("2", "s", 1, "assistant", "It needs to support `retry` in src/b.ts at once.", 2), ("3", "d", 0, "user", "# Runbook rollback", 1), ("4", "d", 1, "assistant", "steps", 2)], TURN)
    sessions = spark.createDataFrame([("s", "cursor"), ("d", "docs")], "id string, agent string")
    got = P.update(spark, turns, sessions, 10)
    assert {r.kind for r in got["incidents"].collect()} == {"incident", "root_cause", "solution"} and got["incident_edges"].count() == 2
    assert "decision" in {r.extractor for r in got["routed"].collect()} and got["sources"].collect()[0].doc_kind == "runbook"
    assert not got["health"].collect()[0].unhealthy
    files = spark.createDataFrame([("a.py", "1"), ("b.py", "2")], "path string, content_hash string")
    src = spark.createDataFrame([("a.py", "def f(): g()"), ("b.py", "def g(): pass")], "path string, source string")
    old, _ = P.sync(spark.createDataFrame([("a.py", "python", "function", "old", 1), ("gone.py", "python", "function", "x", 1)], "path string, language string, kind string, name string, line int"), files.limit(0), files, src)
    assert {(r.path, r.name) for r in old.where("kind = 'function'").collect()} == {("a.py", "f"), ("b.py", "g")}
    same, states = P.sync(old, files, files, src)
    assert same.count() == old.count() and states.where("state = 'resolved'").count() == 1
    facts = spark.createDataFrame([("1", "decision", "use locks always here", "", 0.9, "c", 1, 1), ("2", "decision", "use locks never here", "", 0.9, "c", 2, 2), ("3", "x", "weak", "", 0.1, None, 3, 3)], "id string, kind string, title string, summary string, confidence double, cluster_id string, created_at long, updated_at long")
    kept, edges = P.verify(facts, spark.createDataFrame([], "src string, dst string, kind string"), 10)
    assert kept.count() == 2 and {r.kind for r in edges.collect()} <= {"contradicts", "supersedes"}
    con = spark.createDataFrame([("c", 2, ""), ("e", 2, "known")], "id string, member_count int, summary string")
    assert [r.id for r in P.summarize(facts, con, 10).collect()] == ["c"]
    e = P.enrich(spark, spark.createDataFrame([("a.sql", "CREATE TABLE a (id INT REFERENCES b(id));")], "path string, source string"), spark.createDataFrame([("a",)], "text string"), spark.createDataFrame([("1", "A")], "id string, name string"))
    assert e["gaps"].count() == 1 and e["matches"].count() == 1
    mark = P.fingerprint(facts).collect()[0][0]
    assert P.enrich(spark, src, facts.select("title"), facts, mark, facts) is None
    assert P.analyse(files.withColumn("path", F.concat(F.lit("src/"), "path")), files.limit(0), "deep", 10).count() == 2
    reg = P.register(spark.createDataFrame([], "id string, name string, path string, registered_at long, last_seen_at long"), spark.createDataFrame([("/p", "p")], "path string, name string"), 5)
    again = P.register(reg, spark.createDataFrame([("/p", "p")], "path string, name string"), 9).collect()[0]
    assert (again.registered_at, again.last_seen_at) == (5, 9)


def test_config():
    from lorequarry.plans import config as K

    s = K.settings({"cluster": {"wave": 1, "attach": None}})
    assert s["cluster"]["wave"] == 1 and s["cluster"]["attach"] == 0.88 and K.DEFAULTS["cluster"]["wave"] == 4
    assert K.fingerprint({"a": 1, "b": 2}) == K.fingerprint({"b": 2, "a": 1}) != K.fingerprint({"a": 2, "b": 1})
    assert K.model_ref("local:name:7b") == ("local", "name:7b") and K.profile(" Deep ") == "deep" and K.profile(None) == "standard"
    for bad in (lambda: K.settings({"cluster": {"waves": 1}}), lambda: K.settings({"x": {}}), lambda: K.model_ref("none"), lambda: K.profile("x")):
        with pytest.raises(ValueError):
            bad()
