"""The nine operators on small fixtures with the hard cases, against brute force where there is one."""
import ast
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorequarry.llm import conversations, groups, history, mixing, neighbours, pii, splitting, tokens, validity
from lorequarry.llm.grammars import EXTENSIONS, grammar

HAVE_TOKENS = os.path.exists(os.path.join(tokens.TOKENIZERS, tokens.VOCABULARY))
needs_tokens = pytest.mark.skipif(not HAVE_TOKENS, reason="no vocabulary files")
TURN = "id string, session_id string, idx int, role string, text string, ts long, raw string"
PEOPLE = "person_id int, given_name string, family_name string, handle string"


# ---- 1 ----


@pytest.mark.parametrize(
    "text,kinds",
    [
        ("mail a.b+c@site.example now", {"email"}), ("see https://x.example/?to=ann%40site.example&r=1", {"email"}), ("ann (at) site [dot] example", {"email"}),
        ("git@forge.example:team/x.git and pkg@2.10.1", set()), ("call +44 20 7946 0123", {"phone"}), ("(212) 555-0100 or 020 7946 0123", {"phone"}), ("run 7312559865 at 10.14.122-rc2", set()),
        ("SSN 912-34-5678", {"id_number"}), ("ISBN-like 978-0-00-345000-0 and build 2025-03-756", set()), ("Steuer-ID: 02 788 036 025;", {"id_number"}), ("passport no. AB12345", {"id_number"}), ("my passport C4KJ7P2R1 is lost", {"id_number"}), ("the passport was renewed", set()), ("passport no. X9Z999999", {"id_number"}),
        ("at 12 Baker Street, Town", {"address"}), ("12 bis, rue du Lac, 99001 Ville", {"address"}), ("Hauptstr. 7b, 09123 Ort", {"address"}), ("See section 7 Road map. Copy 776 files to Drive E.", set()), ("", set()),
    ],
)
def test_written_forms(text, kinds):
    assert {k for _, _, k in pii.written_forms(text)} == kinds


def test_unescape_keeps_positions():
    raw = '{"t":"caf\\u00e9 \\"x\\" \\\\n a@b.example","u":"{\\\\"m\\\\": \\\\"c@d.example\\\\"}"'
    u = pii.Unescaped(raw)
    for m in re.finditer(r"[ac]@[bd]\.example", u.text):
        assert raw[u.origin(m.start()) : u.origin(m.end())] == m.group()


def test_pii_end_to_end(spark):
    rnd = random.Random(1)
    syl = ["Zor", "Wex", "Quil", "Nad", "Tam", "Bre", "Hal", "Osk"]
    people = [(i, rnd.choice(syl) + rnd.choice(["ra", "mo", "lo", "ne"]) + rnd.choice(["en", "is", "or", "ia"]), rnd.choice(syl) + rnd.choice(["vi", "da", "ki"]) + rnd.choice(["grove", "holt", "wick"]), None) for i in range(60)]
    words = "the cache index throttle window keeps every session while our journal drops stale batch label merge".split()
    rows = [(f"f{i}", "s", i, "user", " ".join(rnd.choice(words) for _ in range(30)).capitalize(), 1, None) for i in range(400)]
    g, f = people[0][1], people[0][2]
    rows += [
        ("n1", "s", 1, "user", f"reported by {g} {f}, who left", 1, f'{{"text":"reported by {g} {f}, who left","by":"x@y.example"}}'), ("n2", "s", 1, "user", f"{f.upper()}, {g.upper()} said so", 1, None),
        ("n3", "s", 1, "user", f"{g} says it is fine", 1, None), ("n4", "s", 1, "user", None, None, None), ("n5", None, None, None, "", None, '{"cut'), ("n6", "s", 1, "user", f"ask {g[0]}. {f} for it", 1, None),
    ]
    rows.append(rows[-1])
    t, p = spark.createDataFrame(rows, TURN).withColumn("items", F.lit(1)), spark.createDataFrame(people, PEOPLE)
    got = {(r.turn_id, r.field, r.kind) for r in pii.found(spark, t, p).collect()}
    assert got == {("n1", "text", "name"), ("n1", "raw", "name"), ("n1", "raw", "email"), ("n2", "text", "name"), ("n6", "text", "name")}
    red = {r.id: r for r in pii.redact(spark, t, p).collect()}
    assert red["n1"].text == "reported by <NAME>, who left" and red["n1"].raw == '{"text":"reported by <NAME>, who left","by":"<EMAIL>"}' and red["n4"].text is None
    assert pii.found(spark, t.limit(0), p).count() == 0


# ---- 2 ----


def test_conversations(spark):
    say = lambda s, rows: [(f"{s}-{i}", s, x, r, t, ts, None) for i, (x, r, t, ts) in enumerate(rows)]
    big = [(i, "user" if i % 2 == 0 else "assistant", "x", None) for i in range(conversations.CHUNK_IDX * 2 + 2)]
    rows = (
        say("ok", [(0, " User", "a", 5), (1, "tool", "", 3), (2, "assistant", "b", None)]) + say("gap", [(0, "user", "a", 1), (2, "assistant", "b", 2)]) + say("open", [(0, "user", "a", 1), (1, "assistant", "b", 2), (2, "user", "c", 3)])
        + say("byts", [(None, "assistant", "b", 9), (None, "user", "a", 1)]) + say("tie", [(None, "user", "a", 1), (None, "assistant", "b", 1)]) + say("mixed", [(0, "user", "a", 1), (None, "assistant", "b", 2)])
        + say("role", [(0, "user", "a", 1), (1, None, "b", 2)]) + say("blank", [(0, "user", " \n", 1), (1, "assistant", "b", 2)]) + say("big", big) + say("notime", [(None, "user", "a", None), (None, "assistant", "b", 2)])
    )
    rows += rows[:3] + [("x", None, 0, "user", "a", 1, None), ("y", "unknown", 0, "user", "a", 1, None)]
    random.Random(2).shuffle(rows)
    turns = spark.createDataFrame(rows, TURN)
    ids = ["ok", "gap", "open", "byts", "tie", "mixed", "role", "blank", "big", "none", "notime", "ok", None]
    sessions = spark.createDataFrame([(i,) for i in ids], "id string")
    assert {r.session_id for r in conversations.broken_sessions(spark, turns, sessions).collect()} == {"gap", "open", "tie", "mixed", "role", "blank", "none", "notime"}
    c = conversations.conversations(spark, turns, sessions)
    assert [(r.turn_id, r.role) for r in c.where("session_id = 'byts'").orderBy("position").collect()] == [("byts-1", "user"), ("byts-0", "assistant")]
    big_rows = c.where("session_id = 'big'").orderBy("position").collect()
    assert [r.position for r in big_rows] == list(range(len(big))) and all(r.turn_id == f"big-{r.position}" for r in big_rows)


def test_late_rows_wait_and_lost_ones_are_left_out(spark, tmp_path):
    hour = 3_600_000
    row = lambda s, i, r, ts: (f"{s}-{i}", s, i, r, "x", 240 * hour + ts, None)
    batches = [
        [row("a", 0, "user", hour), row("a", 1, "assistant", hour + 1), row("b", 0, "user", 2 * hour)],
        [row("a", 2, "user", hour + hour // 2), row("b", 1, "assistant", 2 * hour + 1)],  # late, but within the hour
        [row("c", 0, "user", 10 * hour), row("c", 1, "assistant", 10 * hour + 1)],
        [row("e", 0, "user", 11 * hour)],  # the watermark of one batch holds from the next one on
        [row("e", 1, "assistant", 11 * hour + 1)],
        [row("a", 3, "assistant", hour), row("e", 2, "user", 11 * hour + 2)],  # a's row comes too late
        [row("d", 0, "user", 30 * hour)],
        [row("d", 1, "assistant", 30 * hour + 1)],
    ]
    (tmp_path / "in").mkdir()
    got, held = {}, []

    def keep(df, k):
        got.update({r.session_id: (k, r.n, r.users, r.last) for r in df.collect()})

    stream = conversations.chunk_stream(spark.readStream.schema(conversations.LIGHT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), "1 hour")
    q = None
    for k, b in enumerate(batches):
        conversations.light_rows(spark.createDataFrame(b, TURN), 3).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination()
        held.append(set(got))
    assert got["a"][1:] == (3, 2, 1) and got["b"][1:] == (2, 1, 2) and got["c"][1:] == (2, 1, 2)
    assert {"a", "b"} <= held[5] and "d" not in got  # closed chunks leave the state as the watermark passes, open ones stay


# ---- 3 ----

VALID = {
    "typescript": ["", "// only\n", "const re = /[{(]x/g, a = b / c / d;", "let s = `a ${b + `c${d}`} }`;", "export interface A<T> { readonly id: string; f?(x: T): void }", "const f = async <T,>(a: T, b?: number): Promise<T> => a as T;", "class A extends B<C> implements D { private x = 1; get y(): number { return this.x } }", "type X = { [K in keyof T]?: T[K] } | 'a' | `b${string}`;", "for (const [k, v] of m) if (k < v) break\nfoo()\n", "enum E { A = 1, B }\ndeclare module 'x' { export const y: number }"],
    "tsx": ["const a = <div className=\"x\" {...p}>{rows.map((r) => <li key={r}>{r} text's</li>)}<br/></div>;", "const b = <>text</>;"],
    "javascript": ["export default class { #a = 1; static async *g() { yield* this.#a } }", "label: while (1) { continue label }", "var a = b\n/c/g\nlet {x, ...y} = z?.[0]?.w ?? 1;"],
    "go": ["package a", "package a\n\nimport (\n\t\"fmt\"\n)\n\ntype S struct {\n\tA, B int `json:\"a\"`\n\tC map[string][]byte\n}\n\nfunc (s *S) F(x ...int) (n int, err error) {\n\tfor i, v := range x {\n\t\tif v := s.A; v > i {\n\t\t\treturn 0, fmt.Errorf(\"%d {\", v)\n\t\t}\n\t}\n\tm := map[string]S{\"a\": {A: 1}}\n\tswitch t := y.(type) {\n\tcase int:\n\t}\n\tgo func() { <-c }()\n\treturn\n}\n"],
    "rust": ["use std::{a, b::*};\n#[derive(Debug)]\npub struct A<'a, T: B + 'a> where T: C { pub x: &'a [T] }", "fn f(x: &mut Vec<u8>) -> Result<(), Box<dyn E>> { let y = if x.len() > 1 { 'a' } else { '\\n' }; match y { 'a'..='z' | 'A' if true => return Ok(()), k => println!(\"{} }}\", k), } for i in 0..10 { x[i] += 1; } Ok(()) }", "/* a /* nested */ b */ fn main() {}"],
    "java": ["package a.b;\nimport java.util.*;\npublic class A<T extends B> { static int f(List<String> r, int... n) { for (String s : r) { if (s.length() > 1) { throw new X(\"{\" + s); } } var y = (int) 1L; return r.stream().map(x -> x + 1).map(String::valueOf).count() > 0 ? 1 : 2; } enum E { A, B; } record R(int x) {} }"],
    "csharp": ["using System;\nnamespace A.B\n{\n    public class C<T> : D where T : new()\n    {\n        public int X { get; set; } = 1;\n        public int F(IEnumerable<string> r, int n)\n        {\n            foreach (var s in r) { if (s.Length > n) throw new E($\"{s} > {n:0.0} {{\"); }\n            var q = r.Where(x => x != null)?.Count() ?? 0;\n            return q is > 1 and < 3 ? 1 : 2;\n        }\n    }\n}\n"],
    "sql": ["-- only", "CREATE TABLE t (id INT PRIMARY KEY, s VARCHAR(9) DEFAULT '(', n NUMERIC(10, 2) CHECK (n >= 0), FOREIGN KEY (id) REFERENCES u(id) ON DELETE CASCADE);", "SELECT a.id, COUNT(*) AS n FROM t AS a LEFT JOIN u ON a.id = u.id WHERE a.x > 1 -- it's\nGROUP BY a.id HAVING COUNT(*) > 1 ORDER BY 2 DESC LIMIT 5;", "INSERT INTO c VALUES (1, 'O''X'); CREATE INDEX i ON t (id, n);"],
}
INVALID = {
    "typescript": ["const a = {", "<<<<<<< HEAD\nlet a;\n", "def f(x):\n    pass\n", "const s = 'open\n", "function f( { return 1 }"], "tsx": ["const a = <div><b></div"], "javascript": ["export interface A { x: string }", "{\n  \"name\": \"x\", \"v\": 1\n}", "const f = (v: string) => v;"],
    "go": ["", "# heading\n", "package a\n\nfunc f() {\n", "package a\n=======\n"], "rust": ["fn f() {", "{ \"a\": 1 }", "let x = 1;", "/* open"], "java": ["class A { int x = ; }", "int f() {", "using System;"], "csharp": ["class A { void F() { ", "package a.b;\nclass X {}\n"], "sql": ["jobs:\n  a: b\n", "CREATE TABLE t (\n", "SELECT FROM", "import os\n"],
}
INVALID["go"] = INVALID["go"][1:]


@pytest.mark.parametrize("lang", sorted(VALID))
def test_grammars(lang):
    for s in VALID[lang]:
        assert grammar(lang).parse(s) == -1, s
        assert grammar(lang).parse(s.replace("\n", "\r\n")) == -1, s
    for s in INVALID[lang]:
        assert grammar(lang).parse(s) >= 0, s


def test_python_grammar_agrees_with_ast():
    good = open(splitting.__file__).read() + "\n" + open(pii.__file__).read()
    sources = ["", "# x", "x: int = 1\n", "async def f(a, /, b=1, *c, d, **e) -> int:\n    async with a as b, c: await d\n    return [x async for x in y if x]\n", "match x:\n    case {'a': [1, *r]} if r: pass\n    case _: pass\n", "lambda *a, b=1: (yield)\n", "if x:\npass", "def f(:\n  pass", "f'{a!r:>{w}}'\n", "x = (1,\n", "class A(B, metaclass=C): x = y = 1; z += 2\n", "try:\n    pass\n", "a if b\n", "print(*a, **b, c=1)\n", "with (a as b, c as d): pass\n", "\tx\n", "x = '''open\n", "for a, *b in c: continue\nelse: pass\n", "@d.e(1)\ndef f(): ...\n", "x[1:2, ::3, ...]\n", "not in x\n", "global\n"]
    for s in [*sources, good, good[: len(good) // 2], good[: len(good) // 3]]:
        try:
            ast.parse(s)
            ok = True
        except SyntaxError:
            ok = False
        assert (grammar("python").parse(s) < 0) == ok, s[-200:]


def test_flags_and_rates(spark):
    src = spark.createDataFrame([("/r/a/x.ts", "let a = 1"), ("/r/a/y.TS", "<<<<<<< HEAD\nlet a\n"), ("/r/a/z.py", "def f(:\n"), ("/q/w.txt", "?"), ("/r/a/e.go", None)], "path string, source string")
    files = spark.createDataFrame([("/r/a/x.ts", 1, "[]"), ("/r/a/x.ts", 2, None), ("/r/a/y.TS", 1, None), ("/r/a/z.py", 1, None), ("/q/w.txt", 1, None), (None, 1, None)], "path string, indexed_at long, errors string")
    proj = spark.createDataFrame([("/r",), ("/r/a",)], "path string")
    f = {r.path: (r.repository, r.invalid, r.cause) for r in validity.file_flags(files, src, proj).collect()}
    assert f["/r/a/x.ts"] == ("/r/a", False, None) and f["/r/a/y.TS"] == ("/r/a", True, "merge conflict") and f["/q/w.txt"] == (None, None, None) and f["/r/a/z.py"][1]
    assert {(r.language, r.files, r.invalid_files) for r in validity.rates(files, src, proj).collect()} == {("typescript", 2, 1), ("python", 1, 1)}
    assert set(EXTENSIONS.values()) == set(VALID) | {"python"}


# ---- 4 ----


def test_history_matches_brute_force(spark):
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(60)]
    base = [[rnd.choice(vocab) for _ in range(rnd.randint(30, 60))] for _ in range(25)]
    rows, sess = [], []
    for b in range(4):
        for k in range(30):
            w = list(rnd.choice(base))
            for _ in range(rnd.choice([0, 0, 1, 2, 4, 12])):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            rows.append((f"{b}-{k}", f"s{b}", k, rnd.choice(["user", " Assistant ", "tool"]), " ".join(w), 1, None))
        sess.append((f"s{b}", b, "p"))
    rows += [("short", "s3", 1, "user", "too few words", 1, None), ("null", "s3", 1, "user", None, 1, None), ("lost", "nosession", 1, "user", " ".join(base[0]), 1, None), ("same", "s3", 1, "user", " ".join(["a"] * 40), 1, None)]
    turns, sessions = spark.createDataFrame(rows, TURN), spark.createDataFrame(sess, "id string, ingested_at long, source_path string")
    docs = {r[0]: (int(r[1][1:]), set(zip(w, w[1:], w[2:]))) for r in rows if r[1] in ("s0", "s1", "s2", "s3") and r[3].strip().lower() in ("user", "assistant") and r[4] and len(w := r[4].split()) >= 30}
    want = {i for i, (b, s) in docs.items() if any(c < b and len(s & t) / len(s | t) >= 0.7 for c, t in docs.values())}
    got = {r.turn_id for r in history.repeated_turns(spark, turns, sessions).collect()}
    assert want and got == want
    assert history.repeated_turns(spark, turns.limit(0), sessions).count() == 0


def _near_copies(n, seed, words=120, changes=3):
    rnd = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(changes):
            w[rnd.randrange(words)] = f"x{rnd.randrange(10**9)}"
        out.append(" ".join(w))
    return out


DOC = "doc_id string, batch long, text string"


def test_history_reopens_with_what_it_was_made_with(spark, tmp_path):
    rnd = random.Random(11)
    texts = [" ".join(f"v{rnd.randrange(900)}" for _ in range(45)) for _ in range(200)]
    path = f"file://{tmp_path}/index"
    first = history.HistoryIndex(spark, path, ranges=4)
    assert first.accept("a", spark.createDataFrame([(f"a{i}", 1, t) for i, t in enumerate(texts)], DOC)).count() == 0
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = history.HistoryIndex(spark, path)
        assert again.settings["ranges"] == 4
        near = [(f"n{i}", 2, t + " more") for i, t in enumerate(texts[:50])]
        got = {r.doc_id for r in again.accept("b", spark.createDataFrame([(f"b{i}", 2, t) for i, t in enumerate(texts)] + near, DOC)).collect()}
        assert got == {f"b{i}" for i in range(200)} | {f"n{i}" for i in range(50)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    with pytest.raises(ValueError):
        history.HistoryIndex(spark, path, percent=80)
    third = history.HistoryIndex(spark, path)
    assert third.entries() == ["a", "b"]
    assert {r.doc_id for r in third.accept("b", spark.createDataFrame([], DOC)).collect()} == got  # an entry is accepted once
    with pytest.raises(ValueError):
        third.accept("c", spark.createDataFrame([("c", 2, texts[0])], DOC))  # not later than what was accepted
    assert third.accept("d", spark.createDataFrame([("d", 3, None), ("e", None, texts[0])], DOC)).count() == 0


def test_an_entry_without_its_mark_is_no_part_of_the_index(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    text = _near_copies(2, 12)
    index = history.HistoryIndex(spark, path, ranges=2)
    index._complete = lambda entry: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        index.accept("a", spark.createDataFrame([("a", 1, text[0])], DOC))
    again = history.HistoryIndex(spark, path)
    assert again.entries() == [] and again.accept("a", spark.createDataFrame([("a", 1, text[0])], DOC)).count() == 0
    assert [r.doc_id for r in again.accept("b", spark.createDataFrame([("b", 2, text[1])], DOC)).collect()] == ["b"]


def test_history_in_one_entry_or_in_many(spark, tmp_path):
    rnd = random.Random(13)
    base = [[f"w{rnd.randrange(80)}" for _ in range(40)] for _ in range(12)]
    rows = []
    for b in range(4):
        for k in range(25):
            w = list(rnd.choice(base))
            for _ in range(rnd.choice([0, 1, 2, 3, 5])):
                w[rnd.randrange(len(w))] = f"w{rnd.randrange(80)}"
            rows.append((f"{b}-{k}", b, " ".join(w)))
    sets = {i: (b, set(zip(t.split(), t.split()[1:], t.split()[2:]))) for i, b, t in rows}
    want = {i for i, (b, s) in sets.items() if any(c < b and len(s & t) / len(s | t) >= 0.7 for c, t in sets.values())}
    df = spark.createDataFrame(rows, DOC)
    whole = history.HistoryIndex(spark, f"file://{tmp_path}/one", ranges=3)
    assert {r.doc_id for r in whole.accept("all", df).collect()} == want
    parts = history.HistoryIndex(spark, f"file://{tmp_path}/many", ranges=3)
    got = set()
    for b in range(4):
        parts = history.HistoryIndex(spark, f"file://{tmp_path}/many")
        got |= {r.doc_id for r in parts.accept(f"batch-{b}", df.where(F.col("batch") == b)).collect()}
    assert got == want


def test_families_of_near_copies_stay_linear(spark, tmp_path, monkeypatch):
    texts = _near_copies(600, 14)
    rows = [(f"{i}", 1 + i // 300, t) for i, t in enumerate(texts)]
    for entries in (["all"], ["one", "two"]):
        index = history.HistoryIndex(spark, f"file://{tmp_path}/{len(entries)}", ranges=2)
        got, pairs = set(), 0
        for k, e in enumerate(entries):
            part = rows if len(entries) == 1 else rows[300 * k : 300 * (k + 1)]
            got |= {r.doc_id for r in index.accept(e, spark.createDataFrame(part, DOC)).collect()}
            pairs += sum(index.pairs)
        assert got == {str(i) for i in range(300, 600)} and pairs <= 1000
    monkeypatch.setattr(history, "CELL_ROWS", 16)  # heavy cells in parts
    monkeypatch.setattr(history.HistoryIndex, "_can", lambda self, q, h: F.lit(True) if h == "h" else F.lit(False))
    index = history.HistoryIndex(spark, f"file://{tmp_path}/parts", ranges=2)
    assert index.accept("all", spark.createDataFrame(rows[270:330], DOC)).count() == 30 and index.pairs[0] == 0


# ---- 5 ----


@pytest.mark.parametrize("growth", [0, 2, groups.GROWTH, 10_000])
def test_components(spark, growth):
    rnd = random.Random(5)
    n = 80
    e = [(f"{i:03}", f"{i + 1:03}") for i in range(30)] + [(f"{rnd.randrange(40, n):03}", f"{rnd.randrange(40, n):03}") for _ in range(25)] + [("000", "000"), (None, "001"), ("001", "000"), ("000", "001")]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in e:
        if a and a != b:
            a, b = sorted((find(a), find(b)))
            up[b] = a
    got = groups.components(spark, spark.createDataFrame(e, "u string, v string"), growth)
    assert {(r.group_id, r.vertex) for r in got.collect()} == {(find(x), x) for x in up}


def test_group_concepts_filters(spark):
    links = spark.createDataFrame([(1, "a", "b", " Same-AS "), (2, "b", "c", "variant_of"), (3, "c", "zz", "same_as"), (4, "d", "d", "same_as"), (5, None, "a", "same_as")], "id long, a string, b string, kind string")
    con = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("a",), (None,)], "id string")
    assert {tuple(r) for r in groups.group_concepts(spark, links, con).collect()} == {("a", "a"), ("a", "b")}
    assert groups.group_concepts(spark, links.limit(0), con).count() == 0


# ---- 6 ----


def test_neighbours_recall_copies_and_nulls(spark):
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(60, 64))
    x = np.repeat(centers, 6, axis=0) + 0.25 * rng.normal(size=(360, 64))
    rows = [(f"c{i:04}", v.astype(np.float32).tolist(), 1) for i, v in enumerate(x)]
    rows += [(f"d{i:04}", rows[0][1], 1) for i in range(9)] + [("c0001", [1.0] * 64, 0), ("z", [0.0] * 64, 1), ("n", None, 1), ("s", [1.0] * 32, 1), ("e", [], 1)]
    df = spark.createDataFrame(rows, "id string, embedding array<float>, updated_at long")
    got = {tuple(r) for r in neighbours.similar_pairs(spark, df).collect()}
    ids = [r[0] for r in rows[:369]]
    v = np.array([r[1] for r in rows[:369]], dtype=np.float32).astype(np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    s = v @ v.T
    s[s > 1 - 1e-12] = 1.0
    np.fill_diagonal(s, -2)
    want = set()
    for i in range(len(ids)):
        for j in sorted(range(len(ids)), key=lambda j: (-s[i, j], ids[j]))[:5]:
            if s[i, j] >= 0.86:
                want.add(tuple(sorted((ids[i], ids[j]))))
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)
    assert neighbours.similar_pairs(spark, df.limit(0)).count() == 0


def test_visits_are_those_of_a_priority_queue():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 8))
    f = neighbours.Forest(x, 3, 20)
    seen = f.visit(x[:20], 9)
    for i in range(20):
        heap, want = [(-np.inf, r) for r in f.roots], []
        while heap:
            heap.sort()
            d, node = heap.pop(0)
            if node < 0:
                want.append((d, ~node))
                continue
            m = float(np.float32(x[i].astype(np.float32) @ f.w[node] - f.b[node]))
            near, far = f.sides[node][1 if m > 0 else 0], f.sides[node][0 if m > 0 else 1]
            heap += [(max(d, -abs(m)), int(near)), (max(d, abs(m)), int(far))]
        key = {leaf: max(d, 0.0) for d, leaf in want}  # equal keys may change places
        assert np.allclose(sorted(key[leaf] for leaf in seen[i].tolist()), [max(d, 0.0) for d, _ in want[:9]], atol=1e-5)
        assert {leaf for d, leaf in want if d < 0} == set(seen[i, :3].tolist())
    assert (f.visit(x[:5], 10**6) >= 0).all() and f.visit(x[:0], 5).shape[0] == 0


def test_grown_leaves_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(16)
    x = np.repeat(rng.normal(size=(500, 64)), 4, axis=0) + 0.3 * rng.normal(size=(2000, 64))
    df = spark.createDataFrame([(f"c{i:04}", v.astype(np.float32).tolist(), 1) for i, v in enumerate(x)], "id string, embedding array<float>, updated_at long")
    v = x.astype(np.float32).astype(np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    s = v @ v.T
    np.fill_diagonal(s, -2)
    want = {tuple(sorted((f"c{i:04}", f"c{j:04}"))) for i in range(2000) for j in np.argsort(-s[i])[:5] if s[i, j] >= 0.86}
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 300)
    got = {tuple(r) for r in neighbours.similar_pairs(spark, df, fit_rows=40, leaf_rows=32).collect()}
    assert len(want) > 1000 and len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


# ---- 7 ----


@needs_tokens
def test_encoding_agrees_with_the_library():
    tk = pytest.importorskip("tokenizers")
    t = tk.Tokenizer.from_file(os.path.join(tokens.TOKENIZERS, tokens.VOCABULARY))
    t.encode_special_tokens = True
    a, rnd = tokens.automaton(), random.Random(7)
    texts = ["", "<|endoftext|> x", "it's  we'll\n\n\tx ", "é中😀 \x85　x", "a" * 3000, "the quick " * 500, "\U000e0001‍"]
    texts += ["".join(rnd.choice(al) for _ in range(rnd.randint(0, 30))) for al in ("ab", "abcde ", "the ing", "é中 \n", "01 ,", "'sdmtlvre ") for _ in range(200)]
    for x, e in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
        assert a.encode(x).tolist() == e.ids and a.decode(e.ids) == x


@needs_tokens
def test_the_vocabulary_goes_to_the_workers(spark, tmp_path):
    import shutil

    path = tmp_path / "vocabulary.json"
    shutil.copy(os.path.join(tokens.TOKENIZERS, tokens.VOCABULARY), path)
    out = tokens.encode(spark.createDataFrame([(1, "hello world")], "doc_id long, text string"), str(path))
    path.unlink()  # read by the driver when the query was made
    assert out.collect()[0].ids == [31373, 995]


@needs_tokens
def test_encode_frame(spark):
    df = spark.createDataFrame([(1, "hello world", 1), (2, "", 1), (3, None, 1), (1, "hello world", 1)], "doc_id long, text string, ids int")
    got = [(r.doc_id, r.ids) for r in tokens.encode(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, [31373, 995]), (1, [31373, 995]), (2, []), (3, [])]))
    assert {r.text for r in tokens.decode(tokens.encode(df)).collect()} == {"hello world", ""}
    assert tokens.encode(df.limit(0)).count() == 0


# ---- 8 ----


def test_water_filling():
    w = mixing.water_fill(100, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1000, "b": 10, "c": 1000})
    assert w["b"] == 10 and w["a"] == pytest.approx(90 * 5 / 7) and sum(w.values()) == pytest.approx(100)
    assert mixing.water_fill(100, {"a": 1.0, "z": 1.0}, {"a": 30, "z": 0}) == {"a": 30, "z": 0.0}
    assert mixing.water_fill(10, {}, {}) == {}


@needs_tokens
def test_mix(spark):
    rows = [(i, "word " * (10 + i % 7), ["big", "Small-one", " small_one"][0 if i % 10 else 1 + i % 2], None) for i in range(600)] + [(900, None, "big", None), (901, "", "big", None), (902, "x", None, None), (903, "x y", "other", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    goal = spark.createDataFrame([("big", 0.6, 1), ("small_one", 0.3, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    m = mixing.mix(spark, docs, goal, total=3000).collect()
    by = {}
    for r in m:
        by[r.source] = by.get(r.source, 0) + r.n_tokens * r.copies
        assert 0 < r.copies <= (1 if r.source == "big" else 3)
    assert len({r.doc_id for r in m}) == len(m) and not {900, 901, 902, 903} & {r.doc_id for r in m}
    assert by["big"] == pytest.approx(2000, abs=17) and by["small_one"] == pytest.approx(1000, abs=17)
    s = {r.source: r.actual_share for r in mixing.shares(spark, docs, goal, total=3000).collect()}
    assert sum(s.values()) == pytest.approx(1) and s["absent"] == 0
    again = mixing.mix(spark, docs, goal, total=3000).collect()
    assert sorted(map(tuple, m)) == sorted(map(tuple, again)) and mixing.mix(spark, docs.limit(0), goal).count() == 0


# ---- 9 ----


@needs_tokens
def test_pieces():
    a = tokens.automaton()
    text = "\n\n".join("A sentence of some words that goes on. Another one, shorter! And a third?" for _ in range(40))
    for t, limit, overlap in [(text, 64, 8), (text, 50, 0), ("x" * 5000, 40, 10), ("日本語の文字列" * 300, 40, 8), ("😀👩‍💻" * 200, 40, 6), ("word " * 2000, 100, 20), (" \n" * 900, 30, 4), ("a" * 3 + "\n\n" + "b " * 300, 33, 9)]:
        ps = splitting.pieces(a, t, limit, overlap)
        assert ps[0][0] == 0 and ps[-1][1] == len(t) and all(len(a.encode(t[x:y])) == n <= limit for x, y, n, _ in ps)
        for (x, y, _, _), (u, v, _, _) in zip(ps, ps[1:]):
            assert x < u <= y < v
            if overlap:
                assert overlap <= len(a.encode(t[u:y])) <= overlap + 3 or not t.strip()
    assert {p[3] for p in splitting.pieces(a, text, 64, 8)} <= {"paragraph", "sentence", "end"}
    assert splitting.pieces(a, "short", 64, 8) == [] and splitting.pieces(a, "", 64, 8) == []


@needs_tokens
def test_split_documents(spark):
    docs = spark.createDataFrame([(1, "word " * 300, "Big-one", 1), (2, "word " * 300, None, 1), (3, None, "x", 1), (4, "", "x", 1), (5, "few", "x", 1)], "doc_id long, text string, source string, piece int")
    lim = spark.createDataFrame([("big_one", 500, 10), (None, 100, 10)], "source string, max_tokens int, overlap_tokens int")
    r = splitting.split_documents(docs, lim).collect()
    assert {x.doc_id for x in r} == {2} and all(x.n_tokens <= 100 for x in r)
    with pytest.raises(ValueError):
        splitting.split_documents(docs, spark.createDataFrame([("a", 10, 10)], lim.schema))


@needs_tokens
def test_plan_costs_as_little_as_over_all_positions():
    a, rnd = tokens.automaton(), random.Random(9)
    words = ["alpha", "beta.", "gamma,\n", "delta!\n\n", "ünïcödé", "x" * 70, "日本語の文。", "a_b/c", "😀"]
    for _ in range(60):
        text = "".join(rnd.choice(words) + rnd.choice([" ", " ", ""]) for _ in range(rnd.randint(150, 500)))
        limit = rnd.choice([24, 48, 96, 200])
        overlap = rnd.choice([0, 4, limit // 4, limit - 10])
        w = splitting.split(text)
        packs = list(map(a.packed, w))
        lens = np.array([len(p) >> 2 for p in packs])
        pos, lev, at_char, *_ = splitting.boundaries(a, text, w, packs, lens)
        assert all(len(text[: at_char[p]].encode()) == sum(map(len, map(a.labels.get, np.frombuffer(b"".join(packs), dtype=np.int32)[:p].tolist()))) for p in pos[:: max(1, len(pos) // 20)])
        assert set(pos.tolist()) == set(np.flatnonzero(at_char[1:] >= 0) + 1)
        whole, total = {0, *pos.tolist()}, int(pos[-1])
        begin = [next(q for q in range(max(p - overlap, 0), -1, -1) if q in whole) for p in pos.tolist()]
        pen, target = splitting.PENALTY[lev].copy(), (total + overlap) / max(2, -(-(total - overlap) // (limit - overlap)))
        pen[-1] = 0
        scale, s = splitting.IMBALANCE / limit**2, np.array([0, *begin])
        cost = np.append(0.0, np.full(len(pos), np.inf))
        for k, p in enumerate(pos.tolist()):  # every earlier position is tried
            c = np.where(p - s[: k + 1] <= limit, cost[: k + 1] + scale * (p - s[: k + 1] - target) ** 2, np.inf)
            cost[k + 1] = c.min() + pen[k]
        keep = splitting._needed(pos, lev, limit, overlap)
        back = np.array(begin)[keep].tolist()
        plan = splitting._best(pos[keep].tolist(), splitting.PENALTY[lev[keep]].tolist(), back, limit, target)
        got, at = 0.0, 0
        for k in plan:
            p = int(pos[keep][k])
            assert p - at <= limit
            got += scale * (p - at - target) ** 2 + (pen[keep][k] if p != total else 0)
            at = back[k]
        assert got == pytest.approx(cost[-1], abs=1e-9)


@needs_tokens
def test_a_text_without_plan_gives_an_error_row(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "word " * 300, "a")], "doc_id long, text string, source string")
    lim = spark.createDataFrame([("a", 100, 10)], "source string, max_tokens int, overlap_tokens int")
    a = tokens.automaton()
    monkeypatch.setattr(splitting, "_best", lambda *x: None)
    with pytest.raises(ValueError):
        splitting.pieces(a, "word " * 300, 100, 10)
    monkeypatch.undo()
    assert splitting.split_documents(docs, lim).count() > 3


def test_settings_are_never_cut(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SETTINGS_ROWS", 3)
    assert len(mixing.settings(spark.range(3))) == 3
    with pytest.raises(ValueError):
        mixing.settings(spark.range(4))


@pytest.mark.parametrize("lang,before,after", [("javascript", "let x = ", ";"), ("tsx", "let x = ", ";"), ("sql", "SELECT ", ""), ("go", "package a\nvar x = ", "\n"), ("python", "x = ", ""), ("java", "class A { int x = ", "; }"), ("rust", "fn f() { let x = ", "; }"), ("csharp", "class A { int x = ", "; }")])
def test_nesting_of_any_depth(lang, before, after):
    n = 4000
    assert grammar(lang).parse(before + "(" * n + "1" + ")" * n + after) == -1
    assert grammar(lang).parse(before + "(" * n + "1" + ")" * (n - 1) + after) >= 0


def test_assignment_needs_a_place():
    for s in ["f() = 1", "x = 1 = 2", "f(a=1, b)", "f(**a, *b)", "def f(a=1, b): pass", "(a, b.c[0]) = x", "[a, *b] = x", "del f()", "del (a), b[0], c.d", "for f() in x: pass", "f(x)[0] += 1", "(x): int = 1", "with a as f(): pass", "'a'.b = 1", "a, b += 1", "def f(a, /, b=1, *, c, **d): pass", "f(a, *b, c, d=1, *e, **g)", "f(a for a in b)"]:
        try:
            ast.parse(s)
            ok = True
        except SyntaxError:
            ok = False
        assert (grammar("python").parse(s) < 0) == ok, s
    for s in ["a = b = c;", "[a, b] = [b, a];", "({a} = x);", "a.b[c] += f() ? x = 1 : y;", "x ??= 1; z >>>= 1", "for (a.b of c) d = e;", "while ((x = f())) ;", "a == b; a <= b", "f(x).y = z"]:
        assert grammar("javascript").parse(s) == grammar("typescript").parse(s) == -1, s
    for s in ["1 = 2;", "f() = 1;", "a + b = c;", "'x' += 1"]:
        assert grammar("javascript").parse(s) >= 0 and grammar("typescript").parse(s) >= 0, s
    assert grammar("typescript").parse("a! = 1; (a as any) = 2; this.a = this.b!;") == -1
