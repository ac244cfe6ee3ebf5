"""Source trees: symbols, imports, table definitions, manifests."""
from __future__ import annotations

import ast
import keyword
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The language of an extension, and what defines a symbol in it.
LANGUAGES = {
    "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "jsx", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "go": "go", "rs": "rust", "java": "java", "cs": "csharp", "dart": "dart", "ex": "elixir", "exs": "elixir", "sql": "sql", "ddl": "sql",
}
_ECMA = [
    (r"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([\w$]+)", "function"), (r"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([\w$]+)", "class"),
    (r"(?m)^\s*(?:export\s+)?interface\s+([\w$]+)", "interface"), (r"(?m)^\s*(?:export\s+)?type\s+([\w$]+)\s*(?:<[^=]*>)?=", "type_alias"), (r"(?m)^\s*(?:export\s+)?(?:const\s+)?enum\s+([\w$]+)", "enum"),
    (r"(?m)^\s*(?:export\s+)?const\s+([\w$]+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*(?::[^=]+)?=>", "function"), (r"(?m)^\s*import\s[^;'\"]*?['\"]([^'\"]+)['\"]", "import"),
]
SYMBOLS = {
    "go": [(r"(?m)^func\s+(?:\([^)]*\)\s*)?(\w+)", "function"), (r"(?m)^type\s+(\w+)\s+struct", "struct"), (r"(?m)^type\s+(\w+)\s+interface", "interface"), (r"(?m)^\s*(?:import\s+)?(?:\w+\s+)?\"([\w./\-]+)\"\s*$", "import")],
    "rust": [(r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)", "function"), (r"(?m)^\s*(?:pub\s+)?struct\s+(\w+)", "struct"), (r"(?m)^\s*(?:pub\s+)?enum\s+(\w+)", "enum"), (r"(?m)^\s*(?:pub\s+)?trait\s+(\w+)", "trait"), (r"(?m)^\s*use\s+([\w:]+)", "import")],
    "java": [(r"\bclass\s+(\w+)", "class"), (r"\binterface\s+(\w+)", "interface"), (r"\benum\s+(\w+)", "enum"), (r"(?m)^\s*(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)+[\w<>\[\], ]+\s+(\w+)\s*\(", "method"), (r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)", "import")],
    "csharp": [(r"\bclass\s+(\w+)", "class"), (r"\binterface\s+(\w+)", "interface"), (r"\bnamespace\s+([\w.]+)", "namespace"), (r"(?m)^\s*(?:(?:public|private|protected|internal|static|async|virtual|override)\s+)+[\w<>\[\], ]+\s+(\w+)\s*\(", "method"), (r"(?m)^\s*using\s+([\w.]+)\s*;", "import")],
    "dart": [(r"\bclass\s+(\w+)", "class"), (r"(?m)^\s*import\s+'([^']+)'", "import")],
    "elixir": [(r"(?m)^\s*defmodule\s+([\w.]+)", "module"), (r"(?m)^\s*defp?\s+(\w+)", "function"), (r"(?m)^\s*(?:alias|import|use)\s+([\w.]+)", "import")],
    **{k: _ECMA for k in ("typescript", "tsx", "javascript", "jsx")},
}


_C_LIKE = r"//[^\n]*|/\*[\s\S]*?\*/"
_QUOTED = r"\"(?:[^\"\\\n]|\\.)*\"|`(?:[^`\\]|\\[\s\S])*`"
#: Comments and strings of a language; in Rust a quote also begins a lifetime.
_PARTS = {
    k: re.compile(f"(?P<comment>{'#[^\n]*' if k == 'elixir' else _C_LIKE})|{_QUOTED}|{_CHAR}")
    for k, _CHAR in {**dict.fromkeys(SYMBOLS, r"'(?:[^'\\\n]|\\.)*'"), "rust": r"'(?:[^'\\\n]|\\[^\n]{1,9}?)'", "go": r"'(?:[^'\\\n]|\\[^\n]{1,9}?)'"}.items()
}
_CALL = re.compile(r"(?<![\w$])([^\W\d][\w$]*)\s*\(")
#: Words before a bracket that call nothing, and words after which a name is defined.
_NO_CALL = frozenset("if for while switch catch return function func fn match with case sizeof typeof elif def defp do when using lock foreach new super this import require".split())
_DEFINES = re.compile(r"(?:function\s*\*?|func(?:\s*\([^()]*\))?|fn|def|defp|class|new)\s+$")
_blank = lambda text: re.sub(r"[^\n]", " ", text)


def _line_symbols(source: str, language: str, patterns) -> list[tuple[str, str, int]]:
    """Defining lines, imports and calls of a language without its own parser, outside comments; imports alone look into strings."""
    parts = _PARTS[language]
    told = parts.sub(lambda m: _blank(m[0]) if m["comment"] else m[0], source)
    bare = parts.sub(lambda m: _blank(m[0]), source)
    out, defined = [], set()
    for rx, kind in patterns:
        for m in rx.finditer(told if kind == "import" else bare):
            out.append((m[1], kind, source.count("\n", 0, m.start(1)) + 1))
            defined.add(m.start(1))
    for m in _CALL.finditer(bare):
        if m[1] not in _NO_CALL and m.start(1) not in defined and not _DEFINES.search(bare, max(0, m.start() - 40), m.start()):
            out.append((m[1], "call", source.count("\n", 0, m.start(1)) + 1))
    return out


_PY_BLANK = re.compile(r"#[^\n]*|(\"\"\"|\'\'\')[\s\S]*?\1|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")
_PY_LINES = [(re.compile(r"(?m)^[ \t]*(?:async[ \t]+)?def[ \t]+(\w+)"), "function"), (re.compile(r"(?m)^[ \t]*class[ \t]+(\w+)"), "class"), (re.compile(r"(?m)^[ \t]*from[ \t]+\.*([\w.]*)[ \t]+import\b"), "import")]
_PY_IMPORT = re.compile(r"(?m)^[ \t]*import[ \t]+([\w.]+(?:[ \t]+as[ \t]+\w+)?(?:[ \t]*,[ \t]*[\w.]+(?:[ \t]+as[ \t]+\w+)?)*)")
_PY_CALL = re.compile(r"(?<!\bdef )(?<!\bclass )\b([^\W\d]\w*)[ \t]*\(")


def _python_lines(source: str) -> list[tuple[str, str, int]]:
    """What can be read of a source that does not parse: defining lines, imports and calls outside strings and comments."""
    clean = _PY_BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)
    line = lambda m: clean.count("\n", 0, m.start(1)) + 1
    out = [(m[1] or ".", kind, line(m)) for rx, kind in _PY_LINES for m in rx.finditer(clean)]
    out += [(n.split()[0], "import", line(m)) for m in _PY_IMPORT.finditer(clean) for n in m[1].split(",")]
    return out + [(m[1], "call", line(m)) for m in _PY_CALL.finditer(clean) if not keyword.iskeyword(m[1])]


def _python_symbols(source: str) -> list[tuple[str, str, int]]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return _python_lines(source)
    out = []
    for n in ast.walk(tree):
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append((n.name, "function", n.lineno))
        elif isinstance(n, ast.ClassDef):
            out.append((n.name, "class", n.lineno))
        elif isinstance(n, ast.Import):
            out += [(a.name, "import", n.lineno) for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            out.append((n.module or ".", "import", n.lineno))
        elif isinstance(n, ast.Call) and isinstance(n.func, (ast.Name, ast.Attribute)):
            out.append((n.func.id if isinstance(n.func, ast.Name) else n.func.attr, "call", n.lineno))
    return out


_SQL_BLANK = re.compile(r"--[^\n]*|/\*[\s\S]*?\*/|'(?:[^']|'')*'")
_DDL = re.compile(r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+|unlogged\s+|materialized\s+|unique\s+)*(table|view|index|function|procedure|trigger|schema|type|sequence)\s+(?:concurrently\s+)?(?:if\s+not\s+exists\s+)?([\w.\"`\[\]]+)")
_REF = re.compile(r"(?i)\breferences\s+([\w.\"`\[\]]+)")
_ALTER = re.compile(r"(?i)^\s*alter\s+table\s+(?:if\s+exists\s+)?(?:only\s+)?([\w.\"`\[\]]+)\s+add\s+(?:column\s+)?(?!constraint)(\w+)")
_READS = re.compile(r"(?i)\b(?:from|join)\s+([\w.\"`\[\]]+)")
_ON = re.compile(r"(?i)\bon\s+([\w.\"`\[\]]+)")
_NOT_COLUMN = {"primary", "foreign", "unique", "check", "constraint", "exclude", "index", "key", "like"}


def _bare(name: str) -> str:
    return re.sub(r"[\"`\[\]]", "", name).split(".")[-1]


def ddl_objects(source: str) -> list[tuple[str, str, str | None]]:
    """(kind, name, of) of each definition: columns and indexes of their table, foreign keys and what a view reads of their target."""
    out: list[tuple[str, str, str | None]] = []
    clean = _SQL_BLANK.sub(lambda m: " " * len(m.group()), source)
    for stmt in clean.split(";"):
        if m := _ALTER.match(stmt):
            out.append(("column", m[2].lower(), _bare(m[1]).lower()))
        m = _DDL.match(stmt)
        if not m:
            continue
        kind, name = m[1].lower(), _bare(m[2]).lower()
        on = _ON.search(stmt, m.end()) if kind in ("index", "trigger") else None
        out.append((kind, name, _bare(on[1]).lower() if on else None))
        if kind == "view":
            out += [("reads", name, _bare(t).lower()) for t in _READS.findall(stmt, m.end())]
        if kind == "table" and "(" in stmt:
            body, depth, part, parts = stmt[stmt.index("(") + 1 :], 0, "", []
            for c in body:
                if c == ")" and depth == 0:
                    break
                depth += (c == "(") - (c == ")")
                if c == "," and depth == 0:
                    parts.append(part)
                    part = ""
                else:
                    part += c
            for p in [*parts, part]:
                word = re.match(r"\s*[\"`\[]?(\w+)", p)
                if word and word[1].lower() not in _NOT_COLUMN:
                    out.append(("column", word[1].lower(), name))
                out += [("foreign_key", name, _bare(r).lower()) for r in _REF.findall(p)]
    return out


def symbols(sources: DataFrame) -> DataFrame:
    """(path, language, kind, name, line) of ``sources(path, source)``.

    Python by its syntax tree, SQL by its definitions, other languages by their
    defining lines and calls outside comments and strings, and so is Python that
    does not parse.
    """
    rx = {k: [(re.compile(p), kind) for p, kind in v] for k, v in SYMBOLS.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, src in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                lang = LANGUAGES.get((path or "").rsplit(".", 1)[-1].lower())
                if not lang or not src:
                    continue
                if lang == "python":
                    got = _python_symbols(src)
                elif lang == "sql":
                    got = [(n if of is None else f"{of}.{n}", k, 0) for k, n, of in ddl_objects(src)]
                else:
                    got = _line_symbols(src, lang, rx[lang])
                rows += [(path, lang, k, n, l) for n, k, l in got]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, [pa.string()] * 4 + [pa.int32()])], ["path", "language", "kind", "name", "line"])

    return sources.select("path", "source").mapInArrow(run, "path string, language string, kind string, name string, line int")


def code_edges(found: DataFrame) -> DataFrame:
    """(src, dst, kind) of symbols: a file contains what it defines and imports what it names."""
    s = found.where("kind <> 'call'")
    edge = F.when(F.col("kind") == "import", F.struct(F.col("path").alias("src"), F.col("name").alias("dst"), F.lit("imports").alias("kind")))
    own = F.struct(F.col("path").alias("src"), F.concat_ws("#", "path", "name").alias("dst"), F.lit("contains").alias("kind"))
    return s.select(F.coalesce(edge, own).alias("e")).select("e.*").distinct()


def calls(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """calls(caller, callee_name) by file and nodes(id, name, kind) of symbols, as ``resolve_calls`` takes them."""
    nodes = found.where(F.col("kind").isin("function", "method")).select(F.concat_ws("#", "path", "name").alias("id"), "name", "kind").distinct()
    return found.where("kind = 'call'").select(F.col("path").alias("caller"), F.col("name").alias("callee_name")).distinct(), nodes


def ddl(sources: DataFrame) -> DataFrame:
    """(path, kind, name, of) of every definition in the SQL files of ``sources(path, source)``; see ``ddl_objects``."""
    names = ["path", "kind", "name", "of"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, *o) for p, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if s for o in ddl_objects(s)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in (zip(*rows) if rows else [()] * 4)], names)

    return sources.where(F.lower("path").rlike(r"\.(?:sql|ddl)$")).select("path", "source").mapInArrow(run, "path string, kind string, name string, of string")


def ddl_entities(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """tables(name, stub) and relations(src, dst) of SQL files: foreign keys and what views read; what is only referred to is a stub."""
    d = ddl(sources)
    keys = d.where("kind in ('foreign_key', 'reads')").select(F.col("name").alias("src"), F.col("of").alias("dst"))
    made = d.where("kind in ('table', 'view')").select("name", F.lit(False).alias("stub"))
    return made.unionByName(keys.select(F.col("dst").alias("name"), F.lit(True).alias("stub"))), keys


def ddl_tables(sources: DataFrame) -> DataFrame:
    """(path, table_name) of CREATE TABLE statements, in the JVM: comments blanked, names without quotes."""
    clean = F.regexp_replace("source", r"--[^\n]*", "")
    names = F.regexp_extract_all(clean, F.lit(r"(?i)create\s+table\s+(?:if\s+not\s+exists\s+)?([\w.]+)"), 1)
    return sources.where(F.lower("path").rlike(r"\.(?:sql|ddl)$")).select("path", F.explode(names).alias("t")).select("path", F.lower("t").alias("table_name"))


# The dependency lines of manifests.
_LINES = {
    "requirements.txt": (r"(?m)^\s*([A-Za-z0-9_.\-]+)\s*(?:[<>=!~\[;]|$)", "dependency"), "go.mod": (r"(?m)^\s*(?:require\s+)?([\w.\-]+\.[\w.\-]+/[\w./\-]+)\s+v", "dependency"),
    "Cargo.toml": (r"(?m)^([A-Za-z0-9_\-]+)\s*=\s*(?:\"[\d^~*<>=]|\{)", "dependency"), "Gemfile": (r"(?m)^\s*gem\s+['\"]([^'\"]+)", "dependency"),
    "pubspec.yaml": (r"(?m)^  ([a-z0-9_]+):\s*[\^\d]", "dependency"), "pom.xml": (r"<artifactId>([^<]+)</artifactId>", "dependency"), "mix.exs": (r"\{:(\w+),", "dependency"),
    "build.gradle": (r"(?:implementation|api|compile)\s*\(?['\"][^:'\"]+:([^:'\"]+)", "dependency"), "pyproject.toml": (r"(?m)^\s*\"([A-Za-z0-9_.\-]+)\s*(?:[<>=!~\[;][^\"]*)?\",?\s*$", "dependency"),
}


def manifests(files: DataFrame) -> DataFrame:
    """(kind, name, path): dependencies and tools of manifests(path, content); of one (kind, name in any case) the first path."""
    base = F.regexp_extract("path", r"([^/]+)$", 1)
    out = []
    js = F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>")
    pk = files.where(base == "package.json").select("path", js.alias("j"))
    out.append(pk.select("path", F.lit("dependency").alias("kind"), F.explode(F.array_distinct(F.concat(F.coalesce(F.map_keys("j.dependencies"), F.array()), F.coalesce(F.map_keys("j.devDependencies"), F.array())))).alias("name")))
    for name, (rx, kind) in _LINES.items():
        out.append(files.where(base == name).select("path", F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all("content", F.lit(rx), 1)).alias("name")))
    tool = (
        F.when(base.rlike(r"(?i)^dockerfile"), "docker").when(base.rlike(r"(?i)^docker-compose"), "docker-compose").when(F.col("path").rlike(r"\.github/workflows/"), "github-actions")
        .when(base.rlike(r"\.tf$"), "terraform").when(base == "Makefile", "make").when(base == "Jenkinsfile", "jenkins")
    )
    out.append(files.where(tool.isNotNull()).select("path", F.lit("tool").alias("kind"), tool.alias("name")))
    df = out[0]
    for o in out[1:]:
        df = df.unionByName(o)
    first = df.groupBy("kind", F.lower("name").alias("key")).agg(F.min_by("name", "path").alias("name"), F.min("path").alias("path"))
    return first.select("kind", "name", "path")
