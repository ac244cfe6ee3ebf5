"""Parsing-expression grammars of the languages, compiled when first used."""
from __future__ import annotations

from lorequarry.llm.peg import Grammar

_compiled: dict[str, Grammar] = {}

# The language that a file's extension stands for.
EXTENSIONS = {
    "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx",
    "js": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "go": "go", "rs": "rust", "java": "java", "cs": "csharp", "sql": "sql", "ddl": "sql",
}


def grammar(language: str) -> Grammar:
    """The grammar of a language."""
    if language not in _compiled:
        from lorequarry.llm.grammars import braces, ecma, python, sql

        make = {
            "typescript": ecma.typescript, "tsx": ecma.tsx, "javascript": ecma.javascript, "python": python.python,
            "go": braces.go, "rust": braces.rust, "java": braces.java, "csharp": braces.csharp, "sql": sql.sql,
        }[language]
        _compiled[language] = make()
    return _compiled[language]
