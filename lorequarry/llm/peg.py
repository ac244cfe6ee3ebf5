"""A packrat parser for parsing-expression grammars, straight over characters.

A grammar is text: ``rule <- sequence / sequence``. Terms: ``'x'`` a literal,
``"x"`` a keyword, ``/x/`` a pattern (all after white space and comments),
``~/x/`` a pattern right here, ``NL`` a line break before the next token,
``EOF`` the end; ``( )``, ``? * +`` and ``& !`` as usual. Each rule is tried at
most once at a position. A text is valid if the rule ``start`` consumes it all;
if not, the furthest position at which something was expected is reported.
"""
from __future__ import annotations

import re
import sys
from collections.abc import Callable

import regex

_TERM = re.compile(r"\s*(?:(?P<lit>'(?:[^'\\]|\\.)*')|(?P<kw>\"[^\"]*\")|(?P<re>~?/(?!\s)(?:[^/\\]|\\.)*/i?)|(?P<name>\w+)|(?P<op><-|[()/?*+&!]))")

Step = Callable[[int], int]


class Grammar:
    """The compiled rules of one language."""

    def __init__(self, text: str, trivia: str, ignore_case: bool = False, prepare: Callable[[str], tuple[str, int]] | None = None):
        self.ignore_case, self.prepare = ignore_case, prepare
        self._skip = re.compile(trivia).match
        self.text, self.far = "", 0
        self._at: dict[int, int] = {}
        self.rules: dict[str, Step] = {}
        self.memos: list[dict[int, int]] = []
        self.firsts: dict[str, frozenset[str] | None] = {}
        trees = {}
        for block in re.split(r"\n(?=\w+ *<-)", re.sub(r"(?m)^\s*#.*$", "", text).strip()):
            name, body = re.match(r"(\w+)\s*<-\s*(.*)", block, re.S).groups()
            toks = [m for m in _TERM.finditer(body) if m.lastgroup]
            trees[name] = self._choice([(m.lastgroup, m.group(m.lastgroup)) for m in toks], [0])
        self.trees, self.terms = trees, len(re.findall(r"\S+", text))
        for name in trees:
            self.rules[name] = self._rule(name)
        self.steps = {n: self._compile(t) for n, t in trees.items()}

    # ---- reading ----

    def _choice(self, t, i):
        alts = [self._sequence(t, i)]
        while i[0] < len(t) and t[i[0]] == ("op", "/"):
            i[0] += 1
            alts.append(self._sequence(t, i))
        return alts[0] if len(alts) == 1 else ("or", alts)

    def _sequence(self, t, i):
        items = []
        while i[0] < len(t) and t[i[0]] not in (("op", "/"), ("op", ")")):
            items.append(self._prefix(t, i))
        return items[0] if len(items) == 1 else ("seq", items)

    def _prefix(self, t, i):
        kind, v = t[i[0]]
        if kind == "op" and v in "&!":
            i[0] += 1
            return (v, self._prefix(t, i))
        i[0] += 1
        if (kind, v) == ("op", "("):
            node = self._choice(t, i)
            i[0] += 1
        elif kind == "lit":
            node = ("lit", v[1:-1].replace("\\'", "'").replace("\\\\", "\\"))
        elif kind == "kw":
            node = ("re", rf"{re.escape(v[1:-1])}(?![\w$])", False, "i" if self.ignore_case else "")
        elif kind == "re":
            raw, flags = v.startswith("~"), "i" if v.endswith("i") or self.ignore_case else ""
            v = v.removeprefix("~").removesuffix("i") if v.endswith("/i") else v.removeprefix("~")
            node = ("re", v[1:-1].replace("\\/", "/"), raw, flags)
        else:
            node = ("name", v)
        while i[0] < len(t) and t[i[0]][0] == "op" and t[i[0]][1] in "?*+":
            node = (t[i[0]][1], node)
            i[0] += 1
        return node

    # ---- first characters: an alternative that can't begin here is not tried ----

    def _first(self, n, busy=frozenset()):
        """The characters with which a term can begin; None if any, or if it can be empty."""
        k = n[0]
        if k == "lit":
            return frozenset(n[1][0])
        if k == "re":
            if n[2]:
                return None
            f = regex.compile(n[1], regex.I if n[3] else 0).fullmatch
            if regex.compile(n[1]).match(""):
                return None
            return frozenset(c for c in [*map(chr, range(128)), "é"] if f(c, partial=True))
        if k == "name":
            if n[1] in ("NL", "EOF") or n[1] in busy:
                return None
            if n[1] not in self.firsts:
                self.firsts[n[1]] = None
                self.firsts[n[1]] = self._first(self.trees[n[1]], busy | {n[1]})
            return self.firsts[n[1]]
        if k == "or":
            fs = [self._first(a, busy) for a in n[1]]
            return None if any(f is None for f in fs) else frozenset().union(*fs)
        if k == "seq":
            for x in n[1]:
                if x[0] in "!&":
                    continue
                if x[0] in "?*":
                    f, rest = self._first(x[1], busy), self._first(("seq", n[1][n[1].index(x) + 1 :]), busy)
                    return None if f is None or rest is None else f | rest
                return self._first(x, busy)
            return None
        if k == "+":
            return self._first(n[1], busy)
        return None

    # ---- compiling ----

    def skip(self, p: int) -> int:
        """The position behind white space and comments."""
        q = self._at.get(p)
        if q is None:
            q = self._at[p] = self._skip(self.text, p).end()
        return q

    def _rule(self, name: str) -> Step:
        memo: dict[int, int] = {}
        self.memos.append(memo)
        get = memo.get

        def run(p: int) -> int:
            q = get(p)
            if q is None:
                q = memo[p] = self.steps[name](p)
            return q

        return run

    def _compile(self, n) -> Step:
        k = n[0]
        if k == "lit":
            s, size = n[1], len(n[1])

            def lit(p: int) -> int:
                at = self._at.get(p)
                if at is None:
                    at = self._at[p] = self._skip(self.text, p).end()
                if self.text.startswith(s, at):
                    return at + size
                if at > self.far:
                    self.far = at
                return -1

            return lit
        if k == "re":
            match, raw = re.compile(n[1], re.I if n[3] else 0).match, n[2]

            def pattern(p: int) -> int:
                if not raw:
                    p = self.skip(p)
                m = match(self.text, p)
                if m:
                    return m.end()
                if p > self.far:
                    self.far = p
                return -1

            return pattern
        if k == "name":
            if n[1] == "NL":
                return lambda p: p if "\n" in self.text[p : self.skip(p)] else -1
            if n[1] == "EOF":

                def eof(p: int) -> int:
                    at = self.skip(p)
                    if at == len(self.text):
                        return at
                    if at > self.far:
                        self.far = at
                    return -1

                return eof
            return self.rules[n[1]]
        if k == "seq":
            items = [self._compile(x) for x in n[1]]

            def seq(p: int) -> int:
                for f in items:
                    p = f(p)
                    if p < 0:
                        return -1
                return p

            return seq
        if k == "or":
            steps = [(self._compile(a), self._first(a)) for a in n[1]]
            table = {c: [f for f, first in steps if first is None or c in first] for c in [*map(chr, range(128)), "é", ""]}
            other = table["é"]
            size = self

            def choice(p: int) -> int:
                at = size.skip(p)
                c = size.text[at : at + 1]
                alts = table.get(c, other)
                for f in alts:
                    q = f(p)
                    if q >= 0:
                        return q
                if at > size.far:
                    size.far = at
                return -1

            return choice
        f = self._compile(n[1])
        if k == "?":
            return lambda p: q if (q := f(p)) >= 0 else p
        if k == "&":
            return lambda p: p if f(p) >= 0 else -1
        if k == "!":

            def not_(p: int) -> int:
                far = self.far  # what must not come is not what was expected
                q = f(p)
                self.far = far
                return -1 if q >= 0 else p

            return not_

        def many(p: int) -> int:
            q = f(p)
            if q < 0:
                return -1 if k == "+" else p
            while q >= 0 and q != p:
                p, q = q, f(q)
            return p

        return many

    def line_at(self, position: int, source: str) -> int:
        """The line of the position that the last ``parse`` reported; prepared texts keep their lines apart."""
        if self.prepare and self.text and self.text != source:
            return self.text.count("\n", 0, position) + self.text.count("\x01", 0, position) + 1
        return source.count("\n", 0, position) + 1

    def parse(self, text: str) -> int:
        """-1 if the text is valid, else the furthest position at which it failed."""
        if self.prepare:
            text, bad = self.prepare(text)
            if bad >= 0:
                return bad
        for m in self.memos:
            m.clear()
        self._at.clear()
        self.text, self.far = text, 0
        # Calls between rules need no C stack, so nesting is bounded by memory only. A level of
        # nesting consumes text and passes each rule at most once, which bounds the depth.
        depth = min(2**31 - 1, 4 * self.terms * (len(text) + 2) + 12_000)
        if sys.getrecursionlimit() < depth:
            sys.setrecursionlimit(depth)
        end = self.rules["start"](0)
        self._at.clear()
        return -1 if end >= 0 else self.far
