"""Symbols of Python sources that do not parse."""
from lorequarry.sources import code as C

BROKEN = '''import os, json as j
from . import near
from ..a.b import c
class Box(Base):
    async def load(self, x):
        """def not_this(): call()"""
        return open(x).read()  # gone()
def cut(:
    print "old", f(1)
'''


def test_what_can_be_read_of_broken_python(spark):
    rows = C.symbols(spark.createDataFrame([("/p/a.py", BROKEN)], "path string, source string")).collect()
    assert {(r.kind, r.name, r.line) for r in rows} == {
        ("import", "os", 1), ("import", "json", 1), ("import", ".", 2), ("import", "a.b", 3), ("class", "Box", 4), ("function", "load", 5),
        ("call", "open", 7), ("call", "read", 7), ("function", "cut", 8), ("call", "f", 9),
    }


def test_the_lines_agree_with_the_tree():
    src = "import a.b, c\nfrom d import e\nclass K:\n    def m(self):\n        return self.n(g(1))\n"
    assert sorted(C._python_lines(src)) == sorted(C._python_symbols(src))
