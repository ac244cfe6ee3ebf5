"""Encode text with a public byte-level BPE vocabulary through a tokenization automaton.

The automaton reads bytes and emits tokens. It starts with one state and the 256
byte arcs; each merge (u, v) -> w, in order of rank, adds a gadget: wherever a
u-arc is followed by a v-arc there is now a w-arc, its target a copy of the
state behind v, and v no longer follows that u. What may follow a state depends
only on the token that led to it, so the compiled automaton has one state a
token, and whether the arc y leaves the state of x is settled by the gadget that
made the younger of the two: it copied the arcs of the state behind x's right
half, or it put y where x's arc to y's left half was. This rule is evaluated
when an arc is first asked for and then kept in the transition table, so only
arcs that the text uses are compiled. The one path that spells a word is the
encoding; decoding emits the labels of its arcs.
"""
from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the public vocabulary files lie; never copied into this repository.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.json"

# The pre-split pattern of the public vocabulary and its white space.
_SPACE = r"\t-\r \x85\xa0  -     　"
PRE_SPLIT = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
_ASCII_SPACE = r"\t-\r "
ASCII_SPLIT = rf"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^{_ASCII_SPACE}A-Za-z0-9]+|[{_ASCII_SPACE}]+(?![^{_ASCII_SPACE}])|[{_ASCII_SPACE}]+"


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = {chr(b): b for b in shown}
    for k, b in enumerate(b for b in range(256) if b not in set(shown)):
        out[chr(256 + k)] = b
    return out


class _Words(dict):
    """Pre-split words and their ids as int32 bytes, encoded when first asked for; of bounded size."""

    def __init__(self, a: Automaton):
        super().__init__()
        self.a = a

    def __missing__(self, word: str) -> bytes:
        got = np.array(self.a.path(word.encode("utf-8", "surrogatepass")), dtype=np.int32).tobytes()
        if len(self) > 400_000:
            self.clear()
        if len(word) <= 64:
            self[word] = got
        return got


class Automaton:
    """The compiled merges; states are tokens, arcs are made when first asked for."""

    START = -1

    def __init__(self, text: str):
        """The automaton of a vocabulary file's text."""
        model = json.loads(text)["model"]
        to_byte, vocab = byte_letters(), model["vocab"]
        self.labels: dict[int, bytes] = {i: bytes(to_byte[c] for c in t) for t, i in vocab.items() if all(c in to_byte for c in t)}
        self.birth: dict[int, int] = {i: -1 for i, s in self.labels.items() if len(s) == 1}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            self.merge[u, v] = rank
            if w not in self.birth:
                self.birth[w], self.halves[w] = rank, (u, v)
        self.table: dict[int, bool] = {}
        self.root: dict = {}
        reached = {i for i, b in self.birth.items() if b < 0}
        for w, (u, v) in self.halves.items():  # in order of birth
            if u in reached and v in reached and self._arc(u, v, self.birth[w]):
                reached.add(w)
        for i in reached:
            node = self.root
            for byte in self.labels[i]:
                node = node.setdefault(byte, {})
            node[-1] = i
        self.sizes = np.zeros(max(self.labels, default=-1) + 1, dtype=np.int64)  # bytes of each label
        for i, s in self.labels.items():
            self.sizes[i] = len(s)
        self.words = _Words(self)
        self.packed = self.words.__getitem__  # the ids of one pre-split word as int32 bytes

    def _arc(self, x: int, y: int, time: float) -> bool:
        """Whether y may follow x once the gadgets before ``time`` are in place."""
        birth, halves = self.birth, self.halves
        while True:
            m = self.merge.get((x, y))
            if m is not None and m < time:
                return False
            bx, by = birth[x], birth[y]
            if by >= bx:
                if by < 0:
                    return True
                y, time = halves[y][0], by + 1
            else:
                x, time = halves[x][1], bx

    def arc(self, x: int, y: int) -> bool:
        """The transition table, filled when asked."""
        key = x << 32 | y
        got = self.table.get(key)
        if got is None:
            if len(self.table) > 2_000_000:
                self.table.clear()
            got = self.table[key] = self._arc(x, y, float("inf"))
        return got

    def path(self, word: bytes) -> list[int]:
        """The tokens of the one path that spells a word."""
        n, root, arc = len(word), self.root, self.arc
        last, start = [self.START] * (n + 1), [0] * (n + 1)
        for j in range(n):
            x, node = last[j], root
            for k in range(j, n):
                node = node.get(word[k])
                if node is None:
                    break
                y = node.get(-1)
                if y is not None and (j == 0 or arc(x, y)):
                    last[k + 1], start[k + 1] = y, j
        out, at = [], n
        while at:
            out.append(last[at])
            at = start[at]
        return out[::-1]

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text."""
        return np.frombuffer(b"".join(map(self.packed, split(text))), dtype=np.int32)

    def decode(self, ids) -> str:
        """The text that a list of ids spells."""
        return b"".join(self.labels[int(i)] for i in ids).decode("utf-8", "replace")


_unicode_split = regex.compile(PRE_SPLIT).findall
_ascii_split = re.compile(ASCII_SPLIT).findall


def split(text: str) -> list[str]:
    """The pre-split words of a text; together they are the text."""
    return _ascii_split(text) if text.isascii() else _unicode_split(text)


_loaded: dict[str, Automaton] = {}


def _read(path: str | None) -> tuple[str, str]:
    text = open(path or os.path.join(TOKENIZERS, VOCABULARY), encoding="utf-8").read()
    return xxhash.xxh3_128_hexdigest(text), text


def compiled(key: str, text: str) -> Automaton:
    """The automaton of a vocabulary's text, compiled once a worker."""
    if key not in _loaded:
        _loaded[key] = Automaton(text)
    return _loaded[key]


def automaton(path: str | None = None) -> Automaton:
    """The automaton of a vocabulary file of this machine."""
    return compiled(*_read(path))


def shipped(spark: SparkSession, path: str | None = None):
    """The vocabulary file as a broadcast (a few MB): only the driver needs the file."""
    return spark.sparkContext.broadcast(_read(path))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of ``docs(doc_id, text)``; a null and an empty text give an empty list.

    Strings that look like special tokens are ordinary text. No shuffle, no cap
    on the length of a text; repeated rows give repeated results.
    """

    model = shipped(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = compiled(*model.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                parts = [b"".join(map(a.packed, split(t))) if t else b"" for t in b.column(1).to_pylist()]
                offs = np.cumsum([0] + [len(p) >> 2 for p in parts]).astype(np.int32)
                flat = np.frombuffer(b"".join(parts), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of ``encoded(doc_id, ids)``, by emitting the arcs' labels."""

    model = shipped(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = compiled(*model.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([a.decode(i or ()) for i in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def token_counts(docs: DataFrame, columns: list[str], path: str | None = None) -> DataFrame:
    """``columns`` of the documents and n_tokens, the length of the encoding."""
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)

    model = shipped(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = compiled(*model.value)
        for b in batches:
            n = [sum(map(len, map(a.packed, split(t)))) >> 2 if t else 0 for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(n, pa.int64())], [*columns, "n_tokens"])

    return docs.select(F.col("text").alias("_text"), *columns).mapInArrow(run, f"{kinds}, n_tokens long")
