"""Split oversized texts at natural boundaries.

Sizes are tokens of a public tokenizer. The boundaries of a text (paragraph,
line, sentence, word, and tokens where there is nothing else) are the positions
of a dynamic programme that minimises cut penalties and size imbalance, subject
to the limit and to the overlap of consecutive pieces.

Defined cases: null, empty and short texts give no pieces; a source without a
limit takes that of the null source, or stays whole if there is none; a run of
any length without boundaries is cut between tokens, never inside a character;
an overlap start that would lie inside a character moves back to its beginning; a
text for which the pre-split at the cuts leaves no pieces within the limit gives
one row with piece -1, boundary ``unsplit`` and a null text.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorequarry.llm.mixing import clean_source, settings
from lorequarry.llm.tokens import Automaton, compiled, shipped, split

LEVELS = ("paragraph", "line", "sentence", "word", "token")
#: What a cut at a boundary of each level costs, and the weight of the squared imbalance.
PENALTY = np.array([0.0, 0.15, 0.3, 0.8, 3.0])
IMBALANCE = 1.0
_SENTENCE_END = re.compile(r"[.!?。！？…؟।][\"'”’)\]»]*$")
_NO_SPACE_STOP = re.compile(r"[。！？；]")


class _Shapes(dict):
    """What a pre-split word is for a boundary: 1 white space with a line break, 2 begins with white
    space, 4 ends a sentence, 8 two line breaks, 16 holds a full stop of a script without spaces."""

    def __missing__(self, w: str) -> int:
        brk = "\n" in w and w.isspace()
        got = brk + 2 * w[0].isspace() + 4 * bool(_SENTENCE_END.search(w)) + 8 * (brk and w.count("\n") > 1) + 16 * bool(_NO_SPACE_STOP.search(w))
        if len(self) > 400_000:
            self.clear()
        if len(w) <= 64:
            self[w] = got
        return got


_shape = _Shapes().__getitem__


def boundaries(a: Automaton, text: str, words: list[str], packs: list[bytes], lens: np.ndarray):
    """(token positions of the candidate cuts, their levels, the char position at each token position, the words' places).

    Every position between two tokens that lies between characters is a
    candidate; one inside a character has no char position (-1).
    """
    ends = np.cumsum(lens)
    chars = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
    c = np.fromiter(map(_shape, words), dtype=np.int64, count=len(words))
    nxt, after = np.append(c[1:], 0), np.append(c[2:], [0, 0])[: len(c)]
    level = np.full(len(words), 4, dtype=np.int64)  # of the cut behind each word
    broken, space = (nxt & 1) > 0, (nxt & 2) > 0
    level[(c & 16) > 0] = 2
    level[space] = 3
    level[space & ((c & 4) > 0)] = 2
    # a cut goes before the white space: so a piece ends in the tokens that the whole text has there
    level[broken] = 1
    level[broken & (((nxt & 8) > 0) | ((after & 1) > 0))] = 0
    level[(c & 1) > 0] = 4
    at_byte = np.cumsum(a.sizes[np.frombuffer(b"".join(packs), dtype=np.int32)])
    at_char = np.zeros(int(ends[-1]) + 1, dtype=np.int64)
    if text.isascii():
        at_char[1:] = at_byte
    else:
        first = (np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8) & 0xC0) != 0x80
        inside = np.append(~first, False)[at_byte]
        at_char[1:] = np.where(inside, -1, np.append(np.cumsum(first) - 1, first.sum())[at_byte])
    levels = np.full(len(at_char), 4, dtype=np.int64)
    levels[ends] = level
    pos = np.flatnonzero(at_char[1:] >= 0) + 1
    levels[-1] = 0
    return pos, levels[pos], at_char, ends - lens, chars, ends


def _length(a: Automaton, text: str, x: int, y: int, s: int, p: int, words: list[str], ends, starts, chars) -> int:
    """The length of the own encoding of text[x:y], tokens s to p of the whole.

    A stretch of a path is a path: as long as the piece is pre-split where the
    whole text is, it has the same tokens. Only the first words and the last can
    be split otherwise; if they are, the piece is encoded again.
    """
    i = int(np.searchsorted(ends, s, "right"))  # the words in which the piece begins and ends
    j = int(np.searchsorted(ends, p, "left"))
    if j - i <= 2:
        want = [text[max(x, int(chars[k]) - len(words[k])) : min(y, int(chars[k]))] for k in range(i, j + 1)]
        same = split(text[x:y]) == want
    else:
        same = split(text[x : chars[i + 1]]) == [text[x : chars[i]], words[i + 1]]
        if same and p < ends[j]:
            tail = text[int(chars[j]) - len(words[j]) : y]
            same = split(tail) == [tail]
    return p - s if same else len(a.encode(text[x:y]))


def _needed(pos: np.ndarray, lev: np.ndarray, limit: int, overlap: int) -> np.ndarray:
    """Which cuts can be part of a plan of least cost.

    Let a token cut j lie between cuts h and i of a better level with L tokens
    between them, and w = IMBALANCE / limit^2. Reaching h costs at most
    w * 2 * L * limit more imbalance than reaching j, and reaching i by a short
    piece from h at most IMBALANCE more. So going on from i costs less than going
    on from j whatever comes, if what j's level costs more than both, and
    IMBALANCE, exceeds the imbalance by which the lengths can differ, 4 * w * (L + 2) * limit;
    and a piece that ends before i begins better at h. Such cuts are left out;
    the plan's cost is that over all positions.
    """
    token = lev == 4
    spare = (PENALTY[4] - 2 * PENALTY[3] - IMBALANCE) / IMBALANCE
    good = np.flatnonzero(~token)
    if not len(good) or spare <= 0:
        return np.ones(len(pos), dtype=bool)
    where = np.concatenate([[0], pos[good]])
    after = np.searchsorted(where, pos, "left")  # the end is a good cut, so there is always one
    gap = where[after] - where[np.maximum(after - 1, 0)]
    return ~token | (4 * (gap + 2) > spare * limit) | (overlap + gap + 4 > limit)


def _best(pos: list[int], pen: list[float], start: list[int], limit: int, target: float) -> list[int] | None:
    """Indices of the cuts with the least cost, the end included.

    The cost of a piece is convex in its length and infinite beyond the limit,
    so of two beginnings the later one, once better, stays better. Beginnings
    wait in a queue in the order in which they become the best; what is never
    the best is dropped when a later one comes. Each enters and leaves once.
    """
    unit = limit**2 / IMBALANCE  # costs are kept in units of the squared imbalance
    back, end = [-1] * len(pos), len(pos) - 1
    # of the waiting beginnings: the place, the cost so far, that cost + (place + target)^2, the cut, and where it takes over
    at, cost, level, cut, turn = [0], [0.0], [target * target], [-1], [0.0]
    head, tail = 0, 0
    for k, (p, b, extra) in enumerate(zip(pos, start, pen)):
        while head < tail and turn[head + 1] <= p:
            head += 1
        x = p - at[head]
        if x > limit:
            return None
        back[k] = cut[head]
        if k == end:
            break
        x -= target
        c = cost[head] + x * x + extra * unit
        if at[tail] == b:  # the same beginning: the cheaper one stays
            if cost[tail] <= c:
                continue
            del at[tail], cost[tail], level[tail], cut[tail], turn[tail]
            tail -= 1
        x = b + target
        x = c + x * x
        here = 0.0
        while tail >= head:
            s = at[tail]
            here = (x - level[tail]) / (2 * (b - s))  # where both cost the same, or the earlier one is out of reach
            if here > s + limit + 1:
                here = s + limit + 1
            if tail == head or turn[tail] < here:
                break
            del at[tail], cost[tail], level[tail], cut[tail], turn[tail]
            tail -= 1
        at.append(b)
        cost.append(c)
        level.append(x)
        cut.append(k)
        turn.append(here)
        tail += 1
    out, k = [], end
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def pieces(a: Automaton, text: str, limit: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """(start, stop, n_tokens, boundary) of the pieces of a text, offsets in code points; [] if it fits.

    n_tokens is the length of the piece's own encoding. Cutting may move the
    pre-split at a piece's ends; if that makes one too long, a smaller limit is
    planned with.
    """
    if len(text) * 4 <= limit:  # a token has at least a byte, a character at most four
        return []
    words = split(text)
    packs = list(map(a.packed, words))
    lens = np.fromiter(map(len, packs), dtype=np.int64, count=len(words)) >> 2
    if int(lens.sum()) <= limit:
        return []
    pos, lev, at_char, starts, chars, ends = boundaries(a, text, words, packs, lens)
    total = int(ends[-1])
    # a piece begins ``overlap`` tokens before the cut, or where the character there begins
    whole = np.maximum.accumulate(np.where(at_char >= 0, np.arange(total + 1), 0))
    begin = whole[np.maximum(pos - overlap, 0)]
    for slack in (0, 2, 4, 8, 16, 32, 64):
        if limit - slack - overlap < 8:
            break
        room = limit - slack
        count = max(2, -(-(total - overlap) // (room - overlap)))
        keep = _needed(pos, lev, room, overlap)
        at, level, back = pos[keep].tolist(), lev[keep], begin[keep].tolist()
        plan = _best(at, PENALTY[level].tolist(), back, room, (total + (count - 1) * overlap) / count)
        if plan is None:
            continue
        out, s = [], 0
        for k in plan:
            p = at[k]
            x, y = int(at_char[s]), int(at_char[p])
            out.append((x, y, _length(a, text, x, y, s, p, words, ends, starts, chars), "end" if p == total else LEVELS[level[k]]))
            s = back[k]
        if all(p[2] <= limit for p in out):
            return out
    raise ValueError(f"no pieces within {limit} tokens that share {overlap}")


def split_documents(docs: DataFrame, limits: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, stop, n_tokens, boundary, text) of every text over its source's limit.

    ``limits(source, max_tokens, overlap_tokens)`` is a small table of settings;
    it goes to the workers as a dictionary. There is no shuffle.
    """
    rows = settings(limits.select(clean_source(F.col("source")).alias("s"), "max_tokens", "overlap_tokens"))
    by = {r["s"]: (int(r["max_tokens"]), int(r["overlap_tokens"] or 0)) for r in rows if r["max_tokens"] is not None}
    for s, (m, o) in by.items():
        if o < 0 or m - o < 8:
            raise ValueError(f"limit of {s}: the overlap must be at least 8 tokens smaller than max_tokens")
    names = ["doc_id", "piece", "start", "stop", "n_tokens", "boundary", "text"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
    model = shipped(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = compiled(*model.value)

        def out(cols):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        for b in batches:
            cols: list[list] = [[] for _ in names]
            for doc, text, source in zip(*(c.to_pylist() for c in b.columns)):
                lim = by.get(source, by.get(None))
                if not text or lim is None:
                    continue
                try:
                    got = pieces(a, text, *lim)
                except ValueError:  # one text must not fail the job
                    for c, v in zip(cols, (doc, -1, 0, len(text), None, "unsplit", None)):
                        c.append(v)
                    continue
                for i, (x, y, n, kind) in enumerate(got):
                    for c, v in zip(cols, (doc, i, x, y, n, kind, text[x:y])):
                        c.append(v)
                if len(cols[0]) > 4000:
                    yield out(cols)
                    cols = [[] for _ in names]
            yield out(cols)

    return docs.select("doc_id", "text", clean_source(F.col("source")).alias("source")).mapInArrow(
        run, "doc_id long, piece int, start int, stop int, n_tokens int, boundary string, text string"
    )
