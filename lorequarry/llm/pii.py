"""Personal information in free text: find it and put typed placeholders in its place.

Emails, telephone numbers, identity numbers and street addresses have a written
form, which patterns describe. Names have none, so they are found by what the
corpus discloses: the sub-terms (letter trigrams) of each term are weighed by
how much more often they occur in protected entities (the known people) than in
the vocabulary of the whole corpus, and a candidate pair of terms counts only if
its terms occur beside another revealing term far more often than chance, i.e.
if the bits they disclose exceed a threshold. All counts are over all documents.

Defined cases: a null or empty field holds nothing; a cut-off or invalid JSON in
``raw`` is read as far as its escapes go; exact repeats of a turn give one row; a
field with no item gives no row; a text of any length is scanned whole.
"""
from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorequarry.llm.mixing import settings
from lorequarry.session import Stored

KINDS = ("email", "phone", "id_number", "address", "name")

# ---- written forms -------------------------------------------------------

_AT = r"(?:\s?[\[({<]\s?at\s?[\])}>]\s?|%40|&#64;|&commat;|[@＠﹫])"
_DOT = r"(?:\s?[\[({<]\s?(?:dot|punkt|point|punto)\s?[\])}>]\s?|[.．])"
EMAIL = re.compile(
    rf"(?<![\w.+%\-])(?!git{_AT})(?P<local>[^\W_](?:[\w.+\-']|%2B)*?){_AT}(?:[^\W_](?:[\w\-]*[^\W_])?{_DOT})+[^\W\d_]{{2,24}}(?![\w])"
    rf"|(?<![\w.+%\-])[^\W_][\w.+\-]*\s(?:at|AT)\s(?:[^\W_][\w\-]*\s(?:dot|DOT)\s)+[^\W\d_]{{2,24}}(?!\w)",
    re.I,
)
_ID_LABEL = (
    r"(?:ssn|itin|tin|nino?|nir|dni|nie|nif|cpf|cnp|pesel|bsn|nid|passports?|passeport|pasaporte|reisepass(?:nummer)?|"
    r"social[ _]security|sozialversicherungs\w*|s[ée]curit[ée] sociale|national insurance|national[ _]id(?:entity)?|"
    r"steuer-?(?:id(?:entifikationsnummer)?|nummer)|idnr|tax(?:payer)?[ _]?id|identity card|personalausweis\w*)"
)
ID_NUMBER = re.compile(
    rf"(?<![\w]){_ID_LABEL}(?:[ _]?(?:number|no|num|nr|n°|card|id))?\.?[\"']?\s{{0,2}}(?:[:=#]|is)?\s{{0,2}}[\"']?"
    r"(?P<v>\d{3}-\d{2}-\d{4}(?![\w\-])|(?=(?:[ .\-]?[A-Z0-9]){6,21}(?![A-Z0-9]))(?=(?:[ .\-]?[A-Z]{0,2}[ .\-]?\d){4})[A-Z0-9](?:[ .\-]?[A-Z0-9]){5,20}?(?=$|[^\w.\- ]|[.\-](?:\W|$)| (?![A-Z]?\d)(?![A-Z]\b)))"
    r"|(?<![\w\-.])\d{3}-\d{2}-\d{4}(?![\w\-])"  # social security
    r"|(?<![\w\-])[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?![\w\-])"  # national insurance
    r"|(?<![\w\-.])[12] ?\d{2} ?(?:0[1-9]|1[0-2]|[2-9]\d) ?(?:\d{2}|2[AB]) ?\d{3} ?\d{3} ?\d{2}(?![\w\-])"  # French register
    r"|(?<![\w\-])\d{8}-?[A-HJ-NP-TV-Z](?![\w\-])",  # Spanish identity
    re.I,
)
PHONE = re.compile(
    r"(?<![\w+\-.])(?:tel:)?\+\d{1,3}(?:[ .\-/]?\(?\d{1,5}\)?){2,6}(?!\w)"  # international
    r"|(?<![\w+\-.])00[1-9]\d{0,2}(?:[ .\-/]\(?\d{1,8}\)?){1,5}(?![\w\-])"  # 00 and country
    r"|(?<![\w+\-.(])(?:1[ .\-])?\(?[2-9]\d{2}\)?[ .\-]\d{3}[ .\-]\d{4}(?:\s?(?:ext|x|extension)\.?\s?\d{1,6})?(?![\w\-])"  # North America
    r"|(?<![\w+\-.])\(0\d{1,4}\)[ .\-/]?\d{3,8}(?:[ .\-/]\d{2,6}){0,3}(?![\w\-])"  # (area) number
    r"|(?<![\w+\-.])0[1-9](?:[ .]\d{2}){4}(?![\w\-])"  # French, in pairs
    r"|(?<![\w+\-.])0\d{2,4}[ /]\d{3,4}[ \-]?\d{3,4}(?![\w\-])"  # British and German trunk forms
    r"|(?<![\w+\-.])0\d{4}[ ]\d{5,6}(?![\w\-])"
    r"|(?<=tel:)\d{7,15}(?!\w)"
    r"|(?:(?<=phone[=: ])|(?<=phone[=:] )|(?<=mobile[=: ])|(?<=mobile[=:] )|(?<=tel[=: ])|(?<=\btel\. )|(?<=phone\": \")|(?<=phone\":\")|(?<=tel\": \")|(?<=tel\":\"))\+?\d{9,15}(?!\w)",
    re.I,
)
_STREET = r"(?:Street|St\.?|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.?|Drive|Dr\.?|Boulevard|Blvd\.?|Close|Way|Court|Ct\.?|Terrace|Crescent|Square|Sq\.?|Place|Pl\.?|Gardens|Grove|Hill|Row|Walk|Parkway|Pkwy\.?|Highway|Hwy\.?)"
_ST_UP = _STREET.upper()
_CAP = r"[^\W\d_a-zß-öø-ÿ][^\W\d_]*(?:['’\-][^\W\d_]+)*"
_FR = r"(?:rue|avenue|boulevard|place|chemin|all[ée]e|impasse|quai|cours|route|square|passage|sentier)"
_DE = r"(?:stra(?:ß|ss|SS)e|STRA(?:SS|ß)E|str\.|STR\.|weg|WEG|gasse|GASSE|platz|PLATZ|allee|ALLEE|ufer|UFER|damm|DAMM|ring|RING)"
ADDRESS_EN = re.compile(
    rf"(?<![\w\-.])\d{{1,5}}[A-Za-z]?,? (?:(?:North|South|East|West|N\.|S\.|E\.|W\.) )?{_CAP}(?: {_CAP}){{0,3}}? (?:{_STREET}|{_ST_UP})(?!\w)(?![ \-][a-z]*-)"
)
ADDRESS_FR = re.compile(
    rf"(?<![\w\-.])\d{{1,5}}(?: ?(?:bis|ter|quater|BIS|TER|[A-D]))?,? (?:{_FR}|{_FR.upper()}) (?:(?:de|du|des|d['’]|la|le|les|l['’]|DE|DU|DES|D['’]|LA|LE|LES|L['’]) ?){{0,2}}{_CAP}(?: {_CAP}){{0,3}}"
)
ADDRESS_DE = re.compile(
    rf"(?<!\w)[^\W\d_a-zß-öø-ÿ][^\W\d_]*(?:[ \-](?:{_CAP}[ \-])?)?(?:(?<![ \-]){_DE}|(?<=[ \-])(?:Stra(?:ß|ss)e|Str\.|Weg|Gasse|Platz|Allee|Ufer|Damm|Ring)) \d{{1,4}}(?: ?[a-zA-Z])?(?!\w)"
)
ADDRESS_ES = re.compile(
    rf"(?<!\w)(?:Calle|CALLE|C/|Avda\.?|Avenida|AVENIDA|Plaza|PLAZA|Paseo|PASEO|Via|VIA|Viale|Piazza|Rua|RUA) (?:(?:de|del|la|las|los|el|da|do|DE|DEL|LA|LAS|LOS) ){{0,2}}{_CAP}(?: {_CAP}){{0,3}},? (?:n[.º°]? ?)?\d{{1,4}}(?!\w)"
)
#: What a text needs to hold an item of a kind at all: cheap tests before the patterns.
_AT_SIGNS = ("@", "%40", "(at)", "[at]", "{at}", "<at>", "( at )", "[ at ]", " dot ", "&#64;", "&commat;", "＠", "﹫")
_LONG_NUMBER = re.compile(r"\d(?:[ .\-/()]{0,2}[A-Za-z]?\d){5}")
_ID_HINT = re.compile(rf"(?<!\w){_ID_LABEL}")
_HOUSE = re.compile(r"\d[A-Za-z]?,? [^\W\d_a-zß-öø-ÿ]")
_DE_HINT = ("straße ", "strasse ", "str. ", "weg ", "gasse ", "platz ", "allee ", "ufer ", "damm ", "ring ")
_ES_HINT = ("calle ", "c/ ", "avda", "avenida ", "plaza ", "paseo ", "via ", "viale ", "piazza ", "rua ")
_FR_HINT = ("rue ", "avenue ", "boulevard ", "place ", "chemin ", "allée ", "allee ", "impasse ", "quai ", "cours ", "route ", "square ", "passage ", "sentier ")


def _patterns(text: str) -> Iterator[tuple[str, re.Pattern]]:
    """The kinds and patterns that can match in a text at all, in order of precedence."""
    low = text.lower()
    if any(x in low for x in _AT_SIGNS):
        yield "email", EMAIL
    long = _LONG_NUMBER.search(text)
    if long or _ID_HINT.search(low):  # behind a label a number may be short or mixed with letters
        yield "id_number", ID_NUMBER
    if long:
        yield "phone", PHONE
    if _HOUSE.search(text):
        yield "address", ADDRESS_EN
    if any(x in low for x in _FR_HINT):
        yield "address", ADDRESS_FR
    if any(x in low for x in _DE_HINT):
        yield "address", ADDRESS_DE
    if any(x in low for x in _ES_HINT):
        yield "address", ADDRESS_ES


def written_forms(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the items that have a written form; none overlap."""
    out: list[tuple[int, int, str]] = []
    for kind, rx in _patterns(text):
        for m in rx.finditer(text):
            a, b = m.span("v") if kind == "id_number" and m.group("v") else m.span()
            if kind == "phone" and not 7 <= sum(c.isdigit() for c in m.group()) <= 20:
                continue
            if all(b <= x or a >= y for x, y, _ in out):
                out.append((a, b, kind))
    return out


# ---- names ---------------------------------------------------------------

WORD = re.compile(r"[^\W\d_]+")
#: Words that stand between a given and a family name.
PARTICLES = frozenset("van von vom de del della der den des di da dos du la le el al bin ben ibn ter ten zu zur o d mac mc st".split())
#: Least mean log-odds of a term's sub-terms (of one written without a capital), and least bits that its company discloses.
SUBTERM_MIN, SUBTERM_LOWER, BITS_MIN = 0.4, 1.3, 4.0
#: A term that makes up more than this share of the corpus is frequent, and its company must disclose more; there are fewer than 1 / share of them.
COMMON_SHARE, COMMON_LEAST = 1 / 32768, 8


def fold(word: str) -> str:
    """A word without case and accents."""
    if word.isascii():
        return word.lower()
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)).lower()


def grams(term: str) -> list[str]:
    """The letter trigrams of a folded term, with its ends."""
    w = f"^{term}$"
    return [w[i : i + 3] for i in range(len(w) - 2)]


class NameModel:
    """Sub-term log-odds for given and family terms, from counts of the corpus and of known people."""

    def __init__(self, given: set[str], family: set[str], neg: dict[str, float]):
        self.given, self.family = given, family
        total = sum(neg.values())
        self.odds = []
        for pos in (given, family):
            p = Counter(g for w in pos for g in grams(w))
            k, sp = len(p.keys() | neg.keys()), sum(p.values())
            low = math.log(0.5 / (sp + 0.5 * k))
            odds = {g: (math.log((p[g] + 0.5) / (sp + 0.5 * k)) if g in p else low) - math.log((neg.get(g, 0) + 0.5) / (total + 0.5 * k)) for g in p.keys() | neg.keys()}
            self.odds.append((odds, low - math.log(0.5 / (total + 0.5 * k))))
        self.cache: dict[str, int] = {}

    def score(self, term: str, which: int) -> float:
        odds, rest = self.odds[which]
        gs = grams(term)
        return sum(odds.get(g, rest) for g in gs) / len(gs)

    def kind(self, word: str) -> int:
        """Bit 1: reveals a given name; bit 2: a family name; bit 4: rather a family than a given name."""
        k = self.cache.get(word)
        if k is None:
            t = fold(word)
            k = 0
            if t in self.given or t in self.family:
                k = (t in self.given) + 2 * (t in self.family)
                if word[0].isupper():
                    k |= (self.score(t, 0) >= SUBTERM_MIN) + 2 * (self.score(t, 1) >= SUBTERM_MIN)
            elif len(t) >= (4 if word[0].isupper() else 5) and t not in PARTICLES:
                least = SUBTERM_MIN if word[0].isupper() else SUBTERM_LOWER
                k = (self.score(t, 0) >= least) + 2 * (self.score(t, 1) >= least)
            if k & 2 and t not in self.given and (t in self.family or self.score(t, 1) > self.score(t, 0)):
                k |= 4
            if len(self.cache) > 400_000:
                self.cache.clear()
            self.cache[word] = k
        return k


_GAP = re.compile(r"[ \t ]{1,3}|[ ]?\n[ ]?")
_BARREL = re.compile(rf"(?:[\-‐–]{_CAP})+")
_COMMA = re.compile(r"[ ]?,[ \t ]{1,3}|,")
_INITIAL_GAP = re.compile(r"\.?[ \t ]{1,3}|\.")


def name_candidates(text: str, model: NameModel, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str, str]]:
    """(start, end, given term or '', family term) of the pairs of revealing terms."""
    get = model.kind
    kinds = set(map(get, set(WORD.findall(text))))
    if not any(k & 2 for k in kinds):
        return []
    toks = [(m.group(), m.start(), m.end()) for m in WORD.finditer(text)]
    out, n = [], len(toks)
    free = lambda a, b: all(b <= x or a >= y for x, y, _ in taken)
    full = _GAP.fullmatch

    def initial(i: int) -> bool:
        return 0 <= i < n and len(toks[i][0]) == 1 and toks[i][0].isupper()

    i = 0
    while i < n:
        w, a, b = toks[i]
        if not get(w) & 2:
            i += 1
            continue
        # the family name: double-barrelled parts after it, particles and O' before it
        last = i
        while last + 1 < n and text[toks[last][2] : toks[last + 1][1]] in ("-", "‐", "–") and (get(toks[last + 1][0]) & 2 or toks[last + 1][0][0].isupper()):
            last += 1
        first = i
        while first and toks[first - 1][0].lower() in PARTICLES and (full(text, toks[first - 1][2], toks[first][1]) or text[toks[first - 1][2] : toks[first][1]] in ("'", "’", "''", "\\'", "‘", "`")):
            first -= 1
        got = None
        p = first - 1
        if p >= 0:
            gap = text[toks[p][2] : toks[first][1]]
            if get(toks[p][0]) & 1 and _GAP.fullmatch(gap):
                got = (toks[p][1], toks[last][2], fold(toks[p][0]))
            elif get(w) & 4 and initial(p) and (_INITIAL_GAP.fullmatch(gap)) and (gap[0] == "." or toks[p][0] not in "AI"):
                q = p - 1
                if q >= 0 and get(toks[q][0]) & 1 and _GAP.fullmatch(text[toks[q][2] : toks[p][1]]):
                    got = (toks[q][1], toks[last][2], fold(toks[q][0]))
                else:
                    got = (toks[p][1], toks[last][2], "")
        if got is None and last + 1 < n:
            gap, nxt = text[toks[last][2] : toks[last + 1][1]], toks[last + 1]
            comma = _COMMA.fullmatch(gap)
            if get(nxt[0]) & 1 and (comma or _GAP.fullmatch(gap)):
                got = (toks[first][1], nxt[2], fold(nxt[0]))
            elif get(w) & 4 and initial(last + 1) and (comma or _GAP.fullmatch(gap)) and text[nxt[2] : nxt[2] + 1] == ".":
                got = (toks[first][1], nxt[2] + 1, "")
        if got and free(got[0], got[1]):
            more = _BARREL.match(text, got[1])
            got = (got[0], more.end() if more else got[1], got[2])
            out.append((got[0], got[1], got[2], fold(w)))
            while i < n and toks[i][2] <= got[1]:
                i += 1
        else:
            i = last + 1
    return out


# ---- JSON escapes --------------------------------------------------------

_ESC = re.compile(r"\\(?:u([0-9a-fA-F]{4})|(.))", re.S)
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


class Unescaped:
    """A text with its escapes resolved, and where each position came from."""

    def __init__(self, raw: str, depth: int = 2):
        self.text, self.maps = raw, []
        for _ in range(depth):
            if "\\" not in self.text:
                break
            src, out, at, starts, froms, pos = self.text, [], 0, [0], [0], 0
            for m in _ESC.finditer(src):
                out.append(src[at : m.start()])
                pos += m.start() - at
                c = chr(int(m.group(1), 16)) if m.group(1) else _PLAIN.get(m.group(2), m.group(2))
                out.append(c)
                starts.append(pos)
                froms.append(m.start())
                pos += 1
                starts.append(pos)
                froms.append(m.end())
                at = m.end()
            out.append(src[at:])
            self.text = "".join(out)
            self.maps.append((starts, froms))

    def origin(self, pos: int) -> int:
        """The position in the raw text of a position in ``text``."""
        for starts, froms in reversed(self.maps):
            k = bisect_right(starts, pos) - 1
            pos = froms[k] + pos - starts[k]
        return pos


Item = tuple[int, int, str, str, str]


def scan(text: str, model: NameModel) -> list[Item]:
    """(start, end, kind, given, family) of every item of one text."""
    found = written_forms(text)
    names = name_candidates(text, model, found)
    return [(a, b, k, "", "") for a, b, k in found] + [(a, b, "name", g, f) for a, b, g, f in names]


def scan_raw(raw: str, text: str | None, known: list[Item], model: NameModel) -> list[Item]:
    """As ``scan`` for a JSON field; the part that repeats the turn's text is not read twice."""
    u = Unescaped(raw)
    t, out = u.text, []
    at = t.find(text) if text and len(text) > 20 else -1
    if at >= 0:
        end = at + len(text)
        # an item may reach over the ends of the repeated part: the rest is read with quotes as its border
        parts = [(0, t[:at]), (end, t[end:])]
        out += [(a + at, b + at, k, g, f) for a, b, k, g, f in known]
    else:
        parts = [(0, t)]
    for off, part in parts:
        out += [(a + off, b + off, k, g, f) for a, b, k, g, f in scan(part, model)]
    return [(u.origin(a), u.origin(b), k, g, f) for a, b, k, g, f in out] if u.maps else out


# ---- the corpus ----------------------------------------------------------


def vocabulary(turns: DataFrame) -> DataFrame:
    """(term, n, caps): how often each folded term occurs in all texts, and how often of that with a capital."""

    def folded(c: Counter) -> pa.RecordBatch:
        out, caps = Counter(), Counter()
        for w, n in c.items():
            t = fold(w)
            out[t] += n
            caps[t] += n * w[0].isupper()
        return pa.RecordBatch.from_pydict({"term": pa.array(list(out), pa.string()), "n": pa.array(list(out.values()), pa.int64()), "caps": pa.array([caps[t] for t in out], pa.int64())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                c.update(WORD.findall(t))
            if len(c) > 300_000:  # bounded memory: what has been counted so far goes out
                yield folded(c)
                c = Counter()
        yield folded(c)

    per = turns.where("text is not null").select("text").mapInArrow(count, "term string, n long, caps long")
    return per.groupBy("term").agg(F.sum("n").alias("n"), F.sum("caps").alias("caps"))


def _gram_weights(vocab: DataFrame, exclude) -> dict[str, float]:
    """Trigram counts over the vocabulary; letters are folded to a-z, so their number is bounded by 28 ** 3."""
    t = vocab.where(F.length("term").between(3, 40) & F.col("term").rlike("^[a-z]+$"))
    if exclude is not None:
        t = t.where(~exclude("term"))
    w = F.concat(F.lit("^"), "term", F.lit("$"))
    g = t.select((F.lit(1.0) + F.log("n")).alias("w"), F.explode(F.transform(F.sequence(F.lit(1), F.length("term")), lambda i: F.substr(w, i, F.lit(3)))).alias("g"))
    return {r["g"]: r["w"] for r in g.groupBy("g").agg(F.sum("w").alias("w")).collect()}


def often(vocab: DataFrame) -> tuple[int, float]:
    """(words of the corpus, occurrences above which a term is frequent)."""
    total = vocab.agg(F.sum("n")).collect()[0][0] or 0
    return total, max(COMMON_LEAST, total * COMMON_SHARE)


def fit_names(spark: SparkSession, vocab: DataFrame, people: DataFrame) -> NameModel:
    """The sub-term model. People is a small fixed table; of the corpus only trigram counts reach the driver."""
    rows = settings(people.select("given_name", "family_name"))
    given = {fold(w) for r in rows if r[0] for w in WORD.findall(r[0]) if len(w) > 2}
    family = {fold(w) for r in rows if r[1] for w in WORD.findall(r[1]) if len(w) > 3 and fold(w) not in PARTICLES}
    model = NameModel(given, family, _gram_weights(vocab, None))
    first = spark.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def reveals(term: pd.Series) -> pd.Series:  # unknown names are not vocabulary: leave them out of it and weigh again
        m = first.value
        return term.map(lambda t: m.kind(t) > 0)

    limit = often(vocab)[1]
    a, b = _gram_weights(vocab.where(F.col("n") > limit), None), _gram_weights(vocab.where(F.col("n") <= limit), reveals)
    for g, w in b.items():
        a[g] = a.get(g, 0.0) + w
    return NameModel(given, family, a)


ITEMS = "turn_id string, field string, items array<struct<start:int,stop:int,kind:string,given:string,family:string>>"


def items(turns: DataFrame, model: NameModel) -> DataFrame:
    """Candidate items of each turn and field; only fields that hold one give a row."""
    b = turns.sparkSession.sparkContext.broadcast(model)

    item = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string()), ("given", pa.string()), ("family", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = b.value
        for batch in batches:
            ids, fields, lists = [], [], []
            for id_, text, raw in zip(*(c.to_pylist() for c in batch.columns)):
                known = scan(text, m) if text else []
                if known:
                    ids.append(id_), fields.append("text"), lists.append(known)
                if raw:
                    r = scan_raw(raw, text, known, m)
                    if r:
                        ids.append(id_), fields.append("raw"), lists.append(r)
            rows = [[dict(zip(("start", "stop", "kind", "given", "family"), x)) for x in l] for l in lists]
            yield pa.RecordBatch.from_pydict({"turn_id": pa.array(ids, pa.string()), "field": pa.array(fields, pa.string()), "items": pa.array(rows, pa.list_(item))})

    return turns.select("id", "text", "raw").mapInArrow(run, ITEMS)


def disclosure(cands: DataFrame, vocab: DataFrame, known: frozenset[str] = frozenset()) -> DataFrame:
    """(term, bits): how many bits of surprise there are in the company a term keeps.

    bits = log2 of (share of a term's occurrences that stand in a candidate
    pair) / (that share over the whole corpus). Terms of known people pass. A
    fixed phrase also keeps one company, so of a frequent term only pairs of two
    whole terms count, and none if it is mostly written without a capital; the
    pairs of frequent terms are left out of the share over the whole corpus.
    """
    total, limit = often(vocab)
    x = cands.select("field", F.explode("items").alias("i")).where("i.kind = 'name'").select("field", "i.given", "i.family")
    in_text = F.col("field") == "text"
    t = x.select("field", (F.col("given") != "").alias("whole"), F.explode(F.array("given", "family")).alias("term")).where("term <> ''")
    t = t.groupBy("term").agg(F.count_if(in_text).alias("in_text"), F.count_if(in_text & F.col("whole")).alias("whole"))
    frequent = vocab.where((F.col("n") > limit) & ~F.col("term").isin(sorted(known))).select("term")
    rest = x.where(in_text).join(frequent.withColumnRenamed("term", "given"), "given", "left_anti").join(frequent.withColumnRenamed("term", "family"), "family", "left_anti")
    base = 2.0 * (rest.count() or 1) / (total or 1)
    v = t.join(vocab, "term", "left")
    pairs = F.when(F.col("n") <= limit, F.col("in_text")).when(2 * F.col("caps") >= F.col("n"), F.col("whole")).otherwise(F.lit(0))
    share = F.when(F.col("n").isNull(), F.lit(1.0)).otherwise((pairs + 0.5) / (F.col("n") + 1.0))
    return v.select("term", F.log2(share / F.lit(base)).alias("bits"), share.alias("share"))


#: Of a term's occurrences, the share that must stand in a candidate pair. Bits alone
#: would let a common word pass in a corpus with few names.
SHARE_MIN = 0.12


def find(spark: SparkSession, turns: DataFrame, people: DataFrame) -> DataFrame:
    """(turn_id, field, kind, start, stop) of every item, repeats of a turn as one."""
    vocab = Stored(spark, vocabulary(turns), "vocabulary")
    model = fit_names(spark, vocab.df, people)
    cands = Stored(spark, items(turns, model), "items")
    known = sorted(model.given | model.family)  # of the people table, a small fixed one
    bits = disclosure(cands.df, vocab.df, frozenset(known))
    bits = bits.where(~F.col("term").isin(known)) if known else bits
    weak = Stored(spark, bits.where((F.col("bits") < BITS_MIN) | (F.col("share") < SHARE_MIN)).select("term"), "weak")
    flat = cands.df.select("turn_id", "field", F.explode("items").alias("i")).select("turn_id", "field", "i.*").distinct()
    names = flat.where("kind = 'name'")
    w = weak.df
    names = names.join(w.withColumnRenamed("term", "given"), "given", "left_anti").join(w.withColumnRenamed("term", "family"), "family", "left_anti")
    cols = ["turn_id", "field", "kind", "start", "stop"]
    return flat.where("kind <> 'name'").select(cols).union(names.select(cols))


def found(spark: SparkSession, turns: DataFrame, people: DataFrame) -> DataFrame:
    """(turn_id, field, kind): which kinds each field holds."""
    return find(spark, turns, people).select("turn_id", "field", "kind").distinct()


def redact(spark: SparkSession, turns: DataFrame, people: DataFrame) -> DataFrame:
    """The turns with ``<EMAIL>``, ``<PHONE>`` … in place of the items of text and raw, one row each as given."""
    per = find(spark, turns, people).groupBy("turn_id", "field").agg(F.array_sort(F.collect_set(F.struct("start", "stop", "kind"))).alias("spans"))
    wide = per.groupBy("turn_id").agg(*[F.max(F.when(F.col("field") == f, F.col("spans"))).alias(f"_{f}") for f in ("text", "raw")])

    @F.pandas_udf("string")
    def put(text: pd.Series, spans: pd.Series) -> pd.Series:
        def one(t, ss):
            if t is None or ss is None:
                return t
            out, at = [], 0
            for s in ss:
                if s["start"] >= at:
                    out += [t[at : s["start"]], f"<{s['kind'].upper()}>"]
                    at = s["stop"]
            return "".join(out) + t[at:]

        return pd.Series([one(t, s) for t, s in zip(text, spans)], dtype=object)

    j = turns.join(wide, turns["id"] == wide["turn_id"], "left")
    return j.select(*[(put(F.col(c), F.col(f"_{c}")).alias(c) if c in ("text", "raw") else turns[c]) for c in turns.columns])
