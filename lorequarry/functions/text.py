"""Column functions on text: trimming, names, full-text terms, labels and scores."""
from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorequarry import schema as S

_c = F.col


def col(c: Column | str) -> Column:
    return _c(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """White space of every kind off both ends (``trim`` takes spaces only)."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def sha_id(*parts) -> Column:
    """16 hex digits of the SHA-1 of the parts, joined by ``|``."""
    return F.substring(F.sha1(F.concat_ws("|", *[col(p).cast("string") for p in parts])), 1, 16)


def middle_trim(c, limit: int, reserve: int = 40) -> Column:
    """The first and last part of a text over the limit, with a note of how much is gone between."""
    c, half = col(c), (limit - reserve) // 2
    note = F.concat(F.lit("\n\n...[trimmed "), (F.length(c) - limit).cast("string"), F.lit(" chars]...\n\n"))
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, half), note, F.substring(c, -half, half))).otherwise(c)


def entity_name(c) -> Column:
    """A name for matching: lower case, letters and digits, one trailing s off if more than three are left."""
    n = F.regexp_replace(F.lower(col(c)), "[^a-z0-9]", "")
    return F.when((F.length(n) > 3) & n.endswith("s"), F.regexp_replace(n, "s$", "")).otherwise(n)


def skill_name(c) -> Column:
    """Lower case, runs of white space as one blank, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(col(c)), r"\s+", " "))


def drop_repeated_lines(c) -> Column:
    """Lines without those over 20 characters that repeat the last one kept, and without rules after the first.

    A dropped repeat is equal to the line kept before it, so each line is held
    against its neighbour only, in one pass.
    """
    bare = lambda x: F.regexp_replace(x, r"\s+$", "")
    lines = F.filter(F.split(col(c), "\n"), lambda x, i: (i == 0) | ~bare(x).rlike(r"^[-+]{3,}$"))
    shifted = lambda a: F.concat(F.array(F.lit(None).cast("string")), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))))
    pairs = lambda a: F.zip_with(a, shifted(a), lambda x, p: F.when(~F.coalesce((bare(x) == bare(p)) & (F.length(bare(x)) > 20), F.lit(False)), x))
    # the lines as a variable of an outer function: worked out once, not once a line
    return F.array_join(F.array_compact(F.get(F.transform(F.array(lines), pairs), F.lit(0))), "\n")


def clean_turn(c, limit: int = 12_000) -> Column:
    """A turn's text without thinking fences, repeats, rules and housekeeping opener, trimmed in the middle."""
    t = strip(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?is)```(?:thinking|thought).*?```", ""))
    t = strip(drop_repeated_lines(t))
    t = strip(F.regexp_replace(t, r"(?i)^(?:I'll |I will |Let me |Sure[,!]? |Okay[,!]? )", ""))
    return middle_trim(t, limit)


def file_tier(path) -> Column:
    """0 tests, fixtures, vendored and generated files; 1 entry files; 2 the rest."""
    p = F.regexp_replace(col(path), r"\\", "/")
    skip = p.rlike(r"/__tests__/|/__mocks__/|/fixtures?/|\.(?:test|spec)\.[cm]?[jt]sx?$|\.generated\.|/vendor/")
    entry = p.rlike(r"(?:^|/)(?:index|main|app|server|cli)\.[cm]?[jt]sx?$")
    return F.when(skip, 0).when(entry, 1).otherwise(2)


def scope_of_domain(domain) -> Column:
    """The scope that a domain label stands for."""
    d = col(domain)
    return F.when(d == "business_logic", "industry").when(d.isin("architecture", "implementation", "debugging", "devops"), "technical").otherwise("meta")


def level(weight, projects) -> Column:
    """The proficiency level for a summed weight and a number of projects."""
    w, p = col(weight), col(projects)
    return (
        F.when((w >= 12) | (p >= 4), "expert").when((w >= 6) | (p >= 3), "proficient")
        .when((w >= 3) | (p >= 2), "competent").when(w >= 1, "advanced_beginner").otherwise("novice")
    )


def project_status(idle_days, limit: int = 90) -> Column:
    """active up to ``limit`` idle days, archived beyond or if never seen."""
    return F.when(col(idle_days) <= limit, "active").otherwise("archived")


def idle_days(last_ms, now_ms) -> Column:
    """Whole days since a time, rounded, at least 0; null if there is none."""
    days = F.floor((F.lit(now_ms) - col(last_ms)) / 86_400_000.0 + 0.5)
    return F.when(col(last_ms).isNotNull(), F.greatest(F.lit(0).cast("long"), days))


def round2(c) -> Column:
    """Two decimals, halves up."""
    return F.floor(col(c) * 100 + 0.5) / 100


def language_weight(files) -> Column:
    return F.least(F.lit(3.0), 1 + F.log10(col(files) + 1))


# ---- full text ----


def _unaccented() -> tuple[str, str]:
    """The letters of the Latin, Greek and Cyrillic blocks that carry marks, and the letters under them."""
    ranges = (range(0xC0, 0x530), range(0x1E00, 0x2000))
    pairs = [(chr(i), unicodedata.normalize("NFD", chr(i))) for r in ranges for i in r if chr(i).islower()]
    pairs = [(a, b[0]) for a, b in pairs if len(b) > 1 and all(unicodedata.combining(x) for x in b[1:])]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _BARE = _unaccented()


def plain(c) -> Column:
    """Lower case without accents, terms apart by one blank, a blank at either end."""
    c = F.lower(F.coalesce(col(c), F.lit("")))
    bare = F.regexp_replace(F.translate(c, _MARKED, _BARE), r"\p{Mn}+", "")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def has_phrase(columns: list, term: str) -> Column:
    """Whether any of the columns holds the terms of a phrase next to each other."""
    want = plain(F.lit(term))
    out = F.lit(False)
    for c in columns:
        out = out | F.contains(plain(c), want)
    return out


def matches(columns: list, query: str, every: bool = True) -> Column:
    """Whether all (or any) of the blank-separated parts of a query occur; nothing matches an empty query."""
    parts = [has_phrase(columns, p) for p in query.split() if p.strip('"\'')]
    if not parts:
        return F.lit(False)
    out = parts[0]
    for p in parts[1:]:
        out = (out & p) if every else (out | p)
    return out


def holds(c, needle: str) -> Column:
    """Case-insensitive contains, taking ``%`` and ``_`` literally."""
    return F.contains(F.lower(col(c)), F.lit(needle.lower()))


def strip_tags(c) -> Column:
    """Markup out, common entities decoded, white space as single blanks."""
    t = F.regexp_replace(col(c), "<[^>]*>", " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&nbsp;", " "), ("&#10;", " "), ("&#[xX][aA];", " ")):
        t = F.regexp_replace(t, a, b)
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def cache_key(*parts) -> Column:
    """SHA-256 of the parts as one JSON object."""
    return F.sha2(F.to_json(F.struct(*[col(p) for p in parts])), 256)


def clamp(c, limit: int, marker: str = "\n...[trimmed]...\n", reserve: int = 32) -> Column:
    """The two ends of a text over the limit around a marker."""
    c, half = col(c), (limit - reserve) // 2
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, half), F.lit(marker), F.substring(c, -half, half))).otherwise(c)


def known_level(c) -> Column:
    """A written level in its normal spelling, or ``competent`` for what is none."""
    n = F.regexp_replace(F.lower(strip(c)), r"[\s\-]+", "_")
    return F.when(n.isin(*S.LEVELS), n).otherwise("competent")


def written_fields(c) -> Column:
    """The entries of a map of strings whose value is more than blanks, with trimmed values."""
    return F.transform_values(F.map_filter(col(c), lambda k, v: F.length(strip(v)) > 0), lambda k, v: strip(v))


def org_of_remote(url) -> Column:
    """The owner that a repository's remote names, in scp or URL form; null if it has neither form."""
    u = col(url)
    scp = F.regexp_extract(u, r"^[^@\s]+@[^:\s]+:([^/\s]+)/[^/\s]+?(?:\.git)?$", 1)
    web = F.regexp_extract(u, r"^[a-z]+://[^/\s]+/([^/\s]+)/[^/\s]+?(?:\.git)?/?$", 1)
    return F.nullif(F.coalesce(F.nullif(scp, F.lit("")), web), F.lit(""))
