"""Agents: cached row functions with a pluggable backend.

An agent maps a JSON payload to a JSON reply. Rows whose (agent, model, version,
input) key is in the cache never reach the backend; the others go through
``mapInPandas`` in batches and come back as rows to append to the cache. The
default backends are rules that run offline and give the same reply each time.
"""
from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Backend = Callable[[dict], dict]
CACHE = "input_hash string, agent_name string, model string, ok boolean, output string, produced_at long"


@dataclass(frozen=True)
class Agent:
    name: str
    version: str
    required: tuple[str, ...]
    backend: Backend
    model: str = "rules"


def run_agent(rows: DataFrame, agent: Agent, cache: DataFrame | None, now_ms: int, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(rows with ``ok`` and ``output``, new cache rows). A reply that lacks a required field is a failure, tried twice."""
    keyed = rows.withColumn("input_hash", F.sha2(F.concat_ws("|", F.lit(agent.name), F.lit(agent.model), F.lit(agent.version), F.col(payload)), 256))
    distinct = keyed.select("input_hash", payload).dropDuplicates(["input_hash"])
    todo = distinct if cache is None else distinct.join(cache.where("ok").select("input_hash"), "input_hash", "left_anti")

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf[payload]:
                reply, ok = None, False
                for _ in range(2):
                    try:
                        reply = agent.backend(json.loads(text))
                        ok = all(k in reply for k in agent.required)
                    except (ValueError, KeyError, TypeError):
                        ok = False
                    if ok:
                        break
                out.append((ok, json.dumps(reply, sort_keys=True) if ok else None))
            yield pd.DataFrame({
                "input_hash": pdf["input_hash"], "agent_name": agent.name, "model": agent.model,
                "ok": [o for o, _ in out], "output": pd.Series([t for _, t in out], dtype=object), "produced_at": now_ms,
            })

    fresh = todo.select("input_hash", payload).mapInPandas(call, CACHE)
    known = fresh if cache is None else fresh.unionByName(cache)
    return keyed.join(known.select("input_hash", "ok", "output").dropDuplicates(["input_hash"]), "input_hash", "left"), fresh


def expire(cache: DataFrame, agent: str, now_ms: int, days: int = 30) -> DataFrame:
    """The cache without this agent's replies older than ``days``."""
    return cache.where((F.col("agent_name") != agent) | (F.col("produced_at") >= now_ms - days * 86_400_000))


# ---- offline backends ----

_BUG = re.compile(r"\b(?:bug|error|exception|fail(?:s|ed|ure)?|crash|traceback|broken|fix(?:ed)?)\b", re.I)
_DECIDE = re.compile(r"\b(?:we (?:agreed|decided)|decision|instead of|should|must|never|always)\b", re.I)
_BUSINESS = re.compile(r"\b(?:customer|invoice|order|contract|account|ledger|compliance)\b", re.I)
_OPS = re.compile(r"\b(?:deploy|docker|pipeline|cluster|terraform|kubernetes|ci)\b", re.I)
_ARCH = re.compile(r"\b(?:architecture|design|module|interface|schema|service)\b", re.I)


def triage_rules(p: dict) -> dict:
    t = p.get("text") or ""
    short = len(t) < 60
    domain = "debugging" if _BUG.search(t) else "business_logic" if _BUSINESS.search(t) else "devops" if _OPS.search(t) else "architecture" if _ARCH.search(t) else "implementation"
    return {
        "relevance": "chitchat" if short else "on_topic", "domain": domain, "quality": "noise" if not t.strip() else "decision_grade" if _DECIDE.search(t) else "signal",
        "linkage": "linked" if re.search(r"[\w\-]+/[\w\-]+\.\w+|`\w+`", t) else "unlinked", "activity": "bugfix" if domain == "debugging" else "feature", "confidence": 0.9 if short else 0.7,
    }


def doc_kind_rules(p: dict) -> dict:
    head = (p.get("text") or "")[:400].lower()
    kinds = (("adr", ("status: accepted", "# adr", "decision record")), ("runbook", ("runbook", "rollback", "on-call")), ("changelog", ("changelog", "## [")), ("postmortem", ("postmortem", "root cause")), ("readme", ("readme", "install")))
    return {"doc_kind": next((k for k, words in kinds if any(w in head for w in words)), "other"), "topics": sorted(set(re.findall(r"(?m)^#+\s+(\w+)", head)))[:8]}


def extract_rules(p: dict) -> dict:
    """Facts from sentences that state a decision, a problem or a solution."""
    out = []
    for s in re.split(r"(?<=[.!?])\s+", p.get("text") or ""):
        kind = "decision" if _DECIDE.search(s) else "problem" if _BUG.search(s) else None
        if kind and len(s) > 20:
            out.append({"kind": kind, "title": s[:120], "confidence": 0.6, "anchors": re.findall(r"\b[A-Z][A-Z0-9]{1,9}-\d+\b|[\w\-]+/[\w\-/]+\.\w+|`\w+`", s)[:5]})
    return {"facts": out[:8]}


_KINDS = (
    ("requirement", re.compile(r"\b(?:needs? to|has to|shall|is required to|should support|requirement)\b", re.I)),
    ("intent", re.compile(r"\b(?:I want|I would like|let's|we plan|the goal is|going to)\b", re.I)),
    ("solution", re.compile(r"\b(?:fixed by|solved by|the fix|workaround|resolved)\b", re.I)),
    ("business_rule", re.compile(r"\b(?:must|never|always|only if|at most|at least)\b.*\b(?:customer|invoice|order|contract|account|ledger)\b", re.I)),
    ("constraint", re.compile(r"\b(?:must not|cannot|limit(?:ed)? to|no more than)\b", re.I)),
    ("problem", _BUG), ("decision", _DECIDE),
)
#: The kinds that each of the five extractors may give.
EXTRACTED = {
    "decision": ("decision", "constraint"), "business_logic": ("business_rule", "constraint"), "requirements": ("requirement",),
    "intent": ("intent",), "problem_solution": ("problem", "solution"),
}


def _sentences(text: str | None) -> list[str]:
    return [s.strip() for s in re.split(r"(?<=[.!?])\s+|\n+", text or "") if len(s.strip()) > 20]


def kind_rules(kinds: tuple[str, ...]) -> Backend:
    """A backend that gives the sentences of some kinds as facts."""

    def rules(p: dict) -> dict:
        out = []
        for s in _sentences(p.get("text")):
            kind = next((k for k, rx in _KINDS if k in kinds and rx.search(s)), None)
            if kind:
                out.append({"kind": kind, "title": s[:120], "confidence": 0.6, "anchors": re.findall(r"\b[A-Z][A-Z0-9]{1,9}-\d+\b|[\w\-]+/[\w\-/]+\.\w+|`\w+`", s)[:5]})
        return {"facts": out[:8]}

    return rules


def incident_rules(p: dict) -> dict:
    """Sentences that name a fault and its cause, with the next one that names a fix."""
    out, ss = [], _sentences(p.get("text"))
    for i, s in enumerate(ss):
        m = re.search(r"(.{10,}?)\b(?:because of|because|caused by|due to|root cause (?:is|was))\b\s*(.{5,})", s, re.I)
        if m and _BUG.search(s):
            fix = next((x for x in ss[i + 1 : i + 6] if _KINDS[2][1].search(x)), None)
            out.append({"problem": m[1].strip(" ,")[:200], "root_cause": m[2].strip(" .")[:200], "resolution": fix[:200] if fix else None, "evidence": s[:300]})
    return {"incidents": out[:5]}


def verify_rules(p: dict) -> dict:
    a, b = set(re.findall(r"\w+", (p.get("a") or "").lower())), set(re.findall(r"\w+", (p.get("b") or "").lower()))
    same = len(a & b) / max(1, len(a | b))
    neg = ("not" in a or "never" in a) != ("not" in b or "never" in b)
    return {"verdict": "contradicts" if same > 0.5 and neg else "supersedes" if same > 0.8 else "compatible", "confidence": round(same, 2)}


def link_rules(p: dict) -> dict:
    c = float(p.get("cosine") or 0)
    return {"relation": "same_as" if c >= 0.92 else "variant_of" if c >= 0.78 else "none", "confidence": round(c, 2)}


def summary_rules(p: dict) -> dict:
    titles = [t for t in p.get("titles") or [] if t]
    return {"name": min(titles, key=lambda t: (len(t), t)) if titles else "", "summary": "; ".join(sorted(titles)[:5])}


def layer_rules(p: dict) -> dict:
    path = (p.get("path") or "").lower()
    rules = (("test", r"test|spec"), ("ui", r"view|component|page|\.tsx$"), ("data", r"model|store|db|sql|migration"), ("api", r"api|route|controller|server"), ("infra", r"deploy|infra|docker|ci"))
    return {"layer": next((n for n, rx in rules if re.search(rx, path)), "other"), "tags": []}


TRIAGE = Agent("triage", "1", ("relevance", "domain", "quality", "linkage", "activity", "confidence"), triage_rules)
DOC_KIND = Agent("source_classifier", "1", ("doc_kind", "topics"), doc_kind_rules)
EXTRACT = Agent("window_extractor", "1", ("facts",), extract_rules)
VERIFY = Agent("verifier", "1", ("verdict", "confidence"), verify_rules)
LINK = Agent("linker", "1", ("relation", "confidence"), link_rules)
SUMMARIZE = Agent("summarizer", "1", ("name", "summary"), summary_rules)
LAYER = Agent("file_analyzer", "1", ("layer", "tags"), layer_rules)
INCIDENT = Agent("incident", "1", ("incidents",), incident_rules)
EXTRACTORS = {name: Agent(name, "1", ("facts",), kind_rules(kinds)) for name, kinds in EXTRACTED.items()}


def store_runs(fresh: DataFrame, path: str) -> None:
    """Add the replies of a run to the cache at ``path``; ``run_agent`` takes that table as its cache next time."""
    fresh.write.mode("append").parquet(path)
