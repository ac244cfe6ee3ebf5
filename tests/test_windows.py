"""Windows over whole tables, against a plain loop over the turns as they are stored."""
import os
import random

import pytest

from lorequarry.operators import windows as W
from lorequarry.plans import catalogue as c

D = "/root/testdata/sf0.001"
TURN = "id string, session_id string, idx int, role string, text string, ts long, raw string"


def loop(turns, max_turns=12, max_chars=8000, role=lambda r: (r or "").strip().lower()):
    """(session_id, start_idx, end_idx, n_turns, text) of turns(id, session_id, idx, role, text, ts)."""
    out, sessions = [], {}
    for t in set(turns):
        if t[1] is not None:
            sessions.setdefault(t[1], []).append(t)
    for s, ts in sessions.items():
        ts = sorted((t for t in ts if t[2] is not None), key=lambda t: (t[2], t[0])) + sorted((t for t in ts if t[2] is None), key=lambda t: (t[5] is None, t[5] or 0, t[0]))
        last, exchanges = max((t[2] for t in ts if t[2] is not None), default=-1), []
        for t in ts:
            last += t[2] is None
            idx = last if t[2] is None else t[2]
            if role(t[3]) == "user":
                exchanges.append([])
            if exchanges:
                exchanges[-1].append((idx, t[3] or "", t[4] or ""))
        for e in exchanges:
            kept = [t for k, t in enumerate(e[:max_turns]) if sum(len(x[2]) for x in e[:k]) < max_chars]
            if any(role(r) in ("assistant", "tool") for _, r, _ in kept):
                out.append((s, kept[0][0], kept[-1][0], len(kept), "\n\n".join(f"[{r}] {x}" for _, r, x in kept).strip()))
    return sorted(out)


def segmented(df, *caps):
    return sorted((r.session_id, r.start_idx, r.end_idx, r.n_turns, r.text) for r in W.segment(df, *caps).collect())


def test_sessions_without_idx_and_turns_that_share_one(spark):
    rows = [
        ("a2", "a", None, "assistant", "late", 20, None), ("a1", "a", None, "user", "early", 10, None), ("a3", "a", None, "tool", "no time", None, None),
        ("b1", "b", 0, "user", "q", 1, None), ("b2", "b", 1, "assistant", "one", 2, None), ("b3", "b", 1, "assistant", "other", 2, None), ("b4", "b", None, "tool", "more", 0, None),
    ]
    assert segmented(spark.createDataFrame(rows, TURN)) == [
        ("a", 0, 2, 3, "[user] early\n\n[assistant] late\n\n[tool] no time"),
        ("b", 0, 2, 4, "[user] q\n\n[assistant] one\n\n[assistant] other\n\n[tool] more"),
    ]


def test_roles_count_without_blanks_and_case(spark):
    rows = [("a", "s", 0, " User", "q", 1, None), ("b", "s", 1, "ASSISTANT", "x", 2, None), ("c", "s", 2, "user\n", "r", 3, None), ("d", "s", 3, "Tool ", "y", 4, None)]
    assert segmented(spark.createDataFrame(rows, TURN)) == [("s", 0, 1, 2, "[ User] q\n\n[ASSISTANT] x"), ("s", 2, 3, 2, "[user\n] r\n\n[Tool ] y")]


def test_disordered_turns_match_the_loop(spark):
    random.seed(11)
    rows = []
    for s in range(80):
        kind = s % 4  # clean, no idx at all, some idx missing, some idx shared
        for i in range(random.randint(0, 14)):
            idx = i if kind == 0 else None if kind == 1 or kind == 2 and random.random() < 0.3 else i // 2 if kind == 3 else i
            rows.append((f"{random.randint(0, 999)}-{s}-{i}", str(s), idx, random.choice(["user", "assistant", "tool", None, " User", "ASSISTANT\n", "Tool "]), "x" * random.randint(0, 40), random.choice([None, random.randint(0, 30)]), None))
    for caps in ((4, 70), (12, 8000)):
        assert segmented(spark.createDataFrame(rows, TURN), *caps) == loop([r[:6] for r in rows], *caps)


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
def test_queries_see_every_turn(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{D}/turns.parquet").select("id", "session_id", "idx", "role", "text", "ts").collect()]
    for q, caps in ((c.segment_windows, ()), (c.segment_windows_small_caps, (2, 150))):
        got = sorted((r.session_id, r.start_idx, r.end_idx, r.n_turns) for r in q(spark, D).collect())
        assert got == [x[:4] for x in loop(rows, *caps)]
