"""The history index on texts that meet often by chance: what is shuffled, and what the sketches let pass."""
from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorequarry.llm import history

DOC = "doc_id string, batch long, text string"


def _shuffled(spark) -> int:
    seen = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(seen.apply(i).totalShuffleWrite() for i in range(seen.size()))


def test_pairs_that_meet_by_chance_are_not_shuffled(spark, tmp_path):
    rnd = random.Random(21)
    texts = [" ".join(f"w{rnd.randrange(10)}" for _ in range(40)) for _ in range(3000)]
    rows = [(f"{i}", 1 + i % 2, t) for i, t in enumerate(texts)] + [(f"n{i}", 3, texts[i] + " more") for i in range(40)]
    before = _shuffled(spark)
    got = history.HistoryIndex(spark, f"file://{tmp_path}/index", ranges=4).accept("all", spark.createDataFrame(rows, DOC))
    assert {r.doc_id for r in got.collect()} == {f"n{i}" for i in range(40)}
    assert _shuffled(spark) - before < 10_000_000


@pytest.mark.parametrize("percent", [50, 70, 90])
def test_sketches_rule_out_no_near_pair(spark, tmp_path, percent):
    rng = np.random.default_rng(percent)
    pairs = []
    for n in [28, 60, 127, 128, 129, 150, 180, 300] * 40:
        both = rng.integers(0, 2**63 - 1, int(rng.integers(n * percent // 100, n + 1)))
        pairs.append([np.concatenate([both, rng.integers(0, 2**63 - 1, int(rng.integers(0, n - len(both) + 1)))]) for _ in range(2)])
    flat = [v for p in pairs for v in p]
    marks = [a.to_pylist() for a in history.sketches(np.concatenate(flat), np.array([len(v) for v in flat]))]
    rows = [(len(a), len(b), len(np.intersect1d(a, b)), *[m[2 * i] for m in marks], *[m[2 * i + 1] for m in marks]) for i, (a, b) in enumerate(pairs)]
    names = ["qn", "hn", "same", *[f"q{c}" for c in history.SKETCH], *[f"h{c}" for c in history.SKETCH]]
    index = history.HistoryIndex(spark, f"file://{tmp_path}/index", percent=percent)
    df = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in names)).withColumn("near", index._near(F.col("same"), F.col("qn"), F.col("hn")))
    seen = df.withColumn("alike", index._alike("q", "h")).collect()
    assert all(r.alike for r in seen if r.near) and sum(r.near for r in seen) > 50


def test_rounds_and_heavy_cells_change_nothing(spark, tmp_path, monkeypatch):
    rnd = random.Random(23)
    base = [[f"w{rnd.randrange(80)}" for _ in range(40)] for _ in range(12)]
    rows = []
    for b in range(4):
        for k in range(25):
            w = list(rnd.choice(base))
            for _ in range(rnd.choice([0, 1, 2, 3, 5])):
                w[rnd.randrange(len(w))] = f"w{rnd.randrange(80)}"
            rows.append((f"{b}-{k}", b, " ".join(w)))
    sets = {i: (b, set(zip(t.split(), t.split()[1:], t.split()[2:]))) for i, b, t in rows}
    want = {i for i, (b, s) in sets.items() if any(c < b and len(s & t) / len(s | t) >= 0.7 for c, t in sets.values())}
    monkeypatch.setattr(history, "ROUND_CELLS", 300)
    monkeypatch.setattr(history, "CELL_ROWS", 3)
    whole = history.HistoryIndex(spark, f"file://{tmp_path}/one", ranges=3)
    assert {r.doc_id for r in whole.accept("all", spark.createDataFrame(rows, DOC)).collect()} == want
    got = set()
    for b in range(4):
        parts = history.HistoryIndex(spark, f"file://{tmp_path}/many", ranges=3)
        got |= {r.doc_id for r in parts.accept(f"b{b}", spark.createDataFrame([r for r in rows if r[1] == b], DOC)).collect()}
    assert got == want and len(want) > 20
