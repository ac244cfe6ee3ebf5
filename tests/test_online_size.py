"""Online clusters of one large project: the same decisions as by comparing with every concept, in time."""
from __future__ import annotations

import time

import numpy as np
import pandas as pd

from lorequarry.operators import facts as FA


def _facts(spark, vectors: np.ndarray):
    pdf = pd.DataFrame({"project_id": "p", "id": [f"{i:06d}" for i in range(len(vectors))], "kind": "k", "created_at": 0, "embedding": vectors.tolist()})
    return spark.createDataFrame(pdf, "project_id string, id string, kind string, created_at int, embedding array<double>")


def _one_by_one(vectors: np.ndarray, attach: float = 0.88, recheck: float = 0.85) -> dict[str, str]:
    """A wave of one: at ``recheck`` or nearer a fact ends in the nearest concept, else it founds."""
    sums: dict[str, np.ndarray] = {}
    out = {}
    for i, v in enumerate(vectors):
        id_, best = f"{i:06d}", max(((float(s @ v / np.linalg.norm(s) / np.linalg.norm(v)), c) for c, s in sums.items()), default=(0.0, ""))
        out[id_] = best[1] if best[0] >= recheck else id_
        sums[out[id_]] = sums.get(out[id_], 0) + v
    return out


def test_many_concepts_of_one_project(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(12_000, 64))  # hardly any two are near, so nearly all found a concept
    began = time.time()
    got = FA.online_clusters(_facts(spark, v)).select("concept").distinct().count()
    assert got > 11_900 and time.time() - began < 45  # comparing each fact with a new stack of all concepts took minutes


def test_screening_changes_no_decision(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 16))
    v = base[rng.integers(0, 60, 500)] + rng.normal(size=(500, 16)) * rng.uniform(0.1, 0.7, size=(500, 1))
    v *= 10.0 ** rng.integers(-6, 6, size=(500, 1))
    got = {r.id: r.concept for r in FA.online_clusters(_facts(spark, v), wave=1).collect()}
    assert got == _one_by_one(v) and 60 <= len(set(got.values())) < 500
