"""Names of people who are not known, however often they are mentioned."""
import random

from lorequarry.llm import pii

PEOPLE = [("Marianne", "Petersen"), ("Katarina", "Andersen"), ("Christine", "Johansen"), ("Henriette", "Sorensen"), ("Josephine", "Lindström"), ("Marietta", "Hendriksen")]


def test_a_hot_name_is_found_and_a_hot_phrase_is_not(spark):
    random.seed(2)
    words = [f"{a}{b}{c}" for a in ("bu", "go", "xi", "wu", "plo") for b in ("zz", "gg", "kk", "ff") for c in ("ow", "up", "ix", "og")]
    text = lambda: " ".join(random.choices(words, k=40))
    rows = [(f"hot{i}", "s", i, "user", f"{text()} Katrine Andriksen {text()}", i, None) for i in range(200)]
    rows += [(f"rare{i}", "s", i, "user", f"{text()} Christina Johannsen {text()}", i, None) for i in range(2)]
    rows += [(f"phrase{i}", "s", i, "user", f"{text()} katrinen Lindsen {text()}", i, None) for i in range(200)]
    rows += [(f"plain{i}", "s", i, "user", text(), i, None) for i in range(200)]
    turns = spark.createDataFrame(rows, "id string, session_id string, idx int, role string, text string, ts long, raw string")
    people = spark.createDataFrame([(i, g, f, None) for i, (g, f) in enumerate(PEOPLE)], "person_id int, given_name string, family_name string, handle string")
    got = {r.turn_id for r in pii.found(spark, turns, people).where("kind = 'name'").collect()}
    assert got == {r[0] for r in rows if r[0].startswith(("hot", "rare"))}
    out = {r.id: r.text for r in pii.redact(spark, turns, people).collect()}
    assert all("Andriksen" not in out[f"hot{i}"] and "<NAME>" in out[f"hot{i}"] for i in range(200))
