"""Every registered core query that has SQL agrees with it on the smallest tables."""
import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
D = "/root/testdata/sf0.001"
from lorequarry.plans import catalogue as c  # noqa: E402


def flat(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 4)
    if isinstance(v, (list, tuple)):
        return tuple(flat(x) for x in v)
    return round(float(v), 4) if type(v).__name__ == "Decimal" else v


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
@pytest.mark.parametrize("name", sorted(c.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(D):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{D}/{f}')")
    df = c.Q[name](spark, D)
    cols = sorted(df.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((tuple(flat(r[k]) for k in cols) for r in df.collect()), key=key)
    cur = con.execute(c.SQL[name])
    at = [[x[0] for x in cur.description].index(k) for k in cols]
    assert got == sorted((tuple(flat(r[i]) for i in at) for r in cur.fetchall()), key=key)
