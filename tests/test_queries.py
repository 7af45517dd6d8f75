import os

import duckdb
import pytest

import __spark_entry__

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"create view {t} as select * from read_parquet('{p if os.path.isfile(p) else p + '/*'}')")
    return c


def plain(v):
    if v is None or isinstance(v, (bool, str, int)):
        return str(v)
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    return f"{float(v) + 0.0:.6f}"


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_same_as_sql(spark, con, name):
    df = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(df.columns)
    cur = con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = sorted([plain(r[names.index(c)]) for c in columns] for r in cur.fetchall())
    assert sorted([plain(r[c]) for c in columns] for r in df.select(columns).collect()) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
