"""Every query with SQL against DuckDB on the smallest tables, and the others for rows."""

import duckdb
import pytest

from voxloom.operators import objects
from voxloom.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def test_jaws_split_at_the_upper_median(spark):
    rows = [(v, k, 0.0, 0.0, None if k % 7 == 0 else float(k * 13 % 11)) for v in (1, None) for k in range(24 + (v or 0))]
    got = objects.split_jaws(spark.createDataFrame(rows, "volume_id long, id long, x double, y double, z double"))
    assert "collect_list" not in got._jdf.queryExecution().toString()  # no row carries its whole group
    out = {(x["volume_id"], x["id"]): x["jaw"] for x in got.collect()}
    assert len(out) == len(rows)
    for v in (1, None):
        zs = sorted(z for w, _, _, _, z in rows if w == v and z is not None)
        assert all(out[w, k] == ("upper" if z is not None and z >= zs[len(zs) // 2] else "lower") for w, k, _, _, z in rows if w == v)


def _rows(frame):
    cols = sorted(frame.columns)
    f = frame[cols].astype(object)
    return cols, sorted(map(tuple, f.where(f.notna(), None).to_numpy().tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    if name in registry.ORACLES:
        assert _rows(got) == _rows(con.execute(registry.ORACLES[name]).df())
    else:
        assert len(got)
