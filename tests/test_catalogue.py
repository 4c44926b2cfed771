"""Every query of the core against its SQL in DuckDB."""

import itertools
import math
import os

import duckdb
import pytest

from spectrail.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else v


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, sf_dir, name):
    df = catalogue.queries()[name](spark, sf_dir)
    rows = df.collect()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = duck.execute(sql)
    columns = sorted(d[0] for d in found.description)
    assert sorted(df.columns) == columns
    names = [d[0] for d in found.description]
    theirs = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in found.fetchall()), key=repr)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=repr)
    assert len(mine) == len(theirs)
    for a, b in zip(sorted(mine, key=lambda r: [str(x) for x in r]), sorted(theirs, key=lambda r: [str(x) for x in r]), strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and x == pytest.approx(y, rel=1e-6, abs=2e-6)), (name, a, b)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", ["star_and_disc"])
def test_broadcasts_read_no_table(spark, sf_dir, name):
    """Only generated tables of a fixed size go through the driver."""
    lines = catalogue.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    below = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below += itertools.takewhile(lambda j: depth[j] > depth[i], range(i + 1, len(lines)))
    assert any("FileScan" in line for line in lines)
    assert not [lines[j] for j in below if "FileScan" in lines[j]]


def test_resample_own_halfway_between_samples(spark, tmp_path):
    """Vectors for which a wanted place is as near to two samples, those beside them, and one without any."""
    ids = [0, *(i + d for i in (520, 2345, 4464, 6289, 8408, 10527) for d in (-1, 0, 1))]
    rows = [(i, [float((i * 31 + k * 17) % 101) for k in range(64)]) for i in ids]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["vec_id"], r["j"]): r["z"] for r in catalogue.queries()["resample_own"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == {(i, j): z for i, j, z in con.execute(catalogue.oracle_sql()["resample_own"]).fetchall()}


def test_star_and_disc_joins_no_parts(spark, tmp_path):
    """A sum of two models of one row: nothing is shuffled, and parts that share a key give a row each, as in SQL."""
    spark.createDataFrame([(k, 1) for k in (0, 1, 1, 7, 7, 7, 9999)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    df = catalogue.queries()["star_and_disc"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    key = lambda r: [str(x) for x in r]
    theirs = sorted(con.execute(catalogue.oracle_sql()["star_and_disc"]).fetchall(), key=key)
    assert len(theirs) == 7 * 12 and sorted((tuple(r) for r in df.collect()), key=key) == theirs
