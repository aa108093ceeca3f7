"""Registered queries take all rows of their tables, not some ids."""

import bisect
import random

import pytest

from kinspan.plans import derived as D
from kinspan.plans import queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(3)
    rows = [(rng.choice(D.CHROMS), rng.randrange(1, 999), k % 7, rng.randrange(1, 999), k, f"199{rng.randrange(5, 9)}-0{rng.randrange(1, 9)}-1{rng.randrange(9)}", float(rng.randrange(1, 51))) for k in range(60)]
    at = str(tmp_path_factory.mktemp("tables"))
    names = "l_returnflag string, l_suppkey long, l_linenumber int, l_partkey long, l_orderkey long, l_shipdate string, l_quantity double"
    spark.createDataFrame(rows + rows[:5], names).write.parquet(f"{at}/lineitem.parquet")
    return at


def test_discordance_takes_all_gaps(spark, folder):
    def alleles(p, s):
        return int((p * 7 + s * 13) % 3 != 0), int((p * 5 + s * 11) % 4 != 0)

    expected = set()
    for r in D.segments(spark, folder).collect():
        pairs = [(alleles(p, r.sid1), alleles(p, r.sid2)) for p in range(r.pid1 + 1, r.pid2) if 0 <= p < D.SITES]
        bad = sum(x[0] == x[1] and y[0] == y[1] and x[0] != y[0] for x, y in pairs)
        expected.add((r.chrom, r.sid1, r.sid2, r.pid1, r.pid2, bad))
    found = [tuple(r) for r in queries.discordance(spark, folder).collect()]
    assert sorted(found) == sorted(expected) and any(r[3] % 5 for r in found)


def test_boundary_pids_asks_for_every_site(spark, folder):
    days = [d for d in range(D.SITES) if d % 400 < 200 or d % 13 == 0]
    bp = [d * 1000 + 1 for d in days]
    expected = []
    for d in range(D.SITES):
        left, right = d * 1000 + 1 - 500, d * 1000 + 1 + 1000 * d
        expected += [(c, left, right, max(bisect.bisect_right(bp, left) - 1, 0), bisect.bisect_right(bp, right)) for c in D.CHROMS]
    assert sorted(map(tuple, queries.boundary_pids(spark, folder).collect())) == sorted(expected)


def test_map_to_bp_asks_for_every_site_also_beyond_the_map(spark, folder):
    k = [10 if 10 <= i <= 12 else i for i in range(1, 61)]
    points = [(0, 0.0)] + [(i * 40000 + 1, (20 * n + n * n % 17) / 10.0) for i, n in zip(range(1, 61), k)]
    slopes = [(b[1] - a[1]) / (b[0] - a[0]) for a, b in zip(points, points[1:])]
    slopes.append(slopes[-1])
    found = {(r.chrom, r.pid): r.bp for r in queries.map_to_bp(spark, folder).collect()}
    assert len(found) == D.SITES * len(D.CHROMS)
    for (_, pid), place in found.items():
        cm = pid * 0.4
        at = max(i for i, p in enumerate(points) if p[1] <= cm)
        exact = points[at][0] + ((cm - points[at][1]) / slopes[at] if slopes[at] else 0)
        assert abs(place - exact) <= 0.5 + 1e-6


@pytest.mark.parametrize("query", ["discordance", "map_to_bp", "boundary_pids"])
def test_sql_takes_all_rows_as_well(spark, folder, query):
    duckdb = pytest.importorskip("duckdb").connect()
    duckdb.execute(f"create view lineitem as select * from read_parquet('{folder}/lineitem.parquet/*.parquet')")
    rows = duckdb.execute(queries.ORACLE_SQL[query]).fetchall()
    assert sorted(rows) == sorted(map(tuple, queries.QUERIES[query](spark, folder).collect()))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_merging_by_length_takes_one_exchange_and_no_join(spark, folder):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = _plan(queries.merge_by_length(spark, folder))
        assert plan.count("Exchange ") == 1 and "Join" not in plan
        plan = _plan(queries.split_by_regions(spark, folder))
        assert plan.count("Join") == 1 and plan.count("FileScan") == 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_each_query_has_sql():
    from kinspan.plans import exchange

    assert set(queries.QUERIES) == set(queries.ORACLE_SQL) and set(exchange.QUERIES) == set(exchange.ORACLE_SQL)


def test_matrix_binary_of_totals_beyond_16_bits(spark, tmp_path):
    from kinspan.plans import exchange

    duckdb = pytest.importorskip("duckdb").connect()
    lines = spark.range(6000).selectExpr("if(id % 3 = 0, 'A', if(id % 3 = 1, 'N', 'R')) as l_returnflag", "id % 100 div 99 as l_suppkey", "cast(id % 7 as int) as l_linenumber", "2 as l_partkey", "id as l_orderkey", "'1996-05-11' as l_shipdate", "50.0D as l_quantity")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    duckdb.execute(f"create view lineitem as select * from read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    want = sorted(duckdb.execute(exchange.ORACLE_SQL["matrix_binary"]).fetchall())
    assert want == [(2, 0, 5940 * 35), (2, 1, 60 * 35)]
    assert sorted(map(tuple, exchange.matrix_binary(spark, str(tmp_path)).collect())) == want


def test_sources_and_sinks_against_sql(spark, tmp_path):
    """On rows of their own: lineitem, orders and supplier with all columns that the queries read."""
    from kinspan.plans import exchange

    duckdb = pytest.importorskip("duckdb").connect()
    rng = random.Random(5)
    lines = [(rng.choice(D.CHROMS), rng.randrange(1, 999), k % 7, rng.randrange(1, 999), k, f"199{rng.randrange(5, 9)}-0{rng.randrange(1, 9)}-1{rng.randrange(9)}", float(rng.randrange(1, 51))) for k in range(200)]
    names = "l_returnflag string, l_suppkey long, l_linenumber int, l_partkey long, l_orderkey long, l_shipdate string, l_quantity double"
    tables = {
        "lineitem": spark.createDataFrame(lines, names),
        "orders": spark.createDataFrame([(k, k % 17 + 1) for k in range(1, 60)], "o_orderkey long, o_custkey long"),
        "supplier": spark.createDataFrame([(k, k % 25) for k in range(1, 90)], "s_suppkey long, s_nationkey long"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
        duckdb.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    for name, query in exchange.QUERIES.items():
        found = query(spark, str(tmp_path))
        columns = sorted(found.columns)
        cursor = duckdb.execute(f"select {', '.join(f'"{c}"' for c in columns)} from ({exchange.ORACLE_SQL[name]})")
        assert sorted(map(repr, cursor.fetchall())) == sorted(repr(tuple(r)) for r in found.select(*columns).collect()), name
