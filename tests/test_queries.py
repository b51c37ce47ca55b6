"""Every query that SQL can express equals DuckDB on the smallest tables; the rest run."""

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import catalog, oracle

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    got = [r.asDict() for r in df.collect()]
    if name not in oracle.SQL:
        assert got
        return
    cursor = duck.execute(oracle.SQL[name])
    columns = [c[0] for c in cursor.description]
    want = [dict(zip(columns, r, strict=True)) for r in cursor.fetchall()]
    key = lambda r: tuple(repr(r[c]) for c in sorted(df.columns))
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_scalar_numbers_late_ids(spark, tmp_path):
    """Ids of larger tables: the summers of 1986 to 1991, their edges and years beyond 9999."""
    edges = [(e + d) // 1000 for e in (515520000, 527007600, 671554800, 684867600) for d in range(-12000, 12001, 1000)]
    ids = sorted({*edges, *range(515000, 690000, 997), 5999999, 253402271, 253402272, 253402273, 1000000001, 8000099999})
    duckdb.sql(f"""COPY (SELECT unnest({ids}) AS event_id, TIMESTAMP '2024-01-01' AS ts, 7::BIGINT AS user_id, 'click' AS event_type,
        21.5::DOUBLE AS value, '{{"k": 1}}' AS props) TO '{tmp_path}/events.parquet'""")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    cursor = db.execute(oracle.SQL["scalar_numbers"])
    columns = [c[0] for c in cursor.description]
    got = catalog.QUERIES["scalar_numbers"](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(cursor.fetchall(), key=lambda r: r[0])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
