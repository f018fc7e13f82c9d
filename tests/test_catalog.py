"""Every registered key-value query against DuckDB on the smallest driver tables (skipped where they are absent)."""

import os

import duckdb
import pytest

from keyloom import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are absent")


def rows(names, got):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(cell(r[i]) for i in order) for r in got), key=str)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    df = catalog.queries()[name](spark, DATA)
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in ("events", "orders", "customer"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    cur = db.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(names, cur.fetchall()) == rows(df.columns, df.collect())


def test_file_numbers_of_both_levels(spark, tmp_path):
    """A log of more than a million changes: numbers of its level-0 files meet those of the level-1 files, from 1,001."""
    db = duckdb.connect()
    db.execute(f"CREATE VIEW e AS SELECT * FROM read_parquet('{DATA}/events.parquet')")
    db.execute(f"COPY (SELECT * FROM e UNION ALL SELECT e.* REPLACE (e.event_id + 1000000 + 1000 * k AS event_id) FROM e, unnest(range(7)) AS t(k)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    db.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
    want = db.execute(catalog.oracle_sql()["manifest_file_check"]).fetchall()
    assert len({r[0] for r in want}) < len(want)
    assert rows(["file_number"], want) == rows(["file_number"], catalog.queries()["manifest_file_check"](spark, str(tmp_path)).collect())
