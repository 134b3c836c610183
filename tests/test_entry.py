"""Every query of the library itself against its SQL, on a small scale factor."""

import duckdb
import pytest

from planeprint import plans

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark".split()


def values(rows, columns):
    return sorted(str([round(r[c], 5) + 0.0 if isinstance(r[c], float) else r[c] for c in sorted(columns)]) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.execute(plans.ORACLE_SQL[name]).df().to_dict("records")
    df = plans.QUERIES[name](spark, SF)
    assert values([r.asDict() for r in df.collect()], df.columns) == values(want, df.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
