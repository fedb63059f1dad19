"""Every registered query against its SQL."""

import math

import duckdb
import pytest

from weftline.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines".split()


def tidy(rows):
    def one(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 9)
        return v

    return sorted((tuple(one(v) for v in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = tidy(df.select(*columns).collect())
    if name in catalog.ORACLES:
        want = duck.sql(catalog.ORACLES[name])
        assert sorted(want.columns) == columns
        order = ", ".join(f'"{c}"' for c in columns)
        assert got == tidy(duck.sql(f"SELECT {order} FROM ({catalog.ORACLES[name]})").fetchall())
    else:
        assert got or name == "page_links"


def test_ingestion_hashes_a_text_once_a_scan(spark):
    """No filter makes a join's key a second time, and no field of a card that is not asked for is made."""
    plan = catalog.ingest_written(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "isnotnull(sha2(" not in plan and "isnotnull(coalesce(sha2(" not in plan
    assert "struct(display_headline" not in plan and "key_points" not in plan.replace("key_points, array()", "")
