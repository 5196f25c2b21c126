"""Every query against its SQL twin on the smallest tables."""

import math
from collections import Counter
from datetime import datetime
from pathlib import Path

import duckdb
import pytest

from lotwright.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value.replace(tzinfo=None) if isinstance(value, datetime) else value


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    frame = catalog.QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    if name in catalog.ORACLES:
        want = duck.sql(catalog.ORACLES[name])
        at = [want.columns.index(c) for c in columns]
        assert sorted(want.columns) == columns
        assert got == Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_cards_keep_what_a_title_says(spark, tmp_path):
    """Titles cut within an entity, and with entities that stand for no sign of the title."""
    titles = ["Ly and&amp", "token = &quot;0b96", "a &amp; b &amp;lt; c", "a < b", "&amp;amp"]
    pages = spark.createDataFrame([(i, "", f"<title>{t}</title>") for i, t in enumerate(titles)], "page_id long, url string, html string")
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    frame = catalog.QUERIES["op.catalogue_cards"](spark, str(tmp_path))
    want = duckdb.connect().execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'").sql(catalog.ORACLES["op.catalogue_cards"])
    at = [want.columns.index(c) for c in frame.columns]
    assert Counter(map(tuple, frame.collect())) == Counter(tuple(r[i] for i in at) for r in want.fetchall())
