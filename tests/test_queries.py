"""Every query with SQL beside it gives the same rows in DuckDB."""

import datetime
import math

import duckdb
import pytest

from rolecast.plans import provider_queries, queries, state_queries, text_queries  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "~"
    if isinstance(value, bool | datetime.datetime):
        return str(value)
    return f"{value:.6f}" if isinstance(value, int | float) else str(value)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_same_rows(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    if name not in queries.ORACLE_SQL:
        return
    want = duck.sql(queries.ORACLE_SQL[name])
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_initials_of_odd_texts(spark, tmp_path):
    """Every letter, every space, and texts without words give the initials of the SQL."""
    letters = [chr(i) for i in range(1, 0x20000) if not 0xD800 <= i < 0xE000]
    texts = [f"{c}x y" for c in letters] + [f"a{c}b c" for c in map(chr, [*range(1, 0x300), *range(0x1680, 0x1681), *range(0x2000, 0x2070), 0x3000, 0xFEFF])]
    texts += [None, "", " \t\n", "ß ß", "\u0149 ǰ", "e\u0301x ﬁx", "\r\none"]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    want = duckdb.sql(f"WITH documents AS (FROM '{path}/*.parquet') {queries.ORACLE_SQL['initials']}").fetchall()
    got = {r.doc_id: r.initials for r in queries.QUERIES["initials"](spark, str(tmp_path)).collect()}
    assert [(texts[k], w, got[k]) for k, w in want if w != got[k]] == [] and len(want) == len(got)
