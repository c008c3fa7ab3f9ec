"""Queries against their SQL over texts on which Java and RE2 disagree about word edges: 'stß' begins with an ordinal's ending."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry

QUERIES = [
    "block_idf",
    "context_ranks",
    "key_weights",
    "keys_nw",
    "native_addresses",
    "one_owner",
    "overlap_features",
    "prune",
    "scaled_scores",
    "source_context",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sql"))
    trees, ways = "oak elm ash fir yew bay fig box".split(), "garten allee kanal hafen turm markt".split()
    text = lambda i, way: f"{' '.join(trees[(i // 6 + j) % 8] for j in range(4))}\n{100 + i // 6} {way} {ways[i // 6 % 6]} {ways[(i // 6 + 1) % 6]}"
    rows = [(i, text(i, "12 stßenweg" if i % 2 else "12ßenweg"), "en", "x", 0) for i in range(48)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", QUERIES)
def test_rows_are_those_of_the_sql(spark, folder, name):
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    want = db.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r)) for r in entry.queries()[name](spark, folder).select(*columns).collect())
    assert db.execute(f"SELECT count(*) FROM ({entry.oracle_sql()[name]})").fetchone()[0] > 0


def test_rounding_is_that_of_the_sql(spark):
    """Halves in the seventh place, such as that of 41 / 640, which decimals round up."""
    import duckdb

    from kinfold.plans.queries import six

    ratios = "SELECT a, b, a / b AS x FROM range(-640, 641) t(a), (VALUES (7), (128), (640), (1280)) s(b)"
    want = {r[:2]: r[2] for r in duckdb.sql(f"SELECT a, b, round(x, 6) FROM ({ratios})").fetchall()}
    rows = spark.range(-640, 641).selectExpr("id AS a", "explode(array(7, 128, 640, 1280)) AS b").selectExpr("a", "b", "a / b AS x")
    got = {(r.a, r.b): r.y for r in rows.select("a", "b", six(rows.x).alias("y")).collect()}
    assert got == want and got[41, 640] == 0.064062
