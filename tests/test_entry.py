from __future__ import annotations

import __spark_entry__ as entry
from kinfold.plans import queries, sql


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(sql.SQL) == {k if k != "context_ranks" else "context" for k in queries.ORACLE_SQL}


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
