from __future__ import annotations

import pytest

from kinfold.operators import blocking, features, normalize
from kinfold.plans import session


@pytest.mark.parametrize(("held", "copies"), [(1, 24), (7 * features.HELD, 24), (7 * features.HELD, 6)])
def test_records_are_sent_to_the_pairs(spark, monkeypatch, held, copies):
    """Each pair gets the columns of both records; ids of pairs are shuffled once, and never with what they got."""
    monkeypatch.setattr(features, "COPIES", copies)
    pairs = spark.range(2000).selectExpr("'a' || id % 40 AS s1_id", "'b' || id % 70 AS cand_id")
    a, b = spark.range(40).selectExpr("'a' || id AS s1_id", "repeat(id, 9) AS x"), spark.range(70).selectExpr("'b' || id AS cand_id", "repeat(id, 7) AS y")
    want = sorted((f"a{i % 40}", f"b{i % 70}", str(i % 40) * 9, str(i % 70) * 7) for i in range(2000))
    out = features.met(pairs, a, b, held).select("s1_id", "cand_id", "x", "y")
    assert sorted(map(tuple, session.stored(out, features.BY_FIRST).collect())) == want
    assert spark.conf.get(*features.BY_FIRST) == "true"
    if copies == 24:
        spark.conf.set(*features.BY_FIRST, "false")
        try:
            plan = features.met(pairs, a, b, held)._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set(*features.BY_FIRST, "true")
        exchanges = [x for x in plan.splitlines() if "Exchange" in x]
        assert len(exchanges) == 3 and all("hashpartitioning(kinfold_cell#" in x and "_id#" not in x for x in exchanges)


def test_plain_features_of_odd_records(spark):
    """Empty names and addresses, repeated words and short names; numbers worked out by hand."""
    rows = [(1, "a", "Oak Oak Elm", "12 ash road ash, 12345", "US"), (2, "b", "oak elm oak", "12 ash rd, 12345", "US"), (3, "c", "", None, "US"), (1, "d", None, "", "US")]
    r = normalize.plain(spark.createDataFrame(rows, "src byte, entity_id string, name string, addr string, country string"))
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("d", "c")], "s1_id string, cand_id string")
    got = {(x.s1_id, x.cand_id): x for x in features.plain_features(pairs, r, fuzzy=False, kind="double").collect()}
    ab, ac, dc = got["a", "b"], got["a", "c"], got["d", "c"]
    assert (ab.name_token_jaccard, ab.addr_token_jaccard, ab.name_exact, ab.addr_exact, ab.postcode_match, ab.house_num_overlap, ab.is_source2) == (1, 1, 0, 0, 1, 1, 1)
    assert ab.name_char_ngram_jaccard == pytest.approx(3 / 9)
    assert (ac.name_token_jaccard, ac.addr_token_jaccard, ac.name_len_ratio, ac.addr_cand_missing, ac.addr_s1_missing) == (0, 0, 0, 1, 0)
    assert (dc.name_exact, dc.name_len_ratio, dc.name_char_ngram_jaccard, dc.addr_either_missing, dc.addr_exact, dc.name_first_token_match, dc.house_num_any) == (0, 1, 0, 1, 0, 0, 0)


@pytest.mark.parametrize("query", ["plain_features", "string_features", "rerank_features"])
def test_many_records_are_met_by_slices(spark, monkeypatch, query):
    """The same rows, with the shuffle files of one slice at a time: those of all records at once filled the disk at 1 GB."""
    rows = [(1 + i % 3, f"S{i}", f"Oak {'elm fir'[i % 5:]} {i % 7} Ltd", f"{i % 9} ash {'road' * (i % 4)} {10000 + i % 8}, Texas", "US") for i in range(60)]
    e = spark.createDataFrame(rows, "src byte, entity_id string, name string, addr string, country string")
    r = session.stored(normalize.plain(e) if query == "plain_features" else normalize.normalized(e, native=False))
    pairs = spark.createDataFrame([(f"S{i}", f"S{k}", 1.0 + i * k % 11) for i in range(0, 60, 3) for k in range(60) if k % 3 and (i + k) % 4 == 0], "s1_id string, cand_id string, bscore double")
    make = getattr(blocking if query == "rerank_features" else features, query)
    want, writes, of = sorted(map(str, make(pairs, r).collect())), [], session.written
    monkeypatch.setattr(features, "SLICE", 700)
    monkeypatch.setattr(session, "written", lambda df, *more: writes.append(df.columns) or of(df, *more))
    assert sorted(map(str, make(pairs, r).collect())) == want and len(want) == 200
    assert sum(len(x) > 7 for x in writes) > 2
