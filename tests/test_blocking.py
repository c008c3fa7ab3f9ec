from __future__ import annotations

import random

import pytest

from kinfold.operators import blocking, normalize
from kinfold.plans import session

RECORD = "src byte, entity_id string, name string, addr string, country string"


@pytest.fixture
def records(spark):
    rnd = random.Random(3)
    word = lambda: rnd.choice("oak elm ash fir yew bay fig box".split())
    rows = [(1 + i % 3, f"S{1 + i % 3}-{i}", f"{word()} {word()} {word()}", f"{rnd.randrange(30)} {word()} road, 1234{rnd.randrange(9)}", rnd.choice(["US", "India", ""])) for i in range(400)]
    return spark.createDataFrame(rows, RECORD)


@pytest.mark.parametrize("heavy", [1, 7])
def test_keys_of_many_first_records_are_dealt_out(records, monkeypatch, heavy):
    rich, plain = normalize.normalized(records, native=False).persist(), normalize.plain(records).persist()
    of = lambda f, r: sorted(map(str, f(r).collect()))
    want = [of(blocking.block, rich), of(blocking.block_plain, plain), of(blocking.union_candidates, plain)]
    monkeypatch.setattr(blocking, "HEAVY", heavy)
    assert want == [of(blocking.block, rich), of(blocking.block_plain, plain), of(blocking.union_candidates, plain)] and all(want)


def test_blocking_equals_brute_force(records):
    """Summed weights of shared keys, over all pairs of a country."""
    import math
    from collections import Counter, defaultdict

    rich = normalize.normalized(records, native=False)
    keys, country, src = defaultdict(set), {}, {}
    for r in blocking.keys(rich).collect():
        keys[r["entity_id"]].add((r["country"], r["kt"], r["key"]))
    for r in rich.collect():
        country[r["entity_id"]], src[r["entity_id"]] = r["country"], r["src"]
    n = Counter(c for i, c in country.items() if src[i] != 1)
    df = Counter(k for i, own in keys.items() if src[i] != 1 for k in own)
    caps = blocking.caps()
    weight = {k: math.log(n[k[0]]) - math.log(d) for k, d in df.items() if d <= caps[k[1]]}
    want = {}
    for a in (i for i in src if src[i] == 1):
        for b in (i for i in src if src[i] != 1):
            if shared := [weight[k] for k in keys[a] & keys[b] if k in weight]:
                want[a, b] = sum(shared)
    got = {(r["s1_id"], r["cand_id"]): r["bscore"] for r in blocking.block(rich, 1 << 30).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-6) for k in got)


def test_rows_of_few_small_files_are_dealt_out(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    spark.range(1000).coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    assert session.spread(df).rdd.getNumPartitions() == df.rdd.getNumPartitions()
    monkeypatch.setattr(session, "WORTH", 0)
    assert session.spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and session.spread(df).count() == 1000
    monkeypatch.setattr(session, "GROUP", 1)
    assert session.spread(df).rdd.getNumPartitions() == df.rdd.getNumPartitions()


def test_pairs_are_not_shuffled(spark):
    """Candidates go as lists to the records of source 1; sums, distinct pairs and ranks need no other exchange."""
    rows = [(1, "a", "x", "name", "k"), (1, "b", "x", "name", "k"), (2, "c", "x", "name", "k"), (2, "d", "x", "gram", "m"), (1, "a", "x", "gram", "m"), (3, "c3", "x", "name", "k")]
    k = spark.createDataFrame(rows, "src byte, entity_id string, country string, kt string, key string")
    usable = spark.createDataFrame([(2, "x", "name", "k", 0.5, 2), (3, "x", "name", "k", 0.25, 2), (2, "x", "gram", "m", 1.0, 1)], "src byte, country string, kt string, key string, w double, first long")
    pairs = blocking.shared(k, usable)
    out = blocking.top(blocking.scored(pairs, ("name", "gram")), "bscore", 25, ("s1_id", "src"))
    assert "hashpartitioning(s1_id#" in (plan := out._jdf.queryExecution().executedPlan().toString())
    assert not [x for x in plan.splitlines() if "Exchange" in x and "cand_id" in x.partition("hashpartitioning")[2]]
    got = {(r.s1_id, r.cand_id, r.bscore) for r in out.collect()}
    assert got == {("a", "c", 0.5), ("b", "c", 0.5), ("a", "d", 1.0), ("a", "c3", 0.25), ("b", "c3", 0.25)}


@pytest.mark.parametrize(("candidates", "firsts", "sums"), [(1 << 17, 1 << 16, 1 << 20), (30, 20, 100)])
def test_many_pairs_meet_in_cells(records, monkeypatch, candidates, firsts, sums):
    """The same rows, ties included, without an exchange of pairs: lists of them filled the disk at 1 GB."""
    rich, plain = normalize.normalized(records, native=False).persist(), normalize.plain(records).persist()
    ways = [lambda: blocking.block(rich, 7), lambda: blocking.block_plain(plain, 3), lambda: blocking.union_candidates(plain)]
    want = [sorted(map(str, f().collect())) for f in ways]
    for name, value in {"PAIRS": -1, "CANDIDATES": candidates, "FIRSTS": firsts, "SUMS": sums}.items():
        monkeypatch.setattr(blocking, name, value)
    monkeypatch.delattr(blocking, "shared")
    assert [sorted(map(str, f().collect())) for f in ways] == want and all(want)
