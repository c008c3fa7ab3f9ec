from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.operators import blocking, context, decode, features, learn
from kinfold.sources import records as S


@pytest.mark.parametrize(
    ("p", "want"),
    [([0.9], [0.1, 0.9]), ([0.5], [0.5, 0.5]), ([0.4], [0.6, 0.4]), ([0.3, 0.2], [0.56, 0.29, 0.271111]), ([0.95, 0.5], [0.025, 0.870833, 0.752778]), ([0.9, 0.8, 0.1], [0.018, 0.768429, 0.856455, 0.644198])],
)
def test_expected_f_goldens(p, want):
    assert decode.expected_f(np.array(p)) == pytest.approx(want, abs=1e-6)


def test_expected_f_equals_enumeration():
    p = [0.9, 0.7, 0.35, 0.2]
    for k in range(5):
        total = 0.0
        for x in itertools.product((0, 1), repeat=4):
            w = float(np.prod([q if v else 1 - q for q, v in zip(p, x, strict=True)]))
            total += w * (float(not any(x)) if k == 0 else 1.25 * sum(x[:k]) / (0.25 * sum(x) + k))
        assert decode.expected_f(np.array(p))[k] == pytest.approx(total)


def test_f_of_counts(spark):
    rows = [((0, 0, 0), 1), ((0, 1, 0), 0), ((0, 0, 2), 0), ((0, 1, 1), 0), ((1, 1, 1), 1), ((1, 2, 1), 0.555556), ((1, 1, 2), 0.833333), ((2, 3, 4), 0.625)]
    df = spark.createDataFrame([x for x, _ in rows], "tp int, named int, true int")
    got = [r[0] for r in df.select(decode.f_of_counts(F.col("tp"), F.col("named"), F.col("true"))).collect()]
    assert got == pytest.approx([y for _, y in rows], abs=1e-6)


@pytest.fixture
def scored(spark):
    return spark.createDataFrame([("s", "a", 2, 0.9), ("s", "b", 3, 0.9), ("s", "c", 2, 0.4), ("t", "a", 2, 0.8), ("u", "d", 2, 0.3)], "s1_id string, cand_id string, src int, p double")


def test_context(scored):
    got = {(r["s1_id"], r["cand_id"]): r for r in context.context(scored, "p", "p").collect()}
    assert [got["s", c]["p_rank_s1"] for c in "abc"] == [1, 2, 3]
    assert [round(got["s", c]["p_gap_s1"], 6) for c in "abc"] == [0, 0, 0.5] and [round(got["s", c]["p_margin_s1"], 6) for c in "abc"] == [0.5, 0.5, 0]
    assert got["u", "d"]["p_margin_s1"] == 0 and got["t", "a"]["p_rank_c"] == 2 and got["s", "a"]["p_mutual_best"] == 1 and got["s", "a"]["p_n_hi_s1"] == 2


def test_context_does_not_depend_on_row_order(scored):
    rows = lambda df: sorted(map(tuple, context.context(df, "p", "p").collect()))
    assert rows(scored) == rows(scored.orderBy(F.desc("cand_id")).repartition(3))


def test_one_owner_and_prune(spark):
    df = spark.createDataFrame([("s", "a", 0.8), ("t", "a", 0.8), ("u", "a", 0.3)], "s1_id string, cand_id string, p double")
    values = lambda strict: [r["o"] for r in context.one_owner(df, "p", "o", strict).orderBy("s1_id").collect()]
    assert values(False) == [0.8, 0.8, 0] and values(True) == [0.8, 0, 0]
    assert context.prune(df, "p", 0.5, 1).count() == 2


def test_decoding_and_metrics(spark, scored):
    truth = spark.createDataFrame([("s", "a"), ("t", "x")], "s1_id string, cand_id string")
    ents = spark.createDataFrame([("s",), ("t",), ("u",), ("v",)], "s1_id string")
    links = decode.by_threshold(scored, "p", 0.85)
    m = decode.metrics(links, truth, ents).first()
    assert m["n_entities"] == 4 and m["f05"] == pytest.approx((1.25 / 2.25 + 0 + 1 + 1) / 4)
    assert m["micro_precision"] == 0.5 and m["micro_recall"] == 0.5
    tau, best = decode.best_threshold(scored, "p", truth, ents)
    each = {r["tau"]: r["f05"] for r in decode.threshold_scores(scored, "p", truth, ents).collect()}
    assert len(each) == 19 and best == max(each.values()) and tau == min(t for t, f in each.items() if f == best)
    for t in (0.3, 0.85):
        assert each[t] == pytest.approx(decode.metrics(decode.by_threshold(scored, "p", t), truth, ents).first()["f05"])
    assert decode.oracle(scored, truth, ents).first()["f05"] >= best
    d = decode.diagnostics(scored, truth, ents).first()
    assert (d["recall_ceiling"], d["total_true_edges"], d["recovered_edges"]) == (0.5, 2, 1)
    assert {r["cand_id"] for r in decode.by_expected_f(scored, "p").where("s1_id = 's'").collect()} == {"a", "b"}


def test_number_relations(spark):
    rows = [(["8451"], ["8453"], 1, 0), (["6310"], ["310"], 0, 1), (["6310"], ["6312"], 1, 0), (["102"], ["102"], 0, 0), (["5"], ["7"], 0, 0), ([], ["1"], 0, 0), (["1234567890"], ["1234567891"], 0, 0)]
    df = spark.createDataFrame([x[:2] for x in rows], "addr_num_a array<string>, addr_num_b array<string>")
    assert [(r["n_near"], r["n_trunc"]) for r in features.number_features(df).collect()] == [x[2:] for x in rows]


def test_word_weights_and_features(spark):
    rows = [(f"s{i}", f"c{i}", "acme", "acme group" if i % 2 else "acme stores", i % 2) for i in range(20)]
    p = spark.createDataFrame(rows, "s1_id string, cand_id string, name_a string, name_b string, y int")
    w = {(r["side"], r["tok"]): r["llr"] for r in learn.word_weights(p).collect()}
    assert w["extra", "group"] > 0 > w["extra", "stores"]
    f = features.word_features(p, learn.word_weights(p)).where("s1_id = 's1'").first()
    assert f["llr_extra_max"] == pytest.approx(w["extra", "group"]) and f["n_extra"] == 1 and f["n_miss"] == 0 and f["llr_miss_sum"] == 0


def test_token_dictionary(spark):
    rows = [(["a", "b"], ["é", "ü"])] * 2 + [(["x", "b"], ["é", "ü"]), (["a"], ["é", "ü"])]
    df = spark.createDataFrame(rows, "lat array<string>, nat array<string>")
    assert {tuple(r) for r in learn.token_dictionary(df, native="[à-ÿ]").collect()} == {("é", "a"), ("ü", "b")}


def test_lists_have_every_record_once(spark):
    links = spark.createDataFrame([("s", "b", 1), ("s", "a", 2), ("s", "b", 3), ("s", " ", 1)], "s1_id string, cand_id string, r int")
    need = spark.createDataFrame([("s",), ("t",)], "s1_id string")
    assert {tuple(r) for r in S.id_lists(links, need, S.MATCHES, "r").collect()} == {("s", "b,a"), ("t", "")}


def test_files_round_trip(spark, tmp_path):
    p = tmp_path / "r.tsv"
    p.write_text('entity_id\textra\tbusiness_name\tbusiness_address\tcountry\nS2-1\tq\tA "quoted\tx, y\tUS\nS2-2\t\tB\t\t\n', encoding="utf-8")
    got = [tuple(r) for r in S.read_records(spark, str(p), 2).orderBy("entity_id").collect()]
    assert got == [(2, "S2-1", 'A "quoted', "x, y", "US"), (2, "S2-2", "B", "", "")]
    (tmp_path / "bad.tsv").write_text("entity_id\tcountry\nx\ty\n", encoding="utf-8")
    with pytest.raises(ValueError, match="business_name"):
        S.read_records(spark, str(tmp_path / "bad.tsv"), 2)
    (tmp_path / "t.tsv").write_text("source1_entity_id\tmatched_entity_ids\ns\ta, b,,\nt\t\n", encoding="utf-8")
    assert sorted(map(tuple, S.truth_links(S.read_truth(spark, str(tmp_path / "t.tsv"))).collect())) == [("s", "a"), ("s", "b")]
    S.write_matches(S.truth_links(S.read_truth(spark, str(tmp_path / "t.tsv"))), spark.createDataFrame([("s",), ("t",)], "s1_id string"), str(tmp_path / "out"))
    assert sorted(x for f in (tmp_path / "out").glob("part-*") for x in f.read_text().splitlines()) == ["s\ta,b", "t\t"]


def test_blocking_keeps_caps_and_countries(spark):
    schema = "src byte, entity_id string, country string, concat string, state string, core_tok array<string>, addr_tok array<string>, addr_num array<string>"
    rows = [(1, "s", "US", "acmewidgets", "", ["acme", "widgets"], ["oak"], ["12"]), (2, "c", "US", "acmewidgets", "", ["acme", "widgets"], ["oak"], ["12"]), (3, "d", "FR", "acmewidgets", "", ["acme", "widgets"], [], [])]
    rows += [(2, f"x{i}", "US", "common", "", ["common"], [], []) for i in range(400)] + [(1, "t", "US", "common", "", ["common"], [], [])]
    df = spark.createDataFrame(rows, schema)
    k = blocking.keys(df)
    assert {r["key"] for r in k.where("entity_id = 's' and kt = 'np'").collect()} == {"acme|widgets"}
    usable = blocking.usable_keys(k.where("src <> 1"), df)
    assert usable.where("key = 'common' and kt = 'nt'").count() == 0 and usable.where("df > 1000").count() == 0
    got = blocking.block(df).collect()
    assert {(r["s1_id"], r["cand_id"]) for r in got if r["s1_id"] == "s"} == {("s", "c")}
    assert {r["cand_id"] for r in got if r["s1_id"] == "t"} <= {f"x{i}" for i in range(400)} and len([r for r in got if r["s1_id"] == "t"]) <= 120
