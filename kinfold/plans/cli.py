"""Command line: train on records with truth, validate, or predict for new ones.

The data folder has train_source{1,2,3}.tsv and train_ground_truth.tsv, or test_source{1,2,3}.tsv. Models and the steps of a run go
to the work folder, matching_results, candidate_pairs and reports to the output folder. A step that a run of the same
settings and inputs has already is not made again, unless it is forced.
"""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict, fields
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import context, decode
from ..operators.normalize import kept
from ..sources import records as S
from .resolve import Config, Model, PlainModel, links_of, score, score_plain, train, train_plain
from .session import session, ship
from .steps import Done, Run, identity_of


def sources(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    return reduce(DataFrame.unionByName, (S.read_records(spark, f"{folder}/{kind}_source{i}.tsv", i) for i in (1, 2, 3)))


def sampled(e: DataFrame, share: int) -> DataFrame:
    """Candidates and about share of 1,000 records of source 1."""
    return e.where("src <> 1").unionByName(kept(e.where("src = 1"), F.col("entity_id"), share)) if share < 1000 else e


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("mode", choices=("train", "validate", "predict"))
    p.add_argument("--data", required=True)
    p.add_argument("--work", required=True)
    p.add_argument("--out")
    p.add_argument("--method", choices=("rich", "plain"), default="rich")
    p.add_argument("--share", type=int, default=1000, help="of 1,000 records of source 1 that training keeps")
    p.add_argument("--force", nargs="*", default=[], help="steps to make anew (with all later ones); beginnings of names will do")
    p.add_argument("--until", default="", help="the last step to make")
    for f in fields(Config):
        p.add_argument(f"--{f.name.replace('_', '-')}", default=None, **({"action": "store_true"} if type(f.default) is bool else {"type": type(f.default)}), help=f"or KINFOLD_{f.name.upper()}; {f.default}")
    return p


def main(args: list[str] | None = None) -> dict:
    """Runs what the arguments say; the report, or what steps were made."""
    a = parser().parse_args(args)
    spark = session("kinfold")
    ship(spark)
    config = Config.of(vars(a))
    kind = "test" if a.mode == "predict" else "train"
    inputs = identity_of(spark, *(f"{a.data}/{kind}_source{i}.tsv" for i in (1, 2, 3)), *([f"{a.data}/train_ground_truth.tsv"] if kind == "train" else [f"{a.work}/{a.method}-model"]))
    run = Run(spark, a.work, [a.method, kind, a.share, asdict(config), inputs], tuple(a.force), a.until)
    e = sources(spark, a.data, kind)
    try:
        report = learned(spark, a, config, e, run) if kind == "train" else predicted(spark, a, e, run)
    except Done as last:
        report = {"last": str(last)}
    report |= {"made": run.made, "path": run.path}
    print(json.dumps(report, default=str))
    return report


def learned(spark: SparkSession, a: argparse.Namespace, config: Config, e: DataFrame, run: Run) -> dict:
    """train: a model in the work folder. validate: also the lists of the records that it was learned from, out of fold."""
    e = sampled(e, a.share)
    need = e.where("src = 1").select(F.col("entity_id").alias("s1_id"))
    links = S.truth_links(S.read_truth(spark, f"{a.data}/train_ground_truth.tsv")).join(need, "s1_id", "left_semi")
    m = train(e, links, config, steps=run) if a.method == "rich" else train_plain(e, links, config, steps=run)
    m.save(f"{a.work}/rich-model") if a.method == "rich" else m.save(spark, f"{a.work}/plain-model")
    if a.mode == "validate":
        out = a.out or a.work
        if a.method == "rich":
            pairs = spark.read.parquet(f"{run.path}/match-scores").withColumn("place", -F.col("p2"))
            named = links_of(pairs, m).join(pairs.select("s1_id", "cand_id", "place"), ["s1_id", "cand_id"])
        else:
            pairs = spark.read.parquet(f"{run.path}/owned").withColumn("place", -F.col("prob_owned"))
            named = pairs.where(F.col("prob_owned") >= m.tau)
        S.write_matches(named, need, f"{out}/matching_results", "place")
        S.write_candidates(pairs, need, f"{out}/candidate_pairs", "place")
        spark.createDataFrame([(json.dumps(m.report),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/report")
    return dict(m.report)


def predicted(spark: SparkSession, a: argparse.Namespace, e: DataFrame, run: Run) -> dict:
    need = e.where("src = 1").select(F.col("entity_id").alias("s1_id"))
    out = a.out or a.work
    if a.method == "plain":
        m = PlainModel.load(spark, f"{a.work}/plain-model")
        pairs = score_plain(e, m, run).withColumn("place", -F.col("prob_owned"))
        named = decode.by_threshold(pairs, "prob_owned", m.tau).join(pairs, ["s1_id", "cand_id"])
    else:
        m = Model.load(spark, f"{a.work}/rich-model")
        pairs = score(e, m, run)
        if a.own or m.config.own:
            pairs = context.one_owner(pairs, "p2", "p2_owned", strict=True).drop("p2").withColumnRenamed("p2_owned", "p2")
        pairs = pairs.select("s1_id", "cand_id", "p2", (-F.col("p2")).alias("place"))
        named = decode.by_expected_f(pairs, "p2", m.config.most).join(pairs, ["s1_id", "cand_id"])
    S.write_matches(named, need, f"{out}/matching_results", "place")
    S.write_candidates(pairs, need, f"{out}/candidate_pairs", "place")
    return {"pairs": pairs.count(), "links": named.count()}


if __name__ == "__main__":
    main()
