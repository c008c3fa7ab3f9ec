"""The registered queries. Records come from documents: first line as name, the rest as address, language as country."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.romanise import romanised, script
from ..functions.similarity import scores
from ..functions.vocabulary import KEY_TYPES
from ..operators import blocking, context, decode, features, learn, normalize
from ..sources import records as S
from .resolve import Config, resolve, resolve_plain, train, train_plain
from .session import ship, spread, stored
from .sql import SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return f


def ent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.document_entities(spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")))


def rec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in normal form, written once for all that a query reads of them."""
    return stored(normalize.normalized(ent(spark, sf_dir), native=False))


def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(normalize.plain(ent(spark, sf_dir)))


#: Letters and digits, and those that natively() writes in their place.
LATIN, NATIVE = "kgcjtdnpbmyrlvsh0123456789", "कगचजटडनपबमयरलवसह०१२३४५६७८९"


def natively(e: DataFrame) -> DataFrame:
    """Records whose candidates are written in another script: consonants of names, consonants and digits of addresses."""
    other = F.col("src") != 1
    names = F.translate(F.lower("name"), LATIN[:16], NATIVE[:16])
    return e.withColumns({"name": F.when(other, names).otherwise(F.col("name")), "addr": F.when(other, F.translate(F.lower("addr"), LATIN, NATIVE)).otherwise(F.col("addr"))})


def native_dictionaries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(tokens, states) learned from natively written candidates; two links are enough for a state."""
    e = ent(spark, sf_dir)
    return learn.dictionaries(normalize.unromanised(natively(e)), S.document_truth(e), 2)


def first(e: DataFrame) -> DataFrame:
    return e.where("src = 1").select(F.col("entity_id").alias("s1_id"))


def pairs(spark: SparkSession, sf_dir: str, records: DataFrame | None = None) -> DataFrame:
    """Shortlist with a probability out of the block score."""
    p = blocking.block(records or rec(spark, sf_dir), 25)
    return p.select("s1_id", "cand_id", "src", "bscore", F.round(F.col("bscore") / (F.col("bscore") + 40), 6).alias("p"))


def six(c: Column) -> Column:
    """c to six places as SQL rounds: what a product of doubles makes a little less than a half, such as of 41 / 640, goes down."""
    x = c.cast("double")
    return F.signum(x) * F.floor(F.abs(x) * 1e6 + 0.5) / 1e6 + 0.0


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: six(F.col(c)) for c in columns})


@query
def entities(spark, sf_dir):
    return ent(spark, sf_dir).drop("text")


@query
def truth_links(spark, sf_dir):
    return S.document_truth(ent(spark, sf_dir))


@query
def truth_parsed(spark, sf_dir):
    """The truth as a table of comma lists, with blanks, taken apart again."""
    lists = S.id_lists(S.document_truth(ent(spark, sf_dir)), first(ent(spark, sf_dir)), S.TRUTH)
    return S.truth_links(lists.withColumn(S.TRUTH[1], F.concat(F.lit(" "), F.regexp_replace(S.TRUTH[1], ",", ", ,"), F.lit(",,"))))


@query
def name_tokens(spark, sf_dir):
    t = X.name_tokens(F.col("name"))
    return ent(spark, sf_dir).select("entity_id", F.array_join(t, " ").alias("tokens"), F.size(t).alias("n"))


@query
def names(spark, sf_dir):
    return normalize.names(ent(spark, sf_dir), native=False).select("entity_id", "name_str", "core_str", "concat", "alias_str", "is_domain")


@query
def addresses(spark, sf_dir):
    a = normalize.addresses(ent(spark, sf_dir), native=False)
    return a.select("entity_id", "state", F.array_join("addr_tok", " ").alias("addr_tok"), F.array_join("addr_num", " ").alias("addr_num"), "addr_str", "addr_missing")


@query
def plain_names(spark, sf_dir):
    return normalize.plain(ent(spark, sf_dir)).select("entity_id", *(F.col(f"n.{c}") for c in ("norm", "sorted", "despaced", "suffix", "is_domain")))


@query
def plain_addresses(spark, sf_dir):
    return normalize.plain(ent(spark, sf_dir)).select("entity_id", "a.norm", "a.postcode", F.array_join("a.house_numbers", ",").alias("house_numbers"), "a.landmark", "a.is_missing")


@query
def grams(spark, sf_dir):
    return normalize.plain(ent(spark, sf_dir)).select(F.explode(X.grams(F.col("n.despaced"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


for _k in KEY_TYPES:

    def _keys(spark, sf_dir, k=_k):
        return blocking.keys(normalize.normalized(ent(spark, sf_dir), native=False)).where(F.col("kt") == k).select("entity_id", "country", "key")

    _keys.__name__ = f"keys_{_k}"
    query(_keys)


@query
def key_weights(spark, sf_dir):
    r = rec(spark, sf_dir)
    return rounded(blocking.usable_keys(blocking.keys(r).where("src <> 1"), r), "w")


@query
def signal_postings(spark, sf_dir):
    r = plain(spark, sf_dir)
    return rounded(blocking.usable_signals(blocking.signals(r).where("src <> 1"), r), "w")


@query
def block_idf(spark, sf_dir):
    return blocking.block(rec(spark, sf_dir))


@query
def block_rarity(spark, sf_dir):
    return blocking.block_plain(normalize.plain(ent(spark, sf_dir)))


@query
def union_candidates(spark, sf_dir):
    return blocking.union_candidates(normalize.plain(ent(spark, sf_dir)))


@query
def blocking_diagnostics(spark, sf_dir):
    e = ent(spark, sf_dir)
    return rounded(decode.diagnostics(pairs(spark, sf_dir), S.document_truth(e), first(e)), "recall_ceiling", "avg_candidates_per_s1")


@query
def overlap_features(spark, sf_dir):
    wanted = [c for c in features.STRING if c in "c_inter c_len_a c_len_b aw_inter aw_len_a aw_len_b num_inter num_len_a num_len_b num_first_eq num_conflict state_cmp addr_missing_b is_domain_b acronym_b native_b src_b x_len_a x_len_b x_prefix c_cov_a c_cov_b aw_cov_b num_cov_b".split()]
    r = rec(spark, sf_dir)
    p = features.overlap_features(features.attach(pairs(spark, sf_dir, r).select("s1_id", "cand_id"), r))
    return rounded(p.select("s1_id", "cand_id", *wanted), "c_cov_a", "c_cov_b", "aw_cov_b", "num_cov_b")


@query
def plain_features(spark, sf_dir):
    r = normalize.plain(ent(spark, sf_dir))
    out = features.plain_features(blocking.block_plain(r).select("s1_id", "cand_id"), r, fuzzy=False, kind="double")
    real = ("name_char_ngram_jaccard", "name_token_jaccard", "name_len_ratio", "addr_token_jaccard", "house_num_overlap")
    return out.select("s1_id", "cand_id", *(six(F.col(c)).alias(c) if c in real else F.col(c).cast("int").alias(c) for c in out.columns[2:]))


@query
def jaro_winkler(spark, sf_dir):
    r = rec(spark, sf_dir)
    p = features.attach(pairs(spark, sf_dir, r).select("s1_id", "cand_id"), r, ("core_str",))
    ascii_ = lambda c: F.regexp_replace(c, "[^a-z0-9 ]", "")  # noqa: E731  DuckDB compares bytes
    return p.select("s1_id", "cand_id", F.round(scores({"jw": ("jw", ascii_("core_str_a"), ascii_("core_str_b"))})["jw"], 6).alias("jw"))


@query
def number_relations(spark, sf_dir):
    r = rec(spark, sf_dir)
    p = features.number_features(features.attach(pairs(spark, sf_dir, r).select("s1_id", "cand_id"), r, ("addr_num",)))
    return p.select("s1_id", "cand_id", "n_near", "n_trunc", "n_exact2", "n_bigA_in_B", "n_bigB_in_A")


def _named(spark, sf_dir):
    e, r = ent(spark, sf_dir), rec(spark, sf_dir)
    p = features.labelled(pairs(spark, sf_dir, r).select("s1_id", "cand_id"), S.document_truth(e))
    return features.attach(p, r, ("name_str",)).select("s1_id", "cand_id", "y", F.col("name_str_a").alias("name_a"), F.col("name_str_b").alias("name_b"))


@query
def word_weights(spark, sf_dir):
    return rounded(learn.word_weights(_named(spark, sf_dir)), "llr")


@query
def word_features(spark, sf_dir):
    p = stored(_named(spark, sf_dir))
    out = features.word_features(p, learn.word_weights(p)).drop("y", "name_a", "name_b")
    return rounded(out, *(c for c in out.columns if c.startswith("llr_") and not c.endswith("_unk")))


@query
def sibling_numbers(spark, sf_dir):
    r = rec(spark, sf_dir)
    p = features.attach(pairs(spark, sf_dir, r).select("s1_id", "cand_id", "p"), r, ("name_str", "addr_str", "addr_num"))
    p = p.withColumnsRenamed({"addr_str_b": "addr_b", "name_str_b": "name_b", "addr_num_b": "num_b"})
    return features.sibling_features(p, "p", 0.5, fuzzy=False).select("s1_id", "cand_id", "sib_n", "sib_num", "sib_addr_exact")


@query
def context_ranks(spark, sf_dir):
    out = context.context(pairs(spark, sf_dir), "p", "p")
    return rounded(out.drop("src", "bscore", "p"), "p_gap_s1", "p_margin_s1", "p_gap_c")


@query
def source_context(spark, sf_dir):
    return rounded(context.source_context(pairs(spark, sf_dir), "p").drop("src", "bscore", "p"), "sum_s1", "sum_c")


@query
def scaled_scores(spark, sf_dir):
    return rounded(context.scaled(pairs(spark, sf_dir), "bscore").drop("src", "bscore", "p"), "bscore_share", "bscore_log_rank")


@query
def one_owner(spark, sf_dir):
    p = context.one_owner(context.one_owner(pairs(spark, sf_dir), "p", "owned"), "p", "owned_strict", strict=True)
    return p.select("s1_id", "cand_id", "owned", "owned_strict")


@query
def prune(spark, sf_dir):
    return context.prune(pairs(spark, sf_dir), "p", 0.3).select("s1_id", "cand_id", "p")


@query
def threshold_decode(spark, sf_dir):
    return decode.as_text(decode.by_threshold(pairs(spark, sf_dir), "p", 0.7))


@query
def threshold_search(spark, sf_dir):
    e = ent(spark, sf_dir)
    return rounded(decode.threshold_scores(pairs(spark, sf_dir), "p", S.document_truth(e), first(e)), "f05")


def _rounded_metrics(df):
    return rounded(df, "f05", "f05_singletons", "f05_nonsingletons", "micro_precision", "micro_recall")


@query
def macro_f05(spark, sf_dir):
    e = ent(spark, sf_dir)
    return _rounded_metrics(decode.metrics(decode.by_threshold(pairs(spark, sf_dir), "p", 0.7), S.document_truth(e), first(e)))


@query
def oracle_f05(spark, sf_dir):
    e = ent(spark, sf_dir)
    return _rounded_metrics(decode.oracle(pairs(spark, sf_dir), S.document_truth(e), first(e)))


@query
def sink_matches(spark, sf_dir):
    links = pairs(spark, sf_dir).where("p >= 0.7").withColumn("place", -F.col("p"))
    return S.id_lists(links, first(ent(spark, sf_dir)), S.MATCHES, "place")


@query
def sink_candidates(spark, sf_dir):
    return S.id_lists(pairs(spark, sf_dir), first(ent(spark, sf_dir)), S.CANDIDATES)


@query
def token_dictionary(spark, sf_dir):
    return native_dictionaries(spark, sf_dir)[0]


@query
def state_dictionary(spark, sf_dir):
    return native_dictionaries(spark, sf_dir)[1]


@query
def native_names(spark, sf_dir):
    """Names of natively written records, by the learned dictionary, else by rule."""
    n = normalize.names(natively(ent(spark, sf_dir)), native_dictionaries(spark, sf_dir)[0])
    return n.select("entity_id", "name_str", "core_str", "concat", "is_domain")


@query
def native_addresses(spark, sf_dir):
    """Addresses of natively written records, by rule, with learned states."""
    a = normalize.addresses(natively(ent(spark, sf_dir)), native_states=native_dictionaries(spark, sf_dir)[1])
    return a.select("entity_id", "state", F.array_join("addr_tok", " ").alias("addr_tok"), F.array_join("addr_num", " ").alias("addr_num"), "addr_str", "addr_missing")


@query
def reranked_fixed(spark, sf_dir):
    """The re-rank by fixed weights, those of the similarities 0, so that SQL has the same order."""
    r = rec(spark, sf_dir)
    weights = {"bias": -1.0, "r_bs": 2.0, "r_brank": -0.5, "r_addr_missing": 0.25, "r_num_conflict": -0.75, "r_num_match": 0.5}
    out = blocking.rerank(blocking.rerank_features(blocking.block(r), r), weights)
    return rounded(out.select("s1_id", "cand_id", "r_bs", "r_brank", "r_addr_missing", "r_num_conflict", "r_num_match", "rscore", "brank"), "r_bs", "r_brank")


@query
def expected_f_decode(spark, sf_dir):
    return decode.by_expected_f(pairs(spark, sf_dir), "p")


@query
def romanised_tokens(spark, sf_dir):
    """Distinct tokens of all texts, moved into Devanagari letter by letter, with their script and romanisation."""
    t = ent(spark, sf_dir).select(F.explode(X.words(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " ")).alias("token")).distinct()
    native = F.translate("token", LATIN[:16], NATIVE[:16])
    return t.withColumn("native", native).select("token", "native", romanised(F.col("native")).alias("latin"), script(F.col("native")).alias("script"))


# -- without SQL: similarities and models


@query
def string_features(spark, sf_dir):
    r = rec(spark, sf_dir)
    return features.string_features(pairs(spark, sf_dir, r).select("s1_id", "cand_id"), r)


@query
def reranked(spark, sf_dir):
    r = rec(spark, sf_dir)
    p = blocking.rerank_features(blocking.block(r), r)
    weights = blocking.rerank_weights(features.labelled(p, S.document_truth(ent(spark, sf_dir))))
    return blocking.rerank(p, weights)


@query
def resolved(spark, sf_dir):
    """Training on the true links, then all records resolved: one list of matches for each record of source 1.

    With five rounds of trees, not Config.rounds: these queries show the whole run, and training takes most of their time.
    """
    e = ent(spark, sf_dir)
    return S.id_lists(resolve(e, train(e, S.document_truth(e), Config(folds=2, rounds=5), native=False)), first(e), S.MATCHES)


@query
def resolved_plain(spark, sf_dir):
    """The same by two stacked stages over the plainer features, with calibration, one owner and a threshold; with all rounds and folds."""
    e = ent(spark, sf_dir)
    return S.id_lists(resolve_plain(e, train_plain(e, S.document_truth(e), Config())), first(e), S.MATCHES)


ORACLE_SQL = {("context_ranks" if k == "context" else k): v for k, v in SQL.items()}
