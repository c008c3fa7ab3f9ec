"""Features of pairs. pairs has s1_id and cand_id; records are in normal form."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.romanise import NATIVE
from ..functions.similarity import scores
from ..plans.session import dealt, stored, stored_parts
from .learn import word_lists

SIDE = ("name", "name_str", "core_str", "concat", "alias_str", "addr_str", "addr_tok", "addr_num", "core_tok", "state", "addr_missing", "is_domain")

PLAIN = (
    "name_exact name_sorted_exact name_despaced_exact name_jaro_winkler name_indel_ratio name_token_set_ratio name_token_sort_ratio "
    "name_partial_ratio name_char_ngram_jaccard name_token_jaccard name_first_token_match name_len_ratio suffix_match suffix_conflict "
    "addr_exact addr_token_jaccard addr_indel_ratio postcode_both_present postcode_match house_num_overlap house_num_any "
    "addr_s1_missing addr_cand_missing addr_either_missing is_source2"
).split()
BLOCK = "nt np nc ap at nn nw aa ns nx bscore rscore brank r_bs r_brank r_name r_addr r_num_conflict r_num_match".split()
STRING = (
    "n_ratio n_tset n_tsort n_partial c_ratio c_tset c_tsort c_partial c_jw x_ratio x_partial x_prefix alias_ratio a_ratio a_tset a_tsort "
    "a_partial c_inter c_len_a c_len_b aw_inter aw_len_a aw_len_b num_inter num_len_a num_len_b num_first_eq num_conflict state_cmp "
    "addr_missing_b is_domain_b acronym_b native_b src_b x_len_a x_len_b c_cov_a c_cov_b aw_cov_b num_cov_b"
).split()
EXTRA = (
    "n_near n_trunc n_bigA_in_B n_bigB_in_A n_exact2 llr_extra_min llr_extra_max llr_extra_sum llr_extra_unk llr_miss_min llr_miss_sum "
    "llr_miss_unk n_extra n_miss sib_n sib_addr sib_name sib_num sib_addr_exact"
).split()


def attach(pairs: DataFrame, records: DataFrame, columns: tuple[str, ...] = SIDE) -> DataFrame:
    """pairs with the columns of both records, as <column>_a and <column>_b."""
    a = records.where("src = 1").select(F.col("entity_id").alias("s1_id"), *(F.col(c).alias(f"{c}_a") for c in columns))
    b = records.where("src <> 1").select(F.col("entity_id").alias("cand_id"), *(F.col(c).alias(f"{c}_b") for c in columns), F.col("src").alias("src_b"))
    return dealt(pairs.drop("src_b"), "s1_id").join(a, "s1_id", "left").join(b, "cand_id", "left")


#: Bytes of records that one task holds of each side, and the copies of a record beyond which each of its pairs carries it.
HELD, COPIES = 192 << 20, 24


#: A join by two keys then leaves sides as they are that are dealt out by the first of them.
BY_FIRST = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


def cell_keys(spark: SparkSession, cells: int, partitions: int) -> list[int]:
    """Numbers that hash partitioning puts into partitions of their own, as far as the first few thousand do."""
    at = F.pmod(F.hash("id"), F.lit(partitions))
    found = spark.range(64 * partitions).groupBy(at.alias("at")).agg(F.min("id").alias("id")).orderBy("at").limit(cells).collect()
    own = [r["id"] for r in found]
    return own + [-1 - k for k in range(cells - len(own))]


def met(pairs: DataFrame, a: DataFrame, b: DataFrame, held: int, slices: int = 1) -> DataFrame:
    """pairs with the columns of a (by s1_id) and of b (by cand_id); held: bytes of both. To be run under BY_FIRST.

    Records, not pairs, are shuffled: both sides are dealt into so many parts that one fits a task, and each pair of parts
    meets in a task of its own, together with the pairs of ids that belong there. So a record is sent once for each part
    of the other side. If that is oftener than its pairs are many, each pair carries its record instead. slices: a is one of
    so many, and so small that it isn't divided; b is sent once.
    """
    spark = pairs.sparkSession
    cores = spark.sparkContext.defaultParallelism
    n, k = (max(math.ceil(math.sqrt(cores)), math.ceil(held / HELD)),) * 2 if slices == 1 else (1, max(cores, math.ceil(held / HELD)))
    if slices == 1 and n > COPIES:
        return dealt(pairs, "s1_id").join(a, "s1_id", "left").join(b, "cand_id", "left")
    # Fewer partitions than a shuffle has would be dealt out again, by both keys.
    partitions = max(n * k, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = F.array(*(F.lit(x).cast("long") for x in cell_keys(spark, n * k, partitions)))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    cell = lambda i, j: F.get(keys, i * k + j)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    in_cells = lambda df: df.repartition(partitions, "kinfold_cell")
    a = a.withColumn("kinfold_j", every(k)).withColumn("kinfold_cell", cell(part("s1_id", n), F.col("kinfold_j"))).drop("kinfold_j")
    b = b.withColumn("kinfold_i", every(n)).withColumn("kinfold_cell", cell(F.col("kinfold_i"), part("cand_id", k))).drop("kinfold_i")
    p = in_cells(pairs.withColumn("kinfold_cell", cell(part("s1_id", n), part("cand_id", k))))
    for side, key in ((a, "s1_id"), (b, "cand_id")):
        p = p.join(in_cells(side).hint("shuffle_hash"), ["kinfold_cell", key], "left")
    return p.drop("kinfold_cell")


#: Bytes of records, as far as they are sent, of one slice.
SLICE = 256 << 20


def held_by(records: DataFrame) -> int:
    """Characters of names and addresses."""
    return records.select(F.sum(F.length(F.coalesce("name", F.lit(""))) + F.length(F.coalesce("addr", F.lit("")))).alias("n")).first()["n"] or 0


def by_slices(pairs: DataFrame, records: DataFrame, held: int, make: Callable[[DataFrame, DataFrame, DataFrame, int], DataFrame]) -> DataFrame:
    """make(pairs, records of source 1, other records, slices), a row for each pair, written under BY_FIRST by slices of the
    records of source 1, one after another: the shuffle files of a slice go before the next is begun. held: bytes of records."""
    n = max(1, math.ceil(held / SLICE))
    a, b = records.where("src = 1"), records.where("src <> 1")
    if n == 1:
        return stored(make(pairs, a, b, 1), BY_FIRST)
    # Both are read for each slice.
    pairs = stored(pairs)
    own = lambda c, k: F.pmod(F.xxhash64(F.lit("slice"), F.col(c)), F.lit(n)) == k
    return stored_parts([lambda k=k: make(pairs.where(own("s1_id", k)), a.where(own("entity_id", k)), b, n) for k in range(n)], BY_FIRST)


def labelled(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """pairs with y: 1 for a true link."""
    return pairs.join(links.select("s1_id", "cand_id").distinct().withColumn("y", F.lit(1)), ["s1_id", "cand_id"], "left").withColumn("y", F.coalesce("y", F.lit(0)))


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def plain_features(pairs: DataFrame, records: DataFrame, fuzzy: bool = True, kind: str = "float") -> DataFrame:
    """The 25 features over the plainer form (structs n and a), of a numeric kind; fuzzy: with the string similarities. Written."""
    # Words are in their joined forms, whose copies cost least; without similarities an address's are needed once each.
    short = {
        "name": F.col("n.norm"), "suffix": F.col("n.suffix"), "is_missing": F.col("a.is_missing"), "postcode": F.col("a.postcode"), "house": F.array_join("a.house_numbers", " "),
        "digest": F.sha2("a.norm", 256), "addr": F.col("a.norm") if fuzzy else F.array_join(F.array_distinct("a.tokens"), " "),
    }
    held = held_by(records)
    records = records.select("src", "entity_id", *(c.alias(k) for k, c in short.items()))
    if held > SLICE:
        records = stored(records)
    side = lambda own, key, x, *more: own.select(F.col("entity_id").alias(key), *more, *(F.col(k).alias(f"{k}_{x}") for k in short))

    def make(p: DataFrame, a: DataFrame, b: DataFrame, slices: int) -> DataFrame:
        met_ = met(p.drop("src_b"), side(a, "s1_id", "a"), side(b, "cand_id", "b", F.col("src").alias("src_b")), held, slices)
        return _plain_features(met_, [c for c in pairs.columns if c not in PLAIN], fuzzy, kind)

    return by_slices(pairs, records, held, make)


def _plain_features(p: DataFrame, keep: list[str], fuzzy: bool, kind: str) -> DataFrame:
    apart = lambda c: F.when(F.col(c) != "", F.split(c, " ")).otherwise(F.array().cast("array<string>"))
    p = p.withColumns({f"{k}_words_{x}": apart(f"{k}_{x}") for k in ("name", "addr", "house") for x in "ab"})
    p = p.withColumns({f"grams_{x}": X.grams(F.replace(F.col(f"name_{x}"), F.lit(" "), F.lit(""))) for x in "ab"})
    form = lambda x: {
        "norm": F.col(f"name_{x}"), "tokens": F.col(f"name_words_{x}"), "sorted": F.array_join(F.array_sort(f"name_words_{x}"), " "),
        "despaced": F.replace(F.col(f"name_{x}"), F.lit(" "), F.lit("")), "suffix": F.col(f"suffix_{x}"),
    }
    place = lambda x: {
        "norm": F.col(f"addr_{x}"), "digest": F.col(f"digest_{x}"), "tokens": F.col(f"addr_words_{x}"), "postcode": F.col(f"postcode_{x}"),
        "house_numbers": F.col(f"house_words_{x}"), "is_missing": F.col(f"is_missing_{x}"),
    }
    na, nb, aa, ab = form("a"), form("b"), place("a"), place("b")
    both = ~aa["is_missing"] & ~ab["is_missing"]
    la, lb = F.length(na["norm"]), F.length(nb["norm"])
    equal = lambda k: _flag((na[k] == nb[k]) & (na[k] != ""))
    post = (aa["postcode"] != "") & (ab["postcode"] != "")
    out = {
        "name_exact": equal("norm"), "name_sorted_exact": equal("sorted"), "name_despaced_exact": equal("despaced"),
        "name_char_ngram_jaccard": X.jaccard(F.col("grams_a"), F.col("grams_b")), "name_token_jaccard": X.jaccard(na["tokens"], nb["tokens"]),
        "name_first_token_match": _flag(X.first(na["tokens"]) == X.first(nb["tokens"])),
        "name_len_ratio": F.when(F.greatest(la, lb) > 0, F.least(la, lb) / F.greatest(la, lb)).otherwise(F.lit(1.0)),
        "suffix_match": equal("suffix"), "suffix_conflict": _flag((na["suffix"] != "") & (nb["suffix"] != "") & (na["suffix"] != nb["suffix"])),
        "addr_exact": _flag(both & (aa["digest"] == ab["digest"])), "addr_token_jaccard": F.when(both, X.jaccard(aa["tokens"], ab["tokens"])).otherwise(F.lit(0.0)),
        "postcode_both_present": _flag(post), "postcode_match": _flag(post & (aa["postcode"] == ab["postcode"])),
        "house_num_overlap": X.jaccard(aa["house_numbers"], ab["house_numbers"]), "house_num_any": _flag((F.size(aa["house_numbers"]) > 0) & (F.size(ab["house_numbers"]) > 0)),
        "addr_s1_missing": _flag(aa["is_missing"]), "addr_cand_missing": _flag(ab["is_missing"]), "addr_either_missing": _flag(~both), "is_source2": _flag(F.col("src_b") == 2),
    }
    if fuzzy:
        x, y = na["norm"], nb["norm"]
        p = p.withColumn("kinfold_s", scores({
            "jw": ("jw", x, y), "ratio": ("ratio", x, y), "tset": ("tset", x, y), "tsort": ("tsort", x, y), "partial": ("partial", x, y), "addr": ("ratio", aa["norm"], ab["norm"]),
        }))
        s = lambda k: F.col(f"kinfold_s.{k}") / 100
        out |= {
            "name_jaro_winkler": F.when((x != "") & (y != ""), F.col("kinfold_s.jw")).otherwise(F.lit(0.0)), "name_indel_ratio": s("ratio"), "name_token_set_ratio": s("tset"),
            "name_token_sort_ratio": s("tsort"), "name_partial_ratio": s("partial"), "addr_indel_ratio": F.when(both, s("addr")).otherwise(F.lit(0.0)),
        }
    return p.select(*keep, *(out[k].cast(kind).alias(k) for k in PLAIN if k in out))


def overlap_features(p: DataFrame) -> DataFrame:
    """An attached table with counts, flags and coverages (all of STRING that no similarity goes into)."""
    num = F.size(F.array_intersect("addr_num_a", "addr_num_b"))
    p = p.withColumns({
        "c_inter": F.size(F.array_intersect("core_tok_a", "core_tok_b")), "c_len_a": F.size("core_tok_a"), "c_len_b": F.size("core_tok_b"),
        "aw_inter": F.size(F.array_intersect("addr_tok_a", "addr_tok_b")), "aw_len_a": F.size("addr_tok_a"), "aw_len_b": F.size("addr_tok_b"),
        "num_inter": num, "num_len_a": F.size("addr_num_a"), "num_len_b": F.size("addr_num_b"),
        "num_first_eq": _flag(X.first(F.col("addr_num_a")) == X.first(F.col("addr_num_b"))),
        "num_conflict": _flag((F.size("addr_num_a") > 0) & (F.size("addr_num_b") > 0) & (num == 0)),
        "state_cmp": F.when((F.col("state_a") == "") | (F.col("state_b") == ""), 0).when(F.col("state_a") == F.col("state_b"), 1).otherwise(-1),
        "acronym_b": _flag(X.initials(F.col("core_tok_a")) == F.col("concat_b")), "native_b": _flag(F.col("name_b").rlike(NATIVE)),
        "x_len_a": F.length("concat_a"), "x_len_b": F.length("concat_b"), "x_prefix": X.prefix_length(F.col("concat_a"), F.col("concat_b")),
    })
    cover = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return p.withColumns({
        "c_cov_a": cover("c_inter", "c_len_a"), "c_cov_b": cover("c_inter", "c_len_b"), "aw_cov_b": cover("aw_inter", "aw_len_b"), "num_cov_b": cover("num_inter", "num_len_b"),
        "addr_missing_b": _flag(F.col("addr_missing_b")), "is_domain_b": _flag(F.col("is_domain_b")), "src_b": F.col("src_b").cast("int"),
    })


def string_features(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """pairs with the features of STRING. Written."""
    # The forms that are sent are some three times as long as the name and the address.
    held = 3 * held_by(records)
    side = lambda own, key, x, *more: own.select(F.col("entity_id").alias(key), *(F.col(k).alias(f"{k}_{x}") for k in SIDE), *more)

    def make(p: DataFrame, a: DataFrame, b: DataFrame, slices: int) -> DataFrame:
        return _string_features(met(p.drop("src_b"), side(a, "s1_id", "a"), side(b, "cand_id", "b", F.col("src").alias("src_b")), held, slices), [x for x in pairs.columns if x not in STRING])

    return by_slices(pairs, records, held, make)


def _string_features(p: DataFrame, keep: list[str]) -> DataFrame:
    c = lambda k: (F.col(f"{k}_a"), F.col(f"{k}_b"))
    wanted = {f"n_{k}": (k, *c("name_str")) for k in ("ratio", "tset", "tsort", "partial")} | {f"c_{k}": (k, *c("core_str")) for k in ("ratio", "tset", "tsort", "partial", "jw")}
    wanted |= {f"x_{k}": (k, *c("concat")) for k in ("ratio", "partial")} | {f"a_{k}": (k, *c("addr_str")) for k in ("ratio", "tset", "tsort", "partial")}
    wanted["alias_ratio"] = ("tset", F.col("core_str_a"), F.col("alias_str_b"))
    p = overlap_features(p.withColumn("kinfold_s", scores(wanted)).withColumns({k: F.col(f"kinfold_s.{k}") for k in wanted}))
    return p.select(*keep, *(F.col(k).cast("float").alias(k) for k in STRING))


def number_features(p: DataFrame, a: str = "addr_num_a", b: str = "addr_num_b") -> DataFrame:
    """p with relations between the numbers of two addresses, of up to nine digits."""
    short = lambda k: F.filter(F.coalesce(F.col(k), F.array().cast("array<string>")), lambda x: (F.length(x) >= 1) & (F.length(x) <= 9))
    p = p.withColumn("kinfold_a", short(a)).withColumn("kinfold_b", short(b))
    A, B = F.col("kinfold_a"), F.col("kinfold_b")
    n = lambda x: x.try_cast("long")
    has = lambda x, y: x.startswith(y) | x.endswith(y)
    near = F.exists(A, lambda x: F.exists(B, lambda y: (n(x) != n(y)) & (F.length(x) == F.length(y)) & (F.length(x) >= 2) & (F.abs(n(x) - n(y)) <= 20) & ~F.array_contains(B, x) & ~F.array_contains(A, y)))
    trunc = F.exists(A, lambda x: F.exists(B, lambda y: (n(x) != n(y)) & (F.least(F.length(x), F.length(y)) >= 2) & (has(x, y) | has(y, x))))
    big = lambda x: F.array_max(F.transform(x, n)).cast("string")
    return p.withColumns({
        "n_near": _flag(near), "n_trunc": _flag(trunc), "n_exact2": F.size(F.filter(F.array_intersect(A, B), lambda x: F.length(x) >= 2)),
        "n_bigA_in_B": _flag(F.array_contains(B, big(A))), "n_bigB_in_A": _flag(F.array_contains(A, big(B))),
    }).drop("kinfold_a", "kinfold_b")


def word_features(p: DataFrame, weights: DataFrame, key: tuple[str, ...] = ("s1_id", "cand_id")) -> DataFrame:
    """p (name_a, name_b) with sums and extremes of the weights of extra and missing words; unknown words are counted."""
    w = word_lists(p)
    for side in ("extra", "miss"):
        own = weights.where(F.col("side") == side).select("tok", "llr")
        agg = (
            w.select(*key, F.explode(side).alias("tok")).join(own, "tok", "left").groupBy(*key)
            .agg(F.min("llr").alias(f"llr_{side}_min"), F.max("llr").alias(f"llr_{side}_max"), F.sum("llr").alias(f"llr_{side}_sum"), F.sum(F.col("llr").isNull().cast("int")).alias(f"llr_{side}_unk"))
        )
        w = w.join(agg, list(key), "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in w.columns if c.startswith("llr_")}
    return w.withColumns(zero | {"n_extra": F.size("extra"), "n_miss": F.size("miss")}).drop("extra", "miss", "llr_miss_max")


def sibling_features(p: DataFrame, prob: str = "p1", least: float = 0.5, fuzzy: bool = True) -> DataFrame:
    """p (name_b, addr_b: strings, num_b) with agreement with the same record's other candidates of that probability.

    Without any, counts are 0 and the rest -1. fuzzy: with the word-set similarities.
    """
    peers = p.where(F.col(prob) >= least).select("s1_id", F.col("cand_id").alias("peer"), F.col("addr_b").alias("sa"), F.col("name_b").alias("sn"), F.col("num_b").alias("snum"))
    both = p.select("s1_id", "cand_id", "addr_b", "name_b", "num_b").join(peers, "s1_id").where("cand_id <> peer")
    num = F.size(F.filter(F.array_intersect("num_b", "snum"), lambda x: F.length(x) >= 2)) > 0
    both = both.withColumn("s_num", _flag(num)).withColumn("s_exact", _flag((F.col("addr_b") == F.col("sa")) & (F.length("addr_b") > 0)))
    aggs = [F.count("*").alias("sib_n"), F.max("s_num").alias("sib_num"), F.max("s_exact").alias("sib_addr_exact")]
    if fuzzy:
        both = both.withColumn("s", scores({"addr": ("tset", F.col("addr_b"), F.col("sa")), "name": ("tset", F.col("name_b"), F.col("sn"))}))
        aggs += [(F.max("s.addr") / 100).alias("sib_addr"), (F.max("s.name") / 100).alias("sib_name")]
    out = p.join(both.groupBy("s1_id", "cand_id").agg(*aggs), ["s1_id", "cand_id"], "left")
    made = ["sib_num", "sib_addr_exact", *(["sib_addr", "sib_name"] if fuzzy else [])]
    return out.withColumns({"sib_n": F.coalesce("sib_n", F.lit(0))} | {c: F.coalesce(F.col(c), F.lit(-1)) for c in made})


def extra_features(pairs: DataFrame, records: DataFrame, weights: DataFrame, prob: str = "p1") -> DataFrame:
    """pairs with the features of EXTRA."""
    p = attach(pairs, records, ("name_str", "addr_str", "addr_num"))
    p = p.withColumnsRenamed({"name_str_a": "name_a", "name_str_b": "name_b", "addr_str_b": "addr_b"}).withColumn("num_b", F.col("addr_num_b"))
    p = word_features(sibling_features(number_features(p), prob), weights)
    return p.select(*pairs.columns, *(F.col(k).cast("float").alias(k) for k in EXTRA))
