"""Records in normal form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V
from ..functions.romanise import NATIVE, romanised


def token_table(tokens: DataFrame, learned: DataFrame | None = None) -> DataFrame:
    """(native, latin) for the distinct native tokens of a table (token): the learned form, else by rule."""
    native = tokens.where(F.col("token").rlike(NATIVE)).select(F.col("token").alias("native")).distinct()
    out = native.select("native", romanised(F.col("native")).alias("rule"))
    if learned is None:
        return out.select("native", F.col("rule").alias("latin"))
    return out.join(learned, "native", "left").select("native", F.coalesce("latin", "rule").alias("latin"))


def with_latin(df: DataFrame, column: str, key: str, learned: DataFrame | None = None) -> DataFrame:
    """df with the native tokens of an array column in Latin letters.

    Only rows with a native token are taken apart and put together again.
    """
    has = F.exists(column, lambda x: x.rlike(NATIVE))
    long = df.where(has).select(key, F.posexplode(column).alias("i", "token"))
    table = token_table(long, learned)
    done = (
        long.join(table.withColumnRenamed("native", "token"), "token", "left")
        .groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("latin", "token").alias("t")))).alias("l"))
        .select(key, F.filter(F.transform("l", lambda x: x["t"]), lambda x: x != "").alias("kinfold_latin"))
    )
    return df.join(done, key, "left").withColumn(column, F.coalesce("kinfold_latin", column)).drop("kinfold_latin")


def with_native_states(df: DataFrame, column: str, key: str, learned: DataFrame) -> DataFrame:
    """df with the codes that learned (native, code) has for native components of an array of (part, code).

    Only rows with a native component that is no state yet are taken apart.
    """
    has = F.exists(column, lambda x: x["code"].isNull() & x["part"].rlike(NATIVE))
    long = df.where(has).select(key, F.posexplode(column).alias("i", "x")).select(key, "i", "x.part", "x.code")
    done = (
        long.join(learned.select(F.col("native").alias("part"), F.col("code").alias("more")), "part", "left")
        .groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "part", F.coalesce("code", "more").alias("code")))).alias("l"))
        .select(key, F.transform("l", lambda x: F.struct(x["part"].alias("part"), x["code"].alias("code"))).alias("kinfold_states"))
    )
    return df.join(done, key, "left").withColumn(column, F.coalesce("kinfold_states", column)).drop("kinfold_states")


def names(df: DataFrame, learned: DataFrame | None = None, native: bool = True) -> DataFrame:
    """df (entity_id, name) with name_tok, core_tok, name_str, core_str, concat, alias_str and is_domain.

    native: whether names may be in other scripts than Latin.
    """
    out = df.withColumn("name_tok", X.name_tokens(F.col("name")))
    if native:
        out = with_latin(out, "name_tok", "entity_id", learned)
    out = out.withColumn("name_tok", X.mapped(F.col("name_tok"), V.NAME_CANON)).withColumn("core_tok", X.core(F.col("name_tok")))
    return out.withColumns({
        "name_str": F.array_join("name_tok", " "), "core_str": F.array_join("core_tok", " "), "concat": F.array_join("core_tok", ""),
        "alias_str": X.alias(F.col("name")), "is_domain": X.is_domain(F.col("name")),
    })


def addresses(df: DataFrame, learned: DataFrame | None = None, native: bool = True, native_states: DataFrame | None = None) -> DataFrame:
    """df (entity_id, addr, country) with state, addr_tok, addr_num, addr_str and addr_missing.

    The state is the last component that is one; components that are states belong to the address no longer. native_states:
    (native, code) of components that are states of any country.
    """
    parts = X.components(X.address_base(F.col("addr")))
    out = df.withColumn("kinfold_parts", X.states(F.col("country"), parts))
    if native and native_states is not None:
        out = with_native_states(out, "kinfold_parts", "entity_id", native_states)
    found = F.filter("kinfold_parts", lambda x: x["code"].isNotNull())
    rest = F.array_join(F.transform(F.filter("kinfold_parts", lambda x: x["code"].isNull() & (x["part"] != "")), lambda x: x["part"]), " ")
    out = out.withColumn("state", F.coalesce(F.try_element_at(found, F.lit(-1))["code"], F.lit(""))).withColumn("kinfold_rest", rest)
    out = out.withColumn("addr_num", X.digit_runs(F.col("kinfold_rest"))).withColumn("addr_all", X.address_words(F.col("kinfold_rest")))
    if native:
        out = with_latin(out, "addr_all", "entity_id", learned)
    out = out.withColumn("addr_all", X.mapped(F.col("addr_all"), V.ADDR_CANON))
    return out.withColumns({
        "addr_str": F.array_join(F.transform("addr_all", X.no_leading_zeros), " "),
        "addr_tok": X.without(F.filter("addr_all", lambda x: ~x.rlike(r"^\d+$")), V.ADDR_STOP),
        "addr_missing": F.trim("kinfold_rest") == "",
    }).drop("kinfold_parts", "kinfold_rest", "addr_all")


def normalized(df: DataFrame, learned: DataFrame | None = None, native: bool = True, native_states: DataFrame | None = None) -> DataFrame:
    """Names and addresses of records (src, entity_id, name, addr, country)."""
    return addresses(names(df, learned, native), learned, native, native_states)


def unromanised(df: DataFrame) -> DataFrame:
    """(src, entity_id, name_tok, parts, state) of records, from which dictionaries are learned."""
    parts = X.states(F.col("country"), X.components(X.address_base(F.col("addr"))))
    out = df.select("src", "entity_id", X.name_tokens(F.col("name")).alias("name_tok"), parts.alias("kinfold_parts"))
    found = F.filter("kinfold_parts", lambda x: x["code"].isNotNull())
    return out.select("src", "entity_id", "name_tok", F.transform("kinfold_parts", lambda x: x["part"]).alias("parts"), F.coalesce(F.try_element_at(found, F.lit(-1))["code"], F.lit("")).alias("state"))


def plain(df: DataFrame, canonical_suffix: bool = True, compat: bool = False) -> DataFrame:
    """df with the plainer normal forms as structs n and a."""
    return df.withColumn("n", X.plain_name(F.col("name"), canonical_suffix)).withColumn("a", X.plain_address(F.col("addr"), compat))


def kept(df: DataFrame, key: Column, share: int, salt: str = "sample") -> DataFrame:
    """About share of 1,000 rows, the same ones every time."""
    return df.where(F.pmod(F.xxhash64(F.lit(salt), key), F.lit(1000)) < share)
