"""Reading records, truth and id lists from tab-separated files; writing id lists.

Everything is read as text by an explicit schema and without quoting: a quote in free text is a character. Null and
missing values become empty texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = ("entity_id", "business_name", "business_address", "country")
TRUTH = ("source1_entity_id", "matched_entity_ids")
MATCHES = ("source1_entity_id", "matched_entity_ids")
CANDIDATES = ("source1_entity_id", "candidate_entity_ids")


def _read(spark: SparkSession, path: str, names: tuple[str, ...]) -> DataFrame:
    """The named columns of a file with a header; ValueError if one is missing."""
    head = spark.read.option("sep", "\t").option("quote", "").option("header", True).option("inferSchema", False).csv(path)
    if missing := [n for n in names if n not in head.columns]:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in head.columns])
    df = spark.read.schema(schema).option("sep", "\t").option("quote", "").option("header", True).csv(path)
    return df.select(*(F.coalesce(F.col(n), F.lit("")).alias(n) for n in names))


def read_records(spark: SparkSession, path: str, src: int) -> DataFrame:
    """(src, entity_id, name, addr, country) of one source."""
    df = _read(spark, path, RECORD)
    return df.select(F.lit(src).cast("byte").alias("src"), "entity_id", F.col("business_name").alias("name"), F.col("business_address").alias("addr"), "country")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, TRUTH)


def ids_of(c: Column) -> Column:
    """A comma list as an array without blanks; null and empty as an empty array."""
    return F.filter(F.transform(F.split(F.trim(F.coalesce(c, F.lit(""))), ","), lambda x: F.trim(x)), lambda x: x != "")


def truth_links(truth: DataFrame) -> DataFrame:
    """(s1_id, cand_id), one row for each id of each list."""
    return truth.select(F.col(TRUTH[0]).alias("s1_id"), F.explode(ids_of(F.col(TRUTH[1]))).alias("cand_id")).distinct()


def id_lists(links: DataFrame, required: DataFrame, header: tuple[str, str] = MATCHES, order: str | None = None) -> DataFrame:
    """One row for each required id (column s1_id), with its ids joined by commas; empty without any.

    order: the column of links that ranks ids; by id without it. Repeated ids count once, blank ones not at all.
    """
    rank = F.col(order) if order else F.lit(0)
    own = (
        links.where(F.coalesce(F.trim("cand_id"), F.lit("")) != "").groupBy("s1_id", "cand_id").agg(F.min(rank).alias("rank"))
        .groupBy("s1_id").agg(F.array_sort(F.collect_list(F.struct("rank", "cand_id"))).alias("l"))
    )
    joined = F.coalesce(F.array_join(F.transform("l", lambda x: x["cand_id"]), ","), F.lit(""))
    return required.select("s1_id").distinct().join(own, "s1_id", "left").select(F.col("s1_id").alias(header[0]), joined.alias(header[1]))


def write_lists(lists: DataFrame, path: str) -> None:
    """Tab-separated, never quoted, in the order of the first column; a folder of part files."""
    a, b = lists.columns
    line = lists.orderBy(a).select(F.concat_ws("\t", a, b).alias("value"))
    line.write.mode("overwrite").text(path)


def write_matches(links: DataFrame, required: DataFrame, path: str, order: str | None = None) -> None:
    write_lists(id_lists(links, required, MATCHES, order), path)


def write_candidates(links: DataFrame, required: DataFrame, path: str, order: str | None = None) -> None:
    write_lists(id_lists(links, required, CANDIDATES, order), path)


def document_entities(docs: DataFrame) -> DataFrame:
    """Records out of a documents table: (src, entity_id, name, addr, country, text).

    Every document is a record of one of three sources. Its first line is the name, the rest of its text, with a number
    and a state that the text determines, is the address, its language the country.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    state = F.element_at(F.array(*map(F.lit, ("texas", "ohio", "kerala", "goa", "paris"))), (F.length(text) % 5 + 1).cast("int"))
    rest = F.array_join(F.slice(F.split(text, "\n"), 2, 1_000_000_000), " ")
    return docs.select(
        (F.col("doc_id") % 3 + 1).cast("byte").alias("src"), F.concat(F.lit("S"), F.col("doc_id") % 3 + 1, F.lit("-"), F.col("doc_id")).alias("entity_id"),
        F.get(F.split(text, "\n"), F.lit(0)).alias("name"), F.concat(F.length(text), F.lit(" "), rest, F.lit(", "), state).alias("addr"),
        F.when(F.col("lang") == "en", "US").when(F.col("lang") == "de", "India").otherwise(F.coalesce("lang", F.lit(""))).alias("country"), text.alias("text"),
    )


def document_truth(entities: DataFrame) -> DataFrame:
    """(s1_id, cand_id): records of sources 2 and 3 with the text of a record of source 1; empty texts are nobody's."""
    entities = entities.where("text <> ''")
    key = F.sha2(F.col("text").cast("binary"), 256)
    a = entities.where("src = 1").select(F.col("entity_id").alias("s1_id"), key.alias("k"))
    b = entities.where("src <> 1").select(F.col("entity_id").alias("cand_id"), key.alias("k"))
    return a.join(b, "k").select("s1_id", "cand_id")
