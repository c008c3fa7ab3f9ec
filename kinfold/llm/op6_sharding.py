"""Sharding by extendible hashing.

A shard is a prefix of the bits of a hash of doc_id. The directory starts with one shard; only a shard over the byte
limit splits, on its next bit, until every shard fits. The directory is built from sums of bytes over cells (prefixes of
a length that the total suggests), not from the rows; only rows of cells that are themselves over the limit are summed
again over longer prefixes. The directory depends on the rows and the limit alone, not on how it was built.

The hash is the first 60 bits of md5 over doc_id as text.

Defined cases: null and empty texts have no bytes and still belong to a shard; a null doc_id hashes as an empty text;
rows with one doc_id share a shard; a shard of BITS bits that is over the limit (one long text, or many rows of one
doc_id) stays as it is; an empty table gives an empty result; other columns are ignored by assign() and written by
write_shards(), whose own column shard takes the place of one of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, table

#: Bits of the hash, bytes of a shard at most, and bits by which a cell grows where it is over that.
BITS, MAX_BYTES, STEP = 60, 16 << 20, 10
#: Bytes of a shard at most in the registered query: shards small enough to split at every scale factor.
QUERY_BYTES = 256 << 10
#: Rows of the directory's cells up to which these are sent to all tasks; beyond, the join shuffles.
SMALL = 1 << 17


def key(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def prefix(bits: Column | int) -> Column:
    """The first bits of the column key."""
    return F.call_function("shiftright", F.col("key"), (F.lit(BITS) - F.lit(bits) if isinstance(bits, int) else F.lit(BITS) - bits).cast("int"))


def directory(rows: DataFrame, max_bytes: int) -> list[tuple[int, DataFrame]]:
    """[(bits, (cell, depth, shard, shard_bytes))] for rows (key, bytes): the shard of every cell of so many bits."""
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    bits, known, out = min(BITS, max(0, (total // max_bytes).bit_length() + 4)), 0, []
    while True:
        cells = cut(rows.groupBy(prefix(bits).alias("cell")).agg(F.sum("bytes").alias("bytes")), "cells")
        each = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(known), F.lit(bits))).alias("depth")).withColumn("shard", F.call_function("shiftright", F.col("cell"), (F.lit(bits) - F.col("depth")).cast("int")))
        sums = each.groupBy("depth", "shard").agg(F.sum("bytes").alias("shard_bytes"))
        fits = sums.where((F.col("shard_bytes") <= max_bytes) | (F.col("depth") == BITS))
        best = each.join(fits, ["depth", "shard"]).groupBy("cell").agg(F.min(F.struct("depth", "shard", "shard_bytes")).alias("s")).select("cell", "s.*")
        done = cut(best, "directory")
        out.append((bits, done))
        full = cut(cells.join(done, "cell", "left_anti").select("cell"), "full")
        if bits == BITS or full.isEmpty():
            return out
        rows = rows.withColumn("cell", prefix(bits)).join(full, "cell", "left_semi").drop("cell")
        known, bits = bits + 1, min(BITS, bits + STEP)


def assign(docs: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """doc_id, bytes, depth, shard (bits as text) and shard_bytes for every row of docs (doc_id, text)."""
    rows = docs.select("doc_id", key(F.col("doc_id")).alias("key"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    out = rows
    parts = directory(rows.select("key", "bytes"), max_bytes)
    for i, (bits, cells) in enumerate(parts):
        cells = cells.select(F.col("cell").alias(f"cell{i}"), F.struct("depth", "shard", "shard_bytes").alias(f"s{i}"))
        small = cells.limit(SMALL + 1).count() <= SMALL
        out = out.withColumn(f"cell{i}", prefix(bits)).join(F.broadcast(cells) if small else cells, f"cell{i}", "left")
    s = F.coalesce(*(F.col(f"s{i}") for i in range(len(parts))))
    out = out.withColumn("s", s)
    name = F.when(F.col("s.depth") == 0, F.lit("")).otherwise(F.call_function("lpad", F.bin("s.shard"), F.col("s.depth"), F.lit("0")))
    return out.select("doc_id", "bytes", F.col("s.depth").cast("int").alias("depth"), name.alias("shard"), F.col("s.shard_bytes").alias("shard_bytes"))


def write_shards(docs: DataFrame, path: str, max_bytes: int = MAX_BYTES) -> None:
    """All columns of docs as Parquet, a folder for each shard, in ascending doc_id order within it."""
    docs = docs.drop("shard")
    shards = assign(docs, max_bytes).select("doc_id", "shard").distinct().withColumnRenamed("doc_id", "kinfold_id")
    with_shard = docs.join(shards, F.col("doc_id").eqNullSafe(F.col("kinfold_id"))).drop("kinfold_id")
    with_shard.repartition("shard").sortWithinPartitions("shard", "doc_id").write.partitionBy("shard").parquet(path)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"), QUERY_BYTES)


OP6_SQL = f"""
WITH k AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key, coalesce(strlen(text), 0)::BIGINT AS bytes FROM documents),
s AS (SELECT d, key >> ({BITS} - d) AS shard, sum(bytes)::BIGINT AS shard_bytes FROM k, range({BITS + 1}) AS t(d) GROUP BY ALL),
f AS (SELECT * FROM s WHERE shard_bytes <= {QUERY_BYTES} OR d = {BITS}),
b AS (SELECT doc_id, bytes, min(d) AS depth, arg_min(shard, d) AS shard, arg_min(shard_bytes, d) AS shard_bytes, key FROM k JOIN f ON f.shard = k.key >> ({BITS} - f.d) GROUP BY doc_id, bytes, key)
SELECT doc_id, bytes, depth::INTEGER AS depth, CASE WHEN depth = 0 THEN '' ELSE lpad(ltrim(bin(shard), '0'), depth::INTEGER, '0') END AS shard, shard_bytes FROM b
"""
