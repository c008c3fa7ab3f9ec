"""Records that arrive as a stream: normal forms, keys, and candidates from a table of usable keys.

All steps are stateless, so the stream needs no watermark; the candidates' side is a table that a batch run has written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import blocking, normalize

SCHEMA = T.StructType([T.StructField("src", T.ByteType()), *(T.StructField(n, T.StringType()) for n in ("entity_id", "name", "addr", "country"))])


def read_stream(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """Records of JSON files as they arrive in a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).json(folder)


def candidate_keys(records: DataFrame, scale: float = 1.0) -> DataFrame:
    """(country, kt, key, w, cand_id, src): usable keys of known records in normal form, each with its candidates."""
    k = blocking.keys(records).where("src <> 1")
    return k.join(blocking.usable_keys(k, records, blocking.caps(scale)), ["country", "kt", "key"]).select("country", "kt", "key", "w", F.col("entity_id").alias("cand_id"), "src")


def matched(batch: DataFrame, known: DataFrame, depth: int = 25) -> DataFrame:
    """The best candidates of one batch of arriving records of source 1."""
    k = blocking.keys(normalize.normalized(batch.where("src = 1"), native=False)).select(F.col("entity_id").alias("s1_id"), "country", "kt", "key")
    pairs = k.join(known, ["country", "kt", "key"]).select("s1_id", "cand_id", "src", "kt", "key", "w")
    return blocking.top(blocking.scored(pairs), "bscore", depth)


def start(stream: DataFrame, known: DataFrame, out: str, checkpoint: str, depth: int = 25) -> StreamingQuery:
    """Write the candidates of each batch under its number, so that a repeated batch replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        matched(batch, known, depth).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
