from __future__ import annotations

import json

from pyspark.sql import functions as F

from kinfold.operators import blocking, normalize
from kinfold.streaming import records as R


def test_stream_gives_what_a_batch_gives(spark, tmp_path):
    rows = [(2, f"S2-{i}", f"acme{i} widgets", f"{i + 10} oak street", "US") for i in range(20)] + [(1, f"S1-{i}", f"acme{i} widgets", f"{i + 10} oak st", "US") for i in range(5)]
    records = normalize.normalized(spark.createDataFrame(rows, R.SCHEMA), native=False)
    (tmp_path / "in").mkdir()
    for i in range(5):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps(dict(zip(R.SCHEMA.fieldNames(), rows[20 + i], strict=True))) + "\n")
    known = R.candidate_keys(records)
    R.start(R.read_stream(spark, str(tmp_path / "in"), 2), known, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("s1_id", "cand_id", F.col("bscore")).collect()))
    want = sorted(map(tuple, blocking.top(blocking.block(records), "bscore", 25).select("s1_id", "cand_id", "bscore").collect()))
    assert got == want and len({x[0] for x in got}) == 5
