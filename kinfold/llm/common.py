"""Helpers that the operators share: tables, the shared folder, Arrow batches, word hashes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import count, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.session import ship, spread, written

#: Texts that an operator holds as Python objects at a time.
SLICE = 400

_local: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a local session (one machine, as in tests) may be without it; it gets a temporary folder.
    """
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="kinfold-"))
        atexit.register(shutil.rmtree, _local[0], True)
    return f"file://{_local[0]}"


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write df into the shared folder and read it back, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, what)
    written(df, path)
    back = spark.read.schema(df.schema).parquet(path)
    back.kinfold_path = path
    return back


def fresh(df: DataFrame, name: str) -> str:
    """name, or with underscores behind it one that df has no column of (in any case)."""
    has = {x.lower() for x in df.columns}
    while name.lower() in has:
        name += "_"
    return name


#: Column with the number of rows that a key of skewed() has.
TIMES = "kinfold_times"


def skewed(rows: DataFrame, keyed: DataFrame, on: list[str], total: int, how: str = "inner", share: int = 1000) -> DataFrame:
    """rows joined (inner or left) with a table of unique keys, with TIMES, whose sum is total at most.

    A key of more than one in share of total rows is hot. There are fewer than share of these; they are sent to all tasks,
    so that rows of a hot key stay where they are. The others are joined by shuffling. keyed is read twice.
    """
    hot = F.col(TIMES) * share > F.lit(total)
    there = F.broadcast(keyed.where(hot).drop(TIMES))
    rest = rows.join(F.broadcast(keyed.where(hot).select(*on)), on, "left_anti").join(keyed.where(~hot).drop(TIMES), on, how)
    return rows.join(there, on).unionByName(rest)


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete what cut() wrote, once nothing reads it any more."""
    for df in frames:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.kinfold_path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: What operators keep between batches of a Python worker, by module: functions that give it up.
_kept: dict[str, Callable[[], None]] = {}
_current: list[str] = []


def keeps(module: str, clear: Callable[[], None]) -> None:
    _kept[module] = clear


def enter(module: str) -> None:
    """A worker serves one operator after the other; what the others have kept goes when a new one begins."""
    if _current and _current[0] != module:
        for name, clear in _kept.items():
            if name != module:
                clear()
        try:
            import ctypes

            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):
            pass
    _current[:] = [module]


def map_texts(df: DataFrame, f: Callable[[pa.RecordBatch, list], dict], schema: T.StructType, text: str = "text", as_bytes: bool = False) -> DataFrame:
    """Apply f to slices of rows in Arrow batches.

    f gets the slice and its texts (str or UTF-8 bytes, null as empty) and returns a column (list or array) for each
    field of schema that the slice itself doesn't have under the same name.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(schema)
        enter(f.__module__)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                part = whole.slice(at, SLICE)
                col = part.column(part.schema.get_field_index(text))
                if as_bytes:
                    col = col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary())
                empty = b"" if as_bytes else ""
                texts = [empty if x is None else x for x in col.to_pylist()]
                got = f(part, texts)
                cols = []
                for field in out:
                    v = got[field.name] if field.name in got else part.column(part.schema.get_field_index(field.name))
                    cols.append(v.cast(field.type) if isinstance(v, pa.Array) else pa.array(v, field.type, from_pandas=False))
                yield pa.RecordBatch.from_arrays(cols, schema=out)

    return df.mapInArrow(run, schema)


#: ASCII A-Z to lower case, everything else as it is.
LOWER = bytes(range(256)).lower()

_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes:
    """64-bit hashes of words, as a numpy array. Keeps what it has seen, up to a number of words."""

    def __init__(self, most: int = 250_000):
        from xxhash import xxh3_64_intdigest

        self.most, self.digest = most, xxh3_64_intdigest
        self.place: dict[bytes, int] = {}
        self.hash = np.zeros(1 << 16, dtype=np.uint64)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.place) > self.most:
            self.place.clear()
        at = np.fromiter(map(self.place.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        new = np.flatnonzero(at < 0)
        if len(new):
            place, digest = self.place, self.digest
            fresh = {w: None for w in map(words.__getitem__, new.tolist())}
            first = len(place)
            while first + len(fresh) > len(self.hash):
                self.hash = np.concatenate((self.hash, np.zeros_like(self.hash)))
            self.hash[first : first + len(fresh)] = list(map(digest, fresh))
            place.update(zip(fresh, count(first), strict=False))
            at[new] = [place[words[i]] for i in new.tolist()]
        return self.hash[at]


def shingle_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, by position; with fewer words, of the whole sequence; none without words."""
    if not len(h):
        return h
    n = min(n, len(h))
    acc = np.full(len(h) - n + 1, np.uint64(n), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            acc = mix(acc * _MIX + h[k : len(h) - n + 1 + k])
    return acc


def map_columns(df: DataFrame, f: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]], schema: T.StructType | str) -> DataFrame:
    """Apply f to the slices of a partition, each a dict of lists; f yields dicts of lists or arrays with schema's fields."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(df.sparkSession)
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(schema)
        enter(f.__module__)

        def slices() -> Iterator[dict[str, list]]:
            for whole in batches:
                for at in range(0, whole.num_rows, SLICE):
                    yield whole.slice(at, SLICE).to_pydict()

        for got in f(slices()):
            yield pa.RecordBatch.from_arrays([got[x.name] if isinstance(got[x.name], pa.Array) else pa.array(got[x.name], x.type) for x in out], schema=out)

    return df.mapInArrow(run, schema)
