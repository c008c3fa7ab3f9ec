"""Sessions, and what executors need to run this package's Python functions."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()
#: Rows of an Arrow batch, unless the session has its own setting.
ROWS = "1500"


def session(app: str = "kinfold", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; conf overrides (dots as double underscores)."""
    b = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Bound Arrow batches, and send this package to the executors unless their path has it already (once an application)."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        # Rows of whole texts: the usual batch of 10,000 would hold tens of megabytes on either side of each worker.
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    roots = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(PACKAGE.parent) in roots:
        return
    path = Path(tempfile.mkdtemp()) / f"{PACKAGE.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    spark.sparkContext.addPyFile(str(path))


#: Bytes of a table that one task may have to read alone (a row group of a Parquet file), and bytes that are worth dealing out.
GROUP, WORTH = 128 << 20, 1 << 20


def spread(df: DataFrame) -> DataFrame:
    """df, its rows dealt out to all cores if its files are so few and small that most cores would have none."""
    spark = df.sparkSession
    files = df.inputFiles()
    cores = spark.sparkContext.defaultParallelism
    if not files or len(files) >= cores:
        return df
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    size = sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in map(path, files))
    return df.repartition(cores) if size > WORTH and len(files) + size // GROUP < cores else df


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df by key in as many partitions as a shuffle has. Rows of few bytes that much work is done on would otherwise be put
    together into one task; a join by the same key that shuffles finds them in place."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


#: Spark deletes a write's shuffle files as soon as it has ended, not when the driver happens to collect its garbage.
CLEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def written(df: DataFrame, path: str, conf: dict[str, str] | None = None) -> None:
    """Write df; conf: settings of the session meanwhile. Its shuffle files go with the end of the write."""
    spark, conf = df.sparkSession, CLEAN | (conf or {})
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, conf: dict[str, str] | None = None) -> DataFrame:
    """df written into the folder of spark.checkpoint.dir and read back: later steps neither repeat nor plan it again.

    conf: settings of the session while it is planned and written.

    A local session (one machine, as in tests) may be without that setting; it gets a temporary folder.
    """
    path = fresh(df.sparkSession)
    written(df, path, conf)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_parts(parts: list[Callable[[], DataFrame]], conf: dict[str, str] | None = None) -> DataFrame:
    """The rows of all parts, each made and written on its own, one after another, as stored() does."""
    paths = []
    for make in parts:
        df = make()
        paths.append(fresh(df.sparkSession))
        written(df, paths[-1], conf)
    return df.sparkSession.read.schema(df.schema).parquet(*paths)


def fresh(spark: SparkSession) -> str:
    """A path in the folder of spark.checkpoint.dir that nothing is at."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="kinfold-")
        atexit.register(shutil.rmtree, folder, True)
    return f"{folder.rstrip('/')}/stored-{uuid.uuid4().hex}"
