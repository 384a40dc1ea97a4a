"""Session settings, table loading and lineage cuts shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_SHIPPED: set[str] = set()
_FOLDERS: set[str] = set()
#: The folders of cut tables.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> SparkSession:
    """Gives the session's Python workers this package, once an application.

    The archive lies in the shared folder where that is a path, and is served by the driver like any
    py-file, so that a cluster needs no install.
    """
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent.parent
        folder = shared_dir(spark).removeprefix("file://")
        if folder.startswith("/"):
            folder = _tables(spark).removeprefix("file://")
            os.makedirs(folder, exist_ok=True)
        else:
            folder = None
        handle, name = tempfile.mkstemp(prefix="millrace-", suffix=".zip", dir=folder)
        os.close(handle)
        with zipfile.ZipFile(name, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(name)
        _SHIPPED.add(app)
    return spark


def session(app: str = "millrace", cores: str = "*", partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A local session with the settings that the operators are tested under."""
    return ship(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset (tests), one of our own.

    On a cluster the setting names storage that every executor reaches. A machine-local
    folder is used only under a local master.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def _tables(spark: SparkSession) -> str:
    """The application's own folder for cut tables, removed when its JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/millrace-tables/{spark.sparkContext.applicationId}"
    if path not in _FOLDERS:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _FOLDERS.add(path)
    return path


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """df written as a table in the shared folder and read again.

    Cuts the lineage: a lost executor costs a re-read, not the whole history. Unlike
    an RDD checkpoint the table is columnar and compressed, and later stages prune it. The
    shuffle files behind it are removed as soon as it is written, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{_tables(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables made by `cut`, which nothing reads any more; what isn't such a table is left."""
    for df in tables:
        if path := _PATHS.pop(df, None):
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut_counted(df: DataFrame, name: str = "step") -> tuple[DataFrame, tuple]:
    """cut, and the number of rows with a combined hash of them, both taken while the table is written."""
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    marked = df.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*df.columns)).alias("h"))
    out = cut(marked, name)
    return out, (seen.get["n"], seen.get["h"])


def partitions(spark: SparkSession) -> int:
    """How many partitions a shuffle of the session makes."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def width(spark: SparkSession) -> int:
    """The partitions for a step that costs far more CPU than its input has bytes."""
    return max(partitions(spark), spark.sparkContext.defaultParallelism)


def spread(scan: DataFrame) -> DataFrame:
    """A scan over enough partitions to keep every core busy.

    Small tables come as one or two splits. A large one has splits enough and is left as it is,
    without a shuffle. For scans only: to count partitions behind a shuffle would run it.
    """
    n = width(scan.sparkSession)
    return scan if scan.rdd.getNumPartitions() >= n else scan.repartition(n)


#: A key with more than one in HOT of all rows is hot; there are less than HOT of them.
HOT = 1000


def hot_join(big: DataFrame, small: DataFrame, on: list[str], rows: str, total: int) -> DataFrame:
    """big inner joined with small on `on`, where one key may hold a third of big's rows.

    rows: a column of small with the number of big's rows of the key; total: all of big's rows. The hot keys' rows of small are
    broadcast: less than HOT keys, with the few rows that small has of a key. No other key has more than one in HOT of the
    rows, so the rest is shuffled. The column `rows` is left out of the result.
    """
    hot = F.broadcast(small.where(F.col(rows) * HOT > total))
    rest = small.where(~(F.col(rows) * HOT > total))
    few = big.join(hot, on)
    return few.unionByName(big.join(hot.select(*on), on, "left_anti").join(rest, on)).drop(rows)


def once(df: DataFrame, *keys: str) -> DataFrame:
    """One row for each key: rows delivered again are dropped. A null key is a key like any other."""
    return df.repartition(width(df.sparkSession), *keys).dropDuplicates(list(keys))
