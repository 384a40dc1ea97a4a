"""Streams over growing folders: last value by key, and work not done yet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from millrace.sources.files import latest

#: Parts of a merged store; a batch rewrites only those that it touches.
BUCKETS = 64


def stream(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet", files_a_trigger: int = 16, names: str = "*") -> DataFrame:
    """The files of a folder, and those that come later; names: a pattern of the files' names."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_a_trigger).option("pathGlobFilter", names).load(path)


def latest_by_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key so far: state of one row a key."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")


def _versions(spark: SparkSession, store: str, before: int | None = None) -> tuple[dict[int, str], list]:
    """The newest folder of each bucket, of batches before `before`, and the folders that these have replaced. At most BUCKETS a batch, most of them removed."""
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/*/bucket=*")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
    newest: dict[int, tuple[int, object]] = {}
    old = []
    for p in sorted((f.getPath() for f in found), key=lambda p: int(p.getParent().getName())):
        n, bucket = int(p.getParent().getName()), int(p.getName().partition("=")[2])
        if before is None or n < before:
            if bucket in newest:
                old.append(newest[bucket][1])
            newest[bucket] = (n, p)
    return {k: p.toString() for k, (_, p) in newest.items()}, old


def current(spark: SparkSession, store: str, schema: T.StructType) -> DataFrame:
    """The last row of each key that a store of `merge_into` holds."""
    paths = list(_versions(spark, store)[0].values())
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def merge_into(rows: DataFrame, store: str, key: str, order: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Keeps a folder of the last row of each key; a batch that is run again changes nothing.

    The store is dealt to BUCKETS by a hash of the key. A batch reads and rewrites only the buckets that its keys are in, as a new
    version in a folder of the batch's number; versions that the batch before had replaced already are removed.
    """

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
        batch.persist()
        touched = [r[0] for r in batch.where(F.col(key).isNotNull()).select(bucket.alias("b")).distinct().collect()]  # at most BUCKETS
        held, old = _versions(spark, store, n)
        new = latest(batch, key, order)
        if paths := [held[b] for b in touched if b in held]:
            new = latest(new.unionByName(spark.read.schema(batch.schema).parquet(*paths)), key, order)
        new.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/{n}")
        batch.unpersist()
        for p in old:
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    return rows.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_counts(rows: DataFrame, ts: str, kind: str, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by time window and kind, with rows up to `late` behind."""
    return rows.withWatermark(ts, late).groupBy(F.window(ts, length), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def windows_into(rows: DataFrame, store: str, ts: str, kind: str, checkpoint: str, length: str = "1 hour", late: str = "2 hours") -> StreamingQuery:
    """Keeps a store of `window_counts` over a stream, keyed by window and kind; rows later than `late` are dropped, and their windows' state with them."""
    counts = window_counts(rows, ts, kind, length, late)
    return merge_into(counts.select(F.to_json(F.struct("start", kind), {"ignoreNullFields": "false"}).alias("key"), "start", kind, "n"), store, "key", "n", checkpoint, "update")
