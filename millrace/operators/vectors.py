"""Vectors: norms, neighbours within a cosine distance, density clusters and their reports.

With a least density of two points, density clusters are the connected components of the graph of near
pairs. The pairs come from banding by random directions, not from a join of all with all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.graph import connected_components
from millrace.plans.ranges import placed
from millrace.plans.runtime import cut, spread

#: Keeping the chance to miss a pair at the limit below one in ten thousand decides the number of bands; rows made for them at a time.
MISS, SLICE = 1e-4, 1024
#: Signs of random projections kept of a vector, and how many standard deviations below the expectation at the limit their agreement may lie.
BITS, DEVIATIONS = 512, 4.0
#: Rows of a bucket that one task compares with the bucket's others.
SALT_ROWS = 4000
_SIGNS = [f"s{i}" for i in range(BITS // 64)]


def norm(c: str = "embedding"):
    return F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(c: str = "embedding"):
    """The vector at length one, in doubles; a zero vector stays zero."""
    n = norm(c)
    return F.transform(c, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def _collision(cosine: float, directions: int) -> float:
    """How often two vectors of that cosine have the same winner among random directions, by simulation with a fixed seed."""
    r = np.random.default_rng(11)
    x, z = r.standard_normal((20_000, directions)), r.standard_normal((20_000, directions))
    y = cosine * x + np.sqrt(max(0.0, 1 - cosine * cosine)) * z
    a, b = np.abs(x).argmax(1), np.abs(y).argmax(1)
    at = np.arange(len(x))
    return float(((a == b) & (np.sign(x[at, a]) == np.sign(y[at, b]))).mean())


def near_pairs(df: DataFrame, key: str, c: str, eps: float, directions: int = 64, seed: int = 5) -> DataFrame:
    """(src, dst, distance): pairs with src < dst whose cosine distance is at most eps, exact for each pair found.

    Each vector goes to one bucket a band, named by the random direction it lies nearest to; only rows of
    a bucket are compared, first by the signs of random projections, then, each pair once, exactly. The bands are as many as leave a pair
    at the limit undetected less than once in ten thousand; the signs lose three in a hundred thousand. A bucket of many rows is dealt to
    several tasks. Zero, null and empty vectors have no pairs; repeated vectors are pairs at distance 0. Larger
    thresholds need more bands, without an upper limit; from 1 on, where nearness is no more than chance, the call is refused.
    """
    if not 0 <= eps < 1:
        raise ValueError("the cosine distance must be at least 0 and below 1")
    p = _collision(1 - eps, directions)
    bands = max(1, int(np.ceil(np.log(MISS) / np.log(max(1e-9, 1 - p))))) if p < 1 else 1
    agree = 1 - np.arccos(np.clip(1 - eps, -1, 1)) / np.pi
    least = int(np.floor(BITS * agree - DEVIATIONS * np.sqrt(BITS * agree * (1 - agree))))
    rows = df.select(F.col(key).alias("id"), unit(c).alias("v")).where(F.size("v") > 0).where(F.exists("v", lambda x: x != 0))
    schema = T.StructType([rows.schema["id"], T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("keys", T.ArrayType(T.IntegerType())), *(T.StructField(s, T.LongType()) for s in _SIGNS)])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):
                b = whole.slice(lo, SLICE)
                sizes = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
                for size in np.unique(sizes):
                    at = pa.array(np.flatnonzero(sizes == size))
                    x = np.asarray(b.column(1).take(at).flatten()).reshape(len(at), -1)
                    r = np.random.default_rng(seed)
                    signs = np.packbits(x @ r.standard_normal((int(size), BITS)) > 0, axis=1).view(np.int64)
                    keys = np.empty((len(at), bands), dtype=np.int32)
                    for band in range(bands):
                        proj = x @ r.standard_normal((int(size), directions))
                        best = np.abs(proj).argmax(1)
                        keys[:, band] = (band * directions + best) * 2 + (proj[np.arange(len(at)), best] > 0)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.ravel()))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), lists, *(pa.array(np.ascontiguousarray(signs[:, i])) for i in range(len(_SIGNS)))], names=[f.name for f in schema.fields])

    signed = cut(spread(rows).mapInArrow(keyed, schema), "signed")
    held = signed.select("id", *_SIGNS, F.explode("keys").alias("k"))
    salts = held.groupBy("k").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts")).where("salts > 1")
    held = held.join(salts, "k", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    a = held.select(F.col("id").alias("src"), "k", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), *[F.col(s).alias(f"a{s}") for s in _SIGNS])
    b = held.select(F.col("id").alias("dst"), "k", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), *_SIGNS)
    differing = sum((F.bit_count(F.col(s).bitwiseXOR(F.col(f"a{s}"))) for s in _SIGNS[1:]), F.bit_count(F.col(_SIGNS[0]).bitwiseXOR(F.col(f"a{_SIGNS[0]}"))))
    met = a.join(b, ["k", "salt"]).where(F.col("src") < F.col("dst")).where(differing <= BITS - least).select("src", "dst").distinct()
    full = met.join(signed.select(F.col("id").alias("src"), F.col("v").alias("va")), "src").join(signed.select(F.col("id").alias("dst"), F.col("v").alias("vb")), "dst").where(F.size("va") == F.size("vb"))
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return full.select("src", "dst", (F.lit(1.0) - dot).alias("distance")).where(F.col("distance") <= eps)


def _winners(cosine: float, rows: int, directions: int) -> tuple[int, int]:
    """(winners a key, bands) that miss a pair at the limit less than MISS and make the fewest keys and meetings of that many rows; a key costs as much as five meetings."""
    p = _collision(cosine, directions)
    found = []
    for width in range(1, 5):
        bands = 1 if p >= 1 else int(np.ceil(np.log(MISS) / np.log(max(1e-9, 1 - p**width))))
        found.append((bands * (5 * rows + rows * rows / 2 / (2 * directions) ** width), width, max(1, bands)))
    return min(found)[1:]


def signatures(df: DataFrame, key: str, c: str, cosine: float, rows: int, directions: int = 32, seed: int = 6) -> DataFrame:
    """(key, keys, s0, ...) of each vector that isn't null, empty or zero: a key a band, made of the winners of one or more blocks of random directions, and the signs of random projections.

    Two vectors at that cosine or nearer have no key in common less than once in ten thousand. rows: about how many vectors there are.
    """
    width, bands = _winners(cosine, rows, directions)
    named = df.select(F.col(key), F.col(c).cast("array<double>").alias("v")).where(F.size("v") > 0).where(F.exists("v", lambda x: x != 0))
    schema = T.StructType([named.schema[key], T.StructField("keys", T.ArrayType(T.LongType())), *(T.StructField(s, T.LongType()) for s in _SIGNS)])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = {}
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):
                b = whole.slice(lo, SLICE)
                sizes = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
                for size in np.unique(sizes):
                    at = pa.array(np.flatnonzero(sizes == size))
                    x = np.asarray(b.column(1).take(at).flatten()).reshape(len(at), -1)
                    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
                    if size not in made:
                        r = np.random.default_rng(seed)
                        made = {size: (r.standard_normal((int(size), BITS), dtype=np.float32), r.standard_normal((bands, int(size), width * directions), dtype=np.float32))}
                    planes, blocks = made[size]
                    signs = np.packbits(x @ planes > 0, axis=1).view(np.int64)
                    keys = np.empty((len(at), bands), dtype=np.int64)
                    for band in range(bands):
                        p = (x @ blocks[band]).reshape(len(at), width, directions)
                        best = np.abs(p).argmax(2)
                        won = best * 2 + (np.take_along_axis(p, best[:, :, None], 2)[:, :, 0] > 0)
                        keys[:, band] = band
                        for k in range(width):
                            keys[:, band] = keys[:, band] * 2 * directions + won[:, k]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.ravel()))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), lists, *(pa.array(np.ascontiguousarray(signs[:, i])) for i in range(len(_SIGNS)))], names=[f.name for f in schema.fields])

    return spread(named).mapInArrow(keyed, schema)


def met(left: DataFrame, right: DataFrame, key: str, cosine: float, on) -> DataFrame:
    """(src, dst, equal): pairs of a row of left and one of right with a key in common that the signs let pass; on: a further condition. Rows: columns of `signatures` and any others, of left with l_, of right with r_ before the name."""
    agree = 1 - np.arccos(np.clip(cosine, -1, 1)) / np.pi
    least = int(np.floor(BITS * agree - DEVIATIONS * np.sqrt(BITS * agree * (1 - agree))))
    side = lambda df, x: df.select(F.explode("keys").alias("k"), *[F.col(c).alias(f"{x}_{c}") for c in df.columns if c != "keys"])
    equal = F.lit(BITS) - sum((F.bit_count(F.col(f"l_{s}").bitwiseXOR(F.col(f"r_{s}"))) for s in _SIGNS[1:]), F.bit_count(F.col(f"l_{_SIGNS[0]}").bitwiseXOR(F.col(f"r_{_SIGNS[0]}"))))
    pairs = side(left, "l").join(side(right, "r"), "k").where(on).select(F.col(f"l_{key}").alias("src"), F.col(f"r_{key}").alias("dst"), equal.alias("equal"))
    return pairs.where(F.col("equal") >= least).distinct()


def confirmed(pairs: DataFrame, rows: DataFrame, key: str, c: str, cosine: float) -> DataFrame:
    """The pairs (src, dst) whose vectors have one length and a cosine of at least `cosine`, in doubles."""
    full = pairs.select("src", "dst").join(rows.select(F.col(key).alias("src"), F.col(c).alias("va")), "src").join(rows.select(F.col(key).alias("dst"), F.col(c).alias("vb")), "dst").where(F.size("va") == F.size("vb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):
                b = whole.slice(lo, SLICE)
                sizes = b.column(2).value_lengths().to_numpy(zero_copy_only=False)
                for size in np.unique(sizes):
                    at = pa.array(np.flatnonzero(sizes == size))
                    x, y = (np.asarray(b.column(i).take(at).flatten()).astype(np.float64).reshape(len(at), -1) for i in (2, 3))
                    ok = pa.array(np.flatnonzero((x * y).sum(1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)) >= cosine - 1e-12))
                    yield pa.RecordBatch.from_arrays([b.column(i).take(at).take(ok) for i in (0, 1)], names=["src", "dst"])

    full = full.select("src", "dst", "va", "vb")
    return full.mapInArrow(run, full.select("src", "dst").schema)


def density_clusters(df: DataFrame, key: str, c: str, eps: float, least: int = 2) -> DataFrame:
    """(id, label) of every vector: the rank of its component by least id among components of at least `least`, else -1.

    Exact copies of a vector are one in the search for pairs, so that a group of them gives no pairs.
    """
    same = df.where(F.exists(c, lambda x: x != 0)).select(F.col(key).alias("id"), F.col(c).alias("v"))
    firsts = same.groupBy("v").agg(F.min("id").alias("src"))
    copies = same.join(firsts, "v").where("id <> src").select("src", F.col("id").alias("dst"))
    pairs = cut(near_pairs(firsts, "src", "v", eps).select("src", "dst").union(copies), "pairs")
    parts = connected_components(pairs)
    sizes = parts.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    ranked = placed(sizes, [], ["component"], "label")
    named = parts.join(ranked, "component").select(F.col("node").alias("id"), "label")
    return df.select(F.col(key).alias("id")).join(named, "id", "left").select("id", F.coalesce("label", F.lit(-1)).alias("label"))


def cluster_summary(labels: DataFrame, members: DataFrame, key: str, image: str, score: str, least: int = 3) -> DataFrame:
    """Name person_NNN, distinct images, members and mean score of each cluster of at least `least` members; noise is left out."""
    rows = labels.where("label >= 0").join(members.withColumnRenamed(key, "id"), "id")
    out = rows.groupBy("label").agg(F.countDistinct(image).alias("n_images"), F.count("*").alias("n_faces"), F.round(F.avg(score), 6).alias("avg_score"))
    return out.where(F.col("n_faces") >= least).select(F.format_string("person_%03d", F.col("label")).alias("cluster"), "n_images", "n_faces", "avg_score")


def cluster_preview(labels: DataFrame, samples: int = 3) -> DataFrame:
    """Each cluster's size and its first members, greatest clusters first."""
    rows = labels.where("label >= 0")
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("id"))).where(F.col("r") <= samples)  # limited before the shuffle
    named = first.groupBy("label").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("samples"))
    return rows.groupBy("label").agg(F.count("*").alias("n")).join(named, "label").orderBy(F.col("n").desc(), "label")


def cluster_stats(labels: DataFrame) -> DataFrame:
    """One row: clusters, clustered members, greatest cluster (null where there is none), noise."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    real = F.col("label") >= 0
    return sizes.agg(F.count_if(real).alias("n_clusters"), F.coalesce(F.sum(F.when(real, F.col("n"))), F.lit(0)).alias("n_members"), F.max(F.when(real, F.col("n"))).alias("max_size"), F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0)).alias("n_noise"))


def apply_labels(clusters: DataFrame, labels: DataFrame, key: str, name: str):
    """clusters with the label's name, or the key itself where there is none."""
    return clusters.join(labels.select(key, name), key, "left").withColumn(name, F.coalesce(F.col(name), F.col(key).cast("string")))


def vault_stats(images: DataFrame) -> DataFrame:
    """One row over image records (faces, error): images, faces, errors, mean faces an image."""
    n = F.coalesce(F.size("faces"), F.lit(0))
    return images.agg(F.count("*").alias("n_images"), F.sum(F.greatest(n, F.lit(0))).alias("n_faces"), F.count_if(F.col("error").isNotNull()).alias("n_errors"), F.round(F.avg(F.greatest(n, F.lit(0))), 6).alias("avg_faces"))
