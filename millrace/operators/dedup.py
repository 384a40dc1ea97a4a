"""Duplicates: exact groups, keepers by quality, greedy removal of near ones, reports."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.vectors import confirmed, met, signatures
from millrace.plans.ranges import placed
from millrace.plans.runtime import cut, discard

#: Rows of the first stretch of a greedy pass, and how many times as long as the one before each next one is.
STRETCH, GROWTH = 1024, 4


def content_hash(c: str):
    """MD5 of a text or of bytes."""
    return F.md5(F.col(c).cast("binary"))


def hamming(a, b):
    """Differing bits of two 64-bit hashes."""
    return F.bit_count(a.bitwiseXOR(b))


def face_quality(blur: str = "blur_score", score: str = "det_score", area: str = "face_area"):
    """Sharpness, detection and area weighed 4 : 3 : 3."""
    return F.col(blur) * F.lit(0.4) + F.col(score) * F.lit(100.0) * F.lit(0.3) + F.col(area) * F.lit(0.3)


def exact_groups(df: DataFrame, key: str, digest: str, quality: str) -> DataFrame:
    """key, digest, group_size and rank within the rows of equal digest: best quality first, ties by key. Null digests are no group."""
    rows = placed(df.where(F.col(digest).isNotNull()).select(key, digest, F.col(quality).alias("__q")), [digest], [F.col("__q").desc(), F.col(key)], "__i", total="group_size")
    return rows.select(key, digest, "group_size", (F.col("__i") + 1).alias("rank"))


def maximal_independent(nodes: DataFrame, edges: DataFrame, key: str, order: str) -> DataFrame:
    """The keys that a greedy pass in `order` keeps: one is kept unless a kept one before it is its neighbour.

    nodes: key and order (unique, ascending); edges: src, dst in any direction. A node is decided as soon as
    all its neighbours before it are dropped, or one of them is kept, so the rounds are as many as the
    longest chain of undecided neighbours; each round is cut to a table.
    """
    rank = nodes.select(F.col(key).alias("k"), F.col(order).alias("o"))
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    before = both.join(rank.select(F.col("k").alias("src"), F.col("o").alias("so")), "src").join(rank.select(F.col("k").alias("dst"), F.col("o").alias("do")), "dst").where("do < so").select("src", "dst").distinct()
    before = cut(before, "before")
    state = cut(rank.select("k", F.lit(None).cast("boolean").alias("kept")), "state")
    while True:
        seen = before.join(state.select(F.col("k").alias("dst"), F.col("kept").alias("dk")), "dst").groupBy("src").agg(F.max(F.coalesce(F.col("dk"), F.lit(False))).alias("hit"), F.count_if(F.col("dk").isNull()).alias("open"))
        now = state.join(seen.withColumnRenamed("src", "k"), "k", "left")
        decided = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("hit"), False).when(F.coalesce("open", F.lit(0)) == 0, True)
        state = cut(now.select("k", decided.alias("kept")), "state")
        if state.where("kept is null").isEmpty():
            break
    return state.where("kept").select(F.col("k").alias(key))


def near_duplicates(rows: DataFrame, pairs: DataFrame, key: str, order: str) -> DataFrame:
    """key and kept of every row, for near pairs (src, dst): the earlier of two near rows in `order` is kept."""
    kept = maximal_independent(rows, pairs, key, order)
    return rows.select(key).join(kept.withColumn("kept", F.lit(True)), key, "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def piece_masks(varying: int, most: int, agree: int) -> list[int]:
    """The bits of each choice of `agree` of most + agree pieces, into which the bits of `varying` are cut."""
    bits = [i for i in range(64) if varying >> i & 1]
    n = most + agree
    edges = [round(len(bits) * i / n) for i in range(n + 1)]
    pieces = [sum(1 << i for i in bits[a:b]) for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(pieces, agree)]


def hash_pairs(rows: DataFrame, key: str, c: str, most: int = 5, agree: int = 3, others: DataFrame | None = None) -> DataFrame:
    """(src, dst, bits): pairs src < dst of rows whose 64-bit hashes differ in at most `most` bits, none missed; with others: all such pairs of a row and one of others.

    The bits in which any two hashes differ (one number, taken first) are cut into most + agree pieces; two hashes within
    `most` bits have at least `agree` pieces in common, so each choice of that many pieces is a key and only rows with an equal key
    are compared. Bits that are the same in all hashes are in no piece, as a key of them would be every row's. More agreeing
    pieces make rarer keys. Equal hashes give their pairs too; call it on distinct ones where a hash may be frequent. Null hashes have no pairs.
    """
    hashed = rows.where(F.col(c).isNotNull()).select(F.col(key).alias("id"), F.col(c).alias("h"))
    right = hashed if others is None else others.where(F.col(c).isNotNull()).select(F.col(key).alias("id"), F.col(c).alias("h"))
    varying = hashed.union(right).agg(F.bit_or("h").bitwiseXOR(F.bit_and("h"))).first()[0] or 0
    masks = piece_masks(varying, most, agree)
    keys = [F.xxhash64(F.lit(k), F.col("h").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long"))) for k, m in enumerate(masks)]
    one, other = (x.select("id", "h", F.explode(F.array(*keys)).alias("k")) for x in (hashed, right))
    both = one.alias("a").join(other.alias("b"), (F.col("a.k") == F.col("b.k")) & (F.col("a.id") < F.col("b.id") if others is None else F.lit(True)))
    bits = hamming(F.col("a.h"), F.col("b.h"))
    return both.where(bits <= most).select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"), bits.alias("bits")).distinct()


def _kept_of(here: DataFrame, vecs: DataFrame, most: int, least_dot: float) -> DataFrame:
    """The rows (o) of a stretch (o, h and signatures) that a pass over it alone keeps.

    Of the images of one hash only the first and those near by vector to one without are compared further.
    """
    bare = F.col("l_h").isNull() | F.col("r_h").isNull()
    mixed = cut(confirmed(cut(met(here, here, "o", least_dot, bare & (F.col("l_o") < F.col("r_o"))), "met"), vecs, "o", "v", least_dot), "mixed")
    touched = mixed.select(F.col("src").alias("o")).union(mixed.select("dst")).distinct().withColumn("touched", F.lit(True))
    hashed = here.where("h is not null").select("o", "h").join(touched, "o", "left")
    # Of the images with one hash and without a vector's neighbour only the first can be kept; the others have no neighbour that it lacks.
    firsts = hashed.where("touched is null").groupBy("h").agg(F.min("o").alias("o")).select("o", "h")
    active = cut(firsts.union(hashed.where("touched").select("o", "h")), "active")
    near_hashes = hash_pairs(active.select("h").distinct(), "h", "h", most).select("src", "dst")
    one, other = (active.select(F.col("o").alias(c), F.col("h").alias(f"h_{c}")) for c in ("x", "y"))
    across = near_hashes.join(one, F.col("src") == F.col("h_x")).join(other, F.col("dst") == F.col("h_y")).select(F.col("x").alias("src"), F.col("y").alias("dst"))
    within = one.join(other, (F.col("h_x") == F.col("h_y")) & (F.col("x") < F.col("y"))).select(F.col("x").alias("src"), F.col("y").alias("dst"))
    return maximal_independent(active.select("o").union(here.where("h is null").select("o")), across.union(within).union(mixed), "o", "o")


def _near_to(kept: DataFrame, rest: DataFrame, vecs: DataFrame, most: int, least_dot: float) -> DataFrame:
    """The rows (o) of the rest that are near to a kept one. By vector the likeliest kept one is tried first, the others only where it isn't near."""
    hashes = hash_pairs(kept.where("h is not null").select("h"), "h", "h", most, others=rest.select("h").distinct()).select(F.col("dst").alias("h")).distinct()
    by_hash = cut(rest.select("o", "h").join(hashes, "h", "left_semi").select("o"), "near")
    open_ = rest.join(by_hash, "o", "left_anti")
    pairs = cut(met(kept, open_, "o", least_dot, F.col("l_h").isNull() | F.col("r_h").isNull()), "met")
    best = pairs.groupBy("dst").agg(F.max_by("src", F.struct("equal", -F.col("src"))).alias("src")).select("src", "dst")
    first = cut(confirmed(best, vecs, "o", "v", least_dot), "near")
    others = pairs.join(first.select("dst"), "dst", "left_anti").select("src", "dst").join(best, ["src", "dst"], "left_anti")
    return by_hash.union(first.select(F.col("dst").alias("o"))).union(confirmed(others, vecs, "o", "v", least_dot).select("dst")).distinct()


def image_duplicates(rows: DataFrame, key: str, digest: str, phash: str, vector: str, quality: str, most: int = 5, least_dot: float = 0.98) -> DataFrame:
    """(key, status, of) of every image: exact, near or kept.

    Exact: in a group of equal digests, but for its best, whose key is `of`. The whole group, its best too (kept), leaves the
    search for near ones. Those left are gone through by quality, best first, ties by key: one is near if a kept one before
    it has a perceptual hash within `most` bits or, where one of the two has no hash, a cosine of at least `least_dot`.
    The pass goes in stretches, each longer than the one before: what a kept image of a stretch is near to leaves the rest before its own pairs are
    looked for, so that many alike images give few pairs. Null digests are no group; images without hash and vector have no near ones. Null qualities come last.
    """
    groups = exact_groups(rows, key, digest, quality).where("group_size > 1")
    best = groups.where("rank = 1").select(digest, F.col(key).alias("of"))
    exact = groups.join(best, digest).select(key, F.when(F.col("rank") > 1, "exact").otherwise("kept").alias("status"), F.when(F.col("rank") > 1, F.col("of")).alias("of"))
    left = rows.join(groups.select(key), key, "left_anti").select(F.col(key).alias("id"), F.col(phash).alias("h"), F.col(vector).alias("v"), F.col(quality).alias("q"))
    left = cut(placed(left, [], [F.col("q").desc_nulls_last(), F.col("id")], "o"), "images")
    n = left.count()
    vecs = left.where("v is not null").select("o", "v")
    alive = cut(left.select("o", "h").join(signatures(vecs, "o", "v", least_dot, n), "o", "left"), "alive")
    kept, lo, hi = left.select("o").limit(0), 0, STRETCH
    while lo < n:
        here = alive.where(F.col("o") < hi)
        now = cut(alive.join(_kept_of(here, vecs, most, least_dot), "o", "left_semi"), "kept")
        kept = kept.union(now.select("o"))
        rest = cut(alive.where(F.col("o") >= hi).join(_near_to(now, alive.where(F.col("o") >= hi), vecs, most, least_dot), "o", "left_anti"), "alive")
        discard(alive)
        alive, lo, hi = rest, hi, hi + (hi - lo) * GROWTH
    near = left.select(F.col("id").alias(key), "o").join(kept.withColumn("k", F.lit(True)), "o", "left").select(key, F.when(F.col("k"), "kept").otherwise("near").alias("status"), F.lit(None).cast(rows.schema[key].dataType).alias("of"))
    return exact.union(near)


def removal_report(groups: DataFrame, cluster: str) -> DataFrame:
    """Members before, removed and after, of each cluster with two or more. groups: cluster and kept."""
    out = groups.groupBy(cluster).agg(F.count("*").alias("n_before"), F.count_if(~F.col("kept")).alias("n_removed"))
    return out.where("n_before >= 2").withColumn("n_after", F.col("n_before") - F.col("n_removed"))
