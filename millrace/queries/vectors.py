"""Vectors, faces and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import dedup, vectors
from millrace.operators.images import largest_face
from millrace.operators.nested import flatten_list
from millrace.plans.runtime import table
from millrace.queries import base as b
from millrace.sources.files import latest, unseen

EPS = 0.6


def _emb(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "embedding")


def _members(spark, d):
    return _emb(spark, d).select("vec_id", (F.col("vec_id") % 40).alias("image"), F.abs(F.col("embedding")[0].cast("double")).alias("score"))


def images(spark, d):
    """The last row of each image of the face log."""
    return latest(table(spark, d, "face_cache"), "image_path", "log_id")


def _faces(spark, d):
    return flatten_list(images(spark, d), ["image_path"], "faces", fields=["det_score", "size", "blur_score", "brightness", "face_area", "bbox", "embedding"])


def vector_norms(spark, d):
    return _emb(spark, d).select("vec_id", F.round(vectors.norm(), 6).alias("norm"), F.size(vectors.unit()).alias("dims"))


def vector_neighbors(spark, d):
    return vectors.near_pairs(_emb(spark, d), "vec_id", "embedding", EPS).select("src", "dst", F.round("distance", 6).alias("distance"))


def _labels(spark, d):
    return vectors.density_clusters(_emb(spark, d), "vec_id", "embedding", EPS)


def dbscan_clusters(spark, d):
    return _labels(spark, d).select("id", F.col("label").cast("long").alias("label"))


def cluster_summary(spark, d):
    return vectors.cluster_summary(_labels(spark, d), _members(spark, d), "vec_id", "image", "score")


def cluster_preview(spark, d):
    return vectors.cluster_preview(_labels(spark, d))


def cluster_stats(spark, d):
    return vectors.cluster_stats(_labels(spark, d))


def labels_join(spark, d):
    clusters = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return vectors.apply_labels(clusters, table(spark, d, "nation"), "n_nationkey", "n_name")


def vault_stats(spark, d):
    return vectors.vault_stats(images(spark, d))


def face_rows(spark, d):
    return _faces(spark, d).where("embedding is not null").select("image_path", "position", F.round("det_score", 6).alias("det_score"))


def detection_filter(spark, d):
    return _faces(spark, d).where("det_score >= 0.5D and get(size, 0) >= 50 and get(size, 1) >= 50").select("image_path", "position")


def largest_faces(spark, d):
    return images(spark, d).select("image_path", largest_face()["det_score"].alias("det_score"))


def quality_rank(spark, d):
    from pyspark.sql import Window

    rows = _faces(spark, d).withColumn("q", F.round(dedup.face_quality(), 6))
    return rows.select("image_path", "position", "q", F.row_number().over(Window.partitionBy("image_path").orderBy(F.col("q").desc_nulls_last(), "position")).alias("rank"))


def _hashed(spark, d):
    return b.docs(spark, d).where("text is not null").select("doc_id", dedup.content_hash("text").alias("digest"), F.length("text").alias("q"))


def exact_dups(spark, d):
    return dedup.exact_groups(_hashed(spark, d), "doc_id", "digest", "q").where("group_size > 1")


def dedup_keepers(spark, d):
    return dedup.exact_groups(_hashed(spark, d), "doc_id", "digest", "q").where("rank = 1").select("doc_id", "group_size")


def near_dup_keepers(spark, d):
    emb = _emb(spark, d)
    pairs = vectors.near_pairs(emb, "vec_id", "embedding", EPS)
    return dedup.near_duplicates(emb.select("vec_id", (F.lit(1_000_000) - F.col("vec_id")).alias("o")), pairs, "vec_id", "o")


def dedup_report(spark, d):
    kept = near_dup_keepers(spark, d).join(_labels(spark, d).withColumnRenamed("id", "vec_id"), "vec_id").where("label >= 0")
    return dedup.removal_report(kept, "label").select(F.col("label").cast("long").alias("label"), "n_before", "n_removed", "n_after")


def hash_distance(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") * F.lit(2654435761)).alias("a"), (F.col("s_nationkey").cast("long") * F.lit(40503)).alias("b"))
    return rows.select("s_suppkey", dedup.hamming(F.col("a"), F.col("b")).alias("bits"))


def latest_by_key(spark, d):
    return latest(table(spark, d, "events").select("user_id", "event_id", "ts", "event_type"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


def incremental_skip(spark, d):
    return unseen(table(spark, d, "customer").select("c_custkey"), table(spark, d, "events").select(F.col("user_id").alias("c_custkey")), "c_custkey")


HASHED = 24


def image_dups(spark, d):
    """Duplicates of the images by their first face: the hash is the signs of its vector's first components, missing for even sizes."""
    first = images(spark, d).select("image_path", F.get("faces", 0).alias("f")).select("image_path", "f.*")
    v = F.when((F.size("embedding") > HASHED) & F.exists("embedding", lambda x: x != 0), F.col("embedding"))
    bits = sum((F.when(F.col("embedding")[i] > 0, 1 << i).otherwise(0) for i in range(1, HASHED)), F.when(F.col("embedding")[0] > 0, 1).otherwise(0))
    rows = first.select("image_path", v.alias("v"), F.round(dedup.face_quality(), 6).alias("q"), F.md5(F.concat_ws("|", "age", "gender", F.get("size", 0))).alias("digest"), F.when(v.isNotNull() & (F.get("size", 1) % 2 == 1), bits.cast("long")).alias("h"))
    return dedup.image_duplicates(rows, "image_path", "digest", "h", "v", "q", least_dot=0.8)


_NEAR = f"e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), near AS (SELECT a.vec_id AS src, b.vec_id AS dst, 1 - list_cosine_similarity(a.v, b.v) AS distance FROM e a, e b WHERE a.vec_id < b.vec_id AND 1 - list_cosine_similarity(a.v, b.v) <= {EPS}::DOUBLE)"
_CLUSTERS = _NEAR + ", both_ways AS (SELECT src, dst FROM near UNION ALL SELECT dst, src FROM near), reach(a, b) AS (SELECT DISTINCT src, src FROM both_ways UNION SELECT r.a, w.dst FROM reach r JOIN both_ways w ON w.src = r.b), comp AS (SELECT a AS id, min(b) AS c FROM reach GROUP BY a), labels AS (SELECT e.vec_id AS id, coalesce(dense_rank() OVER (ORDER BY c NULLS LAST) - 1, -1) AS l, c FROM e LEFT JOIN comp ON comp.id = e.vec_id), clusters AS (SELECT id, CASE WHEN c IS NULL THEN -1 ELSE l END AS label FROM labels)"
_IMAGES = "images AS (SELECT * FROM face_cache WHERE image_path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY image_path ORDER BY log_id DESC) = 1), faces AS (SELECT image_path, unnest(faces) AS f, unnest(range(0, len(faces)))::INT AS position FROM images)"
_HASHED = f"{b.DOCS}, hashed AS (SELECT doc_id, md5(text) AS digest FROM docs WHERE text IS NOT NULL), grouped AS (SELECT *, count(*) OVER (PARTITION BY digest) AS group_size, row_number() OVER (PARTITION BY digest ORDER BY doc_id) AS rank FROM hashed)"
_BITS = " + ".join(f"CASE WHEN f.embedding[{i + 1}] > 0 THEN {1 << i} ELSE 0 END" for i in range(HASHED))
_IMAGE_DUPS = f"""WITH RECURSIVE {_IMAGES}, first AS (SELECT image_path, faces[1] AS f FROM images), made AS (SELECT image_path, f, CASE WHEN len(f.embedding) > {HASHED} AND len(list_filter(f.embedding, lambda x: x <> 0)) > 0 THEN list_transform(f.embedding, lambda x: x::DOUBLE) END AS v FROM first),
rows AS (SELECT image_path, v, round(f.blur_score * 0.4::DOUBLE + f.det_score * 100.0::DOUBLE * 0.3::DOUBLE + f.face_area * 0.3::DOUBLE, 6) AS q, md5(concat_ws('|', f.age, f.gender, f.size[1])) AS digest, CASE WHEN v IS NOT NULL AND f.size[2] % 2 = 1 THEN ({_BITS})::BIGINT END AS h FROM made),
grouped AS (SELECT *, count(*) OVER (PARTITION BY digest) AS n, row_number() OVER best AS r, first_value(image_path) OVER best AS top FROM rows WINDOW best AS (PARTITION BY digest ORDER BY q DESC, image_path)),
left_over AS (SELECT *, row_number() OVER (ORDER BY q DESC NULLS LAST, image_path) AS o FROM grouped WHERE n = 1),
near AS (SELECT a.o AS a, b.o AS b FROM left_over a, left_over b WHERE a.o < b.o AND CASE WHEN a.h IS NOT NULL AND b.h IS NOT NULL THEN bit_count(xor(a.h, b.h)) <= 5 ELSE a.v IS NOT NULL AND b.v IS NOT NULL AND list_cosine_similarity(a.v, b.v) >= 0.8::DOUBLE END),
pass(k, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT k + 1, CASE WHEN EXISTS (SELECT 1 FROM near WHERE near.b = k + 1 AND list_contains(kept, near.a)) THEN kept ELSE list_append(kept, k + 1) END FROM pass WHERE k < (SELECT count(*) FROM left_over))
SELECT image_path, CASE WHEN r = 1 THEN 'kept' ELSE 'exact' END AS status, CASE WHEN r > 1 THEN top END AS of FROM grouped WHERE n > 1
UNION ALL SELECT image_path, CASE WHEN list_contains((SELECT kept FROM pass ORDER BY k DESC LIMIT 1), o) THEN 'kept' ELSE 'near' END, NULL FROM left_over"""
_GREEDY = _CLUSTERS + ", nodes AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id DESC) AS k FROM e WHERE vec_id IN (SELECT src FROM both_ways)), pass(k, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT p.k + 1, CASE WHEN EXISTS (SELECT 1 FROM both_ways w WHERE w.src = n.vec_id AND list_contains(p.kept, w.dst)) THEN p.kept ELSE list_append(p.kept, n.vec_id) END FROM pass p JOIN nodes n ON n.k = p.k + 1), last_pass AS (SELECT kept FROM pass ORDER BY k DESC LIMIT 1), decided AS (SELECT e.vec_id, e.vec_id NOT IN (SELECT vec_id FROM nodes) OR list_contains((SELECT kept FROM last_pass), e.vec_id) AS kept FROM e)"
SQL = {
    "vector_norms": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, len(embedding) AS dims FROM embeddings",
    "vector_neighbors": f"WITH {_NEAR} SELECT src, dst, round(distance, 6) AS distance FROM near",
    "dbscan_clusters": f"WITH RECURSIVE {_CLUSTERS} SELECT id, label FROM clusters",
    "cluster_summary": f"WITH RECURSIVE {_CLUSTERS} SELECT format('person_{{:03d}}', label) AS cluster, count(DISTINCT id % 40) AS n_images, count(*) AS n_faces, round(avg(abs(v[1])), 6) AS avg_score FROM clusters JOIN e ON e.vec_id = id WHERE label >= 0 GROUP BY label HAVING count(*) >= 3",
    "cluster_preview": f"WITH RECURSIVE {_CLUSTERS} SELECT label, count(*) AS n, array_to_string(list_slice(list_sort(list(id)), 1, 3), ',') AS samples FROM clusters WHERE label >= 0 GROUP BY label",
    "cluster_stats": f"WITH RECURSIVE {_CLUSTERS}, sizes AS (SELECT label, count(*) AS n FROM clusters GROUP BY label) SELECT count(*) FILTER (label >= 0) AS n_clusters, coalesce(sum(n) FILTER (label >= 0), 0)::BIGINT AS n_members, max(n) FILTER (label >= 0) AS max_size, coalesce(sum(n) FILTER (label < 0), 0)::BIGINT AS n_noise FROM sizes",
    "labels_join": "SELECT c_nationkey AS n_nationkey, c_custkey, coalesce(n_name, c_nationkey::VARCHAR) AS n_name FROM customer LEFT JOIN nation n ON n.n_nationkey = c_nationkey",
    "vault_stats": f"WITH {_IMAGES} SELECT count(*) AS n_images, sum(coalesce(len(faces), 0))::BIGINT AS n_faces, count(error) AS n_errors, round(avg(coalesce(len(faces), 0)), 6) AS avg_faces FROM images",
    "face_rows": f"WITH {_IMAGES} SELECT image_path, position, round(f.det_score, 6) AS det_score FROM faces WHERE f.embedding IS NOT NULL",
    "detection_filter": f"WITH {_IMAGES} SELECT image_path, position FROM faces WHERE f.det_score >= 0.5 AND f.size[1] >= 50 AND f.size[2] >= 50",
    "largest_faces": f"WITH {_IMAGES} SELECT i.image_path, x.det_score FROM images i LEFT JOIN (SELECT image_path, f.det_score AS det_score FROM faces QUALIFY row_number() OVER (PARTITION BY image_path ORDER BY coalesce(f.size[1] * f.size[2], -1) DESC, position) = 1) x ON x.image_path = i.image_path",
    "quality_rank": f"WITH {_IMAGES}, q AS (SELECT image_path, position, round(f.blur_score * 0.4::DOUBLE + f.det_score * 100.0::DOUBLE * 0.3::DOUBLE + f.face_area * 0.3::DOUBLE, 6) AS q FROM faces) SELECT *, row_number() OVER (PARTITION BY image_path ORDER BY q DESC NULLS LAST, position) AS rank FROM q",
    "exact_dups": f"WITH {_HASHED} SELECT * FROM grouped WHERE group_size > 1",
    "dedup_keepers": f"WITH {_HASHED} SELECT doc_id, group_size FROM grouped WHERE rank = 1",
    "near_dup_keepers": f"WITH RECURSIVE {_GREEDY} SELECT vec_id, kept FROM decided",
    "dedup_report": f"WITH RECURSIVE {_GREEDY} SELECT label, count(*) AS n_before, count(*) FILTER (NOT kept) AS n_removed, count(*) FILTER (kept) AS n_after FROM decided JOIN clusters ON clusters.id = decided.vec_id WHERE label >= 0 GROUP BY label HAVING count(*) >= 2",
    "image_dups": _IMAGE_DUPS,
    "hash_distance": "SELECT s_suppkey, bit_count(xor((s_suppkey * 2654435761)::BIGINT, (s_nationkey * 40503)::BIGINT)) AS bits FROM supplier",
    "latest_by_key": "SELECT user_id, event_id, event_type FROM events WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "incremental_skip": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)",
}
QUERIES = {k: globals()[k] for k in SQL}
