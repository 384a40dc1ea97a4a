"""Queries and SQL of the operators for training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import pair_defects, personal_data, reading_level, similarity_clusters, source_mix, target_sample, term_frequency, text_stats, token_ids
from millrace.plans.runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_terms(spark, d).where("mark is not null").select("term", "mark")


def p1_terms(spark: SparkSession, d: str) -> DataFrame:
    found = term_frequency.marked_terms(term_frequency.answers(table(spark, d, "probe_answers")), "answer_id", "response")
    return found.select("term", "n_occurrences", "n_records", "mark")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_defects(spark, d).where("defect is not null")


def p2_defects(spark: SparkSession, d: str) -> DataFrame:
    return pair_defects.pair_defects(pair_defects.records(table(spark, d, "pairs"), table(spark, d, "probe_answers")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    faces = similarity_clusters.valid_faces(table(spark, d, "face_cache"))
    groups, _ = similarity_clusters.similar_groups(faces.select("id", "vec"))
    return similarity_clusters.face_clusters(faces, groups).select("face_key", "cluster_key")


def p3_clusters(spark: SparkSession, d: str) -> DataFrame:
    faces = similarity_clusters.valid_faces(table(spark, d, "face_cache"))
    groups, links = similarity_clusters.similar_groups(faces.select("id", "vec"))
    return similarity_clusters.cluster_report(faces, groups, links)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = personal_data.find_personal(personal_data.turns(table(spark, d, "conversation")), table(spark, d, "known_name"))
    return found.select("msg_id", "kind", "found").distinct()


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    texts = personal_data.turns(table(spark, d, "conversation"))
    return personal_data.redact(texts, personal_data.find_personal(texts, table(spark, d, "known_name")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    texts = text_stats.record_texts(table(spark, d, "pairs"), table(spark, d, "conversation"))
    return text_stats.text_quality(texts, ["src", "rec_id"], "text").where("shape is not null").select("src", "rec_id", "shape")


def p5_stats(spark: SparkSession, d: str) -> DataFrame:
    texts = text_stats.record_texts(table(spark, d, "pairs"), table(spark, d, "conversation"))
    found = text_stats.text_quality(texts, ["src", "rec_id"], "text")
    named = [F.round(F.col("stats")[i], 6).alias(n) for i, n in enumerate(text_stats.STATS)]
    return found.select("src", "rec_id", "lang", *named, F.round("d2", 3).alias("distance2"), F.transform("parts", lambda x: F.round(x, 3)).alias("parts"), "shape")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_report(spark, d).where("unmet").select("dataset_id", "field_name", "category")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return target_sample.draw_sample(table(spark, d, "image_shot"), table(spark, d, "shot_target"))[1]


def p7_sample(spark: SparkSession, d: str) -> DataFrame:
    return target_sample.draw_sample(table(spark, d, "image_shot"), table(spark, d, "shot_target"))[0]


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return token_ids.token_ids(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_report(spark, d).where("short").select("mix_id", "source_name")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return source_mix.mix_sources(table(spark, d, "documents"), table(spark, d, "source_target"))[1]


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return source_mix.mix_sources(table(spark, d, "documents"), table(spark, d, "source_target"))[0]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_levels(spark, d).where("level_name <> 'medium'").select("doc_id", "level_name")


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading_level.reading_levels(table(spark, d, "documents"), table(spark, d, "level_reference"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit()}


_TERMS = r"""
WITH answers AS (SELECT DISTINCT answer_id, response FROM probe_answers WHERE response IS NOT NULL AND NOT starts_with(response, '[ERROR')),
words AS (SELECT answer_id, nfc_normalize(lower(unnest(regexp_extract_all(nfc_normalize(response), '[\p{L}\p{Nd}]+')))) AS term FROM answers),
counts AS (SELECT term, count(*) AS n_occurrences, count(DISTINCT answer_id) AS n_records FROM words GROUP BY term),
marked AS (SELECT *, CASE WHEN n_records < 3 THEN 'rare' WHEN n_records * 4 > (SELECT count(DISTINCT answer_id) FROM answers) THEN 'common' END AS mark FROM counts)
"""
_SHOTS = r"""
WITH scans AS (SELECT DISTINCT img_id, dataset_id, image_path, shot_type, face_angles, scanned_ts FROM image_shot),
now AS (SELECT *, regexp_replace(lower(shot_type), '[\s_/.-]+', ' ', 'g') AS s, regexp_replace(lower(face_angles), '[\s_/.-]+', ' ', 'g') AS a FROM scans
  QUALIFY row_number() OVER (PARTITION BY dataset_id, image_path ORDER BY scanned_ts DESC, img_id DESC) = 1),
cats AS (SELECT dataset_id, 'shot_type' AS field_name, CASE WHEN regexp_matches(s, 'close|head ?shot|portrait|tight') THEN 'close' WHEN regexp_matches(s, 'mid|medium|waist|half|cowboy') THEN 'mid' WHEN regexp_matches(s, 'far|wide|full|long|distant') THEN 'far' END AS category FROM now
  UNION ALL SELECT dataset_id, 'face_angles', CASE WHEN regexp_matches(a, 'three quarter|3 ?4|¾|quarter') THEN 'three_quarter' WHEN regexp_matches(a, 'profile|side|lateral') THEN 'profile' WHEN regexp_matches(a, 'front|facing|head on') THEN 'front' END FROM now),
have AS (SELECT dataset_id, field_name, category, count(*) AS n FROM cats GROUP BY ALL)
SELECT t.dataset_id, t.field_name, t.category FROM (SELECT DISTINCT * FROM shot_target) t LEFT JOIN have h ON h.dataset_id = t.dataset_id AND h.field_name = t.field_name AND h.category = t.category
WHERE coalesce(h.n, 0) * 100 < greatest(t.target_pct * t.draw_rows, t.min_rows * 100)
"""


_FACES = """
WITH RECURSIVE newest AS (SELECT * FROM face_cache WHERE image_path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY image_path ORDER BY log_id DESC) = 1),
faces AS (SELECT image_path, unnest(faces) AS f, unnest(range(0, len(faces))) AS pos FROM newest),
vec AS (SELECT image_path || '#' || pos AS k, list_transform(f.embedding, lambda x: x::DOUBLE) AS v FROM faces WHERE len(f.embedding) > 0 AND len(list_filter(f.embedding, lambda x: x <> 0)) > 0),
near AS (SELECT a.k AS a, b.k AS b FROM vec a, vec b WHERE a.k <> b.k AND list_cosine_similarity(a.v, b.v) >= 0.6 - 1e-12),
reach(a, b) AS (SELECT DISTINCT a, a FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b),
cluster AS (SELECT a AS face_key, min(b) AS cluster_key, count(*) AS n FROM reach GROUP BY a)
SELECT face_key, cluster_key FROM cluster WHERE n >= 3
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _TERMS + "SELECT term, mark FROM marked WHERE mark IS NOT NULL",
        "p1_terms": _TERMS + "SELECT term, n_occurrences, n_records, mark FROM marked",
        "p3_found": _FACES,
        "p7_found": _SHOTS,
    }
