"""Image records, gaps and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import gaps, images
from millrace.plans.runtime import table
from millrace.queries import base as b
from millrace.queries import vectors as v

#: Fixed value: a taxonomy of words that occur in the test texts; the operator takes any other.
TAXONOMY = {"clothing_items": ["scarf", "raincoat", "jumper", "jacket"], "expressions": ["smiling", "serious"], "places": ["harbour", "library", "market", "roof"], "_note": ["not a term"]}


def _shots(spark, d):
    """The last scan of each image."""
    rows = table(spark, d, "image_shot").groupBy("dataset_id", "image_path").agg(F.max_by(F.struct("img_id", "shot_type", "face_angles", "face_ratio", "confidence"), F.struct("scanned_ts", "img_id")).alias("s"))
    return rows.select("dataset_id", "image_path", "s.*")


def shot_type(spark, d):
    return _shots(spark, d).select("dataset_id", "image_path", images.shot_type("face_ratio").alias("shot"), F.round(images.shot_confidence("face_ratio"), 6).alias("confidence"))


def shot_distribution(spark, d):
    return images.distribution(_shots(spark, d).select(images.shot_type("face_ratio").alias("shot")), "shot", [*images.SHOTS, "unknown"])


def shot_sequence_names(spark, d):
    rows = _shots(spark, d).select(F.concat_ws("/", "dataset_id", "image_path").alias("path"), images.shot_type("face_ratio").alias("shot"))
    return images.sequence_names(rows, "shot", "path", F.lit("my_set")).select("path", "name")


def cached_shots(spark, d):
    shots = _shots(spark, d).select("img_id", "image_path", "face_ratio")
    cache = shots.where("img_id % 3 = 0 and face_ratio is not null").select(F.concat(F.lit("c"), F.col("img_id").cast("string")).alias("path"), "face_ratio").union(shots.where("img_id % 3 = 1 and face_ratio is not null").select(F.concat(F.lit("r"), F.col("img_id").cast("string")), "face_ratio"))
    asked = shots.select("img_id", F.concat(F.lit("c"), F.col("img_id").cast("string")).alias("image_path"), F.concat(F.lit("r"), F.col("img_id").cast("string")).alias("relative_path"))
    return images.cached_shot(asked, cache).select("img_id", "shot_type", F.round("confidence", 6).alias("confidence"), "face_ratio")


def face_angles(spark, d):
    w, h = F.get("bbox", F.lit(2)) - F.get("bbox", F.lit(0)), F.get("bbox", F.lit(3)) - F.get("bbox", F.lit(1))
    share = F.get("size", F.lit(0)) % 10 / F.lit(10.0)
    return v._faces(spark, d).select(images.face_angle(w * share, h).alias("angle")).groupBy("angle").agg(F.count("*").alias("n"))


def visibility(spark, d):
    return v.images(spark, d).select("image_path", F.size("faces").alias("k"), F.transform("faces", lambda f: f["det_score"]).alias("s")).select("image_path", (F.coalesce("k", F.lit(0)) > 0).alias("visible"), F.round(F.coalesce(F.aggregate("s", F.lit(0.0), lambda a, x: a + x) / F.nullif("k", F.lit(0)), F.lit(0.0)), 6).alias("confidence"))


def concepts(spark, d):
    rows = images.concepts(b.docs(spark, d).where("text is not null"), "text", TAXONOMY)
    return rows.select("doc_id", "pose", "setting", "lighting", F.array_join("concepts", "|").alias("concepts"), F.array_join("clothing", "|").alias("clothing"), F.array_join("attributes", "|").alias("attributes"))


def image_manifest(spark, d):
    shots = _shots(spark, d).select("img_id", images.shot_type("face_ratio").alias("shot"))
    described = images.concepts(b.docs(spark, d).where("text is not null"), "text", TAXONOMY).withColumnRenamed("doc_id", "img_id")
    return images.image_manifest(shots, described, "img_id").select("img_id", "shot", "pose", F.array_join("concepts", "|").alias("concepts"))


def _pixels(spark, d):
    """Metrics of 16 x 16 images made of the vectors' components."""
    from millrace.operators import pixels

    made = F.unhex(F.array_join(F.transform(F.flatten(F.array_repeat("embedding", 4)), lambda x: F.lpad(F.hex(F.floor(F.abs(x.cast("double")) * 255 * 4).cast("int") % 256), 2, "0")), ""))
    rows = table(spark, d, "embeddings").select("vec_id", made.alias("pixels"), F.lit(16).alias("width"), F.lit(16).alias("height"))
    return pixels.pixel_metrics(rows, "vec_id")


def pixel_metrics(spark, d):
    return _pixels(spark, d).select("vec_id", F.round("blur_score", 6).alias("blur_score"), F.round("brightness", 6).alias("brightness"))


def pixel_hashes(spark, d):
    """The perceptual hash has no counterpart in SQL."""
    return _pixels(spark, d).select("vec_id", "phash")


def taxonomy_tags(spark, d):
    found = images.taxonomy_terms("text", TAXONOMY)

    def named(category: str):
        return lambda t: F.struct(F.lit(category).alias("category"), t.alias("term"))

    rows = b.docs(spark, d).select("doc_id", F.explode(F.flatten(F.array(*[F.transform(c, named(k)) for k, c in found.items()]))).alias("x"))
    return rows.select("doc_id", "x.category", "x.term")


def concept_topk(spark, d):
    docs = b.docs(spark, d).where("text is not null")
    total = docs.agg(F.count("*").alias("total"))
    rows = images.concepts(docs, "text", TAXONOMY).select(F.explode("concepts").alias("concept")).groupBy("concept").agg(F.count("*").alias("n"))
    return rows.orderBy(F.col("n").desc(), "concept").limit(20).crossJoin(total).select("concept", "n", F.round(F.col("n") / F.col("total"), 6).alias("frequency"))  # one row


def _poses(spark, d):
    e = lambda k: F.get("embedding", F.lit(k)).cast("double")
    kp = F.array(*[F.struct((e(3 * i) * 800 + 300).alias("x"), (e(3 * i + 1) * 400 + (60 * i)).alias("y"), (F.abs(e(3 * i + 2)) * 9).alias("c")) for i in range(17)])
    rows = table(spark, d, "embeddings").select("vec_id", kp.alias("kp"))
    return rows.select("vec_id", *[c.alias(k) for k, c in images.pose_of("kp").items()])


def pose_types(spark, d):
    return _poses(spark, d).select("vec_id", "pose", "orientation", "hands", F.round("confidence", 6).alias("confidence"))


def pose_recommendations(spark, d):
    poses = _poses(spark, d)
    counts = poses.groupBy(F.col("pose").alias("target")).agg(F.count("*").alias("n")).union(poses.groupBy("hands").agg(F.count("*").alias("n")))
    return gaps.gaps(counts, poses.agg(F.count("*").alias("total")), gaps.POSE_RULES)


def _by_angle(spark, d):
    angle = F.regexp_replace(F.lower("face_angles"), r"[\s_/.-]+", " ")
    return _shots(spark, d).select(F.when(angle.rlike("three quarter|3 ?4"), "three_quarter").when(angle.rlike("profile|side"), "profile").when(angle.rlike("front"), "front").alias("target"))


def _gaps(spark, d):
    rows = _by_angle(spark, d)
    return gaps.gaps(rows.groupBy("target").agg(F.count("*").alias("n")).where("target is not null"), rows.agg(F.count("*").alias("total")), gaps.ANGLE_RULES)


def gap_recommendations(spark, d):
    return _gaps(spark, d)


def generation_quota(spark, d):
    return _gaps(spark, d).select("target", gaps.quota(per_gap=25).alias("quota"))


def generation_plan(spark, d):
    return gaps.planned(_gaps(spark, d), prompts={"front": "a face from the front"}, per_gap=25)


def dataset_warnings(spark, d):
    shot = F.regexp_replace(F.lower("shot_type"), r"[\s_/.-]+", " ")
    rows = _shots(spark, d).select("dataset_id", F.when(shot.rlike("close|head ?shot"), "close").when(shot.rlike("mid|medium|waist"), "mid").when(shot.rlike("far|wide|full"), "far").otherwise("unknown").alias("s"))
    facts = rows.groupBy("dataset_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("s") == k).alias(k) for k in ("close", "mid", "far", "unknown")])
    return gaps.dataset_warnings(facts).select("dataset_id", "warnings")


def _validated(spark, d):
    return gaps.with_validation(v._faces(spark, d).select("image_path", "position", "blur_score", "brightness"))


def validation_pass(spark, d):
    return _validated(spark, d).select("image_path", "position", F.round("quality", 6).alias("quality"), "passed", "reason")


def validation_reasons(spark, d):
    return _validated(spark, d).groupBy("reason").agg(F.count("*").alias("n"))


def validation_stats(spark, d):
    return gaps.validation_stats(_validated(spark, d))


def rejections(spark, d):
    rows = _validated(spark, d).withColumn("k", F.format_string("%s#%05d", "image_path", "position"))
    return gaps.rejections(rows, "k").select("k", "reason")


def target_check(spark, d):
    rows = _shots(spark, d).select("img_id", F.lower("face_angles").alias("a"), F.element_at(F.array(F.lit("front"), F.lit("profile"), F.lit("hands_visible"), F.lit("")), (F.col("img_id") % 4 + 1).cast("int")).alias("t"))
    return rows.select("img_id", gaps.target_met(F.col("t"), F.col("a"), F.col("img_id") % 3 == 0).alias("met"))


def _daily(spark, d):
    rows = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type")
    return rows.groupBy("day").agg(F.count("*").alias("made"), F.count_if(F.col("event_type") == "purchase").alias("approved")).withColumn("metric", F.col("approved") / F.col("made"))


def convergence(spark, d):
    return gaps.convergence(_daily(spark, d), "day", "metric").select("day", F.round("improvement", 6).alias("improvement"), "converged")


def cumulative_rate(spark, d):
    return gaps.cumulative(_daily(spark, d), "day", "made", "approved").select("day", "total_made", "total_approved", F.round("rate", 6).alias("rate"))


def resume_iteration(spark, d):
    return gaps.resume_at(gaps.convergence(_daily(spark, d), "day", "metric"), "day", 365)


def validation_routes(spark, d):
    return gaps.routed(_validated(spark, d)).groupBy("route").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("avg_quality"))


def merge_approved(spark, d):
    approved = table(spark, d, "part").select(F.concat("p_name", F.when(F.col("p_size") % 3 == 0, ".PNG").when(F.col("p_size") % 3 == 1, ".jpg").otherwise(".webp")).alias("file"))
    return gaps.merge_approved(table(spark, d, "supplier").select(F.col("s_name").alias("file")), approved).groupBy("origin").agg(F.count("*").alias("n"), F.min("file").alias("first"))


_S = "shots AS (SELECT dataset_id, image_path, img_id, shot_type, face_angles, face_ratio FROM image_shot QUALIFY row_number() OVER (PARTITION BY dataset_id, image_path ORDER BY scanned_ts DESC, img_id DESC) = 1)"


def _shot(r):
    return f"CASE WHEN coalesce({r}, 0) > 0.25::DOUBLE THEN 'close' WHEN coalesce({r}, 0) > 0.08::DOUBLE THEN 'mid' ELSE 'far' END"


def _conf(r):
    z = f"coalesce({r}, 0::DOUBLE)"
    return f"CASE WHEN {z} > 0.25::DOUBLE THEN least(0.95::DOUBLE, 0.7::DOUBLE + ({z} - 0.25::DOUBLE) * 0.5::DOUBLE) WHEN {z} > 0.08::DOUBLE THEN greatest(0.6::DOUBLE, 0.9::DOUBLE - abs({z} - 0.165::DOUBLE) * 3.0::DOUBLE) ELSE least(0.85::DOUBLE, 0.7::DOUBLE - {z} * 5.0::DOUBLE) END"


def _angle(w, h):
    return f"CASE WHEN {w} IS NULL OR {h} IS NULL THEN 'unknown' WHEN CASE WHEN {h} > 0 THEN ({w}) / ({h}) ELSE 1 END < 0.6::DOUBLE THEN 'profile' WHEN CASE WHEN {h} > 0 THEN ({w}) / ({h}) ELSE 1 END < 0.85::DOUBLE THEN 'three_quarter' ELSE 'front' END"


def _first(c, cats):
    return "CASE " + " ".join(f"WHEN {b.contains(c, t)} THEN '{k}'" for k, t in cats.items()) + " END"


def _list(items):
    return "list_filter([" + ", ".join(items) + "]::VARCHAR[], lambda x: x IS NOT NULL)"


def _terms(c, ts):
    return _list([f"CASE WHEN contains({c}, '{t}') THEN '{t}' END" for t in ts])


_OWN = {k: t for k, t in TAXONOMY.items() if k[0] != "_"}
_ALL = [t for ts in _OWN.values() for t in ts]
_ATTR = [a for a in images.ATTRIBUTES if a not in _ALL]
_C = f"WITH {b.DOCS}, c AS (SELECT doc_id, lower(text) AS low FROM docs WHERE text IS NOT NULL), f AS (SELECT doc_id, {_first('low', images.POSES)} AS pose, {_first('low', images.SETTINGS)} AS setting, {_first('low', images.LIGHTS)} AS lighting, {_terms('low', _ALL)} AS terms, {_terms('low', _OWN['clothing_items'])} AS clothing, {_terms('low', _OWN['expressions'])} AS expr, {_terms('low', images.ATTRIBUTES)} AS attr0 FROM c), g AS (SELECT *, list_filter(attr0, lambda x: NOT list_contains(terms, x)) AS attr FROM f), concepts AS (SELECT doc_id, pose, setting, lighting, list_sort(list_distinct(list_concat({_list(['pose', 'setting', 'lighting'])}, terms, attr))) AS concepts, list_sort(clothing) AS clothing, list_sort(list_distinct(list_concat(expr, attr))) AS attributes FROM g) "
_KP = "kp AS (SELECT vec_id, list_transform(range(0, 17), lambda i: {'x': embedding[3 * i + 1]::DOUBLE * 800 + 300, 'y': embedding[3 * i + 2]::DOUBLE * 400 + 60 * i, 'c': abs(embedding[3 * i + 3]::DOUBLE) * 9}) AS k FROM embeddings)"


def _vis(i):
    return f"(k[{i + 1}].c > 0.3::DOUBLE)"


def _my(*ids):
    num = " + ".join(f"CASE WHEN {_vis(i)} THEN k[{i + 1}].y ELSE 0 END" for i in ids)
    den = " + ".join(f"CASE WHEN {_vis(i)} THEN 1 ELSE 0 END" for i in ids)
    return f"(({num}) / nullif({den}, 0)::DOUBLE)"


_POSE = (
    _KP
    + f", m AS (SELECT *, {_vis(0)} AS nose, ({_vis(5)} OR {_vis(6)}) AS sh, ({_vis(11)} OR {_vis(12)}) AS hp, ({_vis(13)} OR {_vis(14)}) AS kn, ({_vis(15)} OR {_vis(16)}) AS an, {_my(5, 6)} AS sy, {_my(11, 12)} AS hy, {_my(13, 14)} AS ky, {_my(15, 16)} AS ay, {_my(9, 10)} AS wy, ({_vis(9)} OR {_vis(10)}) AS wr, ({_vis(7)} OR {_vis(8)}) AS el, abs(k[7].x - k[6].x) AS w, (k[6].y + k[7].y) / 2 AS s2, list_transform(list_filter([6, 7, 12, 13, 14, 15, 16, 17], lambda i: k[i].c > 0.3::DOUBLE), lambda i: k[i].y) AS body, list_filter(k, lambda q: q.c > 0) AS sure FROM kp), "
    "poses AS (SELECT vec_id, CASE WHEN NOT (nose AND sh) THEN 'unknown' WHEN hp AND kn AND ky > hy AND an AND ay > ky AND ay - ky > abs(hy - sy) * 0.5::DOUBLE THEN 'standing' WHEN hp AND kn AND ky > hy AND an AND ky - hy < abs(hy - sy) * 0.3::DOUBLE THEN 'crouching' WHEN hp AND kn AND NOT (ky > hy AND an) AND abs(ky - hy) < abs(hy - sy) * 0.5::DOUBLE THEN 'sitting' WHEN hp AND kn AND ky > hy AND NOT an THEN 'kneeling' WHEN abs(k[1].y - sy) < 50 THEN 'lying' WHEN kn AND an AND list_var_pop(body) > 5000 THEN 'action' ELSE 'unknown' END AS pose, "
    f"CASE WHEN {_vis(5)} AND {_vis(11)} AND {_vis(6)} AND {_vis(12)} THEN CASE WHEN {_vis(0)} OR {_vis(1)} OR {_vis(2)} THEN 'frontal' ELSE 'back' END WHEN {_vis(5)} AND {_vis(11)} THEN 'side_left' WHEN {_vis(6)} AND {_vis(12)} THEN 'side_right' WHEN sh THEN 'three_quarter' ELSE 'unknown' END AS orientation, "
    f"CASE WHEN NOT (wr OR el) THEN 'hidden' WHEN wr AND wy < s2 THEN 'raised' WHEN wr AND abs(wy - CASE WHEN {_vis(11)} AND {_vis(12)} THEN (k[12].y + k[13].y) / 2 ELSE s2 + 100 END) < 50 THEN 'on_hips' WHEN {_vis(7)} AND {_vis(8)} AND abs(k[9].x - k[8].x) < w * 0.6::DOUBLE THEN 'crossed' WHEN {_vis(9)} AND {_vis(10)} AND abs(k[11].x - k[10].x) > w * 1.5::DOUBLE THEN 'gesturing' ELSE 'relaxed' END AS hands, "
    "CASE WHEN len(sure) = 0 THEN 0 ELSE list_sum(list_transform(sure, lambda q: q.c)) / len(sure) END AS confidence FROM m)"
)


def _rules(rules, counts, total):
    values = ", ".join(f"({i}, '{k}', '{t}', {lo}::DOUBLE, {w}::DOUBLE, '{lab}')" for i, (k, t, lo, w, lab) in enumerate(rules))
    return f"rules(ord, kind, target, below, wanted, label) AS (VALUES {values}), counts AS ({counts}), total AS ({total}), p AS (SELECT rules.*, coalesce(n, 0) / total::DOUBLE * 100 AS pct, total FROM rules LEFT JOIN counts USING (target), total WHERE total > 0), gaps AS (SELECT ord, kind, target, trunc((wanted / 100::DOUBLE - pct / 100::DOUBLE) * total)::INT AS needed, printf('%s %.1f%% (target: %.0f%%)', label, pct, wanted) AS reason FROM p WHERE pct < below)"


_ANG = r"ang AS (SELECT CASE WHEN regexp_matches(a, 'three quarter|3 ?4') THEN 'three_quarter' WHEN regexp_matches(a, 'profile|side') THEN 'profile' WHEN regexp_matches(a, 'front') THEN 'front' END AS target FROM (SELECT regexp_replace(lower(face_angles), '[\s_/.-]+', ' ', 'g') AS a FROM shots))"
_GAPS = f"{_S}, {_ANG}, " + _rules(gaps.ANGLE_RULES, "SELECT target, count(*) AS n FROM ang WHERE target IS NOT NULL GROUP BY target", "SELECT count(*) AS total FROM ang")
_VALID = v._IMAGES + ", val AS (SELECT image_path, position, f.blur_score AS blur, f.brightness AS br, 0.6::DOUBLE * least(f.blur_score / 500::DOUBLE, 1::DOUBLE) + 0.4::DOUBLE * (1::DOUBLE - abs(f.brightness - 127.5::DOUBLE) / 127.5::DOUBLE) AS quality, CASE WHEN f.blur_score IS NULL OR f.brightness IS NULL THEN 'missing' WHEN f.blur_score < 100 THEN 'blurry' WHEN f.brightness < 30 THEN 'too_dark' WHEN f.brightness > 225 THEN 'too_bright' END AS reason FROM faces)"
_DAILY = "daily AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS made, count(*) FILTER (event_type = 'purchase') AS approved, count(*) FILTER (event_type = 'purchase') / count(*)::DOUBLE AS metric FROM events GROUP BY 1)"
SQL = {
    "shot_type": f"WITH {_S} SELECT dataset_id, image_path, {_shot('face_ratio')} AS shot, round({_conf('face_ratio')}, 6) AS confidence FROM shots",
    "shot_distribution": f"WITH {_S}, c AS (SELECT {_shot('face_ratio')} AS value, count(*) AS n FROM shots GROUP BY 1) SELECT d.value, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT count(*) FROM shots)::DOUBLE * 100, 6) AS pct, coalesce(n, 0) < 3 AS few FROM (VALUES ('close'), ('mid'), ('far'), ('unknown')) d(value) LEFT JOIN c USING (value)",
    "shot_sequence_names": f"WITH {_S}, s AS (SELECT dataset_id || '/' || image_path AS path, {_shot('face_ratio')} AS shot FROM shots) SELECT path, printf('my_set_%s_%04d', shot, row_number() OVER (PARTITION BY shot ORDER BY path)) AS name FROM s",
    "cached_shots": f"WITH {_S} SELECT img_id, CASE WHEN img_id % 3 < 2 AND face_ratio IS NOT NULL THEN {_shot('face_ratio')} ELSE 'mid' END AS shot_type, round(CASE WHEN img_id % 3 < 2 AND face_ratio IS NOT NULL THEN {_conf('face_ratio')} ELSE 0.3 END, 6) AS confidence, CASE WHEN img_id % 3 < 2 THEN coalesce(face_ratio, 0) ELSE 0 END AS face_ratio FROM shots",
    "face_angles": f"WITH {v._IMAGES}, x AS (SELECT {_angle('(f.bbox[3] - f.bbox[1]) * (f.size[1] % 10 / 10.0::DOUBLE)', '(f.bbox[4] - f.bbox[2])')} AS angle FROM faces) SELECT angle, count(*) AS n FROM x GROUP BY angle",
    "visibility": f"WITH {v._IMAGES} SELECT image_path, coalesce(len(faces), 0) > 0 AS visible, round(coalesce(list_sum(list_transform(faces, lambda f: f.det_score)) / nullif(len(faces), 0), 0), 6) AS confidence FROM images",
    "concepts": _C + "SELECT doc_id, pose, setting, lighting, array_to_string(concepts, '|') AS concepts, array_to_string(clothing, '|') AS clothing, array_to_string(attributes, '|') AS attributes FROM concepts",
    "image_manifest": _C.replace("WITH ", f"WITH {_S}, ", 1) + f"SELECT img_id, {_shot('face_ratio')} AS shot, pose, array_to_string(concepts, '|') AS concepts FROM shots LEFT JOIN concepts ON doc_id = img_id",
    "taxonomy_tags": f"WITH {b.DOCS}, t(category, term) AS (VALUES {', '.join(f'({k!r}, {t!r})' for k, ts in _OWN.items() for t in ts)}) SELECT doc_id, category, term FROM docs, t WHERE contains(lower(text), term)",
    "concept_topk": _C + "SELECT concept, n, round(n / (SELECT count(*) FROM concepts), 6) AS frequency FROM (SELECT unnest(concepts) AS concept, count(*) AS n FROM concepts GROUP BY 1 ORDER BY n DESC, concept LIMIT 20)",
    "pose_types": f"WITH {_POSE} SELECT vec_id, pose, orientation, hands, round(confidence, 6) AS confidence FROM poses",
    "pose_recommendations": f"WITH {_POSE}, " + _rules(gaps.POSE_RULES, "SELECT pose AS target, count(*) AS n FROM poses GROUP BY 1 UNION ALL SELECT hands, count(*) FROM poses GROUP BY 1", "SELECT count(*) AS total FROM poses") + " SELECT * FROM gaps",
    "gap_recommendations": f"WITH {_GAPS} SELECT * FROM gaps",
    "generation_quota": f"WITH {_GAPS} SELECT target, least(needed, 75) AS quota FROM gaps",
    "dataset_warnings": rf"WITH {_S}, k AS (SELECT dataset_id, CASE WHEN regexp_matches(s, 'close|head ?shot') THEN 'close' WHEN regexp_matches(s, 'mid|medium|waist') THEN 'mid' WHEN regexp_matches(s, 'far|wide|full') THEN 'far' ELSE 'unknown' END AS s FROM (SELECT dataset_id, regexp_replace(lower(shot_type), '[\s_/.-]+', ' ', 'g') AS s FROM shots)), w AS (SELECT dataset_id, count(*) AS total, count(*) FILTER (s = 'close') * 100 / count(*)::DOUBLE AS c, count(*) FILTER (s = 'mid') * 100 / count(*)::DOUBLE AS m, count(*) FILTER (s = 'far') * 100 / count(*)::DOUBLE AS f, count(*) FILTER (s = 'unknown') AS u FROM k GROUP BY dataset_id) SELECT dataset_id, array_to_string(list_filter([CASE WHEN total < 15 THEN printf('only %d images', total) END, CASE WHEN total >= 15 AND total < 30 THEN printf('%d images, more is better', total) END, CASE WHEN c < 20 THEN printf('few close shots (%.0f%%)', c) END, CASE WHEN c > 60 THEN printf('too many close shots (%.0f%%)', c) END, CASE WHEN m < 30 THEN printf('few mid shots (%.0f%%)', m) END, CASE WHEN f < 15 THEN printf('few far shots (%.0f%%)', f) END, CASE WHEN u > total * 0.3::DOUBLE THEN printf('%d images of unknown shot', u) END], lambda x: x IS NOT NULL), '; ') AS warnings FROM w",
    "validation_pass": f"WITH {_VALID} SELECT image_path, position, round(quality, 6) AS quality, reason IS NULL AS passed, reason FROM val",
    "validation_reasons": f"WITH {_VALID} SELECT reason, count(*) AS n FROM val GROUP BY reason",
    "validation_stats": f"WITH {_VALID} SELECT count(*) AS n, count(*) FILTER (reason IS NULL) AS n_passed, round(count(*) FILTER (reason IS NULL) / count(*)::DOUBLE * 100, 6) AS approval_pct, round(avg(quality) FILTER (reason IS NULL OR reason <> 'missing'), 6) AS avg_quality FROM val",
    "rejections": f"WITH {_VALID} SELECT printf('%s#%05d', image_path, position) AS k, reason FROM val WHERE reason IS NOT NULL ORDER BY k LIMIT 10",
    "target_check": f"WITH {_S}, t AS (SELECT img_id, lower(face_angles) AS a, ['front', 'profile', 'hands_visible', ''][(img_id % 4 + 1)::INT] AS t FROM shots) SELECT img_id, coalesce(t = '' OR CASE WHEN t = 'hands_visible' THEN img_id % 3 = 0 ELSE contains(a, t) OR contains(t, a) END, true) AS met FROM t",
    "convergence": f"WITH {_DAILY}, l AS (SELECT day, metric, lag(metric) OVER (ORDER BY day) AS p FROM daily) SELECT day, round(CASE WHEN p <> 0 THEN (metric - p) / p END, 6) AS improvement, coalesce(abs(CASE WHEN p <> 0 THEN (metric - p) / p END) < 0.05::DOUBLE, false) AS converged FROM l",
    "cumulative_rate": f"WITH {_DAILY} SELECT day, sum(made) OVER w::BIGINT AS total_made, sum(approved) OVER w::BIGINT AS total_approved, round(sum(approved) OVER w / sum(made) OVER w, 6) AS rate FROM daily WINDOW w AS (ORDER BY day)".replace("sum(made) OVER w::BIGINT", "(sum(made) OVER w)::BIGINT").replace("sum(approved) OVER w::BIGINT", "(sum(approved) OVER w)::BIGINT"),
    "resume_iteration": f"WITH {_DAILY} SELECT n + 1 AS next_iteration, first_converged, n + 1 <= 365 AND first_converged IS NULL AS goes_on FROM (SELECT count(*) AS n, min(day) FILTER (abs((metric - p) / nullif(p, 0)) < 0.05::DOUBLE) AS first_converged FROM (SELECT *, lag(metric) OVER (ORDER BY day) AS p FROM daily))",
    "validation_routes": f"WITH {_VALID} SELECT CASE WHEN reason IS NULL THEN 'approved' WHEN reason <> 'missing' THEN 'rejected' END AS route, count(*) AS n, round(avg(quality), 6) AS avg_quality FROM val GROUP BY 1",
    "generation_plan": f"WITH {_GAPS}, made AS (SELECT ord, target, row_number() OVER (ORDER BY ord, k) + 41 AS seed FROM (SELECT ord, target, unnest(range(1, least(needed, 75) + 1)) AS k FROM gaps WHERE needed > 0)) SELECT ord, target, seed::INT AS seed, CASE target WHEN 'front' THEN 'a face from the front' ELSE replace(target, '_', ' ') END || ', ' || ['soft light', 'studio', 'outdoors'][(('0x' || substr(md5(seed::VARCHAR), 1, 8))::BIGINT % 3 + 1)::INT] AS prompt FROM made",
    "pixel_metrics": "WITH px AS (SELECT vec_id, list_transform(embedding, lambda x: floor(abs(x::DOUBLE) * 255 * 4)::INT % 256) AS c FROM embeddings), inner_ AS (SELECT vec_id, c, list_transform(range(196), lambda i: c[((i // 14) * 16 + i % 14 + 1) % 64 + 1] + c[((i // 14 + 2) * 16 + i % 14 + 1) % 64 + 1] + c[((i // 14 + 1) * 16 + i % 14) % 64 + 1] + c[((i // 14 + 1) * 16 + i % 14 + 2) % 64 + 1] - 4 * c[((i // 14 + 1) * 16 + i % 14 + 1) % 64 + 1]) AS l FROM px) SELECT vec_id, round(list_aggregate(l, 'var_pop'), 6) AS blur_score, round(list_avg(c), 6) AS brightness FROM inner_",
    "merge_approved": "SELECT origin, count(*) AS n, min(file) AS first FROM (SELECT s_name AS file, 'real' AS origin FROM supplier UNION ALL SELECT 'synthetic_' || p_name || CASE p_size % 3 WHEN 0 THEN '.PNG' ELSE '.jpg' END, 'synthetic' FROM part WHERE p_size % 3 < 2) GROUP BY origin",
}
QUERIES = {k: globals()[k] for k in SQL} | {"pixel_hashes": pixel_hashes}
