"""Image records: shot types, face angles, captions' concepts, poses from key points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.functions.ladder import first_of
from millrace.plans.ranges import placed

#: Words of captions that tell pose, setting, light and attributes.
POSES = {"standing": ["standing", "upright"], "sitting": ["sitting", "seated"], "lying": ["lying", "laying", "reclined"], "kneeling": ["kneeling"], "crouching": ["crouching", "squatting"], "leaning": ["leaning"]}
SETTINGS = {"indoor": ["indoor", "inside", "room", "bedroom", "living room", "kitchen"], "outdoor": ["outdoor", "outside", "beach", "park", "garden", "street"], "studio": ["studio", "plain background", "solid background"]}
LIGHTS = {"natural": ["natural light", "daylight", "sunlight", "golden hour"], "artificial": ["artificial", "studio lighting", "flash"], "soft": ["soft lighting", "diffused"], "dramatic": ["dramatic lighting", "low key", "high contrast"]}
ATTRIBUTES = ["smiling", "happy", "serious", "looking at camera", "blonde", "brunette", "long hair", "short hair", "blue eyes", "green eyes", "brown eyes"]
SHOTS = ["close", "mid", "far"]


def shot_type(ratio) -> Column:
    """By the face's share of the image: above .25 close, above .08 mid, else far; null counts as no share."""
    r = F.coalesce(tx.col(ratio), F.lit(0.0))
    return F.when(r > F.lit(0.25), "close").when(r > F.lit(0.08), "mid").otherwise("far")


def shot_confidence(ratio) -> Column:
    r = F.coalesce(tx.col(ratio), F.lit(0.0))
    close = F.least(F.lit(0.95), F.lit(0.7) + (r - F.lit(0.25)) * F.lit(0.5))
    mid = F.greatest(F.lit(0.6), F.lit(0.9) - F.abs(r - F.lit(0.165)) * F.lit(3.0))
    return F.when(r > F.lit(0.25), close).when(r > F.lit(0.08), mid).otherwise(F.least(F.lit(0.85), F.lit(0.7) - r * F.lit(5.0)))


def largest_face(faces: str = "faces") -> Column:
    """The face of the greatest width times height, the first of several; null without faces."""
    area = lambda f: F.coalesce(F.get(f["size"], F.lit(0)) * F.get(f["size"], F.lit(1)), F.lit(-1))
    return F.reduce(faces, F.get(faces, F.lit(0)), lambda best, f: F.when(area(f) > area(best), f).otherwise(best))


def cached_shot(images: DataFrame, cache: DataFrame, path: str = "image_path", relative: str = "relative_path") -> DataFrame:
    """images with the cached ratio by path, else by relative path; unknown images are mid at ratio 0 and confidence .3."""
    a = cache.select(F.col("path").alias(path), F.col("face_ratio").alias("__a"))
    b = cache.select(F.col("path").alias(relative), F.col("face_ratio").alias("__b"))
    found = images.join(a, path, "left").join(b, relative, "left").withColumn("face_ratio", F.coalesce("__a", "__b"))
    known = F.col("face_ratio").isNotNull()
    return found.drop("__a", "__b").withColumns({"shot_type": F.when(known, shot_type("face_ratio")).otherwise("mid"), "confidence": F.when(known, shot_confidence("face_ratio")).otherwise(0.3), "face_ratio": F.coalesce("face_ratio", F.lit(0.0))})


def taxonomy_terms(c, taxonomy: dict[str, list[str]]) -> dict[str, Column]:
    """For each category the terms that are part of the text; keys with a leading underscore are left out."""
    low = F.lower(tx.col(c))
    return {k: F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t.lower())), t) for t in terms])) for k, terms in taxonomy.items() if not k.startswith("_")}


def concepts(df: DataFrame, c: str, taxonomy: dict[str, list[str]] | None = None, clothing: tuple = ("clothing",), attributes: tuple = ("expressions",)) -> DataFrame:
    """df with pose, setting, lighting, and sorted lists concepts, clothing and attributes of the caption.

    A term counts where it is part of the text, also within a word. clothing and attributes name the
    taxonomy's categories (clothing: by part of the name) that go into those lists.
    """
    low = F.lower(F.coalesce(F.col(c), F.lit("")))
    out = df.withColumns({"pose": tx.first_category(low, POSES), "setting": tx.first_category(low, SETTINGS), "lighting": tx.first_category(low, LIGHTS)})
    found = taxonomy_terms(low, taxonomy or {})
    none = F.array().cast("array<string>")
    join = lambda cols: F.array_distinct(F.flatten(F.array(none, *cols)))
    extra = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(a)), a) for a in ATTRIBUTES]))
    terms = join(list(found.values()))
    own = F.array_except(extra, terms)
    named = F.array_compact(F.array("pose", "setting", "lighting"))
    return out.withColumns(
        {
            "concepts": F.array_sort(F.array_distinct(F.concat(named, terms, own))),
            "clothing": F.array_sort(join([v for k, v in found.items() if any(x in k for x in clothing)])),
            "attributes": F.array_sort(F.array_distinct(F.concat(join([v for k, v in found.items() if k in attributes]), own))),
        }
    )


def distribution(df: DataFrame, c: str, domain: list[str], least: int = 3) -> DataFrame:
    """Count, percentage and whether too few, of every value of the domain, also of those that don't occur."""
    counts = df.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    rows = df.sparkSession.createDataFrame([(v,) for v in domain], "value string").join(counts, "value", "left").crossJoin(total)  # one row
    n = F.coalesce("n", F.lit(0))
    return rows.select("value", n.alias("n"), F.round(F.when(F.col("total") > 0, n / F.col("total") * 100).otherwise(0.0), 6).alias("pct"), (n < least).alias("few"))


def sequence_names(df: DataFrame, group: str, order: str, trigger, width: int = 4):
    """With name: trigger, group and the number within the group in order."""
    return placed(df, [group], [order], "__n").withColumn("name", F.format_string(f"%s_%s_%0{width}d", trigger, F.col(group), F.col("__n") + 1)).drop("__n")


def trigger_word(c) -> Column:
    """A label as a trigger: small letters, blanks as underscores."""
    return F.replace(F.lower(tx.col(c)), F.lit(" "), F.lit("_"))


def face_angle(width, height) -> Column:
    """By the box's aspect: below .6 profile, below .85 three_quarter, else front; without height 1; null without a box."""
    aspect = F.when(height > 0, width / height).otherwise(F.lit(1.0))
    return F.when(width.isNull() | height.isNull(), "unknown").when(aspect < F.lit(0.6), "profile").when(aspect < F.lit(0.85), "three_quarter").otherwise("front")


SEEN = 0.3


def pose_of(kp: str = "kp") -> dict[str, Column]:
    """pose, orientation, hands and confidence from 17 key points (array of struct x, y, c) in COCO order.

    Null or empty key points give unknown for the first two, unknown hands and confidence 0.
    """
    p = lambda i: F.get(F.col(kp), F.lit(i))
    seen = lambda i: p(i)["c"] > F.lit(SEEN)

    def mean_y(*ids):
        hit = [F.when(seen(i), p(i)["y"]) for i in ids]
        n = sum((F.when(seen(i), 1).otherwise(0) for i in ids[1:]), F.when(seen(ids[0]), 1).otherwise(0))
        return sum((F.coalesce(h, F.lit(0.0)) for h in hit[1:]), F.coalesce(hit[0], F.lit(0.0))) / n

    nose, shoulders, hips, knees, ankles = seen(0), seen(5) | seen(6), seen(11) | seen(12), seen(13) | seen(14), seen(15) | seen(16)
    sy, hy, ky, ay = mean_y(5, 6), mean_y(11, 12), mean_y(13, 14), mean_y(15, 16)
    torso = F.abs(hy - sy)
    legs = hips & knees
    upright = legs & (ky > hy) & ankles
    body = F.concat(*[F.transform(F.filter(F.slice(kp, i + 1, 2), lambda q: q["c"] > F.lit(SEEN)), lambda q: q["y"]) for i in (5, 11, 13, 15)])
    mean = F.aggregate(body, F.lit(0.0), lambda s, y: s + y) / F.size(body)
    variance = F.aggregate(body, F.lit(0.0), lambda s, y: s + (y - mean) * (y - mean)) / F.size(body)
    absent = F.col(kp).isNull() | (F.size(kp) == 0)
    pose = first_of(
        [
            (absent | ~(nose & shoulders), "unknown"),
            (upright & (ay > ky) & ((ay - ky) > torso * F.lit(0.5)), "standing"),
            (upright & ((ky - hy) < torso * F.lit(0.3)), "crouching"),
            (legs & ~(ky > hy) & (F.abs(ky - hy) < torso * F.lit(0.5)), "sitting"),
            (legs & (ky > hy) & ~ankles & (F.abs(ky - hy) < torso * F.lit(0.5)), "sitting"),
            (legs & (ky > hy) & ~ankles, "kneeling"),
            (F.abs(p(0)["y"] - sy) < 50, "lying"),
            (knees & ankles & (variance > 5000), "action"),
        ],
        "unknown",
    )
    left, right = seen(5) & seen(11), seen(6) & seen(12)
    orientation = first_of([(absent, "unknown"), (left & right & (seen(0) | seen(1) | seen(2)), "frontal"), (left & right, "back"), (left, "side_left"), (right, "side_right"), (seen(5) | seen(6), "three_quarter")], "unknown")
    wrists, elbows = seen(9) | seen(10), seen(7) | seen(8)
    shoulder = (p(5)["y"] + p(6)["y"]) / 2
    hip = F.when(seen(11) & seen(12), (p(11)["y"] + p(12)["y"]) / 2).otherwise(shoulder + 100)
    wy = mean_y(9, 10)
    width = F.abs(p(6)["x"] - p(5)["x"])
    hands = first_of(
        [
            (absent, "unknown"), (~(wrists | elbows), "hidden"), (wrists & (wy < shoulder), "raised"), (wrists & (F.abs(wy - hip) < 50), "on_hips"),
            (seen(7) & seen(8) & (F.abs(p(8)["x"] - p(7)["x"]) < width * F.lit(0.6)), "crossed"), (seen(9) & seen(10) & (F.abs(p(10)["x"] - p(9)["x"]) > width * F.lit(1.5)), "gesturing"),
        ],
        "relaxed",
    )
    sure = F.filter(kp, lambda q: q["c"] > 0)
    confidence = F.when(absent | (F.size(sure) == 0), F.lit(0.0)).otherwise(F.aggregate(sure, F.lit(0.0), lambda s, q: s + q["c"]) / F.size(sure))
    return {"pose": pose, "orientation": orientation, "hands": hands, "confidence": confidence}


def image_manifest(shots: DataFrame, described: DataFrame, key: str) -> DataFrame:
    """Each image's shot with its concepts; images that aren't described have none."""
    return shots.join(described.select(key, "pose", "setting", "lighting", "concepts", "clothing", "attributes"), key, "left")
