"""Gaps of a data set, recommendations, generation quotas, validation and convergence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.ladder import messages

#: Kind, target, share below which it is a gap, wanted share (both in percent), how the reason names it.
ANGLE_RULES = [("face_angle", "front", 40.0, 50.0, "Front faces are"), ("face_angle", "three_quarter", 20.0, 30.0, "Three-quarter views are"), ("face_angle", "profile", 10.0, 20.0, "Profile shots are"), ("composition", "hands_visible", 30.0, 30.0, "Hands visible in")]
POSE_RULES = [("pose_type", "standing", 50.0, 60.0, "Standing poses are"), ("pose_type", "sitting", 10.0, 20.0, "Sitting poses are"), ("pose_type", "action", 5.0, 15.0, "Action poses are"), ("hand_position", "raised", 10.0, 15.0, "Raised hands are"), ("hand_position", "crossed", 5.0, 10.0, "Crossed arms are")]
BLUR_MIN, DARK, BRIGHT = 100.0, 30.0, 225.0


def gaps(counts: DataFrame, total: DataFrame, rules: list[tuple]) -> DataFrame:
    """kind, target, count needed and reason for every rule whose share is below its limit.

    counts: target and n; total: one row with total. Needed is the integer part of (wanted share - share) *
    total in binary arithmetic. No images, no gaps.
    """
    table = counts.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rules)], "ord int, kind string, target string, below double, wanted double, label string")
    rows = table.join(counts, "target", "left").crossJoin(total).where("total > 0")  # one row
    pct = F.coalesce("n", F.lit(0)) / F.col("total") * F.lit(100.0)
    need = ((F.col("wanted") / F.lit(100.0) - F.col("pct") / F.lit(100.0)) * F.col("total")).cast("int")
    out = rows.withColumn("pct", pct).where(F.col("pct") < F.col("below"))
    return out.select("ord", "kind", "target", need.alias("needed"), F.format_string("%s %.1f%% (target: %.0f%%)", "label", "pct", "wanted").alias("reason"))


def quota(needed: str = "needed", per_gap: int = 10) -> Column:
    """How many to make for a gap: what is needed, at most three times the number a gap, which is also the default."""
    return F.least(F.coalesce(F.col(needed), F.lit(per_gap)), F.lit(3 * per_gap))


def planned(recommended: DataFrame, base_seed: int = 42, per_gap: int = 10, prompts: dict[str, str] | None = None, variants: list[str] = ("soft light", "studio", "outdoors")) -> DataFrame:
    """A row for each item to make: its gap, seed (base + running number) and prompt; the variant is chosen by the first 32 bits of the seed's MD5."""
    rows = recommended.withColumn("k", F.explode(F.sequence(F.lit(1), F.greatest(quota(per_gap=per_gap), F.lit(0))))).where("needed > 0")
    n = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("ord", "k")) - 1  # as many rows as items, a few a gap
    named = F.coalesce(F.create_map(*[F.lit(x) for kv in (prompts or {"": ""}).items() for x in kv])[F.col("target")], F.replace("target", F.lit("_"), F.lit(" ")))
    pick = F.element_at(F.array(*[F.lit(v) for v in variants]), (F.pmod(F.conv(F.substring(F.md5(F.col("seed").cast("string")), 1, 8), 16, 10).cast("long"), F.lit(len(variants))) + 1).cast("int"))
    return rows.withColumn("seed", F.lit(base_seed) + n).select("ord", "target", "seed", F.concat_ws(", ", named, pick).alias("prompt"))


def dataset_warnings(facts: DataFrame) -> DataFrame:
    """Warnings on total, close, mid, far and unknown (a row a data set), joined by semicolons."""
    n = F.col("total")
    pct = lambda c: F.when(n > 0, F.col(c) / n * F.lit(100.0))
    text = lambda s, c: F.format_string(s, c)
    steps = [
        (n < 15, text("only %d images", n)), ((n >= 15) & (n < 30), text("%d images, more is better", n)),
        (pct("close") < 20, text("few close shots (%.0f%%)", pct("close"))), (pct("close") > 60, text("too many close shots (%.0f%%)", pct("close"))),
        (pct("mid") < 30, text("few mid shots (%.0f%%)", pct("mid"))), (pct("far") < 15, text("few far shots (%.0f%%)", pct("far"))),
        (F.col("unknown") > n * F.lit(0.3), text("%d images of unknown shot", F.col("unknown"))),
    ]
    return facts.withColumn("warnings", F.array_join(messages(steps), "; "))


def image_quality(blur: str = "blur_score", brightness: str = "brightness") -> Column:
    """Sharpness up to 500 and nearness to middle brightness, weighed 6 : 4."""
    return F.lit(0.6) * F.least(F.col(blur) / F.lit(500.0), F.lit(1.0)) + F.lit(0.4) * (F.lit(1.0) - F.abs(F.col(brightness) - F.lit(127.5)) / F.lit(127.5))


def target_met(target, angle, hands_visible=None, eyes_visible=None) -> Column:
    """Whether an image has what it was made for: the angle by names part of each other, hands and eyes by sight.

    An empty target is always met, and so is one whose detector is missing (null).
    """
    t, a = F.coalesce(target, F.lit("")), F.lower(angle)
    return F.coalesce((t == "") | F.when(t.isin("hands_visible", "eyes_visible"), F.coalesce(hands_visible if hands_visible is not None else F.lit(None).cast("boolean"), eyes_visible if eyes_visible is not None else F.lit(True), F.lit(True))).otherwise(F.contains(a, t) | F.contains(t, a)), F.lit(True))


def with_validation(images: DataFrame, blur: str = "blur_score", brightness: str = "brightness", met: Column | None = None) -> DataFrame:
    """images with quality, passed and the first reason of blurry, too_dark, too_bright and target (null if passed).

    Exactly at a limit passes. A row without measurements is missing and doesn't pass.
    """
    reasons = messages([(F.col(blur) < BLUR_MIN, F.lit("blurry")), (F.col(brightness) < DARK, F.lit("too_dark")), (F.col(brightness) > BRIGHT, F.lit("too_bright")), (~(met if met is not None else F.lit(True)), F.lit("target"))])
    absent = F.col(blur).isNull() | F.col(brightness).isNull()
    out = images.withColumns({"quality": image_quality(blur, brightness), "reason": F.when(absent, "missing").otherwise(F.get(reasons, F.lit(0)))})
    return out.withColumn("passed", F.col("reason").isNull())


def validation_stats(validated: DataFrame) -> DataFrame:
    """One row: all rows (missing ones too), passed, approval percentage of all, mean quality of those present."""
    return validated.agg(F.count("*").alias("n"), F.count_if("passed").alias("n_passed"), F.round(F.when(F.count("*") > 0, F.count_if("passed") / F.count("*") * 100).otherwise(0.0), 6).alias("approval_pct"), F.round(F.avg(F.when(F.col("reason").isNull() | (F.col("reason") != "missing"), F.col("quality"))), 6).alias("avg_quality"))


def rejections(validated: DataFrame, order: str, most: int = 10) -> DataFrame:
    """The first rejected rows in order."""
    return validated.where("not passed").orderBy(order).limit(most)


def convergence(history: DataFrame, order: str, metric: str, threshold: float = 0.05) -> DataFrame:
    """history with the metric's relative change to the row before, and whether its size is below the threshold.

    No change is known for the first row and after a metric of 0; a missing metric counts as 0.
    """
    w = Window.partitionBy(F.lit(1)).orderBy(order)  # a row an iteration
    m = F.coalesce(F.col(metric).cast("double"), F.lit(0.0))
    last = F.lag(m).over(w)
    change = F.when(last != 0, (m - last) / last)
    return history.withColumn("improvement", change).withColumn("converged", F.coalesce(F.abs(F.col("improvement")) < F.lit(threshold), F.lit(False)))


def cumulative(history: DataFrame, order: str, made: str, approved: str) -> DataFrame:
    """history with running totals of both and the running rate."""
    w = Window.partitionBy(F.lit(1)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = history.withColumns({"total_made": F.sum(made).over(w), "total_approved": F.sum(approved).over(w)})
    return out.withColumn("rate", F.when(F.col("total_made") > 0, F.col("total_approved") / F.col("total_made")).otherwise(F.lit(0.0)))


def merge_config(base: Column, override: Column) -> Column:
    """A map's entries with those of the second in their place; nested values are replaced whole."""
    keys = F.map_keys(override)
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.array_contains(keys, k)), override)


def merge_approved(real: DataFrame, approved: DataFrame, name: str = "file", prefix: str = "synthetic_") -> DataFrame:
    """Both sets' files, the approved png and jpg ones under a prefix, with their origin."""
    kept = approved.where(F.lower(name).rlike(r"\.(png|jpg)$")).select(F.concat(F.lit(prefix), F.col(name)).alias(name), F.lit("synthetic").alias("origin"))
    return real.select(name, F.lit("real").alias("origin")).unionByName(kept)


def resume_at(history: DataFrame, order: str | None = None, most: int = 10) -> DataFrame:
    """One row: the next iteration after those of the history, and whether the loop goes on.

    It does up to `most` iterations, unless one has converged already (`order`: the iteration's column, beside `converged`);
    first_converged is the first such iteration, null where there is none.
    """
    first = F.min(F.when(F.col("converged"), F.col(order))) if order else F.lit(None).cast("long")
    out = history.agg((F.count("*") + 1).alias("next_iteration"), first.alias("first_converged"))
    return out.withColumn("goes_on", (F.col("next_iteration") <= most) & F.col("first_converged").isNull())


def routed(validated: DataFrame) -> DataFrame:
    """validated with `route`: approved or rejected; rows without measurements go nowhere (null)."""
    return validated.withColumn("route", F.when(F.col("passed"), "approved").when(F.col("reason") != "missing", "rejected"))


def write_routes(validated: DataFrame, path: str) -> None:
    """A folder of the approved rows and one of the rejected ones."""
    routed(validated).where("route is not null").write.mode("overwrite").partitionBy("route").parquet(path)
