"""A sample of each data set with target category shares on several margins (problem 7)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.ranges import prefix_sums
from millrace.plans.runtime import cut, hot_join, width

FIELDS = ("shot_type", "face_angles")
#: Parameter: raking ends when a round moves no weight, at the latest after so many rounds; the report's `settled` tells which.
RAKE_ROUNDS = 200
#: Words that tell a category, tried in order.
SHOT_WORDS = {"close": "close|head ?shot|portrait|tight", "mid": "mid|medium|waist|half|cowboy", "far": "far|wide|full|long|distant"}
ANGLE_WORDS = {"three_quarter": r"three quarter|3 ?4|¾|quarter", "profile": "profile|side|lateral", "front": "front|facing|head on"}


def category(c, words: dict[str, str]):
    """A spelling's category, or null where it is in none."""
    plain = F.regexp_replace(F.lower(c), r"(?U)[\s_/.-]+", " ")
    out = F.lit(None).cast("string")
    for name, pattern in reversed(words.items()):
        out = F.when(plain.rlike(pattern), name).otherwise(out)
    return out


def current_images(images: DataFrame) -> DataFrame:
    """The scan with the latest scanned_ts of each image, ties by the greatest img_id; null times come first."""
    last = F.max_by(F.struct("img_id", "shot_type", "face_angles"), F.struct(F.coalesce(F.col("scanned_ts").cast("timestamp"), F.lit("0001-01-01").cast("timestamp")), "img_id")).alias("s")
    rows = images.groupBy("dataset_id", "image_path").agg(last)
    return rows.select("dataset_id", "image_path", "s.img_id", category(F.col("s.shot_type"), SHOT_WORDS).alias("shot_type"), category(F.col("s.face_angles"), ANGLE_WORDS).alias("face_angles"))


def _rake(cells: pd.DataFrame, goals: pd.DataFrame) -> pd.DataFrame:
    """Whole quotas of a data set's cells: raked weights, largest remainders within what is there, minimums repaired.

    cells: at most (categories + 1) ** fields rows with n; goals: the data set's targets.
    """
    n = cells.n.to_numpy(dtype="float64")
    of = {f: cells[f].to_numpy() for f in FIELDS}
    share, least, at = {}, {}, {}
    for f, cat, pct, low in zip(goals.field_name, goals.category, goals.target_pct, goals.min_rows):
        share.setdefault(f, {})[cat] = pct / 100
        least[f, cat] = int(low)
        at[f, cat] = of[f] == cat
    fields = [f for f in FIELDS if f in share]
    draw = int(goals.draw_rows.max())
    w = n.copy()
    for f in fields:
        w[~np.isin(of[f].astype(str), [str(c) for c in share[f]])] *= 1e-6  # images outside the categories only fill up
    for _ in range(RAKE_ROUNDS):
        moved = 0.0
        for f in fields:
            total = w.sum()
            for cat, s in share[f].items():
                have = w[at[f, cat]].sum()
                if have > 0 and total > 0:
                    k = s * total / have
                    moved = max(moved, abs(k - 1))
                    w[at[f, cat]] *= k
        if moved < 1e-9:
            break
    quota = np.zeros(len(n), dtype="int64")
    want = min(draw, int(n.sum()))
    while quota.sum() < want:  # each pass fills cells or ends
        room = n - quota
        live = (room > 0) & (w > 0)
        if not live.any():
            live = room > 0
        ww = w * live if (w * live).sum() > 0 else live.astype(float)
        step = np.minimum(ww / ww.sum() * (want - quota.sum()), room)
        whole = step.astype("int64")
        left = want - quota.sum() - whole.sum()
        if not whole.sum():
            for i in sorted(range(len(step)), key=lambda i: (-(step[i] - whole[i]), i))[:left]:
                if live[i]:
                    whole[i] += 1
        quota = quota + whole

    def spare(j: int) -> int:
        """How many of the cell could go without a category falling below its least."""
        slack = [int(quota[at[g, of[g][j]]].sum()) - least[g, of[g][j]] for g in fields if (g, of[g][j]) in at]
        return int(min([int(quota[j]), *slack]))

    for key, m in least.items():
        mine = at[key]
        while quota[mine].sum() < m and (mine & (quota < n)).any():
            i = max((i for i in range(len(n)) if mine[i] and quota[i] < n[i]), key=lambda i: (n[i] - quota[i], -i))
            quota[i] += 1
            give = [j for j in range(len(n)) if not mine[j] and quota[j] > 0]
            if quota.sum() > draw and give and spare(j := max(give, key=lambda j: (spare(j), -j))) > 0:
                quota[j] -= 1
    return cells.assign(weight=w / n, quota=quota, settled=bool(moved < 1e-9))


def draw_sample(images: DataFrame, targets: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(sample, report) of each data set in `targets` (dataset_id, field_name, category, target_pct, draw_rows, min_rows).

    Only the counts of the data sets' cells (at most 16 rows each) are raked; the images are then taken
    from each cell by the smallest exponential keys -ln(u)/weight of hashed ids, by running counts over
    range partitions, so that a data set with a third of all images spreads over many tasks. A minimum
    that the shares leave unmet takes the place of what is over elsewhere, or enlarges the sample.
    report: a row for each target with `available`, `needed` (the larger of the share of draw_rows and
    min_rows), `drawn`, the residual `gap` in rows, `unmet` where available is less than needed, and `settled`, whether
    the data set's margins could be raked to agree (null without images).
    A data set without images has reports but no sample. Null categories are in no category. Targets that
    are repeated count once.
    """
    goals = targets.select("dataset_id", "field_name", "category", F.col("target_pct").cast("double").alias("target_pct"), F.col("draw_rows").cast("long").alias("draw_rows"), F.col("min_rows").cast("long").alias("min_rows")).distinct().where("dataset_id is not null")
    wanted = goals.select("dataset_id").distinct()
    now = cut(current_images(images.join(wanted, "dataset_id", "left_semi")), "images")
    cells = now.groupBy("dataset_id", *FIELDS).agg(F.count("*").alias("n"))
    parts = width(images.sparkSession)
    cells = cells.na.fill("", list(FIELDS)).repartition(parts, "dataset_id")
    schema = "dataset_id string, shot_type string, face_angles string, n long, weight double, quota long, settled boolean"
    raked = cut(cells.groupBy("dataset_id").cogroup(goals.repartition(parts, "dataset_id").groupBy("dataset_id")).applyInPandas(lambda c, g: _rake(c.sort_values(list(FIELDS), ignore_index=True), g.fillna({"target_pct": 0, "draw_rows": 0, "min_rows": 0})) if len(c) and len(g) else pd.DataFrame(columns=["dataset_id", "shot_type", "face_angles", "n", "weight", "quota", "settled"]).astype({"n": "int64", "weight": "float64", "quota": "int64", "settled": "bool"}), schema), "raked")

    keyed = hot_join(now.na.fill("", list(FIELDS)), raked.where("quota > 0").drop("settled"), ["dataset_id", *FIELDS], "n", now.count())
    u = (F.pmod(F.xxhash64(F.lit(seed), "dataset_id", "image_path"), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    keyed = keyed.withColumn("key", -F.log(u) / F.greatest("weight", F.lit(1e-300))).withColumn("one", F.lit(1).cast("long"))
    ranked = prefix_sums(keyed, ["dataset_id", *FIELDS], ["key", "image_path"], "one", "nth")
    sample = cut(ranked.where("nth <= quota").select("dataset_id", "image_path", "img_id", *[F.when(F.col(f) != "", F.col(f)).alias(f) for f in FIELDS]), "sample")

    def counted(df: DataFrame, out: str) -> DataFrame:
        per = df.groupBy("dataset_id", *FIELDS).agg(F.count("*").alias("n"))
        tall = per.select("dataset_id", "n", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("category")) for f in FIELDS])).alias("x"))
        return tall.groupBy("dataset_id", F.col("x.field_name").alias("field_name"), F.col("x.category").alias("category")).agg(F.sum("n").alias(out))

    keys = ["dataset_id", "field_name", "category"]
    report = goals.join(counted(now, "available"), keys, "left").join(counted(sample, "drawn"), keys, "left").na.fill(0, ["available", "drawn"])
    report = report.join(raked.groupBy("dataset_id").agg(F.every("settled").alias("settled")), "dataset_id", "left")
    report = report.withColumn("needed", F.greatest(F.col("target_pct") * F.col("draw_rows") / 100, F.col("min_rows").cast("double")))
    return sample, report.withColumn("gap", F.col("needed") - F.col("drawn")).withColumn("unmet", F.col("available") * 100 < F.greatest(F.col("target_pct") * F.col("draw_rows"), F.col("min_rows") * 100.0))
