import pickle
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators import chat, dedup, gaps, images, pixels, profile, quality, scan, splits, traits, vectors

TURNS = "conv_id string, turn int, msg_id long, role string, text string"


def texts(spark, *xs):
    return spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "id long, text string")


def one(spark, column, *xs):
    return [r[1] for r in texts(spark, *xs).select("id", column).orderBy("id").collect()]


def test_words_of_any_script(spark):
    assert one(spark, tx.words("text"), "Étion, réaile_2 no!", "", None) == [["Étion", "réaile_2", "no"], [], None]
    pad = tx.padded("text")
    assert one(spark, tx.count_terms(F.lower(pad), ["you know", "like"]), "You know you know, like LIKE likely", "") == [4, 0]
    assert one(spark, tx.strip("text"), "  \t a b \n", "　") == ["a b", ""]
    assert one(spark, F.size(tx.words("text")), "a b") == [2]


def test_length_bands(spark):
    n = [9, 19, 20, 29, 30, 49, 50, 500, 501, 1000, 1001, 2000, 2001]
    assert one(spark, quality.length_score("text")[0], *["x" * k for k in n]) == [25, 25, 50, 50, 75, 75, 100, 100, 85, 85, 70, 70, 40]


def test_message_scores_of_odd_texts(spark):
    out = quality.with_message_scores(texts(spark, "", None, "I love it! Do you? We were frustrated by the " + "Reasonable " * 60, "🙂🙂"), "text").orderBy("id").collect()
    assert [r.density_score for r in out][:2] == [0.0, 0.0] and out[2].engagement_score == 100 and out[3].density_score == 0
    assert quality.with_message_scores(texts(spark).limit(0), "text").count() == 0


def test_question_and_relevance(spark):
    assert one(spark, quality.question_score("text")[0], "What is it?", "tell me about it", "a? and b? ", "one two three four five?") == [100, 70, 100, 100]
    df = spark.createDataFrame([("how are you", "fine"), ("blur score set", "the blur score"), ("", "x")], "q string, r string")
    assert [r[0] for r in df.select(quality.relevance_score("q", "r")[0]).collect()] == [70.0, 85.0, 70.0]


def test_grades(spark):
    df = spark.createDataFrame([(x,) for x in (90.0, 89.9, 80.0, 70.0, 60.0, 59.9)], "s double")
    assert [r[0] for r in df.select(quality.grade("s")).collect()] == list("ABBCDF")


def test_pairs_are_positional(spark):
    data = [("a", 0, 1, "system", "s"), ("a", 1, 2, "user", "q"), ("a", 2, 3, "assistant", "r"), ("b", 0, 4, "user", "q"), ("b", 1, 5, "assistant", "r"), ("b", 2, 6, "user", "q2"), ("c", 0, 7, "assistant", "r"), ("d", 0, 8, "user", "u"), ("d", 1, 9, "user", "v")]
    df = spark.createDataFrame(data, TURNS)
    assert [r.conv_id for r in chat.positional_pairs(df).collect()] == ["b"]
    assert sorted(r.conv_id for r in chat.adjacent_pairs(df).collect()) == ["a", "b"]
    assert chat.positional_pairs(df.limit(0)).count() == 0


def test_reasons_in_order(spark):
    xs = ["we should CIRCLE back, I hear you", "I hear you, dear friend", "ok", "Okay.", "...", " \t", None, "short one", "long enough text"]
    assert one(spark, chat.filter_reason("text"), *xs) == ["blacklist", "blacklist", "low_quality", "low_quality", "low_quality", "low_quality", "low_quality", "too_short", "keep"]
    assert one(spark, chat.filter_reason("text", slop=False), xs[1]) == ["keep"]
    assert one(spark, chat.matched_pattern("text", [*chat.BLACKLIST, *chat.SLOP]), xs[0]) == [r"\bcircle back\b"]
    assert one(spark, chat.filter_reason("text", toxic=F.lit(0.81)), "long enough text") == ["toxicity"]
    assert one(spark, chat.normal_role("text"), " Human", "AI", "SYSTEM ", "tool", None) == ["user", "assistant", "system", None, None]


def test_survival_needs_two(spark):
    df = spark.createDataFrame([("a", True), ("a", True), ("b", True), ("b", False)], "conv_id string, k boolean")
    assert rows(chat.surviving(df, F.col("k"))) == [("a", 2, 2, True), ("b", 2, 1, False)]


def test_formats(spark):
    df = spark.createDataFrame([("i", "r")], "instruction string, response string")
    assert df.select(chat.extracted_response(chat.alpaca())).first()[0] == "r"
    assert df.select(chat.chat_messages()).first()[0][1].content == "r"
    assert df.select(F.to_json(chat.caption_conversation(F.lit("p"), F.lit("c")))).first()[0].count("type") == 3


def test_profiles(spark):
    df = texts(spark, "a b c a b c", "a b", "Hi there you. Hi there you! ok")
    top = profile.top_ngrams(df, "text", 3, 2).collect()
    assert (top[0].ngram, top[0].n) == ("a b c", 2) and abs(sum(r.share for r in top) - 1) < 1e-6
    assert profile.sentence_starters(df, "text").first().starter == "hi there you"
    assert rows(profile.vocabulary(df.limit(0), "text")) == [(0, 0, 0.0, 0.0)]
    assert profile.vocabulary(df, "text").first().total_words == 15
    t = profile.trait_totals(texts(spark, "fun!!! 😄 need to play, because"), "text").first()
    assert (t.playful, t.assertive, t.analytical) == (4, 1, 1)


def test_shots_and_angles(spark):
    df = spark.createDataFrame([(0.25,), (0.2501,), (0.08,), (0.0801,), (None,)], "r double")
    assert [r[0] for r in df.select(images.shot_type("r")).collect()] == ["mid", "close", "far", "mid", "far"]
    box = spark.createDataFrame([(6.0, 10.0), (8.5, 10.0), (5.9, 10.0), (1.0, 0.0), (None, 1.0)], "w double, h double")
    assert [r[0] for r in box.select(images.face_angle(F.col("w"), F.col("h"))).collect()] == ["three_quarter", "front", "profile", "front", "unknown"]
    few = images.distribution(df.select(images.shot_type("r").alias("s")), "s", ["close", "mid", "far", "unknown"])
    assert [(r.value, r.n, r.few) for r in few.orderBy("value").collect()] == [("close", 1, True), ("far", 2, True), ("mid", 2, True), ("unknown", 0, True)]


def test_largest_face_first_on_ties(spark):
    df = spark.createDataFrame([([([2, 3], "a"), ([3, 2], "b"), (None, "c")],), ([],), (None,)], "faces array<struct<size: array<int>, n: string>>")
    assert [r[0] for r in df.select(images.largest_face()["n"]).collect()] == ["a", None, None]


def test_concepts(spark):
    df = texts(spark, "Sitting in the bedroom, smiling, a Red Scarf", None)
    out = images.concepts(df, "text", {"clothing": ["scarf"], "_x": ["red"]}).orderBy("id").collect()
    assert (out[0].pose, out[0].setting, out[0].concepts, out[0].clothing, out[0].attributes) == ("sitting", "indoor", ["indoor", "scarf", "sitting", "smiling"], ["scarf"], ["smiling"])
    assert out[1].concepts == []


def points(**at):
    base = [(0.0, 0.0, 0.0)] * 17
    for k, v in at.items():
        base[int(k[1:])] = v
    return base


def test_poses(spark):
    up = points(p0=(100.0, 10.0, 0.9), p5=(80.0, 100.0, 0.9), p6=(120.0, 100.0, 0.9), p11=(85.0, 200.0, 0.9), p12=(115.0, 200.0, 0.9), p13=(85.0, 280.0, 0.9), p14=(115.0, 280.0, 0.9), p15=(85.0, 360.0, 0.9), p16=(115.0, 360.0, 0.9), p9=(70.0, 50.0, 0.9))
    df = spark.createDataFrame([(1, up), (2, points()), (3, None), (4, [])], "id long, kp array<struct<x: double, y: double, c: double>>")
    p = images.pose_of()
    out = df.select("id", *[c.alias(k) for k, c in p.items()]).orderBy("id").collect()
    assert tuple(out[0])[1:4] == ("standing", "frontal", "raised") and abs(out[0].confidence - 0.9) < 1e-9
    assert tuple(out[1])[1:4] == ("unknown", "unknown", "hidden")
    assert [tuple(r)[1:] for r in out[2:]] == [("unknown", "unknown", "unknown", 0.0)] * 2


@pytest.mark.parametrize(("n", "total", "want"), [(7, 18, 1), (0, 10, 5), (3, 8, 1)])
def test_needed_in_binary_arithmetic(spark, n, total, want):
    counts = spark.createDataFrame([("front", n)], "target string, n long")
    got = gaps.gaps(counts, spark.createDataFrame([(total,)], "total long"), gaps.ANGLE_RULES).where("target = 'front'").first()
    assert got.needed == int((0.5 - n / total * 100 / 100) * total) and (got.needed == want or n / total != 7 / 18)


def test_no_images_no_gaps(spark):
    none = spark.createDataFrame([], "target string, n long")
    assert gaps.gaps(none, spark.createDataFrame([(0,)], "total long"), gaps.ANGLE_RULES).count() == 0
    made = gaps.planned(gaps.gaps(none, spark.createDataFrame([(10,)], "total long"), gaps.ANGLE_RULES))
    assert [r.seed for r in made.orderBy("seed").collect()] == list(range(42, 42 + made.count())) and made.count() == 13


def test_validation_limits(spark):
    df = spark.createDataFrame([(1, 100.0, 30.0), (2, 99.9, 29.0), (3, 500.0, 225.1), (4, None, 1.0)], "id long, blur_score double, brightness double")
    assert [r.reason for r in gaps.with_validation(df).orderBy("id").collect()] == [None, "blurry", "too_bright", "missing"]
    assert gaps.validation_stats(gaps.with_validation(df)).first().approval_pct == 25.0
    assert gaps.validation_stats(gaps.with_validation(df.limit(0))).first().n == 0


def test_convergence(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 1.05), (4, 1.06), (5, None)], "i int, m double")
    out = gaps.convergence(df, "i", "m").orderBy("i").collect()
    assert [r.improvement is None for r in out] == [True, True, False, False, False] and [r.converged for r in out] == [False, False, False, True, False]
    merged = spark.range(1).select(gaps.merge_config(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3)))).first()[0]
    assert merged == {"a": 1, "b": 3}


def test_clusters(spark):
    v = [[1.0, 0.0, 0.0], [0.9, 0.44, 0.0], [0.6, 0.8, 0.0], [0.0, 0.0, 1.0], [0.0, 0.0, 0.0]]
    df = spark.createDataFrame([*enumerate(v), (5, None), (6, [])], "id long, e array<float>")
    labels = dict(rows(vectors.density_clusters(df, "id", "e", 0.2)))
    assert labels == {0: 0, 1: 0, 2: 0, 3: -1, 4: -1, 5: -1, 6: -1}
    assert vectors.cluster_stats(vectors.density_clusters(df.limit(0), "id", "e", 0.2)).first().max_size is None
    assert vectors.near_pairs(df, "id", "e", 0.99).count() >= vectors.near_pairs(df, "id", "e", 0.2).count()
    with pytest.raises(ValueError, match="below 1"):
        vectors.near_pairs(df, "id", "e", 1.0)


def test_exact_groups_and_hamming(spark):
    df = spark.createDataFrame([(1, "x", 1.0), (2, "x", 2.0), (3, "y", 1.0), (4, None, 1.0), (5, "x", 2.0)], "id long, h string, q double")
    assert [(r.id, r["rank"]) for r in dedup.exact_groups(df, "id", "h", "q").orderBy("h", "rank").collect()] == [(2, 1), (5, 2), (1, 3), (3, 1)]
    assert spark.range(1).select(dedup.hamming(F.lit(5), F.lit(6))).first()[0] == 2


def test_traits(spark):
    df = spark.createDataFrame([("p", "I am 20 or 30, from Berlin"), ("p", 'they call me "Ann Lee" at 7 or 101'), ("p", "curly hair")], "prompt string, r string")
    assert rows(traits.number_means(df, "prompt", "r")) == [("p", 25, 0.666667)]
    assert [(r.place, r.n) for r in traits.place_votes(df, "prompt", "r").collect()] == [("Berlin", 1)]
    assert [(r.name, r.n) for r in traits.quoted_names(df, "prompt", "r").collect()] == [("Ann Lee", 1)]
    assert [r[0] for r in df.select(traits.vote("r")).collect()] == ["male" if "he" in x or "man" in x else None for x in ("i am 20 or 30, from berlin", "they call me", "curly hair")]
    assert [r.prompt for r in traits.prompt_grid(spark, 3, {"a": ["x", "y"], "b": ["1", "2", "3"]}, "%s%s").orderBy("i").collect()] == ["x1", "y2", "x3"]


def test_split_is_exact_and_stable(spark):
    a = splits.split(spark.range(101), "id")
    assert a.where("split = 'train'").count() == 90
    assert rows(a) == rows(splits.split(spark.range(101).repartition(7), "id"))
    assert splits.split(spark.range(0), "id").count() == 0


def test_ladders(spark):
    df = spark.createDataFrame([(19,), (20,), (50,), (100,)], "n long")
    assert [(r.epochs, r.batch, r.warmup) for r in splits.training_plan(df, "n").collect()] == [(20, 1, 38), (15, 1, 30), (10, 2, 25), (8, 4, 20)]


def test_pickles_are_read_not_loaded(spark):
    data = [("a", pickle.dumps([1])), ("b", b"cos\nsystem\n(S'x'\ntR."), ("c", b"\x80\x04bad"), ("d", None), ("e", pickle.dumps(pytest.approx, protocol=4))]
    got = {r.path: r.risk for r in scan.pickle_scan(spark.createDataFrame(data, "path string, content binary")).collect()}
    assert got == {"a": "safe", "b": "dangerous", "c": "damaged", "d": "damaged", "e": "suspicious"}


def test_pixels(spark):
    import numpy as np

    r = np.random.default_rng(1)
    noise = r.integers(0, 256, (40, 30), dtype=np.uint8)
    smooth = np.tile(np.linspace(0, 255, 30).astype(np.uint8), (40, 1))
    brute = [4 * -int(noise[y, x]) + sum(int(noise[y + a, x + b]) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))) for y in range(1, 39) for x in range(1, 29)]
    assert abs(pixels.laplacian_variance(noise) - np.var(brute)) < 1e-6
    data = [(1, noise.tobytes(), 30, 40), (2, smooth.tobytes(), 30, 40), (3, (noise // 2).tobytes(), 30, 40), (4, None, 1, 1), (5, b"x", 9, 9), (6, b"ab", 2, 1)]
    out = {x.id: x for x in pixels.pixel_metrics(spark.createDataFrame(data, "id long, pixels binary, width int, height int"), "id").collect()}
    assert out[1].blur_score > 1000 > out[2].blur_score and out[4].phash is None and out[5].blur_score is None and out[6].blur_score == 0
    differ = lambda a, b: bin((out[a].phash ^ out[b].phash) & (2**64 - 1)).count("1")
    assert differ(1, 3) <= 5 < differ(1, 2)


def test_near_pairs_of_a_wide_threshold_and_a_hot_group(spark):
    r = np.random.default_rng(6)
    x = r.standard_normal((300, 32))
    x[:100] = x[0] + 0.01 * r.standard_normal((100, 32))  # a third of all rows lie together
    df = spark.createDataFrame([(i, [float(t) for t in v]) for i, v in enumerate(x)], "id long, e array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(1 - u @ u.T <= 0.8, 1)))}
    before, vectors.SALT_ROWS = vectors.SALT_ROWS, 40
    try:
        assert {(p.src, p.dst) for p in vectors.near_pairs(df, "id", "e", 0.8).collect()} == want
    finally:
        vectors.SALT_ROWS = before


def test_hash_keys_hold_only_bits_that_differ(spark):
    """24 bits of 64 differ, the sign among them: every key has bits of its own, and no pair is missed."""
    varying = (1 << 23) - 1 | 1 << 63
    masks = dedup.piece_masks(varying, 5, 3)
    assert len(masks) == 56 and all(m and m & ~varying == 0 for m in masks) and min(m.bit_count() for m in masks) >= 9
    r = random.Random(5)
    hs = sorted({(r.getrandbits(23) | 1 << 40) - r.randrange(2) * (1 << 63) for _ in range(300)})
    got = {(x.src, x.dst) for x in dedup.hash_pairs(spark.createDataFrame([(h,) for h in hs], "h long"), "h", "h").collect()}
    assert got == {(a, b) for a in hs for b in hs if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 5} and got


def test_alike_images_give_few_pairs(spark, monkeypatch):
    """The pass in stretches keeps what a pass over all pairs keeps, and no table holds the pairs of all alike images."""
    seen, cut = [], dedup.cut

    def counted(df, name="step"):
        out = cut(df, name)
        seen.append(out.count())
        return out

    monkeypatch.setattr(dedup, "cut", counted)
    monkeypatch.setattr(dedup, "STRETCH", 64, raising=False)
    r = np.random.default_rng(8)
    people = r.standard_normal((4, 48))
    vecs = [people[k % 4 if k % 9 else 0] + r.standard_normal(48) * (0.1 + 0.1 * (k % 4)) if k % 11 else r.standard_normal(48) for k in range(400)]
    hashes = [None if k % 3 else int(sum(1 << i for i in range(24) if v[i] > 0)) for k, v in enumerate(vecs)]
    vecs = [None if k % 50 == 7 else [float(x) for x in v] for k, v in enumerate(vecs)]
    data = [(k, f"d{k}", h, v, float((k * 37) % 400)) for k, (h, v) in enumerate(zip(hashes, vecs))]
    df = spark.createDataFrame(data, "img long, digest string, h long, v array<double>, q double")
    got = {x.img: x.status for x in dedup.image_duplicates(df, "img", "digest", "h", "v", "q", least_dot=0.8).collect()}

    def near(a, b):
        if hashes[a] is not None and hashes[b] is not None:
            return (hashes[a] ^ hashes[b]).bit_count() <= 5
        return vecs[a] is not None and vecs[b] is not None and np.dot(vecs[a], vecs[b]) >= 0.8 * np.linalg.norm(vecs[a]) * np.linalg.norm(vecs[b])

    kept = []
    for k in sorted(range(400), key=lambda k: -data[k][4]):
        if not any(near(k, x) for x in kept):
            kept.append(k)
    assert {k for k, s in got.items() if s == "kept"} == set(kept) and len(got) == 400
    assert max(seen) <= 4000
