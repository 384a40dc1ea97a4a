import random
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from millrace.llm import similarity_clusters as S
from millrace.llm.source_mix import mix_sources
from millrace.llm.target_sample import draw_sample
from millrace.llm.token_ids import BYTE_BPE, TOKENIZERS
from millrace.plans import runtime

SHOT = "img_id long, dataset_id string, image_path string, shot_type string, face_angles string, scanned_ts string"
TARGET = "dataset_id string, field_name string, category string, target_pct int, draw_rows int, min_rows int"


def test_sample_meets_targets_where_it_can(spark):
    r = random.Random(1)
    data = [(i, "d" if i % 3 else "e", f"/{i}", r.choice(["close", "Close shot", "MID", "far_shot", None, "?"]), r.choice(["front", "3/4", "Profile left", ""]), f"2025-01-01 00:00:{i % 60:02d}") for i in range(600)]
    data += [(1000 + i, *x[1:5], "2024-01-01 00:00:00") for i, x in enumerate(data[:50])] + data[:20]
    targets = [("d", "shot_type", c, p, 60, 5) for c, p in (("close", 50), ("mid", 30), ("far", 20))] + [("d", "face_angles", c, p, 60, 5) for c, p in (("front", 40), ("three_quarter", 40), ("profile", 20))] + [("e", "shot_type", "far", 100, 500, 3), ("none", "shot_type", "mid", 100, 10, 1)]
    sample, report = draw_sample(spark.createDataFrame(data, SHOT), spark.createDataFrame(targets, TARGET))
    drawn = [x for x in sample.collect() if x.dataset_id == "d"]
    assert len(drawn) == 60 == len({x.image_path for x in drawn})
    shots = Counter(x.shot_type for x in drawn)
    assert abs(shots["close"] - 30) <= 2 and abs(shots["mid"] - 18) <= 2 and abs(shots["far"] - 12) <= 2
    out = {(x.dataset_id, x.category): x for x in report.collect()}
    assert not out["d", "close"].unmet and out["e", "far"].unmet and out["none", "mid"].unmet and out["none", "mid"].available == 0
    assert sample.where("dataset_id = 'none'").count() == 0


def test_sample_repairs_minimums_and_takes_nulls(spark):
    data = [(i, "d", f"/{i}", "close" if i < 95 else "far", None, None) for i in range(100)] + [(200, None, None, None, None, None)]
    targets = [("d", "shot_type", "close", 100, 20, 0), ("d", "shot_type", "far", 0, 20, 4)]
    sample, report = draw_sample(spark.createDataFrame(data, SHOT), spark.createDataFrame(targets, TARGET))
    assert Counter(x.shot_type for x in sample.collect())["far"] == 4
    empty, left = draw_sample(spark.createDataFrame([], SHOT), spark.createDataFrame(targets, TARGET))
    assert empty.count() == 0 and {x.available for x in left.collect()} == {0}
    assert rows(draw_sample(spark.createDataFrame(data, SHOT), spark.createDataFrame([], TARGET))[1]) == []


@pytest.mark.skipif(not Path(f"{TOKENIZERS}/{BYTE_BPE}").exists(), reason="no tokenizer files here")
def test_mix(spark):
    docs = [(i, "word " * (1 + i % 7), ["Guide", "guide ", "note-book", "Note Book", None][i % 5]) for i in range(200)] + [(0, "word ", "Guide"), (900, None, "guide"), (901, "", "guide")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("m", "guide", 1.0, 2), ("m", "note_book", 1.0, 3), ("m", "absent", 0.5, 9), ("n", "guide", 1.0, 1), ("z", "guide", 0.0, 1)], "mix_id string, source_name string, weight double, max_repeat int")
    mix, report = mix_sources(df, targets)
    out = {(x.mix_id, x.source_name): x for x in report.collect()}
    total = sum(x.n_tokens for x in mix_sources(df, targets, total_tokens=10)[0].limit(0).collect()) or out["n", "guide"].target_tokens
    assert {k for k, x in out.items() if x.short} == {("m", "absent"), ("n", "guide")}
    for k in (("m", "guide"), ("m", "note_book")):
        assert abs(out[k].tokens - out[k].target_tokens) <= 7 and abs(out[k].target_tokens - 0.4 * total) < 1e-6
    assert max(x.copies for x in mix.collect()) <= 3 and out["z", "guide"].tokens == 0
    assert mix_sources(df.limit(0), targets)[0].count() == 0


def groups(vectors, limit=0.6):
    x = np.array(vectors)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    parent = list(range(len(x)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in zip(*np.nonzero(x @ x.T >= limit)):
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(x))]


def test_clusters_match_all_pairs(spark):
    r = np.random.default_rng(4)
    people = r.standard_normal((12, 128))
    vecs = [people[k % 12 if k % 3 else 0] + r.standard_normal(128) * (0.3 + 0.12 * (k % 3)) for k in range(240)] + list(r.standard_normal((40, 128))) + [people[1]] * 3
    faces = [(i, f"/p{i:04d}.jpg", [{"embedding": [float(x) for x in v], "det_score": 0.5}]) for i, v in enumerate(vecs)]
    faces += [(5000, "/none.jpg", None), (5001, "/empty.jpg", []), (5002, "/zero.jpg", [{"embedding": [0.0] * 128, "det_score": 0.1}, {"embedding": None, "det_score": 0.1}, {"embedding": [], "det_score": 0.1}]), (5003, "/short.jpg", [{"embedding": [1.0, 2.0], "det_score": 0.1}]), (5004, "/p0001.jpg", None), (-1, "/p0002.jpg", None)]
    schema = "log_id long, image_path string, faces array<struct<embedding: array<float>, det_score: double>>"
    df = spark.createDataFrame(faces, schema)
    found = S.valid_faces(df)
    parts, links = S.similar_groups(found.select("id", "vec"))
    got = {(x.face_key, x.cluster_key) for x in S.face_clusters(found, parts).collect()}
    keep = [i for i in range(len(vecs)) if i != 1]
    label = groups([np.float32(vecs[i]) for i in keep])
    byk = {}
    for i, g in zip(keep, label):
        byk.setdefault(g, []).append(f"/p{i:04d}.jpg#0")
    assert got == {(k, min(v)) for v in byk.values() if len(v) >= 3 for k in v}
    report = S.cluster_report(found, parts, links).collect()
    assert sum(x.part_size for x in report) == len(got) and all(1 <= len(x.typical) <= 3 for x in report)
    none = S.valid_faces(df.limit(0))
    assert S.face_clusters(none, S.similar_groups(none.select("id", "vec"))[0]).count() == 0


def test_every_candidate_is_verified(spark):
    """1 and 3 are alike; both have a nearer sketch in a decoy."""
    sketch = {1: 0, 2: 0, 3: 63, 4: 63}
    signed = spark.createDataFrame([(i, [7], s, 0, 0, 0) for i, s in sketch.items()], "id long, keys array<long>, s0 long, s1 long, s2 long, s3 long")
    vectors = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.5, 0.0, 0.87]), (3, [0.8, 0.6, 0.0]), (4, [0.0, 0.0, -1.0])], "id long, vec array<float>")
    apart = spark.createDataFrame([(i, i) for i in sketch], "id long, component long")
    assert [(x.src, x.dst) for x in S._between(vectors, apart, S._near_groups(signed, apart), 0.6).collect()] == [(1, 3)]


def test_groups_meet_by_all_their_members(spark, monkeypatch):
    """Of two groups only the last pair of members is alike, in blocks of two rows."""
    monkeypatch.setattr(S, "BLOCK_ROWS", 2)
    vecs = [(i, [1.0, 0.0, 0.01 * i]) for i in range(5)] + [(10 + i, [0.0, 1.0, 0.01 * i]) for i in range(3)] + [(5, [0.9, 0.5, 0.0]), (13, [0.5, 0.9, 0.0])]
    vectors = spark.createDataFrame(vecs, "id long, vec array<float>")
    parts = spark.createDataFrame([(i, 0 if i < 10 else 10) for i, _ in vecs], "id long, component long")
    links = S._between(vectors, parts, spark.createDataFrame([(0, 10)], "src long, dst long"), 0.8)
    assert {(x.src, x.dst) for x in links.collect()} == {(13, 5)}


def test_medoids_by_all_alike_and_for_every_member(spark):
    """A chain of twelve needs four medoids at least; a hub with the greatest id is the medoid though all links hang on the least one."""
    e = np.eye(20)
    vecs = [e[i] + e[i + 1] + e[i + 2] for i in range(12)] + [0.7 * e[19] + 0.714 * e[i] for i in range(4)] + [e[19]]
    faces = spark.createDataFrame([(i, f"f{i:02d}", [float(x) for x in v]) for i, v in enumerate(vecs)], "id long, face_key string, vec array<float>")
    parts = spark.createDataFrame([(i, 0 if i < 12 else 12) for i in range(17)], "id long, component long")
    links = spark.createDataFrame([(12, i, 0.7) for i in range(13, 17)], "src long, dst long, cosine double")
    got = S.cluster_report(faces, parts, links).collect()
    chain = [x for x in got if x.cluster_key == "f00"]
    assert len(chain) >= 4 and max(x.part_size for x in chain) <= 3 and sum(x.part_size for x in chain) == 12
    assert [x.medoid for x in got if x.cluster_key == "f12"] == ["f16"]


def test_tables_of_rounds_are_removed(spark):
    """What only one round reads isn't kept on disk after it."""
    folder = Path(runtime._tables(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    r = np.random.default_rng(3)
    vecs = runtime.cut(spark.createDataFrame([(i, [float(x) for x in np.eye(24)[i % 4] + 0.02 * r.standard_normal(24)]) for i in range(60)], "id long, vec array<float>"))
    groups, _ = S.similar_groups(vecs)
    assert groups.count() == 60 and groups.select("component").distinct().count() == 4
    kept = {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before}
    assert not kept & {"signatures", "sums", "centroids", "slice", "near-groups", "near", "sizes"}


def test_shuffle_files_go_when_a_table_is_cut(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: sum(".data" in str(disk.getAllFiles().apply(i)) for i in range(disk.getAllFiles().size()))
    before = files()
    for i in range(5):
        runtime.cut(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(25):  # they are removed in the background
        if files() <= before:
            return
        time.sleep(0.2)
    assert False, (before, files())


def test_packed_vectors_are_the_same(spark, monkeypatch):
    """Sixteenths take a byte a number on disk, any float comes back as it was, and groups in slices are those of lists."""
    r = np.random.default_rng(5)
    x = np.concatenate([r.integers(-100, 100, (4, 24)) / 16, r.standard_normal((3, 24)), r.integers(-30000, 30000, (2, 24)), np.zeros((1, 24)), np.full((1, 24), 1e30)]).astype(np.float32)
    held = S.pack(x)
    assert (S._vectors(held) == x).all() and (S._vectors(held.slice(2, 6)) == x[2:8]).all() and set(S._lengths(held)) == {24}
    assert [len(v.as_py()) for v in held] == [26] * 4 + [98] * 3 + [50] * 2 + [26, 98]
    monkeypatch.setattr(S, "SLICE_VECTORS", 20)
    people = r.integers(-40, 40, (4, 48))
    vecs = [[float(v) / 16 for v in people[i % 4] + r.integers(-9, 9, 48)] for i in range(60)] + [[1.5, -0.25]]
    data = [(i, f"p{i:02d}", [{"embedding": v}, {"embedding": None}]) for i, v in enumerate(vecs)] + [(99, "p03", None)]
    found = S.valid_faces(spark.createDataFrame(data, "log_id long, image_path string, faces array<struct<embedding: array<float>>>"))
    assert {len(x.vec) for x in found.collect()} == {50, 4} and found.count() == 60
    parts = S.face_clusters(found, S.similar_groups(found.select("id", "vec"))[0]).collect()
    assert {(x.face_key, x.cluster_key) for x in parts} == {(f"p{i:02d}#0", f"p{i % 4 if i % 4 < 3 else 7:02d}#0") for i in range(60) if i != 3}
