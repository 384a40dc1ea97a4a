import random

from conftest import rows
from pyspark.sql import functions as F

from millrace.operators.dedup import maximal_independent
from millrace.plans.graph import connected_components
from millrace.plans.ranges import placed, prefix_sums
from millrace.plans.runtime import cut, hot_join, once, shared_dir


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components_match_union_find(spark):
    r = random.Random(3)
    for n, m in ((30, 15), (60, 80), (40, 10)):
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)]
        df = spark.createDataFrame(edges, "src long, dst long")
        assert dict(rows(connected_components(df))) == union_find([e for e in edges if e[0] != e[1]])


def test_components_of_a_chain_a_hub_and_nothing(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(64)], "src long, dst long")
    assert {c for _, c in rows(connected_components(chain))} == {0}
    hub = spark.createDataFrame([(7, i) for i in range(8, 400)] + [(None, 3)], "src long, dst long")
    assert {c for _, c in rows(connected_components(hub))} == {7}
    assert connected_components(chain.limit(0)).count() == 0


def test_components_of_strings(spark):
    df = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "x")], "src string, dst string")
    assert rows(connected_components(df)) == [("a", "a"), ("b", "a"), ("c", "a")]


def test_prefix_sums_with_a_hot_group_and_nulls(spark):
    r = random.Random(5)
    data = [("hot" if i % 3 else r.choice(["a", None, "b"]), i, r.choice([None, 1, 2, 5])) for i in range(400)]
    got = rows(prefix_sums(spark.createDataFrame(data, "g string, o long, n long"), ["g"], ["o"], "n", "upto"))
    want, sums = [], {}
    for g, o, n in sorted(data, key=lambda x: x[1]):
        sums[g] = sums.get(g, 0) + (n or 0)
        want.append((g, o, n, sums[g]))
    assert got == sorted(want, key=repr)
    assert prefix_sums(spark.createDataFrame([], "g string, o long, n long"), ["g"], ["o"], "n", "upto").count() == 0


def test_greedy_keepers_match_the_loop(spark):
    r = random.Random(9)
    for _ in range(3):
        n = 25
        edges = [(a, b) for a in range(n) for b in range(a) if r.random() < 0.12]
        kept = set()
        for k in range(n):
            if not any((min(k, o), max(k, o)) in {(min(e), max(e)) for e in edges} for o in kept):
                kept.add(k)
        nodes = spark.createDataFrame([(k, k * 10) for k in range(n)], "k long, o long")
        got = maximal_independent(nodes, spark.createDataFrame(edges, "src long, dst long"), "k", "o")
        assert {x for (x,) in rows(got)} == kept


def test_cut_and_once(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, "b")], "k long, v string")
    assert rows(once(df, "k")) == [(1, "a"), (None, "b")]
    assert rows(cut(df)) == rows(df) and shared_dir(spark)


def test_places_of_a_hot_group(spark):
    r = random.Random(4)
    data = [("hot" if r.random() < 0.5 else r.choice(["a", "b", None]), r.randrange(50), i, f"t{i}") for i in range(4000)]
    df = spark.createDataFrame(data, "g string, o int, id long, i string")
    got = placed(df, ["g"], ["o", "id"], "at", {"after": "i"}, total="n")
    want = {}
    for g in ("hot", "a", "b", None):
        mine = sorted((x for x in data if x[0] == g), key=lambda x: x[1:3])
        want |= {x[2]: (k, mine[k + 1][3] if k + 1 < len(mine) else None, len(mine)) for k, x in enumerate(mine)}
    assert {x.id: (x.at, x.after, x.n) for x in got.collect()} == want and got.columns == ["g", "o", "id", "i", "at", "after", "n"]
    assert [x.at for x in placed(df, [], ["o", "id"], "at").orderBy("o", "id").collect()] == list(range(4000))
    assert placed(df.limit(0), ["g"], ["o"], "at", {"after": "i"}).count() == 0


def test_hot_join(spark):
    big = spark.range(9000).select(F.when(F.col("id") < 6000, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    small = spark.createDataFrame([("hot", 1, 6000), ("hot", 2, 6000), ("7000", 4, 1), ("none", 3, 0)], "k string, v int, n int")
    got = hot_join(big, small, ["k"], "n", 9000)
    assert got.count() == 12_001 and sorted(got.columns) == ["id", "k", "v"] and hot_join(big.limit(0), small, ["k"], "n", 0).count() == 0


def test_no_task_holds_a_hot_group(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("g"), "id")
        parts = df.repartitionByRange(16, "g", "id").groupBy(F.spark_partition_id().alias("p"), "g").count().where("g = 'hot'").collect()
        assert placed(df, ["g"], ["id"], "at").where("g = 'hot'").agg(F.max("at")).first()[0] == 9_999
        assert max(x["count"] for x in parts) < 20_000 / 5
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
