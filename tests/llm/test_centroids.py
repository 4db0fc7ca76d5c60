import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tramline.llm import centroids


def brute(rows, k=16, rounds=3, dims=64):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(64 * x) for x in v]))
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    cs = [list(v) for _, v in order[:k]]
    if not cs:
        return []

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cs))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(cs)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                cs[j] = [sum(c) // len(mine) for c in zip(*mine)]
    last = [near(v) for _, v in kept]
    inertia = [sum(d for d, j in last if j == c) for c in range(len(cs))]
    mark = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return [(i, j, d, inertia[j], sum(inertia), mark[j]) for (i, _), (d, j) in zip(kept, last)]


def got(df, **more):
    return sorted((tuple(r)[:6] for r in centroids.cluster(df, **more).collect()), key=str)


def test_equals_brute_force_with_odd_rows(spark):
    r = random.Random(5)
    heart = [[r.gauss(0, 3) for _ in range(8)] for _ in range(6)]
    rows = [(i, [x + r.gauss(0, 0.4) for x in heart[i % 6]]) for i in range(900)]
    rows += [(2000 + i, [float(r.randint(-1, 1)) / 64 for _ in range(8)]) for i in range(300)]  # ties and repeats
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (5000, None), (5001, [1.0] * 7), (5002, [None] + [0.0] * 7), (5003, [math.nan] * 8), (5004, [math.inf] * 8), (5005, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("x")).withColumn("cluster", F.lit(9)).repartition(5)
    for k, rounds in ((16, 3), (1, 2), (5, 6)):
        assert got(df, k=k, rounds=rounds, dims=8) == sorted(brute(rows, k, rounds, 8), key=str)
    scans = centroids.cluster(df, k=6, rounds=6, dims=8).agg(F.sum("scans"), F.count("*")).first()
    assert scans[0] < 5 * scans[1]  # bounds spare most of the seven scans


def test_one_spot_few_rows_and_none(spark):
    same = [(i, [0.5] * 4) for i in range(50)] + [(None, [0.5] * 4)]
    schema = "vec_id long, embedding array<float>"
    assert got(spark.createDataFrame(same, schema), dims=4) == sorted(brute(same, dims=4), key=str)
    few = [(1, [1.0, 2.0]), (2, [-1.0, 0.25])]
    assert got(spark.createDataFrame(few, schema), dims=2) == sorted(brute(few, dims=2), key=str)
    for none in ([], [(None, [1.0, 1.0])], [(1, None)]):
        assert got(spark.createDataFrame(none, schema), dims=2) == []


def test_very_large_components_are_exact(spark):
    r = random.Random(2)
    rows = [(i, [r.choice([1e6, 3e9, -7e7]) + r.random() for _ in range(3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    top = 2**63 - 1
    want = [(i, j, min(d, top), min(c, top), min(a, top), m) for i, j, d, c, a, m in brute(rows, 4, 3, 3)]
    assert got(df, k=4, dims=3) == sorted(want, key=str)
    wild = spark.createDataFrame([(i, [1e300 if i % 2 else -1e300, 1.7e308, 0.0]) for i in range(4)], "vec_id long, embedding array<double>")
    assert centroids.cluster(wild, k=2, dims=3).count() == 0  # 64 * 1.7e308 is not finite
    wild = spark.createDataFrame([(i, [1e300 if i % 2 else -1e300, 0.0]) for i in range(4)], "vec_id long, embedding array<double>")
    assert centroids.cluster(wild, k=2, dims=2).count() == 4


def test_loosening_is_a_bound_and_less_than_the_drift():
    rnd = np.random.default_rng(1)
    spared = 0
    for _ in range(300):
        d = int(rnd.integers(1, 6))
        old, centre = rnd.normal(0, 4, d), rnd.normal(0, 4, d)
        new = old + rnd.normal(0, rnd.choice([0.01, 1, 5]), d)
        radius = float(rnd.choice([0.0, 0.1, 1, 6]))
        x = rnd.normal(0, 1, (400, d))
        x = centre + x / np.linalg.norm(x, axis=1, keepdims=True) * radius * rnd.random((400, 1))
        gain = np.linalg.norm(x - old, axis=1) - np.linalg.norm(x - new, axis=1)
        got, drift = centroids.nearer(old, new, centre, radius), np.linalg.norm(new - old)
        assert gain.max() <= got + 1e-9 and got <= drift + 1e-12
        spared += got < drift / 2
    assert spared > 50


def test_query_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from tramline.llm.queries import QUERIES, SQL

    sf = "/root/testdata/sf0.001"
    rows = QUERIES["op11_centroids"](spark, sf).drop("scans").collect()
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = con.execute(SQL["op11_centroids"]).fetchall()
    names = [d[0] for d in con.description]
    assert sorted(tuple(r[n] for n in names) for r in rows) == sorted(want)
