import math
import random

import numpy as np
from pyspark.sql import functions as F

from tramline.llm import topk


def brute(rows, k, every):
    def values(v):
        return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(64 * x) for x in v]

    kept = [(i, w) for i, v in rows if (w := values(v)) is not None and i is not None]
    out = []
    for q in sorted({i for i, _ in kept if i % every == 0}):
        own = min(v for i, v in kept if i == q)
        best = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in kept if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


def test_equals_brute_force(spark):
    r = random.Random(8)
    rows = [(i, [r.gauss(0, 0.2) * (1 + 3 * (d == 0)) for d in range(24)]) for i in range(400)]
    rows += [(1000 + i, [round(r.random() * 2) / 2 - 0.5 for _ in range(24)]) for i in range(100)]  # many ties
    rows += [(40, rows[40][1]), (40, rows[41][1]), (2000, None), (2001, [None, 1.0]), (2002, [math.nan]), (2020, [math.inf]), (2040, [0.5]), (None, [1.0]), (2060, []), (2080, [1e7] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("x"))
    for shard, block in ((8192, 512), (60, 7)):
        v = df.select("vec_id", topk.whole(F.col("embedding")).alias("values"))
        got = sorted(tuple(x) for x in topk.top_k(v, F.col("vec_id") % 20 == 0, 5, shard=shard, block=block).collect())
        assert got == brute(rows, 5, 20)
    few = df.filter("vec_id in (0, 1)").select("vec_id", topk.whole(F.col("embedding")).alias("values"))
    assert topk.top_k(few, F.col("vec_id") == 0, 5).count() == 1
    assert topk.top_k(few.limit(0), F.col("vec_id") == 0, 5).count() == 0


def test_repeated_rows_and_wide_values(spark):
    r = random.Random(9)
    rows = [(20, [0.5, -0.5])] * 150 + [(i, [r.gauss(0, 1), r.gauss(0, 1)]) for i in range(1, 60)] + [(60, [1e5, 1.0]), (80, [1e10, -3.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for shard, block in ((65_536, 512), (40, 1)):
        v = df.select("vec_id", topk.whole(F.col("embedding")).alias("values"))
        got = sorted(tuple(x) for x in topk.top_k(v, F.col("vec_id") % 20 == 0, 7, shard=shard, block=block).collect())
        assert got == brute(rows, 7, 20)


def test_search_prunes_by_the_floor():
    r = np.random.default_rng(3)
    lists = np.round(r.standard_normal((64, 3000)) * np.r_[np.full(6, 40), np.full(58, 1)][:, None])
    ids = np.arange(3000)
    for own in range(0, 200, 10):
        q = lists[:, own]
        at, score = topk.search(q, own, ids, lists, lists.min(1), lists.max(1), 20)
        full = q @ lists
        full[own] = -np.inf
        want = np.lexsort((ids, -full))[:20]
        assert at.tolist() == want.tolist() and score.tolist() == full[want].tolist()


def test_every_vector_moves_once(spark):
    df = spark.range(4000).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: F.pmod(F.xxhash64("id", i), F.lit(100))).alias("values"))
    plan = topk.top_k(df, F.col("vec_id") % 20 == 0)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("RepartitionByExpression") == 1
