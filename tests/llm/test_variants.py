import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tramline.llm import variants


def brute_words(rows, every=97, letters=5, least=3):
    n = Counter()
    for i, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in r)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % every == 0:
                w = "".join(c for p, c in enumerate(w) if p != h % len(w))
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= letters and k >= least}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    s, t = sorted((a, b), key=len)
    return any(t[:i] + t[i + 1 :] == s for i in range(len(t)))


def brute(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(((-n[v], v) for v in vs), default=None)
        form[w] = best[1] if best and -best[0] >= 2 * n[w] else None
    out = []
    for w in n:
        r = w
        while form[r]:
            r = form[r]
        out.append((w, form[w], r, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("few", [0, 1, 16])
def test_group_equals_brute_force(spark, few):
    r = random.Random(few)
    n = {}
    for _ in range(500):
        w = "".join(r.choice("abñ") for _ in range(r.randint(5, 9)))
        n[w] = r.choice([3, 3, 5, 6, 12, 25, 100])
    n |= {"prefix" + "".join(r.choice("abcdefg") for _ in range(3)): r.randint(3, 9) for _ in range(80)}
    n |= {"schneider" + "x" * i: 3 * 2**i for i in range(12)}  # a long chain
    df = spark.createDataFrame(list(n.items()), "word string, n long").withColumn("form", F.lit("?"))
    want = brute(n)
    assert rows(variants.group(df, few=few)) == want
    assert len({x[2] for x in want}) < len(want) and max(x[4] for x in want) > 5
    pairs = variants.near(df, few).select("a", "b").collect()
    assert len(pairs) == len({frozenset(p) for p in pairs}) == sum(x[4] for x in want) // 2


def test_hot_chunk_makes_no_square_of_pairs(spark):
    r = random.Random(1)
    ws = {"overall" + "".join(r.choice("abcdefghijklmnopqrst") for _ in range(7)) for _ in range(3000)}
    df = spark.createDataFrame([(w, 3) for w in ws], "word string, n long")
    assert variants.near(df).count() == sum(one_edit(a, b) for a, b in _neighbours(ws))
    keys = variants._rows(df, grams=False).groupBy("key").count().agg(F.max("count")).first()[0]
    assert keys == len(ws)


def _neighbours(ws):
    by = defaultdict(set)
    for w in ws:
        for i in range(len(w)):
            by[i, w[:i] + w[i + 1 :]].add(w)
    return {(a, b) for v in by.values() for a in v for b in v if a < b}


def test_words_of_documents(spark, frame):
    r = random.Random(4)
    pool = ["Stadtbahn", "stadtbahn", "straße", "ÉCOLE", "école", "tramway", "Tramwáy", "tram", "x×y÷zab", "naïve"]
    texts = [" ".join(r.choice(pool) for _ in range(30)) + r.choice(["", "\n1a2b", "É" * 7]) for _ in range(120)] + [None, "", "word" * 30_000, "a " * 5]
    df = frame(texts)
    data = [(x["doc_id"], x["text"]) for x in df.select("doc_id", "text").collect()]
    odd = [(None, "tramwaystadt tramwaystadt tramwaystadt"), (None, "tramwaystadt"), (5, "tramway " * 40), (5, "tramway " * 40)]
    data += odd
    df = df.select("doc_id", "text", F.lit("w").alias("word"), F.lit(1).alias("n")).union(spark.createDataFrame([(*o, "w", 1) for o in odd], "doc_id long, text string, word string, n int"))
    for every in (97, 3):
        want = brute_words(data, every)
        assert {x["word"]: x["n"] for x in variants.words(df, every).collect()} == want
        assert rows(variants.group(variants.words(df, every))) == brute(want)


def test_no_words(spark, frame):
    assert variants.group(variants.words(frame([None, "", "1 2 3"]))).collect() == []
    assert variants.group(variants.words(frame([]))).collect() == []


def test_query_equals_brute_force(spark):
    from tramline.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    n = brute_words(docs)
    near = defaultdict(set)
    by = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            by[w[:i] + w[i + 1 :]].add(w)
        by[w].add(w)
    for v in by.values():
        for a in v:
            near[a] |= {b for b in v if one_edit(a, b)}
    got = {r["word"]: r for r in QUERIES["op13_variants"](spark, sf).collect()}
    assert set(got) == set(n)
    for w, r in got.items():
        best = min(((-n[v], v) for v in near[w]), default=None)
        takes = best is not None and -best[0] >= 2 * n[w]
        assert (r["n"], r["n_near"], r["form"], r["form_n"]) == (n[w], len(near[w]), best[1] if takes else None, -best[0] if takes else None)
        root = w
        while got[root]["form"]:
            root = got[root]["form"]
        assert r["root"] == root
