"""Registered queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm import bpe, centroids, guesses, langid, lm, ngram, pack, pii, rollup, rules, topk, toxic, variants
from tramline.llm.common import crc_mod, table
from tramline.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def queries() -> dict:
    import corpus_pipeline

    return QUERIES | {"pipeline": corpus_pipeline.run}


def sql() -> dict:
    import corpus_pipeline

    return SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.join(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


@query
def op2_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = rules.statistics(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    path = scratch_path(spark, "rules")
    stats.write.parquet(path)  # read for the cutoffs and for the verdicts
    got = rules.judge(spark.read.schema(stats.schema).parquet(path), table(spark, sf_dir, "labels"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


@query
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["kind"].isin(*pii.BASE))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    n = [F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in pii.BASE]  # noqa: B023
    return found.select("doc_id", *n, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


@query
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    load = bpe.loader(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), load).drop("text")
    return bpe.decode(ids, load).select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack.pack(table(spark, sf_dir, "documents"), pack.loader(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op6_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.whole(F.col("embedding")).alias("values"))
    found = topk.top_k(vectors, F.col("vec_id") % 20 == 0, 20)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


SQL["op6_maxscore"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""


@query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    model = langid.fit(docs.filter(~held_out))
    return langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model)


@query
def op8_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 7) == 2
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return lm.score(rows, ~F.col("held_out"), pack.loader(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN))


@query
def op9_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in one batch, which is sent twice; those labelled of low quality are deleted; those with
    repeated lines are revised to their distinct lines."""
    files = {"byte_bpe_50k": "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k": "byte_bpe_multi_50k.tiktoken"}
    load = rollup.loader({k: public_tokenizers.path(v) for k, v in files.items()}, public_tokenizers.PATTERN)
    docs = table(spark, sf_dir, "documents")
    lines = F.split("text", "\n")
    once = docs.filter(F.size(F.array_distinct(lines)) < F.size(lines)).withColumn("text", F.array_join(F.array_distinct(lines), "\n"))
    r = rollup.Rollup(spark, scratch_path(spark, "rollup"), load, list(files))
    r.commit("1-load", inserts=docs)
    r.commit("1-load", inserts=docs)
    r.commit("2-drop", deletes=table(spark, sf_dir, "labels").filter("quality = 0"))
    r.commit("3-revise", revised=once)
    return r.totals()


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents").select("doc_id", "text"), crc_mod(F.col("doc_id"), 5) == 0
    model = toxic.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxic.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model)


@query
def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _rounds(k: int, rounds: int, dims: int) -> str:
    """SQL of the plain rounds over table v (row, vec_id, x list of whole numbers)."""
    sql = f"""
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: floor(64 * CAST(e AS DOUBLE))) AS x
  FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS (
  SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS INTEGER) AS cluster, x
  FROM v WHERE vec_id IS NOT NULL ORDER BY sha256('1:' || vec_id), x LIMIT {k})"""
    for i in range(rounds + 1):
        sql += f""",
d{i} AS MATERIALIZED (
  SELECT row, vec_id, v.x, cluster,
         CAST(list_dot_product(v.x, v.x) - 2 * list_dot_product(v.x, c.x) + list_dot_product(c.x, c.x) AS BIGINT) AS distance
  FROM v, c{i} c),
a{i} AS MATERIALIZED (
  SELECT row, any_value(vec_id) AS vec_id, any_value(x) AS x, min({{'d': distance, 'j': cluster}}) AS best FROM d{i} GROUP BY row)"""
        if i < rounds:
            sql += f""",
m{i} AS (
  SELECT best.j AS cluster, pos, floor(sum(val) / count(*)) AS val
  FROM (SELECT best, unnest(x) AS val, generate_subscripts(x, 1) AS pos FROM a{i}) GROUP BY best.j, pos),
n{i} AS (SELECT cluster, list(val ORDER BY pos) AS x FROM m{i} GROUP BY cluster),
c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(n.x, c.x) AS x FROM c{i} c LEFT JOIN n{i} n ON n.cluster = c.cluster)"""
    return sql + f"""
SELECT a.vec_id, a.best.j AS cluster, a.best.d AS distance,
       CAST(sum(a.best.d) OVER (PARTITION BY a.best.j) AS BIGINT) AS cluster_inertia, CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(c.x, lambda e: CAST(CAST(e AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.best.j"""


SQL["op11_centroids"] = _rounds(16, 3, 64)


@query
def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = guesses.find(docs, guesses.vocabulary(docs))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    n = [F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in guesses.KINDS]  # noqa: B023
    base = F.filter("found", lambda s: s["kind"].isin(*guesses.BASE))
    return found.select("doc_id", *n, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


@query
def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(variants.words(table(spark, sf_dir, "documents"), every=97, letters=5, least=3), ratio=2)
