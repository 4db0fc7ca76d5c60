"""Exact top-k search by MaxScore over whole-number vectors.

Every dimension is a query term. In a shard of candidates a term's contribution lies between bounds that follow from
the shard's least and greatest value there. The k-th best of some promising candidates, scored in full, is the floor. Terms are
split by the floor: the non-essential ones are the most terms, those of the narrowest bounds first, that alone could not lift a candidate from its
least score to the floor. The postings of the essential terms are traversed for all candidates and summed; a candidate stays competitive
while its sum and the upper bounds of all other terms reach the floor. The others are probed for competitive candidates
only, widest first, and dropped ones never come back. Shards are searched apart and their
best k merged, which is exact as the order (score, then smaller id) is total.

Candidates are packed where they are read, in the fewest bytes that hold them, and each pack moves once, to its shard. Blocks of queries
stream past the shard one after another, so a task holds one shard and one block, never pairs of rows.

Defined cases: vectors that are null or hold null or non-finite components take no part; vectors of unequal length are
filled with zeros; an id that occurs more than once is queried with the least of its vectors and is a
candidate in each row, but never for itself; an empty table gives no rows. Components are clipped to 63 bits and scores
are exact while they fit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.llm.common import slices

SHARD, BLOCK, PACK, STEP = 65_536, 512, 1024, 8
_PACKED = "shard int, block int, ids binary, data binary, dims int"


def whole(embedding: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component; null where a component is null or not finite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(embedding.isNotNull() & ~bad, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _packed(ids: np.ndarray, lists: pa.Array) -> tuple[bytes, bytes, int]:
    """Ids, matrix and dimensions of some vectors; the matrix has two, four or eight bytes a component."""
    lens = lists.value_lengths().to_numpy()
    flat, dims = lists.flatten().to_numpy(), int(lens.max(initial=0))
    ends = max(abs(int(flat.min(initial=0))), abs(int(flat.max(initial=0))))
    m = np.zeros((len(lens), dims), "<i2" if ends < 1 << 15 else "<i4" if ends < 1 << 31 else "<i8")
    m[np.repeat(np.arange(len(lens)), lens), np.arange(len(flat)) - np.repeat(lens.cumsum() - lens, lens)] = flat
    return ids.astype("<i8").tobytes(), m.tobytes(), dims


def _packs(df: DataFrame, step: int, shards: int | None) -> DataFrame:
    """Packs of at most ``step`` rows (id, v) of a task: of candidates, dealt to shards in turn, or of queries in blocks, without ``shards``."""

    def run(batches):
        n = TaskContext.get().partitionId()
        for b in slices(batches, step):
            ids, data, dims = _packed(b.column(0).to_numpy(zero_copy_only=False), b.column(1))
            row = {"shard": n % shards if shards else -1, "block": 0 if shards else 1, "ids": ids, "data": data, "dims": dims}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("ids", pa.binary()), ("data", pa.binary()), ("dims", pa.int32())]))
            n += 1

    return df.select("id", "v").mapInArrow(run, _PACKED)


def _matrix(ids: bytes, data: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, "<i8")
    return i, np.frombuffer(data, f"<i{len(data) // (len(i) * dims)}" if dims else "<i8").reshape(len(i), dims)


def _joined(packs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a shard in order and its posting lists, one per dimension."""
    ids, dims = np.concatenate([i for i, _ in packs]), max(m.shape[1] for _, m in packs)
    lists = np.zeros((dims, len(ids)), max((m.dtype for _, m in packs), key=lambda d: d.itemsize))
    at = 0
    for i, m in packs:
        lists[: m.shape[1], at : at + len(i)] = m.T
        at += len(i)
    return ids, lists


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def search(query: np.ndarray, own: int, ids: np.ndarray, by_dim: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, scores) of the best ``k`` candidates of one shard; ``by_dim`` holds one posting list per dimension."""
    ends = np.stack([query * low, query * high])
    upper, width = ends.max(0), np.abs(ends[1] - ends[0])
    order = np.argsort(-width, kind="stable")
    rest = upper[order][::-1].cumsum()[::-1]  # bound of the terms from a place on
    spare = width[order][::-1].cumsum()[::-1]  # by how much they can lift a candidate
    alive = np.flatnonzero(ids != own)
    if len(alive) > k:
        lead = (query[order[:STEP]] @ by_dim[order[:STEP]])[alive]
        seed = np.argpartition(-lead, min(len(lead) - 1, 4 * k))[: 4 * k]
        full = query @ by_dim[:, alive[seed]]
        floor = np.partition(full, len(full) - k)[len(full) - k]
        # essential: terms until the rest alone cannot lift a candidate from its least score to the floor
        at = max(STEP, int(np.count_nonzero(spare >= floor - ends.min(0).sum())))
        total = lead + (query[order[STEP:at]] @ by_dim[order[STEP:at]])[alive]
        while True:
            bound = rest[at] if at < len(order) else 0
            keep = total + bound >= floor
            alive, total = alive[keep], total[keep]
            if at >= len(order):
                break
            terms = order[at : at + STEP]
            total = total + query[terms] @ by_dim[np.ix_(terms, alive)]
            at += STEP
    else:
        total = (query @ by_dim)[alive]
    best = _best(total, ids[alive], k)
    return alive[best], total[best]


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", value: str = "values", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, id, score) of each query row against every other row of ``vectors``; ``value`` is an array of long."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(value).alias("v"), is_query.alias("q")).filter(F.col("v").isNotNull() & F.col("id").isNotNull())
    n, step = rows.count(), min(PACK, shard)
    # small tables give every core a shard
    shards = max(-(-n // shard), min(-(-n // step), spark.sparkContext.defaultParallelism), 1)
    asked = rows.filter("q").groupBy("id").agg(F.min("v").alias("v"))
    blocks = _packs(asked, block, None).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    met = _packs(rows, step, shards).union(blocks.select("shard", "block", "ids", "data", "dims")).repartitionById(shards, F.col("shard")).sortWithinPartitions("block")

    def run(batches):
        packs, ids, lists, peak = [], None, None, 0.0
        for b in slices(batches, 1):
            _, is_block, *pack = (c[0].as_py() for c in b.columns)
            some = _matrix(*pack)
            if not is_block:
                packs.append(some)
                continue
            if not packs and ids is None:
                return  # more shards than packs
            if ids is None:
                ids, lists = _joined(packs)
                packs.clear()
                peak = max(-float(lists.min(initial=0)), float(lists.max(initial=0)), 1.0)
                held = {}
            dims = min(len(lists), some[1].shape[1])
            qs = some[1][:, :dims]
            most = peak * max(-float(qs.min(initial=0)), float(qs.max(initial=0)), 1.0) * max(1, dims)
            kind = "f8" if most < 2**52 else "i8"  # sums of whole numbers below 2^53 are exact in doubles, and faster
            if kind not in held:
                held.clear()
                by_dim = lists.astype(kind)
                held[kind] = by_dim, by_dim.min(1), by_dim.max(1)
            by_dim, low, high = (x[:dims] for x in held[kind])
            out = [(q, *search(v, q, ids, by_dim, low, high, k)) for q, v in zip(some[0].tolist(), qs.astype(kind))]
            yield pa.RecordBatch.from_pydict(
                {
                    "query_id": pa.array(np.concatenate([np.full(len(at), q) for q, at, _ in out]).astype("i8")),
                    "id": pa.array(np.concatenate([ids[at] for _, at, _ in out]).astype("i8")),
                    "score": pa.array(np.concatenate([s for _, _, s in out]).astype("i8")),
                }
            )

    found = met.mapInArrow(run, "query_id long, id long, score long")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
