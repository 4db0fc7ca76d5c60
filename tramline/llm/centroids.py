"""Clustering around k centroids with lower bounds that geometry loosens by less than the full drift.

Vectors lie in blocks, and a vector keeps its centroid, an upper bound of the distance to it and a lower bound of the
distance to every other centroid. When centroids have moved, the upper bound grows by the move of the own one. The
lower bound of the vectors of centroid i, which all lie in a sphere around its old place, shrinks by what any other
centroid j can have come nearer to any place in that sphere. With m the middle of the way of j, that is at most
``|way| * cos(a)`` where a is the angle at m between the way and the place, because

    d(x, old) - d(x, new) = 2 |way| (height of x over m) / (d(x, old) + d(x, new)), and the sum is at least 2 d(x, m).

The greatest cosine over the sphere is read off the plane through m, the way and the centre of the sphere: the angle
of the centre less the half angle of the sphere. A centroid that moves across or away loosens nothing. A vector whose
bounds still part its centroid from the others is not looked at; else its own distance is taken exactly, and if
that does not help, all its distances are.

Centroids are whole vectors: floor(sum / count) by exact sums. Only the sums of vectors that changed their centroid
are gathered. The k centroids, their sums and radii (k times the dimensions) are the only things that reach the
driver; every pass is written to the shared folder, and the pass before the last is deleted.

Defined cases: vectors that are null, of another length, or hold null or non-finite components take no part; null ids
take part but start no centroid; rows that repeat an id are vectors of their own, and as starts they are taken in the
order of their components; with fewer vectors than centroids there are as many centroids as vectors with an id, and
without any there are no rows; centroids without vectors stay where they are; distances that do not fit 63
bits are given as the greatest that does, though compared exactly; components beyond 2^53 are held there.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.llm.common import slices
from tramline.session import drop_path, scratch_path

BLOCK = 4096
#: bounds are widened by this share of the greatest distance in play, far more than doubles can be off
SLACK = 1e-9
#: below this size all terms of a squared distance over 64 dimensions are exact in doubles
PLAIN = 2.0**22
_TOP = 2**63 - 1
_FAR = 2.0**53
_BLOCKS = (
    "ids array<bigint>, kind string, vectors binary, own binary, upper binary, lower binary, scans binary, "
    "parts array<struct<cluster:int,n:bigint,high:array<bigint>,low:array<bigint>,radius:double,distance:decimal(38,0)>>"
)


@dataclass(frozen=True)
class Move:
    """Centroids of a pass and what their move since the pass before does to the bounds of each cluster."""

    centroids: tuple[tuple[int, ...], ...]
    grow: tuple[float, ...] = ()
    shrink: tuple[float, ...] = ()
    #: least distance from each centroid to another one
    apart: tuple[float, ...] = ()
    slack: float = 0.0


def nearer(old: np.ndarray, new: np.ndarray, centre: np.ndarray, radius: float) -> float:
    """At most how much nearer ``new`` is than ``old`` to any place within ``radius`` of ``centre``."""
    way = new - old
    length = float(np.sqrt(way @ way))
    if length == 0:
        return 0.0
    off = centre - (old + new) / 2
    reach = float(np.sqrt(off @ off))
    if reach <= radius:
        return length
    cos = min(1.0, max(-1.0, float(off @ way) / (reach * length)))
    angle = np.arccos(cos) - np.arcsin(min(1.0, radius / reach))
    return length * max(0.0, float(np.cos(max(0.0, angle))))


def move(before: list[list[int]], after: list[list[int]], radius: list[float]) -> Move:
    a, b = np.array(before, "f8"), np.array(after, "f8")
    k = len(a)
    gaps = np.sqrt(((b[:, None, :] - b[None, :, :]) ** 2).sum(2)) + np.diag(np.full(k, np.inf))
    slack = SLACK * (1 + float(np.abs(a).max()) + float(np.abs(b).max()) + max(radius, default=0.0)) * a.shape[1]
    grow = np.sqrt(((b - a) ** 2).sum(1)) + slack
    shrink = [max((nearer(a[j], b[j], a[i], radius[i] + slack) for j in range(k) if j != i), default=0.0) + slack for i in range(k)]
    return Move(tuple(map(tuple, after)), tuple(grow.tolist()), tuple(shrink), tuple(gaps.min(1).tolist()), slack)


def squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of ``v`` to rows of ``c``, both whole: doubles where they are exact, else objects."""
    peak = max(float(np.abs(v).max(initial=0)), float(np.abs(c).max(initial=0)))
    if peak * max(1.0, (v.shape[1] / 64) ** 0.5) < PLAIN:
        return (v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)[None, :]
    w, x = [[int(y) for y in r] for r in v.tolist()], [[int(y) for y in r] for r in c.tolist()]
    out = np.empty((len(w), len(x)), object)
    for i, r in enumerate(w):
        for j, s in enumerate(x):
            out[i, j] = sum((p - q) ** 2 for p, q in zip(r, s))
    return out


def _own_squares(v: np.ndarray, c: np.ndarray, own: np.ndarray) -> np.ndarray:
    out = None
    for j in range(len(c)):
        at = np.flatnonzero(own == j)
        d = squares(v[at], c[j : j + 1])[:, 0]
        if out is None:
            out = np.zeros(len(v), d.dtype)
        elif d.dtype == object and out.dtype != object:
            out = out.astype(object)
        out[at] = d
    return out


def _roots(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype("f8"))


def assign(v: np.ndarray, c: np.ndarray, step: Move, own: np.ndarray | None, upper: np.ndarray, lower: np.ndarray, scans: np.ndarray) -> np.ndarray:
    """Nearest centroid of each row; bounds and numbers of full scans are changed in place."""
    if own is None:
        own, unsure = np.zeros(len(v), "i4"), np.arange(len(v))
    else:
        own = own.copy()
        upper += np.array(step.grow)[own]
        lower -= np.array(step.shrink)[own]
        apart = np.array(step.apart)[own]
        unsure = np.flatnonzero((upper >= lower - step.slack) & (2 * upper >= apart - step.slack))
        upper[unsure] = _roots(_own_squares(v[unsure], c, own[unsure])) if len(unsure) else 0.0
        unsure = unsure[(upper[unsure] + step.slack >= lower[unsure]) & (2 * upper[unsure] + step.slack >= apart[unsure])]
    if len(unsure):
        d = squares(v[unsure], c)
        best = d.argmin(1)
        at = np.arange(len(unsure))
        own[unsure], upper[unsure] = best, _roots(d[at, best])
        if len(c) > 1:
            rest = d.copy()
            rest[at, best] = d.max() + 1
            lower[unsure] = _roots(rest.min(1))
        else:
            lower[unsure] = np.inf
        scans[unsure] += 1
    return own


def _sums(v: np.ndarray) -> tuple[list[int], list[int]]:
    """Sums of whole columns in two parts, multiples of 2^32 and rest, that fit long."""
    high = np.floor(v / 2.0**32)
    return high.astype("i8").sum(0).tolist(), (v - high * 2.0**32).astype("i8").sum(0).tolist()


def _parts(v: np.ndarray, own: np.ndarray, before: np.ndarray | None, upper: np.ndarray, dist: np.ndarray | None) -> list[dict]:
    """What the block adds to each cluster: vectors that came less those that went, radius, and distances if given."""
    out = []
    moved = np.arange(len(v)) if before is None else np.flatnonzero(own != before)
    for j in np.unique(np.concatenate([own, own[:0] if before is None else before])).tolist():
        came = moved[own[moved] == j]
        went = came[:0] if before is None else moved[before[moved] == j]
        (h, l), (h2, l2) = _sums(v[came]), _sums(v[went])
        mine = own == j
        out.append(
            {
                "cluster": j, "n": len(came) - len(went),
                "high": [a - b for a, b in zip(h, h2)], "low": [a - b for a, b in zip(l, l2)],
                "radius": float(upper[mine].max(initial=0.0)),
                "distance": None if dist is None else Decimal(sum(map(int, dist[mine].tolist()))),
            }
        )
    return out


def _kind(v: np.ndarray) -> str:
    peak = np.abs(v).max(initial=0)
    return "<i2" if peak < 2**15 else "<i4" if peak < 2**31 else "<f8"


def _wholes(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, floor(scale * x)) of the vectors that take part."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(size == dims)
    flat = column.take(pa.array(at)).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype("f8").reshape(len(at), dims)  # nulls become NaN
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(x * scale)
    good = np.isfinite(x).all(1)
    return at[good], x[good].clip(-_FAR, _FAR)


def _block(ids, v, own, upper, lower, scans, parts) -> pa.RecordBatch:
    kind = _kind(v)
    cols = [
        pa.array([ids], pa.list_(pa.int64())), pa.array([kind]), pa.array([v.astype(kind).tobytes()], pa.binary()),
        *(pa.array([x.tobytes()], pa.binary()) for x in (own.astype("<i4"), upper.astype("<f8"), lower.astype("<f8"), scans.astype("<i4"))),
        pa.array([parts], _PARTS),
    ]
    return pa.RecordBatch.from_arrays(cols, names=["ids", "kind", "vectors", "own", "upper", "lower", "scans", "parts"])


_PARTS = pa.list_(
    pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("high", pa.list_(pa.int64())), ("low", pa.list_(pa.int64())), ("radius", pa.float64()), ("distance", pa.decimal128(38, 0))])
)


def _first(rows: DataFrame, start: list[list[int]], dims: int, scale: int, last: bool) -> DataFrame:
    """Blocks of the vectors, each assigned by a full scan."""
    step = Move(tuple(map(tuple, start)))

    def run(batches):
        c = np.array(step.centroids, "f8")
        for b in slices(batches, BLOCK):
            at, v = _wholes(b.column(1), dims, scale)
            if len(at):
                upper, lower, scans = np.zeros(len(v)), np.zeros(len(v)), np.zeros(len(v), "i4")
                own = assign(v, c, step, None, upper, lower, scans)
                yield _block(b.column(0).take(pa.array(at)).to_pylist(), v, own, upper, lower, scans, _parts(v, own, None, upper, _own_squares(v, c, own) if last else None))

    return rows.mapInArrow(run, _BLOCKS)


def _read(b: pa.RecordBatch, i: int, dims: int):
    r = {n: b.column(n)[i].as_py() for n in ("ids", "kind", "vectors", "own", "upper", "lower", "scans")}
    v = np.frombuffer(r["vectors"], r["kind"]).astype("f8").reshape(-1, dims)
    return r["ids"], v, np.frombuffer(r["own"], "<i4"), np.frombuffer(r["upper"], "<f8").copy(), np.frombuffer(r["lower"], "<f8").copy(), np.frombuffer(r["scans"], "<i4").copy()


def _next(blocks: DataFrame, step: Move, dims: int, last: bool) -> DataFrame:
    def run(batches):
        c = np.array(step.centroids, "f8")
        for b in batches:
            for i in range(b.num_rows):
                ids, v, before, upper, lower, scans = _read(b, i, dims)
                own = assign(v, c, step, before, upper, lower, scans)
                yield _block(ids, v, own, upper, lower, scans, _parts(v, own, before, upper, _own_squares(v, c, own) if last else None))

    return blocks.drop("parts").mapInArrow(run, _BLOCKS)


def _gather(blocks: DataFrame, k: int, dims: int, n: list[int], sums: list[list[int]]) -> tuple[list[float], list[int]]:
    """Add the blocks' changes to counts and sums; radius and distances of each cluster. At most k rows come back."""
    part = blocks.select(F.explode("parts").alias("p")).select("p.*")
    exact = lambda c: F.sum(c.cast("decimal(38,0)"))
    add = [exact(F.col(x)[d]).alias(f"{x}{d}") for x in ("high", "low") for d in range(dims)]
    rows = part.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.sum("distance").alias("distance"), *add).collect()
    radius, distance = [0.0] * k, [0] * k
    for r in rows:
        j = r["cluster"]
        n[j] += r["n"]
        radius[j], distance[j] = r["radius"], int(r["distance"] or 0)
        for d in range(dims):
            sums[j][d] += (int(r[f"high{d}"]) << 32) + int(r[f"low{d}"])
    return radius, distance


def starts(vectors: DataFrame, k: int, dims: int, id_col: str, value: str, scale: int, order: Column) -> list[list[int]]:
    """The first ``k`` vectors by ``order``, then by components."""
    x = F.col(value)
    good = x.isNotNull() & (F.size(x) == dims) & F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y.cast("double") * scale) < float("inf")))
    rows = vectors.filter(good & F.col(id_col).isNotNull()).select(order.alias("_order"), F.transform(x, lambda y: y.cast("double") * scale).alias("_v"))
    return [[int(np.floor(min(max(y, -_FAR), _FAR))) for y in r["_v"]] for r in rows.orderBy("_order", "_v").limit(k).collect()]


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, id_col: str = "vec_id", value: str = "embedding", scale: int = 64, order: Column | None = None) -> DataFrame:
    """One row per vector that takes part: id, cluster, distance (squared), the inertia of its cluster and of all,
    the hash of its final centroid, and ``scans``, how often all of its distances were taken."""
    spark = vectors.sparkSession
    order = F.sha2(F.concat(F.lit("1:"), F.col(id_col).cast("string")).cast("binary"), 256) if order is None else order
    result = f"`{id_col}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, scans int"
    at = starts(vectors, k, dims, id_col, value, scale, order)
    if not at:
        return spark.createDataFrame([], result)
    k, n, sums = len(at), [0] * len(at), [[0] * dims for _ in at]
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(value).alias("v"))
    path, step, inertia = None, None, []
    for i in range(rounds + 1):
        last = i == rounds
        new = _first(rows, at, dims, scale, last) if i == 0 else _next(spark.read.schema(_BLOCKS).parquet(path), step, dims, last)
        before, path = path, scratch_path(spark, f"centroids-{i}")
        new.write.parquet(path)
        if before:
            drop_path(spark, before)
        radius, inertia = _gather(spark.read.schema(_BLOCKS).parquet(path), k, dims, n, sums)
        if not last:
            moved = [[s // n[j] for s in sums[j]] if n[j] else list(at[j]) for j in range(k)]
            step, at = move(at, moved, radius), moved
    blocks = spark.read.schema(_BLOCKS).parquet(path)
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    names = [c.strip().split()[0].strip("`") for c in result.split(",")]
    final = tuple(map(tuple, at))

    def rows_of(batches):
        c = np.array(final, "f8")
        total = min(sum(inertia), _TOP)
        for b in batches:
            for i in range(b.num_rows):
                ids, v, own, _, _, scans = _read(b, i, dims)
                js, far = own.tolist(), [min(int(x), _TOP) for x in _own_squares(v, c, own).tolist()]
                cols = [ids, js, far, [min(inertia[j], _TOP) for j in js], [total] * len(js), [marks[j] for j in js], scans.tolist()]
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types)], names=names)

    return blocks.select("ids", "kind", "vectors", "own", "upper", "lower", "scans").mapInArrow(rows_of, result)
