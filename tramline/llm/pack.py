"""Packing of documents into fixed-length training sequences along a space-filling curve.

A document is its token ids and an end id. Its hashed vector (counts of token ids, each id hashed to a
fixed random direction) is projected to a few dimensions, each coordinate is cut at quantiles, and
the cell's place on a Hilbert curve is the sort key: documents of like content lie close together on the
curve. The curve is dealt out in ranges, and each range is filled into sequences from end to end,
documents being cut where a sequence is full, so that only the last sequence of a range has padding.

Quantiles and range borders come from a sample of at least ``sample`` documents in expectation, drawn by row. They
decide how even the ranges are, not which documents are packed. Ties of the key are broken by a hash
of the id and the row's place in its task, and borders may fall between them, so copies of one document, and rows without an id,
spread over ranges.

Defined cases: null or empty text is the end id alone; null ids are kept as null; repeated rows are packed
each; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tramline.llm.common import once, release, slices

DIMS, BITS = 4, 8
PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 characters for
    themselves, the other bytes in order from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Ids:
    """Token ids of a byte-level vocabulary in the tokenizers format.

    Texts are encoded from the same vocabulary as ranks, which is several times faster. A text that holds the string of a
    special token goes through the tokenizers library, as does one with a run of white space too long for the other's pattern matcher;
    the library's tables are built when the first such text comes.
    """

    def __init__(self, raw: bytes, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        self.raw, self.library = raw, None
        file, at = json.loads(raw), byte_of()
        self.marks = [t["content"] for t in file.get("added_tokens") or ()]
        vocab = file["model"]["vocab"]
        ranks = {bytes(at[c] for c in t): i for t, i in vocab.items() if t not in self.marks}
        self.coder = tiktoken.Encoding("ids", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.line = self.coder.encode_ordinary("\n")[0]

    @property
    def tokenizer(self) -> Tokenizer:
        if self.library is None:
            self.library = Tokenizer.from_buffer(self.raw)
        return self.library

    def one(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if not any(m in text for m in self.marks):
            try:
                return self.coder.encode_to_numpy(text, disallowed_special=())
            except ValueError:  # the matcher's stack is full
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, without special tokens around it; a special token's string in it stays one id."""
        return list(map(self.one, texts))


def loader(path: str, pattern: str) -> Callable[[], Ids]:
    """Read the vocabulary here (a few MB) and let each worker build its encoder once."""
    with open(path, "rb") as f:
        raw = f.read()
    key = ("ids", zlib.crc32(raw), pattern)
    return lambda: once(key, lambda: Ids(raw, pattern))


def directions(dims: int = DIMS, size: int = 1 << 16) -> np.ndarray:
    """Fixed random directions of hashed token ids, one row per dimension."""
    return np.ascontiguousarray(np.random.default_rng(20).standard_normal((size, dims)).astype("f4").T)


def project(ids: np.ndarray, dirs: np.ndarray) -> list[float]:
    """Projection of a document's hashed vector, scaled to unit variance."""
    if not len(ids):
        return [0.0] * len(dirs)
    size = dirs.shape[1]
    at = ids if int(ids.max()) < size else ids % size
    return [float(d.take(at).sum()) / len(ids) ** 0.5 for d in dirs]


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places of grid cells (n, dims) on the Hilbert curve."""
    x = [c.astype("i8") for c in cells.T]
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            turn = (x[i] & q) != 0
            swap = np.where(turn, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(turn, x[0] ^ (q - 1), x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    flip, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[n - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = key << 1 | (c ^ flip) >> b & 1
    return key


def place(points: np.ndarray, edges: np.ndarray, rows: list) -> np.ndarray:
    """Order along the curve: the cell's place, then a hash of what tells the row."""
    cells = np.stack([np.searchsorted(e, p, "right") for e, p in zip(edges, points.T)], 1)
    tie = np.array([zlib.crc32(str(r).encode()) >> 1 for r in rows], "i8")
    return hilbert(cells) << 31 | tie


def told(doc_ids: list, first: int) -> list[tuple]:
    """Id, task and place in the task of rows of which ``first`` came before."""
    task = TaskContext.get().partitionId()
    return [(d, task, first + i) for i, d in enumerate(doc_ids)]


def pack(
    docs: DataFrame,
    load: Callable[[], Ids],
    length: int = 2048,
    end: int = 1,
    sample: int = 4000,
    full: int = 200,
    id_col: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Pieces of all documents: ``PIECES``, ids as little-endian unsigned 32-bit integers.

    A range holds ``full`` sequences or more where there are so many, and there are at most as many
    ranges as shuffle partitions.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    n_docs, most = rows.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    sample = max(sample, 20 * most)
    dirs = directions()

    def points(batches):
        for b in slices(batches, 200):
            for d, ids in zip(b.column(0).to_pylist(), load()(b.column(1).to_pylist())):
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([d], pa.int64()), "n": pa.array([len(ids) + 1], pa.int64()), "p": pa.array([project(ids, dirs)], pa.list_(pa.float32()))})

    # by id and row, so that one repeated id is neither taken whole nor left out whole
    some = rows.filter(F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(max(1, n_docs // sample))) == 0)
    seen = some.mapInArrow(points, "doc_id bigint, n bigint, p array<float>").toArrow()  # about ``sample`` small rows
    if not seen.num_rows:
        seen = pa.table({"doc_id": [0], "n": [1], "p": [[0.0] * DIMS]})
    at = np.array(seen["p"].to_pylist(), "f4")
    edges = np.quantile(at, np.arange(1, 1 << BITS) / (1 << BITS), axis=0).T
    order, weight = place(at, edges, list(enumerate(seen["doc_id"].to_pylist()))), np.array(seen["n"])
    tokens = weight.mean() * n_docs
    parts = int(max(1, min(most, tokens // (length * full))))
    by = np.argsort(order)
    share = np.cumsum(weight[by]) / weight.sum()
    borders = order[by][np.searchsorted(share, np.arange(1, parts) / parts).clip(0, len(by) - 1)]

    def tokenise(batches):
        first = 0
        for b in slices(batches):
            doc_ids, ids = b.column(0).to_pylist(), load()(b.column(1).to_pylist())
            where = place(np.array([project(i, dirs) for i in ids], "f4"), edges, told(doc_ids, first))
            first += b.num_rows
            # two bytes an id where all ids of the batch fit
            kind = "<u2" if max([end, *(int(i.max()) for i in ids if len(i))]) < 1 << 16 else "<u4"
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": b.column(0),
                    "part": pa.array(np.searchsorted(borders, where, "right"), pa.int32()),
                    "place": pa.array(where, pa.int64()),
                    "n": pa.array([len(i) + 1 for i in ids], pa.int64()),
                    "ids": pa.array([np.append(i, np.uint32(end)).astype(kind).tobytes() for i in ids], pa.binary()),
                }
            )

    def fill(batches):
        release()
        part, seq, room = None, 0, length
        for b in slices(batches):
            out = []
            for doc, p, n, raw in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4))):
                if p != part:
                    part, seq, room = p, 0, length
                start = 0
                if len(raw) == 2 * n:
                    raw = np.frombuffer(raw, "<u2").astype("<u4").tobytes()
                while start < n:
                    if not room:
                        seq, room = seq + 1, length
                    take = min(room, n - start)
                    out.append((doc, start, take, raw[4 * start : 4 * (start + take)], n, p << 40 | seq, length - room))
                    start, room = start + take, room - take
            names = [c.split()[0] for c in PIECES.split(", ")]
            kinds = [pa.binary() if n == "ids" else pa.int64() for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    ordered = rows.mapInArrow(tokenise, "doc_id bigint, part int, place bigint, n bigint, ids binary").repartitionById(parts, F.col("part"))
    return ordered.sortWithinPartitions("part", "place", "doc_id").mapInArrow(fill, PIECES)
