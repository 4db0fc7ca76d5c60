"""Token counts as delta-maintained rollups.

Documents are counted once when they come. A batch turns inserts, deletes and revised texts into signed rows: an insert adds
a document's counts, a delete takes the counts that are on record for it, a revision does both. Totals by source,
language and tokenizer version are sums of the batches' signed sums, so they never need the texts again.

Layout below ``path``: ``rows/batch=b`` (signed rows per document and version), ``sums/batch=b`` (signed sums) and
``done/batch=b`` (written last). A batch counts only when it is done; a batch that is done is not applied again, and
one that broke off is written anew over its remains, so a repeated or retried commit changes nothing.
One writer commits at a time.

Defined cases: null text counts 0 tokens; null source or language is a group of its own; a null id is counted on insert but
cannot be deleted or revised; inserting an id again adds another document under it, and deleting it takes all of them;
deletes and revisions of unknown ids do nothing, repeated ones count once; an empty batch is done without rows.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.bpe import cuts
from tramline.llm.common import once, slices

KEYS = ["source", "lang", "version"]
_BITS = 48


class Counts:
    """Token counts of a text under several versions at once; counts of short cuts are kept in a bounded table."""

    def __init__(self, raw: dict[str, bytes], pattern: str, kept: int = 800_000):
        self.kept, self._cuts = kept, {}
        self.coders = []
        for name, r in raw.items():
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, r.splitlines()) if a}
            self.coders.append(tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}))

    def one(self, cut: str) -> int:
        """The versions' counts side by side in one number, so that adding it adds all of them."""
        n = 0
        for i, c in enumerate(self.coders):
            n |= len(c.encode_ordinary(cut)) << _BITS * i
        if len(cut) <= 64:
            if len(self._cuts) >= self.kept:
                self._cuts.clear()
            self._cuts[cut] = n
        return n

    def __call__(self, text: str | None) -> list[int]:
        known = self._cuts.get
        n = sum([known(c) or self.one(c) for c in cuts(text)]) if text else 0
        return [n >> _BITS * i & ((1 << _BITS) - 1) for i in range(len(self.coders))]


def loader(paths: dict[str, str], pattern: str) -> Callable[[], Counts]:
    """Counter for versions given as name -> file of ranks."""
    raw = {}
    for name, p in paths.items():
        with open(p, "rb") as f:
            raw[name] = f.read()
    key = ("counts", *[(n, zlib.crc32(r)) for n, r in raw.items()])
    return lambda: once(key, lambda: Counts(raw, pattern))


def counted(docs: DataFrame, load: Callable[[], Counts], versions: list[str]) -> DataFrame:
    """One row (doc_id, source, lang, version, n_docs, n_tokens) per document and version."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), "text")

    def run(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([load()(t) for t in b.column(3).to_pylist()], pa.list_(pa.int64()))], names=["doc_id", "source", "lang", "n"])

    got = rows.mapInArrow(run, "doc_id long, source string, lang string, n array<long>")
    each = F.explode(F.arrays_zip(F.array(*map(F.lit, versions)).alias("version"), F.col("n").alias("n_tokens")))
    return got.select("doc_id", "source", "lang", each.alias("c")).select("doc_id", "source", "lang", F.col("c.version"), F.lit(1).cast("long").alias("n_docs"), F.col("c.n_tokens"))


class Rollup:
    """Totals kept below ``path``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, load: Callable[[], Counts], versions: list[str]):
        self.spark, self.path, self.load, self.versions = spark, path.rstrip("/"), load, versions

    def _fs(self, p: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(p)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def batches(self) -> list[str]:
        """Names of the batches that are done."""
        fs, at = self._fs(f"{self.path}/done")
        return sorted(s.getPath().getName().removeprefix("batch=") for s in fs.listStatus(at)) if fs.exists(at) else []

    def _read(self, what: str) -> DataFrame | None:
        done = self.batches()
        return self.spark.read.parquet(*[f"{self.path}/{what}/batch={b}" for b in done]) if done else None

    def current(self) -> DataFrame | None:
        """Counts on record per document, source, language and version."""
        rows = self._read("rows")
        if rows is None:
            return None
        return rows.groupBy("doc_id", *KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs <> 0 or n_tokens <> 0")

    def commit(self, batch: str, inserts: DataFrame | None = None, deletes: DataFrame | None = None, revised: DataFrame | None = None) -> bool:
        """Apply one batch; False if it was done before. ``deletes`` has doc_id; the others are documents."""
        if batch in self.batches():
            return False
        now, signed = self.current(), []
        if inserts is not None:
            signed.append(counted(inserts, self.load, self.versions))
        gone = [d.select(F.col("doc_id").cast("long")) for d in (deletes, revised) if d is not None]
        if gone and now is not None:
            taken = now.join(reduce(DataFrame.union, gone).distinct(), "doc_id", "left_semi")
            signed.append(taken.select("doc_id", *KEYS, (-F.col("n_docs")).alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens")))
            if revised is not None:
                known = revised.dropDuplicates(["doc_id"]).join(now.select("doc_id").distinct(), "doc_id", "left_semi")
                signed.append(counted(known, self.load, self.versions))
        rows = f"{self.path}/rows/batch={batch}"
        empty = self.spark.createDataFrame([], "doc_id long, source string, lang string, version string, n_docs long, n_tokens long")
        reduce(DataFrame.union, signed, empty).write.mode("overwrite").parquet(rows)
        sums = self.spark.read.parquet(rows).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        sums.write.mode("overwrite").parquet(f"{self.path}/sums/batch={batch}")
        fs, at = self._fs(f"{self.path}/done/batch={batch}")
        return fs.mkdirs(at)

    def totals(self) -> DataFrame:
        """n_docs and n_tokens by source, language and version, groups that came to nothing left out."""
        sums = self._read("sums")
        if sums is None:
            return self.spark.createDataFrame([], "source string, lang string, version string, n_docs long, n_tokens long")
        return sums.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs <> 0 or n_tokens <> 0")
