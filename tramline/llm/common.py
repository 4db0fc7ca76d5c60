"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: a word is a longest run of anything but the six ASCII white-space characters
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: rows that a Python task turns into objects at a time, so that memory follows a slice and not a batch
SLICE = 500

_KEPT: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(key, make: Callable):
    """``make()`` once in this Python worker; bounded things only (vocabularies, models)."""
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def release(*kept) -> None:
    """Drop this worker's tables but those of the named keys, so that steps that need the memory do not find it taken by earlier ones."""
    for key in [k for k in _KEPT if k not in kept]:
        del _KEPT[key]
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # freed memory goes back to the machine, where the C library knows how
    if trim is not None:
        trim(0)


def release_tables() -> None:
    """Like ``release``, for what is called once for each of many small groups: nothing is done where no tables are kept."""
    if _KEPT:
        release()


def keep_only(*kinds: str) -> None:
    """``release`` of all but tables of these kinds: the first part of a ``once`` key, the kind of a ``recent`` one."""
    release(*[k for k in _KEPT if (k[1] if k[0] == "recent" else k[0]) in kinds])


def recent(key, make: Callable):
    """Like ``once`` for what belongs to one query: the value of the newest key of its kind (``key[0]``) stays."""
    kept = _KEPT.get(("recent", key[0]))
    if kept is None or kept[0] != key:
        kept = _KEPT[("recent", key[0])] = (key, make())
    return kept[1]


def slices(batches: Iterable[pa.RecordBatch], step: int = SLICE) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def by_slice(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str, step: int = SLICE) -> DataFrame:
    """``mapInArrow`` over slices of at most ``step`` rows; ``fn`` returns columns in the order of ``schema``."""

    def run(batches):
        for b in slices(batches, step):
            yield pa.RecordBatch.from_pydict(fn(b))

    return df.mapInArrow(run, schema)


def words(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8, A-Z lower-cased; ``bytes`` methods know ASCII only, which is the rule wanted."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def clean_name(s: str) -> str:
    return re.sub(r"\W+", "_", s)
