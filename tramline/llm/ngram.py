"""N-gram Jaccard join: documents whose sets of word shingles overlap enough, and their components.

Texts become sets of 64-bit shingle hashes; equal sets are one node from then on, so copies never form pairs. With
a threshold t, two linked sets share at least t times the larger one. The steps:

1. *Survivors.* In the order of the hashes, the first n - ceil(t n) + l shingles of two linked sets share l. Only these are
   shuffled; a set with fewer shingles known to another set cannot have a link and leaves.
2. *Order.* Survivors' shingles get their document frequency. Shingles of one survivor alone are dropped from the lists (not from the
   sizes), and the others are ordered rarest first.
3. *Search in units.* Survivors meet in units of bounded size by their least shared hash. In a unit, T-occurrence search
   runs over its inverted lists by DivideSkip: the longest lists are put aside, the short ones are merged
   on a heap, and candidates that occur often enough are probed for in the long lists by binary search. A unit gives
   the edges of a spanning forest, never all pairs.
4. *Merge.* Where a hash has several units, one set of each component found so far meets again, until one unit is left.
5. *Rest.* By the prefix principle, a link that is still unseen shares one of the rarest shingles. Where such a
   shingle joins sets of different components, sets of the smaller unit are searched in the larger one.

Every link lies within a component of the result, and every edge is verified: sizes and overlaps are exact up to
collisions of 64-bit hashes.

Defined cases: null, empty or blank texts have no shingles, link with nothing and are their own component;
a null id links with nothing and has a null component; each of several rows with one id counts
as a document of that id; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.llm.common import once, release, release_tables, slices, words
from tramline.llm.components import _written, components

#: share of a set that the prefixes of two linked sets have in common at least: 1 / SHARE
SHARE = 10
#: bounds of a search unit
UNIT_SETS, UNIT_TOKENS = 400, 1_000_000
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _C2
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles, or of the whole sequence where it is shorter."""
    w = words(text)
    if not w:
        return np.zeros(0, np.int64)
    table = once("words", _WordHash)
    h = np.fromiter(map(table.__getitem__, w), np.uint64, len(w))
    k = min(k, len(h))
    m = len(h) - k + 1
    acc = np.full(m, k, np.uint64)
    for j in range(k):
        acc = _mix(acc * _C1 + h[j : j + m])
    return np.unique(acc.view(np.int64))


def least_overlap(n: int, num: int, den: int) -> int:
    """Shingles that a set of ``n`` shares with any set it is linked to, at least."""
    return -(-num * n // den)


def linked(a: int, b: int, both: int, num: int, den: int) -> bool:
    return den * both >= num * (a + b - both)


class Forest:
    """Union-find over component ids."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        while (p := self.up.setdefault(x, x)) != x:
            self.up[x] = x = self.up.setdefault(p, p)
        return x

    def union(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[a] = b
        return a != b


class Index:
    """Inverted lists of a unit; positions in a list grow."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.lists: dict[int, list[int]] = {}
        self.sizes: list[int] = []

    def add(self, size: int, tokens: list[int]) -> None:
        at = len(self.sizes)
        self.sizes.append(size)
        for t in tokens:
            self.lists.setdefault(t, []).append(at)

    def search(self, size: int, tokens: list[int], skip) -> Iterator[int]:
        """Positions of linked sets for which ``skip`` does not hold when they come up, by DivideSkip."""
        need = least_overlap(size, self.num, self.den)
        lists = [x for t in tokens if (x := self.lists.get(t))]
        if len(lists) < need:
            return
        lists.sort(key=len)
        # long lists: as many as the overlap allows, fewer where the longest is long and probing costs more
        far = min(need - 1, int(need / (0.0085 * np.log2(max(2, len(lists[-1]))) + 1)))
        short, long = lists[: len(lists) - far], lists[len(lists) - far :]
        for at, same in groupby(heapq.merge(*short)):
            seen = sum(1 for _ in same)
            if seen + far < need or skip(at):
                continue
            other = self.sizes[at]
            want = max(need, -(-self.num * (size + other) // (self.num + self.den)))
            left = far
            for x in reversed(long):
                if seen >= want or seen + left < want:
                    break
                left -= 1
                i = bisect_left(x, at)
                seen += i < len(x) and x[i] == at
            if seen >= want:
                yield at


def search_unit(rows: Iterable[tuple], num: int, den: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the unit's links.

    Rows are (asks, keeps, sid, component, size, tokens): the set is searched for among those kept before it,
    and is kept for later ones. Links inside a component need no edge.
    """
    forest, index, kept, edges = Forest(), Index(num, den), [], []
    for asks, keeps, sid, comp, size, tokens in rows:
        if asks:
            for at in index.search(size, tokens, lambda i: forest.find(kept[i][1]) == forest.find(comp)):  # noqa: B023
                forest.union(kept[at][1], comp)
                edges.append((sid, kept[at][0]))
        if keeps:
            index.add(size, tokens)
            kept.append((sid, comp))
    return edges


_UNIT = "asks boolean, keeps boolean, sid bigint, comp bigint, n bigint, tokens array<bigint>"


def unit_edges(table: pa.Table, num: int, den: int) -> pa.Table:
    """``search_unit`` on a table with its columns; units are many and small, so what is done for each of them must cost little."""
    release_tables()
    t = table.select(["asks", "keeps", "sid", "comp", "n", "tokens"]).combine_chunks()
    order = np.lexsort((t["sid"].to_numpy(), t["n"].to_numpy(), t["asks"].to_numpy() & ~t["keeps"].to_numpy()))
    cols = [t[c].to_pylist() for c in t.column_names[:5]]
    lists = t["tokens"].combine_chunks()
    flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    edges = search_unit(((*(c[i] for c in cols), flat[ends[i] : ends[i + 1]].tolist()) for i in order), num, den)
    return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})


def _searched(rows: DataFrame, by: list[str], num: int, den: int) -> DataFrame:
    """Edges (a, b) of all units; ``rows`` has ``by`` and the columns of ``search_unit``."""
    return rows.groupBy(*by).applyInArrow(lambda table: unit_edges(table, num, den), "a bigint, b bigint")


def _prefix(n: int, num: int, den: int) -> int:
    return n - least_overlap(n, num, den) + -(-n // SHARE)


def _digest(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, n, sid (hash of the set, null where it is empty or the id is null) and the set's prefix."""

    def run(batches):
        release("words")
        for b in slices(batches):
            ids, n, sid, prefix = b.column(0).to_pylist(), [], [], []
            for d, t in zip(ids, b.column(1).to_pylist()):
                s = shingles(t, k)
                n.append(len(s))
                known = len(s) and d is not None
                sid.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if known else None)
                prefix.append(s[: _prefix(len(s), num, den)] if known else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(prefix, pa.list_(pa.int64()))], names=["doc_id", "n", "sid", "prefix"])

    return docs.mapInArrow(run, "doc_id bigint, n bigint, sid bigint, prefix array<bigint>")


def _runs(keys: np.ndarray) -> np.ndarray:
    """Starts of runs in sorted keys."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)


def _shared_counts(prefixes: DataFrame, most: int = 1_000_000, held: int = 250_000, parts: int = 200) -> DataFrame:
    """(sid, hits): how many shingles of the set's prefix are in another set's prefix, or more.

    Each task settles what it can by itself: a shingle of several of its sets is shared, and goes on as one
    mark, one of a single set goes on with that set. So a shingle sends a row from every ``most`` of a task at most, however
    many sets hold it. Shingles meet in ``parts`` partitions, or more where there are more than ``held`` in each, so what
    a task holds is bounded, and the rows that leave it follow the shingles rather than sets times partitions.
    """

    def local(batches):
        release()
        seen, sids, prefixes_, n_held = set(), [], [], 0

        def settle():
            lens = [len(p) for p in prefixes_]
            keys, owner = np.concatenate(prefixes_), np.repeat(np.array(sids, np.int64), lens)
            order = np.argsort(keys, kind="stable")
            keys, owner = keys[order], owner[order]
            at = _runs(keys)
            size = np.diff(np.r_[at, len(keys)])
            one = at[size == 1]
            many = np.repeat(size > 1, size)
            who, hits = np.unique(owner[many], return_counts=True)
            marks = keys[at[size > 1]]
            cols = ((keys[one], owner[one], 0), (marks, marks, -1), (who, who, None))
            for key, sid, n in cols:
                n = hits if n is None else np.full(len(key), n)
                for i in range(0, len(key), 100_000):
                    yield pa.RecordBatch.from_pydict({"key": pa.array(key[i : i + 100_000]), "sid": pa.array(sid[i : i + 100_000]), "n": pa.array(n[i : i + 100_000].astype("i4"))})

        for b in batches:
            lists = b.column(1)
            flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            for i, s in enumerate(b.column(0).to_pylist()):
                if s not in seen:
                    seen.add(s)
                    sids.append(s)
                    prefixes_.append(flat[ends[i] : ends[i + 1]].copy())
                    n_held += len(prefixes_[-1])
            if n_held >= most:
                yield from settle()
                seen, sids, prefixes_, n_held = set(), [], [], 0
        if n_held:
            yield from settle()

    def meet(batches):
        release()
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches]
        if not got:
            return
        key, sid, n = (np.concatenate(c) for c in zip(*got))
        del got
        yield pa.RecordBatch.from_pydict({"sid": pa.array(sid[n > 0]), "hits": pa.array(n[n > 0].astype("i8"))})
        key, sid, n = key[n <= 0], sid[n <= 0], n[n <= 0]
        order = np.argsort(key, kind="stable")
        key, sid, n = key[order], sid[order], n[order]
        at = _runs(key)
        if len(at):
            shared = (np.minimum.reduceat(n, at) < 0) | (np.minimum.reduceat(sid, at) != np.maximum.reduceat(sid, at))
            hit = np.repeat(shared, np.diff(np.r_[at, len(key)])) & (n == 0)
            who, hits = np.unique(sid[hit], return_counts=True)
            yield pa.RecordBatch.from_pydict({"sid": pa.array(who), "hits": pa.array(hits)})

    total = prefixes.agg(F.sum(F.size("prefix"))).first()[0] or 0
    parts = max(parts, total // held, int(prefixes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = prefixes.mapInArrow(local, "key bigint, sid bigint, n int").repartition(parts, "key")
    return met.mapInArrow(meet, "sid bigint, hits bigint").groupBy("sid").agg(F.sum("hits").alias("hits"))


def _places(col: str, bits: int, probes: int = 4) -> list[Column]:
    return [F.pmod(F.xxhash64(F.col(col), F.lit(j)), F.lit(bits)).alias(f"p{j}") for j in range(probes)]


def _marks(alive: DataFrame, most: int = 1 << 28) -> np.ndarray:
    """Bloom filter of the survivors' ids as 64-bit words, 32 MB at most.

    It spares a shuffle of all texts. What passes wrongly is left out by its set later, so a full filter costs time, not results.
    """
    n = alive.count()
    bits = 64
    while bits < min(most, 12 * n):
        bits *= 2
    at = alive.select(F.explode(F.array(*_places("doc_id", bits))).alias("p"))
    word, mask = F.shiftright("p", 6), F.expr("shiftleft(1L, cast(p & 63 as int))")
    got = at.groupBy(word.alias("w")).agg(F.bit_or(mask).alias("m")).toArrow()  # at most bits / 64 rows
    words_ = np.zeros(bits // 64, np.int64)
    words_[got["w"].to_numpy()] = got["m"].to_numpy()
    return words_


def _ceil(over: str, by: int | str) -> Column:
    return F.expr(f"(({over}) + ({by}) - 1) div ({by})")


def _labelled(units: DataFrame, comps: DataFrame) -> DataFrame:
    """``units`` with ``comp``: the root found so far, or the set itself."""
    return units.join(comps, F.col("sid") == F.col("node"), "left").withColumn("comp", F.coalesce("root", "sid")).drop("node", "root")


def _cut_units(sets: DataFrame) -> DataFrame:
    """Deal the sets of each ``home`` to units of bounded size; ``crowd`` is the number of sets of the home."""
    many = sets.groupBy("home").agg(F.count(F.lit(1)).alias("crowd"), F.sum(F.size("tokens")).alias("w"))
    many = many.select("home", "crowd", F.greatest(_ceil("crowd", UNIT_SETS), _ceil("w", UNIT_TOKENS)).alias("chunks"))
    return sets.join(many, "home").withColumn("unit", F.xxhash64("home", F.pmod(F.xxhash64("sid"), F.col("chunks"))))


def _meet_again(units: DataFrame, edges: list[DataFrame], comps: DataFrame, num: int, den: int) -> DataFrame:
    """Step 4: one set of each component meets the others of its home, until a home fits one unit."""
    crowded = units.filter("chunks > 1")
    while not crowded.isEmpty():
        reps = _labelled(crowded.select("home", "sid"), comps).groupBy("home", "comp").agg(F.min("sid").alias("sid"))
        sets = reps.join(units.select("sid", "n", "tokens"), "sid")
        again = _written(_cut_units(sets).filter("crowd > 1"), "reps")
        found = _written(_searched(again.select("unit", F.lit(True).alias("asks"), F.lit(True).alias("keeps"), "sid", "comp", "n", "tokens"), ["unit"], num, den), "edges")
        if found.isEmpty():
            break
        edges.append(found)
        comps = components(_all(edges), "a", "b")
        crowded = again.filter("chunks > 1")
    return comps


def _all(edges: list[DataFrame]) -> DataFrame:
    out = edges[0]
    for e in edges[1:]:
        out = out.union(e)
    return out


def _rest(units: DataFrame, comps: DataFrame, num: int, den: int) -> DataFrame:
    """Step 5: edges between components that share one of the rarest shingles."""
    known = _labelled(units.select("sid", "unit", "crowd", F.slice("tokens", 1, F.col("p")).alias("first")), comps)
    posts = known.select("sid", "comp", F.struct("crowd", "unit").alias("at"), F.explode("first").alias("t"))
    mixed = posts.groupBy("t").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1").select("t")
    posts = posts.join(mixed, "t")
    homes = posts.groupBy("t", F.col("at").alias("to")).agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    apart = (F.col("at") < F.col("to")) & ~((F.col("c0") == F.col("comp")) & (F.col("c1") == F.col("comp")))
    routes = _written(posts.join(homes, "t").filter(apart).select("sid", F.col("to.unit").alias("unit")).distinct(), "routes")
    load = routes.groupBy("unit").agg(_ceil("count(1)", UNIT_SETS).alias("salts"))
    sets = _labelled(units.select("sid", "n", "tokens", F.col("unit").alias("own")), comps)
    cols = ["unit", "salt", "asks", "keeps", "sid", "comp", "n", "tokens"]
    asks = routes.join(load, "unit").join(sets, "sid").withColumn("salt", F.pmod(F.xxhash64("sid"), F.col("salts")))
    keeps = sets.join(load, F.col("own") == F.col("unit")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    rows = [d.withColumn("asks", F.lit(q)).withColumn("keeps", F.lit(not q)).select(*cols) for d, q in ((asks, True), (keeps, False))]
    return _written(_searched(rows[0].unionByName(rows[1]), ["unit", "salt"], num, den), "edges")


def join(
    docs: DataFrame,
    k: int = 5,
    num: int = 4,
    den: int = 5,
    id_col: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``; linked means Jaccard >= num / den."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    digest = _written(_digest(rows, k, num, den), "digest")
    nodes = digest.filter("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"))

    # 1. survivors: the smaller of the two prefixes' promises must be met
    hits = _shared_counts(digest.filter("sid is not null").select("sid", "prefix"))
    need = _ceil(f"({num} * n + {den - 1}) div {den}", SHARE)
    alive = _written(nodes.join(hits, "sid").filter(F.col("hits") >= need).select("sid", "doc_id", "n"), "alive")

    # 2. shingles of survivors, rarest first
    held = spark.sparkContext.broadcast(_marks(alive))

    def sets(batches):
        release("words")
        bits, seen = held.value, set()
        for b in slices(batches):
            at = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]])
            hit = np.flatnonzero((bits[at >> 6] >> (at & 63) & 1).all(0))
            got = [shingles(b.column(0)[int(i)].as_py(), k) for i in hit]
            sids = [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) for s in got]
            new = [i for i, s in enumerate(sids) if len(got[i]) and s not in seen]
            seen.update(sids)
            yield pa.RecordBatch.from_arrays([pa.array([sids[i] for i in new], pa.int64()), pa.array([got[i] for i in new], pa.list_(pa.int64()))], names=["sid", "tokens"])

    texts = rows.filter("doc_id is not null").select("text", *_places("doc_id", len(held.value) * 64))
    posts = _written(texts.mapInArrow(sets, "sid bigint, tokens array<bigint>"), "sets").select("sid", F.explode("tokens").alias("t"))
    common = posts.groupBy("t").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    lists = posts.join(common, "t").groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("l"))
    # a set that came twice, from repeated rows, has each shingle twice in a row
    lists = lists.select("sid", F.filter("l", lambda x, i: (i == 0) | (F.get("l", i - 1)["t"] != x["t"])).alias("l"))
    least = F.expr(f"({num} * n + {den - 1}) div {den}")
    near = lists.join(alive.select("sid", "n"), "sid").withColumn("p", (F.size("l") - least + 1).cast("int")).filter("p > 0")

    # 3. units by the least shared hash
    near = near.select("sid", "n", "p", F.col("l.t").alias("tokens"), F.array_min("l.t").alias("home"))
    units = _written(_cut_units(_written(near, "near")), "units")
    alone = units.filter("crowd > 1").select("unit", F.lit(True).alias("asks"), F.lit(True).alias("keeps"), "sid", F.col("sid").alias("comp"), "n", "tokens")
    edges = [_written(_searched(alone, ["unit"], num, den), "edges")]
    comps = _meet_again(units, edges, components(edges[0], "a", "b"), num, den)
    edges.append(_rest(units, comps, num, den))
    comps = components(_all(edges), "a", "b")

    group = nodes.select("sid", "doc_id").join(comps, F.col("sid") == F.col("node"), "left").select("sid", "doc_id", F.coalesce("root", "sid").alias("comp"))
    first = group.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    of_set = group.join(first, "comp").select("sid", "component_id")
    own = digest.filter("sid is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return digest.join(of_set, "sid").select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(own)
