"""Spelling variants by asymmetric q-chunks: words one edit apart, the usual form of each, and the root of its chain.

Of two words one edit apart let the one that is not longer give two disjoint chunks, its halves, and the other its grams
of the same lengths with their places. One edit leaves one of the chunks whole, at its place or shifted by one, so
chunks and grams that agree in text, length of the words and shift join to a complete list of candidates. Of the grams
within shift one only that whose shift agrees with the lengths of the words can belong to a pair (in front
of the edit nothing moves, behind it all moves by the difference of the lengths), and only that one is sent.

A chunk that many words share would make as many pairs as the square of its words. So chunks and grams are counted first;
where pairs outnumber rows by more than ``FEW``, rows also carry the rest of their word with one letter left out,
which makes the join exact there: rows stay in proportion to the letters of the words, pairs to true neighbours and to
``FEW`` times the rows. All candidates are verified by their edit distance.

Forms: of its near words a word takes the most frequent one, if that has at least ``ratio`` times its occurrences. Along a
chain of forms the counts grow by that factor, so chains are short; roots come by doubling the followed way,
each step written to the shared folder.

Defined cases: null and empty texts have no words; null ids count as the empty text in the hash; rows that repeat an id
are documents of their own; a word deleted down below the least length is no word; without words there are
no rows; columns but id and text are not read; ties in frequency go to the smallest word in code-point order.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.llm.common import slices
from tramline.session import cut

# Fixed value: letters of a word.
LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: candidate pairs per row from which a chunk is refined
FEW = 16
#: distinct words that a task counts before it sends them on
HELD = 200_000


def spelled(doc_id, run: str, every: int) -> str:
    """The lower-cased run, with the letter that the hash names left out where ``every`` divides the hash."""
    word = run.lower() if run.isascii() else run.translate(_LOWER)
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode("utf-8", "surrogatepass"))
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def words(docs: DataFrame, every: int = 97, letters: int = 5, least: int = 3, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of the words of at least ``letters`` letters that occur ``least`` times or more."""

    def run(batches):
        held: Counter = Counter()

        def sent() -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()

        for b in slices(batches):
            for doc_id, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for r, n in Counter(LETTERS.findall(t or "")).items():
                    if len(r) >= letters and len(w := spelled(doc_id, r, every)) >= letters:
                        held[w] += n
                if len(held) > HELD:
                    yield from sent()
        yield from sent()

    found = docs.select(id_col, text).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _sides(size: Column, i: int) -> tuple[Column, Column]:
    """Start (from 1) and length of chunk ``i`` of a word of ``size`` letters."""
    half = (size / 2).cast("int")
    return (F.lit(1), half) if i == 0 else (half + 1, size - half)


def _rows(table: DataFrame, grams: bool) -> DataFrame:
    """Chunks of each word, or the grams that can meet chunks of words as long or one letter shorter.

    ``key`` names chunk, difference of lengths, length of the chunk's word and the text; ``rest`` is what else the word has.
    """
    own = F.char_length("word")
    parts = []
    for i in (0, 1):
        for d in (0, 1):
            size = own - d if grams else own
            start, length = _sides(size, i)
            start = start + d if grams and i == 1 else start  # behind the edit, all is shifted by the difference
            rest = F.substring("word", F.lit(1), start - 1) if i else F.substring("word", length + 1, own)
            parts.append(F.struct(F.concat(F.lit(f"{i}{d}"), size.cast("string"), F.lit(":"), F.substring("word", start, length)).alias("key"), rest.alias("rest"), F.lit(i).alias("i"), F.lit(d).alias("d")))
    return table.select("word", "n", F.explode(F.array(*parts)).alias("c")).select("word", "n", "c.*")


def _without(rest: Column, placed: bool) -> Column:
    """``rest`` with each letter left out in turn, behind the letter's place if ``placed``."""
    size = F.char_length(rest)
    each = lambda p: F.concat(F.substring(rest, F.lit(1), p - 1), F.substring(rest, p + 1, size))
    named = (lambda p: F.concat(p.cast("string"), F.lit(":"), each(p))) if placed else each
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), named))


def near(table: DataFrame, few: int = FEW) -> DataFrame:
    """(a, n_a, b, n_b): each pair of words of ``table`` (word, n) with an edit distance of exactly one, once."""
    chunks, grams = _rows(table, grams=False), _rows(table, grams=True)
    both = chunks.select("key", F.lit(1).alias("c"), F.lit(0).alias("g")).union(grams.select("key", F.lit(0).alias("c"), F.lit(1).alias("g")))
    c, g = F.sum("c"), F.sum("g")
    keys = cut(both.groupBy("key").agg((c * g > few * (c + g)).alias("often"), c.alias("c"), g.alias("g")).filter("c > 0 and g > 0 and (c > 1 or g > 1 or substring(key, 2, 1) = '1')").select("key", "often"), "chunks")
    plain = F.array(F.lit(""))
    same, longer = F.col("d") == 0, F.col("often")
    # equal lengths: the letter at one place differs; else the gram's word has one letter more
    a_more = F.when(~longer, plain).when(same, _without(F.col("rest"), True)).otherwise(F.array("rest"))
    b_more = F.when(~longer, plain).otherwise(F.when(same, _without(F.col("rest"), True)).otherwise(_without(F.col("rest"), False)))
    a = chunks.join(keys, "key").select("key", F.col("word").alias("a"), F.col("n").alias("n_a"), F.explode(a_more).alias("more"))
    b = grams.join(keys, "key").select("key", F.col("word").alias("b"), F.col("n").alias("n_b"), "i", "d", F.explode(b_more).alias("more"))
    half = (F.char_length("a") / 2).cast("int")
    # a pair that shares both chunks comes by the first; words of equal length come in both orders
    first = (F.col("i") == 0) | (F.substring("a", F.lit(1), half) != F.substring("b", F.lit(1), half))
    once = (F.col("d") == 1) | (F.col("a") < F.col("b"))
    return a.join(b, ["key", "more"]).filter(once & first & (F.levenshtein("a", "b", 1) == 1)).select("a", "n_a", "b", "n_b")


def forms(pairs: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, n_near, form, form_n) of the words that have near words; form is null where none is frequent enough."""
    ways = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("other"), F.col("n_b").alias("m"))
    ways = ways.union(pairs.select(F.col("b"), F.col("n_b"), F.col("a"), F.col("n_a")))
    best = ways.groupBy("word").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("n_near"), F.min(F.struct(F.negative("m").alias("m"), F.col("other"))).alias("best"))
    takes = -F.col("best.m") >= ratio * F.col("n")
    return best.select("word", "n_near", F.when(takes, F.col("best.other")).alias("form"), F.when(takes, -F.col("best.m")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) for links (word, form) without circles; every step doubles the way followed."""
    at = cut(links.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while at.filter("moved").limit(1).count():
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = cut(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
    return at.select("word", "root")


def group(table: DataFrame, ratio: int = 2, few: int = FEW) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of ``table`` (word, n), whose words are distinct."""
    table = cut(table.select("word", "n"), "words")
    found = cut(forms(near(table, few), ratio), "forms")
    root = roots(found.filter("form is not null"))
    out = table.join(found, "word", "left").join(root, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
