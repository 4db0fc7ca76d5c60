"""Language identification, word first with backoff to character n-grams.

A word that the model knows is scored by its log frequency in each language. An unseen word is scored by
its character n-grams: the longest n for which any of its n-grams (with word borders) is known, then the next
shorter one, down to single characters; a word without any known n-gram says nothing. A
text's score of a language is the mean over its words, and the confidence is the softmax of these
means times the number of words, at most ``EVIDENCE`` of them, as words of a text are not independent.

The model is fitted on a bounded sample of labelled texts: about ``max_docs`` texts by a hash of the id. Its size is bounded by
``top`` words and ``top`` n-grams of each length per language, so it can be broadcast. Prediction reads the
text only.

Defined cases: null texts and texts without a letter are ``und`` with score 0, and so is every text when
nothing was learned; equal scores go to the language first in the alphabet; repeated rows are treated each;
texts with null labels are not learned from.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.llm.common import by_slice, recent

UND = "und"
#: letters and what joins them; everything else parts words
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
SIZES = (4, 3, 2, 1)
#: words whose evidence counts at most for the confidence
EVIDENCE = 20


class Model:
    """Log frequencies by word and by n-gram, as rows of one table; ``kept`` more rows hold unseen words once looked up."""

    def __init__(self, langs: list[str], tables: dict[int, dict[str, list[int]]], kept: int = 300_000):
        self.langs, self.kept = langs, kept
        self.index: dict[int, dict[str, int]] = {}
        logs = []
        for n, counts in tables.items():
            at = sum(map(len, logs))
            self.index[n] = {k: at + i for i, k in enumerate(counts)}
            if counts:
                m = np.array(list(counts.values()), float)
                logs.append(np.log((m + 0.5) / (m.sum(0) + 0.5 * len(m))))
        #: its last row is that of words of which nothing is known
        self.table = np.concatenate([*logs, np.zeros((1, len(langs)))])

    def backoff(self, word: str) -> np.ndarray:
        w = f"^{word}$"
        for n in SIZES:
            known = self.index.get(n, {})
            hits = [known[g] for i in range(len(w) - n + 1) if (g := w[i : i + n]) in known]
            if hits:
                return self.table[hits].mean(0)
        return self.table[-1]

    def predict(self, text: str | None, rows: Rows) -> tuple[str, float]:
        found = _TOKEN.findall(text.lower()) if text and self.langs else []
        if not any(c.isalpha() for w in found for c in w):
            return UND, 0.0
        mean = np.zeros(len(self.langs))
        for i in range(0, len(found), 50_000):
            part = found[i : i + 50_000]
            rows.make_room(len(part))
            mean += rows.table[np.fromiter(map(rows.__getitem__, part), np.int64, len(part))].sum(0)
        mean /= len(found)
        weight = np.exp((mean - mean.max()) * min(len(found), EVIDENCE))
        best = int(mean.argmax())
        return self.langs[best], float(weight[best] / weight.sum())


class Rows(dict):
    """Row of each word in a table: known words, and a bounded number of unseen ones, looked up once."""

    def __init__(self, model: Model):
        self.model, self.known = model, model.index.get(0, {})
        self.table = np.concatenate([model.table, np.zeros((model.kept, len(model.langs)))])
        self.clear()

    def clear(self):
        super().clear()
        self.update(self.known)
        self.free = len(self.model.table)

    def make_room(self, n: int):
        if self.free + n > len(self.table):
            self.clear()

    def __missing__(self, word: str) -> int:
        at = self[word] = self.free
        self.table[at] = self.model.backoff(word)
        self.free += 1
        return at


def fit(labelled: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", max_docs: int = 12_000, top: int = 20_000, least: int = 2) -> Model:
    """Model from texts with a language: counts are taken in Spark, only the bounded tables come to the driver."""
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("t"), F.col(lang).alias("lang"))
    step = max(1, rows.select("id").count() // max_docs)
    rows = rows.filter(F.pmod(F.xxhash64("id"), F.lit(step)) == 0).select("t", "lang")

    def tokens(b):
        ws = [_TOKEN.findall(t.lower()) for t in b.column(0).to_pylist()]
        return {"lang": b.column(1), "words": pa.array(ws, pa.list_(pa.string()))}

    counts = by_slice(rows, tokens, "lang string, words array<string>").select("lang", F.explode("words").alias("w")).groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    bordered = F.concat(F.lit("^"), F.col("w"), F.lit("$"))

    def grams(n: int):
        places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length("w") + (3 - n)))
        return F.transform(places, lambda i: F.struct(F.lit(n).alias("size"), F.substring(bordered, i, F.lit(n)).alias("g")))

    units = counts.select("lang", "n", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("size"), F.col("w").alias("g"))), *map(grams, SIZES))).alias("u")).select("lang", "n", "u.*")
    units = units.groupBy("lang", "size", "g").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) & ((F.col("size") == 0) | (F.char_length("g") == F.col("size"))))
    best = Window.partitionBy("lang", "size").orderBy(F.desc("n"), "g")
    table = units.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= top).drop("r").orderBy("size", "g", "lang").toArrow()  # at most top rows per language and size
    langs = sorted(set(table["lang"].to_pylist()))
    at = {x: i for i, x in enumerate(langs)}
    tables: dict[int, dict[str, list[int]]] = {n: {} for n in (0, *SIZES)}
    for x, n, g, k in zip(*(table[c].to_pylist() for c in ("lang", "size", "g", "n"))):
        tables[n].setdefault(g, [0] * len(langs))[at[x]] = k
    return Model(langs, tables)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without ``text`` and with lang_pred and score (0 to 1) of the whole text."""
    rest = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    rows = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(text).alias("_text"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    key = ("langid", uuid.uuid4().hex)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]] + ["lang_pred string", "score double"])

    def run(b):
        rows = recent(key, lambda: Rows(held.value))
        got = [held.value.predict(t, rows) for t in b.column(len(rest)).to_pylist()]
        return dict(zip(rest, b.columns)) | {"lang_pred": pa.array([g[0] for g in got], pa.string()), "score": pa.array([g[1] for g in got], pa.float64())}

    return by_slice(rows, run, schema)
