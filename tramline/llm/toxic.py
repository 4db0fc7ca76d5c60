"""Toxicity by weak supervision.

1. Units (words, and beginnings of words of three to six letters) are ranked by how surely they are
   more frequent in texts labelled toxic; the best ``units`` of them make the lexicons.
2. Many voters look at a text: lexicon voters (the words dealt to groups, one voter a group), voters on
   beginnings by length, density and absence voters, a fixed lexicon, and patterns (capitals, exclamation
   marks). Each votes toxic, clean or abstains.
3. A generative label model estimates by expectation maximisation how each voter votes on toxic and on clean texts. Votes
   that still agree given the class are correlated; a voter's evidence is divided by one plus its
   correlations, so that copies of one signal do not count twice. Known labels stay fixed.
4. A linear classifier is trained on the posteriors; it alone scores texts.

Fitting reads a bounded sample: about ``max_docs`` labelled and ``max_docs`` other texts, by a hash of the id. Labels of held-out
rows are never read. The model has at most ``units`` weights beside the voters', so it can be broadcast.

Defined cases: null and empty texts get the score of a text without any unit; without a toxic and a
clean label nothing is learned and every score is 0; null labels are not used; repeated rows are treated each.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.llm.common import by_slice, recent

# A small public lexicon of insults.
INSULTS = ("clown", "disgusting", "dumb", "fool", "garbage", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "ugly", "worthless")
INSULT_SET = frozenset(INSULTS)
MARKS = ".,;:!?()[]{}\"'#*$%&|<>-_"
INSULT = -1
BEGIN = (3, 4, 5, 6)
GROUPS = 8
#: voters: the word groups, the beginnings, then these
OTHERS = ("dense", "many", "none", "insult", "capitals", "calls")


def units_of(token: str) -> list[str]:
    """Units of one blank-separated token in lower case: ``=word`` and its beginnings ``^...``."""
    w = token.strip(MARKS)
    if len(w) < 2:
        return []
    return ["=" + w, *["^" + w[:n] for n in BEGIN if len(w) > n]]


class Units(dict):
    """Token -> indexes of its units in the model; a bounded number of tokens is kept."""

    def __init__(self, index: dict[str, int], kept: int = 400_000):
        super().__init__()
        self.index, self.kept = index, kept

    def __missing__(self, token: str) -> tuple[int, ...]:
        got = tuple(i for u in units_of(token) if (i := self.index.get(u)) is not None)
        if token.strip(MARKS) in INSULT_SET:
            got += (INSULT,)
        if len(self) >= self.kept:
            self.clear()
        self[token] = got
        return got


def measure(text: str | None, units: Units) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the units found, repeats included, and (words, insults, share of capitals, calls per word)."""
    raw = text.split() if text else []
    tokens = text.lower().split() if text else []
    hits = [i for got in map(units.__getitem__, tokens) if got for i in got]
    n = max(1, len(tokens))
    at = np.array(hits, np.int64)
    return at[at != INSULT], np.array([len(tokens), float(INSULT in hits), sum(map(str.isupper, raw)) / n, (text or "").count("!") / n])


def voted(hits: np.ndarray, facts: np.ndarray, model: dict) -> np.ndarray:
    """Votes of all voters: 1 toxic, -1 clean, 0 none."""
    kind = model["kind"][hits]  # group of a word, or GROUPS + place of the beginning's length
    words = kind < GROUPS
    v = np.zeros(GROUPS + len(BEGIN) + len(OTHERS), np.int8)
    v[np.unique(kind[words])] = 1
    for j in range(len(BEGIN)):
        v[GROUPS + j] = (kind == GROUPS + j).sum() >= 2
    share = words.sum() / max(1.0, facts[0])
    last = (1 if share > 0.004 else -1 if not share else 0, int(words.sum() >= 3), -int(not len(hits)), int(facts[1]), 1 if facts[2] > 0.5 else -int(facts[2] < 0.02), 1 if facts[3] > 0.3 else -int(facts[3] == 0))
    v[GROUPS + len(BEGIN) :] = last
    return v


def label_model(votes: np.ndarray, known: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors, vote tables P(vote | class) (voters, 2, 3) and evidence weights; ``known`` is 0, 1 or nan."""
    fixed = ~np.isnan(known)
    prior = known[fixed].mean().clip(0.01, 0.99)
    post = np.where(fixed, np.nan_to_num(known), prior)
    n, m = votes.shape
    onehot = np.stack([votes == v for v in (-1, 0, 1)], 2).astype("f4")
    weight, start = np.ones(m), True
    for _ in range(rounds):
        use = fixed if start else np.ones(n, bool)  # the first tables come from known labels
        w = np.stack([1 - post, post])[:, use]
        table = np.einsum("cn,nmv->mcv", w, onehot[use]) + 0.5
        table /= table.sum(2, keepdims=True)
        expected = np.einsum("cn,mcv,v->nm", w, table, np.array([-1, 0, 1]))
        rest = votes[use] - expected  # what the class does not explain
        scale = np.sqrt((rest**2).mean(0)) + 1e-9
        corr = (rest / scale).T @ (rest / scale) / max(1, use.sum())
        np.fill_diagonal(corr, 0)
        weight = 1 / (1 + np.clip(corr - 0.05, 0, None).sum(1))
        odds = np.log(prior / (1 - prior)) + np.einsum("nmv,mv->n", onehot, weight[:, None] * np.log(table[:, 1] / table[:, 0]))
        new = np.where(fixed, np.nan_to_num(known), 1 / (1 + np.exp(-odds.clip(-30, 30))))
        done, post, start = not start and np.abs(new - post).max() < 1e-3, new, False
        if done:
            break
    return post, table, weight


def linear(x: np.ndarray, y: np.ndarray, ridge: float = 3e-4, rounds: int = 400) -> np.ndarray:
    """Logistic regression on soft labels by accelerated gradient steps; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    v = np.ones(x.shape[1], "f4")
    for _ in range(20):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v)
    step = 1 / (0.25 * np.linalg.norm(x @ v) ** 2 / len(x) * 1.1 + ridge)
    w = at = np.zeros(x.shape[1], "f4")
    for k in range(rounds):
        p = 1 / (1 + np.exp(-(x @ at).clip(-30, 30)))
        new = at - step * (x.T @ (p - y) / len(x) + ridge * at)
        w, at = new, new + k / (k + 3) * (new - w)
    return w


def features(hits: np.ndarray, facts: np.ndarray, model: dict) -> np.ndarray:
    counts = np.log1p(np.bincount(hits, minlength=len(model["kind"])))
    return np.concatenate([counts, voted(hits, facts, model)]).astype("f4")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    max_docs: int = 12_000,
    units: int = 600,
    least: int = 5,
) -> dict | None:
    """Model from ``docs`` and those ``labels`` for which ``learn`` holds; None where nothing can be learned."""
    known = labels.filter(learn & F.col(label).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label).cast("double").alias("y"))
    known = known.filter(F.pmod(F.xxhash64("_id"), F.lit(max(1, known.count() // max_docs))) == 0)
    # one label per id, the larger of repeated ones; the bound on rows makes the broadcast safe
    known = F.broadcast(known.groupBy("_id").agg(F.max("y").alias("y")))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("t"))
    every = max(1, docs.select(id_col).count() // max_docs)
    some = rows.join(known, "_id", "left").filter(F.col("y").isNotNull() | (F.pmod(F.xxhash64(F.col("_id"), F.lit(1)), F.lit(every)) == 0))

    def unit_sets(b):
        got = [sorted({u for w in set((t or "").lower().split()) for u in units_of(w)}) for t in b.column(0).to_pylist()]
        return {"y": b.column(1), "u": pa.array(got, pa.list_(pa.string()))}

    sets = by_slice(some.filter(F.col("y").isNotNull()).select("t", "y"), unit_sets, "y double, u array<string>")
    total = sets.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n1")).first()
    if not total.n or not total.n1 or total.n1 == total.n:
        return None
    rate = total.n1 / total.n
    counts = sets.select("y", F.explode("u").alias("u")).groupBy("u").agg(F.sum("y").alias("n1"), F.count(F.lit(1)).alias("n")).filter(F.col("n1") >= least)
    share = F.col("n1") / F.col("n")
    z = (share - rate) / F.sqrt(F.lit(rate * (1 - rate)) / F.col("n"))
    best = counts.filter(share > max(0.5, min(0.9, 3 * rate))).select("u", z.alias("z")).orderBy(F.desc("z"), "u").limit(units).toPandas()
    names = sorted(best["u"])
    deal = iter(range(len(names)))
    kind = np.array([next(deal) % GROUPS if u[0] == "=" else GROUPS + BEGIN.index(len(u) - 1) for u in names], np.int64)
    model = {"index": {u: i for i, u in enumerate(names)}, "kind": kind}

    def measured(b):
        u = Units(model["index"])
        got = [measure(t, u) for t in b.column(0).to_pylist()]
        return {"y": b.column(1), "hits": pa.array([h.tolist() for h, _ in got], pa.list_(pa.int64())), "facts": pa.array([f.tolist() for _, f in got], pa.list_(pa.float64()))}

    seen = by_slice(some.select("t", "y"), measured, "y double, hits array<bigint>, facts array<double>").toArrow()  # at most about 2 * max_docs rows
    y = np.array([np.nan if v is None else v for v in seen["y"].to_pylist()])
    both = [(np.array(h, np.int64), np.array(f)) for h, f in zip(seen["hits"].to_pylist(), seen["facts"].to_pylist())]
    x = np.array([features(h, f, model) for h, f in both])
    post, table, weight = label_model(x[:, len(names) :], y)
    return model | {"w": linear(x, post), "votes": table, "evidence": weight}


def score(text: str | None, units: Units, model: dict) -> float:
    hits, facts = measure(text, units)
    w, n = model["w"], len(model["kind"])
    z = w[-1] + w[n:-1] @ voted(hits, facts, model)
    if len(hits):
        at, c = np.unique(hits, return_counts=True)
        z += w[at] @ np.log1p(c)
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def predict(docs: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """``docs`` without ``text`` and with score (0 to 1) and predicted (1 from one half on)."""
    rest = [c for c in docs.columns if c not in (text, "score", "predicted")]
    rows = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(text).alias("_text"))
    held, key = docs.sparkSession.sparkContext.broadcast(model), ("toxic", uuid.uuid4().hex)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]] + ["score double", "predicted int"])

    def run(b):
        m = held.value
        u = recent(key, lambda: Units(m["index"] if m else {}))
        got = [score(t, u, m) if m else 0.0 for t in b.column(len(rest)).to_pylist()]
        return dict(zip(rest, b.columns)) | {"score": pa.array(got, pa.float64()), "predicted": pa.array([int(g >= 0.5) for g in got], pa.int32())}

    return by_slice(rows, run, schema)
