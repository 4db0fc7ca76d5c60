import itertools
import random

import pyarrow as pa
import pytest

from tramline.llm import common, ngram


def brute(texts, k, num, den):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])

    sets = [shingles(t) for t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(sets)), 2):
        a, b = sets[i], sets[j]
        if a and b and den * len(a & b) >= num * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


def corpus(seed):
    """Copies, near copies in chains, texts that share a passage, templates with other fillings, short and empty texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 5)))
    text = lambda n: [word() for _ in range(n)]
    docs, passage = [], text(40)
    for _ in range(12):
        t = text(r.randint(5, 120))
        docs.append(t)
        for _ in range(r.randint(0, 6)):  # a chain of edits
            t = list(t)
            for _ in range(r.randint(0, 2)):
                t[r.randrange(len(t))] = word()
            docs.append(t)
    base = text(100)
    for _ in range(40):  # a large group of near copies, and some just too far away
        t = list(base)
        for _ in range(r.choice((0, 1, 2, 4, 5, 6, 7))):
            t[r.randrange(len(t))] = word()
        docs.append(t)
    docs += [text(r.randint(0, 30)) + passage + text(r.randint(0, 30)) for _ in range(20)]
    docs += [text(3), text(3), ["X", "y"], ["x", "Y"], [], ["one"]]
    out = [" ".join(t) for t in docs]
    return out + [out[0], out[0].upper(), out[5].replace(" ", " \n\t"), " \n ", "", None]


@pytest.mark.parametrize("k,num,den,small", [(4, 85, 100, False), (5, 4, 5, True)])
def test_components_equal_brute_force(frame, monkeypatch, k, num, den, small):
    if small:  # many units and levels
        monkeypatch.setattr(ngram, "UNIT_SETS", 3)
        monkeypatch.setattr(ngram, "UNIT_TOKENS", 500)
    texts = corpus(k)
    got = sorted(tuple(r) for r in ngram.join(frame(texts), k, num, den).collect())
    assert got == brute(texts, k, num, den)


def test_search_finds_all_links():
    r = random.Random(1)
    sets = [frozenset(r.sample(range(60), r.randint(20, 45))) if i % 3 else frozenset(range(r.randint(0, 4), r.randint(36, 40))) for i in range(150)]
    index = ngram.Index(3, 5)
    for i, s in enumerate(sets):
        found = set(index.search(len(s), list(s), lambda at: False))
        assert found == {j for j in range(i) if ngram.linked(len(s), len(sets[j]), len(s & sets[j]), 3, 5)}
        index.add(len(s), list(s))


def test_units_free_memory_once(monkeypatch):
    """Thousands of small units lie in a task; what frees a worker's memory reads all its objects and is too slow for each of them."""
    calls = []
    monkeypatch.setattr(common.gc, "collect", lambda *_: calls.append(1))
    monkeypatch.setattr(common, "_KEPT", {"words": {}})
    unit = pa.table({"asks": [True] * 2, "keeps": [True] * 2, "sid": [5, 6], "comp": [5, 6], "n": [3, 3], "tokens": pa.array([[1, 2, 3]] * 2, pa.list_(pa.int64()))})
    for _ in range(50):
        assert ngram.unit_edges(unit, 4, 5).to_pylist() == [{"a": 6, "b": 5}]
    assert len(calls) == 1 and not common._KEPT


def test_edges(frame, spark):
    assert ngram.join(frame([])).collect() == []
    rows = [(None, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (7, "A b c d e f", None, None, None), (7, "A b c d e f", None, None, None), (2, None, "en", "s", 1)]
    got = sorted((tuple(r) for r in ngram.join(frame(rows)).collect()), key=str)
    assert got == [(1, 2, 1), (2, 0, 2), (7, 2, 1), (7, 2, 1), (None, 2, None)]
    assert all(c == i for i, _, c in (tuple(r) for r in ngram.join(frame(["a b", "c d", ""])).collect()))
