"""Language ID, toxicity, language model: held-out accuracy, brute-force base figures, edges."""

import collections
import math
import random
import types
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from pyspark.sql import functions as F

from tramline.llm import attention, common, langid, lm, pack, toxic
from tramline.llm.common import crc_mod

SF = "/root/testdata/sf0.001"
LOAD = pack.loader(P.path("byte_bpe_50k.json"), P.PATTERN)


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = crc_mod(F.col("doc_id"), 4) == 2
    model = langid.fit(docs.filter(~held))
    got = langid.predict(docs.filter(held).withColumn("score", F.lit("clash")), model).collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_language_backoff_and_edges(frame):
    rows = [(i, t, x, "s", 1) for i, (t, x) in enumerate([("der die das und", "de"), ("the and of to", "en")] * 3)]
    model = langid.fit(frame(rows), least=1)
    texts = [None, "", "123 !?", "the", "undies", "½", "the " * 60_000]
    got = [(r.lang_pred, r.score) for r in langid.predict(frame(texts), model).orderBy("doc_id").collect()]
    assert [g[0] for g in got] == ["und", "und", "und", "en", "de", "und", "en"] and got[0][1] == 0.0
    nothing = langid.fit(frame([(1, "text", None, "s", 1)]))
    assert langid.predict(frame(["text"]), nothing).first().lang_pred == "und"
    assert langid.predict(frame([]), model).count() == 0


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = crc_mod(F.col("doc_id"), 5) == 0
    model = toxic.fit(docs, labels, ~held)
    got = toxic.predict(docs, model).join(labels, "doc_id").filter(held).collect()
    pos, neg = [r.score for r in got if r.toxic], [r.score for r in got if not r.toxic]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert auc > 0.85 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert (model["evidence"] <= 1).all() and model["votes"].shape == (toxic.GROUPS + len(toxic.BEGIN) + len(toxic.OTHERS), 2, 3)


def test_label_model_discounts_copies():
    r = np.random.default_rng(0)
    y = (r.random(4000) < 0.3).astype(int)
    vote = lambda acc: np.where(r.random(4000) < acc, 2 * y - 1, 1 - 2 * y)
    one, two, three = vote(0.8), vote(0.8), vote(0.7)
    known = np.where(np.arange(4000) < 600, y, np.nan)
    post, table, weight = toxic.label_model(np.stack([one, one, one, two, three], 1), known)
    assert weight[0] < 0.5 < weight[3] and abs(table[3, 1, 2] - 0.8) < 0.06 and ((post > 0.5) == y).mean() > 0.8


def test_toxicity_edges(frame, spark):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    model = toxic.fit(frame([None, "you idiot", ""]), labels, F.lit(True))
    assert model is None and [r.score for r in toxic.predict(frame([None, "x"]), model).collect()] == [0.0, 0.0]
    assert toxic.predict(frame([]), model).count() == 0


def test_windows_score_each_token_once():
    docs = [np.arange(5, 5 + n) for n in (0, 1, 15, 16, 17, 31, 100)]
    ids, target, first, of = attention.windows(docs, 1, 2, 0)
    for i, d in enumerate(docs):
        t = target[of == i].ravel()
        assert t[t >= 0].tolist() == [*d, 2] and first[of == i].sum() == 1


def test_gradients_match_differences():
    r = np.random.default_rng(1)
    p = {k: v.astype("f8") for k, v in attention.start(9, 5).items()}
    rows, target = r.integers(0, 9, (3, attention.WINDOW)), r.integers(-1, 5, (3, attention.HOP))
    first = np.array([True, False, False])
    _, g = attention.step(p, rows, first, target)
    for k in p:
        at = tuple(int(r.integers(0, s)) for s in p[k].shape)
        up, down = ({**p, k: p[k].copy()} for _ in range(2))
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        there = np.flatnonzero(g["rows"] == at[0]) if k == "E" else at[:1]
        got = g[k][there[0], at[1]] if k == "E" and len(there) else 0.0 if k == "E" else g[k][at]
        diff = (attention.step(up, rows, first, target)[0] - attention.step(down, rows, first, target)[0]) / 2e-5
        assert math.isclose(diff, got, rel_tol=2e-3, abs_tol=2e-5), k


def test_scorer_equals_training_forward_and_sums_to_one():
    r = np.random.default_rng(2)
    counts = r.integers(1, 50, 30)
    shape = lm.Shape([r.integers(0, 30, 80) for _ in range(6)], counts)
    p = attention.start(shape.rows, shape.classes)
    scorer = attention.Scorer(p, shape.class_of, shape.row_of, shape.inside)
    probe = [np.array([3, 4])]
    total = np.exp([scorer.score([np.array([3, 4, t])], shape.begin, shape.end, shape.pad)[0] for t in range(30)])
    assert np.isfinite(total).all()
    # chains of one token: P(text with its end) summed over all next tokens stays within one
    assert 0 < np.exp(scorer.score(probe, shape.begin, shape.end, shape.pad)[0]) + total.sum() < 1


def test_scorer_equals_windows():
    """Scores by blocks equal those of windows taken one by one, as in training."""
    r = np.random.default_rng(5)
    docs = [r.integers(0, 30, n) for n in (0, 1, 15, 16, 17, 40, 100, 300)]
    shape = lm.Shape(docs, r.integers(1, 50, 30))
    p = attention.start(shape.rows, shape.classes)
    got = attention.Scorer(p, shape.class_of, shape.row_of, shape.inside).score(docs, shape.begin, shape.end, shape.pad, at_once=3)
    for d, g in zip(docs, got):
        rows, first, target = shape.windows([d])
        loss, _ = attention.step(p, rows, first, target)
        assert math.isclose(g, -loss * (len(d) + 1) + shape.inside[d].sum(), rel_tol=1e-4)


def test_base_scores_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.lit("x").alias("score"))
    docs = docs.union(spark.createDataFrame([(10**6, None, "x"), (10**6 + 1, "", "x"), (10**6 + 2, "Unheard-of-word the", "x")], docs.schema))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    count, end = collections.Counter(), 0
    for d, t in rows:
        if zlib.crc32(str(d).encode()) % 7 != 2:
            count.update((t or "").encode().lower().split())
            end += 1
    n, v = sum(count.values()) + end, len(count) + 1
    got = {r.doc_id: r for r in lm.score(docs.drop("score"), crc_mod(F.col("doc_id"), 7) != 2, LOAD, head=50, sample=40, steps=5, rounds=2).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        w = (t or "").encode().lower().split()
        want = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w) + math.log10((end + 1) / (n + v + 1))
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w) + 1, sum(count[x] > 0 for x in w) + 1, n)
        assert math.isclose(r.base_score, want, rel_tol=1e-9) and r.score < 0


def test_model_learns_order(spark):
    r = random.Random(3)
    text = lambda: " ".join(x for _ in range(60) for x in r.choice([("red", "apple"), ("blue", "sky"), ("old", "house")]))
    rows = [(i, text()) for i in range(120)] + [(1000, " ".join(r.choice(["red", "apple", "blue", "sky", "old", "house"]) for _ in range(120)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.score for x in lm.score(docs, F.col("doc_id") < 100, LOAD, sample=100, steps=60).collect()}
    assert max(got[i] for i in range(100, 120)) > got[1000] + 20  # held-out texts in the learned order are far likelier
    assert lm.score(docs.limit(0), F.lit(True), LOAD).count() == 0


def test_model_learns_from_every_document(spark):
    """Each pair of words is in few documents of many, among a third of copies of one text; all pairs are learned."""
    r = random.Random(4)
    names = "red apple blue sky old house green tree cold water long road small bird fast horse dark night warm bread deep river loud music".split()
    pairs = list(zip(names[::2], names[1::2]))
    rows = [(i, " ".join([*pairs[i % len(pairs)]] * r.randint(25, 35))) for i in range(240)] + [(300 + i, "same text " * 30) for i in range(120)]
    probes = [(1000 + i, " ".join((p if i % 2 == 0 else p[::-1]) * 20)) for i, p in enumerate(x for p in pairs for x in (p, p))]
    docs = spark.createDataFrame(rows + probes, "doc_id long, text string")
    got = {x.doc_id: x.score for x in lm.score(docs, F.col("doc_id") < 1000, LOAD, sample=4, steps=60).collect() if x.doc_id >= 1000}
    first = lambda i: " ".join(pairs[i])
    alike = [(first(i), got[1000 + 2 * i]) for i in range(len(pairs))]
    assert min(s for _, s in alike) > -90, alike  # 40 words; a pair that is not learned from costs twice as much


def test_neighbour_sums_by_parts_equal_brute_force():
    r = np.random.default_rng(8)
    docs = [r.integers(0, 20, n) for n in (0, 1, 2, 50, 7)]
    near, dirs = attention.Neighbours(20), attention.directions(20)
    near.add(docs[:2])
    near.add(docs[2:])
    want, half = np.zeros((20, attention.SIDES)), attention.SIDES // 2
    for d in docs:
        for a, b in zip(d[:-1], d[1:]):
            want[b, :half] += dirs[a]
            want[a, half:] += dirs[b]
    assert (near.x.T == want).all() and near.n.sum() == 60


def test_training_takes_every_window():
    r = np.random.default_rng(9)
    parts = [(r.integers(0, 9, (n, attention.WINDOW)), r.random(n) < 0.1, r.integers(0, 5, (n, attention.HOP))) for n in (3, 700, 0, 256, 1)]
    t = attention.Trainer(attention.start(9, 5), 0)
    taken, step = [], t.step
    t.step = lambda rows, *x: (taken.append(rows), step(rows, *x))
    for p in parts:
        t.read(*p)
    t.read(*(x[:0] for x in parts[0]), last=True)
    rows = lambda x: sorted(map(tuple, np.concatenate(x).tolist()))
    assert rows(taken) == rows([p[0] for p in parts])
    assert attention.train(attention.start(9, 5), iter(parts), 2, 0)[1] == 960


def test_training_and_scoring_drop_the_tables_of_reading(monkeypatch):
    """A worker's words with their ids grow with its texts; later steps need the memory and not the words."""
    r = np.random.default_rng(3)
    docs = [r.integers(0, 30, n) for n in (5, 40, 90)]
    shape, table = lm.Shape(docs, r.integers(1, 50, 30)), lm.WordTable([], np.zeros(0, int), np.arange(30) % 2 == 0)
    weights = attention.begun(shape.rows, shape.class_of_row, shape.share)
    raw = pa.array([d.astype("<u2").tobytes() for d in docs], pa.binary())
    read = {("ids", 1): "encoder", ("recent", "word ids"): ("key", "words")}
    old = {"words": {}, ("recent", "lm"): (("lm", "before"), "scorer")}

    monkeypatch.setattr(common, "_KEPT", read | old)
    batch = pa.RecordBatch.from_arrays([raw, pa.array([0, 1, 2])], names=["ids", "at"])
    got = list(lm._learned([batch], types.SimpleNamespace(value=(weights, shape, table)), "<u2", 2, 0))
    assert not common._KEPT and got[0]["n"].to_pylist() == [sum(len(d) // attention.HOP + 1 for d in docs)]

    monkeypatch.setattr(common, "_KEPT", read | old)
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8, 9]), raw], names=["row", "ids"])
    got = list(lm._scored([batch], types.SimpleNamespace(value=(weights, shape, table, 3)), ("lm", "now"), "<u2"))
    assert [k for k in common._KEPT] == [("recent", "lm")] and common._KEPT[("recent", "lm")][0] == ("lm", "now")
    assert got[0]["row"].to_pylist() == [7, 8, 9] and max(got[0]["score"].to_pylist()) < 0

    monkeypatch.setattr(common, "_KEPT", read | old)
    common.keep_only("ids", "word ids")
    assert common._KEPT == read


def test_number_of_classes():
    r = np.random.default_rng(10)
    shape = lm.Shape([r.integers(0, 200, 2000) for _ in range(5)], np.ones(200))
    assert shape.classes >= 49 and len(set(shape.class_of[:200])) > 31  # 48 and the end


def test_word_table_equals_brute_force():
    """Hashes tell beginnings apart, figures equal counts taken one by one, and probabilities of what can follow sum to one."""
    r = np.random.default_rng(11)
    begins = np.arange(40) < 15
    word = lambda: (int(r.integers(0, 15)), *map(int, r.integers(15, 40, r.integers(0, 4))))
    known = sorted({word() for _ in range(300)})
    counts = r.integers(1, 90, len(known))
    table = lm.WordTable([np.array(w) for w in known], counts, begins)
    pair, every, step, kinds = collections.Counter(), collections.Counter(), collections.Counter(), set()
    for w, n in zip(known, counts.tolist()):
        for i in range(1, len(w) + 1):
            e = w[i] if i < len(w) else 40
            pair[w[:i], e] += n
            every[w[:i]] += n
            step[w[i - 1], e] += 1
            kinds.add((w[i - 1], e))
    docs = [[word() for _ in range(n)] for n in (0, 1, 30, 200)]
    got = list(zip(*table.look([np.array([i for w in d for i in w], np.int64) for d in docs], 41)))
    for d in docs:
        before = ()
        for e in [i for w in d for i in w] + [41]:
            begin, seen, n, left, s_seen, s_every, s_kinds, _ = got.pop(0)
            over = e == 41 or e < 15
            assert begin == over
            if before == ():
                assert (seen, n, left) == (1, 1, 0)
            else:
                what = 40 if over else e
                assert (seen, n) == (pair[before, what], every[before]) and left == (0.5 if every[before] else 1)
                assert (s_seen, s_kinds) == (step[before[-1], what], max(1, len({x for a, x in kinds if a == before[-1]})))
                assert s_every == sum(c for (a, _), c in step.items() if a == before[-1])
            before = (e,) if over else (*before, e)
    assert not got
    others = [w for w in {word() for _ in range(200)} if w not in known]
    of = table.leaving([np.array(w) for w in others])
    for w, at in zip(others, of.tolist()):
        leaves = [i for i in range(1, len(w) + 1) if every[w[:i]] and not pair[w[:i], w[i] if i < len(w) else 40]]
        assert len(leaves) <= 1 and (at >= 0) == bool(leaves)
        assert not leaves or table.every[at] == every[w[: leaves[0]]]


def test_held_out_scores_near_the_unigram_base(spark):
    """The base gives every unheard word the share of one, so its sum over words passes one; the model does not beat it, but is within 15 % of its log (19 % before the word table)."""
    held = crc_mod(F.col("doc_id"), 7) == 2
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", held.alias("held"))
    got = lm.score(docs, ~F.col("held"), LOAD).filter("held").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got.s > 1.15 * got.b


def test_looking_up_finds_beginnings_without_searching_them():
    """a beginning is known from the pair that led to it, and how an id goes on from the pair too; only words that left the table are searched by id."""
    r = np.random.default_rng(12)
    begins = np.arange(40) < 15
    known = [np.array([int(r.integers(0, 15)), *r.integers(15, 40, r.integers(0, 4))]) for _ in range(200)]
    table = lm.WordTable(known, np.ones(200, int), begins)
    asked, step = [], table.step
    table.before = None
    table.step = lambda keys: (asked.append(len(keys)), step(keys))[1]
    docs = [np.concatenate(known[i : i + 20]) for i in range(0, 200, 20)]
    seen = table.look(docs, 41)[1]
    assert (seen > 0).all() and sum(asked) == len(docs)  # the first id of each text alone


def test_reading_sums_neighbours_of_words_once(monkeypatch, frame):
    """pairs inside a word are added once a word with its count, and the sums are those of whole texts."""
    texts = ["qxzjvkw words " * 50, "words", None, "", "other qxzjvkw " * 30, "  words words "]
    load = lm.word_ids(LOAD).ids
    vocab, wi = load.tokenizer.get_vocab_size(), lm.WordIds(load)
    want, pairs, taken = attention.Neighbours(vocab), attention.Neighbours.pairs, []
    want.add(wi([common.words(t) for t in texts]))
    monkeypatch.setattr(attention.Neighbours, "pairs", lambda self, left, right, times=1: (taken.append(len(left)), pairs(self, left, right, times))[1])
    runs = []
    docs = types.SimpleNamespace(schema={"row": types.SimpleNamespace(dataType=types.SimpleNamespace(simpleString=lambda: "bigint"))})
    docs.select = lambda *a: types.SimpleNamespace(mapInArrow=lambda run, kind: runs.append(run))
    lm._read(docs, LOAD, vocab)
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts), pa.array([True] * 6)], names=["row", "t", "learn"])
    got = [x for b in runs[0](iter([batch])) for x in b.to_pylist()]
    near = {x["key"]: x for x in got if x["kind"] == 1}
    assert sorted(near) == np.flatnonzero(want.n).tolist()
    assert all(x["n"] == want.n[k] and x["near"] == want.x[:, k].astype(int).tolist() for k, x in near.items())
    ids = [np.frombuffer(x["ids"], "<u2" if vocab <= 1 << 16 else "<u4").tolist() for x in got if x["kind"] == 3]
    assert ids == [x.tolist() for x in wi([common.words(t) for t in texts])]
    assert sum(taken) < sum(map(len, ids)) - 100  # fewer than pairs of ids in the texts


def _log_class(p, shape, before, c):
    """Log probability of class ``c`` after these ids, by the forward pass of training."""
    rows, first, target = shape.windows([before])
    return -attention.step(p, rows, first, np.where((np.arange(target.size) == len(before)).reshape(target.shape), c, -1))[0]


def test_scores_with_counts_equal_the_formula():
    """probabilities mixed once for all documents equal the formula taken id by id, also where the model's are tiny."""
    r = np.random.default_rng(13)
    begins = np.arange(30) < 12
    docs = [np.concatenate([[int(r.integers(0, 12))], r.integers(0, 30, n)]) for n in (0, 30, 200)]
    shape = lm.Shape(docs, r.integers(1, 50, 30), begins=begins)
    table = lm.WordTable([np.array([1, 15]), np.array([2, 16, 17])], np.array([5, 9]), begins)
    for tiny in (0, 90):
        p = attention.begun(shape.rows, shape.class_of_row, shape.share)
        p["b2"][attention.BEGIN :] -= tiny
        scorer = attention.Scorer(p, shape.class_of, shape.row_of, shape.inside)
        told = table.look(docs, shape.end)[:-1]
        got = scorer.score(docs, shape.begin, shape.end, shape.pad, told=told)
        want, at = [], 0
        assert np.isfinite(got).all() and (got < 0).all()
        if tiny:
            continue
        for d in docs[:2]:
            total = 0.0
            for i, t in enumerate([*d.tolist(), shape.end]):
                _, seen, every, left, s_seen, s_every, s_kinds = (float(y[at]) for y in told)
                log, first = _log_class(p, shape, d[:i], shape.class_of[t]) + shape.inside[t], t == shape.end or begins[t]
                over = np.logaddexp.reduce([_log_class(p, shape, d[:i], c) for c in [*range(attention.BEGIN), attention.CLASSES]])
                low = (s_seen + s_kinds * math.exp(over if first else log)) / (s_every + s_kinds)
                total += math.log((seen + left * low) / (every + left)) + (log - over if first else 0)
                at += 1
            want.append(total)
        assert np.allclose(got[:2], want, rtol=1e-4)
