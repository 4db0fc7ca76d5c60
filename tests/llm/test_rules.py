import collections
import math
import random
import re

from pyspark.sql import functions as F

from tramline.llm import rules


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = collections.defaultdict(list)
    for i in range(len(w) - 7):
        seen[tuple(w[i : i + 8])].append(i)
    hit = {i + j for at in seen.values() if len(at) > 1 for i in at for j in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_statistics_equal_brute_force(frame):
    r = random.Random(2)
    texts = [None, "", " \n\t", "one", "\x0b\x0c x\xa0y  z ", "a b c d e f g h " * 3, "a " * 50, "é # | <b>\n\n é # | <b>\n x "]
    texts += ["".join(r.choice(["a ", "b ", "c ", "\n", "dé ", "#", "\t", "\xa0", "\r\n"]) for _ in range(r.randint(0, 200))) for _ in range(150)]
    got = rules.statistics(frame(texts)).orderBy("doc_id").collect()
    for t, g in zip(texts, got):
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == brute(t), t
    assert got[0].words == "w" and rules.statistics(frame([])).count() == 0


def test_binomial_tail_is_exact(spark):
    cases = [(k, n, a) for n in (1, 5, 60, 900, 20_000) for a in (0.0125, 0.1) for k in (0, 1, 3, 40, 200, 1900)]
    for a in (0.0125, 0.1):
        rows = [(k, n) for k, n, b in cases if b == a and k <= n]
        df = spark.createDataFrame(rows, "k long, n long").withColumn("p", rules.binomial_tail(F.col("k"), F.col("n"), a))
        for k, n, p in df.collect():
            exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(a) + (n - j) * math.log1p(-a)) for j in range(k + 1))
            assert math.isclose(p, exact if k < n * a else 1.0, rel_tol=1e-6)


def test_cutoffs_keep_the_promise(spark):
    r = random.Random(4)
    good = [("en", float(r.random() < 0.004)) for _ in range(4000)] + [("xx", 0.0)] * 20
    cols = {c: "double" for over_under in rules.RATIOS.values() for c in over_under}
    df = spark.createDataFrame([(s, *[1.0 if c in ("n_words", "n_lines", "n_letters") else 0.9 * bad for c in cols]) for s, bad in good], "lang string, " + ", ".join(f"{c} {k}" for c, k in cols.items()))
    got = {x.stratum: x.cutoffs for x in rules.cutoffs(df, "lang").collect()}
    share = sum(b for _, b in good) / 4000
    assert set(got) == {"en"} and set(got["en"]) == set(rules.RATIOS)  # too few labels prove nothing
    assert all(c == 0.15 for c in got["en"].values()) and share < 0.05 / len(rules.RATIOS)
    strict = {x.stratum: x.cutoffs for x in rules.cutoffs(df, "lang", alpha=0.004 * len(rules.RATIOS)).collect()}
    assert all(c >= 1.0 for c in strict["en"].values())  # a rule at 0.9 would reject more than may be


def test_verdicts_and_edges(frame, spark):
    labels = spark.createDataFrame([(i, 1) for i in range(900)] + [(None, 1), (5, None), (10**9, 1)], "doc_id long, quality int")
    plain = "word other " * 3 + " ".join(f"w{i}" for i in range(30))
    texts = [plain + f" x{i}" for i in range(900)] + [" ".join(f"q{i}###" for i in range(40)), None, "few words"]
    got = {r.doc_id: r for r in rules.judge(rules.statistics(frame(texts)), labels).collect()}
    assert all(got[i].kept for i in range(900)) and not got[900].kept and got[900].failed_rules == ["symbols_per_word"]
    assert got[901].base_failed and not got[902].kept and len(got) == 903
    none = rules.judge(rules.statistics(frame(texts[-3:])), labels.limit(0)).orderBy("doc_id").collect()
    assert [r.kept for r in none] == [True, False, False]
