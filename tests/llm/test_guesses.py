import hashlib
import random
import re
import time
from collections import Counter
from math import log10

import pytest
from pyspark.sql import functions as F

from tramline.llm import guesses as g

PATTERNS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
LEAST = {"assign": 6, "access": 20, "hex": 24}
RANK = g.ranks("the of and correct horse battery staple house summer time with straße".split())


def brute_base(text):
    out = []
    for k, p in PATTERNS.items():
        for m in re.finditer(p, text, re.A):
            if len(m[2] if k == "assign" else m[0]) >= LEAST[k]:
                out.append((*m.span(), k))
    return sorted(out, key=lambda s: (s[0], g.BASE.index(s[2])))


def test_base_spans_equal_the_patterns():
    r = random.Random(1)
    parts = ["password", "Secret", "TOKEN", "api_key", "apikey", "passwd", "ſecret", "AKIA", "ABCD1234", "0123456789abcdef", "ff", '"', "'", " ", "  ", ":", "=", "==", "x", "é", "\n", "a.b-c", "secretsecret"]
    for _ in range(6000):
        s = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert [x for x in g.spans(s, RANK) if x[2] != "guess"] == brute_base(s), s


def naive(s):
    """Least cost over every way to cut ``s``, each piece by its cheapest reading."""
    costs = {}
    for i, j, c in g.pieces(s, RANK):
        costs[i, j] = min(c, costs.get((i, j), 99))
    best = 99.0
    for cut in range(2 ** (len(s) - 1)):
        ends = [i + 1 for i in range(len(s) - 1) if cut >> i & 1] + [len(s)]
        total, at = 0.0, 0
        for e in ends:
            total += g.JOIN + min(costs.get((at, e), 99), sum(map(g.brute_cost, s[at:e])))
            at = e
        best = min(best, total)
    return best


def test_cost_is_the_least_over_all_cuts():
    r = random.Random(6)
    parts = ["the", "time", "T1me", "qwe", "asdf", "123", "321", "1999", "aa", "xyx", "!", "Q", "7", "é", "and"]
    for _ in range(60):
        s = "".join(r.choice(parts) for _ in range(4))[:12]
        assert abs(g.guess_cost(s, RANK) - naive(s)) < 1e-9, s


def test_costs_follow_what_a_guesser_knows():
    c = lambda s: g.guess_cost(s, RANK)
    for easy in ("password", "P@ssw0rd", "drowssap", "qwertyuiop", "abcdefgh", "987654321", "aaaaaaaaaaaaaaaaaaaa", "abcabcabcabc", "1987-04-12", "12041987", "Summer2021", "SUMMERtime", "letmeinletmein", "%s" % "zxcvbnm,./"):
        assert c(easy) < g.LEAST, easy
    for hard in ("x8K#m!2pQz", "04dbebab91ab85687d33", "wJalrXUtnFEMI/K7MDENG", "correctstaplebatteryhorsesummer", "ñßøåæþðł"):
        assert c(hard) >= g.LEAST, hard
    assert g.date_cost("31.12.1999") and g.date_cost("12311999") and not g.date_cost("45.45.1999") and not g.date_cost("1.2.3000")
    assert abs(g.word_cost("time", RANK) - log10(RANK["time"] + 1)) < 1e-9 and g.word_cost("tIMe", RANK) > g.word_cost("TIME", RANK) > g.word_cost("time", RANK)
    assert g.word_cost("İstan", RANK) is None and c("İİİ") > 0 and c("") == 0


VALUE = "a8$kd!8sdK2"


@pytest.mark.parametrize(
    "text",
    [
        f"pwd: {VALUE}", f'{{"clientSecret": "{VALUE}"}}', f"conf['db_password'] = '{VALUE}'", f"pass -> {VALUE}.", f"secret := {VALUE}", f"Passwort: {VALUE}", f'SECRET => "{VALUE}"',
        f"the password is '{VALUE}'", f"Authorization: Bearer {VALUE}", f"curl -H bearer {VALUE}", f"db://joe:{VALUE}@host/x", f"mySecretKey={VALUE}", f"AWS_SECRET_ACCESS_KEY={VALUE}", f"mot de passe : {VALUE}", f"contraseña: {VALUE}",
        f"pin1={VALUE}", f"private key: {VALUE}, next", f"(passphrase: {VALUE})",
    ],
)
def test_contexts(text):
    assert [text[a:b] for a, b, k in g.spans(text, RANK) if k == "guess"] == [VALUE]


@pytest.mark.parametrize("text", ["the pass is over there", "password: ${SECRET_VALUE}", "pwd: <your password>", "token: None", f"spinning: {VALUE}", f"compass: {VALUE}", "pwd: summertime", "pwd: 12.04.1987", "pass:", "pwd = ", f"authors: {VALUE}", "pwd: getenv('X9$kdKd82mX')"])
def test_no_secret(text):
    assert not [s for s in g.spans(text, RANK) if s[2] == "guess"]


def test_long_texts_take_time_in_proportion():
    for s in ("pwd: " + "x" * 30_000, "pwd: " + "ab1$" * 8_000, "pass=" * 20_000, "token" * 20_000, "a" * 300_000, "://" * 50_000, '"' * 100_000):
        t = time.time()
        g.spans(s, RANK)
        assert time.time() - t < 20, s[:20]


def test_values_equal_those_of_all_signs():
    """Every sign and address asked, all found values put in order, those that begin inside an earlier one left out."""

    def plain(text):
        found = [m.span(1) for m in g.ADDRESS.finditer(text)]
        for m in g.SIGN.finditer(text):
            before = g.BEFORE.search(text[max(0, m.start() - g.BACK) : m.start()])
            if not before or m[0] == " " and not before["verb"] and not text[max(0, m.start() - 6) : m.start()].lower() == "bearer":
                continue
            if v := g.VALUE.match(text, g.AFTER.match(text, m.end()).end()):
                start, end = v.span(2) if v[1] else v.span()
                while end > start and not v[1] and text[end - 1] in ".:!?":
                    end -= 1
                found.append((start, end))
        out = []
        for s, e in sorted(set(found)):
            if e > s and (not out or s >= out[-1][1]) and not g.HOLE.fullmatch(text[s:e]):
                out.append((s, e))
        return out

    r, n = random.Random(2), 0
    parts = ["pwd", "pass", "pin", "token", "bearer", "basic ", " is", "=", ":", "=>", "->", ">", " ", "  ", "\t", '"', "'", "`", "\\", "\n", ".", "x9", "K$d8", "<a>", "${b}", "%s", "db://u:", "@h", "/", "1"]
    for _ in range(20_000):
        text = "".join(r.choices(parts, k=r.randint(2, 25)))
        assert g.values(text) == plain(text), text
        n += len(g.values(text)) > 1
    assert n > 200


def test_values_take_time_in_proportion():
    t = time.time()
    assert g.values("pass=" * 20_000) == [(5, 100_000)]
    assert time.time() - t < 3


def brute_ranks(n, ranked):
    order = sorted(n.items(), key=lambda x: (-x[1], x[0]))
    upto = {k: i + 1 for i, (_, k) in enumerate(order)}
    return [w for w, k in order if upto[k] <= ranked]


def test_vocabulary_counts_all_texts(spark, frame):
    texts = ["Straße the the x1", None, "", "THE off off off " * 50, "straße"]
    df = frame(texts)
    n = Counter(w for t in texts if t for w in re.findall(r"[^\W\d_]{3,24}", t.lower()))
    for ranked in (10, 2, 1):
        assert g.vocabulary(df, ranked=ranked) == brute_ranks(n, ranked)
    assert g.vocabulary(df, ranked=1) == ["off"] and g.vocabulary(frame([])) == []
    assert g.vocabulary(frame(["abc abd"]), ranked=1) == []  # two words of one count do not fit


def test_rows_null_empty_repeated(spark, frame):
    rows = [(1, f"pwd: {VALUE}", "en", "s", 1), (1, f"pwd: {VALUE}", "en", "s", 1), (None, "token=abcdef", "en", "s", 1), (3, None, None, None, None), (4, "", "", "", 0)]
    df = frame(rows).withColumn("found", F.lit("x"))
    got = sorted(((r["doc_id"], [(s["kind"], s["start"], s["end"]) for s in r["found"]]) for r in g.find(df, []).collect()), key=str)
    assert got == sorted([(1, [("guess", 5, 16)])] * 2 + [(None, [("assign", 0, 12)]), (3, []), (4, [])], key=str)
    assert g.find(frame([]), ["x"]).collect() == []


def test_query_equals_plain_python(spark):
    from tramline.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    n = Counter(w for _, t in docs if t for w in re.findall(r"[^\W\d_]{3,24}", t.lower()))
    rank = g.ranks(brute_ranks(n, g.RANKED))
    want = []
    for i, t in docs:
        base = brute_base(t or "")
        guess = [(a, b, "guess") for a, b in g.values(t or "") if g.guess_cost(t[a:b], rank) >= 10]
        every = sorted(base + guess, key=lambda s: (s[0], g.KINDS.index(s[2])))
        join = lambda spans: ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
        count = Counter(k for *_, k in every)
        want.append((i, *(count[k] for k in g.KINDS), hashlib.sha256(join(base).encode()).hexdigest(), join(every)))
    assert sorted(map(tuple, QUERIES["op12_secrets"](spark, sf).collect())) == sorted(want)
    assert any(w[1] for w in want)
