"""Secrets in texts: three fixed patterns, and values in credential contexts whose guess cost is high.

A credential context is a name (``pwd``, ``passphrase``, ``bearer`` ...), a sign of assignment and a value, or the user and
password of an address. The value's guess cost is the least cost of cutting it into spans, found by
dynamic programming over its places: what a guesser needs who knows words, dates, repeats and keyboard walks. Costs are
log10 of guesses, and each span adds ``JOIN`` for where it begins:

- word: log10 of its rank among the words, more for capitals, for letters written as digits or signs, and if reversed;
- date: days of the years up to 60 from 2000, with or without separators, or a year alone;
- repeat: cost of the repeated unit (itself cut by the same programme), and log10 of how often;
- walk: neighbouring keys of a keyboard, the digit row or the alphabet: log10 of starts, length and turns;
- brute force: log10 of the size of its class, for each character.

Words are the most frequent words of the corpus itself, counted over all documents, behind a short list of usual
passwords; a secret is seldom a run of letters, and the more frequent one is, the cheaper it rightly becomes. A value of
``LEAST`` or more is reported as ``guess``, whatever the base patterns found; those stay as they are.

Work per value is linear in its length: words reach at most ``LONGEST`` letters, units of repeats ``UNIT`` characters, and
brute-force spans need no length as their costs add up.

Defined cases: null and empty texts have no spans; a very long value is costed whole; placeholders (``${X}``,
``<secret>``, ``%s``) are no values; repeated rows are treated each; columns but id and text are not read; without any
words the list of passwords remains.
"""

from __future__ import annotations

import re
from collections import Counter
from math import comb, log10

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.llm.common import recent, slices
from tramline.session import cut

# Kinds, patterns, names, passwords, keyboard rows.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "guess")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: greedy runs that fail their length hold no later match, so the length may stand in the pattern
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
NAME = (
    "passwords?|passwd|passphrase|passcode|pass|pwd|pword|secrets?|tokens?|bearer|credentials?|auth(?:orization)?|"
    "(?:api|access|secret|private|account|storage|client|encryption|signing|master|session)[-_ ]?(?:key|token|secret|pass(?:word)?)|pin|passwort|kennwort|contrase(?:ñ|n)a|mot de passe|mdp|clave"
)
#: a sign of assignment; what stands before it decides
SIGN = re.compile(r"""[:=]>?|->|\x20(?=["'`])|(?<=[Bb]earer)\x20""")
BEFORE = re.compile(rf"""(?i)(?:(?<![^\W_])|(?-i:(?<=[a-z0-9])(?=[A-Z])))(?:{NAME})(?![^\W\d_])[0-9]{{0,3}}["'\]]{{0,2}}[\x20\t:=]{{0,4}}(?P<verb>\x20(?:is|was|ist|es|est))?\Z""")
AFTER = re.compile(r"(?i)[=>]?[\x20\t]{0,4}(?:(?:basic|bearer)\x20)?")
#: characters before a sign that can hold a name
BACK = 60
VALUE = re.compile(r"""(["'`])((?:(?!\1)[^\n\\]|\\.)+)\1|[^\s"'`,;<>()\[\]{}|]+""")
ADDRESS = re.compile(r"[a-z][a-z0-9+.-]{1,20}://[^\s/@:]{0,200}:([^\s/@]+)@", re.A)
HOLE = re.compile(r"(?s)[$%]?[<{(\[].*[>})\]]|%[sd]|\$\w+|[*.xX?_-]+|(?i:null|none|nil|true|false|undefined)|[a-z_]+(?:\.[a-z_]+)*\(.*")
PASSWORDS = (
    "password pass secret admin administrator root user guest test letmein welcome monkey dragon master login princess sunshine football baseball "
    "shadow superman batman hello freedom whatever trustno iloveyou starwars ninja mustang access flower hottie loveme changeme default example "
    "sample dummy placeholder your yours my the token key api demo temp qwerty azerty abc summer winter spring autumn"
).split()
BOARDS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED = dict(zip('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./"))
LEET = {"4": "a", "@": "a", "8": "b", "3": "e", "6": "g", "1": "i", "!": "i", "0": "o", "5": "s", "$": "s", "7": "t", "+": "t", "2": "z"}

LEAST, JOIN, LONGEST, UNIT, RANKED, HELD = 10.0, 0.5, 24, 16, 20_000, 200_000
WORD = re.compile(r"[^\W\d_]{3,24}")
DATE = re.compile(r"(\d{1,4})([-/._ ])(\d{1,2})\2(\d{1,4})", re.A)
YEAR = re.compile(r"(?:19|20)\d\d", re.A)


#: row and place of each key, a row being half a key to the right of that above; and the keys around each
AT = {c: (y, x + y / 2) for y, row in enumerate(BOARDS) for x, c in enumerate(row)}
KEYS = {c: {d for d, q in AT.items() if d != c and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1} for c, p in AT.items()}


def ranks(words: list[str]) -> dict[str, int]:
    """Rank from 1 of each word, the usual passwords first."""
    out: dict[str, int] = {}
    for w in [*PASSWORDS, *words]:
        out.setdefault(w, len(out) + 1)
    return out


def word_cost(piece: str, rank: dict[str, int]) -> float | None:
    """Cost of a piece as one word in any spelling, or None."""
    best = None
    small = piece.lower()
    if len(small) != len(piece):
        return None
    plain = "".join(LEET.get(c, c) for c in small)
    for form, extra in ((small, 0.0), (small[::-1], 0.3), (plain, None), (plain[::-1], None)):
        r = rank.get(form)
        if r is not None:
            more = extra if extra is not None else 0.3 * sum(a != b for a, b in zip(small, plain)) + (0.3 if form != plain else 0.0)
            cost = log10(r + 1) + more
            best = cost if best is None else min(best, cost)
    if best is None:
        return None
    upper, letters = sum(map(str.isupper, piece)), sum(map(str.isalpha, piece))
    if upper:
        usual = upper == letters or piece[0].isupper() and upper == 1 or piece[-1].isupper() and upper == 1
        best += 0.3 if usual else log10(sum(comb(letters, i) for i in range(1, min(upper, letters - upper) + 1)) + 1)
    return best


def date_cost(piece: str) -> float | None:
    """Cost of a piece as a date or year, or None."""
    if YEAR.fullmatch(piece):
        return log10(120)
    if m := DATE.fullmatch(piece):
        cuts = [(m[1], m[3], m[4])]
    elif piece.isascii() and piece.isdigit():
        cuts = [(piece[:i], piece[i:j], piece[j:]) for i, j in {4: [(1, 2), (2, 3)], 6: [(2, 4)], 8: [(2, 4), (4, 6)]}.get(len(piece), [])]
    else:
        return None
    best = None
    for a, b, c in cuts:
        for y, rest in ((a, (b, c)), (c, (a, b))):
            if len(y) not in (2, 4) or any(len(x) > 2 for x in rest):
                continue
            u, v = map(int, rest)
            year = int(y) if len(y) == 4 else 2000 + int(y) - 100 * (int(y) > 50)
            if abs(year - 2000) <= 60 and (1 <= u <= 31 and 1 <= v <= 12 or 1 <= u <= 12 and 1 <= v <= 31):
                cost = log10(365 * max(abs(year - 2000), 20)) + (0.6 if m else 0.0)
                best = cost if best is None else min(best, cost)
    return best


def brute_cost(c: str) -> float:
    if c.isascii():
        return 1.0 if c.isdigit() else log10(26) if c.isalpha() else log10(33)
    return 2.0


def _step(a: str, b: str, keyboard: bool) -> tuple | None:
    """Direction from one key or letter to a neighbouring one, or None."""
    if keyboard:
        return (AT[b][0] - AT[a][0], AT[b][1] > AT[a][1]) if b in KEYS.get(a, ()) else None
    d = ord(b) - ord(a) if a.isalnum() and b.isalnum() and a.isascii() and b.isascii() else 0
    return (d,) if abs(d) == 1 else None


def walks(s: str) -> list[tuple[int, int, float]]:
    """(start, end, cost) of the walks of three characters or more: from the start of a longest one, or up to ``LONGEST`` long."""
    keys = [SHIFTED.get(c, c.lower()) for c in s]
    out = []
    for keyboard in (True, False):
        i = 0
        while i + 2 < len(s):
            turns, j, way = [0, 0], i, None  # turns up to each place of the walk
            while j + 1 < len(s) and (now := _step(keys[j], keys[j + 1], keyboard)) is not None:
                if not keyboard and way not in (None, now):
                    break
                if j > i:
                    turns.append(turns[-1] + (now != way))
                way, j = now, j + 1
            for end in range(i + 3, j + 2):
                for start in {i, *range(max(i, end - LONGEST), end - 2)}:
                    out.append((start, end, log10((len(AT) if keyboard else 62) * (end - start)) + 0.8 * (turns[end - 1 - i] - turns[start + 1 - i])))
            i = max(j, i + 1)
    return out


def repeats(s: str) -> list[tuple[int, int, int]]:
    """(start, end, unit) of the longest repetition of a unit of each length that ends at each place."""
    out = []
    for p in range(1, min(UNIT, len(s) // 2) + 1):
        run = 0
        for j in range(p, len(s)):
            run = run + 1 if s[j] == s[j - p] else 0
            if run >= max(p, 2) and run % p == 0:
                out.append((j + 1 - run - p, j + 1, p))
    return out


def pieces(s: str, rank: dict[str, int], within: bool = False) -> list[tuple[int, int, float]]:
    """(start, end, cost) of the spans of ``s`` other than brute force, by end."""
    out = walks(s)
    if not within:
        units: dict[str, float] = {}
        for i, j, p in repeats(s):
            unit = s[i : i + p]
            if unit not in units:
                units[unit] = guess_cost(unit, rank, True)
            out.append((i, j, units[unit] + log10((j - i) // p)))
    for j in range(3, len(s) + 1):
        for i in range(max(0, j - LONGEST), j - 2):
            piece = s[i:j]
            if (c := word_cost(piece, rank)) is not None:
                out.append((i, j, c))
            if 4 <= j - i <= 10 and piece[0].isdigit() and piece[-1].isdigit() and (c := date_cost(piece)) is not None:
                out.append((i, j, c))
    return sorted(out, key=lambda x: x[1])


def guess_cost(s: str, rank: dict[str, int], within: bool = False) -> float:
    """log10 of the guesses that the cheapest cut of ``s`` into spans needs; inside a unit nothing repeats."""
    spans_, at = pieces(s, rank, within), 0
    best, brute = [0.0], JOIN  # least cost up to each place; least cost that ends in a brute-force span
    for j, c in enumerate(map(brute_cost, s), 1):
        least = brute = brute + c
        while at < len(spans_) and spans_[at][1] == j:
            least = min(least, best[spans_[at][0]] + JOIN + spans_[at][2])
            at += 1
        best.append(least)
        brute = min(brute, least + JOIN)
    return best[-1]


def values(text: str) -> list[tuple[int, int]]:
    """Places of values in credential contexts, in order and apart."""
    out: list[tuple[int, int]] = []

    def take(s: int, e: int) -> None:
        if e > s and (not out or s >= out[-1][1]) and not HOLE.fullmatch(text[s:e]):
            out.append((s, e))

    addresses = [m.span(1) for m in ADDRESS.finditer(text)][::-1]
    for m in SIGN.finditer(text):  # later signs have no earlier values
        at = AFTER.match(text, m.end()).end()
        if out and at + 1 < out[-1][1]:  # a value here, with a quote or without, would begin inside the last one
            continue
        before = BEFORE.search(text[max(0, m.start() - BACK) : m.start()])
        if not before or m[0] == " " and not before["verb"] and not text[max(0, m.start() - 6) : m.start()].lower() == "bearer":
            continue
        if v := VALUE.match(text, at):
            start, end = v.span(2) if v[1] else v.span()
            while end > start and not v[1] and text[end - 1] in ".:!?":
                end -= 1
            while addresses and addresses[-1] <= (start, end):
                take(*addresses.pop())
            take(start, end)
    for s, e in reversed(addresses):
        take(s, e)
    return out


def spans(text: str, rank: dict[str, int], least: float = LEAST, cost=guess_cost) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind), by start and then by kind as listed."""
    found = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(*m.span(), "access") for m in ACCESS.finditer(text)] + [(*m.span(), "hex") for m in HEX.finditer(text)]
    found += [(s, e, "guess") for s, e in values(text) if cost(text[s:e], rank) >= least]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def vocabulary(docs: DataFrame, text: str = "text", ranked: int = RANKED) -> list[str]:
    """The most frequent words of all texts, most frequent first, as many whole classes of equal counts as ``ranked`` words hold.

    Words are runs of 3 to 24 letters of any script.
    """

    def run(batches):
        held: Counter = Counter()

        def sent():
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()

        for b in slices(batches):
            for t in b.column(0).to_pylist():
                if t:
                    held.update(WORD.findall(t.lower()))
                if len(held) > HELD:
                    yield from sent()
        yield from sent()

    n = cut(docs.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    # counts are few; a class of equal counts comes whole or not at all, so no task sends more than is wanted
    classes = n.groupBy("n").agg(F.count(F.lit(1)).alias("c"))
    upto = classes.withColumn("s", F.sum("c").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)))
    least = upto.filter(F.col("s") <= ranked).agg(F.min("n")).first()[0]
    rows = [] if least is None else n.filter(F.col("n") >= least).collect()
    return [r["word"] for r in sorted(rows, key=lambda r: (-r["n"], r["word"]))]


def find(docs: DataFrame, words: list[str], least: float = LEAST, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id and ``found``, an array of (kind, start, end) in order. ``words`` are the guesser's, most frequent first."""
    rows = docs.select(F.col(id_col), F.col(text).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast("\n".join(words))  # at most RANKED words of LONGEST letters
    mark = hash(sent.value)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        rank = recent(("guesses", mark), lambda: ranks(sent.value.split("\n") if sent.value else []))
        known: dict[str, float] = {}

        def cost(value: str, rank: dict[str, int]) -> float:
            if value not in known:
                if len(known) >= 20_000 or len(value) > 1_000:
                    known.clear()
                known[value] = guess_cost(value, rank)
            return known[value]

        for b in slices(batches):
            got = [[{"kind": k, "start": s, "end": e} for s, e, k in spans(t or "", rank, least, cost)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, kind)], names=[id_col, "found"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, found array<struct<kind:string,start:bigint,end:bigint>>")
