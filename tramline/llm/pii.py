"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass: at-signs, plus signs, digits, address schemes and
identifier cues. A local parser expands each anchor to the boundaries of what it may belong to and
validates it. Kinds and their rules:

- ``email``, ``ip``, ``card``, ``phone``: as the four base patterns below would match, leftmost and
  non-overlapping per kind; matches that fail their check are dropped and not tried again.
- ``url``: any scheme followed by credentials before the host (``scheme://user:secret@host``, the user may be empty).
- ``iban``: after an IBAN cue, country, check digits and body of the country's length with remainder 1 modulo 97, in either
  case, with single blanks or hyphens.
- ``ssn``: after its cue, groups of 3, 2 and 4 digits, none of them zero, with the same blank, hyphen or nothing between.
- ``account``: after an account cue, 6 to 17 digits with single blanks or hyphens.

Cues and the words after them (``number``, ``id``, ``is`` and the like) are known in any case; quotes, colons and line ends may follow.

Positions are code points, ends exclusive. An added span inside a base span is left out, as is one that overlaps an added
span before it; one that reaches beyond the base spans it touches stays beside them, and masking replaces their union.

Defined cases: null text has no spans and stays null when masked; empty text has none; repeated rows are
treated each; other columns pass through (``masked``) or are not read (``find``).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.common import once, slices

# Kinds, patterns and cues.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "ssn", "account")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGITS = re.compile(r"[0-9]+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
URL = re.compile(r"[A-Za-z0-9._~%!$&'*+,;=-]*:[^\s@/]+@[A-Za-z0-9.-]+(?::[0-9]+)?")
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*\Z")
SOCIAL = re.compile(r"(?i:social)[\s_-]{1,2}\Z")
_AFTER = r"(?i:s?\.?(?:[\s_-]{0,2}(?:numbers?|num|no|nr|id|code|is|are|was)\b\.?){0,3})[\s:#=.\"'(]{0,6}"
IBAN = re.compile(_AFTER + r"([A-Za-z]{2}[0-9]{2}(?:[ -]?[A-Za-z0-9]){11,30})")
#: for a country without a listed length
IBAN_ANY = re.compile(_AFTER + r"([A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
ALNUM = re.compile(r"[A-Za-z0-9]")
SSN = re.compile(_AFTER + r"([0-9]{3}([ -]?)[0-9]{2}\2[0-9]{4})(?![0-9])")
ACCOUNT = re.compile(_AFTER + r"([0-9](?:[ -]?[0-9]){5,16})(?![0-9])")
CUES = {"iban": ("iban",), "ssn": ("ssn", "security"), "account": ("account", "acct")}
#: longest scheme looked for before its ``://``
SCHEME_MOST = 40
#: length of an IBAN by its country
IBAN_LENGTHS = {
    c: n
    for n, cs in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ TL OM SO", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in cs.split()
}


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for mark in "@+0123456789":
        a.add_word(mark, (mark, 1))
    a.add_word("://", ("url", 3))
    for kind, cues in CUES.items():
        for c in cues:
            for spelled in map("".join, product(*({x, x.upper()} for x in c))):
                a.add_word(spelled, (kind, len(c)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _email(text: str, at: int, done: int) -> tuple[int, int] | None:
    start = at
    while start > done and text[start - 1] in LOCAL:
        start -= 1
    tail = DOMAIN.match(text, at + 1) if start < at else None
    return (start, tail.end()) if tail else None


def _iban_ok(s: str) -> bool:
    body = s.replace(" ", "").replace("-", "")
    return int("".join(str(int(c, 36)) for c in body[4:] + body[:4])) % 97 == 1


def _url(text: str, at: int) -> tuple[int, int] | None:
    """Scheme, credentials and host around a ``://`` that ends at ``at``."""
    m = URL.match(text, at)
    first = max(0, at - 3 - SCHEME_MOST)
    scheme = SCHEME.search(text[first : at - 3]) if m else None
    return (first + scheme.start(), m.end()) if scheme else None


def _cued(kind: str, text: str, at: int, size: int) -> tuple[int, int] | None:
    """The identifier behind a cue of ``size`` letters that ends at ``at``."""
    if size == len("security") and not SOCIAL.search(text[max(0, at - size - 8) : at - size]):
        return None
    m = {"iban": IBAN, "ssn": SSN, "account": ACCOUNT}[kind].match(text, at)
    if not m:
        return None
    start, end = m.span(1)
    if kind == "iban":
        if n := IBAN_LENGTHS.get(m[1][:2].upper()):
            places = [i for i in range(start, end) if text[i] not in " -"]
            end = places[n - 1] + 1 if len(places) >= n else 0
        elif m := IBAN_ANY.match(text, at):
            end = m.end(1)
        if not m or not end or ALNUM.match(text, end) or not _iban_ok(text[start:end]):
            return None
    if kind == "ssn":
        digits = m[1].replace(" ", "").replace("-", "")
        if "000" == digits[:3] or "00" == digits[3:5] or "0000" == digits[5:]:
            return None
    return start, end


def spans(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) of a text, by start and then by kind as listed."""
    found, added = [], []
    done = dict.fromkeys(BASE, 0)
    for last, (what, size) in anchors.iter(text):
        if what == "@":
            if hit := _email(text, last, done["email"]):
                found.append((*hit, "email"))
                done["email"] = hit[1]
        elif what == "+":
            if last >= done["phone"] and (m := PHONE.match(text, last)):
                done["phone"] = m.end()
                if 9 <= sum(map(str.isdecimal, m[0])) <= 15:
                    found.append((*m.span(), "phone"))
        elif size == 1:
            if last >= done["card"]:
                m = CARD.match(text, last)
                done["card"] = m.end() if m else last + 1
                if m and m.end() - last >= 12:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        found.append((*m.span(), "card"))
            if last >= done["ip"]:
                m = IP.match(text, last)
                done["ip"] = m.end() if m else DIGITS.match(text, last).end()
                if m and all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                    found.append((*m.span(), "ip"))
        elif what == "url":
            if hit := _url(text, last + 1):
                added.append((*hit, "url"))
        elif hit := _cued(what, text, last + 1, size):
            added.append((*hit, what))
    return sorted(found + _apart(sorted(set(added)), found), key=lambda s: (s[0], KINDS.index(s[2])))


def _apart(added: list, base: list) -> list:
    """Added spans that lie in no base span and overlap no added one before them."""
    out, taken, i, reach, last = [], sorted(base), 0, 0, 0
    for s in added:
        while i < len(taken) and taken[i][0] <= s[0]:
            reach = max(reach, taken[i][1])
            i += 1
        if s[1] > reach and s[0] >= last:
            out.append(s)
            last = s[1]
    return out


def _anchors() -> ahocorasick.Automaton:
    return once("pii", automaton)


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id and ``found``, an array of (kind, start, end) in order."""
    rows = docs.select(F.col(id_col), F.col(text).alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for b in slices(batches):
            got = [[{"kind": k, "start": s, "end": e} for s, e, k in spans(t or "", _anchors())] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, kind)], names=[id_col, "found"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, found array<struct<kind:string,start:bigint,end:bigint>>")


def mask(text: str | None, anchors: ahocorasick.Automaton, label: Callable[[str], str] = lambda k: f"[{k.upper()}]") -> str | None:
    """The text with each stretch of overlapping spans replaced by the label of its first kind."""
    if not text:
        return text
    out, at = [], 0
    for s, e, k in spans(text, anchors):
        if s >= at:
            out += [text[at:s], label(k)]
        at = max(at, e)
    return "".join([*out, text[at:]]) if out else text


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; all columns stay."""
    at = docs.columns.index(text)

    def run(batches):
        for b in slices(batches):
            new = pa.array([mask(t, _anchors()) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)
