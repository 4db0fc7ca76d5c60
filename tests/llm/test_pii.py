import random
import re

from tramline.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
A = pii.automaton()


def brute(text):
    out = []
    for k, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 12 <= len(d) <= 19 and pii.luhn(d), "phone": lambda: 9 <= len(d) <= 15}[k]()
            if ok:
                out.append((*m.span(), k))
    return sorted(out, key=lambda s: (s[0], pii.BASE.index(s[2])))


def test_base_spans_equal_the_patterns():
    rnd = random.Random(3)
    for alphabet in ("ab.@-1 ", "0123. +-()", "4 -1.2+@ax", "12.25 ", "é+1 ()9-"):
        for _ in range(4000):
            s = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60)))
            assert [x for x in pii.spans(s, A) if x[2] in pii.BASE] == brute(s), s
    s = "ü a.b+c@x-y.co.uk, +49 (30) 1234-5678; 4111 1111 1111 1111, 10.0.0.255 256.1.1.1 1.2.3.4.5.6.7.8"
    assert pii.spans(s, A) == brute(s) and {x[2] for x in brute(s)} == set(pii.BASE)


def test_cues_and_schemes():
    s = "IBAN: GB82 WEST 1234 5698 7654 32, SSN 123-45-6789; account no. 12345678 at https://joe:pw@h.example/x, account of 3"
    kinds = {k: s[a:b] for a, b, k in pii.spans(s, A)}
    assert kinds["iban"] == "GB82 WEST 1234 5698 7654 32" and kinds["ssn"] == "123-45-6789" and kinds["account"] == "12345678"
    assert kinds["url"] == "https://joe:pw@h.example" and kinds["email"] == "pw@h.example"  # the base span stays beside the wider one
    assert pii.mask(s, A).endswith("at [URL]/x, account of 3")
    assert pii.spans("https://joe:p!w)@host/x", A) == [(0, 21, "url")]
    assert pii.spans("IBAN GB83 WEST 1234 5698 7654 32", A) == [] and pii.spans("SSN 000-12-1234", A) == []


def test_cues_in_any_case_and_iban_before_capitals():
    def one(s):
        return [(s[a:b], k) for a, b, k in pii.spans(s, A)]

    for cue in ("Social Security Number: ", "SOCIAL SECURITY NO. ", "social security ", "Ssn nr "):
        assert one(cue + "123-45-6789") == [("123-45-6789", "ssn")], cue
    for cue in ("Account Number: ", "Account No. ", "ACCOUNT NR ", "aCCount ", "Acct No "):
        assert one(cue + "12345678 of 3") == [("12345678", "account")], cue
    for after in (" BIC: X", " I owe", "", ".", " 12", "\nA"):
        assert one("IBAN: DE89 3704 0044 0532 0130 00" + after) == [("DE89 3704 0044 0532 0130 00", "iban")], after
    assert one("IBAN Number: NO9386011117947 ABC") == [("NO9386011117947", "iban")]
    assert one("IBAN DE89 3704 0044 0532 0130 00x") == [] and one("IBAN DE89 3704 0044 0532 0130") == []


SPELLINGS = {
    "account": (
        "accounts: 12345678|account number is 12345678|Account ID 12345678|ACCOUNT NUMBERS 12345678|account_number=12345678|accountNumber: 12345678"
        '|"account_id": "12345678"|acct #12345678|Acct. no. 12345678|account\n12345678|account no: 12-345-678|my account is 12345678 now'
    ),
    "ssn": (
        "SSN: 123456789|ssn 123 45 6789|SSN is 123-45-6789|Social-Security number 123-45-6789|social_security_number: 123456789|social\nsecurity 123-45-6789"
        '|"ssn": "123-45-6789"|SSNs: 123-45-6789|social security no. 123 45 6789'
    ),
    "iban": (
        "IBAN is DE89 3704 0044 0532 0130 00|iban de89370400440532013000|IBAN: DE89-3704-0044-0532-0130-00|IBAN\nDE89 3704 0044 0532 0130 00|IBAN:\r\nDE89370400440532013000"
        "|iban number is de89 3704 0044 0532 0130 00|IBAN (DE89370400440532013000)|IBAN=DE89370400440532013000|IBAN code: DE89370400440532013000|Iban no NO93 8601 1117 947"
        "|IBAN IS14 0159 2600 7654 5510 7303 39"
    ),
    "url": (
        "redis://:pw@cache:6379|amqp://u:pw@mq|mongodb://u:pw@db.example|mongodb+srv://u:pw@db|sftp://u:pw@h|SFTP://u:pw@h|postgresql://u:p%40w@h:5432|http://u:pw@10.0.0.1"
        "|jdbc:mysql://u:pw@h"
    ),
}


def test_spellings_of_cues_and_schemes():
    n = 0
    for kind, given in SPELLINGS.items():
        for s in given.split("|"):
            got = [s[a:b] for a, b, k in pii.spans(s, A) if k == kind]
            assert len(got) == 1 and [x for x in pii.spans(s, A) if x[2] in pii.BASE] == brute(s), s
            wanted = {"account": 8, "ssn": 9}.get(kind)
            assert wanted is None or sum(map(str.isdigit, got[0])) == wanted, s
            assert kind != "url" or s.removeprefix("jdbc:").startswith(got[0]), s
            n += 1
    assert n >= 40
    for s in ("security 123-45-6789", "ssn 123-45 6789", "ssn 000456789", "ssn 123-00-6789", "accounting 12345678", "account since 12345678", "://u:pw@h", "http://host:8080/a@b", "IBAN de88370400440532013000"):
        assert [x for x in pii.spans(s, A) if x[2] not in pii.BASE] == [], s


def test_ibans_whose_digits_are_a_card_are_masked_whole():
    rnd, cards = random.Random(6), {}
    for land in ("BE", "NO", "DK", "AT", "FI", "NL", "SI", "DE", "ES", "FR"):
        for _ in range(200):
            body = "".join(rnd.choice("0123456789") for _ in range(pii.IBAN_LENGTHS[land] - 4))
            check = 98 - int(body + "".join(str(int(c, 36)) for c in land) + "00") % 97
            iban = f"{land}{check:02d}{body}"
            s = f"pay to IBAN {iban} soon"
            found = pii.spans(s, A)
            assert (12, 12 + len(iban), "iban") in found and [x for x in found if x[2] in pii.BASE] == brute(s)
            assert pii.mask(s, A) == "pay to IBAN [IBAN] soon"
            cards[land] = cards.get(land, 0) + any(k == "card" for _, _, k in found)
    assert all(cards[x] > 5 for x in ("BE", "NO", "DK", "AT", "FI", "NL", "SI"))


def test_an_added_span_inside_a_base_span_adds_nothing():
    s = "account 4111 1111 1111 1111"
    assert pii.spans(s, A) == [(8, 27, "card")] and pii.mask(s, A) == "account [CARD]"


def test_long_texts_are_linear():
    for s in ("account " * 40_000, "://" * 60_000, "a" * 200_000 + "://", "http://a:" + "b" * 200_000, "iban " + "a1" * 100_000):
        assert [x for x in pii.spans(s, A) if x[2] in ("url", "iban", "account")] == []
    for s in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" + "(" * 100_000, "1 " * 100_000, "@" * 100_000):
        assert [x for x in pii.spans(s, A) if x[2] != "ip"] == []


def test_operators_and_edges(frame):
    texts = [None, "", "call +1 (555) 123-4567 or me@x.org", "me@x.org", "me@x.org"]
    rows = pii.find(frame(texts)).orderBy("doc_id").collect()
    assert [len(r.found) for r in rows] == [0, 0, 2, 1, 1]
    got = pii.masked(frame(texts)).orderBy("doc_id").collect()
    assert [r.text for r in got] == [None, "", "call [PHONE] or [EMAIL]", "[EMAIL]", "[EMAIL]"] and got[0].words == "w"
    assert pii.find(frame([])).count() == 0 and pii.masked(frame([])).count() == 0
