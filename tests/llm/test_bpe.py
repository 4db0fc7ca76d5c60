import base64
import random
import struct

import public_tokenizers as P
import tiktoken

from tramline.llm import bpe

LOAD = bpe.loader(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
OWN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}, special_tokens={})
HARD = ["", "a" * 3000, "ab" * 900, "é" * 700, "\n" * 200 + "a", " \n \n b", "a   b", "it's  we'll　x\xa0y ", "<|endoftext|>", "0123456789" * 99, "#" * 500, "the" * 777]


def ids(b):
    return list(struct.unpack(f"<{len(b) // 4}I", b))


def test_equals_library_on_random_texts():
    rnd, coder = random.Random(5), LOAD()
    for _ in range(3000):
        s = "".join(rnd.choice("aaabcdeéß  \n\t 12'sll.,!#\xa0　ø𝔘the ") for _ in range(rnd.randint(0, 90)))
        assert ids(coder.encode(s)) == OWN.encode_ordinary(s), s
    for s in HARD:
        assert ids(coder.encode(s)) == OWN.encode_ordinary(s), s[:20]


def test_join_is_associative():
    rnd, coder = random.Random(6), LOAD()
    for _ in range(400):
        b = bytes(rnd.choice(b"theingaton ") for _ in range(rnd.randint(3, 60)))
        i, j = sorted(rnd.sample(range(1, len(b)), 2))
        x, y, z = (tuple(coder.leaf(p)) for p in (b[:i], b[i:j], b[j:]))
        assert coder.join(coder.join(x, y), z) == coder.join(x, coder.join(y, z)) == tuple(coder.leaf(b))


def test_operator_round_trip_and_edges(frame, spark):
    texts = [*HARD, None, "twice", "twice"]
    got = bpe.decode(bpe.encode(frame(texts), LOAD), LOAD).orderBy("doc_id").collect()
    for t, r in zip(texts, got):
        assert ids(r.ids) == OWN.encode_ordinary(t or "") and bytes(r.decoded) == (t or "").encode()
        assert r.words == "w"  # other columns pass; the clashing one was replaced
    assert bpe.encode(frame([]), LOAD).count() == 0
