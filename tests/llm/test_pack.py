import collections
import itertools
import random
import struct

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from tramline.llm import pack

LOAD = pack.loader(P.path("byte_bpe_50k.json"), P.PATTERN)
OWN = Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_curve_visits_neighbours():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        order = cells[np.argsort(pack.hilbert(cells, bits))]
        assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_ids_equal_the_tokenizers_library():
    r, ids = random.Random(4), LOAD()
    texts = ["".join(r.choice(["a", "word", " ", "  ", "\n", "\t", "1", "é", "\u3000", "\u00a0", "'s", "!?", "\U0001f600", "<|endoftext|>" if i % 9 == 0 else "x"]) for _ in range(60)) for i in range(1500)]
    texts += [" " * 300_000, "\n" * 300_000, "a" * 100_000, " \n" * 100_000 + "b", "!" * 100_000, "word " * 50_000 + " " * 200_000 + "end", "", None]
    for t, got in zip(texts, ids(texts)):
        assert got.tolist() == (OWN.encode(t, add_special_tokens=False).ids if t else []), (t or "")[:80]


def test_pieces_are_whole_and_gapless(frame, spark):
    texts = [None, "", "same text", "same text", "x\n y  z <|endoftext|>  end", "long " * 9000] + [f"text {i} " * (i % 70) for i in range(200)]
    rows = pack.pack(frame(texts), LOAD, length=256).collect()
    ids = {i: [*(OWN.encode(t, add_special_tokens=False).ids if t else []), 1] for i, t in enumerate(texts)}
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for d, want in ids.items():
        parts = sorted(by_doc[d], key=lambda r: r.start)
        assert [x for r in parts for x in struct.unpack(f"<{r.length}I", r.ids)] == want
        assert all(r.doc_tokens == len(want) for r in parts)
        assert [r.start for r in parts] == [0, *np.cumsum([r.length for r in parts])[:-1]]
    full = 0
    for parts in by_seq.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == [0, *np.cumsum([r.length for r in parts])[:-1]]
        assert sum(r.length for r in parts) <= 256
        full += sum(r.length for r in parts)
    assert full / (256 * len(by_seq)) > 0.97
    assert pack.pack(frame([]), LOAD).count() == 0


def test_copies_lie_together_and_null_ids_stay(frame):
    rows = [(None, "no id", None, None, None), (1, "a" * 50, "en", "s", 1), (1, "a" * 50, "en", "s", 1)]
    got = pack.pack(frame(rows), LOAD).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "None"]


def test_rows_without_id_spread_over_ranges(spark):
    """A third of the rows have no id and one text; ranges hold like numbers of tokens."""
    import public_tokenizers

    r = __import__("random").Random(2)
    texts = [(i if i % 3 else None, " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(20)) if i % 3 else "one text for all of them") for i in range(6_000)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(4)
    got = pack.pack(df, pack.loader(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN), full=2)
    sizes = {x["p"]: x["n"] for x in got.groupBy((F.col("sequence_id") / (1 << 40)).cast("int").alias("p")).agg(F.sum("length").alias("n")).collect()}
    assert len(sizes) == 4 and max(sizes.values()) < 1.3 * min(sizes.values())


def test_library_tables_only_for_texts_that_need_them():
    """The tokenizers library's tables are not kept beside the ranks until a text needs them; marks are those of the library."""
    import public_tokenizers

    ids = pack.loader(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)()
    ids.library = None
    plain = ids.one("some plain text")
    assert ids.library is None and len(plain)
    assert set(ids.marks) == {t.content for t in ids.tokenizer.get_added_tokens_decoder().values()}
    assert ids.library is not None and ids.tokenizer.encode("some plain text", add_special_tokens=False).ids == list(plain)
