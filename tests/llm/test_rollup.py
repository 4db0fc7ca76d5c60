import base64
import collections

import public_tokenizers as P
import tiktoken

from tramline.llm import rollup
from tramline.session import scratch_path

FILES = {"a": P.path("byte_bpe_50k.tiktoken"), "b": P.path("byte_bpe_multi_50k.tiktoken")}
LOAD = rollup.loader(FILES, P.PATTERN)
OWN = {k: tiktoken.Encoding(k, pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(p, "rb"))}, special_tokens={}) for k, p in FILES.items()}


def brute(docs):
    out = collections.Counter()
    for _, t, lang, source in docs:
        for k, c in OWN.items():
            out[source, lang, k, "docs"] += 1
            out[source, lang, k, "tokens"] += len(c.encode_ordinary(t or ""))
    return out


def read(r):
    out = collections.Counter()
    for x in r.totals().collect():
        out[x.source, x.lang, x.version, "docs"], out[x.source, x.lang, x.version, "tokens"] = x.n_docs, x.n_tokens
    return out


def test_batches(spark):
    cols = "doc_id long, text string, lang string, source string"
    frame = lambda rows: spark.createDataFrame(rows, cols)
    docs = [(1, "Hello  world\n it's", "en", "s0"), (2, None, "en", "s0"), (3, "un deux", None, "s1"), (4, "drei vier", "de", None), (None, "no id", "en", "s0"), (5, "", "en", "s9")]
    path = scratch_path(spark, "rollup-test")
    r = rollup.Rollup(spark, path, LOAD, list(FILES))
    assert r.totals().count() == 0
    assert r.commit("1", inserts=frame(docs)) and not r.commit("1", inserts=frame(docs))
    assert read(r) == brute(docs)
    r.commit("2", deletes=frame([docs[2], docs[2], (99, "", "", "")]))
    left = [d for d in docs if d[0] != 3]
    assert read(r) == brute(left)
    new = (4, "fünf sechs sieben", "de", "s7")
    again = rollup.Rollup(spark, path, LOAD, list(FILES))  # another session
    again.commit("3", revised=frame([new, (98, "unknown", "en", "s0")]))
    left = [d for d in left if d[0] != 4] + [new]
    assert read(again) == brute(left)
    # a batch that broke off left rows but is not done: it does not count, and committing it again does once
    frame([]).write.parquet(f"{path}/rows/batch=4")
    spark.createDataFrame([("x", "x", "a", 5, 5)], "source string, lang string, version string, n_docs long, n_tokens long").write.parquet(f"{path}/sums/batch=4")
    assert read(again) == brute(left)
    more = [(6, "more", "en", "s0")]
    assert again.commit("4", inserts=frame(more)) and not again.commit("4", inserts=frame(more))
    assert again.commit("5") and read(again) == brute(left + more) and again.batches() == ["1", "2", "3", "4", "5"]
