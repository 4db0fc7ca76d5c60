import random

import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_work_on_what_was_kept(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert 0.5 * n < docs.count() <= n
        n = docs.count()
    pieces = cp.STAGES[-1][1](spark, docs, SF).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_decisions(spark):
    r = random.Random(1)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    a = text(60)
    near = a.split()
    near[30] = "other"
    rows = [(1, a, "en", "s", 300), (2, a, "en", "s", 300), (3, " ".join(near), "en", "s", 300), (3, " ".join(near), "en", "s", 300), (4, text(60), "en", "s", 300), (4, text(60), "en", "s", 300), (None, a, "en", "s", 300), (5, None, None, None, None), (6, "1 2 3 " * 30, "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = [x.doc_id for x in cp.near_duplicates(spark, docs, SF).collect()]
    assert sorted(map(str, left)) == ["1", "4", "4", "5", "6", "None"]  # rows of one id with other texts are no copies
    good = [x.doc_id for x in cp.quality(spark, docs, SF).collect()]
    assert 5 not in good and 6 not in good and {1, 2, 3, 4} <= set(good)
    known = [x.doc_id for x in cp.language(spark, docs, SF).collect()]
    assert 5 not in known and 6 not in known and 1 in known
    masked = cp.personal_data(spark, spark.createDataFrame([(1, "to me@x.org", "en", "s", 11), (2, None, None, None, None)], docs.schema), SF).collect()
    assert [(m.text, m.n_chars) for m in masked] == [("to [EMAIL]", 10), (None, None)]
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
