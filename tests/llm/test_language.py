import zlib

import numpy as np

from probefleet.llm import language as L
from probefleet.llm import text as T


def test_held_out_rule_and_accuracy(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.language_id(documents).toPandas().merge(documents.select("doc_id", "lang", "n_chars").toPandas(), on="doc_id")
    assert len(got) == 1000
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all()
    held = got[got.held_out & (got.n_chars > 100)]
    assert (held.lang_pred == held.lang).mean() > 0.98


def test_labels_of_held_out_documents_are_not_read(spark, corpus):
    from pyspark.sql import functions as F

    changed = corpus.withColumn("lang", F.when(L.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    changed = changed.withColumn("source", F.lit("other"))
    assert sorted(L.language_id(changed).collect()) == sorted(L.language_id(corpus).collect())


def test_odd_documents(odd_documents):
    rows = L.language_id(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    by_id = {r.doc_id: r for r in rows}
    for i in (1, 2, 3, 12):
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    assert all(r.lang_pred in {"en", "fr", "ja", "de", "und"} for r in rows)


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert L.language_id(empty).count() == 0
    unlabelled = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert L.language_id(unlabelled).first().lang_pred == "und"


def test_mixture_finds_both_languages():
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.full(L.BUCKETS, 0.05), size=3).astype(np.float32) + 1e-9
    p /= p.sum(axis=1, keepdims=True)
    model = L.Model(("a", "b", "c"), p, np.full(3, 1 / 3))
    counts = np.stack([
        rng.multinomial(3000, p[1].astype(float) / p[1].astype(float).sum()),
        rng.multinomial(3000, (m := (0.7 * p[0] + 0.3 * p[2]).astype(float)) / m.sum()),
    ]).astype(np.float32)
    share = L.proportions(counts, model)
    assert (share[0] > 0).tolist() == [False, True, False]
    assert (share[1] > 0).tolist() == [True, False, True]
    assert np.allclose(share[1], [0.7, 0, 0.3], atol=0.05)
    assert np.allclose(share.sum(axis=1), 1, atol=1e-5)


def test_gram_counts_stay_within_a_text():
    import pyarrow as pa

    both = np.concatenate([c for _, c in L.gram_counts(T.texts(pa.array(["ab cd", None, "Xy"])))])
    alone = [next(L.gram_counts(T.texts(pa.array([x]))))[1][0] for x in ("ab cd", "", "xY")]
    assert (both == np.stack(alone)).all()


def test_a_single_letter(spark):
    texts = ["a", "Z", "7", "a", " ", "é", "ab", "a.", None]
    documents = [(i, x, "en") for i, x in enumerate(texts)] + [(100 + i, "an alpha and a beta are letters", "en") for i in range(9)]
    rows = {r.doc_id: r for r in L.language_id(spark.createDataFrame(documents, "doc_id long, text string, lang string")).collect()}
    assert len(rows) == len(documents)
    for i, x in enumerate(texts):
        want = ("en", ["en"]) if x and any(map(str.isalpha, x)) else ("und", [])
        assert (rows[i].lang_pred, rows[i].languages) == want and rows[i].score == float(want[0] == "en")


def test_gram_counts_of_single_letters():
    import pyarrow as pa

    both = np.concatenate([c for _, c in L.gram_counts(T.texts(pa.array(["a", "xyz", None, "B", "q"])))])
    alone = [next(L.gram_counts(T.texts(pa.array([x]))))[1][0] for x in (" a ", "xyz", "", " b ", " q ")]
    assert (both == np.stack(alone)).all() and both.sum(axis=1).tolist() == [3, 3, 0, 3, 3]
