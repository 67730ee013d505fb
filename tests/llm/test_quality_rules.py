import re

import numpy as np
import pytest

from probefleet.llm import quality_rules as Q
from probefleet.llm import trees
from conftest import WORDS


def brute(text):
    text = text or ""
    words = re.findall(WORDS, text)
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    inside = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    lines, seen, duplicates = text.split("\n"), set(), 0
    for line in lines:
        if re.search(WORDS, line):
            duplicates += line in seen
            seen.add(line)
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": duplicates,
        "n_repeat_words": len(inside),
    }


@pytest.mark.parametrize("source", ["corpus", "odd_documents"])
def test_statistics_match_brute_force(spark, request, source):
    documents = request.getfixturevalue(source)
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    got = Q.quality_rules(documents, labels).collect()
    texts = documents.select("doc_id", "text").collect()
    assert len(got) == len(texts)
    want = sorted((str(r.doc_id), *brute(r.text).values()) for r in texts)
    assert sorted((str(r.doc_id), *(r[c] for c in Q.BASE_COLUMNS)) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_held_out_labels(spark):
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    # Trained on even doc_ids, judged on odd ones.
    judged = Q.quality_rules(documents, labels.where("doc_id % 2 = 0"))
    odd = judged.join(labels, "doc_id").where("doc_id % 2 = 1").toPandas()
    good, bad = odd[odd.quality == 1], odd[odd.quality == 0]
    assert (good.bad_probability < 0.5).mean() > 0.99
    assert (bad.kept).mean() < 0.1


def test_empty_tables(spark):
    documents = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.quality_rules(documents, labels).count() == 0
    one = spark.createDataFrame([(1, "a b c d e f g h i j k")], "doc_id long, text string")
    row = Q.quality_rules(one, labels).first()
    assert row.kept and row.bad_probability is None


def test_monotonic_and_flat_scoring():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 3))
    y = (x[:, 0] + 0.5 * np.sin(3 * x[:, 1]) + rng.normal(scale=0.5, size=2000) > 0).astype(float)
    model = trees.fit(x, y, {0: 1, 2: -1})
    assert ((model.score(x) > 0.5) == y).mean() > 0.8
    line = np.linspace(-3, 3, 200)
    for probe in x[:50]:
        for f, sign in ((0, 1), (2, -1)):
            grid = np.tile(probe, (200, 1))
            grid[:, f] = line
            assert (np.diff(model.score(grid)) * sign >= -1e-12).all()


def test_repeated_doc_ids_count_once(spark, monkeypatch):
    """However many rows have a doc_id, one of them goes to the driver."""
    rows = [(1, "good words of a text " * 20)] * 3000 + [(2, "### ### bad")]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(Q.trees, "fit", lambda x, y, monotonic: seen.append(x.shape))
    Q.fit_rules(documents, labels, sample_rows=2)
    assert [shape[0] for shape in seen] == [2]
