"""Ranked search against scoring every document, and the index's strata and bounds."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from probefleet.llm import ranked_search as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(_LOWER))


def brute_force(documents, queries, top=10):
    counted = [(i, Counter(terms(t))) for i, t in documents]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_all, l_all = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in queries:
        scored = []
        for i, c, n in counted:
            m = 100 - 75 + 75 * n * n_all // l_all
            score = 0
            for t in terms(text):
                if t in c:
                    weight = math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1)))
                    score += weight * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        scored.sort(key=lambda x: x[:3])
        out += [(item, rank, i, -score) for rank, (score, _, _, i) in enumerate(scored[:top], 1)]
    return sorted(map(str, out))


@pytest.fixture(scope="module")
def documents():
    draw = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["É", "日本", "The", "X9"]
    shares = [1 / (i + 1) for i in range(len(words))]
    out = []
    for i in range(400):
        size = draw.choice([0, 1, 2, 5, 30, 30, 200])
        out.append((i, draw.choice([" ", "-", "_", "\n"]).join(draw.choices(words, shares, k=size))))
    out += [(1000 + i % 7, "copy of one text w1 w2 w39") for i in range(150)]
    return [*out, (None, "w1 w2 w3"), (None, None), (5, None), (6, ""), (7, "!!! ???"), (8, "w3 " * 5000), (9, "z" * 100_000)]


QUERIES = [
    (1, "w1 w39 É"), (2, "w39 W39 w39 w38"), (3, "nothing here"), (4, ""), (5, None), (None, "w20 the"), (7, "w5 " * 50 + "w6"),
    (8, " ".join(f"w{i}" for i in range(40))), (8, "copy of one text"), (9, "z" * 100_000), (9, "copy of one text"),
]


def ranked(spark, documents, queries=None, **settings):
    docs = spark.createDataFrame(documents, "doc_id long, text string").repartition(4)
    asked = spark.createDataFrame(queries or QUERIES, "item_id long, text string")
    out = R.ranked_search(docs, asked, **settings)
    return sorted(str(tuple(r)) for r in out.select("item_id", "rank", "doc_id", "score").collect())


@pytest.mark.parametrize("block_postings", [R.BLOCK_POSTINGS, 40])
def test_ranks_equal_scoring_every_document(spark, documents, block_postings):
    assert ranked(spark, documents, block_postings=block_postings) == brute_force(documents, QUERIES)


def test_batches_of_queries(spark, documents):
    docs = spark.createDataFrame(documents, "doc_id long, text string")
    asked = spark.createDataFrame([(i, i, t) for i, (_, t) in enumerate(QUERIES)], "item long, item_id long, text string")
    terms_ = R.query_terms(asked)
    got = R.search(R.build_index(docs), terms_, top=3, batch_entries=5).collect()
    want = brute_force(documents, [(i, t) for i, (_, t) in enumerate(QUERIES)], top=3)
    assert sorted(str((r["item"], r["rank"], r["doc_id"], r["score"])) for r in got) == want


def test_a_stratum_has_one_normaliser_and_bounds_hold(spark, documents):
    docs = spark.createDataFrame(documents, "doc_id long, text string")
    index = R.build_index(docs, block_postings=300)
    queries = R.Queries(np.array([0]), np.array([0, 3]), *_entries(["w1", "w39", "w7"]))
    seen = 0
    for batch in index.blocks.select(*R._BLOCK_COLUMNS).toArrow().to_batches():
        for block in R.Block.read(batch):
            visit, best = R.Visit(block, queries), R.Best(10**6, 0)
            visit.score(0, best)
            assert not len(best.scores) or best.scores.max() <= visit.bounds()[0]
            for i, j in zip(block.at[:-1], block.at[1:], strict=True):
                assert (np.diff(block.tf[i:j].astype(int)) <= 0).all()
            seen += len(block.doc_ids)
    assert seen == sum(bool(terms(t)) for _, t in documents)
    assert index.n_documents == seen
    largest = max(len(b) for b in index.blocks.toArrow().column("doc").to_pylist())
    assert largest < 4 * 5 * 300  # a stratum of 150 equal documents is in several blocks


def _entries(words):
    import pyarrow as pa

    _, _, hashes, _ = R.term_frequencies(pa.array([" ".join(words)]))
    found, entry = np.unique(hashes, return_inverse=True)
    return found, entry, np.full(len(words), 1000, np.int64)


def test_odd_and_empty_tables(spark, odd_documents):
    asked = spark.createDataFrame([(1, "word a b 日本語"), (2, None)], "item_id long, text string").selectExpr("*", "1 as item", "2 as term")
    got = R.ranked_search(odd_documents.selectExpr("*", "3 as m", "4 as part", "5 as tf"), asked)
    want = brute_force([(r.doc_id, r.text) for r in odd_documents.collect()], [(1, "word a b 日本語"), (2, None)])
    assert sorted(str(tuple(r)) for r in got.select("item_id", "rank", "doc_id", "score").collect()) == want
    assert R.ranked_search(odd_documents.limit(0), asked).count() == 0
    assert R.ranked_search(odd_documents, asked.limit(0)).count() == 0
