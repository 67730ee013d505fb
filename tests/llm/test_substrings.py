import hashlib
import random
import re

import numpy as np
import pytest

from probefleet.llm import substrings as S
from conftest import WORDS


def brute(documents):
    first = {}
    split = [re.findall(WORDS, t or "") for _, t in documents]
    rank = lambda d: float("inf") if d is None else d
    for (doc, _), w in zip(documents, split, strict=True):
        for i in range(len(w) - 49):
            key = hashlib.md5(" ".join(w[i : i + 50]).encode()).digest()
            first[key] = min(first.get(key, float("inf")), rank(doc))
    out = []
    for (doc, _), w in zip(documents, split, strict=True):
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - 49):
            if first[hashlib.md5(" ".join(w[i : i + 50]).encode()).digest()] < rank(doc):
                gone[i : i + 50] = True
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((str(doc), len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((str(r[0]), *r[1:]) for r in df.collect())


def pairs(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_corpus(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute(pairs(documents))
    assert sum(r[2] > 0 for r in want) > 50
    assert result(S.substring_digest(documents)) == want


def test_odd_documents(odd_documents):
    assert result(S.substring_digest(odd_documents)) == brute(pairs(odd_documents))
    assert S.substring_digest(odd_documents.limit(0)).count() == 0


@pytest.mark.parametrize("limits", [{}, {"group_segments": 3, "job_segments": 10}])
def test_passages_in_many_contexts(spark, limits):
    rng = random.Random(6)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passages = [fresh(n) for n in (49, 50, 51, 60, 75, 120, 400)] + [["a"] * 130, ["a", "b"] * 70]
    documents = []
    for i in range(90):
        words = fresh(rng.randrange(40))
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            cut = rng.randrange(10) if rng.random() < 0.5 else 0
            words += p[cut:] + fresh(rng.choice([0, 0, 1, 20]))
        sep = rng.choice([" ", "\n", "  ", "\t"])
        documents.append((1000 - 7 * i, sep.join(words)))
    documents += [documents[3], documents[3], (None, documents[4][1]), (None, documents[4][1]), (documents[5][0], documents[6][1])]
    df = spark.createDataFrame(documents, "doc_id long, text string").selectExpr("*", "1 as key", "2 as id", "3 as spans")
    want = brute(documents)
    assert result(S.substring_digest(df, **limits)) == want
    cut = S.without_repeats(df.select("doc_id", "text", "key"), **limits).collect()
    kept = sorted(
        (str(r.doc_id), hashlib.sha256(" ".join(re.findall(WORDS, r.text)).encode()).hexdigest()) for r in cut
    )
    assert kept == sorted((r[0], r[3]) for r in want) and cut[0].key == 1


def test_text_without_repeats_keeps_its_layout(spark):
    text = " ".join(f"x{i}" for i in range(60))
    rows = [(1, f"  {text}\n", 5), (2, f"\n\nlead  in\n{text} \t tail\n end ", 5), (3, None, 5), (4, "few\twords", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r.doc_id: r.text for r in S.without_repeats(df).collect()}
    assert got == {1: rows[0][1], 2: "\n\nlead  in\ntail\n end ", 3: None, 4: "few\twords"}


@pytest.mark.parametrize("depth", [1, 2, 3, 5, 8, 50])
def test_suffix_order_and_common_prefixes(depth):
    rng = random.Random(depth)
    texts = [[rng.randrange(3) for _ in range(rng.randrange(1, 30))] for _ in range(20)] + [[1] * 60, [1] * 70]
    words = np.array([x for t in texts for x in t])
    ends = np.repeat(np.cumsum([len(t) for t in texts]), [len(t) for t in texts])
    order, common = S.suffix_order(words, ends, depth)
    prefix = lambda p: words[p : min(p + depth, ends[p])].tolist()
    listed = [prefix(p) for p in order]
    assert listed == sorted(listed)
    for x, y, n in zip(listed, listed[1:], common, strict=False):
        equal = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        assert n == equal
