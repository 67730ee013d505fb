"""Phrase mining against counting all phrases in Python, also where fingerprints collide."""

import random
import re
from collections import Counter

import pytest

from probefleet.llm import phrases as P
from probefleet.llm.membership import members

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(rows, least, longest=5, top=2000):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(_LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + size])] += 1
    out = []
    for lang, found in counts.items():
        candidates = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        inside = {}
        for p, a in candidates.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    inside[p[i : i + size]] = max(inside.get(p[i : i + size], 0), a)
        kept = []
        for p, a in candidates.items():
            if inside.get(p, 0) >= a:
                continue
            cuts = [(1000 * a * totals[lang] // (found[p[:k]] * found[p[k:]]), k, found[p[:k]], found[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def mined(spark, rows, **settings):
    documents = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(rows)], "doc_id long, text string, lang string")
    return sorted(tuple(r) for r in P.mine_phrases(documents, **settings).select(*COLUMNS).collect())


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(7)
    words = ["Ab", "cd", "é", "日本", "the", "of", "x1", "--"]
    ends = [" ", " ", " ", "\t", "  ", ". ", "\n", ",", " :"]
    out = []
    for i in range(60):
        size = draw.choice([0, 1, 5, 40, 200])
        text = "".join(draw.choice(words[: 3 + i % 6]) + draw.choice(ends) for _ in range(size))
        out.append((text, draw.choice(["en", "en", None, "und", "fr"])))
    line = "a rare phrase of seven words here"
    out += [(f"{line}. {line}", "en")] * 8 + [(None, "en"), ("", None), ("...", "fr"), (None, None)]
    return out


@pytest.mark.parametrize("bits", [64, 12])
def test_phrases_equal_counting_all(spark, rows, bits):
    want = brute_force(rows, 6)
    assert len(want) > 50
    assert mined(spark, rows, least=6, bits=bits) == want


def test_top_and_longest(spark, rows):
    assert mined(spark, rows, least=4, longest=3, top=5) == brute_force(rows, 4, longest=3, top=5)
    assert mined(spark, rows, least=4, longest=2) == brute_force(rows, 4, longest=2)


def test_one_long_text_comes_in_stretches(spark, monkeypatch):
    text = " and. ".join(f"one two {i % 3} three" for i in range(3000)) + "x" * 5000
    seen = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
    batches = seen.selectExpr("text", "1L lang_key").toArrow().to_batches()
    parts = [grams for grams, _ in P.stretches(batches, 1000)]
    assert len(parts) > 20 and b"".join(g.texts.data.tobytes() for g in parts) == text.encode()
    whole = next(P.stretches(batches, 1 << 20))[0]
    for size in range(6):
        assert sum(len(g.starts(size)) for g in parts) == len(whole.starts(size))
    assert mined(spark, [(text, "en")], least=50) == brute_force([(text, "en")], 50)


def test_one_document_many_times_and_clashing_columns(spark):
    """A third of all rows is one row; columns named like the operator's own are not read."""
    rows = [("hot phrase here again", "en")] * 300 + [(f"other words {i} hot phrase", "en") for i in range(600)]
    documents = spark.createDataFrame([(1, t, x) for t, x in rows], "doc_id long, text string, lang string")
    documents = documents.selectExpr("*", "1 as key", "2 as fp", "'x' as phrase", "3 as n", "4 as rank", "5 as lang_key")
    got = sorted(tuple(r) for r in P.mine_phrases(documents).select(*COLUMNS).collect())
    assert got == brute_force(rows, 100)


def test_nothing_to_find(spark, corpus, odd_documents):
    assert P.mine_phrases(corpus.limit(0)).count() == 0
    assert P.mine_phrases(odd_documents).select(*COLUMNS).dtypes[0] == ("lang", "string")
    got = sorted(tuple(r) for r in P.mine_phrases(odd_documents, least=2).select(*COLUMNS).collect())
    assert got == brute_force([(r.text, r.lang) for r in odd_documents.collect()], 2)


def test_members_lose_nobody(spark):
    hashes = spark.range(5000).selectExpr("xxhash64(id) as h")
    known = hashes.toPandas()["h"].to_numpy()
    for most_bits in (1 << 27, 1 << 16, 64):
        found = members(hashes, most_bits).value
        assert found.has(known).all()
    strangers = spark.range(5000, 10000).selectExpr("xxhash64(id) as h").toPandas()["h"].to_numpy()
    assert members(hashes).value.has(strangers).mean() < 0.1
