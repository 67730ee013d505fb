import hashlib
import random
import re

import pytest

from probefleet.llm import decontaminate as D

RULE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(RULE, (text or "").translate(LOWER))


def brute(documents, benchmark, window=10):
    windows = {}
    for item, text in benchmark:
        w = words(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1) if w else ():
            windows.setdefault(tuple(w[i : i + size]), set()).add("null" if item is None else str(item))
    sizes = {len(x) for x in windows}
    out = []
    for doc, text in documents:
        w, hit, items = words(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                found = windows.get(tuple(w[i : i + size]))
                if found:
                    hit.update(range(i, i + size))
                    items |= found
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        out.append((str(doc), len(w), len(hit), len(items), digest, bool(hit)))
    return sorted(out)


def result(df):
    return sorted((str(r[0]), *r[1:]) for r in df.collect())


def pairs(df, name):
    return [(r[name], r["text"]) for r in df.select(name, "text").collect()]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_corpus_matches_brute_force(spark, sf):
    documents = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    benchmark = spark.read.parquet(f"/root/testdata/{sf}/benchmark.parquet")
    want = brute(pairs(documents, "doc_id"), pairs(benchmark, "item_id"))
    assert any(r[5] for r in want)
    assert result(D.decontamination(documents, benchmark)) == want


def test_random_small_alphabet(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["a", "B", "c", "é"]) for _ in range(n))
    benchmark = [(i, text(rng.choice([0, 3, 4, 7, 9, 10, 11, 14, 25]))) for i in range(40)] + [(7, None), (None, text(12))]
    documents = [(i, text(rng.randint(0, 80))) for i in range(80)] + [(90, None), (91, benchmark[3][1]), (91, benchmark[3][1])]
    d = spark.createDataFrame(documents, "doc_id long, text string").selectExpr("*", "1 as start", "2 as item_id")
    b = spark.createDataFrame(benchmark, "item_id long, text string").selectExpr("*", "0 as doc_id")
    want = brute(documents, benchmark)
    assert result(D.decontamination(d, b)) == want
    found = D.find_leaks(d.select("doc_id", "text"), b, block_words=60)
    assert sorted((str(r.doc_id), sum(s.stop - s.start for s in r.spans), len(r["items"])) for r in found.collect()) == [
        (r[0], r[2], r[3]) for r in want
    ]


def test_single_word_item_and_empty_tables(spark, odd_documents):
    one = spark.createDataFrame([(1, "WORD"), (2, "日本語"), (3, "")], "item_id long, text string")
    assert result(D.decontamination(odd_documents, one)) == brute(pairs(odd_documents, "doc_id"), pairs(one, "item_id"))
    none = one.limit(0)
    rows = D.decontamination(odd_documents, none).collect()
    assert len(rows) == odd_documents.count() and not any(r.contaminated for r in rows)
    assert D.decontamination(odd_documents.limit(0), one).count() == 0


def test_leaks_are_cut_out_of_texts(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    filler = " ".join(f"w{i}" for i in range(12))
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    documents = spark.createDataFrame(
        [(1, f"{filler}\n{item.title()}, {filler}!"), (2, filler), (3, item), (4, None)], "doc_id long, text string"
    ).selectExpr("*", "cast(0 as long) n_chars")
    rows = {r.doc_id: r for r in D.without_leaks(documents, benchmark).collect()}
    assert rows[1].text == f"{filler}\n, {filler}!" and rows[1].n_chars == len(rows[1].text)
    assert rows[2].text == filler and 3 not in rows and rows[4].text is None
