import math
import random
import re
from collections import Counter, defaultdict
from unittest.mock import MagicMock

import pyarrow as pa
import pytest

from probefleet.llm import perplexity as P
from probefleet.llm import text as T
from conftest import WORDS

N = P.ORDER


def pieces(word):
    """Words of more than WORD_BYTES, cut between characters at each multiple."""
    raw, out, at = word.encode(), [], 0
    if len(raw) <= P.WORD_BYTES:
        return [word]
    cuts = []
    for cut in range(P.WORD_BYTES, len(raw), P.WORD_BYTES):
        while cut < len(raw) and raw[cut] & 0xC0 == 0x80:
            cut += 1
        cuts.append(cut)
    for cut in [*cuts, len(raw)]:
        if cut > at:
            out.append(raw[at:cut].decode())
        at = cut
    return out


def symbols(text):
    for word in re.findall(WORDS, text or ""):
        for piece in pieces(word):
            padded = P._BEGIN * (N - 1) + piece + P._END
            yield from (padded[i : i + N] for i in range(len(piece) + 1))


def brute_model(texts):
    """P(last symbol | the symbols before it) by the textbook formula."""
    counts = {N: Counter(g for t in texts for g in symbols(t))}
    for k in range(N - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    d = {}
    for k, c in counts.items():
        n = Counter(c.values())
        d[k] = P.discounts(n[1], n[2], n[3], n[4])
    total, left = defaultdict(float), defaultdict(float)
    taken = lambda k, n: d[k][min(n, 3) - 1]
    for k, c in counts.items():
        for g, n in c.items():
            total[g[:-1]] += n
            left[g[:-1]] += taken(k, n)

    def p(gram):
        if not gram:
            return 1 / (len(counts[1]) + 1)
        shorter = p(gram[1:])
        if gram[:-1] not in total:
            return shorter
        n = counts[len(gram)].get(gram, 0)
        own = (n - taken(len(gram), n)) / total[gram[:-1]] if n else 0.0
        return own + left[gram[:-1]] / total[gram[:-1]] * shorter

    return p, counts


def test_perplexity_matches_brute_force(spark, corpus, odd_documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    documents = corpus.select("doc_id", "text", "lang").unionByName(
        odd_documents.selectExpr("doc_id + 100000 doc_id", "text", "lang")
    )
    rows = documents.collect()
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and not r.toxic}
    p, _ = brute_model([r.text for r in rows if r.doc_id in good])
    cache = {}
    want = []
    for r in rows:
        grams = list(symbols(r.text))
        for g in grams:
            if g not in cache:
                cache[g] = -math.log(p(g))
        want.append((str(r.doc_id), len(grams), sum(cache[g] for g in grams)))
    # Several slices give the same as one.
    got = P.quality_classifier(documents, labels, slice_bytes=100_000).collect()
    mine = sorted((str(r.doc_id), r.n_symbols, r.perplexity or 1.0) for r in got)
    assert len(mine) == len(want)
    for (a, n, x), (b, m, cost) in zip(mine, sorted(want), strict=True):
        assert (a, n) == (b, m) and x == pytest.approx(math.exp(cost / n) if n else 1.0, rel=1e-6)
    one = P.quality_classifier(documents, labels).select("doc_id", "n_symbols", "kept")
    same = spark.createDataFrame(got).select("doc_id", "n_symbols", "kept")
    assert sorted(map(str, one.collect())) == sorted(map(str, same.collect()))


def test_probabilities_add_up():
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("abcd") for _ in range(rng.randint(1, 6))) for _ in range(30)) for _ in range(5)]
    p, counts = brute_model(texts)
    alphabet = [g for g in counts[1]]
    for context in list({g[:-1] for g in counts[N]})[:40] + ["zzzz"]:
        assert sum(p(context + a) for a in alphabet) + p(context + "?") == pytest.approx(1)


def test_verdicts(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = P.quality_classifier(documents, labels).join(labels, "doc_id").toPandas()
    assert got[(got.quality == 1) & (got.toxic == 0)].kept.mean() > 0.99
    assert got[got.quality == 0].kept.mean() < 0.5


def test_no_trusted_text_and_empty_tables(spark, odd_documents):
    labels = spark.createDataFrame([(1, 1, 1), (4, 0, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    got = P.quality_classifier(odd_documents, labels).collect()
    assert len(got) == odd_documents.count() and all(r.kept and r.perplexity is None for r in got)
    labels = spark.createDataFrame([(6, 1, 0), (6, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in P.quality_classifier(odd_documents, labels).collect()}
    assert got[6].kept and got[1].kept and got[1].perplexity is None and got[1].lang == "en" and got[2].lang == "und"
    assert got[8].perplexity > got[6].perplexity
    assert P.quality_classifier(odd_documents.limit(0), labels).count() == 0


def test_words_are_cut_between_characters():
    text = "é" * 100 + " short " + "日本" * 40 + " " + "x" * 64 + " " + "y" * 65
    t = T.texts(pa.array([text, None]))
    w = P._cut_words(t, T.words(t))
    found = [t.data[a:b].tobytes().decode() for a, b in zip(w.start, w.end, strict=True)]
    assert found == [x for word in text.split(" ") for x in pieces(word)]
    assert w.first.tolist() == [0, len(found), len(found)]


def test_discounts_stay_in_range():
    for n in [(0, 0, 0, 0), (1, 0, 0, 0), (5, 100, 2, 9), (0, 3, 3, 3), (100, 50, 20, 10)]:
        assert all(0 < d < k for k, d in enumerate(P.discounts(*n), 1))


def test_limits_come_from_unseen_documents(spark, corpus):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").where("quality = 1 and toxic = 0")
    sliced = P.slices(corpus, 100_000)
    picked = P.trusted_slices(sliced, labels, 100_000)
    got = P.unseen_scores(picked, P.trusted_counts(picked)).collect()
    rows = corpus.join(labels.select("doc_id"), "doc_id").withColumn("half", P.half(corpus.doc_id)).collect()
    models = [brute_model([r.text for r in rows if r.half != k])[0] for k in (0, 1)]
    assert {r.half for r in rows} == {0, 1} and len(got) == len(rows)
    mine = {r.doc_id: r for r in got}
    for r in rows[:20]:
        grams = list(symbols(r.text))
        assert mine[r.doc_id].n_symbols == len(grams)
        assert mine[r.doc_id].cost == pytest.approx(sum(-math.log(models[r.half](g)) for g in grams), rel=1e-5)


def test_one_pass_works_out_all_models(spark, corpus):
    """The driver holds what each job, its stages and its plan leave; a pass for each model took three times as many."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    context = spark.sparkContext
    context.setJobGroup("one-pass", "all models")
    try:
        assert P.quality_classifier(corpus, labels).count() == corpus.count()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert len(context.statusTracker().getJobIdsForGroup("one-pass")) < 120


def test_each_step_lets_go_what_a_worker_keeps(spark, monkeypatch):
    """A worker comes from other work, as packing with its tokenizer: not only the first step asks what may go."""
    frame = MagicMock()
    frame.count.return_value = 1
    for name in ("select", "groupBy", "agg", "join", "drop", "distinct", "mapInArrow", "cogroup", "applyInArrow"):
        getattr(frame, name).return_value = frame
    P.trusted_counts(frame), P.asked_grams(frame), P.document_costs(frame, frame)
    asked = []
    monkeypatch.setattr(T, "releases", [lambda: asked.append(1)])
    steps = [call.args[0] for call in frame.mapInArrow.call_args_list]
    assert len(steps) == 5
    for k, rows in enumerate(steps, 1):
        assert list(rows([])) == [] and len(asked) == 2 * k


def test_no_limits_without_two_halves(spark, corpus):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").where("quality = 1 and toxic = 0")
    one = labels.where(P.half(labels.doc_id) == 1)
    picked = P.trusted_slices(P.slices(corpus, 100_000), one, 100_000)
    assert picked.count() and P.unseen_scores(picked, P.trusted_counts(picked)).count() == 0
    got = P.quality_classifier(corpus, one).toPandas()
    assert len(got) == corpus.count() and got.kept.all() and got.threshold.isna().all() and got.perplexity.notna().any()


def test_hidden_labels(spark):
    """Half of the labels are hidden from the classifier, which meets these documents for the first time."""
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("lang = 'en' and doc_id % 2 = 0")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = P.quality_classifier(documents, labels.where("doc_id % 4 = 0")).join(labels.where("doc_id % 4 = 2"), "doc_id").toPandas()
    clean = got[(got.quality == 1) & (got.toxic == 0)]
    assert len(clean) > 300 and clean.kept.mean() > 0.96
    # A few toxic words weigh although the mean is that of clean text.
    assert got[(got.quality == 1) & (got.toxic == 1)].kept.mean() < 0.2
    assert got[got.quality == 0].kept.mean() < 0.3


def test_languages_that_labels_do_not_cover(spark, corpus):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    greek = [(10**6 + i, f"Το κείμενο {i} είναι καθαρό και μιλάει για τη θάλασσα, τα βουνά και τον ουρανό.", "el") for i in range(20)]
    greek.append((10**6 + 20, "Καθαρό κείμενο χωρίς γλώσσα, με αρκετές λέξεις για να το κρίνει κανείς.", None))
    documents = corpus.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(greek, "doc_id long, text string, lang string"))
    got = P.quality_classifier(documents, labels).toPandas()
    new = got[got.doc_id >= 10**6]
    assert len(new) == 21 and new.kept.all() and new.threshold.isna().all() and new.perplexity.notna().all()
    # Languages with enough trusted text are still judged.
    assert not got[got.lang == "en"].kept.all() and got[got.lang == "en"].threshold.notna().all()


@pytest.mark.parametrize("character", ["é", "語", "😀"])
@pytest.mark.parametrize("after", ["", " x", "\n"])
def test_words_of_all_lengths_are_cut_between_characters(character, after):
    for size in range(1, 401):
        for head in range(min(4, size)):
            word = "a" * head + character * ((size - head) // len(character.encode()))
            if not word:
                continue
            t = T.texts(pa.array(["first " + word + after, word]))
            w = P._cut_words(t, T.words(t))
            assert len(w.start) == len(w.end) and (w.end > w.start).all()
            pieces = [t.data[a:b].tobytes().decode() for a, b in zip(w.start, w.end, strict=True)]
            assert "".join(pieces) == "first" + word + after.strip() + word
            assert max(len(p.encode()) for p in pieces) < P.WORD_BYTES + 4
