import random
import re

import numpy as np
import pyarrow as pa
import pytest

from probefleet.llm import jaccard_join as J
from probefleet.llm.components import components
from conftest import WORDS

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(WORDS, (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def roots_of(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute(documents):
    documents = sorted(documents, key=lambda d: (d[0] is None, d[0] or 0))
    sets = [shingles(t) for _, t in documents]
    by_shingle = {}
    for i, s in enumerate(sets):
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    shared = {}
    for members in by_shingle.values():
        for k, i in enumerate(members):
            for j in members[:k]:
                shared[j, i] = shared.get((j, i), 0) + 1
    links = [(i, j) for (i, j), n in shared.items() if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n)]
    roots = roots_of(len(sets), links)
    return sorted((str(d), len(s), str(documents[r][0])) for (d, _), s, r in zip(documents, sets, roots, strict=True))


def result(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


def pairs(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_corpus(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute(pairs(documents))
    assert any(d != c for d, _, c in want)
    assert result(J.similarity_components(documents)) == want


def test_odd_documents(odd_documents):
    assert result(J.similarity_components(odd_documents)) == brute(pairs(odd_documents))
    assert J.similarity_components(odd_documents.limit(0)).count() == 0


@pytest.mark.parametrize("limits", [{}, {"job_shingles": 600, "bucket_entries": 200}])
def test_near_copies_in_one_group(spark, limits):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(4000)}"
    line = [word() for _ in range(12)]
    documents = []
    for base in range(4):
        text = [word() for _ in range((30, 80, 150, 400)[base])]
        for _ in range(40):
            copy = list(text)
            for _ in range(rng.randint(0, len(text) // 15 + 1)):
                at = rng.randrange(len(copy))
                if rng.random() < 0.5:
                    copy[at] = word()
                elif rng.random() < 0.5:
                    del copy[at]
                else:
                    copy.insert(at, word())
            documents.append((len(documents) * 7 % 1000 + 1, " ".join(copy)))
    documents += [(2000 + i, " ".join([*line, *(word() for _ in range(rng.randint(1, 20)))])) for i in range(60)]
    documents += [(3000 + i, documents[0][1].upper()) for i in range(20)] + [documents[5]] * 2
    documents += [(4000, "Four words are few"), (4001, "four  words are FEW"), (4002, "four words are"), (4003, None), (4004, " ")]
    df = spark.createDataFrame(documents, "doc_id long, text string").selectExpr("*", "1 as id", "2 as key", "3 as node")
    assert result(J.similarity_components(df, **limits)) == brute(documents)


def test_threshold_is_exact(spark):
    # Sets of 7 and 7 with 6 in common: 6 of 8; and 3 of 4 by size alone.
    a = "a b c d e f g h i j k"
    documents = [(1, a), (2, a.replace("k", "x")), (3, "p q r s t u v w"), (4, "p q r s t u v"), (5, "l m n o p q r"), (6, "l m n o p q")]
    df = spark.createDataFrame(documents, "doc_id long, text string")
    got = result(J.similarity_components(df))
    assert got == brute(documents)
    assert [c for _, _, c in got] == ["1", "1", "3", "3", "5", "6"]


def test_tree_bound_keeps_all_links():
    rng = np.random.default_rng(8)
    sets = []
    for _ in range(30):
        base = rng.integers(0, 2**63, rng.integers(4, 300), dtype=np.uint64)
        for _ in range(rng.integers(1, 12)):
            keep = base[rng.random(len(base)) < rng.uniform(0.7, 1)]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 2**63, rng.integers(0, len(base) // 4 + 1), dtype=np.uint64)])))
    sets = [s << np.uint64(1) for s in sets if len(s)]
    exact = [
        (i, j) for i in range(len(sets)) for j in range(i)
        if 100 * (n := len(np.intersect1d(sets[i], sets[j]))) >= 75 * (len(sets[i]) + len(sets[j]) - n)
    ]
    assert exact and roots_of(len(sets), J.linked_sets(sets)) == roots_of(len(sets), exact)


def test_hashed_shingles_match_words():
    texts = ["A b C", "a B c", "a b c d e", "a b c d e a b c d e", "", None, "é É", "x"]
    sets = J.shingle_sets(pa.array(texts))
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert (sets[0] == sets[1]).all() and J.set_node(sets[0]) == J.set_node(sets[1]) != J.set_node(sets[7])


def test_components_against_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)]
    edges += [(5000, 5000), (6000, -1)] + [(7000, 7000 + i) for i in range(50)]
    nodes = sorted({x for e in edges for x in e})
    at = {x: i for i, x in enumerate(nodes)}
    want = {x: nodes[r] for x, r in zip(nodes, roots_of(len(nodes), [(at[a], at[b]) for a, b in edges]), strict=True)}
    df = spark.createDataFrame([*edges, (None, 4)], "a long, b long")
    assert dict(components(df).collect()) == want
    assert components(df.limit(0)).count() == 0


def test_a_job_holds_little_beside_its_sets():
    import tracemalloc

    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)) for n in rng.integers(20, 250, 4000)]
    sets[7] = sets[4]
    tracemalloc.start()
    try:
        assert set(J.linked_sets(sets)) in ({(4, 7)}, {(7, 4)})
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 8 << 20
    sizes = np.array([len(x) for x in sets])
    assert J.count_vectors(sets, sizes).tolist() == [np.bincount((x >> np.uint64(56)).astype(int), minlength=256).tolist() for x in sets]


def test_candidates_share_enough_with_each_other(spark):
    # Nodes of 80 shingles: similar ones share 10 of their prefixes; a node with 7 shared ones may have a partner.
    entries, sizes = [], {i: 80 for i in range(40)}
    shingle = iter(range(10**6))
    # Any two of 40 nodes have one shingle in common, which links nothing, and all of them one more.
    entries += [(h, x) for i in range(40) for j in range(i) for h in [next(shingle)] for x in (i, j)]
    entries += [(h, x) for h in [next(shingle)] for x in range(40)]
    for a, b, n_a, n_b, shared in ((100, 101, 80, 80, 10), (102, 103, 80, 80, 9), (104, 105, 80, 108, 40), (106, 107, 81, 108, 10)):
        sizes |= {a: n_a, b: n_b}
        entries += [(h, x) for h in (next(shingle) for _ in range(shared)) for x in (a, b)]
    # Eight nodes have 12 shingles in common; two others share 6 of these, 4 among themselves.
    sizes |= {200 + i: 80 for i in range(10)}
    common = [next(shingle) for _ in range(12)]
    entries += [(h, 200 + i) for h in common for i in range(8)] + [(h, x) for h in common[:6] for x in (208, 209)]
    entries += [(h, x) for h in (next(shingle) for _ in range(4)) for x in (208, 209)]
    rows = spark.createDataFrame([*entries, *entries[:50]], "h long, node long")
    nodes = spark.createDataFrame(list(sizes.items()), "node long, n_shingles long")
    copies = {(i, j) for i in range(200, 208) for j in range(i + 1, 208)}
    found = {(min(r), max(r)) for r in map(tuple, J.candidate_edges(rows, nodes).collect())}
    assert found == {(100, 101), (106, 107), (208, 209)} | copies
    few = dict(components(J.candidate_edges(rows, nodes, most=5)).collect())
    assert {few[i] for i in range(200, 208)} == {200} and few[208] == few[209] and few[100] == few[101] and few[106] == few[107]
    assert not {*range(40), 102, 103, 104, 105} & set(few)


@pytest.mark.parametrize("paired_nodes", [1, 3, 30])
def test_shingles_of_many_documents(spark, paired_nodes):
    rng = random.Random(7)
    word = lambda n=3000: f"w{rng.randrange(n)}"
    line = [word() for _ in range(25)]
    documents = []
    for size in (12, 40, 120):
        text = [word() for _ in range(size)]
        for _ in range(25):
            copy = list(text)
            for _ in range(rng.randint(0, size // 25 + 1)):
                copy[rng.randrange(size)] = word()
            documents.append((len(documents), " ".join(copy)))
    documents += [(500 + i, " ".join([*line, *(word() for _ in range(rng.randint(1, 9)))])) for i in range(30)]
    documents += [(600 + i, " ".join(word(3) for _ in range(rng.randint(1, 30)))) for i in range(60)]
    df = spark.createDataFrame(documents, "doc_id long, text string")
    want = brute(documents)
    assert len({c for _, _, c in want}) < len(documents)
    assert result(J.similarity_components(df, paired_nodes=paired_nodes)) == want


def test_a_tile_has_a_bounded_number_of_small_sets(spark):
    clusters = spark.range(3 * J.JOB_SETS // 2).selectExpr("id as node", "0L as root", "7L as n_shingles")
    names = {x for r in J._jobs(clusters, J.JOB_SHINGLES).selectExpr("explode(jobs) as job").distinct().collect() for x in r}
    assert len(names) == 3


def test_points_that_are_linked_are_not_compared_again(monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64) * np.uint64(2)
    sets = [np.unique(np.append(base, rng.integers(0, 1 << 63, 2, dtype=np.uint64))) for _ in range(20 * J.FANOUT)]
    compared = []
    possible = J.CountTree._possible
    monkeypatch.setattr(J.CountTree, "_possible", lambda self, a, b: compared.append(len(a[1]) * len(b[1])) or possible(self, a, b))
    assert set(roots_of(len(sets), J.linked_sets(sets))) == {0}
    assert sum(compared) < 2 * J.FANOUT * len(sets)
