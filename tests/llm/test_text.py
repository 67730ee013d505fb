import random
import re

import numpy as np
import pyarrow as pa

from conftest import WORDS
from probefleet.llm import text as T


def random_texts(n):
    rng = random.Random(n)
    signs = [" ", "\n", "\t", "\x0b", "\x1c", " ", "a", "b", "é", "日", "🙂", ".", "\x85"]
    return [None if rng.random() < 0.05 else "".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_words_equal_the_pattern():
    texts = random_texts(300)
    t = T.texts(pa.array(texts))
    w = T.words(t)
    found = [t.data[a:b].tobytes().decode() for a, b in zip(w.start, w.end, strict=True)]
    want = [re.findall(WORDS, x or "") for x in texts]
    assert found == [x for words in want for x in words]
    assert w.counts.tolist() == list(map(len, want))
    assert w.owner.tolist() == [i for i, words in enumerate(want) for _ in words]


def test_hashes_tell_words_apart_wherever_they_stand():
    texts = ["ab ba a b aab aba baa", "baa x ab", "a" * 3000 + " ab " + "a" * 2999]
    t = T.texts(pa.array(texts))
    w = T.words(t)
    words = [t.data[a:b].tobytes() for a, b in zip(w.start, w.end, strict=True)]
    hashes = T.word_hashes(t.data, w.start, w.end).tolist()
    assert len(set(hashes)) == len(set(words))
    assert {x: h for x, h in zip(words, hashes, strict=True)} == dict(zip(words, hashes, strict=True))
    # The order of words counts, and so does the length of a gram.
    ids = np.arange(5, dtype=np.uint64)
    assert T.gram_hashes(ids, 2)[0] != T.gram_hashes(ids[::-1].copy(), 2)[-1]
    assert T.gram_hashes(ids, 3)[0] != T.gram_hashes(ids, 2)[0]
    many = np.random.default_rng(0).integers(0, 50, (200_000, 3)).astype(np.uint64)
    flat = T.gram_hashes(many.ravel(), 3)[::3]
    assert len(np.unique(flat)) == len(np.unique(many, axis=0))


def test_slices_keep_all_rows_in_order():
    texts = random_texts(200) + ["x" * 5000] + random_texts(50)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["i", "text"])
    parts = list(T.text_slices([batch.slice(0, 60), batch.slice(60, 0), batch.slice(60)], "text", 300))
    assert [i for p in parts for i in p.column("i").to_pylist()] == list(range(len(texts)))
    assert all(p.num_rows == 1 or len(T.texts(p.column("text")).data) <= 300 for p in parts) and len(parts) > 5
    assert list(T.text_slices([batch.slice(0, 0)], "text")) == []


def test_covered():
    assert T.covered(6, np.array([0, 1, 4]), np.array([2, 3, 5])).tolist() == [True, True, True, False, True, False]
    assert T.covered(0, np.zeros(0, int), np.zeros(0, int)).tolist() == []
