import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from probefleet.llm import packing as K
from probefleet.llm import text as T


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


ODD = [
    "", " ", "  two  blanks", "a b", " a", "a ", "a\n b", "a \nb", "tab\t b\t\tc", "don't  we'll 's", "x  y  z", "日本 語 テキスト",
    "é à  ç É", "<|endoftext|> a <|endoftext|>", "###  $$ %% a1b2 12 34", "  em  space", "\x1c x \x1d", "🙂 🙂🙂", "a" * 5000, " \r\n \r\n x",
    "\u0085 n  o", "ó combined ́",
]


def test_segments_give_the_same_ids(tokenizer):
    mine = K.SegmentTokenizer("byte_bpe_50k.json")
    rng = random.Random(7)
    signs = [" ", " ", "  ", "\n", "\t", " ", "a", "B", "é", "1", "#", "'s", "日", "　", ".", "\u0085", " ", "ß", "word"]
    texts = ODD + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    for _ in range(2):
        ids, first = mine.ids(T.texts(pa.array([*texts, None])))
        got = [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
        assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts] + [[]]


def test_short_texts_are_encoded_in_few_calls(tokenizer):
    """Texts that begin with other segments do not break up what is encoded together."""
    mine, calls = K.SegmentTokenizer("byte_bpe_50k.json"), []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            calls.append(len(texts))
            return tokenizer.encode_batch_fast(texts, **options)

    mine.tokenizer = Counted()
    texts = [f"Text{i} of words{i} and {chr(0x4E00 + i)} signs{i}" for i in range(300)]
    ids, first = mine.ids(T.texts(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [
        tokenizer.encode(t, add_special_tokens=False).ids for t in texts
    ]
    assert len(calls) == 2 and len(ids) > 2000


def check(rows, documents, tokenizer, capacity, with_ids):
    want = []
    for doc, text in documents:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % capacity or min(capacity, len(ids))
        cuts = [0, *range(first, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            raw = np.array(ids[a:b], "<u4").tobytes()
            want.append((str(doc), k, a, b - a, zlib.crc32(raw), *([ids[a:b]] if with_ids else [])))
    got = [(str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32, *([np.frombuffer(r.ids, "<u4").tolist()] if with_ids else [])) for r in rows]
    assert sorted(got) == sorted(want)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences), -(-sum(x[3] for x in want) // capacity)


def test_corpus(spark, tokenizer):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = K.pack_documents(documents, with_ids=False, block_pieces=200).collect()
    used, least = check(rows, [tuple(r) for r in documents.collect()], tokenizer, 2048, False)
    assert used <= least + 2


def test_odd_documents(spark, odd_documents, tokenizer):
    documents = [tuple(r) for r in odd_documents.select("doc_id", "text").collect()]
    for capacity in (2048, 16):
        check(K.pack_documents(odd_documents, capacity=capacity).collect(), documents, tokenizer, capacity, True)
    assert K.pack_documents(odd_documents.limit(0)).count() == 0


def test_items_that_leave_no_room(spark):
    items = spark.createDataFrame([(i, 60) for i in range(50)], "uid long, size long")
    got = K.pack_items(items, 100, block_pieces=4).collect()
    assert len({r.sequence_id for r in got}) == 50 and {r.offset for r in got} == {0}


@pytest.mark.parametrize("small", [0, 40])
def test_blocks_stay_bounded(spark, monkeypatch, small):
    """Large pieces that fill no sequence, alone or with some tiny ones, are not gathered in a larger block."""
    items = spark.createDataFrame([(i, 5 if i < small else 1500 if i % 3 else 1100 + i % 400) for i in range(600)], "uid long, size long")
    seen, blocks = [], K._blocks

    def watched(left, n, level):
        out = blocks(left, n, level)
        seen.append(max((len(r.uids) for r in out.collect()), default=0))
        return out

    monkeypatch.setattr(K, "_blocks", watched)
    rows = K.pack_items(items, 2048, block_pieces=50).collect()
    assert len(rows) == len({r.uid for r in rows}) == 600 and len({r.sequence_id for r in rows}) <= 600 - small * 0.9
    assert all(n < 100 for n in seen) and len(seen) <= 3 and bool(seen) == bool(small)
    sizes = {r.uid: r["size"] for r in items.collect()}
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, sizes[r.uid]))
    for parts in sequences.values():
        parts.sort()
        assert [p[0] for p in parts] == np.cumsum([0, *(p[1] for p in parts)])[:-1].tolist() and sum(p[1] for p in parts) <= 2048


def test_same_result_again(spark):
    items = spark.range(3000).selectExpr("id uid", "1 + pmod(id * 7919, 700) size")
    a, b = (sorted(K.pack_items(items.repartition(n), 1000, block_pieces=700).collect()) for n in (3, 7))
    assert a == b


def test_evolution_beats_its_start():
    rng = np.random.default_rng(4)
    better = 0
    for seed in range(6):
        # Bins of three that fit exactly, which longest-first does not find.
        cuts = np.sort(rng.integers(200, 800, (60, 2)), axis=1)
        sizes = np.concatenate([cuts[:, 0], cuts[:, 1] - cuts[:, 0], 1000 - cuts[:, 1]])
        sizes = sizes[sizes > 0]
        start = K.longest_first(sizes, 1000)
        best = K.evolve(sizes, [], 1000, 60, np.random.default_rng(seed), most=8)[0]
        assert (np.bincount(best.bins, sizes) == best.fill).all() and best.fill.max() <= 1000 and (best.bins >= 0).all()
        assert len(best.fill) <= len(start.fill)
        better += best.fitness(1000) > start.fitness(1000)
    assert better >= 3


def test_crossover_keeps_injected_bins_whole():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 60, 200)
    one = K.longest_first(sizes, 100)
    other = K.best_fit(sizes, rng.permutation(200), K.Packing(np.full(200, -1), np.zeros(0, np.int64)), 100)
    child = K.crossover(sizes, one, other, 100, np.random.default_rng(2))
    fullest = np.argsort(-other.fill, kind="stable")[0]
    groups = {frozenset(np.flatnonzero(child.bins == k).tolist()) for k in range(len(child.fill))}
    whole = sum(frozenset(np.flatnonzero(other.bins == k).tolist()) in groups for k in range(len(other.fill)))
    assert other.fill[fullest] == other.fill.max() and whole >= len(other.fill) // 10
    assert (np.bincount(child.bins, sizes, len(child.fill)) == child.fill).all()


def test_piece_bounds():
    assert K.piece_bounds(1, 4) == [(0, 1)] and K.piece_bounds(4, 4) == [(0, 4)]
    assert K.piece_bounds(9, 4) == [(0, 1), (1, 5), (5, 9)] and K.piece_bounds(8, 4) == [(0, 4), (4, 8)]


def test_remembered_segments_keep_their_ids(monkeypatch):
    """Two small generations: segments are dropped, come back, and always get the tokenizer's own ids."""
    monkeypatch.setattr(K, "REMEMBERED", 50)
    tokens = K.SegmentTokenizer(K.TOKENIZER)
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for k in range(30):
        texts = [" ".join(f"word{(k * 7 + i * i) % 90}é" for i in range(40)), "", f"  x{k}\n y"]
        ids, first = tokens.ids(T.texts(pa.array(texts)))
        for i, text in enumerate(texts):
            assert ids[first[i] : first[i + 1]].tolist() == plain.encode(text, add_special_tokens=False).ids
    assert len(tokens.young.numbers) < 200 and len(tokens.old.numbers) < 200


def test_a_worker_keeps_one_tokenizer_while_it_is_used(monkeypatch):
    first = K.worker_tokenizer(K.TOKENIZER)
    K._forget_idle()
    assert K.worker_tokenizer(K.TOKENIZER) is first
    monkeypatch.setattr(K, "IDLE_SECONDS", -1)
    K._forget_idle()
    assert not K._tokenizers
