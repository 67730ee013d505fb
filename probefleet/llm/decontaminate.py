"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton accepts every substring of the normalised items. Training words stream through it, tracking the length
of the longest substring that ends at each word; lengths of a window or more mark leaked words. Blocks of items have a
bounded number of words, so an automaton fits a task however many items there are; each block passes all documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from probefleet.llm import text as T
from probefleet.llm.workspace import keeping_columns

WINDOW = 10
#: Words of the items in one automaton.
BLOCK_WORDS = 200_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text: digits, letters, everything beyond ASCII.
_WORD = T.byte_class(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))


def normalised(column: pa.Array) -> tuple[T.Texts, T.Words, pa.Array]:
    """Lower-cased texts, their words, and the words as an Arrow array."""
    t = T.texts(column)
    t = T.Texts(_LOWER[t.data], t.offsets)
    w = T.words(t, _WORD)
    inside = t.data[_WORD[t.data]]
    offsets = np.concatenate([[0], np.cumsum(w.end - w.start)])
    strings = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(w), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(inside)]
    )
    return t, w, strings


class Automaton:
    """Generalised suffix automaton over word numbers; states know the windows that end in them.

    `length` is the longest substring of a state, `link` its longest suffix in another state. `windows[state]` lists the
    items for which a substring of exactly WINDOW words (or a whole shorter item) belongs to the state.
    """

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        self.window = window
        self.items_at: dict[tuple[int, int], set[str]] = {}
        for item, words in items:
            size = min(window, len(words))
            state, depth = 0, 0
            for word in words:
                state, depth = self.step(state, depth, word)
                # The whole prefix of the item matches; cut it to a window.
                if depth >= size:
                    self.items_at.setdefault((self.suffix(state, size), size), set()).add(item)

    def _clone(self, state: int, length: int) -> int:
        self.next.append(dict(self.next[state]))
        self.link.append(self.link[state])
        self.length.append(length)
        return len(self.next) - 1

    def _extend(self, last: int, word: int) -> int:
        """The state of the item's prefix after one more word."""
        known = self.next[last].get(word)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._split(last, word, known)
        state = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = state
            at = self.link[at]
        if at >= 0:
            target = self.next[at][word]
            self.link[state] = target if self.length[target] == self.length[at] + 1 else self._split(at, word, target)
        return state

    def _split(self, at: int, word: int, target: int) -> int:
        copy = self._clone(target, self.length[at] + 1)
        self.link[target] = copy
        while at >= 0 and self.next[at].get(word) == target:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def step(self, state: int, depth: int, word: int) -> tuple[int, int]:
        """State and length of the longest match that ends with the word."""
        while state and word not in self.next[state]:
            state = self.link[state]
            depth = self.length[state]
        target = self.next[state].get(word)
        return (0, 0) if target is None else (target, depth + 1)

    def suffix(self, state: int, size: int) -> int:
        """The state of the last size words of a match in state."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state


class Matcher:
    """Streams texts through the automaton of one block of items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        vocabulary: dict[bytes, int] = {}
        numbered = [(item, [vocabulary.setdefault(x, len(vocabulary)) for x in words]) for item, words in items]
        self.window = window
        self.vocabulary = pa.array(list(vocabulary), pa.large_binary())
        self.automaton = Automaton(numbered, window)
        # Whole items below the window, by length.
        self.short = sorted({len(words) for _, words in numbered if len(words) < window})
        pairs = {a << 32 | b for _, words in numbered for a, b in zip(words, words[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), np.int64)

    def _stretches(self, ids: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, int]]:
        """[from, to) of words that can hold a match: every two neighbours are neighbours in some item."""
        least = min([self.window, *self.short])
        if least == 1:
            known = ids >= 0
            edges = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]]).astype(np.int8)))
            yield from zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)
            return
        pair = ids[:-1] << 32 | ids[1:]
        at = np.minimum(np.searchsorted(self.pairs, pair), max(0, len(self.pairs) - 1))
        known = (ids[:-1] >= 0) & (ids[1:] >= 0) & (owner[:-1] == owner[1:])
        known &= self.pairs[at] == pair if len(self.pairs) else False
        edges = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]]).astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), (edges[1::2] + 1).tolist(), strict=True):
            if b - a >= least:
                yield a, b

    def matches(self, column: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
        """For each text: number of words, leaked word ranges [from, to), items with a window in it."""
        _, w, strings = normalised(column)
        ids = pc.index_in(strings, value_set=self.vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        owner = w.owner
        spans: list[list[tuple[int, int]]] = [[] for _ in range(len(column))]
        items: list[set[str]] = [set() for _ in range(len(column))]
        automaton, window = self.automaton, self.window
        for a, b in self._stretches(ids, owner):
            state, depth = 0, 0
            for at, word in enumerate(ids[a:b].tolist(), a):
                if at > a and owner[at] != owner[at - 1]:
                    state, depth = 0, 0
                state, depth = automaton.step(state, depth, word)
                if depth >= window:
                    sizes = [*self.short, window]
                else:
                    sizes = [size for size in self.short if size <= depth]
                for size in sizes:
                    found = automaton.items_at.get((automaton.suffix(state, size), size))
                    if found:
                        text = int(owner[at])
                        items[text] |= found
                        spans[text].append((at + 1 - size - int(w.first[text]), at + 1 - int(w.first[text])))
        return w.counts, spans, items


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items with words, by item_id, in blocks of about block_words words; one block at a time is on the driver.

    A null item_id has the name `null`; a null or empty text has no words and leaves no window.
    """
    block, size = [], 0
    names = F.coalesce(F.col("item_id").cast("string"), F.lit("null"))
    for row in benchmark.select(names.alias("item"), "text").orderBy("item", "text").toLocalIterator():
        _, w, strings = normalised(pa.array([row["text"]], pa.string()))
        if len(w):
            block.append((row["item"], strings.to_pylist()))
            size += len(w)
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def _merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_FOUND = "n_words long, spans array<struct<start: int, stop: int>>, items array<string>"


def find_leaks(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every row of documents with n_words, spans (leaked word ranges, merged) and items (names, sorted as strings).

    documents must have no columns of these names; `without_leaks` takes any. One block of items: a single scan without a shuffle. More blocks:
    each passes the spans found so far along with the row, so a document never leaves its partition either.
    """

    names = documents.columns

    def run(block: list[tuple[str, list[bytes]]]):
        def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, window)
            for batch in T.text_slices(batches, "text"):
                n_words, spans, items = matcher.matches(batch.column("text"))
                for i, (old_spans, old_items) in enumerate(
                    zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True)
                ):
                    if old_spans:
                        spans[i] += [(x["start"], x["stop"]) for x in old_spans]
                    items[i] |= set(old_items or ())
                found = [
                    pa.array(n_words.astype(np.int64)),
                    pa.array(
                        [[{"start": a, "stop": b} for a, b in _merged(x)] for x in spans],
                        pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])),
                    ),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in names), *found], [*names, "n_words", "spans", "items"]
                )

        return rows

    schema = StructType(documents.schema.fields + StructType.fromDDL(_FOUND).fields)
    out = documents.selectExpr(
        *(f"`{c}`" for c in documents.columns),
        "cast(null as long) n_words",
        "cast(null as array<struct<start: int, stop: int>>) spans",
        "cast(null as array<string>) items",
    )
    blocks = 0
    for block in item_blocks(benchmark, block_words):
        out, blocks = out.mapInArrow(run(block), schema), blocks + 1
    return out if blocks else out.mapInArrow(run([("", [b"\x00"])]), schema)


def decontamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of every document: n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_leaks(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["stop"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


@keeping_columns
def without_leaks(documents: DataFrame, benchmark: DataFrame, max_share: float = 0.5) -> DataFrame:
    """documents with leaked words cut out of their texts; those leaked by more than max_share go.

    The characters between cut words go with them; the rest of a text stays as it is. n_chars, where present, follows.
    """
    found = find_leaks(documents, benchmark)
    names = documents.columns

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.text_slices(batches, "text"):
            column = batch.column("text")
            t, w, _ = normalised(column)
            texts_ = column.to_pylist()
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                if spans:
                    raw, base, first = texts_[i].encode(), int(t.offsets[i]), int(w.first[i])
                    keep, at = [], 0
                    for s in spans:
                        keep.append(raw[at : int(w.start[first + s["start"]]) - base])
                        at = int(w.end[first + s["stop"] - 1]) - base
                    texts_[i] = b"".join([*keep, raw[at:]]).decode()
            columns = [pa.array(texts_, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    n_hit = F.aggregate("spans", F.lit(0), lambda total, s: total + s["stop"] - s["start"])
    out = found.where(n_hit <= max_share * F.col("n_words")).mapInArrow(rows, documents.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in documents.columns else out
