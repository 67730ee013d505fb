"""Packing of tokenised documents into sequences by a grouping genetic algorithm.

Documents become pieces of at most `capacity` tokens. Full pieces are sequences of their own. The others are dealt to
blocks of bounded size by a hash; on each block several islands evolve packings: crossover injects whole well-filled
sequences of one parent into another, drops the sequences that hold the same pieces, and places the displaced pieces by
best fit, longest first. Between epochs each island's best packing migrates to the next island. The poorly filled
sequences that remain in all blocks are pooled and packed again in fewer blocks, as long as that fills enough of them. No
block is larger than others for it.

Every random choice is seeded by block, island and epoch, so a task that runs again gives the same result.
"""

from __future__ import annotations

import itertools
import os
import time
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probefleet.llm import text as T
from probefleet.llm.workspace import settled

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k.json"
#: The id after each document.
END_ID = 0
#: Pieces of a block, islands on it, packings on an island, epochs and the crossovers of each.
BLOCK_PIECES = 4096
ISLANDS, POPULATION, EPOCHS, CROSSOVERS = 2, 4, 2, 6
#: Sequences filled less are pooled over the blocks.
WELL_FILLED = 0.99
#: Pooling ends with a level that fills the sequences of a smaller share of its items. So 2**42 items have some 90 levels.
LEAST_PROGRESS = 0.2
#: Text bytes that are tokenised together.
SLICE_BYTES = 4 << 20
#: A worker remembers the ids of two generations of segments, each of so many segments and bytes at most.
REMEMBERED, REMEMBERED_BYTES = 300_000, 12 << 20


class Generation:
    """Segments by number; the ids of number n are flat[begins[n]:begins[n + 1]]."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {}
        self.flat, self.begins, self.bytes = np.zeros(0, np.uint32), np.zeros(1, np.int64), 0

    def add(self, segments: list[bytes], ids: list[np.ndarray], sizes: np.ndarray) -> None:
        self.numbers.update(zip(segments, range(len(self.numbers), len(self.numbers) + len(segments)), strict=True))
        self.flat = np.concatenate([self.flat, *ids])
        self.begins = np.concatenate([self.begins, self.begins[-1] + np.cumsum(sizes)])
        self.bytes += sum(map(len, segments))

    def ids(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some segments one after another, and where each one's end."""
        begins, counts = self.begins[number], self.begins[number + 1] - self.begins[number]
        ends = np.concatenate([[0], np.cumsum(counts)])
        return self.flat[np.arange(ends[-1]) + np.repeat(begins - ends[:-1], counts)], ends

    def is_full(self) -> bool:
        return len(self.numbers) > REMEMBERED or self.bytes > REMEMBERED_BYTES


def _as_bytes(values: pa.LargeBinaryArray) -> list[bytes]:
    """Values without nulls, cut out of one copy of their bytes."""
    if not len(values):
        return []
    _, offsets, data = values.buffers()
    ends = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1].tolist()
    raw = data.to_pybytes() if data else b""
    return [raw[a:b] for a, b in itertools.pairwise(ends)]


class SegmentTokenizer:
    """Token ids of texts, computed once for each distinct segment.

    The tokenizer's pattern starts a new pre-token at a blank before a visible character, so texts can be cut there and
    the ids of the parts joined. Other places are never cut.
    """

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel unit
        from tokenizers import Tokenizer

        if not os.path.exists(name):
            import public_tokenizers

            name = public_tokenizers.path(name)
        self.tokenizer = Tokenizer.from_file(name)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Bytes of each token: a byte-level vocabulary writes each byte as one character.
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.bytes_of[list(vocabulary.values())] = [len(token) for token in vocabulary]
        #: First bytes of characters that are no white space under any definition: visible ASCII and U+00C0 to U+07FF.
        self.visible_bytes = frozenset([*range(0x21, 0x7F), *range(0xC3, 0xE0)])
        self.visible = T.byte_class(bytes(self.visible_bytes))
        self.young, self.old = Generation(), Generation()

    def _encode(self, parts: list[bytes]) -> tuple[list[bytes], list[np.ndarray], np.ndarray]:
        """New segments in the order of their ids, the ids one after another, in pieces, and their numbers.

        Segments that begin with a blank and a visible character are encoded together, as one text; others begin a text and
        are texts of their own. The tokens' bytes tell where each segment ends.
        """
        free: list[bytes] = []
        others: list[bytes] = []
        visible = self.visible_bytes
        for x in parts:
            (free if len(x) > 1 and x[0] == 0x20 and x[1] in visible else others).append(x)
        out, sizes = [], [np.zeros(0, np.int64)]
        for group in (free, others):
            ends = np.cumsum(np.fromiter(map(len, group), np.int64, len(group)))
            at = 0
            while at < len(group):
                # About 64 kB.
                upto = max(at + 1, int(np.searchsorted(ends, ends[at] + (1 << 16))))
                some = group[at:upto]
                texts = [b"".join(some).decode()] if group is free else [x.decode() for x in some]
                found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
                ids = np.array(list(itertools.chain.from_iterable(x.ids for x in found)), np.uint32)
                token_ends, wanted = np.cumsum(self.bytes_of[ids]), ends[at:upto] - (ends[at - 1] if at else 0)
                last = np.searchsorted(token_ends, wanted, "right")
                if last[0] == 0 or (token_ends[last - 1] != wanted).any():
                    raise ValueError("the tokenizer's tokens do not follow the bytes of the text")
                sizes.append(np.diff(last, prepend=0))
                out.append(ids)
                at = upto
        return free + others, out, np.concatenate(sizes)

    def ids(self, t: T.Texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's begin."""
        data = t.data
        cut = np.zeros(len(data) + 1, bool)
        if len(data):
            cut[: len(data) - 1] = (data[:-1] == 0x20) & self.visible[data[1:]]
        cut[t.offsets] = True
        bounds = np.flatnonzero(cut)
        parts = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
        ).dictionary_encode()
        distinct = _as_bytes(parts.dictionary)
        if self.young.is_full():
            self.young, self.old = Generation(), self.young
        young, old = self.young, self.old
        number = list(map(young.numbers.get, distinct))
        missing = [k for k, n in enumerate(number) if n is None]
        before = [old.numbers.get(distinct[k]) for k in missing]
        again = [n for n in before if n is not None]
        if again:
            ids, ends = old.ids(np.array(again, np.int64))
            young.add([distinct[k] for k, n in zip(missing, before, strict=True) if n is not None], [ids], np.diff(ends))
        young.add(*self._encode([distinct[k] for k, n in zip(missing, before, strict=True) if n is None]))
        for k in missing:
            number[k] = young.numbers[distinct[k]]
        indices = parts.indices.to_numpy(zero_copy_only=False)
        ids, ends = young.ids(np.array(number, np.int64)[indices] if distinct else np.zeros(0, np.int64))
        return ids, ends[np.searchsorted(bounds, t.offsets)]


#: The tokenizers of this worker process and when a task last took each: it finds what tasks before it have parsed and remembered.
_tokenizers: dict[str, tuple[SegmentTokenizer, float]] = {}
#: A worker that has gone on to other work for so long forgets them.
IDLE_SECONDS = 20


def worker_tokenizer(name: str) -> SegmentTokenizer:
    tokenizer = _tokenizers[name][0] if name in _tokenizers else SegmentTokenizer(name)
    _tokenizers[name] = tokenizer, time.monotonic()
    return tokenizer


def _forget_idle() -> None:
    for name, (_, used) in list(_tokenizers.items()):
        if time.monotonic() - used > IDLE_SECONDS:
            del _tokenizers[name]


T.releases.append(_forget_idle)


def piece_bounds(length: int, capacity: int) -> list[tuple[int, int]]:
    """[from, to) of a document's pieces; only a longer document is cut, its first piece may be shorter than others."""
    first = length % capacity or min(length, capacity)
    cuts = [0, *range(first, length + 1, capacity)]
    return list(zip(cuts, cuts[1:], strict=False))


_PIECE = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def token_pieces(documents: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """The pieces of all documents under a uid each; ids are little-endian unsigned 32-bit numbers, null if not asked for."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for batch in T.text_slices(batches, "text", SLICE_BYTES):
            tokens = worker_tokenizer(tokenizer)
            docs = batch.column("doc_id").to_pylist()
            ids, first = tokens.ids(T.texts(batch.column("text")))
            out: list[list] = [[] for _ in range(6)]
            kept: list[bytes | None] = []
            for doc, a, b in zip(docs, first[:-1].tolist(), first[1:].tolist(), strict=True):
                own = np.append(ids[a:b], np.uint32(END_ID)).astype("<u4")
                for k, (lo, hi) in enumerate(piece_bounds(len(own), capacity)):
                    raw = own[lo:hi].tobytes()
                    row = (uid, doc, k, lo, hi - lo, zlib.crc32(raw))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    kept.append(raw if with_ids else None)
                    uid += 1
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            lists = pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, t) for c, t in zip(out, types, strict=True)), lists], [x.split()[0] for x in _PIECE.split(", ")]
            )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, _PIECE)


@dataclass
class Packing:
    """The bin of each piece, and each bin's fill."""

    bins: np.ndarray
    fill: np.ndarray

    def fitness(self, capacity: int) -> tuple[int, float]:
        """Fewer bins are better, then fuller ones: the mean square of the fills."""
        return -len(self.fill), float(np.mean((self.fill / capacity) ** 2)) if len(self.fill) else 1.0


def best_fit(sizes: np.ndarray, pieces: np.ndarray, base: Packing, capacity: int) -> Packing:
    """base with some pieces placed in order, each in the fullest bin that has room, else in a new one."""
    bins, fill = base.bins.copy(), base.fill.tolist()
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # a bit for each amount of room that some bin has
    for k, f in enumerate(fill):
        by_room[capacity - f].append(k)
        rooms |= 1 << (capacity - f)
    for piece, size in zip(pieces.tolist(), sizes[pieces].tolist(), strict=True):
        enough = rooms >> size
        if enough:
            room = size + (enough & -enough).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            fill[k] += size
            left = room - size
        else:
            k, left = len(fill), capacity - size
            fill.append(size)
        if not by_room[left]:
            rooms |= 1 << left
        by_room[left].append(k)
        bins[piece] = k
    return Packing(bins, np.array(fill, np.int64))


def longest_first(sizes: np.ndarray, capacity: int) -> Packing:
    empty = Packing(np.full(len(sizes), -1), np.zeros(0, np.int64))
    return best_fit(sizes, np.argsort(-sizes, kind="stable"), empty, capacity)


def _without(packing: Packing, gone: np.ndarray, keep_free: np.ndarray) -> Packing:
    """Without some bins (flags); their pieces and those of keep_free (flags) are unplaced. Bins are numbered anew."""
    number = np.cumsum(~gone) - 1
    bins = np.where(keep_free | gone[packing.bins], -1, number[packing.bins])
    return Packing(bins, packing.fill[~gone])


def crossover(sizes: np.ndarray, one: Packing, other: Packing, capacity: int, rng: np.random.Generator) -> Packing:
    """one, with some of the best-filled bins of other injected whole."""
    n = len(other.fill)
    # Fuller bins first, equal ones by chance; up to half of them go over.
    ranked = np.lexsort((rng.random(n), -other.fill))
    chosen = np.zeros(n, bool)
    chosen[ranked[: max(1, int(n * rng.uniform(0.1, 0.5)))]] = True
    injected = chosen[other.bins]
    # Bins that hold an injected piece go, and a few of the emptiest ones to shake the rest.
    gone = np.zeros(len(one.fill), bool)
    gone[one.bins[injected]] = True
    gone[np.argsort(one.fill, kind="stable")[: max(1, len(one.fill) // 50)]] = True
    base = _without(one, gone, np.zeros(len(sizes), bool))
    number = np.cumsum(chosen) - 1 + len(base.fill)
    base.bins[injected] = number[other.bins[injected]]
    base = Packing(base.bins, np.concatenate([base.fill, other.fill[chosen]]))
    displaced = np.flatnonzero(base.bins < 0)
    return best_fit(sizes, displaced[np.argsort(-sizes[displaced], kind="stable")], base, capacity)


def evolve(
    sizes: np.ndarray, population: list[Packing], capacity: int, crossovers: int, rng: np.random.Generator, most: int = POPULATION
) -> list[Packing]:
    """The population, best first, after some crossovers; it stops once no packing can have fewer bins."""
    least = -(-int(sizes.sum()) // capacity)
    key = lambda p: p.fitness(capacity)
    if not population:
        population = [longest_first(sizes, capacity)]
    while len(population) < most and len(max(population, key=key).fill) > least:
        # Large pieces first but in a loose order, for different starts.
        loose = np.argsort(-sizes * rng.uniform(0.8, 1.0, len(sizes)), kind="stable")
        population.append(best_fit(sizes, loose, Packing(np.full(len(sizes), -1), np.zeros(0, np.int64)), capacity))
    population = sorted(population, key=key, reverse=True)[:most]
    for _ in range(crossovers):
        if len(population) < 2 or len(population[0].fill) <= least:
            break
        a, b = rng.choice(len(population), 2, replace=False)
        child = crossover(sizes, population[min(a, b)], population[max(a, b)], capacity, rng)
        if key(child) > key(population[-1]):
            population = sorted([*population[:-1], child], key=key, reverse=True)
    return population


def _restored(bins: np.ndarray, sizes: np.ndarray) -> Packing:
    return Packing(bins, np.bincount(bins, sizes, minlength=int(bins.max(initial=-1)) + 1).astype(np.int64))


_STATE = "block long, island int, uids array<long>, sizes array<int>, packings array<array<int>>"


def _blocks(items: DataFrame, blocks: int, level: int) -> DataFrame:
    """A row for each block: its pieces, in the order of uid."""
    block = F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(blocks)).alias("block")
    pair = F.struct(F.col("uid"), F.col("size").cast("int").alias("size"))
    packed = items.select(block, pair.alias("p")).groupBy("block").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return packed.select("block", F.col("p.uid").alias("uids"), F.col("p.size").alias("sizes"))


def _epoch(state: DataFrame, epoch: int, capacity: int, crossovers: int) -> DataFrame:
    """Each island's population after an epoch, best first."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                block, island = row.column("block")[0].as_py(), row.column("island")[0].as_py()
                sizes = row.column("sizes")[0].values.to_numpy().astype(np.int64)
                population = [_restored(np.array(p), sizes) for p in row.column("packings")[0].as_py() or ()]
                rng = np.random.default_rng([epoch, island, block])
                best = evolve(sizes, population, capacity, crossovers, rng)
                packings = pa.array([[p.bins.astype(np.int32) for p in best]], pa.list_(pa.list_(pa.int32())))
                yield row.set_column(batch.schema.get_field_index("packings"), "packings", packings)

    return state.mapInArrow(rows, _STATE)


def _migrated(state: DataFrame, islands: int) -> DataFrame:
    """Each island's population with the best packing of the island before it in place of its worst."""
    guests = state.select("block", ((F.col("island") + 1) % islands).alias("island"), F.col("packings")[0].alias("guest"))
    own = F.slice("packings", 1, F.greatest(F.size("packings") - 1, F.lit(1)))
    return state.join(guests, ["block", "island"]).select(
        "block", "island", "uids", "sizes", F.concat(own, F.array("guest")).alias("packings")
    )


def pack_items(
    items: DataFrame,
    capacity: int = CAPACITY,
    block_pieces: int = BLOCK_PIECES,
    islands: int = ISLANDS,
    epochs: int = EPOCHS,
    crossovers: int = CROSSOVERS,
    well_filled: float = WELL_FILLED,
) -> DataFrame:
    """uid, sequence_id, offset for items (uid, size; 0 < size <= capacity): sequences of at most capacity, gapless.

    The number of blocks follows the number of items. Items that leave no room for the smallest one are sequences of their
    own, with a sequence_id of -1 - uid. Levels of pooling end with a single block, or with blocks of which less than
    LEAST_PROGRESS was filled well: then these blocks' sequences stay as they are.
    """
    left = settled(items, "items")
    done: list[DataFrame] = []
    level = 0
    while True:
        count, smallest = left.agg(F.count(F.lit(1)), F.min("size")).first()
        if not count:
            break
        alone = F.col("size") > capacity - smallest
        done.append(left.where(alone).selectExpr("uid", "-1 - uid sequence_id", "0L offset"))
        left = left.where(~alone)
        count = left.count()
        if not count:
            break
        blocks = -(-count // block_pieces)
        start = _blocks(left, blocks, level).withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
        # An island is a unit of work: spread them over the tasks.
        state = start.withColumn("packings", F.array().cast("array<array<int>>")).select(*(x.split()[0] for x in _STATE.split(", ")))
        state = state.repartition(F.col("block"), F.col("island"))
        for epoch in range(epochs):
            if epoch:
                state = _migrated(state, islands)
            state = settled(_epoch(state, epoch, capacity, crossovers), "islands")
        found = settled(_best_of_islands(state, level, capacity, well_filled if blocks > 1 else 0.0), "packed")
        pooled = found.where("not final").select("uid", "size")
        last = blocks == 1 or pooled.count() > (1 - LEAST_PROGRESS) * count
        done.append((found if last else found.where("final")).drop("final", "size"))
        if last:
            break
        left, level = pooled, level + 1
    out = done[0] if done else left.selectExpr("uid", "uid sequence_id", "uid offset")
    for more in done[1:]:
        out = out.unionAll(more)
    return out


def _best_of_islands(state: DataFrame, level: int, capacity: int, well_filled: float) -> DataFrame:
    """uid, size, sequence_id, offset, final: the best packing of each block; final is false in poorly filled bins."""

    def rows(table: pa.Table) -> pa.Table:
        packings = []
        for i in range(table.num_rows):
            sizes = table.column("sizes")[i].values.to_numpy().astype(np.int64)
            best = _restored(table.column("packings")[i].values[0].values.to_numpy().astype(np.int64), sizes)
            packings.append((best.fitness(capacity), -table.column("island")[i].as_py(), i, best, sizes))
        _, _, i, best, sizes = max(packings, key=lambda x: x[:2])
        order = np.argsort(best.bins, kind="stable")
        ends = np.cumsum(sizes[order])
        begin = np.concatenate([[0], ends[:-1]])
        offset = np.empty(len(sizes), np.int64)
        offset[order] = begin - np.repeat(begin[np.searchsorted(best.bins[order], np.arange(len(best.fill)))], np.bincount(best.bins))
        block = table.column("block")[i].as_py()
        return pa.table(
            {
                "uid": table.column("uids")[i].values,
                "size": sizes,
                "sequence_id": (level << 56 | block << 24) + best.bins.astype(np.int64),
                "offset": offset,
                "final": best.fill[best.bins] >= well_filled * capacity,
            }
        )

    return state.groupBy("block").applyInArrow(rows, "uid long, size long, sequence_id long, offset long, final boolean")


def pack_documents(
    documents: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, with_ids: bool = True, **options: float
) -> DataFrame:
    """A row for each piece of every row of documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and
    ids (its tokens, little-endian unsigned 32-bit numbers) if asked for.

    A null or empty text is a piece of one token, the end of a document; rows with the same doc_id are packed each by
    itself, and a null doc_id stays null. Columns other than doc_id and text are not read. sequence_id is negative for
    sequences of one full piece, or of one that leaves no room for any other.
    """
    pieces = settled(token_pieces(documents, tokenizer, capacity, with_ids), "pieces")
    rest = pieces.where(F.col("length") < capacity)
    placed = pack_items(rest.select("uid", F.col("length").alias("size")), capacity, **options)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    full = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.col("uid"), "offset": F.lit(0).cast("long")})
    out = [*columns[:5], "sequence_id", "offset", *columns[5:]]
    return rest.join(placed, "uid").select(*out).unionAll(full.select(*out))
