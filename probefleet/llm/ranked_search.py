"""Ranked lexical search over a length-stratified index.

A document's length enters its score only through an integer normaliser m. Documents of one m make a stratum; within it a
term's postings stand by frequency tf, and what a posting adds to a score, its impact, depends on the frequency alone, so it
is computed once for each tf. A stratum's highest frequencies bound what its documents can score: strata are visited from
the highest bound on, and those below the tenth score found so far are passed over. Large strata are cut into blocks of
bounded postings, each a row of the index.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probefleet.llm import text as T
from probefleet.llm.membership import Members, members
from probefleet.llm.workspace import NO_ID, settled

TOP = 10
#: Postings of a block of the index on average, where a stratum has that many.
BLOCK_POSTINGS = 200_000
#: Blocks that a task holds and orders by their bounds at a time.
BLOCKS_AT_ONCE = 32
#: Term entries of the queries that one search takes on; more queries are searched in several passes over the index.
BATCH_ENTRIES = 500_000
#: Fixed values of the score: m is SCALE - SLOPE + SLOPE * n * N / L, an impact UNIT * tf / (1000 * tf + 8 * m).
SCALE, SLOPE, UNIT, TF_FACTOR, M_FACTOR = 100, 75, 1_000_000_000, 1000, 8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: Terms `[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+` of lower-cased text.
_TERM = T.byte_class(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))
_U = np.uint64


def term_frequencies(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each text; and text, term hash and frequency of all pairs, by text."""
    t = T.texts(column)
    t = T.Texts(_LOWER[t.data], t.offsets)
    w = T.words(t, _TERM)
    hashes, owner = T.word_hashes(t.data, w.start, w.end), w.owner
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(order), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return w.counts, owner[first], hashes[first], np.diff(np.append(first, len(order)))


def _binary(values: list[np.ndarray]) -> pa.Array:
    return pa.array([v.tobytes() for v in values], pa.binary())


def _postings(documents: DataFrame, wanted: Broadcast[Members] | None) -> DataFrame:
    """doc_id, part (a hash that spreads equal documents too), n and the wanted terms with their frequencies of every row."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.text_slices(batches, "text"):
            n, owner, hashes, tf = term_frequencies(batch.column("text"))
            if wanted is not None:
                keep = wanted.value.has(hashes)
                owner, hashes, tf = owner[keep], hashes[keep], tf[keep]
            cuts = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            ranges = list(zip(cuts[:-1], cuts[1:], strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("part"), pa.array(n.astype(np.int64)), pa.array(np.diff(cuts)),
                    _binary([hashes[a:b] for a, b in ranges]), _binary([tf[a:b].astype(np.uint32) for a, b in ranges]),
                ],
                ["doc_id", "part", "n", "n_terms", "terms", "tf"],
            )

    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    part = F.shiftright(F.xxhash64(F.monotonically_increasing_id()), 33)
    texts = documents.select(ids.alias("doc_id"), part.alias("part"), "text")
    return texts.mapInArrow(rows, "doc_id long, part long, n long, n_terms long, terms binary, tf binary")


@dataclass
class Block:
    """A block of a stratum. Postings of term i are [at[i], at[i + 1]), by falling tf; doc numbers the block's doc_ids."""

    m: int
    most: int
    doc_ids: np.ndarray
    terms: np.ndarray
    at: np.ndarray
    tf: np.ndarray
    doc: np.ndarray

    @staticmethod
    def of(m: int, rows: pa.Table) -> Block:
        doc_ids = rows.column("doc_id").to_numpy()
        terms = np.concatenate([np.frombuffer(x, _U) for x in rows.column("terms").to_pylist()])
        tf = np.concatenate([np.frombuffer(x, np.uint32) for x in rows.column("tf").to_pylist()])
        doc = np.repeat(np.arange(len(doc_ids), dtype=np.uint32), rows.column("n_terms").to_numpy())
        order = np.lexsort((doc, -tf.astype(np.int64), terms))
        terms, first = np.unique(terms[order], return_index=True)
        return Block(m, int(np.max(rows.column("n").to_numpy())), doc_ids, terms, np.append(first, len(order)), tf[order], doc[order])

    _ARRAYS = {"doc_ids": np.int64, "terms": _U, "at": np.int64, "tf": np.uint32, "doc": np.uint32}

    def row(self) -> list[pa.Array]:
        arrays = [_binary([getattr(self, name).astype(kind)]) for name, kind in self._ARRAYS.items()]
        return [pa.array([self.m], pa.int64()), pa.array([self.most], pa.int64()), *arrays]

    @staticmethod
    def read(batch: pa.RecordBatch) -> Iterator[Block]:
        for row in range(batch.num_rows):
            arrays = {name: np.frombuffer(batch.column(name)[row].as_buffer(), kind) for name, kind in Block._ARRAYS.items()}
            yield Block(batch.column("m")[row].as_py(), batch.column("most")[row].as_py(), **arrays)

    def impacts(self) -> tuple[np.ndarray, np.ndarray]:
        """The block's frequencies and the impact of each."""
        tfs = np.unique(self.tf).astype(np.int64)
        return tfs, UNIT * tfs // (TF_FACTOR * tfs + M_FACTOR * self.m)


_BLOCK_SCHEMA = "m long, most long, doc_ids binary, terms binary, at binary, tf binary, doc binary"


@dataclass
class Index:
    """Blocks of strata, document frequencies (term, df) of the indexed terms, and N of the whole collection."""

    blocks: DataFrame
    frequencies: DataFrame
    n_documents: int


def build_index(documents: DataFrame, terms: DataFrame | None = None, block_postings: int = BLOCK_POSTINGS) -> Index:
    """The index of all rows of documents that have a term; each row counts, also with equal doc_ids. A null text has none.

    terms, a column of term hashes, keeps the postings to these (and a few more); lengths and N always are those of whole
    documents. The index is written once below the shared folder.
    """
    wanted = members(terms) if terms is not None else None
    postings = settled(_postings(documents, wanted).where(F.col("n") > 0), "search-postings")
    total = postings.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
    n_documents, n_terms = total["n"], total["l"] or 1
    # SLOPE * n * N passes 64 bits on large collections.
    share = F.call_function(
        "div", (F.lit(SLOPE).cast("decimal(3,0)") * F.col("n").cast("decimal(15,0)")) * F.lit(n_documents).cast("decimal(18,0)"),
        F.lit(n_terms).cast("decimal(38,0)"),
    )
    found = postings.where(F.col("n_terms") > 0).withColumn("m", SCALE - SLOPE + share)
    sizes = found.groupBy("m").agg(F.ceil(F.sum("n_terms") / block_postings).alias("_blocks"))
    found = found.join(sizes, "m").withColumn("block", F.pmod("part", F.col("_blocks")))

    def stratum(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        row = Block.of(key[0].as_py(), rows.sort_by([("doc_id", "ascending"), ("part", "ascending")])).row()
        return pa.Table.from_arrays(row, ["m", "most", *Block._ARRAYS])

    # Dealt by block explicitly: rows that come dealt by m alone would keep a large stratum in one task.
    dealt = found.select("m", "block", "part", "doc_id", "n", "n_terms", "terms", "tf").repartition("m", "block")
    blocks = dealt.groupBy("m", "block").applyInArrow(stratum, _BLOCK_SCHEMA)
    blocks = settled(blocks, "search-index")

    def counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in Block.read(batch):
                yield pa.RecordBatch.from_arrays([pa.array(block.terms.view(np.int64)), pa.array(np.diff(block.at))], ["term", "n"])

    frequencies = blocks.select(*_BLOCK_COLUMNS).mapInArrow(counts, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))
    return Index(blocks, frequencies, n_documents)


_BLOCK_COLUMNS = ["m", "most", *Block._ARRAYS]


def query_terms(queries: DataFrame) -> DataFrame:
    """item (a number), term (hash) and n (repeats) of all queries (item_id, text), written once; and their item_ids."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.text_slices(batches, "text"):
            _, owner, hashes, tf = term_frequencies(batch.column("text"))
            items = batch.column("item").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(items[owner]), pa.array(hashes.view(np.int64)), pa.array(tf.astype(np.int64))], ["item", "term", "n"]
            )

    return settled(queries.select("item", "text").mapInArrow(rows, "item long, term long, n long"), "search-terms")


@dataclass
class Queries:
    """Items of one batch: entries [at[i], at[i + 1]) are the terms of item i, numbers in terms, with n * w as weight."""

    items: np.ndarray
    at: np.ndarray
    terms: np.ndarray
    entry: np.ndarray
    weight: np.ndarray

    @staticmethod
    def of(rows) -> Queries:
        rows = rows.sort_values(["item", "term"])
        items, first = np.unique(rows["item"].to_numpy(np.int64), return_index=True)
        terms, entry = np.unique(rows["term"].to_numpy(np.int64).view(_U), return_inverse=True)
        return Queries(items, np.append(first, len(rows)), terms, entry, rows["weight"].to_numpy(np.int64))


class Best:
    """The best documents of one item so far: highest score first, then lowest doc_id."""

    def __init__(self, top: int, least: int):
        self.top, self.least = top, least
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= max(self.least, 1)
        if good.any():
            scores, ids = np.append(self.scores, scores[good]), np.append(self.ids, ids[good])
            order = np.lexsort((ids, -scores))[: self.top]
            self.scores, self.ids = scores[order], ids[order]
            if len(order) == self.top:
                self.least = max(self.least, int(self.scores[-1]))


class Visit:
    """All queries of a batch against one block."""

    def __init__(self, block: Block, queries: Queries):
        self.block, self.queries = block, queries
        tfs, impact = block.impacts()
        self.impact = impact[np.searchsorted(tfs, block.tf)] if len(tfs) else np.zeros(0, np.int64)
        # Where each of the queries' terms stands in the block.
        place = np.searchsorted(block.terms, queries.terms)
        there = np.minimum(place, len(block.terms) - 1)
        self.place = np.where(block.terms[there] == queries.terms, there, -1)
        # Postings stand by falling tf, so a term's first has its highest impact.
        highest = np.where(self.place >= 0, self.impact[block.at[there]], 0)
        self.gain = highest[queries.entry] * queries.weight

    def bounds(self) -> np.ndarray:
        """What no document of the block exceeds, for each item: its terms' gains, of at most as many terms as a document has."""
        q, most = self.queries, self.block.most
        sums = np.concatenate([[0], np.cumsum(self.gain)])
        out = sums[q.at[1:]] - sums[q.at[:-1]]
        for i in np.flatnonzero(np.diff(q.at) > most).tolist():
            gains = self.gain[q.at[i] : q.at[i + 1]]
            out[i] = np.partition(gains, len(gains) - most)[len(gains) - most :].sum()
        return out

    def score(self, item: int, best: Best) -> None:
        q, b = self.queries, self.block
        entries = np.arange(q.at[item], q.at[item + 1])
        place = self.place[q.entry[entries]]
        entries, place = entries[place >= 0], place[place >= 0]
        scores = np.zeros(len(b.doc_ids), np.int64)
        for entry, at in zip(entries.tolist(), place.tolist(), strict=True):
            # A document stands once among the postings of a term.
            s = slice(b.at[at], b.at[at + 1])
            scores[b.doc[s]] += self.impact[s] * q.weight[entry]
        best.add(scores, b.doc_ids)


def _searched(blocks: DataFrame, queries: Broadcast[Queries], least: Broadcast[np.ndarray] | None, top: int) -> DataFrame:
    """item, doc_id and score of the best documents among each task's blocks.

    Without least, each item visits only the best-bound block of each batch of blocks. With it, all blocks whose bound reaches
    least or the score found last.
    """

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = queries.value
        best = [Best(top, int(least.value[i]) if least is not None else 0) for i in range(len(q.items))]
        for batch in batches:
            for part in (batch.slice(at, BLOCKS_AT_ONCE) for at in range(0, batch.num_rows, BLOCKS_AT_ONCE)):
                visits = [Visit(block, q) for block in Block.read(part)]
                bounds = np.stack([v.bounds() for v in visits])
                order = np.argsort(-bounds, axis=0, kind="stable")
                for i in range(len(q.items)):
                    for at in order[:1, i].tolist() if least is None else order[:, i].tolist():
                        # Equal scores may win by their doc_id, so a bound that only reaches the score is visited too.
                        if bounds[at, i] < max(best[i].least, 1):
                            break
                        visits[at].score(i, best[i])
        items = np.repeat(q.items, [len(b.ids) for b in best])
        ids, scores = (np.concatenate([getattr(b, c) for b in best] or [[]]).astype(np.int64) for c in ("ids", "scores"))
        yield pa.RecordBatch.from_arrays([pa.array(items), pa.array(ids), pa.array(scores)], ["item", "doc_id", "score"])

    return blocks.select(*_BLOCK_COLUMNS).mapInArrow(rows, "item long, doc_id long, score long")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= top)


def search(index: Index, terms: DataFrame, top: int = TOP, batch_entries: int = BATCH_ENTRIES) -> DataFrame:
    """item, rank, doc_id and score of the top documents with a score above 0 for each item of terms (see `query_terms`).

    The first look at the index gives each item a score that its last ranked document reaches, the second finds all that reach it.
    """
    spark = index.blocks.sparkSession
    w = F.floor(1000 * F.log(F.lit(2.0 * index.n_documents + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = settled(
        terms.join(index.frequencies, "term").select("item", "term", (w * F.col("n")).alias("weight")).where("weight > 0"), "search-weights"
    )
    passes = max(1, -(-weighted.count() // batch_entries))
    out = None
    for number in range(passes):
        batch = weighted.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == number).toPandas()
        queries = spark.sparkContext.broadcast(Queries.of(batch))
        items = queries.value.items
        first = _ranked(_searched(index.blocks, queries, None, top), top).groupBy("item").agg(
            F.min("score").alias("score"), F.count(F.lit(1)).alias("n")
        )
        least = np.zeros(len(items), np.int64)
        for row in first.where(F.col("n") == top).collect():
            least[np.searchsorted(items, row["item"])] = row["score"]
        found = _ranked(_searched(index.blocks, queries, spark.sparkContext.broadcast(least), top), top)
        out = found if out is None else out.unionByName(found)
    return out.select("item", "rank", F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score")


def ranked_search(documents: DataFrame, queries: DataFrame, top: int = TOP, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """item_id, rank, doc_id and score: for each row of queries (item_id, text) the top documents with a score above 0.

    Equal scores rank by ascending doc_id, null last. Repeated rows of documents are ranked each, repeated rows of queries
    are searched each. Items without a term, or without one that tells documents apart, give no rows. Other columns are
    not read.
    """
    named = settled(queries.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "search-queries")
    terms = query_terms(named)
    index = build_index(documents, terms.select("term").distinct(), block_postings)
    return search(index, terms, top).join(named.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
