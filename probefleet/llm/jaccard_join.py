"""Similarity join of documents on the Jaccard similarity of their word shingles, with R-trees over count vectors.

A document's shingles are hashed into groups; the counts of the groups are a point. Two sets share at most the sum of
the smaller coordinates of their points, and a box of points at most the sum of the smaller upper corners, so an R-tree
leaves few pairs to verify exactly.

The join runs in steps:

1. Documents with equal sets are one node.
2. A node's *prefix* is its first n - ceil(0.75 n) + slack(n) shingles in a common order. Prefixes of similar sets share
   at least the slack of the smaller set, so nodes with fewer shared shingles have no partner and end here. Of the
   others, two of similar sizes that share as many prefix shingles with each other are a candidate pair; *clusters* are
   the components of the candidate pairs. A shingle of very many nodes makes no pairs: among the nodes that can be
   linked by such shingles alone, it adds a star.
3. Clusters are dealt to jobs of bounded size: small ones together, large ones as pairs of tiles of similar set sizes.
   A job holds an R-tree over its points and verifies the surviving pairs.
4. Components of the verified links.

One shingle in common says little: in a large corpus nearly all documents are connected by chance through some. So
clusters grow with the groups of similar documents and not with the corpus.

The common order puts frequent shingles last. Any order gives the same result; this one keeps passages that many
documents share from joining their clusters.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probefleet.llm import text as T
from probefleet.llm.components import components
from probefleet.llm.workspace import NO_ID, keeping_columns, keyed, packed_texts, settled, unpacked_texts

SHINGLE = 5
#: Linked: SCALE * |intersection| >= PERCENT * |union|.
PERCENT, SCALE = 75, 100

#: Coordinates of a point.
GROUPS = 256
#: Points of a leaf of the R-tree, and leaves of a node above.
FANOUT = 64
#: A job of small clusters, and a tile of a large one, have about this many shingles.
JOB_SHINGLES = 2_000_000
#: And at most about this many sets: boxes of small sets tell little apart.
JOB_SETS = 10_000
#: A shingle of more nodes than this makes no pairs; so many times is it looked at what is left without the others.
PAIRED_NODES, PAIRED_LEVELS = 128, 2
#: A prefix has one more shingle, and similar sets share one more in it, for each so many shingles of a set.
SLACK_EVERY = 8
#: Prefix entries that a task gathers before it sends them, and entries for each bucket.
GATHERED, BUCKET_ENTRIES = 1 << 20, 1 << 18
#: A shingle is frequent if it is in this share of a slice of texts, and in one FREQUENT_KEPT-th of all set members.
FREQUENT_SHARE, FREQUENT_KEPT = 0.005, 1 << 17

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def shingle_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles (repeats included) of each text, and where each text's begin; A-Z are lower-cased.

    A text of fewer words than a shingle has its whole sequence as its only one, without words none.
    """
    t = T.texts(column)
    t = T.Texts(_LOWER[t.data], t.offsets)
    w = T.words(t)
    ids = T.word_hashes(t.data, w.start, w.end)
    counts = w.counts
    sizes = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(first[-1], np.uint64)
    grams = T.gram_hashes(ids, SHINGLE)
    full = np.repeat(counts >= SHINGLE, sizes)
    owner = np.repeat(np.arange(len(counts)), sizes)
    at = w.first[owner] + np.arange(len(out)) - first[owner]
    out[full] = grams[at[full]]
    for i in np.flatnonzero((counts > 0) & (counts < SHINGLE)):
        out[first[i]] = T.gram_hashes(ids[w.first[i] : w.first[i + 1]], int(counts[i]))[0]
    return out, first


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, first = shingle_hashes(column)
    return [np.unique(hashes[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


def set_node(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a shingle set: equal for equal sets."""
    with np.errstate(over="ignore"):
        total = T.mix64(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(T.mix64(np.array([total]))[0].astype(np.int64))


def profiles(documents: DataFrame) -> DataFrame:
    """doc_id, id, key, n_shingles and node (null without shingles) of every row."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.text_slices(batches, "text"):
            sets = shingle_sets(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", "id", "key")),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_node(s) if len(s) else None for s in sets], pa.int64()),
                ],
                ["doc_id", "id", "key", "n_shingles", "node"],
            )

    own = keyed(documents).withColumn("doc_id", F.when(F.col("id") != NO_ID, F.col("id")))
    return own.select("doc_id", "id", "key", "text").mapInArrow(
        rows, "doc_id long, id long, key long, n_shingles long, node long"
    )


def frequent_shingles(documents: DataFrame, total: int) -> np.ndarray:
    """Sorted hashes of shingles that are in many texts. They change the order, never the result.

    total is the sum of the sizes of all sets, so at most FREQUENT_KEPT shingles are in total / FREQUENT_KEPT texts or more.
    """

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, int] = {}
        for batch in T.text_slices(batches, "text"):
            sets = shingle_sets(batch.column("text"))
            found, counts = np.unique(np.concatenate(sets), return_counts=True)
            often = counts >= max(4, FREQUENT_SHARE * batch.num_rows)
            for h, n in zip(found[often].view(np.int64).tolist(), counts[often].tolist(), strict=True):
                sums[h] = sums.get(h, 0) + n
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.int64())], ["h", "n"]
        )

    counted = documents.select("text").mapInArrow(rows, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    often = counted.where(F.col("n") >= max(4, total / FREQUENT_KEPT)).select("h").toPandas()["h"]
    return np.sort(often.to_numpy(np.int64).view(np.uint64))


def slack(n: int) -> int:
    return max(1, n // SLACK_EVERY)


def prefix(shingles: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of a set's prefix: first the others by hash, then the frequent ones; and flags of the latter."""
    n = len(shingles)
    size = min(n, n - -(-PERCENT * n // SCALE) + slack(n))
    is_frequent = np.zeros(n, bool)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        is_frequent = frequent[at] == shingles
        order = np.argsort(is_frequent, kind="stable")
        shingles, is_frequent = shingles[order], is_frequent[order]
    return shingles[:size], is_frequent[:size]


def shared_entries(documents: DataFrame, frequent: np.ndarray, buckets: int) -> DataFrame:
    """h, node: the prefix shingles that different nodes share, with their nodes.

    Entries travel packed, by the bucket of their shingle, to meet others. Entries of frequent shingles need no meeting
    to be known as shared: they go along anywhere, so that no shingle gathers more than the others in one task.
    """

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        gathered = 0

        def send() -> Iterator[pa.RecordBatch]:
            if not parts:
                return
            h, often, node = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            bucket = (h % np.uint64(buckets)).astype(np.int64)
            place = np.where(often, -1 - node % buckets, bucket)
            # Within a bucket the upper half of a hash tells shingles apart.
            name = (h >> np.uint64(32)).astype(np.uint32)
            order = np.lexsort((node, name, place))
            place, bucket, name, node = place[order], bucket[order], name[order], node[order]
            new = np.concatenate([[True], (place[1:] != place[:-1]) | (name[1:] != name[:-1]) | (node[1:] != node[:-1])])
            place, bucket, name, node = place[new], bucket[new], name[new], node[new]
            cuts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])).tolist()
            out = [
                (place[a], (name[a:b] if place[a] >= 0 else bucket[a:b] << 32 | name[a:b]).tobytes(), node[a:b].tobytes())
                for a, b in zip(cuts, [*cuts[1:], len(node)], strict=True)
            ]
            columns = zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ["place", "names", "nodes"])

        for batch in T.text_slices(batches, "text"):
            for s in shingle_sets(batch.column("text")):
                if len(s):
                    h, often = prefix(s, frequent)
                    parts.append((h, often, np.full(len(h), set_node(s), np.int64)))
                    gathered += len(h)
            if gathered >= GATHERED:
                yield from send()
                gathered = 0
        yield from send()

    def meet(table: pa.Table) -> pa.Table:
        place = table.column("place")[0].as_py()
        kind = np.uint32 if place >= 0 else np.int64
        name = np.concatenate([np.frombuffer(x, kind) for x in table.column("names").to_pylist()]).astype(np.int64)
        node = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("nodes").to_pylist()])
        if place >= 0:
            order = np.lexsort((node, name))
            name, node = name[order], node[order]
            same_name = name[1:] == name[:-1]
            new = np.concatenate([[True], ~same_name | (node[1:] != node[:-1])])
            name, node = name[new], node[new]
            same_name = name[1:] == name[:-1]
            shared = np.concatenate([same_name, [False]]) | np.concatenate([[False], same_name])
            name, node = place << 32 | name[shared], node[shared]
        return pa.table({"h": name, "node": node})

    packed = documents.select("text").mapInArrow(gather, "place long, names binary, nodes binary")
    return packed.groupBy("place").applyInArrow(meet, "h long, node long")


def _smallest_partner(n: Column) -> Column:
    return F.floor((n * PERCENT + SCALE - 1) / SCALE)


def _least_shared(n: Column) -> Column:
    """Prefix shingles that similar sets share at least if the smaller one has n shingles."""
    return F.greatest(F.lit(1), F.floor(n / SLACK_EVERY))


def _similar_sizes(n: Column, m: Column) -> Column:
    return SCALE * F.least(n, m) >= PERCENT * F.greatest(n, m)


def _paired(entries: DataFrame, level: int, most: int) -> tuple[DataFrame, DataFrame]:
    """a, b: pairs of nodes that share enough prefix shingles, one of them in at most `most` nodes; and the entries of the
    other shingles at nodes that have enough of these to be linked by them alone.

    Each pair counts the shingles of few nodes that it shares, and as many others as it can share.
    """
    many = settled(entries.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("h"), f"many-{level}")
    others = entries.join(many, "h", "left_semi")
    held = settled(others.groupBy("node").agg(F.count(F.lit(1)).alias("held")), f"held-{level}")
    # Similar sets share many shingles, mostly with the same third ones: equal lists of nodes make their pairs once.
    lists = (
        entries.join(many, "h", "left_anti")
        .groupBy("h")
        .agg(F.sort_array(F.collect_list(F.struct("node", "n_shingles"))).alias("list"))
        .where(F.size("list") > 1)
        .groupBy("list")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    first = lists.select("list", "times", F.posexplode("list").alias("at", "x"))
    later = F.slice("list", F.col("at") + 2, F.size("list"))
    pairs = first.select("times", "x", F.explode(F.filter(later, lambda y: _similar_sizes(F.col("x.n_shingles"), y["n_shingles"]))).alias("y"))
    smaller = F.least(F.col("x.n_shingles"), F.col("y.n_shingles"))
    pairs = pairs.groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(
        F.sum("times").alias("shared"), F.min(_least_shared(smaller)).alias("enough")
    )
    for name in ("a", "b"):
        pairs = pairs.join(held.select(F.col("node").alias(name), F.col("held").alias(f"held_{name}")), name, "left")
    possible = F.col("shared") + F.least(F.coalesce("held_a", F.lit(0)), F.coalesce("held_b", F.lit(0)))
    pairs = settled(pairs.where(possible >= F.col("enough")).select("a", "b"), f"pairs-{level}")
    rest = others.join(held, "node").where(F.col("held") >= _least_shared(_smallest_partner(F.col("n_shingles"))))
    return pairs, settled(rest.select("h", "node", "n_shingles"), f"rest-{level}")


def candidate_edges(entries: DataFrame, nodes: DataFrame, most: int = PAIRED_NODES) -> DataFrame:
    """a, b: the pairs of nodes that share enough prefix shingles to be linked; and a star for each shingle of more than
    `most` nodes, over those that can be linked by such shingles alone.

    Nodes that go take shared shingles with them, so the test is made again on what is left.
    """
    sizes = nodes.select("node", "n_shingles", _least_shared(_smallest_partner(F.col("n_shingles"))).alias("enough"))
    left = entries
    for k in range(2):
        if k:
            shared = left.groupBy("h").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
            left = left.join(shared, "h").select("h", "node")
        # A node has at most its prefix here; a frequent shingle's rows never gather in one task.
        counted = left.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("node")))
        left = counted.join(sizes, "node").where("n >= enough").select("h", "node", "n_shingles").distinct()
        left = settled(left, f"entries-{k}")
    edges = []
    for level in range(PAIRED_LEVELS):
        pairs, left = _paired(left, level, most)
        edges.append(pairs)
        if left.isEmpty():
            break
    stars = left.groupBy("h").agg(F.min("node").alias("low"))
    edges.append(left.join(stars, "h").select(F.col("node").alias("a"), F.col("low").alias("b")))
    return reduce(DataFrame.unionAll, edges).distinct()


class CountTree:
    """An R-tree over the count vectors of sets: leaves of FANOUT points in the order of their sizes and largest
    coordinates, and nodes of FANOUT leaves. A box keeps its upper corner and its smallest set."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((vectors.argmax(axis=1), sizes))
        self.vectors, self.sizes = vectors[self.order], sizes[self.order]
        self.leaves = self._boxes(self.vectors, self.sizes)
        self.nodes = self._boxes(*self.leaves)

    @staticmethod
    def _boxes(vectors: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.arange(0, len(sizes), FANOUT)
        return np.maximum.reduceat(vectors, starts, axis=0), np.minimum.reduceat(sizes, starts)

    def _possible(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Pairs of boxes or points (rows of a, rows of b) that can hold linked sets.

        Linked sets share at least PERCENT / (PERCENT + SCALE) of the sum of their sizes.
        """
        shared = np.minimum(a[0][:, None, :], b[0][None, :, :]).sum(axis=2, dtype=np.int64)
        return (PERCENT + SCALE) * shared >= PERCENT * (a[1][:, None] + b[1][None, :])

    def pairs(self, label: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(point, later points that can be linked with it), by positions in the given vectors.

        label names the component of each point, and may change between two results: leaves that are of one component
        together are not looked into.
        """
        starts = np.arange(0, len(self.order), FANOUT)
        for leaf in range(len(self.leaves[1])):
            box = tuple(x[leaf : leaf + 1] for x in self.leaves)
            found = []
            for node in np.flatnonzero(self._possible(box, self.nodes)[0]):
                lo = node * FANOUT
                below = tuple(x[lo : lo + FANOUT] for x in self.leaves)
                found += [lo + k for k in np.flatnonzero(self._possible(box, below)[0]) if lo + k >= leaf]
            a = leaf * FANOUT
            labels = label[self.order]
            lows, highs = np.minimum.reduceat(labels, starts), np.maximum.reduceat(labels, starts)
            found = [x for x in found if min(lows[x], lows[leaf]) < max(highs[x], highs[leaf])]
            points = (self.vectors[a : a + FANOUT], self.sizes[a : a + FANOUT])
            partners: list[list[np.ndarray]] = [[] for _ in range(len(points[1]))]
            for other in found:
                b = other * FANOUT
                ok = self._possible(points, (self.vectors[b : b + FANOUT], self.sizes[b : b + FANOUT]))
                if other == leaf:
                    ok = np.triu(ok, 1)
                for i in np.flatnonzero(ok.any(axis=1)):
                    partners[i].append(b + np.flatnonzero(ok[i]))
            for i, others in enumerate(partners):
                if others:
                    yield int(self.order[a + i]), self.order[np.concatenate(others)]


def count_vectors(sets: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """For each set how many of its members are in each of GROUPS groups. Some sets at a time: a job holds millions of members."""
    vectors = np.empty((len(sets), GROUPS), np.uint16 if sizes.max() < 1 << 16 else np.int64)
    for at in range(0, len(sets), GROUPS):
        some = sets[at : at + GROUPS]
        owner = np.repeat(np.arange(len(some)), sizes[at : at + GROUPS])
        groups = (np.concatenate(some) >> np.uint64(64 - GROUPS.bit_length() + 1)).astype(np.int64)
        vectors[at : at + GROUPS] = np.bincount(owner * GROUPS + groups, minlength=len(some) * GROUPS).reshape(-1, GROUPS)
    return vectors


def linked_sets(sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Links (positions) that connect all similar sets; pairs that earlier links connect already are not verified."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if len(sets) < 2:
        return
    label = np.arange(len(sets))
    for i, others in CountTree(count_vectors(sets, sizes), sizes).pairs(label):
        others = others[label[others] != label[i]]
        if not len(others):
            continue
        parts = [sets[j] for j in others]
        flat = np.concatenate(parts)
        at = np.minimum(np.searchsorted(sets[i], flat), sizes[i] - 1)
        starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]])
        shared = np.add.reduceat((sets[i][at] == flat).astype(np.int64), starts)
        union = sizes[i] + sizes[others] - shared
        for j in others[SCALE * shared >= PERCENT * union]:
            if label[j] != label[i]:
                yield i, int(j)
                label[label == label[j]] = label[i]


def _jobs(clusters: DataFrame, job_shingles: int) -> DataFrame:
    """node and its jobs (an array of names): one for a small cluster; for a large one all pairs of tiles, of its size
    class and the classes next to it, that hold the node."""
    n = F.col("n_shingles")
    weight = F.greatest(n, F.lit(job_shingles // JOB_SETS))
    sizes = clusters.groupBy("root").agg(F.sum(weight).alias("total"))
    whole = sizes.agg(F.sum(F.when(F.col("total") <= job_shingles, F.col("total")))).first()[0] or 0
    bundles = max(1, -(-whole // job_shingles))
    bundle = F.concat(F.lit("s"), F.pmod(F.xxhash64("root"), F.lit(bundles)).cast("string"))
    rows = clusters.join(sizes, "root")
    small = rows.where(F.col("total") <= job_shingles).select("node", F.array(bundle).alias("jobs"))
    # Linked sets differ by a factor of 3/4 at most, so their classes are equal or neighbours.
    size_class = F.floor(F.log(n.cast("double")) / float(np.log(SCALE / PERCENT)) + 1e-9).cast("long")
    large = rows.where(F.col("total") > job_shingles).select("root", "node", "n_shingles", size_class.alias("c"))
    tiles = large.groupBy("root", "c").agg(F.ceil(F.sum(weight) / job_shingles).cast("long").alias("k"))
    up, down = (
        tiles.select("root", (F.col("c") + step).alias("c"), F.col("k").alias(name)) for step, name in ((-1, "k_up"), (1, "k_down"))
    )
    tiled = (
        large.join(tiles, ["root", "c"])
        .join(up, ["root", "c"], "left")
        .join(down, ["root", "c"], "left")
        .withColumn("t", F.pmod(F.xxhash64("node"), F.col("k")))
    )

    def name(c1, t1, c2, t2):
        return F.concat_ws("/", F.lit("l"), *(x.cast("string") for x in (F.col("root"), c1, t1, c2, t2)))

    def others(k):
        return F.when(F.coalesce(k, F.lit(0)) > 0, F.sequence(F.lit(0).cast("long"), k - 1)).otherwise(F.array().cast("array<long>"))

    c, t = F.col("c"), F.col("t")
    same = F.transform(others(F.col("k")), lambda x: name(c, F.least(t, x), c, F.greatest(t, x)))
    above = F.transform(others(F.col("k_up")), lambda x: name(c, t, c + 1, x))
    below = F.transform(others(F.col("k_down")), lambda x: name(c - 1, x, c, t))
    return small.unionAll(tiled.select("node", F.concat(same, above, below).alias("jobs")))


def _components_of(documents: DataFrame, job_shingles: int, bucket_entries: int, paired_nodes: int) -> tuple[DataFrame, DataFrame]:
    """The profiles of all rows, and node, root, component (its smallest id) of all nodes."""
    rows = settled(profiles(documents), "profiles")
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(1, total * 3 // 8 // bucket_entries)
    nodes = settled(
        rows.where("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.min("key").alias("key"), F.max("n_shingles").alias("n_shingles")),
        "nodes",
    )
    entries = settled(shared_entries(documents, frequent_shingles(documents, total), buckets), "entries")
    edges = candidate_edges(entries, nodes, paired_nodes)
    clusters = settled(components(edges).join(nodes.select("node", "key", "n_shingles"), "node"), "clusters")
    jobs = _jobs(clusters, job_shingles).join(clusters.select("node", "key"), "node")
    # Equal rows of documents have equal keys; one of them is enough.
    texts = packed_texts(keyed(documents).select("key", "text")).join(jobs, "key").dropDuplicates(["key"])
    texts = texts.select("node", "packed", F.explode("jobs").alias("job"))

    def verify(table: pa.Table) -> pa.Table:
        names = table.column("node").to_numpy()
        _, firsts = np.unique(names, return_index=True)
        names = names[firsts]
        sets: list[np.ndarray] = []
        for batch in T.text_slices(unpacked_texts(table.take(firsts).to_batches()), "text"):
            sets += shingle_sets(batch.column("text"))
        links = [(int(names[i]), int(names[j])) for i, j in linked_sets(sets)]
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    links = texts.groupBy("job").applyInArrow(verify, "a long, b long")
    roots = components(links)
    own = nodes.select("node", "id").join(roots, "node", "left")
    own = own.select("node", "id", F.coalesce("root", "node").alias("root"))
    lowest = own.groupBy("root").agg(F.min("id").alias("component"))
    return rows, settled(own.join(lowest, "root").select("node", "root", "component"), "components")


def similarity_components(
    documents: DataFrame, job_shingles: int = JOB_SHINGLES, bucket_entries: int = BUCKET_ENTRIES, paired_nodes: int = PAIRED_NODES
) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of documents.

    component_id is the smallest doc_id that links reach. Rows without words link with nothing and keep their own
    doc_id; so do rows with a null doc_id, unless a linked row has one. Equal rows are copies. Columns other than
    doc_id and text are not read.
    """
    rows, named = _components_of(documents, job_shingles, bucket_entries, paired_nodes)
    component = F.coalesce(F.when(F.col("component") != NO_ID, F.col("component")), F.col("doc_id"))
    return rows.join(named, "node", "left").select("doc_id", "n_shingles", component.alias("component_id"))


@keeping_columns
def without_near_copies(
    documents: DataFrame, job_shingles: int = JOB_SHINGLES, bucket_entries: int = BUCKET_ENTRIES, paired_nodes: int = PAIRED_NODES
) -> DataFrame:
    """One row of documents for each component, that with the smallest doc_id; all rows without words stay.

    Rows that stay are unchanged. Of rows with that doc_id, one stays.
    """
    rows, named = _components_of(documents, job_shingles, bucket_entries, paired_nodes)
    members = rows.join(named, "node").select("root", "id", "key")
    first = members.groupBy("root").agg(F.min(F.struct("id", "key")).alias("first"))
    gone = members.join(first, "root").where(F.col("key") != F.col("first.key")).select(F.col("key").alias("_key")).distinct()
    gone = settled(gone, "near-copies")
    repeated = rows.where("node is not null").groupBy(F.col("key").alias("_key")).count().where("count > 1").select("_key")
    repeated = settled(repeated, "repeated-rows")
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "text")
    kept = documents.withColumn("_key", key).join(gone, "_key", "left_anti")
    if not repeated.isEmpty():
        once = kept.join(repeated, "_key", "left_semi").dropDuplicates(["_key"])
        kept = kept.join(repeated, "_key", "left_anti").unionByName(once)
    return kept.drop("_key")
