"""Removal of repeated passages with prefix-partitioned suffix trees.

A passage of WINDOW words that starts in several documents stays in the one with the smallest doc_id. Finding it needs
the deep internal nodes (WINDOW words or more) of the suffix tree of all documents, which is never built as a whole:

1. Each suffix belongs to the group of its *anchor*, the least ANCHOR-word gram in its first WINDOW words. Neighbouring
   suffixes mostly share an anchor, so a run of them travels as one short segment. Suffixes that share their first
   WINDOW words have the same anchor at the same place.
2. Only anchors that occur in two documents can lead to a repeat. The others end here.
3. Equal segments become one, with their smallest doc_id, before they meet. Groups of bounded size are dealt to tasks;
   each builds the suffixes' order and their common prefixes and reads off the deep nodes. Groups above the bound are
   split by longer prefixes: first by SIDE more words before or after the anchor, as a window holds so many on one of
   its sides; what is still too large by all WINDOW words of a suffix, of which only the smallest doc_id matters.
4. Each document gets the word ranges whose node has a smaller doc_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probefleet.llm import text as T
from probefleet.llm.workspace import NO_ID, keeping_columns, keyed, packed_texts, settled, unpacked_texts

WINDOW = 50
#: Words of an anchor.
ANCHOR = 8
#: Words beside an anchor that split a large group. A window has WINDOW - ANCHOR words beside its anchor, at least SIDE
#: of them before it or at least SIDE after it.
SIDE = (WINDOW - ANCHOR) // 2
#: Segments of one anchor that a task takes; anchors of more are split by their suffixes' whole prefixes.
GROUP_SEGMENTS = 2000
#: Segments that are dealt to a task together.
JOB_SEGMENTS = 20_000

_POSITION_BITS = np.uint64(28)


def anchors(ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words of a slice: the hashes of all ANCHOR-grams, the window starts, and each window's anchor position.

    The least gram is the one with the least leading hash bits, the first of equals: a property of the window alone.
    """
    size = len(ids) - WINDOW + 1
    if size <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = T.gram_hashes(ids, ANCHOR)
    least = (grams >> _POSITION_BITS << _POSITION_BITS) | np.arange(len(grams), dtype=np.uint64)
    width, span = 1, WINDOW - ANCHOR + 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    windows = np.flatnonzero(owner[:size] == owner[WINDOW - 1 :])
    at = least[windows] & ((np.uint64(1) << _POSITION_BITS) - np.uint64(1))
    return grams, windows, at.astype(np.int64)


def document_anchors(keyed_documents: DataFrame) -> DataFrame:
    """h, id, key: the distinct anchors of each document."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.text_slices(batches, "text"):
            t = T.texts(batch.column("text"))
            w = T.words(t)
            owner = w.owner
            grams, _, at = anchors(T.word_hashes(t.data, w.start, w.end), owner)
            at = np.unique(at)
            h, doc = grams[at].view(np.int64), owner[at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h), *(batch.column(c).take(pa.array(doc)) for c in ("id", "key"))], ["h", "id", "key"]
            )

    return keyed_documents.mapInArrow(rows, "h long, id long, key long")


def segments(keyed_documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """h, seg, id, key, start, windows, anchor, words: runs of neighbouring windows with the same wanted anchor.

    wanted has the distinct anchors (hs) of each key. seg is a hash of the words and the anchor's place among them; the
    words are those of all windows of the run in the document's own spacing.
    """

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.text_slices(unpacked_texts(batches), "text"):
            t = T.texts(batch.column("text"))
            w = T.words(t)
            owner = w.owner
            ids = T.word_hashes(t.data, w.start, w.end)
            grams, windows, at = anchors(ids, owner)
            hs = batch.column("hs")
            # Membership of (document, anchor) by a hash of both.
            salt = T.mix64(np.arange(len(t), dtype=np.uint64))
            counts = np.diff(hs.offsets.to_numpy())
            flat = hs.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            known = np.unique(flat ^ np.repeat(salt, counts))
            mine = grams[at] ^ salt[owner[windows]]
            found = np.isin(mine, known)
            windows, at = windows[found], at[found]
            if not len(windows):
                continue
            new = np.concatenate([[True], (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1)])
            first = np.flatnonzero(new)
            last = np.concatenate([first[1:], [len(windows)]]) - 1
            begin, end = windows[first], windows[last] + WINDOW
            doc = owner[begin]
            raw, lo, hi = t.data.tobytes(), w.start[begin].tolist(), w.end[end - 1].tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(grams[at[first]].view(np.int64)),
                    pa.array((T.range_hashes(ids, begin, end) + at[first].astype(np.uint64) - begin.astype(np.uint64)).view(np.int64)),
                    *(batch.column(c).take(pa.array(doc)) for c in ("id", "key")),
                    pa.array((begin - w.first[doc]).astype(np.int32)),
                    pa.array((last - first + 1).astype(np.int32)),
                    pa.array((at[first] - begin).astype(np.int32)),
                    pa.array([raw[a:b] for a, b in zip(lo, hi, strict=True)], pa.binary()).cast(pa.string()),
                ],
                ["h", "seg", "id", "key", "start", "windows", "anchor", "words"],
            )

    joined = packed_texts(keyed_documents).join(wanted, "key").select("id", "key", "packed", "hs")
    return joined.mapInArrow(rows, "h long, seg long, id long, key long, start int, windows int, anchor int, words string")


def suffix_order(words: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes by their first `depth` words, and the common prefix length (depth at most) of neighbours.

    words holds texts one after another as word numbers, ends[i] the end of the text that position i is in. Ranks of
    prefixes of doubling length give both.
    """
    n = len(words)
    position = np.arange(n)
    levels, length = [], 1
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64) + 1
    levels.append((1, rank))
    while length < depth:
        step = min(length, depth - length)
        follower = np.where(position + step < ends, np.append(rank, np.zeros(step, np.int64))[step : n + step], 0)
        rank = np.unique(rank * (n + 1) + follower, return_inverse=True)[1].astype(np.int64) + 1
        length += step
        levels.append((length, rank))
    order = np.argsort(rank, kind="stable")
    a, b = order[:-1], order[1:]
    whole = rank[a] == rank[b]
    common = np.zeros(max(0, n - 1), np.int64)
    for length, rank in reversed(levels[:-1]):
        # Neighbours that differ share a sum of different doubling lengths.
        at_a, at_b = a + common, b + common
        inside = (at_a < ends[a]) & (at_b < ends[b])
        same = inside & (rank[np.minimum(at_a, n - 1)] == rank[np.minimum(at_b, n - 1)])
        common += np.where(same, length, 0)
    # A text's end is a rank of its own, so a shared rank may run over the end: cut it there.
    room = np.minimum(ends[a] - a, ends[b] - b)
    return order, np.minimum(np.where(whole, depth, common), room)


def node_ids(words: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For every position with WINDOW words before its text's end: the smallest of ids below its node of that depth.

    ids has a document for each position. Positions closer to the end keep their own.
    """
    order, common = suffix_order(words, ends, WINDOW)
    # Neighbours with WINDOW words in common lie below the same deep node.
    node = np.concatenate([[0], np.cumsum(common < WINDOW)]) if len(order) else np.zeros(0, np.int64)
    low = np.full(int(node[-1]) + 1 if len(node) else 0, NO_ID)
    np.minimum.at(low, node, ids[order])
    out = np.empty(len(words), np.int64)
    out[order] = low[node]
    return out


def _runs(low: np.ndarray, first: int) -> list[dict[str, int]]:
    """[start, stop) of equal neighbours, numbered from first."""
    cuts = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    ends = [*cuts[1:].tolist(), len(low)]
    return [{"start": first + a, "stop": first + b, "low": int(low[a])} for a, b in zip(cuts.tolist(), ends, strict=True)]


_LOWS = "h long, seg long, lows array<struct<start: int, stop: int, low: long>>"
_LOWS_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("low", pa.int64())]))


def subtree_lows(table: pa.Table) -> pa.Table:
    """The smallest doc_id of each window of some groups' distinct segments (h, seg, low, first, windows, words).

    first is added to the windows' numbers.
    """
    found: list[list[dict[str, int]]] = []
    column = table.column("words").combine_chunks()
    t = T.texts(column)
    w = T.words(t)
    strings = pa.array([t.data[a:b].tobytes() for a, b in zip(w.start, w.end, strict=True)], pa.binary())
    numbers = strings.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    counts = w.counts
    lows = node_ids(numbers, np.repeat(w.first[1:], counts), np.repeat(table.column("low").to_numpy(), counts))
    for i, (first, n) in enumerate(zip(table.column("first").to_pylist(), table.column("windows").to_pylist(), strict=True)):
        found.append(_runs(lows[w.first[i] : w.first[i] + n], first))
    return pa.table({"h": table.column("h"), "seg": table.column("seg"), "lows": pa.array(found, _LOWS_TYPE)})


def _whole_prefixes(distinct: DataFrame) -> DataFrame:
    """lows of the distinct segments of large groups: suffixes are grouped by a 128-bit hash of all WINDOW words."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.text_slices(batches, "words"):
            t = T.texts(batch.column("words"))
            w = T.words(t)
            ids = T.word_hashes(t.data, w.start, w.end)
            n = batch.column("windows").to_numpy().astype(np.int64)
            seg = np.repeat(np.arange(len(n)), n)
            offset = np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)
            start = w.first[seg] + offset
            offset += batch.column("first").to_numpy().astype(np.int64)[seg]
            a, b = (T.range_hashes(x, start, start + WINDOW).view(np.int64) for x in (ids, T.mix64(ids + np.uint64(1))))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(seg)) for c in ("h", "seg", "low")), pa.array(offset), pa.array(a), pa.array(b)],
                ["h", "seg", "low", "offset", "a", "b"],
            )

    windows = distinct.select("h", "seg", "low", "first", "windows", "words").mapInArrow(
        rows, "h long, seg long, low long, offset long, a long, b long"
    )
    lowest = windows.groupBy("a", "b").agg(F.min("low").alias("lowest"), F.count(F.lit(1)).alias("n")).where("n > 1")
    own = F.col("offset").cast("int")
    one = F.struct(own.alias("start"), (own + 1).alias("stop"), F.col("lowest").alias("low"))
    # Only windows that several segments share can have a smaller doc_id than the segment's own.
    shared = windows.join(lowest, ["a", "b"]).groupBy("h", "seg").agg(F.collect_list(one).alias("shared"))
    return _own_lows(distinct).unionAll(shared.select("h", "seg", F.col("shared").alias("lows")))


def _own_lows(parts: DataFrame) -> DataFrame:
    """lows of segments whose windows no other segment has."""
    n = (F.col("first") + F.col("windows")).cast("int")
    own = F.struct(F.col("first").cast("int").alias("start"), n.alias("stop"), F.col("low").alias("low"))
    return parts.select("h", "seg", F.array(own).alias("lows"))


def _sides(distinct: DataFrame) -> DataFrame:
    """Distinct segments cut in two: windows with at least SIDE words after the anchor, and the others, which have more
    before it. group is a hash of the anchor and the SIDE words after or before it."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.text_slices(batches, "words"):
            t = T.texts(batch.column("words"))
            w = T.words(t)
            ids, raw = T.word_hashes(t.data, w.start, w.end), t.data.tobytes()
            out: list[tuple] = []
            for i, (n, anchor) in enumerate(zip(batch.column("windows").to_pylist(), batch.column("anchor").to_pylist(), strict=True)):
                # Windows from cut on start at most WINDOW - ANCHOR - SIDE words before the anchor.
                cut = min(max(anchor - (WINDOW - ANCHOR - SIDE), 0), n)
                for after, lo, hi in ((True, cut, n), (False, 0, cut)):
                    if lo < hi:
                        a = int(w.first[i])
                        begin = a + anchor - (0 if after else SIDE)
                        words = raw[w.start[a + lo] : w.end[a + hi - 1 + WINDOW - 1]]
                        out.append((i, lo, hi - lo, words, begin, after))
            rows_, first, windows, words, begin, after = zip(*out, strict=True) if out else [[]] * 6
            begin = np.array(begin, np.int64)
            group = T.range_hashes(ids, begin, begin + ANCHOR + SIDE) ^ np.array(after, np.uint64)
            at = pa.array(np.array(rows_, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).take(at) for c in ("h", "seg", "low")),
                    pa.array(first, pa.int32()),
                    pa.array(windows, pa.int32()),
                    pa.array(words, pa.binary()).cast(pa.string()),
                    pa.array(group.view(np.int64)),
                ],
                ["h", "seg", "low", "first", "windows", "words", "group"],
            )

    columns = distinct.select("h", "seg", "low", "windows", "anchor", "words")
    return columns.mapInArrow(rows, "h long, seg long, low long, first int, windows int, words string, group long")


def window_lows(distinct: DataFrame, group_segments: int, job_segments: int) -> DataFrame:
    """h, seg, lows: for each window of each distinct segment, runs with the smallest doc_id that has the window.

    A segment may have several rows.
    """

    def in_jobs(parts: DataFrame, group: str) -> DataFrame:
        jobs = max(1, -(-parts.count() // job_segments))
        dealt = parts.select("h", "seg", "low", "first", "windows", "words", F.pmod(F.xxhash64(group), F.lit(jobs)).alias("job"))
        return dealt.groupBy("job").applyInArrow(subtree_lows, _LOWS)

    def larger(parts: DataFrame, group: str, than: int, purpose: str) -> DataFrame:
        counts = parts.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > than)
        return settled(counts.select(group), purpose)

    whole = distinct.withColumn("first", F.lit(0))
    large = larger(whole, "h", group_segments, "large-anchors")
    lows = in_jobs(whole.join(large, "h", "left_anti"), "h")
    sides = settled(_sides(whole.join(large, "h", "left_semi")), "sides")
    several, most = larger(sides, "group", 1, "shared-sides"), larger(sides, "group", group_segments, "large-sides")
    met = sides.join(several, "group", "left_semi")
    return (
        lows.unionAll(_own_lows(sides.join(several, "group", "left_anti")))
        .unionAll(in_jobs(met.join(most, "group", "left_anti"), "group"))
        .unionAll(_whole_prefixes(sides.join(most, "group", "left_semi")))
    )


def repeated_ranges(
    keyed_documents: DataFrame, group_segments: int = GROUP_SEGMENTS, job_segments: int = JOB_SEGMENTS
) -> DataFrame:
    """key, spans: word ranges [start, stop) of a document covered by windows that a smaller id has too."""
    found = settled(document_anchors(keyed_documents), "anchors")
    shared = found.groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("h")
    # Written, so that the join is between plain shuffles, where Spark can split a frequent anchor.
    shared = settled(shared, "shared-anchors")
    # An anchor is at least a word of its document, so the lists are bounded by the documents.
    wanted = found.join(shared, "h").groupBy("key").agg(F.collect_set("h").alias("hs"))
    runs = settled(segments(keyed_documents, wanted), "segments")
    distinct = runs.groupBy("h", "seg").agg(
        F.min("id").alias("low"),
        F.first("windows").alias("windows"),
        F.first("anchor").alias("anchor"),
        F.first("words").alias("words"),
    )
    lows = window_lows(settled(distinct, "distinct-segments"), group_segments, job_segments)
    hits = (
        runs.select("h", "seg", "id", "key", "start")
        .join(lows, ["h", "seg"])
        .select("key", "id", F.col("start").alias("at"), F.explode("lows").alias("low"))
        .where("low.low < id")
    )
    span = F.struct(
        (F.col("at") + F.col("low.start")).alias("start"), (F.col("at") + F.col("low.stop") + WINDOW - 1).alias("stop")
    )
    return settled(hits.select("key", span.alias("span")).groupBy("key").agg(F.collect_set("span").alias("spans")), "spans")


def _covered(batch: pa.RecordBatch, w: T.Words) -> np.ndarray:
    """Flags of the removed words of a slice."""
    spans = batch.column("spans")
    rows = np.repeat(np.arange(batch.num_rows), pc.list_value_length(spans).fill_null(0).to_numpy(zero_copy_only=False))
    flat = spans.flatten()
    start, stop = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
    return T.covered(len(w), start + w.first[rows], stop + w.first[rows])


def substring_digest(documents: DataFrame, **limits: int) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of documents.

    Null and empty texts have no words (the digest of an empty text). Null doc_ids count as larger than all others and
    as one document; so do rows with the same doc_id: none of them removes from another. Equal rows get equal rows.
    Columns other than doc_id and text are not read.
    """
    own = keyed(documents)
    spans = repeated_ranges(own, **limits)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.text_slices(unpacked_texts(batches), "text"):
            t = T.texts(batch.column("text"))
            w = T.words(t)
            gone = _covered(batch, w)
            raw, digests, removed = t.data.tobytes(), [], []
            start, end = w.start.tolist(), w.end.tolist()
            for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
                kept = b" ".join([raw[start[k] : end[k]] for k in range(a, b) if not gone[k]])
                digests.append(hashlib.sha256(kept).hexdigest())
                removed.append(int(gone[a:b].sum()))
            ids = batch.column("id").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=ids == NO_ID), pa.array(w.counts.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(digests)],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    joined = packed_texts(own).join(spans, "key", "left").select("id", "packed", "spans")
    return joined.mapInArrow(rows, "doc_id long, n_words long, n_removed long, kept_sha256 string")


@keeping_columns
def without_repeats(documents: DataFrame, **limits: int) -> DataFrame:
    """documents with repeated words cut out of their texts, together with the white space after them.

    Texts without repeats stay as they are, and so do rows; n_chars, where present, follows.
    """
    names = documents.columns
    own = keyed(documents)
    spans = repeated_ranges(own, **limits).withColumnRenamed("key", "_key").withColumnRenamed("spans", "_spans")

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.text_slices(batches, "text"):
            column = batch.column("text")
            t = T.texts(column)
            w = T.words(t)
            gone = _covered(batch.rename_columns([*names, "spans"]), w)
            texts = column.to_pylist()
            for i in np.flatnonzero(np.bincount(w.owner[gone], minlength=len(t))):
                a, b, base = int(w.first[i]), int(w.first[i + 1]), int(t.offsets[i])
                raw, keep = texts[i].encode(), []
                starts = [*(w.start[a:b] - base).tolist(), len(raw)]
                keep = [raw[: starts[0]]] + [raw[starts[k] : starts[k + 1]] for k in range(b - a) if not gone[a + k]]
                texts[i] = b"".join(keep).decode()
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "text")
    joined = documents.withColumn("_key", key).join(spans, "_key", "left").select(*names, "_spans")
    out = joined.mapInArrow(rows, documents.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else out
