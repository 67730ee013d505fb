"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model predicts the characters of a word, and its end, from up to ORDER - 1 characters before; it is trained on all
trusted documents. Counts of n-grams are a distributed table, keyed by the n-gram, and so are the costs that follow from
them. Documents are taken in slices of bounded size: a slice asks each shard of the costs for its distinct n-grams at
once and scores its documents with what comes back. So a frequent n-gram costs an entry for each slice, not one for each
occurrence.

Thresholds are quantiles of the trusted documents' scores for each language. A document that the model was trained on
scores lower than others, and the less so the more text there is; so for the thresholds each half of the trusted documents
is scored by a model of the other half. Beside a document's mean, its peaks count: the mean cube of its words' costs of a
symbol, which a few words unlike the trusted ones raise.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probefleet.llm import text as T
from probefleet.llm.workspace import keeping_columns, settled

ORDER = 5
#: Text bytes of a slice.
SLICE_BYTES = 8 << 20
#: Slices whose n-grams a shard answers on average.
SHARD_SLICES = 16
#: Longer words are cut into pieces of about so many bytes, each predicted by itself.
WORD_BYTES = 64
#: A document goes if its perplexity or its peaks are above this quantile of the trusted documents of its language.
QUANTILE = 0.99
#: Symbols of the trusted mean, and words of the trusted peaks, that a document's own are mixed with, as short texts vary
#: by chance.
PRIOR_SYMBOLS, PRIOR_WORDS = 60, 20
#: Words of fewer symbols make no peak: a symbol of a short word is dear anywhere.
PEAK_SYMBOLS = 5
#: Languages with fewer trusted documents have no threshold: the model hardly saw them.
LEAST_TRUSTED = 30

#: The models, by their columns of counts: of all trusted documents, and of each half.
MODELS = ("n", "n0", "n1")

#: Signs before the first character of a word and after its last; words hold no such control characters but as signs.
_BEGIN, _END = "\x02", "\x03"


def _cut_words(t: T.Texts, w: T.Words) -> T.Words:
    """Words with those of more than WORD_BYTES cut, between characters."""
    long = np.flatnonzero(w.end - w.start > WORD_BYTES)
    if not len(long):
        return w
    places = [np.arange(w.start[i] + WORD_BYTES, w.end[i], WORD_BYTES) for i in long]
    cuts, ends = np.concatenate(places), np.repeat(w.end[long], [len(x) for x in places])
    # On to the next character; a cut inside a word's last character is none.
    for _ in range(3):
        inside = cuts < ends
        cuts[inside] += (t.data[cuts[inside]] & 0xC0) == 0x80
    cuts = cuts[cuts < ends]
    start = np.union1d(w.start, cuts)
    end = np.union1d(w.end, cuts)
    return T.Words(start, end, np.searchsorted(start, t.offsets))


def word_grams(words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct ORDER-grams of some words, the gram of each symbol, and where each word's symbols begin.

    A word's symbols are its characters and its end.
    """
    pad = _BEGIN * (ORDER - 1)
    joined = "".join([f"{pad}{word}{_END}" for word in words])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = np.array([len(word) + 1 for word in words], np.int64)
    first = np.concatenate([[0], np.cumsum(symbols)])
    # Symbol k of word i ends a gram that begins at the word's padding plus k.
    at = np.arange(first[-1]) + np.repeat(np.arange(len(words)) * (ORDER - 1), symbols)
    hashes = T.gram_hashes(T.mix64(codes.astype(np.uint64)), ORDER)[at] if len(at) else np.zeros(0, np.uint64)
    _, where, gram = np.unique(hashes, return_index=True, return_inverse=True)
    return [joined[a : a + ORDER] for a in at[where].tolist()], gram, first


def _gram_keys(grams: list[str]) -> np.ndarray:
    codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return T.gram_hashes(T.mix64(codes), ORDER)[::ORDER] if len(grams) else np.zeros(0, np.uint64)


def _pack(*arrays: np.ndarray) -> bytes:
    """32-bit numbers, compressed byte by byte: upper bytes are mostly equal."""
    pack = zstandard.ZstdCompressor(level=3)
    parts = [pack.compress(np.ascontiguousarray(a.astype(np.int32).view(np.uint8).reshape(-1, 4).T).tobytes()) for a in arrays]
    return b"".join(x for p in parts for x in (len(p).to_bytes(8, "little"), p))


def _unpack(blob: bytes) -> list[np.ndarray]:
    out, at, unpack = [], 0, zstandard.ZstdDecompressor()
    while at < len(blob):
        size = int.from_bytes(blob[at : at + 8], "little")
        planes = np.frombuffer(unpack.decompress(blob[at + 8 : at + 8 + size]), np.uint8).reshape(4, -1)
        out.append(np.ascontiguousarray(planes.T).view(np.int32).ravel().astype(np.int64))
        at += 8 + size
    return out


def row_key() -> Column:
    """A hash of all that a verdict depends on."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text")


_SLICE = "slice long, keys array<long>, doc_ids array<long>, langs array<string>, docs binary, words binary"


def slices(documents: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """A row for each slice of documents: their keys, ids and languages, and packed: the distinct words of the slice, and
    for each document its distinct words and their counts."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for k, batch in enumerate(T.text_slices(batches, "text", slice_bytes)):
            t = T.texts(batch.column("text"))
            w = _cut_words(t, T.words(t))
            inside = t.data[T.NOT_SPACE[t.data]]
            offsets = np.concatenate([[0], np.cumsum(w.end - w.start)])
            strings = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(w), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(inside)]
            ).dictionary_encode()
            # Sorted words compress well.
            order = pc.sort_indices(strings.dictionary)
            words = [x.decode() for x in strings.dictionary.take(order).to_pylist()]
            rank = np.empty(len(words), np.int64)
            rank[order.to_numpy()] = np.arange(len(words))
            ids = rank[strings.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
            del inside, offsets, strings, rank, order
            pairs, counts = np.unique(w.owner * max(1, len(words)) + ids, return_counts=True)
            del w, ids
            doc, word = pairs // max(1, len(words)), pairs % max(1, len(words))
            sizes = np.bincount(doc, minlength=len(t))
            steps = np.diff(word, prepend=0)
            joined = zstandard.ZstdCompressor(level=3).compress("\n".join(words).encode())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([task + k]),
                    pa.array([batch.column("key").to_pylist()], pa.list_(pa.int64())),
                    pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    pa.array([batch.column("lang").to_pylist()], pa.list_(pa.string())),
                    pa.array([_pack(sizes, steps, counts)], pa.binary()),
                    pa.array([joined if words else None], pa.binary()),
                ],
                ["slice", "keys", "doc_ids", "langs", "docs", "words"],
            )

    doc_id, lang = F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    own = documents.select(row_key().alias("key"), doc_id.alias("doc_id"), lang.alias("lang"), "text")
    return own.mapInArrow(rows, _SLICE)


def _words_of(packed: bytes | None) -> list[str]:
    return zstandard.ZstdDecompressor().decompress(packed).decode().split("\n") if packed else []


def half(doc_id: Column) -> Column:
    """0 or 1: the half of the trusted documents that a doc_id is in."""
    return F.pmod(F.xxhash64(doc_id.cast("long"), F.lit("half")), F.lit(2)).cast("int")


def _joined_slices(parts: list[tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]) -> tuple[bytes, bytes | None]:
    """docs and words of one slice from parts of several: their words, and the documents' sizes, words and counts."""
    words = sorted(set().union(*(own for own, *_ in parts)))
    rank = {word: i for i, word in enumerate(words)}
    ids = [np.array([rank[x] for x in own], np.int64)[word] for own, _, word, _ in parts]
    steps = np.diff(np.concatenate(ids), prepend=0)
    docs = _pack(np.concatenate([x for _, x, _, _ in parts]), steps, np.concatenate([x for *_, x in parts]))
    return docs, zstandard.ZstdCompressor(level=3).compress("\n".join(words).encode()) if words else None


def trusted_slices(sliced: DataFrame, trusted: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Slices of all documents whose doc_id is in trusted, and their half. Those of a task are joined to the usual size."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        parts: list[list] = [[], []]
        rest: list[list[list]] = [[[], [], []], [[], [], []]]
        held = [0, 0]

        def joined(which: int) -> pa.RecordBatch:
            nonlocal number
            docs, words = _joined_slices(parts[which])
            keys, doc_ids, langs = rest[which]
            parts[which], rest[which], held[which] = [], [[], [], []], 0
            number += 1
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number]),
                    pa.array([keys], pa.list_(pa.int64())),
                    pa.array([doc_ids], pa.list_(pa.int64())),
                    pa.array([langs], pa.list_(pa.string())),
                    pa.array([docs], pa.binary()),
                    pa.array([words], pa.binary()),
                    pa.array([which], pa.int32()),
                ],
                ["slice", "keys", "doc_ids", "langs", "docs", "words", "half"],
            )

        for batch in T.giving_back(batches):
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                sizes, steps, counts = _unpack(row["docs"])
                words, word = _words_of(row["words"]), np.cumsum(steps)
                lengths = np.array([len(x.encode()) + 1 for x in words], np.int64)
                for which in (0, 1):
                    at = np.sort(np.array(row[f"at{which}"], np.int64))
                    if not len(at):
                        continue
                    chosen = np.zeros(len(sizes), bool)
                    chosen[at] = True
                    pairs = np.repeat(chosen, sizes)
                    seen, own = np.unique(word[pairs], return_inverse=True)
                    length = int((lengths[word[pairs]] * counts[pairs]).sum())
                    if held[which] and held[which] + length > slice_bytes:
                        yield joined(which)
                    parts[which].append(([words[k] for k in seen.tolist()], sizes[at], own, counts[pairs]))
                    for kept, name in zip(rest[which], ("keys", "doc_ids", "langs"), strict=True):
                        kept.extend(row[name][k] for k in at.tolist())
                    held[which] += length
        for which in (0, 1):
            if parts[which]:
                yield joined(which)

    places = (
        sliced.select("slice", F.posexplode("doc_ids").alias("at", "doc_id"))
        .join(trusted.select("doc_id").distinct(), "doc_id")
        .groupBy("slice")
        # At most the documents of a slice.
        .agg(*(F.collect_list(F.when(half(F.col("doc_id")) == k, F.col("at"))).alias(f"at{k}") for k in (0, 1)))
    )
    return sliced.join(places, "slice").drop("slice").mapInArrow(rows, f"{_SLICE}, half int")


def trusted_counts(picked: DataFrame) -> DataFrame:
    """gram, n0, n1: the ORDER-grams of the trusted documents, with their counts in each half."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.giving_back(batches):
            for docs, packed, which in zip(*(batch.column(c).to_pylist() for c in ("docs", "words", "half")), strict=True):
                _, steps, counts = _unpack(docs)
                words = _words_of(packed)
                total = np.bincount(np.cumsum(steps), counts, len(words)).astype(np.int64)
                grams, gram, first = word_grams(words)
                n = np.bincount(gram, np.repeat(total, np.diff(first)), len(grams)).astype(np.int64)
                halves = [n, np.zeros_like(n)][:: -1 if which else 1]
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), *map(pa.array, halves)], ["gram", "n0", "n1"])

    found = picked.select("docs", "words", "half").mapInArrow(rows, "gram string, n0 long, n1 long")
    return found.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney smoothing, kept within [0, count) where counts of counts are scarce."""
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    pairs = ((1, n1, n2), (2, n2, n3), (3, n3, n4))
    raw = [k - (k + 1) * y * b / a if a else k * y for k, a, b in pairs]
    return tuple(min(max(d, 0.05), k - 0.05) for d, (k, _, _) in zip(raw, pairs, strict=True))


def asked_grams(sliced: DataFrame) -> DataFrame:
    """gram: the distinct ORDER-grams of all slices."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.giving_back(batches):
            for packed in batch.column("words").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(word_grams(_words_of(packed))[0], pa.string())], ["gram"])

    return sliced.select("words").mapInArrow(rows, "gram string").distinct()


def kneser_ney(counts: DataFrame) -> tuple[dict[int, tuple[DataFrame, DataFrame]], list[float]]:
    """The models of counts (gram and MODELS), side by side: for each order the n-grams' discounted shares of their contexts
    (gram, share0, ...) and the weights that each context leaves to shorter ones (context, weight0, ...), null where a model
    knows none; and for each model the probability of a symbol before anything is known.

    Below the highest order an n-gram counts once for each symbol seen before it.
    """
    orders = {ORDER: counts.select("gram", *MODELS)}
    for order in range(ORDER - 1, 0, -1):
        seen = (F.count_if(F.col(m) > 0).alias(m) for m in MODELS)
        shorter = orders[order + 1].groupBy(F.substring("gram", 2, order).alias("gram")).agg(*seen)
        orders[order] = settled(shorter, f"grams-{order}")
    every = None
    for order, table in orders.items():
        own = table.select(F.lit(order).alias("order"), *MODELS)
        every = own if every is None else every.unionAll(own)
    types = (F.count_if(F.col(m) > 0).alias(f"{m}_types") for m in MODELS)
    rare = (F.count_if(F.col(m) == k).alias(f"{m}_{k}") for m in MODELS for k in (1, 2, 3, 4))
    tally = {r["order"]: r for r in every.groupBy("order").agg(*types, *rare).collect()}
    models = {}
    for order, table in orders.items():
        taken = []
        for m in MODELS:
            d1, d2, d3 = discounts(*(tally[order][f"{m}_{k}"] for k in (1, 2, 3, 4)))
            n = F.col(m)
            taken.append(F.when(n == 0, 0.0).when(n == 1, d1).when(n == 2, d2).otherwise(d3))
        context = F.substring("gram", 1, order - 1).alias("context")
        sums = [(F.sum(m).alias(f"total{k}"), F.sum(taken[k]).alias(f"left{k}")) for k, m in enumerate(MODELS)]
        contexts = table.groupBy(context).agg(*(x for both in sums for x in both))
        found = table.select("gram", *MODELS, context).join(contexts, "context")
        total = [F.col(f"total{k}") for k in range(len(MODELS))]
        shares = (F.when(F.col(m) > 0, (F.col(m) - taken[k]) / total[k]).alias(f"share{k}") for k, m in enumerate(MODELS))
        weights = (F.when(total[k] > 0, F.col(f"left{k}") / total[k]).alias(f"weight{k}") for k in range(len(MODELS)))
        models[order] = found.select("gram", *shares), contexts.select("context", *weights)
    return models, [1 / (tally[1][f"{m}_types"] + 1) for m in MODELS]


def gram_costs(grams: DataFrame, models: dict[int, tuple[DataFrame, DataFrame]], unseen: list[float]) -> DataFrame:
    """gram, cost0, ...: minus the logarithm of the interpolated probability of each distinct gram's last symbol, by each
    model.

    The orders are worked up from the lowest; each joins the grams' distinct endings with their counts.
    """
    p = None
    for order in range(1, ORDER + 1):
        shares, weights = models[order]
        endings = grams if order == ORDER else grams.select(F.substring("gram", ORDER + 1 - order, order).alias("gram")).distinct()
        known = endings.join(shares, "gram", "left").withColumn("context", F.substring("gram", 1, order - 1))
        known = known.join(weights, "context", "left")
        shorter = [F.lit(x) for x in unseen]
        if p is not None:
            known = known.withColumn("ending", F.substring("gram", 2, order - 1)).join(p, "ending")
            shorter = [F.col(f"p{k}") for k in range(len(unseen))]
        values = (
            (F.coalesce(f"share{k}", F.lit(0.0)) + F.coalesce(f"weight{k}", F.lit(1.0)) * x).alias(f"p{k}")
            for k, x in enumerate(shorter)
        )
        p = settled(known.select(F.col("gram").alias("ending"), *values), f"chances-{order}")
    return p.select(F.col("ending").alias("gram"), *((-F.log(f"p{k}")).alias(f"cost{k}") for k in range(len(unseen))))


def slice_costs(asked: DataFrame, costs: DataFrame, shards: int) -> DataFrame:
    """model, slice, costs: for each slice of asked the costs by its model of its distinct grams, as (shard, 32-bit floats
    in the order of the grams' hashes) for each shard.

    Requests and costs meet by shard, packed. A shard has its part of the distinct grams, and of each slice's requests.
    """

    def cut(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        shard = (keys % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        bounds = np.searchsorted(shard[order], np.arange(shards + 1))
        for k in np.flatnonzero(np.diff(bounds)).tolist():
            yield k, order[bounds[k] : bounds[k + 1]]

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.giving_back(batches):
            for model, name, packed in zip(*(batch.column(c).to_pylist() for c in ("model", "slice", "words")), strict=True):
                keys = np.sort(_gram_keys(word_grams(_words_of(packed))[0]))
                parts = [(k, model, name, keys[at].tobytes()) for k, at in cut(keys)]
                columns = zip(*parts, strict=True) if parts else [[]] * 4
                types = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
                arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["shard", "model", "slice", "keys"])

    def offer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.giving_back(batches):
            keys = _gram_keys(batch.column("gram").to_pylist())
            values = np.stack([batch.column(f"cost{k}").to_numpy().astype(np.float32) for k in range(len(MODELS))], axis=1)
            parts = [(k, keys[at].tobytes(), values[at].tobytes()) for k, at in cut(keys)]
            columns = zip(*parts, strict=True) if parts else [[]] * 3
            types = (pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["shard", "keys", "costs"])

    def answer(asked: pa.Table, offered: pa.Table) -> pa.Table:
        T.give_back()
        joined = lambda name, kind: np.frombuffer(b"".join(offered.column(name).to_pylist()), kind)
        keys, values = joined("keys", np.uint64), joined("costs", np.float32).reshape(-1, len(MODELS))
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        found = [
            {"shard": shard, "costs": values[np.searchsorted(keys, np.frombuffer(raw, np.uint64)), model].tobytes()}
            for shard, model, raw in zip(*(asked.column(c).to_pylist() for c in ("shard", "model", "keys")), strict=True)
        ]
        kind = pa.struct([("shard", pa.int64()), ("costs", pa.binary())])
        return pa.table({"model": asked.column("model"), "slice": asked.column("slice"), "answer": pa.array(found, kind)})

    requests = asked.select("model", "slice", "words").mapInArrow(ask, "shard long, model int, slice long, keys binary")
    offers = costs.mapInArrow(offer, "shard long, keys binary, costs binary")
    answers = requests.groupBy("shard").cogroup(offers.groupBy("shard")).applyInArrow(
        answer, "model int, slice long, answer struct<shard: long, costs: binary>"
    )
    return answers.groupBy("model", "slice").agg(F.collect_list("answer").alias("costs"))  # the distinct grams of a slice


_SCORED = "model int, key long, doc_id long, lang string, n_symbols long, n_words long, cost double, peaks double"


def document_costs(asked: DataFrame, costs: DataFrame) -> DataFrame:
    """model, key, doc_id, lang, n_symbols, n_words, cost (summed) and peaks of every document of the slices, by the model
    that its slice asks.

    peaks sums the cubes of the costs of a symbol of the words that have PEAK_SYMBOLS.
    """
    shards = max(1, asked.count() // SHARD_SLICES)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.giving_back(batches):
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                sizes, steps, counts = _unpack(row["docs"].as_py())
                words = _words_of(row["words"].as_py())
                grams, gram, first = word_grams(words)
                own = _gram_keys(grams)
                ranked = np.argsort(own)
                shard = (own[ranked] % np.uint64(shards)).astype(np.int64)
                cost = np.zeros(len(own))
                for part in row["costs"].as_py() or ():
                    cost[ranked[shard == part["shard"]]] = np.frombuffer(part["costs"], np.float32)
                word_cost = np.add.reduceat(np.append(cost[gram], 0), first[:-1]) if len(words) else np.zeros(0)
                word = np.cumsum(steps)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                peak = np.where(np.diff(first) < PEAK_SYMBOLS, 0, word_cost / np.diff(first)) ** 3
                n_symbols = np.bincount(doc, counts * np.diff(first)[word], len(sizes)).astype(np.int64)
                n_words = np.bincount(doc, counts, len(sizes)).astype(np.int64)
                total = np.bincount(doc, counts * word_cost[word], len(sizes)).astype(np.float64)
                peaks = np.bincount(doc, counts * peak[word], len(sizes)).astype(np.float64)
                model = np.full(len(sizes), row["model"].as_py(), np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(model), *(row[c].values for c in ("keys", "doc_ids", "langs")), *map(pa.array, (n_symbols, n_words, total, peaks))],
                    ["model", "key", "doc_id", "lang", "n_symbols", "n_words", "cost", "peaks"],
                )

    found = asked.join(slice_costs(asked, costs, shards), ["model", "slice"], "left").drop("slice")
    return found.mapInArrow(rows, _SCORED)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_ids labelled of high quality and not toxic, in all their rows."""
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    return (
        labels.where("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min(good).alias("good"))
        .where("good")
        .select("doc_id")
    )


def scored_by(asked: DataFrame, sliced: DataFrame, counts: DataFrame) -> DataFrame:
    """document_costs of the slices of asked, whose words are all in sliced, under the models of some counts (gram, n0, n1).

    The models are worked out in one pass: a pass for each would be as many plans, jobs and tasks for the driver to hold.
    """
    models, unseen = kneser_ney(counts.withColumn("n", F.col("n0") + F.col("n1")))
    costs = gram_costs(settled(asked_grams(sliced), "asked-grams"), models, unseen)
    return settled(document_costs(asked, costs), "document-costs")


def of_other_half(picked: DataFrame, counts: DataFrame) -> DataFrame:
    """The trusted slices, each asking the model of the other half; none without two halves."""
    both = counts.agg(F.max("n0"), F.max("n1")).first()
    model = F.when(F.col("half") == 0, MODELS.index("n1")).otherwise(MODELS.index("n0"))
    return picked.where(F.lit(all(both))).withColumn("model", model).drop("half")


def unseen_scores(picked: DataFrame, counts: DataFrame) -> DataFrame:
    """document_costs of the trusted documents, each half under the model of the other half; none without two halves."""
    return scored_by(of_other_half(picked, counts), picked, counts)


def quality_classifier(documents: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, lang (`und` for null), n_symbols, perplexity, threshold, kept and key of every row of documents.

    perplexity is that of a symbol (null without words); kept is false where it, mixed with PRIOR_SYMBOLS of the
    trusted mean of its language, exceeds the threshold, or where the mean of its words' peaks, mixed likewise, exceeds
    theirs. Both limits come from trusted documents under a model that did not see them. Texts without words are kept:
    nothing speaks against them here. So are all texts of a language (null is one of its own) with fewer than
    LEAST_TRUSTED trusted documents with words: it has no threshold, as the model does not know it. Equal rows get equal
    verdicts; a null doc_id is never trusted. Columns other than doc_id, lang and text are not read.
    """
    sliced = settled(slices(documents, slice_bytes), "slices")
    trusted = settled(trusted_ids(labels), "trusted")
    picked = settled(trusted_slices(sliced, trusted, slice_bytes), "trusted-slices")
    counts = settled(trusted_counts(picked), "gram-counts")
    plain = "doc_id", "lang", "n_symbols"
    if counts.isEmpty():
        every = sliced.select(F.explode(F.arrays_zip("keys", "doc_ids", "langs")).alias("d"))
        return every.select(
            F.col("d.doc_ids").alias("doc_id"), F.col("d.langs").alias("lang"), F.lit(None).cast("long").alias("n_symbols"),
            F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("kept"),
            F.col("d.keys").alias("key"),
        )
    asked = sliced.withColumn("model", F.lit(MODELS.index("n"))).unionByName(of_other_half(picked, counts))
    every = scored_by(asked, sliced, counts)
    scored = every.where(F.col("model") == MODELS.index("n"))
    known = every.where((F.col("model") != MODELS.index("n")) & (F.col("n_symbols") > 0))

    means = (F.sum("cost") / F.sum("n_symbols")).alias("mean"), (F.sum("peaks") / F.sum("n_words")).alias("mean_peak")
    # Tables by language are written: their joins are broadcasts where the size allows it, as one language may hold most rows.
    enough = (F.col("n") >= LEAST_TRUSTED) & (F.col("n_halves") == 2)
    counted = F.count_distinct("doc_id").alias("n"), F.count_distinct(half(F.col("doc_id"))).alias("n_halves")
    each = settled(known.groupBy("lang").agg(*means, *counted).where(enough).drop("n", "n_halves"), "language-means")

    def mixed(frame: DataFrame, means: DataFrame, how: str) -> DataFrame:
        return frame.join(means, "lang", how).withColumns({
            "level": (F.col("cost") + PRIOR_SYMBOLS * F.col("mean")) / (F.col("n_symbols") + PRIOR_SYMBOLS),
            "peak": (F.col("peaks") + PRIOR_WORDS * F.col("mean_peak")) / (F.col("n_words") + PRIOR_WORDS),
        })

    limits = [F.percentile_approx(c, F.lit(quantile), F.lit(10_000)).alias(f"{c}_limit") for c in ("level", "peak")]
    by_lang = settled(each.join(mixed(known, each, "inner").groupBy("lang").agg(*limits), "lang"), "language-levels")
    judged = mixed(scored, by_lang, "left")
    has_words = F.col("n_symbols") > 0
    fits = (F.col("level") <= F.col("level_limit")) & (F.col("peak") <= F.col("peak_limit"))
    return judged.select(
        *plain,
        F.when(has_words, F.exp(F.col("cost") / F.col("n_symbols"))).alias("perplexity"),
        F.exp("level_limit").alias("threshold"),
        F.coalesce(~has_words | fits, F.lit(True)).alias("kept"),
        "key",
    )


@keeping_columns
def without_low_quality(documents: DataFrame, labels: DataFrame, **options: float) -> DataFrame:
    """The rows of documents that the classifier keeps, unchanged."""
    judged = quality_classifier(documents, labels, **options)
    rejected = settled(judged.where("not kept").select(F.col("key").alias("_key")).distinct(), "rejected")
    return documents.withColumn("_key", row_key()).join(rejected, "_key", "left_anti").drop("_key")
