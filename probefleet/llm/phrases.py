"""Phrase collocation mining with Rabin-Karp fingerprints.

Prefix polynomials over word hashes give the fingerprint of every n-gram of a slice at once. Tasks add up equal
fingerprints, a shuffle adds the tasks' sums and keeps one occurrence, the document's key, for each. Longer n-grams are
counted only where their parts are frequent, which a Bloom filter of bounded size tells. A second polynomial shows whether
different n-grams met in one fingerprint; those are counted again by their text. Only frequent phrases are ever spelled out,
each from the document that its occurrence points to. From there on phrases are strings and everything is DataFrame work.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probefleet.llm import text as T
from probefleet.llm.membership import Members, members
from probefleet.llm.workspace import settled, unpacked_texts

LEAST_COUNT = 100
LONGEST = 5
TOP = 2000
#: Texts of this many bytes are hashed together; only one piece without a separator can make a larger stretch.
STRETCH_BYTES = 1 << 20
#: The n-grams of this much text meet in one step of a task.
BUCKET_BYTES = 8 << 20
#: Buckets of a task on average.
TASK_BUCKETS = 2
#: A task adds up this many fingerprints before it hands them on.
PENDING = 800_000
#: Ranks are found in this many parts of a language first.
RANK_PARTS = 32
UNKNOWN = "und"

_SEPARATORS = T.byte_class(b".,;:!?\x0a\x0b\x0c\x0d")
_WORD = ~T.byte_class(b" \t.,;:!?\x0a\x0b\x0c\x0d")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_U = np.uint64
# Odd multipliers of the two polynomials.
_BASES = (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)


def _longs(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


class Grams:
    """The n-grams of lower-cased texts that lie in one piece, and their fingerprints."""

    def __init__(self, t: T.Texts, lang_key: np.ndarray):
        self.texts = T.Texts(_LOWER[t.data], t.offsets)
        self.words = T.words(self.texts, _WORD)
        self.owner = self.words.owner
        separators = np.flatnonzero(_SEPARATORS[self.texts.data])
        # Both numbers grow along the texts, so their sum tells pieces apart.
        self._piece = np.searchsorted(separators, self.words.start) + self.owner
        hashes = T.word_hashes(self.texts.data, self.words.start, self.words.end)
        self._lang = lang_key[self.owner]
        with np.errstate(over="ignore"):
            self._prefixes = []
            for base in _BASES:
                powers = np.full(len(hashes) + 1, base, _U)
                powers[0] = 1
                np.multiply.accumulate(powers, out=powers)
                inverse = np.full(len(hashes) + 1, pow(base, -1, 1 << 64), _U)
                inverse[0] = 1
                np.multiply.accumulate(inverse, out=inverse)
                sums = np.zeros(len(hashes) + 1, _U)
                np.cumsum(hashes * powers[:-1], out=sums[1:])
                self._prefixes.append((sums, inverse))

    def starts(self, size: int) -> np.ndarray:
        """First words of all n-grams of a size; 0 is the empty phrase, which stands at every word."""
        if size <= 1:
            return np.arange(len(self.words))
        return np.flatnonzero(self._piece[: max(0, len(self.words) - size + 1)] == self._piece[size - 1 :])

    def _hashes(self, which: int, start: np.ndarray, size: int) -> np.ndarray:
        sums, inverse = self._prefixes[which]
        with np.errstate(over="ignore"):
            value = (sums[start + size] - sums[start]) * inverse[start] + _U(size)
            return T.mix64(value ^ self._lang[start])

    def fingerprints(self, start: np.ndarray, size: int, bits: int) -> np.ndarray:
        """The n-grams' fingerprints, of which two bits tell apart what is counted in different passes."""
        return self._hashes(0, start, size) >> _U(66 - bits) | _U(max(0, min(size - 1, 2))) << _U(62)

    def checks(self, start: np.ndarray, size: int) -> np.ndarray:
        return (self._hashes(1, start, size) >> _U(32)).astype(np.uint32).view(np.int32)

    def spelled(self, start: int, size: int) -> str:
        w = self.words
        return b" ".join(self.texts.data[w.start[i] : w.end[i]].tobytes() for i in range(start, start + size)).decode()


def stretches(batches: Iterable[pa.RecordBatch], limit: int = STRETCH_BYTES) -> Iterator[tuple[Grams, pa.RecordBatch]]:
    """Grams of some rows at a time, with the rows. A text beyond the limit comes in parts that end with a piece."""
    for batch in T.text_slices(batches, "text", limit):
        t = T.texts(batch.column("text"))
        lang_key = _longs(batch.column("lang_key")).view(_U)
        if len(t.data) <= limit:
            yield Grams(t, lang_key), batch
            continue
        # A slice beyond the limit is one row.
        cuts, at = np.flatnonzero(_SEPARATORS[t.data]) + 1, 0
        while at < len(t.data):
            fitting = int(np.searchsorted(cuts, at + limit, "right"))
            if fitting and cuts[fitting - 1] > at:
                end = int(cuts[fitting - 1])
            else:
                end = int(cuts[fitting]) if fitting < len(cuts) else len(t.data)
            yield Grams(T.Texts(t.data[at:end], np.array([0, end - at])), lang_key), batch
            at = end


@dataclass
class Sums:
    """Sorted fingerprints with number of occurrences, lowest key, lowest and highest check."""

    fp: np.ndarray
    n: np.ndarray
    key: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def of(parts: list[Sums]) -> Sums:
        fp = np.concatenate([p.fp for p in parts])
        order = np.argsort(fp)
        fp = fp[order]
        first = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]])) if len(fp) else np.zeros(0, np.int64)

        def over(name: str, operation: np.ufunc) -> np.ndarray:
            values = np.concatenate([getattr(p, name) for p in parts])[order]
            return operation.reduceat(values, first) if len(first) else values

        return Sums(fp[first], over("n", np.add), over("key", np.minimum), over("low", np.minimum), over("high", np.maximum))

    def frequent(self, least: int) -> pa.RecordBatch:
        keep = self.n >= least
        columns = [self.fp.view(np.int64), self.n, self.key, self.low, self.high]
        return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], ["fp", "n", "key", "low", "high"])

    def packed(self, buckets: int) -> Iterator[pa.RecordBatch]:
        """The entries by bucket, a range of fingerprints, as byte planes: sorted values differ in few of them."""
        # Where checks differ, both stand, and the number of occurrences with the first.
        extra = np.flatnonzero(self.low != self.high)
        at = np.append(np.arange(len(self.fp)), extra)
        order = np.argsort(at, kind="stable")
        second = np.append(np.zeros(len(self.fp), bool), np.ones(len(extra), bool))[order]
        at = at[order]
        check, n = np.where(second, self.high[at], self.low[at]), np.where(second, 0, self.n[at])
        bucket = ((self.fp[at] >> _U(30)) & _U(0xFFFFFFFF)) * _U(buckets) >> _U(32)
        cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(at) else np.zeros(0, np.int64)
        ends = np.append(cuts[1:], len(at))[: len(cuts)]
        planes = [
            [_planes(values[a:b]) for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)]
            for values in (self.fp[at], n.astype(np.int64), self.key[at], check)
        ]
        columns = [pa.array(bucket[cuts].astype(np.int64)), *(pa.array(x, pa.binary()) for x in planes)]
        yield pa.RecordBatch.from_arrays(columns, ["bucket", "fp", "n", "key", "check"])

    @staticmethod
    def unpacked(batch: pa.RecordBatch, row: int) -> Sums:
        fp, n, key, check = (
            _values(batch.column(c)[row].as_buffer(), kind) for c, kind in (("fp", _U), ("n", np.int64), ("key", np.int32), ("check", np.int32))
        )
        return Sums(fp, n, key, check, check)


def _planes(values: np.ndarray) -> bytes:
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _values(planes: pa.Buffer, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def counted(
    texts: DataFrame, sizes: tuple[int, ...], known: Broadcast[Members] | None, known_size: int, bits: int, least: int, buckets: int
) -> DataFrame:
    """fp, n, key, low and high of all n-grams of the sizes that occur least times and whose parts of known_size words are known."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[Sums] = []
        for grams, batch in stretches(batches):
            keys = batch.column("key").to_numpy(zero_copy_only=False).astype(np.int32)
            if known is not None:
                parts = grams.starts(known_size)
                good = np.zeros(len(grams.words) + 1, bool)
                good[parts] = known.value.has(grams.fingerprints(parts, known_size, bits))
            for size in sizes:
                start = grams.starts(size)
                if known is not None:
                    for step in range(size - known_size + 1):
                        start = start[good[start + step]]
                check = grams.checks(start, size)
                ones = np.ones(len(start), np.int64)
                waiting.append(Sums.of([Sums(grams.fingerprints(start, size, bits), ones, keys[grams.owner[start]], check, check)]))
            if sum(len(s.fp) for s in waiting) > PENDING:
                waiting = [Sums.of(waiting)]
                if len(waiting[0].fp) > PENDING // 2:
                    yield from waiting.pop().packed(buckets)
        if waiting:
            yield from Sums.of(waiting).packed(buckets)

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One bucket after the other, as the rows are sorted."""
        waiting, at = [], None
        for batch in batches:
            for row, bucket in enumerate(batch.column("bucket").to_pylist()):
                if bucket != at and waiting:
                    yield Sums.of(waiting).frequent(least)
                    waiting = []
                at = bucket
                waiting.append(Sums.unpacked(batch, row))
        if waiting:
            yield Sums.of(waiting).frequent(least)

    packed = texts.mapInArrow(rows, "bucket long, fp binary, n binary, key binary, check binary")
    # Few buckets for a task at any size, as their rows are large.
    tasks = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets // TASK_BUCKETS)
    return packed.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(sums, "fp long, n long, key int, low int, high int")


_PHRASE_TYPES = [pa.int64(), pa.string(), pa.int32(), pa.string()]


def _spelled(pointed: DataFrame, sizes: range, bits: int) -> DataFrame:
    """fp, lang, size and phrase of the fingerprints fps of each row's packed text."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grams, batch in stretches(unpacked_texts(batches)):
            langs, wanted = batch.column("lang").to_pylist(), batch.column("fps").to_pylist()
            open_ = {(row, fp) for row, fps in enumerate(wanted) for fp in fps}
            every = np.array([fp for fps in wanted for fp in fps], np.int64).view(_U)
            out = []
            for size in sizes:
                start = grams.starts(size)
                found = grams.fingerprints(start, size, bits)
                for i in np.flatnonzero(np.isin(found, every)).tolist():
                    row, fp = int(grams.owner[start[i]]), int(found[i].view(np.int64))
                    if (row, fp) in open_:
                        open_.discard((row, fp))
                        out.append((fp, langs[row], size, grams.spelled(int(start[i]), size)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 4, _PHRASE_TYPES, strict=True)],
                ["fp", "lang", "size", "phrase"],
            )

    return pointed.mapInArrow(rows, "fp long, lang string, size int, phrase string")


def _told_apart(texts: DataFrame, mixed: DataFrame, sizes: range, bits: int) -> DataFrame:
    """lang, size, phrase and a of all phrases with one of the mixed fingerprints, counted by their text."""
    known = members(mixed.select("fp"))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grams, batch in stretches(batches):
            langs, out = batch.column("lang").to_pylist(), {}
            for size in sizes:
                start = grams.starts(size)
                found = grams.fingerprints(start, size, bits)
                for i in np.flatnonzero(known.value.has(found)).tolist():
                    row = (int(found[i].view(np.int64)), langs[int(grams.owner[start[i]])], size, grams.spelled(int(start[i]), size))
                    out[row] = out.get(row, 0) + 1
            columns = [list(c) for c in zip(*(row + (n,) for row, n in out.items()), strict=True)] or [[]] * 5
            types = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["fp", "lang", "size", "phrase", "n"]
            )

    occurrences = texts.mapInArrow(rows, "fp long, lang string, size int, phrase string, n long")
    return (
        occurrences.groupBy("fp", "lang", "size", "phrase").agg(F.sum("n").alias("a"))
        .join(mixed.select("fp"), "fp", "left_semi").select("lang", "size", "phrase", "a")
    )


def frequent_phrases(
    documents: DataFrame, least: int = LEAST_COUNT, longest: int = LONGEST, bits: int = 64
) -> DataFrame:
    """lang, size (words), phrase and a (occurrences) of all phrases of up to longest words found least times or more in a language.

    Each language that has least words or more also has a row of size 0, the empty phrase with the number of its words.
    Nulls in text have no words, in lang are `und`. Repeated rows count each time. bits is the width of fingerprints; fewer
    bits mean more phrases to tell apart by text, and the same rows.
    """
    lang = F.coalesce("lang", F.lit(UNKNOWN))
    # A pointer names few documents rather than one; the phrase is found in one of them by its fingerprint.
    key = F.shiftright(F.xxhash64(F.col("doc_id").cast("string"), lang, "text"), 32).cast("int")
    texts = documents.select(key.alias("key"), lang.alias("lang"), F.xxhash64(lang).alias("lang_key"), "text")
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Words alone, then pairs of frequent words, then all that consists of frequent pairs.
    known, known_size, frequent = None, 0, None
    for sizes in ((0, 1), (2,), tuple(range(3, longest + 1))):
        if sizes and sizes[0] <= longest:
            found = settled(counted(texts, sizes, known, known_size, bits, least, 1 + len(sizes) * size // BUCKET_BYTES), "phrase-counts")
            known, known_size = members(found.select("fp")), sizes[-1]
            frequent = found if frequent is None else frequent.unionByName(found)
    mixed = F.col("low") != F.col("high")
    plain = frequent.where(~mixed)

    # One copy of each document that an occurrence points to, with the fingerprints wanted from it.
    wanted = settled(plain.groupBy("key").agg(F.collect_list("fp").alias("fps")), "phrase-places")
    pointed = members(wanted.select(F.xxhash64("key").alias("place")))

    def pointed_to(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            batch = batch.filter(pa.array(pointed.value.has(_longs(batch.column("place")))))
            packed = [packer.compress((x or "").encode()) for x in batch.column("text").to_pylist()]
            columns = [*(batch.column(c) for c in ("key", "place", "lang", "lang_key")), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "place", "lang", "lang_key", "packed"])

    places = texts.select("key", F.xxhash64("key").alias("place"), "lang", "lang_key", "text")
    copies = places.mapInArrow(pointed_to, "key int, place long, lang string, lang_key long, packed binary")
    copies = copies.groupBy("key", F.xxhash64("lang", "packed").alias("copy")).agg(*(F.first(c).alias(c) for c in ("lang", "lang_key", "packed")))
    sizes = range(longest + 1)
    spelled = _spelled(copies.join(wanted, "key"), sizes, bits).dropDuplicates(["fp"])
    phrases = spelled.join(plain.select("fp", F.col("n").alias("a")), "fp").select("lang", "size", "phrase", "a")
    if frequent.where(mixed).limit(1).count():
        apart = _told_apart(texts, frequent.where(mixed), sizes, bits)
        phrases = phrases.unionByName(apart.where(F.col("a") >= least))
    return phrases


def scored(phrases: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score and longer of all phrases of two or more words among the frequent phrases.

    The score is that of the lowest-scoring cut, the first of equal ones. longer is the count of the most frequent phrase of
    one more word around it, null without one.
    """
    counts = phrases.where(F.col("size") > 0).select("lang", "phrase", "a")
    # A language may have most of the phrases, so its number of words stands by in copies.
    copy = F.explode(F.sequence(F.lit(0), F.lit(RANK_PARTS - 1))).alias("copy")
    totals = phrases.where(F.col("size") == 0).select("lang", F.col("a").alias("n"), copy)
    words = F.split("phrase", " ")
    cuts = (
        phrases.where(F.col("size") > 1)
        .select("lang", "phrase", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
        .withColumn("left", F.array_join(F.slice(words, F.lit(1), F.col("k")), " "))
        .withColumn("right", F.array_join(F.slice(words, F.col("k") + 1, F.col("size")), " "))
    )
    # Whatever holds a phrase as often as the phrase occurs, so does a phrase with one word more.
    longer = (
        cuts.where(F.col("k") == 1).select("lang", F.col("right").alias("phrase"), "a")
        .unionByName(cuts.where(F.col("k") == F.col("size") - 1).select("lang", F.col("left").alias("phrase"), "a"))
        .groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    )
    exact = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r")}
    # Products of counts stay below 10**38, as a corpus has fewer than 10**17 words.
    score = (F.lit(1000).cast("decimal(4,0)") * exact["a"]).cast("decimal(20,0)") * F.col("n").cast("decimal(18,0)")
    score = F.call_function("div", score.cast("decimal(38,0)"), (exact["l"] * exact["r"]).cast("decimal(38,0)"))
    best = (
        cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"])
        .join(counts.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"])
        .withColumn("copy", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)).cast("int"))
        .join(totals, ["lang", "copy"])
        .select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r", "n").alias("cut"))
        .groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min("cut").alias("cut"))
    )
    best = best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.n", "cut.score")
    return best.join(longer, ["lang", "phrase"], "left")


def mine_phrases(documents: DataFrame, least: int = LEAST_COUNT, longest: int = LONGEST, top: int = TOP, bits: int = 64) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first top phrases; see `frequent_phrases`, `scored`.

    A phrase that is found inside a longer one each time it occurs is left out. Order: score and a descending, then the phrase's
    bytes. A table without texts, or without frequent phrases, gives no rows. Other columns are not read.
    """
    phrases = settled(frequent_phrases(documents, least, longest, bits), "phrases")
    kept = scored(phrases).where(F.col("longer").isNull() | (F.col("longer") < F.col("a"))).drop("longer")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    first = kept.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order)))
    first = first.where(F.col("_rank") <= top).drop("_rank")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return first.withColumn("rank", rank).where(F.col("rank") <= top).select(*columns)
