"""Quality rules: document statistics, judged by gradient-boosted trees.

Each text gives a row of statistics (words, symbols, repeated lines and windows, shapes of words). Trees fitted to a
bounded sample of labelled documents score the rows inside the same scan; the features that only ever speak against
a document are constrained to be monotonic.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probefleet.llm import text as T
from probefleet.llm import trees

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Most labelled documents that the trees are fitted to, chosen by a hash of the doc_id.
SAMPLE_ROWS = 20_000
#: A document goes if the trees give it at least this probability of low quality.
REJECT_FROM = 0.5

BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words",
    "word_length",
    "symbol_share",
    "dup_line_share",
    "repeat_share",
    "upper_share",
    "digit_share",
    "punctuation_share",
    "lone_symbol_words",
    "distinct_share",
)
#: Features that may only raise the probability of low quality (+1) or only lower it (-1).
MONOTONIC = {"symbol_share": 1, "dup_line_share": 1, "repeat_share": 1, "lone_symbol_words": 1, "distinct_share": -1}

_SYMBOL = T.byte_class(b"#*$%&|<>")
_UPPER = T.byte_class(bytes(range(0x41, 0x5B)))
_DIGIT = T.byte_class(bytes(range(0x30, 0x3A)))
_PUNCTUATION = T.byte_class(b".,;:!?'\"()-")
_WORDY = T.byte_class(bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))
_STARTS_CHAR = ~T.byte_class(bytes(range(0x80, 0xC0)))


def _repeats(w: T.Words, ids: np.ndarray) -> np.ndarray:
    """For each word, whether it lies in a window of WINDOW words that its text has twice or more."""
    size = len(w) - WINDOW + 1
    if size <= 0:
        return np.zeros(len(w), bool)
    owner = w.owner
    at = np.flatnonzero(owner[:size] == owner[WINDOW - 1 :])
    key = T.gram_hashes(np.concatenate([ids, owner.astype(np.uint64)]), 1)
    hashes = T.gram_hashes(key[: len(w)], WINDOW)[at] ^ key[len(w) :][at]
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    start = at[again]
    return T.covered(len(w), start, start + WINDOW)


def _duplicate_lines(column: pa.Array) -> np.ndarray:
    """For each text, its lines with a word that equal an earlier line of it."""
    lines = pc.split_pattern(column.cast(pa.large_string()).fill_null(""), "\n")
    owner = pc.list_parent_indices(lines).to_numpy()
    flat = pc.list_flatten(lines)
    t = T.texts(flat)
    filled = t.sums(T.NOT_SPACE[t.data]) > 0
    flat, owner = flat.filter(pa.array(filled)), owner[filled]
    if not len(flat):
        return np.zeros(len(column), np.int64)
    line = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pairs = np.unique(owner.astype(np.int64) * (int(line.max()) + 1) + line)
    return np.bincount(owner, minlength=len(column)) - np.bincount(pairs // (int(line.max()) + 1), minlength=len(column))


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """BASE_COLUMNS and FEATURES of each text of a slice."""
    t = T.texts(column)
    w = T.words(t)
    n = len(t)
    ids = T.word_hashes(t.data, w.start, w.end)
    starts = _STARTS_CHAR[t.data]
    n_words = w.counts.astype(np.int64)
    word_chars = t.sums(starts & T.NOT_SPACE[t.data])
    n_symbols = t.sums(_SYMBOL[t.data])
    repeated = np.add.reduceat(np.append(_repeats(w, ids), False), w.first[:-1], dtype=np.int64) * (n_words > 0) if n else n_words
    wordy = np.concatenate([[0], np.cumsum(_WORDY[t.data])])
    lone = np.bincount(w.owner[wordy[w.end] == wordy[w.start]], minlength=n)
    owner = w.owner.astype(np.uint64)
    distinct_keys = np.unique(T.mix64(owner) ^ ids, return_index=True)[1]
    distinct = np.bincount(w.owner[distinct_keys], minlength=n)
    duplicates = _duplicate_lines(column)
    n_lines = t.sums(t.data == 0x0A) + 1
    some_words, some_chars = np.maximum(n_words, 1), np.maximum(word_chars, 1)
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": n_symbols,
        "n_dup_lines": duplicates,
        "n_repeat_words": repeated,
        "log_words": np.log1p(n_words),
        "word_length": word_chars / some_words,
        "symbol_share": n_symbols / some_chars,
        "dup_line_share": duplicates / n_lines,
        "repeat_share": repeated / some_words,
        "upper_share": t.sums(_UPPER[t.data]) / some_chars,
        "digit_share": t.sums(_DIGIT[t.data]) / some_chars,
        "punctuation_share": t.sums(_PUNCTUATION[t.data]) / some_chars,
        "lone_symbol_words": lone / some_words,
        # Longer texts repeat words by nature: compare with the square root of the length.
        "distinct_share": distinct / np.sqrt(some_words),
    }


def features_of(values: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([values[name].astype(np.float64) for name in FEATURES], axis=1)


def base_failed(values: dict[str, np.ndarray]) -> np.ndarray:
    return (values["n_words"] < MIN_WORDS) | (
        100 * values["n_repeat_words"] > MAX_REPEAT_PERCENT * values["n_words"]
    )


def fit_rules(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> trees.Trees | None:
    """Trees for P(quality = 0), from at most sample_rows labelled documents; None unless both labels occur.

    Rows without doc_id or quality are ignored, of rows with one doc_id one counts; a doc_id labelled more than once counts as its lowest quality.
    The sample is sent to all tasks: it has at most sample_rows rows of two numbers.
    """
    sample = (
        labels.select("doc_id", "quality")
        .where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.text_slices(batches, "text"):
            x = features_of(statistics(batch.column("text")))
            values = pa.array(x.ravel()) if len(x) else pa.array([], pa.float64())
            lists = pa.FixedSizeListArray.from_arrays(values, len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality"), lists], ["doc_id", "quality", "x"]
            )

    found = (
        documents.select("doc_id", "text")
        .join(F.broadcast(sample), "doc_id")
        .select("doc_id", "text", F.col("quality").cast("int").alias("quality"))
        .mapInArrow(rows, "doc_id long, quality int, x array<double>")
        # A doc_id may stand in any number of rows; one of them, the same in every run, goes to the driver.
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.min("x").alias("x"))
        .toPandas()
        .sort_values("doc_id", kind="stable")
    )
    bad = (found["quality"] == 0).to_numpy()
    if not bad.any() or bad.all():
        return None
    x = np.array(found["x"].tolist())
    order = np.lexsort((*x.T, found["doc_id"].to_numpy()))
    return trees.fit(x[order], bad[order].astype(float), {FEATURES.index(k): v for k, v in MONOTONIC.items()})


def quality_rules(
    documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, reject_from: float = REJECT_FROM
) -> DataFrame:
    """doc_id, BASE_COLUMNS, base_failed, kept and bad_probability (null without a model) of every document.

    A null or empty text has no words and fails the base rules. Every row is judged by itself, so equal rows get equal
    verdicts; a null doc_id stays null. Other columns of documents are not read. Without usable labels only the base
    rules decide.
    """
    model = fit_rules(documents, labels, sample_rows)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.text_slices(batches, "text"):
            values = statistics(batch.column("text"))
            failed = base_failed(values)
            score = model.score(features_of(values)) if model else None
            kept = ~failed if score is None else ~failed & (score < reject_from)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(pa.array(values[name].astype(np.int64)) for name in BASE_COLUMNS),
                    pa.array(failed),
                    pa.array(kept),
                    pa.nulls(len(failed), pa.float64()) if score is None else pa.array(score),
                ],
                ["doc_id", *BASE_COLUMNS, "base_failed", "kept", "bad_probability"],
            )

    longs = ", ".join(f"{name} long" for name in BASE_COLUMNS)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        rows, f"doc_id long, {longs}, base_failed boolean, kept boolean, bad_probability double"
    )
