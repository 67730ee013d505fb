"""Language identification: each document as a mixture of languages.

Training counts hashed character n-grams for each language over all training documents. A document's n-gram counts
then give its language proportions by expectation-maximisation; the set of languages is the one with the best
penalised likelihood (half the logarithm of the n-grams for each language beyond the first, as in the Bayesian
information criterion).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probefleet.llm import text as T

#: Hash buckets of n-grams. A model has languages x BUCKETS numbers, whatever the size of the corpus.
BUCKETS = 4096
SMOOTHING = 0.5
ROUNDS = 12
#: The model is collected and sent to the tasks; more languages than this are an error, not a truncation.
MAX_LANGUAGES = 512
#: Texts of a block are worked on together, as rows of BUCKETS counts.
BLOCK_ROWS = 512

_LETTER = T.byte_class(bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_LOWER[~_LETTER] = 0x20


def held_out(doc_id: Column) -> Column:
    """Documents that training must not see: crc32 of the doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def gram_counts(t: T.Texts) -> Iterator[tuple[int, np.ndarray]]:
    """(first text, counts as float32 [texts, BUCKETS]) of blocks of texts.

    Grams are two and three bytes long, ASCII letters lower-cased, other ASCII as one blank; grams within blanks do
    not count. A text of a single byte stands between blanks, as it has no grams else.
    """
    single = np.diff(t.offsets) == 1
    if single.any():
        alone = t.offsets[:-1][single]
        data = np.insert(t.data, np.concatenate([alone, alone + 1]), 0x20)
        t = T.Texts(data, t.offsets + np.concatenate([[0], np.cumsum(2 * single)]))
    low = _LOWER[t.data]
    owner = np.repeat(np.arange(len(t)), np.diff(t.offsets))
    a = low.astype(np.uint32)
    for first in range(0, len(t), BLOCK_ROWS):
        last = min(first + BLOCK_ROWS, len(t))
        lo, hi = t.offsets[first], t.offsets[last]
        b, o = a[lo:hi], owner[lo:hi] - first
        counts = np.zeros((last - first) * BUCKETS, np.float32)
        for n in (2, 3):
            if len(b) < n:
                continue
            size = len(b) - n + 1
            gram = np.full(size, n, np.uint32)
            for k in range(n):
                gram = (gram << np.uint32(8)) | b[k : k + size]
            ok = (o[:size] == o[n - 1 :]) & ((b[:size] != 0x20) | (b[1 : 1 + size] != 0x20))
            bucket = ((gram * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
            counts += np.bincount(o[:size][ok] * BUCKETS + bucket[ok], minlength=len(counts)).astype(np.float32)
        yield first, counts.reshape(-1, BUCKETS)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    #: P(gram | language) [languages, BUCKETS]
    p: np.ndarray
    #: Share of the training grams of each language.
    prior: np.ndarray


def fit_model(training: DataFrame) -> Model | None:
    """Gram counts by language over all rows of training (text, lang) with both; None if there are none."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in T.text_slices(batches, "text"):
            lang = np.array(batch.column("lang").to_pylist(), dtype=object)
            for first, counts in gram_counts(T.texts(batch.column("text"))):
                here = lang[first : first + len(counts)]
                for name in set(here):
                    total = sums.setdefault(name, np.zeros(BUCKETS))
                    total += counts[here == name].sum(axis=0, dtype=np.float64)
            if len(sums) > MAX_LANGUAGES:
                raise ValueError(f"more than {MAX_LANGUAGES} languages in the training data")
        for name, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * BUCKETS), pa.array(np.arange(BUCKETS)), pa.array(total.astype(np.int64))],
                ["lang", "bucket", "n"],
            )

    counted = (
        training.select("text", "lang")
        .where("text is not null and lang is not null")
        .mapInArrow(rows, "lang string, bucket long, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("counts"))  # BUCKETS entries
        .limit(MAX_LANGUAGES + 1)
        .collect()
    )
    if len(counted) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages in the training data")
    counted = sorted((r for r in counted if any(c["n"] for c in r["counts"])), key=lambda r: r["lang"])
    if not counted:
        return None
    n = np.array([[c["n"] for c in r["counts"]] for r in counted], dtype=np.float64)
    p = (n + SMOOTHING) / (n + SMOOTHING).sum(axis=1, keepdims=True)
    return Model(tuple(r["lang"] for r in counted), p.astype(np.float32), n.sum(axis=1) / n.sum())


def _em(counts: np.ndarray, p: np.ndarray, allowed: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions among the allowed languages of each row, and their log-likelihood."""
    total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    share = np.where(allowed, start, 0).astype(np.float32)
    share /= share.sum(axis=1, keepdims=True)
    for _ in range(ROUNDS):
        mixed = share @ p
        share = share * ((counts / mixed) @ p.T) / total
        share /= share.sum(axis=1, keepdims=True)
    return share, np.einsum("ij,ij->i", counts, np.log(share @ p), dtype=np.float64)


def proportions(counts: np.ndarray, model: Model) -> np.ndarray:
    """Language proportions of each row of counts; zero outside the chosen set of languages.

    Languages join in the order of their proportions in the full mixture while that improves the penalised likelihood.
    """
    rows, languages = len(counts), len(model.languages)
    everything = np.ones((rows, languages), bool)
    full, _ = _em(counts, model.p, everything, np.broadcast_to(model.prior + 1e-3, (rows, languages)))
    # Ties by the order of the languages.
    rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1, kind="stable")
    penalty = np.log(np.maximum(counts.sum(axis=1), 2)) / 2
    best_share, best = None, None
    open_rows = np.arange(rows)
    for size in range(1, languages + 1):
        share, fit = _em(counts[open_rows], model.p, rank[open_rows] < size, full[open_rows] + 1e-6)
        fit = fit - penalty[open_rows] * (size - 1)
        if best is None:
            best_share, best = share, fit
            continue
        better = fit > best[open_rows]
        open_rows, share, fit = open_rows[better], share[better], fit[better]
        best_share[open_rows], best[open_rows] = share, fit
        if not len(open_rows):
            break
    return best_share


def _has_letter(column: pa.Array, t: T.Texts) -> np.ndarray:
    ascii_letters = t.sums(_LETTER[t.data] & (t.data < 0x80)) > 0
    for i in np.flatnonzero(~ascii_letters):
        ascii_letters[i] = any(map(str.isalpha, column[int(i)].as_py() or ""))
    return ascii_letters


def identify(documents: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score (proportion of lang_pred) and languages (set chosen, by proportion) of every document.

    `und` with score 0 for a null text, a text without a letter, or without a model. Whole texts are read; no other
    column is. Equal texts get equal rows.
    """

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.text_slices(batches, "text"):
            column = batch.column("text")
            t = T.texts(column)
            known = _has_letter(column, t) if model else np.zeros(len(t), bool)
            pred, score, chosen = ["und"] * len(t), np.zeros(len(t)), [[] for _ in range(len(t))]
            if model:
                for first, counts in gram_counts(t):
                    share = proportions(counts, model)
                    order = np.argsort(-share, axis=1, kind="stable")
                    for i in np.flatnonzero(known[first : first + len(counts)]):
                        names = [model.languages[k] for k in order[i] if share[i, k] > 0]
                        pred[first + i], score[first + i], chosen[first + i] = names[0], share[i, order[i, 0]], names
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(pred, pa.string()),
                    pa.array(np.clip(score, 0, 1)),
                    pa.array(chosen, pa.list_(pa.string())),
                ],
                ["doc_id", "held_out", "lang_pred", "score", "languages"],
            )

    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text"
    ).mapInArrow(rows, "doc_id long, held_out boolean, lang_pred string, score double, languages array<string>")


def language_id(documents: DataFrame) -> DataFrame:
    """Every document's language by a model of those that are not held out."""
    return identify(documents, fit_model(documents.where(~held_out(F.col("doc_id")))))
