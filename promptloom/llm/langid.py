"""Language by blended-spectrum string kernels: n-gram presence, Nystroem landmarks, one-versus-rest ridge."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptloom.llm.common import slices, text_only

UNDETERMINED = "und"
_LETTER = np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x10000)])


def _is_letter(codes: np.ndarray) -> np.ndarray:
    out = _LETTER[np.minimum(codes, 0xFFFF)]
    high = codes > 0xFFFF
    if high.any():
        out[high] = [unicodedata.category(chr(c))[0] == "L" for c in codes[high].tolist()]
    return out


def presence(text: str, longest: int, buckets: int) -> np.ndarray | None:
    """Which of the hashed n-grams (1 to `longest` characters, lower-cased, runs of other signs as one space) occur in
    the whole text; none without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _is_letter(codes)
    if not letter.any():
        return None
    codes = np.where(letter, codes, 32)
    codes = codes[letter | np.concatenate(([True], letter[:-1]))].astype(np.uint64)
    if codes[0] != 32:
        codes = np.concatenate((np.array([32], np.uint64), codes))
    found = np.zeros(buckets, np.uint8)
    grams = np.zeros(len(codes), np.uint64)
    for n in range(1, longest + 1):
        grams = grams[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :]
        if not len(grams):
            break
        mixed = (grams + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        found[mixed >> np.uint64(64 - (buckets.bit_length() - 1))] = 1
    return found


def kernel(rows: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Common n-grams over the root of both counts, as one matrix product."""
    rows, landmarks = rows.astype(np.float32), landmarks.astype(np.float32)
    return (rows @ landmarks.T) / np.sqrt(rows.sum(axis=1))[:, None] / np.sqrt(landmarks.sum(axis=1))


class Classifier:
    """Ridge regression in the space that the landmarks span. `weights` holds the Nystroem map and the regression in
    one matrix, so a score is one product with the kernel row."""

    def __init__(self, packed: np.ndarray, langs: list[str], landmarks: int, ridge: float, longest: int, at_once: int = 512):
        """packed: the presence bits of each row, eight to a byte; only `at_once` rows are unpacked at a time."""
        self.names = sorted(set(langs))
        self.longest, self.buckets = longest, packed.shape[1] * 8
        labels = np.array([self.names.index(x) for x in langs])
        # landmarks: from each language in turn, in the sample's order
        turn = np.empty(len(labels), np.int64)
        for c in range(len(self.names)):
            own = np.flatnonzero(labels == c)
            turn[own] = np.arange(len(own))
        self.landmarks = np.unpackbits(packed[np.lexsort((labels, turn))[:landmarks]], axis=1)
        inner = kernel(self.landmarks, self.landmarks).astype(np.float64)
        values, vectors = np.linalg.eigh((inner + inner.T) / 2)
        good = values > 1e-6 * values[-1]
        root = vectors[:, good] / np.sqrt(values[good])
        near = np.concatenate([kernel(np.unpackbits(packed[at : at + at_once], axis=1), self.landmarks) for at in range(0, len(packed), at_once)])
        features = np.concatenate((near @ root, np.ones((len(packed), 1))), axis=1)
        targets = np.where(labels[:, None] == np.arange(len(self.names)), 1.0, -1.0)
        weight = (1 / np.bincount(labels, minlength=len(self.names)))[labels][:, None]  # languages count alike
        penalty = ridge * np.eye(features.shape[1]) * weight.sum() / len(self.names)
        penalty[-1, -1] = 1e-9
        solved = np.linalg.solve(features.T @ (weight * features) + penalty, features.T @ (weight * targets))
        self.weights, self.offset = root @ solved[:-1], solved[-1]

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return kernel(rows, self.landmarks) @ self.weights + self.offset


def _presences(longest: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [presence(t or "", longest, buckets) for t in batch.column(1).to_pylist()]
            packed = [None if r is None else np.packbits(r).tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["lang", "grams"])

    return run


def fit(
    documents: DataFrame,
    per_language: int = 256,
    languages: int = 128,
    landmarks: int = 128,
    longest: int = 3,
    buckets: int = 1 << 14,
    ridge: float = 1e-3,
) -> Classifier | None:
    """Learns from text and lang of rows whose crc32(doc_id as text) mod 5 is not 0: for each of the `languages` most
    frequent values the `per_language` rows with the smallest hashes of the id. That bounds the sample and the model.
    Rows with a null id, lang or text, or without a letter, teach nothing; without any row there is no model."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text"))
    rows = rows.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    common = rows.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(languages).select("lang")
    # an id on several rows: each text counts once, and the bound is one of rows
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    key = ["doc_id", "lang", "text_hash"]
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text_hash"))
    chosen = rows.select(*key).join(F.broadcast(common), "lang").withColumn("nth", first).where(F.col("nth") <= per_language)
    chosen = F.broadcast(chosen.select(*key).distinct())  # per_language * languages at most
    grams = rows.join(chosen, key).groupBy(*key).agg(F.first("text").alias("text"))
    # order by id, so that the model is the same in every run
    taught = grams.select("lang", "text").mapInArrow(_presences(longest, buckets), "lang string, grams binary").where("grams IS NOT NULL")
    taught = sorted((r["lang"], bytes(r["grams"])) for r in taught.collect())
    if not taught:
        return None
    packed = np.frombuffer(b"".join(g for _, g in taught), np.uint8).reshape(len(taught), -1)
    return Classifier(packed, [lang for lang, _ in taught], landmarks, ridge, longest)


def _predict(shared, rows_at_once: int = 256):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, "text"):
            for at in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(at, rows_at_once)
                names, best = [UNDETERMINED] * part.num_rows, np.zeros(part.num_rows)
                if model is not None:
                    rows = [presence(t or "", model.longest, model.buckets) for t in part.column(1).to_pylist()]
                    known = [i for i, r in enumerate(rows) if r is not None]
                    if known:
                        scores = model.scores(np.stack([rows[i] for i in known]))
                        odds = np.exp(4 * (scores - scores.max(axis=1, keepdims=True)))
                        odds /= odds.sum(axis=1, keepdims=True)
                        for i, c, o in zip(known, scores.argmax(axis=1), odds.max(axis=1), strict=True):
                            names[i], best[i] = model.names[c], o
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names), pa.array(best)], ["doc_id", "lang_pred", "score"])

    return run


def identify(documents: DataFrame, model: Classifier | None) -> DataFrame:
    """doc_id, lang_pred, score per row of `documents`, out of its whole text alone.

    Scores are the one-versus-rest values through a softmax, so between 0 and 1; ties go to the first name. A null or
    letterless text, and any text where nothing was learned, is "und" with score 0. The model (landmarks and weights) is
    broadcast: its size is set by the fit's parameters. Null ids and repeated rows are answered row by row.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return text_only(documents, "doc_id", "text").mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double")
