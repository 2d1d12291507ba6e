"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.llm.common import byte_texts, packed_rows, settled, slices, text_only

#: ASCII signs other than letters and digits part words; other letters belong to them.
_PARTS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
PREFIXES, SHARED = (4, 6), 3
BLOCK = 64


def features(text: bytes) -> Counter:
    """Counts of lower-cased words, and one for each beginning that 1, 2, 3 distinct longer words or more share
    (first bytes behind as many NULs): cosine forgets how often, so how many is a term of its own."""
    words = Counter(text.decode("utf-8", "replace").lower().encode().translate(_PARTS).split())
    shared = Counter(w[:n] for n in PREFIXES for w in words if len(w) > n)
    words.update(b"\0" * n + p for p, c in shared.items() for n in range(1, min(c, SHARED) + 1))
    return words


def _by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per feature and class, summed per task; empty feature: all documents."""
    tally: dict[bytes, list[int]] = {}

    def out():
        rows = [(f, *c) for f, c in tally.items()]
        tally.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())],
            ["feature", "clean", "toxic"],
        )

    for batch in slices(batches, "text"):
        for label, text in zip(batch.column(1).to_pylist(), byte_texts(batch), strict=True):
            for f in (b"", *features(text)):
                tally.setdefault(f, [0, 0])[label] += 1
        if len(tally) > 300_000:
            yield out()
    yield out()


def _vectors(vocabulary: dict[bytes, int]):
    """A row per labelled document with its features, and one per task with the documents that hold each feature."""
    known = frozenset(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(vocabulary) + 1, np.int64)  # the last counts all documents

        def rows(ids, labels, places, counts):
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(labels, pa.int32()), pa.array(places, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
                ["doc_id", "label", "places", "counts"],
            )

        for batch in slices(batches, "text"):
            ids, labels, places, counts = [], [], [], []
            for doc, label, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), byte_texts(batch), strict=True):
                place, count = sparse(text, vocabulary, known)
                held[place] += 1
                held[-1] += 1
                if label is not None:
                    ids.append(doc), labels.append(label), places.append(place), counts.append(count)
            if ids:
                yield rows(ids, labels, places, counts)
        seen = np.flatnonzero(held)
        yield rows([None], [None], [seen.tolist()], [held[seen].tolist()])

    return run


def sparse(text: bytes, vocabulary: dict[bytes, int], known: frozenset) -> tuple[list[int], list[int]]:
    """Places and counts of a text's features that the vocabulary has."""
    words = text.decode("utf-8", "replace").lower().encode().translate(_PARTS).split()
    distinct = set(words)
    found = {w: words.count(w) for w in distinct & known}
    shared = Counter([w[:n] for n in PREFIXES for w in distinct if len(w) > n])
    for n in range(1, SHARED + 1):
        found.update({f: 1 for p, c in shared.items() if c >= n and (f := b"\0" * n + p) in known})
    pairs = sorted((vocabulary[f], c) for f, c in found.items())
    return [p for p, _ in pairs], [c for _, c in pairs]


class Index:
    """Labelled unit vectors in blocks of 64, with each term's largest weight per block. Neighbours are exact: blocks
    are read in the order of their bounds until no bound reaches the k-th best."""

    def __init__(self, vocabulary: dict[bytes, int], idf: np.ndarray, ids, labels, places, counts, k: int):
        self.vocabulary, self.known, self.idf, self.k = vocabulary, frozenset(vocabulary), idf, k
        self.memory: dict = {}  # of this index only: a worker outlives a job and scores by several
        self.prior = (sum(labels) + 0.5) / (len(labels) + 1)
        vectors = [self.weights(p, c) for p, c in zip(places, counts, strict=True)]
        plain = [y for y, (p, _) in zip(labels, vectors, strict=True) if not len(p)]
        self.plain = (sum(plain) + self.prior) / (len(plain) + 1)
        # vectors with the same strongest term stand together: bounds are tight
        order = sorted((i for i, (p, _) in enumerate(vectors) if len(p)), key=lambda i: (int(vectors[i][0][np.argmax(vectors[i][1])]), ids[i]))
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.labels = np.array([labels[i] for i in order], np.float64)
        self.blocks = []
        self.bounds = np.zeros((len(vocabulary), -(-len(order) // BLOCK)))
        for b in range(0, len(order), BLOCK):
            part = [vectors[i] for i in order[b : b + BLOCK]]
            terms, weights = np.concatenate([p for p, _ in part]), np.concatenate([w for _, w in part])
            starts = np.cumsum([0] + [len(p) for p, _ in part[:-1]])
            self.blocks.append((terms, weights, starts))
            np.maximum.at(self.bounds[:, b // BLOCK], terms, weights)

    def weights(self, places, counts) -> tuple[np.ndarray, np.ndarray]:
        places = np.asarray(places, np.int64)
        weights = (1 + np.log(np.asarray(counts, np.float64))) * self.idf[places]
        norm = math.sqrt(float(weights @ weights))
        return (places, weights / norm) if norm else (places[:0], weights[:0])

    def nearest(self, places: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the k nearest with a cosine above zero, nearest first, ties to the smaller id."""
        bound = weights @ self.bounds[places]
        query = np.zeros(len(self.idf))
        query[places] = weights
        rows, cosines = np.zeros(0, np.int64), np.zeros(0)
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or len(rows) == self.k and bound[b] < cosines[-1] - 1e-12:
                break
            terms, values, starts = self.blocks[b]
            scores = np.add.reduceat(values * query[terms], starts)
            hit = np.flatnonzero(scores > 0)
            rows, cosines = np.append(rows, hit + b * BLOCK), np.append(cosines, scores[hit])
            best = np.lexsort((self.ids[rows], -np.round(cosines, 12)))[: self.k]
            rows, cosines = rows[best], cosines[best]
        return rows, cosines

    def score(self, text: bytes) -> tuple[float, list[int], list[float]]:
        """Score, ids and cosines of the labelled documents that it rests on."""
        places, weights = self.weights(*sparse(text, self.vocabulary, self.known))
        if not len(places):
            return self.plain, [], []
        key = (places.tobytes(), weights.tobytes())
        if (known := self.memory.get(key)) is not None:
            return known
        rows, cosines = self.nearest(places, weights)
        votes = cosines**2
        vote = float(votes @ self.labels[rows] + self.prior) / float(votes.sum() + 1)
        if len(self.memory) > 50_000:
            self.memory.clear()
        self.memory[key] = out = (min(1.0, max(0.0, vote)), self.ids[rows].tolist(), cosines.tolist())
        return out

    def __getstate__(self) -> dict:
        return {**self.__dict__, "memory": {}}


def training_rows(labels: DataFrame, label: str, sample_rows: int) -> DataFrame:
    """(doc_id, label) to learn from: crc32 of the id as text mod 5 not 0, the `sample_rows` with the smallest
    hashes. Several labels of one id: the largest counts. Null ids and labels are left out."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    rows = rows.where("doc_id IS NOT NULL AND label IN (0, 1)").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    return rows.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)


def fit(
    documents: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    sample_rows: int = 50_000,
    vocabulary_size: int = 4096,
    lift: float = 3.0,
    least: float = 30.0,
    k: int = 15,
) -> Index:
    """The index of at most `sample_rows` labelled documents.

    Its terms are the at most `vocabulary_size` words and word beginnings whose documents' share of the label is
    `lift` times above or below the others', with a chi-square of `least` or more (a third of the labelled rows, the
    largest value that it can have, where those are so few that this is less). Inverse document frequencies are
    those of all `documents`. The index is bounded by sample_rows and vocabulary_size, and is what is broadcast.
    Without any labelled document all scores are the prior, 0.5.
    """
    sample = F.broadcast(training_rows(labels, label, sample_rows))
    narrow = text_only(documents, "doc_id", "text")
    learn = narrow.join(sample, "doc_id").select("doc_id", "label", "text")
    counts = learn.mapInArrow(_by_class, "feature binary, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    counts = settled(counts.where("c + t >= 3"))
    whole = counts.where(F.length("feature") == 0).first()
    clean, toxic = (whole["c"], whole["t"]) if whole else (0, 0)
    n, c, t = float(clean + toxic), F.col("c"), F.col("t")
    chi = n * F.pow(t * (clean - c) - c * (toxic - t), 2) / F.nullif((t + c) * (n - t - c) * float(toxic * clean), F.lit(0.0))
    rate_t, rate_c = (t + 0.5) / (toxic + 1.0), (c + 0.5) / (clean + 1.0)
    chosen = (
        counts.where(F.length("feature") > 0)
        .withColumn("chi", chi)
        .where((F.col("chi") >= min(least, n / 3)) & (F.greatest(rate_t / rate_c, rate_c / rate_t) >= lift))
        .orderBy(F.col("chi").desc(), "feature")
        .limit(vocabulary_size)
    )
    vocabulary = {bytes(r["feature"]): i for i, r in enumerate(chosen.select("feature").collect())}
    rows = narrow.join(sample, "doc_id", "left").select("doc_id", "text", "label")
    rows = settled(rows.mapInArrow(_vectors(vocabulary), "doc_id long, label int, places array<int>, counts array<long>"))
    held = (
        rows.where("label IS NULL")
        .select(F.explode(F.arrays_zip("places", "counts")).alias("x"))
        .groupBy("x.places")
        .agg(F.sum("x.counts").alias("n"))
        .collect()
    )
    frequency = np.zeros(len(vocabulary) + 1)
    for r in held:
        frequency[r[0]] = r["n"]
    idf = np.log((1 + frequency[-1]) / (1 + frequency[:-1])) + 1
    # an id on several rows is one example: `sample_rows` bounds what comes to the driver, however often ids repeat
    known = rows.where("label IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("label", "places", "counts")).alias("x"))
    known = known.select("doc_id", "x.*").orderBy("doc_id").collect()
    return Index(vocabulary, idf, *([r[i] for r in known] for i in range(4)), k) if known else Index(vocabulary, idf, [0, 0], [0, 1], [[], []], [[], []], k)


def score(documents: DataFrame, index: Index, text: str = "text") -> DataFrame:
    """`documents` with the column `toxicity`: score, predicted (1 from 0.5 on), neighbours and cosines.

    Votes of the nearest labelled documents weigh as the square of their cosine, and one vote of the prior is added, so
    little evidence stays near the prior. A text without any term, empty or null ones included, gets the share among
    labelled documents without one. Whole texts are read; no row moves. Null ids and repeated rows are scored like others;
    a column called `toxicity` is replaced, other columns stay as they are. An empty table gives no rows.
    """
    shared = documents.sparkSession.sparkContext.broadcast(index)

    def run(texts: pd.Series) -> pd.DataFrame:
        found = [shared.value.score((t or "").encode()) for t in texts]
        return pd.DataFrame({"score": [f[0] for f in found], "predicted": [int(f[0] >= 0.5) for f in found], "neighbours": [f[1] for f in found], "cosines": [f[2] for f in found]})

    run.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    udf = F.pandas_udf(run, "score double, predicted int, neighbours array<long>, cosines array<double>")
    return documents.withColumn("toxicity", udf(F.col(text)))


def drop_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """`documents` without those that labelled examples show to be toxic; columns and all other rows stay.

    A document goes if it is predicted toxic and shares a term with a labelled one. Where no example speaks about it -
    no labels, none that tell toxic from clean apart, a text without any of their terms - its score is a prior and no
    evidence, and it stays.
    """
    verdict = score(packed_rows(documents), fit(documents, labels), "row.text")
    return verdict.where((F.col("toxicity.predicted") == 0) | (F.size("toxicity.neighbours") == 0)).select("row.*")
