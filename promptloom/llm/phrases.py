"""Substring de-duplication: recurring phrases, Aho-Corasick automata per shard of documents, windows in order."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.llm.common import SPACE, byte_texts, partitions, run_starts, settled, slices, text_only, written

WINDOW, PHRASE = 20, 8
_IS_SPACE = np.isin(np.arange(256), np.frombuffer(SPACE, np.uint8))
LATER, FIRST, LAST = 1, 0, 2


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of all runs of a sequence out of one prefix sum: sum of a value times base^position, mod 2^64, brought
    back to position 0 by the inverse of the base."""

    def __init__(self, seed: int):
        self.base = np.uint64(0x9E3779B97F4A7C15 + 2 * seed)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.table = mix(np.arange(256, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed + 1))
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 1 << 21)
            self.up, self.down = (np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, b, np.uint64)))) for b in (self.base, self.inverse))

    def runs(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._powers(len(values) + 1)
        sums = np.concatenate(([np.uint64(0)], np.cumsum(values * self.up[: len(values)])))
        return mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


class Spelling:
    """Phrases of `size` words spelt out in two 64-bit numbers: a word is one letter, as many bits of its hash as fit. So
    a phrase that recurs carries all that an automaton needs of it; phrases spelt alike by chance only give further
    windows to look at. As text, a letter is `width` characters of a byte: a node of the automaton goes through its
    branches in turn, so it must not have one for every word."""

    def __init__(self, size: int):
        self.size = size
        self.bits = next(b for b in (16, 8, 4, 2) if b * size <= 128)
        self.per = 64 // self.bits
        self.width = max(1, self.bits // 8)

    def letters(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.uint32)

    def spell(self, letters: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The phrases that start at the places `at`."""
        halves = np.zeros((2, len(at)), np.uint64)
        for k in range(self.size):
            half = halves[k // self.per]
            half <<= np.uint64(self.bits)
            half |= letters[at + k]
        return halves[0].view(np.int64), halves[1].view(np.int64)

    def text(self, letters: np.ndarray) -> str:
        return letters.astype(f"<u{self.width}").tobytes().decode("latin-1")

    def read(self, first: np.ndarray, second: np.ndarray) -> list[str]:
        """The distinct phrases as text."""
        order = np.lexsort((second, first))
        halves = [half[order].view(np.uint64) for half in (first, second)]
        starts = run_starts(*halves)
        halves = [half[starts] for half in halves]
        out = np.zeros((len(starts), self.size), np.uint32)
        for k in range(self.size):
            last = min(self.size, (k // self.per + 1) * self.per) - 1
            out[:, k] = halves[k // self.per] >> np.uint64((last - k) * self.bits) & np.uint64((1 << self.bits) - 1)
        text, length = self.text(out), self.size * self.width
        return [text[i : i + length] for i in range(0, len(text), length)]


class Words:
    """The words of several texts in one sequence, with each word's text and its place there."""

    def __init__(self, texts: list[bytes], rolling: Rolling):
        joined = np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)
        space = _IS_SPACE[joined]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.starts, self.ends = edges[::2], edges[1::2]
        self.of = np.searchsorted(np.cumsum([1] + [len(t) + 1 for t in texts[:-1]]), self.starts, side="right") - 1
        self.counts = np.bincount(self.of, minlength=len(texts))
        self.place = np.arange(len(self.of)) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts)
        self.hashes = rolling.runs(rolling.table[joined], self.starts, self.ends)

    def windows(self, size: int) -> np.ndarray:
        """Starts of the runs of `size` words inside one text."""
        n = len(self.of) - size + 1
        return np.flatnonzero(self.of[:n] == self.of[size - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def anchors(self, rolling: Rolling, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows, the phrase that each chooses (the one with the smallest hash), and all phrases' hashes. Equal
        windows choose equal phrases at the same place."""
        windows = self.windows(window)
        if not len(windows):
            return windows, windows, np.zeros(0, np.uint64)
        at = np.arange(len(self.of) - phrase + 1)
        hashes = rolling.runs(self.hashes, at, at + phrase)
        views = np.lib.stride_tricks.sliding_window_view(hashes, window - phrase + 1)
        chosen = np.concatenate([views[windows[i : i + 65536]].argmin(axis=1) for i in range(0, len(windows), 65536)])
        return windows, windows + chosen, hashes


def _tags(texts: list[bytes]) -> np.ndarray:
    return np.array([zlib.crc32(t) for t in texts], np.int64) << 31


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


def _anchors(window: int, phrase: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, spelling = Rolling(1), Spelling(phrase)
        for batch in slices(batches, "text"):
            ids, known = _ids(batch.column(0))
            words = Words(byte_texts(batch), rolling)
            at = np.unique(words.anchors(rolling, window, phrase)[1])
            at = at[known[words.of[at]]]
            spelt = spelling.spell(spelling.letters(words.hashes), at)
            yield pa.RecordBatch.from_arrays([*map(pa.array, spelt), pa.array(ids[words.of[at]])], ["p1", "p2", "doc"])

    return run


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition whose phrase the row before or behind has as well: passages confirmed to recur. The
    first and the last row go on as they are, whatever the neighbouring partitions hold."""
    held, alike = None, True

    def rows(table, keep):
        return pa.RecordBatch.from_arrays([pa.array(column[keep]) for column in table], ["p1", "p2", "doc"])

    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(i).to_numpy() for i in range(3)]
        if held is not None:
            now = [np.concatenate((h, n)) for h, n in zip(held, now, strict=True)]
        same = np.concatenate(([alike], (now[0][1:] == now[0][:-1]) & (now[1][1:] == now[1][:-1])))
        keep = same.copy()
        keep[:-1] |= same[1:]
        yield rows(now, np.flatnonzero(keep[:-1]))
        held, alike = [n[-1:] for n in now], bool(same[-1])
    if held is not None:
        yield rows(held, slice(None))


def _candidates(window: int, phrase: int):
    """Compiles the confirmed phrases of a shard of documents, streams its documents through the automaton, which alone
    says where they stand, and gives out the windows whose chosen phrase is among the occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, second, spelling = Rolling(1), Rolling(2), Spelling(phrase)
        for batch in slices(batches, "text"):
            batch = batch.filter(batch.column(2).is_valid())
            texts = byte_texts(batch)
            ids = _ids(batch.column(0))[0]
            words, tags = Words(texts, rolling), _tags(texts)
            windows, chosen, _ = words.anchors(rolling, window, phrase)
            if not len(windows):
                continue
            automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            for spelt in spelling.read(*(half.to_numpy(zero_copy_only=False) for half in batch.column(2).flatten().flatten())):
                automaton.add_word(spelt)
            automaton.make_automaton()
            ends = np.fromiter((end for end, _ in automaton.iter(spelling.text(spelling.letters(words.hashes)))), np.int64) + 1
            occurs = np.zeros(len(words.of), bool)
            occurs[ends[ends % spelling.width == 0] // spelling.width - phrase] = True
            at = windows[occurs[chosen]]
            of = words.of[at]
            other = second.runs(mix(words.hashes), at, at + window)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rolling.runs(words.hashes, at, at + window).view(np.int64)), pa.array((other >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(ids[of]), pa.array(tags[of] | words.place[at])],
                ["h1", "h2", "doc", "pos"],
            )

    return run


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition that are not the first of their window. Only the partition's very first row can
    not be told here: it comes out as FIRST, and the partition's last one as LAST."""
    before = None

    def rows(kind, table, keep):
        columns = [t[keep] for t in table]
        if kind == LATER:  # their hashes have done their work
            columns[:2] = [np.zeros_like(c) for c in columns[:2]]
        kinds = np.full(len(columns[0]), kind, np.int32)
        return pa.RecordBatch.from_arrays([pa.array(kinds), *map(pa.array, columns)], ["kind", "h1", "h2", "doc", "pos"])

    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(i).to_numpy() for i in range(4)]
        if before is None:
            yield rows(FIRST, now, slice(0, 1))
        else:
            now = [np.concatenate((b, n)) for b, n in zip(before, now, strict=True)]
        same = (now[0][1:] == now[0][:-1]) & (now[1][1:] == now[1][:-1])
        again = same & (now[2][1:] == now[2][:-1]) & (now[3][1:] == now[3][:-1])  # a repeated row: the same place
        yield rows(LATER, now, np.flatnonzero(same & ~again) + 1)
        before = [n[-1:] for n in now]
    if before is not None:
        yield rows(LAST, before, slice(None))


def repeated_windows(documents: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """doc_id, starts: the windows of `window` words of a document that start earlier elsewhere, by (doc_id, start).
    Whole copies of another document, whose windows all do, and documents without any are left out. A start is a word's place in its text, behind the text's CRC-32 (bits 31 and up).

    1. Each window chooses one phrase of `phrase` words by its hash, so equal windows choose equal phrases: about one
       place in seven. The phrases, spelt out but without their places, are range-partitioned and sorted: those met
       twice are confirmed.
    2. Confirmed phrases go to the shards of documents that can hold them, about 2 MB of text each. A task compiles
       those of a shard into an Aho-Corasick automaton over words and streams the shard through it. The places of
       all occurrences come from the automaton; it is as large as its shard's phrases, not as those of the corpus.
    3. Windows around occurrences are range-partitioned by their 96-bit hash and place, sorted and streamed: all but
       the first of a hash repeat. A passage that a third of the documents share is spread by place over partitions;
       a partition only asks its neighbours about its first row.
    """
    return _starts(_with_copies(documents), window, phrase)


def _with_copies(documents: DataFrame) -> DataFrame:
    """(doc_id, text, copied): whether a smaller doc_id has the very same text. All windows of a copy repeat, and none
    of them is ever the first, so copies need not be looked at again."""
    narrow = text_only(documents, "doc_id", "text")
    keys = narrow.where("doc_id IS NOT NULL").select("doc_id", *(F.xxhash64(*c).alias(k) for k, c in (("k1", ["text"]), ("k2", [F.lit(1), "text"]))))
    firsts = keys.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"))
    copies = keys.join(firsts, ["k1", "k2"]).where("doc_id > first").groupBy(F.col("doc_id").alias("copy")).agg(F.collect_set("k1").alias("copied"))
    joined = narrow.join(settled(copies), F.col("doc_id") == F.col("copy"), "left")
    copied = F.coalesce(F.array_contains("copied", F.xxhash64("text")), F.lit(False))
    return joined.select("doc_id", "text", copied.alias("copied"))


def _starts(texts: DataFrame, window: int, phrase: int) -> DataFrame:
    n = partitions(texts.sparkSession)
    narrow = texts.where("NOT copied").select("doc_id", "text")
    phrases = "p1 long, p2 long, doc long"
    anchors = narrow.mapInArrow(_anchors(window, phrase), phrases)
    anchors = anchors.repartitionByRange(n, "p1", "p2", "doc").sortWithinPartitions("p1", "p2")
    confirmed = anchors.mapInArrow(_recurring, phrases).groupBy("doc").agg(F.collect_list(F.struct("p1", "p2")).alias("phrases"))
    # a left join, as everywhere below: an inner one would filter the texts first, and shuffle them once more for it
    shards = texts.join(confirmed, texts["doc_id"] == confirmed["doc"], "left").where("NOT copied").select("doc_id", "text", "phrases")
    found = shards.mapInArrow(_candidates(window, phrase), "h1 long, h2 int, doc long, pos long")
    order = ("h1", "h2", "doc", "pos")
    found = found.repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = written(found.mapInArrow(_later, "kind int, h1 long, h2 int, doc long, pos long"))
    lasts = F.broadcast(rows.where(F.col("kind") == LAST).select("h1", "h2", F.struct("doc", "pos").alias("before")))
    firsts = rows.where(F.col("kind") == FIRST).join(lasts, ["h1", "h2"]).where(F.col("before") < F.struct("doc", "pos")).select("doc", "pos")
    later = rows.where(F.col("kind") == LATER).select("doc", "pos").unionByName(firsts)
    return later.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list("pos").alias("starts"))


def spans(starts: list[int] | None, tag: int, window: int) -> list[tuple[int, int]]:
    """Runs [from, to) of covered words of the text with this tag."""
    out: list[tuple[int, int]] = []
    for s in sorted({s - tag for s in starts or () if (s >> 31) << 31 == tag}):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], s + window)
        else:
            out.append((s, s + window))
    return out


def _kept(window: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            total, gone, kept, froms, tos = [], [], [], [], []
            for text, copied, starts in zip(byte_texts(batch), *(batch.column(i).to_pylist() for i in (2, 3)), strict=True):
                words = text.split()
                runs = [(0, len(words))][: len(words) >= window] if copied else spans(starts, zlib.crc32(text) << 31, window)
                total.append(len(words))
                gone.append(sum(b - a for a, b in runs))
                for a, b in reversed(runs):
                    del words[a:b]
                left = b" ".join(words)
                kept.append(hashlib.sha256(left).hexdigest() if digest else left.decode())
                froms.append([a for a, _ in runs])
                tos.append([b for _, b in runs])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(froms, pa.list_(pa.int64())), pa.array(tos, pa.list_(pa.int64()))],
                ["doc_id", "n_words", "n_removed", "kept", "from_word", "to_word"],
            )

    return run


def remove_repeats(documents: DataFrame, window: int = WINDOW, phrase: int = PHRASE, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept, from_word, to_word per row of `documents`: the words that no repeated window
    covers, joined by one space (its SHA-256 with `digest`), and the runs of words that went.

    Nulls: a null text has no words. A row with a null doc_id takes no part and keeps all words. Rows of one doc_id
    count as one document whose texts follow each other by checksum; equal rows are the same place, and repeat nothing
    of each other. A text of fewer than `window` words keeps all. An empty table gives no rows.
    """
    texts = _with_copies(documents)
    starts = _starts(texts, window, phrase).withColumnRenamed("doc_id", "doc")
    joined = texts.join(starts, F.col("doc_id") == F.col("doc"), "left")
    return joined.select("doc_id", "text", "copied", "starts").mapInArrow(
        _kept(window, digest), "doc_id long, n_words long, n_removed long, kept string, from_word array<long>, to_word array<long>"
    )
