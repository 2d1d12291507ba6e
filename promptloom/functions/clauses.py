"""Overlapping clauses: greedy de-duplication and pairs, the text steps that run in Python on Arrow batches.

A sentence goes if it repeats one kept before it, inside one text. Only sentences that share a rare
word are compared, so the work grows about with the text. Batches cross to Python as Arrow; each text
of a batch is then folded by itself. Spark does all the partitioning: the UDF is a plain projection.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

from promptloom.functions import rules

# Executors get these few functions by value, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_BREAK = re.compile(r"(?<=[.!?])\s+")
_WORD = re.compile(r"[a-z]{3,}")
_STOP = frozenset(rules.STOPWORDS)


def bags_of(text: str, fence_head: str) -> list[tuple[str, set[str]]]:
    """Sentences with their keyword sets; protected code has an empty set."""
    parts = [part.strip() for part in _BREAK.split(text.strip())]
    return [
        (part, set() if part.startswith(fence_head) else set(_WORD.findall(part.lower())) - _STOP)
        for part in parts
        if part
    ]


class Overlaps:
    """The keyword sets met so far, found again by shared words.

    Two sets overlap if the smaller one shares the threshold's part of its words. So of the ``n`` words of the
    smaller set, in any fixed order, one of the first n - need + 1 is shared, ``need`` being that part: a set is
    filed under those words for larger sets to come, and under all its words for smaller ones, which look up only
    their first words. With the text's rare words first, few sets are compared; the result is that of comparing all.
    """

    def __init__(self, bags: list[set[str]], threshold: float):
        self.threshold = threshold
        often = Counter(word for bag in bags for word in bag)
        self.place = {word: n for n, word in enumerate(sorted(often, key=lambda w: (often[w], w)))}
        self.latest: tuple[set[str], list[str]] = (set(), [])
        self.by_first: dict[str, list[int]] = defaultdict(list)
        self.by_any: dict[str, list[int]] = defaultdict(list)
        self.bags: dict[int, set[str]] = {}

    def _first(self, bag: set[str]) -> list[str]:
        if self.latest[0] is not bag:  # a set is looked up, then added
            need = max(1, math.ceil(self.threshold * len(bag) - 1e-9))
            self.latest = (bag, sorted(bag, key=self.place.__getitem__)[: len(bag) - need + 1])
        return self.latest[1]

    def near(self, bag: set[str]) -> Iterator[int]:
        """Positions of the sets that overlap ``bag``, each once, in no order."""
        seen: set[int] = set()
        for index, words in ((self.by_any, self._first(bag)), (self.by_first, bag)):
            for word in words:
                for at in index[word]:
                    if at not in seen:
                        seen.add(at)
                        other = self.bags[at]
                        if len(bag & other) / min(len(bag), len(other)) >= self.threshold:
                            yield at

    def add(self, at: int, bag: set[str]) -> None:
        self.bags[at] = bag
        for word in bag:
            self.by_any[word].append(at)
        for word in self._first(bag):
            self.by_first[word].append(at)


def fold_udf(threshold: float, fence_head: str):
    """text -> text without the sentences that repeat the intent of an earlier kept one."""

    def fold(text: str | None) -> str | None:
        if text is None:
            return None
        items = bags_of(text, fence_head)
        if len(items) <= 1:
            return text
        known, kept = Overlaps([bag for _, bag in items], threshold), []
        for at, (sentence, bag) in enumerate(items):
            if bag:
                if next(known.near(bag), None) is not None:
                    continue
                known.add(at, bag)
            kept.append(sentence)
        return " ".join(kept)

    @F.pandas_udf("string")
    def dedupe(texts: pd.Series) -> pd.Series:
        return texts.map(fold)

    return dedupe


def overlap_udf(threshold: float):
    """text -> for each sentence that overlaps earlier ones: position, first partner, how many."""

    def report(text: str | None) -> list[tuple[int, int, int]]:
        bags = [bag for _, bag in bags_of(text or "", "\0")]
        known, out = Overlaps(bags, threshold), []
        for at, bag in enumerate(bags):
            if bag:
                hits = list(known.near(bag))
                if hits:
                    out.append((at, min(hits), len(hits)))
                known.add(at, bag)
        return out

    @F.pandas_udf("array<struct<pos:int,first_pos:int,partners:int>>")
    def overlaps(texts: pd.Series) -> pd.Series:
        return texts.map(report)

    return overlaps


#: Pairs given out at a time.
PAIRS = 1 << 16


def pairs_within(threshold: float, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (key, at, words), sorted by key and at, to rows (key, first place, second place, words shared), called
    ``names``, of those that overlap under one key. Holds one key's rows at a time, and no more than ``PAIRS`` pairs of it besides one row's."""

    def overlapping(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, group in groupby(rows, itemgetter(0)):
            places, bags = [], []
            for _, at, words in group:
                places.append(at)
                bags.append(set(words.split(" ")))
            if len(bags) == 1:
                continue
            known = Overlaps(bags, threshold)
            for i, bag in enumerate(bags):
                for j in known.near(bag):
                    if places[j] < places[i]:
                        yield key, places[j], places[i], len(bag & bags[j])
                known.add(i, bag)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list[pa.DataType] = []

        def rows() -> Iterator[tuple]:
            for batch in batches:
                types[:] = batch.schema.types
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        def table(found: list[tuple]) -> pa.RecordBatch:
            key, place, _ = types
            columns = zip(zip(*found, strict=True), (key, place, place, pa.int32()), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=names)

        found: list[tuple] = []
        for pair in overlapping(rows()):
            found.append(pair)
            if len(found) == PAIRS:
                yield table(found)
                found = []
        if found:
            yield table(found)

    return pairs
