"""Recurring phrases by stripes: each first word keys one associative counter of what follows it."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptloom.llm.common import byte_texts, partitions, run_starts, slices, written

# What ends a piece of text, and what parts the words in it.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_LETTERS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + PIECE_ENDS, b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(PIECE_ENDS))
_BLANK, _LINE_END = pa.scalar(" ", pa.large_string()), pa.scalar("\n", pa.large_string())
#: Stands for a null language.
UNKNOWN = "und"


class Words(NamedTuple):
    """The words of several texts in order."""

    code: np.ndarray  # place in `names`
    names: pa.Array
    piece: np.ndarray  # number of the piece that a word stands in
    lang: np.ndarray  # language code of its text


def words_of(texts: list[bytes], langs: np.ndarray) -> Words:
    """Words of lower-cased texts, by whole-buffer steps: every text begins a piece, no word is empty."""
    buffer = b"\n".join(texts).translate(_LETTERS)
    chars = np.frombuffer(buffer, np.uint8)
    ends = chars == 10
    inside = ~(ends | (chars == 32))
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate(([0], np.cumsum(stop - start)))
    plain = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(chars[inside])])
    named = plain.dictionary_encode()
    begin = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)))[:-1]
    owner = np.searchsorted(begin, start, side="right") - 1
    return Words(named.indices.to_numpy(), named.dictionary, np.cumsum(ends)[start], langs[owner])


def gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list[bytes], pa.Array]]:
    """Texts and languages of rows with about `limit` bytes in all; a longer text comes alone, never cut."""
    held, size = [], 0
    for part in slices(batches, "text", limit):
        weight = part.column(0).nbytes
        if held and size + weight > limit:
            yield _texts(held)
            held, size = [], 0
        held.append(part)
        size += weight
    if held:
        yield _texts(held)


def _texts(parts: list[pa.RecordBatch]) -> tuple[list[bytes], pa.Array]:
    langs = pa.chunked_array([part.column(1) for part in parts]).cast(pa.string())
    return [text for part in parts for text in byte_texts(part)], pc.fill_null(langs, UNKNOWN).combine_chunks()


def _encoded(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Small codes of the keys, and the key of each code."""
    named = pa.array(keys).dictionary_encode()
    return named.indices.to_numpy(), named.dictionary.to_numpy()


def _runs(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[Words, list[str]]]:
    for texts, langs in gathered(batches, limit):
        named = langs.dictionary_encode()
        words = words_of(texts, named.indices.to_numpy().astype(np.int64))
        if len(words.code):
            yield words, named.dictionary.to_pylist()


def _counts(limit: int):
    """lang, word and its number in each run of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, langs in _runs(batches, limit):
            code, keys = _encoded(words.lang * len(words.names) + words.code)
            names = words.names.take(pa.array(keys % len(words.names))).cast(pa.large_string())
            arrays = [pa.array(langs).take(pa.array(keys // len(words.names))), names.cast(pa.string()), pa.array(np.bincount(code), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "word", "count"])

    return run


STRIPES = "lang string, first string, shard int, stripe string"


def _stripes(shards: dict[tuple[str, str], int], limit: int, lines: int):
    """One stripe for each language, word and shard in a run of texts: how often what followed the word, as lines `count
    second third` (after every so many lines a further row). An empty third word is the end of the piece; so is an empty
    second one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, langs in _runs(batches, limit):
            size = len(words.names)
            end = size  # the code of "no further word"
            code = words.code.astype(np.int64)
            second = np.append(np.where(words.piece[1:] == words.piece[:-1], code[1:], end), end)
            third = np.append(np.where(second[:-1] != end, second[1:], end), end)
            first, firsts = _encoded(words.lang * size + code)
            pair, pairs = _encoded(first.astype(np.int64) * (size + 1) + second)
            triple, triples = _encoded(pair.astype(np.int64) * (size + 1) + third)
            count = np.bincount(triple)
            third, pair = triples % (size + 1), triples // (size + 1)
            second, first = pairs[pair] % (size + 1), pairs[pair] // (size + 1)
            names = pa.concat_arrays([words.names.cast(pa.large_string()), pa.array([""], pa.large_string())])
            lang_of = pa.array(langs).take(pa.array(firsts // size))
            word_of = names.take(pa.array(firsts % size)).cast(pa.string())
            shard = np.zeros(len(count), np.int64)
            if shards:
                parts = np.array([shards.get(key, 1) for key in zip(lang_of.to_pylist(), word_of.to_pylist(), strict=True)], np.int64)
                # a stable hash of the second word: equal in every task, and one shard has all of a pair
                hashed = np.array([zlib.crc32(name.encode()) for name in names.to_pylist()], np.int64)
                shard = hashed[second] % parts[first]
            order = np.lexsort((second, shard, first))
            first, second, third, shard, count = (x[order] for x in (first, second, third, shard, count))
            begin = run_starts(first, shard)
            place = np.arange(len(count)) - np.repeat(begin, np.diff(np.append(begin, len(count))))
            begin = np.flatnonzero(place % lines == 0)
            texts = pc.binary_join_element_wise(
                pa.array(count).cast(pa.large_string()), names.take(pa.array(second)), names.take(pa.array(third)), _BLANK
            )
            grouped = pa.LargeListArray.from_arrays(pa.array(np.append(begin, len(count)), pa.int64()), texts)
            head = pa.array(first[begin])
            arrays = [lang_of.take(head), word_of.take(head), pa.array(shard[begin].astype(np.int32)), pc.binary_join(grouped, _LINE_END).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "first", "shard", "stripe"])

    return run


def _parted(texts: pa.Array, at_most: int) -> tuple[pa.Array, pa.Array]:
    """What stands before and behind the first blank of each text."""
    both = pc.split_pattern(texts, " ", max_splits=at_most).flatten()
    places = np.arange(0, len(both), 2)
    return both.take(pa.array(places)), both.take(pa.array(places + 1))


def _merge(rows: pa.Table) -> tuple[np.ndarray, pa.Table]:
    """Stripes of several keys, in order: the row at which each key begins, and their counters added up elementwise, as
    key (number), follows, count."""
    keys = [pc.dictionary_encode(rows.column(c)).combine_chunks().indices.to_numpy() for c in ("lang", "first")]
    begin = run_starts(*keys, rows.column("shard").to_numpy())
    key = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, rows.num_rows)))
    listed = pc.split_pattern(rows.column("stripe").combine_chunks(), "\n")
    counts, follows = _parted(listed.flatten(), 1)
    entries = pa.table({"key": key[pc.list_parent_indices(listed).to_numpy()], "follows": follows, "count": counts.cast(pa.int64())})
    merged = entries.group_by(["key", "follows"], use_threads=False).aggregate([("count", "sum")])
    return begin, merged.rename_columns(["key", "follows", "count"])


def _frequent(rows: pa.Table, begin: np.ndarray, merged: pa.Table, least: int) -> pa.Table:
    """Out of whole counters: their totals (second and third null), and the pairs and triples of `least` or more."""
    second, third = _parted(merged.column("follows").combine_chunks(), 1)
    counters = merged.append_column("second", second).append_column("third", third)
    none = pa.scalar(None, pa.string())

    def summed(*columns: str) -> pa.Table:
        return counters.group_by(["key", *columns], use_threads=False).aggregate([("count", "sum")]).rename_columns(["key", *columns, "count"])

    ones, twos = summed(), summed("second")
    often = pc.greater_equal(twos.column("count"), least)
    twos = twos.filter(pc.and_(often, pc.not_equal(twos.column("second"), "")))
    threes = counters.filter(pc.and_(pc.greater_equal(counters.column("count"), least), pc.not_equal(third, "")))
    found = []
    for table in (ones, twos, threes):
        columns = {c: table.column(c) if c in table.column_names else pa.repeat(none, table.num_rows) for c in ("second", "third")}
        head = pa.array(begin).take(table.column("key").combine_chunks())
        names = {c: rows.column(c).take(head) for c in ("lang", "first")}
        found.append(pa.table({**names, **columns, "count": table.column("count")}))
    return pa.concat_tables(found)


def _merged(least: int, most: int):
    """Adds up the stripes of each key, which come in order, about `most` characters of them at a time. The counter of a
    key that goes on is a stripe again and comes first in the next step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def step(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            rows = pa.Table.from_batches(held).combine_chunks()
            begin, merged = _merge(rows)
            whole = len(begin) if last else len(begin) - 1
            done = merged.filter(pc.less(merged.column("key"), whole))
            if done.num_rows:
                yield from _frequent(rows, begin, done, least).to_batches()
            if not last:
                rest = merged.filter(pc.equal(merged.column("key"), whole))
                lines = pc.binary_join_element_wise(rest.column("count").cast(pa.string()), rest.column("follows"), " ")
                stripe = pc.binary_join(pa.ListArray.from_arrays([0, len(lines)], lines.combine_chunks()), "\n")
                row = rows.slice(begin[-1], 1)
                held = [pa.RecordBatch.from_arrays([*(row.column(c).combine_chunks() for c in ("lang", "first", "shard")), stripe], rows.schema.names)]
                size = 0  # so that the next step has as many new rows

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                held.append(part)
                size += pc.sum(pc.binary_length(part.column(3))).as_py()
                if size > most:
                    yield from step(False)
        if held:
            yield from step(True)

    return run


def merged_stripes(documents: DataFrame, least: int, limit: int, lines: int = 1 << 10) -> tuple[DataFrame, DataFrame]:
    """Word counts (lang, word, count), and what the merged stripes of all texts hold from `least` on: lang, first,
    second, third, count, with third null for pairs, and both null for a word's own total, which a word whose stripe is in
    shards has one of for each."""
    session = documents.sparkSession
    n = partitions(session)
    texts = documents.select("text", F.col("lang").cast("string"))
    words = written(texts.mapInArrow(_counts(limit), "lang string, word string, count long").groupBy("lang", "word").agg(F.sum("count").alias("count")))
    # a word of more than a quarter of a partition's share is spread; there are fewer than 4 n such words
    total = words.agg(F.sum("count")).first()[0] or 0
    share = max(1.0, total / (4 * n))
    frequent = words.where(F.col("count") > share).withColumn("parts", F.ceil(F.col("count") / share))
    shards = {(r.lang, r.word): r.parts for r in frequent.select("lang", "word", "parts").collect()}
    key = ["lang", "first", "shard"]
    dealt = texts.mapInArrow(_stripes(shards, limit, lines), STRIPES).repartition(n, *key).sortWithinPartitions(*key)
    return words, written(dealt.mapInArrow(_merged(least, limit), "lang string, first string, second string, third string, count long"))


def _score(a: str, left: str, right: str):
    """floor(1000000 a a / (left right)), exactly: decimals of 38 digits hold the products of counts below 10^16."""
    a, left, right = (f"cast({c} AS decimal(38,0))" for c in (a, left, right))
    return F.expr(f"({a} * {a} * cast(1000000 AS decimal(38,0))) div ({left} * {right})")


def mine(documents: DataFrame, least: int = 10, cover: int = 50, top: int = 2000, limit: int = 1 << 21) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of two and three words.

    A phrase's words follow each other within a piece of a lower-cased text (pieces end at `.,;:!?` and line ends); a
    phrase counts from `least` occurrences on. Its score is the least over its cuts in two of 10^6 a a / (l r), floored,
    with a, l, r the counts of the phrase and of both parts, the earlier cut at ties. Phrases of two words go if one of
    three words that holds them occurs at least `cover`% as often. Order: score, then a, descending, then the phrase by
    its bytes; equal phrases do not exist.

    Each task folds runs of about `limit` bytes of text (a longer text is a run of its own) into stripes: per language
    and first word one counter of the two words that follow. Stripes are dealt by language and word and merged
    elementwise. The merged structure has all that is asked for: its entries are the counts of three words, sums by
    second word those of two, sums by stripe those of one, and maxima over it, by first and second or by second and
    third word, tell which phrases a longer one covers. A word with more than a quarter of a partition's share of all
    words has its stripe cut into shards by a hash of the second word, more the more frequent it is (the driver holds
    these words, fewer than four for each shuffle partition); a task holds one shard's counter and a run of stripes.

    A null text is empty and counts nothing, a null language is `und`; rows without an id count as others do, and
    repeated rows are counted as often as they stand there. An empty table, or one without a phrase of `least`
    occurrences, gives no rows. Only text and lang are read, whatever the other columns are called.
    """
    words, stripes = merged_stripes(documents, least, limit)
    n = words.groupBy("lang").agg(F.sum("count").alias("n"))
    twos = stripes.where("second IS NOT NULL AND third IS NULL").select("lang", "first", "second", F.col("count").alias("a"))
    ones = stripes.where("second IS NULL").groupBy("lang", F.col("first").alias("word")).agg(F.sum("count").alias("f")).where(F.col("f") >= least)
    ones = written(ones)
    threes = stripes.where("third IS NOT NULL").withColumnRenamed("count", "a")

    def named(left: str, right: str) -> tuple[DataFrame, DataFrame]:
        return (
            ones.select("lang", F.col("word").alias(left), F.col("f").alias("f_" + left)),
            ones.select("lang", F.col("word").alias(right), F.col("f").alias("f_" + right)),
        )

    left, right = named("first", "second")
    longest = threes.groupBy("lang", "first", "second").agg(F.max("a").alias("longer_right"))
    preceded = threes.groupBy("lang", F.col("second").alias("first"), F.col("third").alias("second")).agg(F.max("a").alias("longer_left"))
    of_two = (
        twos.join(longest, ["lang", "first", "second"], "left").join(preceded, ["lang", "first", "second"], "left")
        .withColumn("longer", F.greatest(F.coalesce("longer_right", F.lit(0)), F.coalesce("longer_left", F.lit(0))))
        .where(100 * F.col("longer") < cover * F.col("a"))
        .join(left, ["lang", "first"]).join(right, ["lang", "second"])
        .withColumn("score", _score("a", "f_first", "f_second"))
        .select("lang", F.concat_ws(" ", "first", "second").alias("phrase"), "a", F.col("f_first").alias("l"), F.col("f_second").alias("r"), "score")
    )
    left, right = named("first", "third")
    head = twos.withColumnRenamed("a", "f_head")
    tail = twos.select("lang", F.col("first").alias("second"), F.col("second").alias("third"), F.col("a").alias("f_tail"))
    cuts = (
        threes.join(head, ["lang", "first", "second"]).join(tail, ["lang", "second", "third"])
        .join(left, ["lang", "first"]).join(right, ["lang", "third"])
        .withColumns({"early": _score("a", "f_first", "f_tail"), "late": _score("a", "f_head", "f_third")})
    )
    late = F.col("late") < F.col("early")
    of_three = cuts.select(
        "lang", F.concat_ws(" ", "first", "second", "third").alias("phrase"), "a",
        F.when(late, F.col("f_head")).otherwise(F.col("f_first")).alias("l"),
        F.when(late, F.col("f_third")).otherwise(F.col("f_tail")).alias("r"),
        F.least("early", "late").alias("score"),
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = of_two.unionByName(of_three).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
