"""Packing token sequences: per partition a fixed number of open windows, best fit, leftovers merged at the end."""

from __future__ import annotations

import codecs
import json
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.llm.common import SPACE, byte_texts, settled, single_thread, slices, text_only

LENGTH, END_ID, OPEN_WINDOWS = 4096, 2, 64
TOKENIZER = "word_bpe_49k.json"
#: Atoms whose ids a worker remembers, and as many again of those before; it then drops the older half.
REMEMBERED = 400_000
#: Atoms encoded at a time: the library's results are large beside the ids.
BATCH = 1024
#: Bytes of text whose atoms are found at once; the texts of a batch come in slices of as much.
BLOCK = 1 << 22

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long, open boolean"
_ARROW = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "window", "offset")] + [("open", pa.bool_())]
)


@lru_cache(maxsize=1)
def _tokenizer(name: str):
    single_thread()
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(name if "/" in name else public_tokenizers.path(name))


#: Kinds of bytes. Letters are ASCII's and the lower-case ones of Latin-1 (0xC3 and a byte), which no normalisation but
#: lower-casing changes. ODD are all other bytes and the apostrophe, which may begin a token with letters behind it.
#: CASED begin the marks that follow a letter, whose case may then tell.
_SPACE, _LETTER, _SIGN, _DIGIT, _ODD, _CASED = range(6)
_FORMS = rb"[ \t-\r]", rb"[A-Za-z\xc3\x9f-\xb6\xb8-\xbf]", rb"[!-&(-/:-@\[-`{-~]", rb"[0-9]", rb"[^\xcc\xcd]", rb"."
_KINDS = bytes(next(kind for kind, form in enumerate(_FORMS) if re.match(form, bytes([x]))) for x in range(256))
_SPECIAL = b"<|"  # begins the names of special tokens


@lru_cache(maxsize=1)
def _letters(name: str):
    """The tokenizer's merges alone, for words that need no normalisation, and the characters that it writes for bytes."""
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    form = json.loads(_tokenizer(name).to_str()) | {"normalizer": None, "pre_tokenizer": None}
    signs = ByteLevel(add_prefix_space=False, use_regex=False)
    characters = [chr(x) for x in range(256)]
    for x in range(0xC0, 0x100):  # in UTF-8 0xC3 and a second byte
        characters[0xC3], characters[x - 0x40] = signs.pre_tokenize_str(chr(x))[0][0]
    return Tokenizer.from_str(json.dumps(form)).model, "".join(characters)


class ChunkTokens:
    """Ids of whole texts by way of their atoms. The tokenizer drops white space and never merges across it, and in a
    chunk without white space it takes runs of letters, runs of signs and single digits each by itself: these are the
    atoms, and a chunk with anything else in it is one as a whole. Atoms are found and told apart for many texts at
    once, so that only distinct ones are looked up, and only those not met before tokenised."""

    def __init__(self, tokenizer: str):
        self.tokenizer = _tokenizer(tokenizer)
        self.merges, self.characters = _letters(tokenizer)
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}  # what was known until `known` was full; what is met again moves back

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if sum(map(len, texts)) <= BLOCK:
            return self._ids(texts)
        return [b"".join(part for block in _blocks(text) for part in self._ids([block])) for text in texts]

    def _ids(self, texts: list[bytes]) -> list[bytes]:
        joined = b"\n".join([*texts, b""])
        atoms, kinds, starts = _atoms(joined)
        distinct = atoms.dictionary_encode()
        places = distinct.indices.to_numpy()
        kind = np.empty(len(distinct.dictionary), np.uint8)
        kind[places] = kinds
        ids = pa.array(self._look_up(distinct.dictionary.to_pylist(), kind), pa.large_binary()).take(distinct.indices)
        _, offsets, data = ids.buffers()
        ends = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
        cuts = np.frombuffer(offsets, np.int64)[ends].tolist() if len(ids) else [0] * len(texts)
        whole = memoryview(data) if data else b""
        return [bytes(whole[a:b]) for a, b in zip([0, *cuts], cuts, strict=False)]

    def _look_up(self, atoms: list[bytes], kinds: np.ndarray) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.before, self.known = self.known, {}
        ids = list(map(self.known.get, atoms))
        letters = (kinds == _LETTER).tolist()
        fresh: tuple[list[int], list[int]] = [], []
        at = -1
        for _ in range(ids.count(None)):
            at = ids.index(None, at + 1)
            ids[at] = self.before.get(atoms[at])
            if ids[at] is None:
                fresh[letters[at]].append(at)
            else:
                self.known[atoms[at]] = ids[at]
        for places, encode in zip(fresh, (self._encode, self._encode_letters), strict=True):
            for i in range(0, len(places), BATCH):
                some = places[i : i + BATCH]
                for at, found in zip(some, encode([atoms[at] for at in some]), strict=True):
                    ids[at] = self.known[atoms[at]] = found
        return ids

    def _encode(self, atoms: list[bytes]) -> list[bytes]:
        """One text of the atoms, parted again by where the tokens begin: less per atom than a text for each."""
        joined = b" ".join(atoms).decode()
        found = self.tokenizer.encode(joined, add_special_tokens=False)
        return _parted(found.ids, np.searchsorted([a for a, _ in found.offsets], np.cumsum([len(p) + 1 for p in joined.split(" ")])))

    def _encode_letters(self, words: list[bytes]) -> list[bytes]:
        written = codecs.charmap_decode(b"\n".join(words), "strict", self.characters)[0].split("\n")
        found = [[token.id for token in self.merges.tokenize(word)] for word in written]
        return _parted(list(chain.from_iterable(found)), np.cumsum(list(map(len, found))))


def _blocks(text: bytes) -> Iterator[bytes]:
    """The text in runs of about BLOCK bytes, cut at white space only."""
    start, any_space = 0, re.compile(_FORMS[_SPACE])
    while len(text) - start > BLOCK:
        space = any_space.search(text, start + BLOCK)
        stop = space.end() if space else len(text)
        yield text[start:stop]
        start = stop
    yield text[start:]


def _atoms(text: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Of each atom its bytes, lower-cased where the tokenizer does no more than that, its kind and where it begins."""
    kinds = np.frombuffer(bytearray(text.translate(_KINDS)), np.uint8)
    if _SPECIAL in text:
        kinds[[m.start() for m in re.finditer(re.escape(_SPECIAL), text)]] = _CASED
    begins = kinds == _DIGIT
    begins[1:] |= kinds[1:] != kinds[:-1]
    begins[:1] = True
    starts = np.flatnonzero(begins)
    kind = kinds[starts]
    written = text.lower()
    odd = kind >= _ODD
    if odd.any():
        space = kind == _SPACE
        chunk = np.cumsum(space)  # with the white space before it
        worst = np.zeros(chunk[-1] + 1, np.uint8)
        worst[chunk[odd]] = _ODD
        worst[chunk[kind == _CASED]] = _CASED
        worst = worst[chunk]
        whole = (worst >= _ODD) & ~space
        kind = np.where(whole, worst, kind)
        kept = ~whole
        kept[1:] |= space[:-1]
        kept[:1] = True
        starts, kind = starts[kept], kind[kept]
        if _CASED in kind:
            changed = bytearray(written)
            for at in np.flatnonzero(kind == _CASED).tolist():
                part = slice(int(starts[at]), int(starts[at + 1]))
                changed[part] = text[part]
            written = bytes(changed)
    inside = kind != _SPACE
    offsets = np.zeros(int(inside.sum()) + 1, np.int32)
    np.cumsum(np.diff(starts, append=len(text))[inside], out=offsets[1:])
    characters = written.translate(None, SPACE)
    atoms = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(characters)])
    return atoms, kind[inside], starts[inside]


def _parted(ids: list[int], cuts: np.ndarray) -> list[bytes]:
    whole, ends = np.array(ids, "<u4").tobytes(), (4 * cuts).tolist()
    return [whole[a:b] for a, b in zip([0, *ends], ends, strict=False)]


@lru_cache(maxsize=1)
def _chunk_tokens(tokenizer: str) -> ChunkTokens:
    """One for all tasks of a worker."""
    return ChunkTokens(tokenizer)


class Packer:
    """Open windows by fill; at most `most` of them. A window is a list of the pieces put in it."""

    def __init__(self, length: int, most: int):
        self.length, self.most = length, most
        self.fills: list[tuple[int, int]] = []  # (tokens in it, number), sorted
        self.held: dict[int, list] = {}
        self.next = 0

    def put(self, pieces: list, size: int) -> list:
        """Places pieces of `size` tokens together; returns the pieces of a window that is done with, or none."""
        done: list = []
        at = bisect_right(self.fills, (self.length - size, 1 << 62)) - 1  # the fullest that still has room
        if at < 0:
            if len(self.fills) == self.most:
                done = self.held.pop(self.fills.pop()[1])
            fill, number = 0, self.next
            self.next += 1
            self.held[number] = []
        else:
            fill, number = self.fills.pop(at)
        self.held[number] += pieces
        if fill + size == self.length:
            done = done + [None] + self.held.pop(number) if done else self.held.pop(number)
        else:
            insort(self.fills, (fill + size, number))
        return done

    def rest(self) -> Iterator[list]:
        for _, number in self.fills:
            yield self.held[number]


class _Out:
    """Rows of finished and open windows. Window numbers hold the level, the task and a count."""

    def __init__(self, level: int, task: int):
        self.base = (level << 58) | (task << 34)
        self.count = 0
        self.rows: list[tuple] = []

    def window(self, pieces: list, is_open: bool) -> None:
        windows: list[list] = [[]]
        for p in pieces:
            windows.append([]) if p is None else windows[-1].append(p)
        for window in windows:
            offset = 0
            for piece in window:
                self.rows.append((*piece, self.base | self.count, offset, is_open))
                offset += piece[2]
            self.count += bool(window)

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.rows, strict=True) if self.rows else [[]] * len(_ARROW)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def _pack(tokenizer: str, end_id: int, length: int, most: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer, out = _chunk_tokens(tokenizer), Packer(length, most), _Out(0, TaskContext.get().partitionId())
        for batch in slices(batches, "text", BLOCK):
            for doc, ids in zip(batch.column(0).to_pylist(), tokens(byte_texts(batch)), strict=True):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, length):
                    part = ids[4 * start : 4 * (start + length)]
                    piece = (doc, start, len(part) // 4, zlib.crc32(part), n)
                    out.window([piece] if piece[2] == length else packer.put([piece], piece[2]), False)
            yield out.batch()
        for window in packer.rest():
            out.window(window, True)
        yield out.batch()

    return run


def _merge(level: int, length: int, most: int, last: bool):
    """Windows left open, which come sorted by number, are packed together as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, out = Packer(length, most), _Out(level, TaskContext.get().partitionId())
        number, held, size = None, [], 0
        for batch in batches:
            for *piece, window, _, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if window != number and held:
                    out.window(packer.put(held, size), False)
                    held, size = [], 0
                number = window
                held.append(tuple(piece))
                size += piece[2]
            yield out.batch()
        if held:
            out.window(packer.put(held, size), False)
        for window in packer.rest():
            out.window(window, not last)
        yield out.batch()

    return run


def pack(
    documents: DataFrame,
    length: int = LENGTH,
    open_windows: int = OPEN_WINDOWS,
    tokenizer: str = TOKENIZER,
    end_id: int = END_ID,
    fan_in: int = 32,
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece of a document.

    A document is the ids of its text and `end_id`. Only a document longer than `length` is cut, at multiples of
    `length`; its rest and all others are placed whole. One pass over the documents in their partitions, texts are
    not shuffled: each task holds `open_windows` windows, puts a piece where it leaves the least room, and gives out
    the fullest when none fits. What is open at a partition's end goes, `fan_in` partitions to a task, to a merge that
    packs open windows together in the same way, level by level up to a single task of `fan_in` x `open_windows`
    windows: no task holds more than `open_windows` windows, whatever the input.

    Nulls: a null text is empty, hence one piece with `end_id` alone; a null doc_id stays null. Repeated rows are
    packed each on its own. An empty table gives no rows.
    """
    pieces = settled(text_only(documents, "doc_id", "text").mapInArrow(_pack(tokenizer, end_id, length, open_windows), _PIECES))
    done = [pieces.where("NOT open")]
    level, groups = 0, pieces.rdd.getNumPartitions()
    while True:
        level += 1
        last = groups <= fan_in
        groups = -(-groups // fan_in)
        task = F.shiftright("window", 34).bitwiseAND((1 << 24) - 1)
        waiting = pieces.where("open").withColumn("group", F.floor(task / fan_in).cast("int"))
        waiting = waiting.repartitionById(max(1, groups), "group") if hasattr(waiting, "repartitionById") else waiting.repartition(max(1, groups), "group")
        waiting = waiting.drop("group").sortWithinPartitions("window", "offset")
        pieces = settled(waiting.mapInArrow(_merge(level, length, open_windows, last), _PIECES))
        done.append(pieces.where("NOT open"))
        if last:
            break
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("window").alias("sequence_id"), "offset")
