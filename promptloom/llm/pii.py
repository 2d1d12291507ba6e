"""Personal data: fixed forms as seeds, and a bootstrapped search for further identifiers by their contexts."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.llm.common import settled, slices, text_only

# The forms of the four kinds, in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_DIGIT = re.compile(r"[0-9]")
_BLANKS = " \t\n\x0b\x0c\r"
_BLANK = re.compile(r"[ \t\n\x0b\x0c\r]")
_KEY = re.compile(r"[A-Za-z_]{2,40}[=:][\"']?$")
_SIGNS = ".,;:!?()[]{}<>\"'"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each match holds one @: the longest local part before it that the match before has left, and a domain behind."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed forms: leftmost, not overlapping within a kind; failing matches are dropped."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m.groups()]
            if all(len(p) < 3 or len(p) == 3 and p <= "255" for p in parts):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def unknown_tokens(text: str, spans: list[tuple[int, int, int]], least: int = 6) -> Iterator[tuple[int, int]]:
    """Tokens with a digit, signs around them and a leading `key=` taken off, that no span touches."""
    covered = sorted((a, b) for a, _, b in spans)
    pos, i = 0, 0
    while m := _DIGIT.search(text, pos):
        start = m.start()
        while start > pos and text[start - 1] not in _BLANKS:
            start -= 1
        blank = _BLANK.search(text, m.end())
        pos = end = blank.start() if blank else len(text)
        for sign in "=:":
            cut = text.find(sign, start, min(end, start + 42))
            if cut > start and not _DIGIT.search(text, start, cut):
                start = cut + 1
        while start < end and text[start] in _SIGNS:
            start += 1
        while end > start and text[end - 1] in _SIGNS:
            end -= 1
        while i < len(covered) and covered[i][1] <= start:
            i += 1
        if end - start >= least and not any(a < end for a, _ in covered[i : i + 1]):
            yield start, end


def contexts(text: str, start: int, end: int, reach: int = 80) -> list[str]:
    """The lexical patterns around a span: the key written onto it, the two words before, the words on both sides."""
    before, behind = text[max(0, start - reach) : start], text[end : end + reach]
    out = []
    if m := _KEY.search(before):
        out.append("k " + m.group().lower())
    words = before.lower().split()[-2:]
    after = behind.lower().split()[:1]
    if len(words) == 2:
        out.append(f"l {words[0]} {words[1]}")
    if words and after:
        out.append(f"b {words[-1]} {after[0]}")
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
    met = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])
    for batch in slices(batches, "text"):
        tags, bases, seen = [], [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            tags.append(zlib.crc32(text.encode()))
            spans = base_spans(text)
            bases.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
            places = [(a, k, b) for a, k, b in spans] + [(a, None, b) for a, b in unknown_tokens(text, spans)]
            seen.append([{"start": a, "kind": k, "end": b, "instance": text[a:b], "patterns": contexts(text, a, b)} for a, k, b in places])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(tags, pa.int64()), pa.array(bases, pa.list_(span)), pa.array(seen, pa.list_(met))], ["doc_id", "tag", "base", "seen"]
        )


def bootstrap(seen: DataFrame, rounds: int = 3, support: int = 3, confidence: float = 0.8) -> DataFrame:
    """(instance, kind): identifiers that the contexts of seeds give away, out of (instance, kind, pattern), kind null
    where unknown.

    In each round a pattern's score for a kind is the belief in its distinct instances' being of that kind over one more
    than their number, if at least `support` seeds or instances believed at `confidence` or more in the round before
    stand in it; an unknown instance is believed as far as its patterns' scores leave no doubt, 1 - product(1 - score).
    So what a round finds makes further patterns count in the next, those without any seed included. Unknown instances
    start at 0, seeds stay at 1. What ends at `confidence` or more is found, for its likeliest kind. Two aggregations and
    three joins a round over distinct pattern-instance pairs; a pattern or token that many rows hold is one pair before
    anything is joined.
    """
    edges = settled(seen.groupBy("pattern", "instance").agg(F.min("kind").alias("kind")))
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("size"), F.count("kind").alias("known"))
    # the others never reach `support`, or hold nothing to find
    sizes = sizes.where((F.col("size") >= support) & (F.col("known") < F.col("size"))).drop("known")
    open_edges = settled(edges.where("kind IS NULL").select("pattern", "instance").join(sizes, "pattern"))
    seeds = edges.where("kind IS NOT NULL").groupBy("pattern", "kind").agg(F.count("*").alias("seeds"))
    seeds = settled(seeds.join(sizes.select("pattern"), "pattern", "left_semi"))
    belief = None
    for _ in range(rounds):
        if belief is None:
            patterns = seeds.select("pattern", "kind", F.col("seeds").alias("sure"), F.col("seeds").cast("double").alias("sum"))
        else:
            sure = F.sum((F.col("belief") >= confidence).cast("long"))
            more = open_edges.join(belief, "instance").groupBy("pattern", "kind").agg(F.sum("belief").alias("more"), sure.alias("found"))
            held = F.coalesce("seeds", F.lit(0))
            patterns = seeds.join(more, ["pattern", "kind"], "full").select(
                "pattern", "kind", (held + F.coalesce("found", F.lit(0))).alias("sure"), (held + F.coalesce("more", F.lit(0.0))).alias("sum")
            )
        scored = open_edges.join(patterns.where(F.col("sure") >= support), "pattern").withColumn("score", F.col("sum") / (F.col("size") + 1))
        doubt = F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("score")))))
        belief = settled(scored.groupBy("instance", "kind").agg((1 - doubt).alias("belief")))
    best = belief.where(F.col("belief") >= confidence).groupBy("instance").agg(F.max(F.struct("belief", (-F.col("kind")).alias("first"))).alias("best"))
    return best.select("instance", (-F.col("best.first")).cast("int").alias("kind"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"])))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def find(documents: DataFrame, rounds: int = 3, support: int = 3, confidence: float = 0.8) -> DataFrame:
    """doc_id, base, spans per row of `documents`: arrays of (start, kind, end) in code points, end exclusive; kind is a
    place in KINDS. `base` has the fixed forms; `spans` has those and the identifiers that were discovered.

    One pass over the whole texts gives spans, tokens with digits and their contexts; what follows moves only these.
    Discovered identifiers come back by token, then by document; a token that a third of all rows hold is joined
    against one row of its own.

    Nulls: a null text is empty and has no spans; null ids are kept, as are repeated rows, each with its spans. An empty
    table gives no rows.
    """
    scanned = text_only(documents, "doc_id", "text").mapInArrow(
        _scan,
        "doc_id long, tag long, base array<struct<start:long,kind:int,end:long>>, "
        "seen array<struct<start:long,kind:int,end:long,instance:string,patterns:array<string>>>",
    )
    scanned = settled(scanned)
    places = scanned.select("doc_id", "tag", F.explode("seen").alias("s")).select("doc_id", "tag", "s.*")
    graph = places.select("instance", "kind", F.explode("patterns").alias("pattern"))
    found = bootstrap(graph, rounds, support, confidence)
    unknown = places.where("kind IS NULL").select("doc_id", "tag", "start", "end", "instance")
    more = unknown.join(found, "instance").select("doc_id", "tag", F.struct("start", "kind", "end").alias("span"))
    more = more.groupBy(F.col("doc_id").alias("doc"), F.col("tag").alias("crc")).agg(F.collect_set("span").alias("more"))
    joined = scanned.join(more, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("tag") == F.col("crc")), "left")
    return joined.select("doc_id", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", "more")).alias("spans"))


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: counts of the fixed forms, and spans as text."""
    found = find(documents)
    kinds = F.col("base.kind")
    counts = [F.size(F.filter(kinds, lambda x: x == F.lit(KINDS.index(name)))).cast("long").alias(f"n_{name}") for name in KINDS]  # noqa: B023
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
