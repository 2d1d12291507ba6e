"""Secrets: fixed forms, and weaker candidates that count only beside the parts of a credential that they lack."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptloom.llm.common import written


class Form(NamedTuple):
    """What a part looks like: one match in a text, leftmost and not overlapping others of its form."""

    kind: str
    role: str  # id, secret or endpoint
    strong: bool
    pattern: str
    least: int  # characters of the match's group 1
    words: tuple[str, ...] = ()  # one of these, in lower case, stands in every match
    needs: tuple[str, ...] = ()  # further patterns that the whole match must hold


_ASSIGNED = r"""["']?\x20*[:=]\x20*["']?"""
# The three forms that are reported wherever they stand, in the order of spans with one start.
BASE = (
    Form("assign", "secret", True, rf"(?i:password|passwd|secret|token|api_?key){_ASSIGNED}([A-Za-z0-9+/_.=-]+)", 6, ("passw", "secret", "token", "api")),
    Form("access", "id", True, r"(AKIA[A-Z0-9]{16,})", 20, ("akia",)),
    Form("hex", "secret", True, r"([0-9a-f]{24,})", 24),
)
#: Candidates that need a complement: names of accounts, named or mixed strings. None may contain a part twice as it
#: grows, so that a match costs no more than its length.
WEAK = (
    Form(
        "identifier", "id", False, rf"(?i:(?:access|client|account|app|key|user)[_-]?id|user_?name|user|login){_ASSIGNED}([A-Za-z0-9_.@-]+)", 3,
        ("id", "user", "login"),
    ),
    Form(
        "secret", "secret", False, rf"(?i:pwd|passphrase|pass|credential|private_?key|access_?key|auth){_ASSIGNED}([A-Za-z0-9+/_.=-]+)", 4,
        ("pwd", "pass", "credential", "key", "auth"),
    ),
    Form("secret", "secret", False, r"([A-Za-z0-9+/_-]{16,})", 16, (), ("[0-9]", "[a-z]", "[A-Z]")),
)
ENDPOINTS = (
    Form("endpoint", "endpoint", False, r"""([A-Za-z0-9]{2,16}://[^\x20\x09-\x0D"'<>]+)""", 8, ("://",)),
    Form("endpoint", "endpoint", False, rf"(?i:hostname|host|endpoint|server|base_?url|url){_ASSIGNED}([A-Za-z0-9:/_.-]+)", 3, ("host", "endpoint", "server", "url")),
)
FORMS = (*BASE, *WEAK, *ENDPOINTS)
KINDS = ("assign", "access", "hex", "identifier", "secret")
_PART = "array<struct<form:int,i:int,gap:int,len:int,ok:boolean>>"


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def _parts(text: Column, number: int, form: Form, likely: Column) -> Column:
    """Every match of a form as (form, i, gap, len, ok): how many characters stand between the match before and this
    one, its own characters, and whether it counts. Cutting the text at the matches gives the gaps. `likely` is a cheap
    test that spares most texts the pattern."""
    pattern = F.lit(form.pattern)
    gaps, matches, values = F.split(text, form.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(1))

    def counts(match: Column, value: Column) -> Column:
        good = F.length(value) >= form.least
        for needed in form.needs:
            good = good & match.rlike(needed)
        return good

    pairs = F.zip_with(matches, values, lambda m, v: F.struct(F.length(m).alias("len"), counts(m, v).alias("ok")))
    zipped = F.zip_with(gaps, pairs, lambda g, p: F.struct(F.length(g).alias("gap"), p["len"].alias("len"), p["ok"].alias("ok")))
    listed = F.transform(
        zipped, lambda s, i: F.struct(F.lit(number).alias("form"), i.alias("i"), s["gap"].alias("gap"), s["len"].alias("len"), s["ok"].alias("ok"))
    )
    full = F.filter(listed, lambda s: s["len"].isNotNull())  # the last gap has no match behind it
    return F.when(likely, full).otherwise(F.array().cast(_PART))


def _scanned(documents: DataFrame) -> DataFrame:
    """doc_id, a 128-bit key of id and text, and the parts of each row. Weak forms are only looked for where the text has
    what they could complete: an access id, or the name of an account and either a secret of the fixed forms or an
    endpoint."""
    rows = documents.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("lower", F.lower("text"))
    text, lower = F.col("text"), F.col("lower")
    likely = {form: _holds(lower, form.words) if form.words else F.lit(True) for form in FORMS}
    access, hexed, identifier = BASE[1], BASE[2], WEAK[0]
    likely[hexed] = text.rlike(hexed.pattern)
    rows = rows.withColumns({
        "has_hex": likely[hexed],
        "has_access": likely[access] & text.rlike(access.pattern),
        "has_name": likely[identifier] & text.rlike(identifier.pattern),
    })
    likely[hexed] = F.col("has_hex")
    others = likely[BASE[0]] | likely[ENDPOINTS[0]] | likely[ENDPOINTS[1]] | F.col("has_hex")
    for form in (*WEAK, *ENDPOINTS):
        likely[form] = (F.col("has_access") | (F.col("has_name") & others)) & likely[form]
    parts = F.concat(*[_parts(text, number, form, likely[form]) for number, form in enumerate(FORMS)])
    key = [F.col("doc_id").isNull(), F.col("doc_id"), text]
    return rows.select("doc_id", F.xxhash64(*key).alias("k1"), F.xxhash64(F.lit(1), *key).alias("k2"), parts.alias("parts"))


def _placed(found: DataFrame) -> DataFrame:
    """k1, k2, form, start, end of the parts that count: running sums of gaps and matches, one window for each text and
    form. A text's parts were one row, so a window never holds more than that."""
    parts = found.select("k1", "k2", F.explode("parts").alias("p")).select("k1", "k2", "p.*")
    order = Window.partitionBy("k1", "k2", "form").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = parts.withColumn("end", F.sum(F.col("gap").cast("long") + F.col("len")).over(order)).where("ok")
    return placed.select("k1", "k2", "form", (F.col("end") - F.col("len")).alias("start"), "end")


def _within(left: DataFrame, right: DataFrame, reach: int, also: Column | None = None) -> DataFrame:
    """The rows of `left` that have a row of `right` in their text at most `reach` characters away (none: they must
    overlap). Both are cut at a grid and meet by cell; a cell holds few parts, as parts of one form do not overlap. The
    columns of `right` are called other_ in `also`."""
    width = max(reach, 256)

    def cells(a: Column, b: Column) -> Column:
        return F.explode(F.sequence(F.floor(a / width), F.floor(b / width)))

    asked = left.withColumn("cell", cells(F.col("start") - reach, F.col("end") + reach))
    there = right.select(*[F.col(c).alias(f"other_{c}") for c in right.columns]).withColumn("other_cell", cells(F.col("other_start"), F.col("other_end")))
    meet = (F.col("k1") == F.col("other_k1")) & (F.col("k2") == F.col("other_k2")) & (F.col("cell") == F.col("other_cell"))
    between = F.greatest("start", "other_start") - F.least("end", "other_end")
    meet = meet & (between < 0 if reach == 0 else between <= reach)
    return asked.join(there, meet if also is None else meet & also, "left_semi").drop("cell").distinct()


def _linked(spans: DataFrame, reach: int) -> DataFrame:
    """The weak candidates whose complement stands within reach: an id beside a secret, or the other way round. If both
    are weak, both must also have an endpoint within reach."""

    def of(forms: tuple[Form, ...]) -> Column:
        return F.col("form").isin([FORMS.index(form) for form in forms])

    base, endpoints = spans.where(of(BASE)), spans.where(of(ENDPOINTS))
    weak = spans.where(of(WEAK))
    keys = ["k1", "k2", "form", "start", "end"]
    weak = weak.join(_within(weak, base, 0).select(*keys), keys, "left_anti")
    placed = _within(weak, endpoints, reach).select(*keys, F.lit(True).alias("anchored"))
    weak = weak.join(placed, keys, "left")
    is_id = of(tuple(form for form in FORMS if form.role == "id"))
    parts = weak.withColumn("strong", F.lit(False)).unionByName(base.withColumns({"anchored": F.lit(None).cast("boolean"), "strong": F.lit(True)}))
    parts = written(parts.withColumns({"is_id": is_id, "anchored": F.coalesce("anchored", F.lit(False))}))
    backed = F.col("other_strong") | (F.col("anchored") & F.col("other_anchored"))
    return _within(parts.where("NOT strong"), parts, reach, (F.col("is_id") != F.col("other_is_id")) & backed).select(*keys)


def find(documents: DataFrame, reach: int = 256) -> DataFrame:
    """doc_id, base, spans per row of `documents`: arrays of (start, kind, end) in code points, end exclusive; kind is a
    place in KINDS. `base` has what the fixed forms match; `spans` has those and the weak candidates of credentials.

    A weak candidate (the name of an account, a string assigned to `pwd` or the like, a long string of mixed characters)
    is reported if no fixed form touches it and a complementary part stands within `reach` characters: an identifier for
    a secret, a secret for an identifier; where the complement is weak as well, both need an endpoint (an address, a
    host) within reach. An interval join on a grid over each text finds these; two parts meet only if their cells do.

    Only columns and SQL functions: the texts are cut by patterns in the projection that reads them, and only places move.
    Texts without parts are not shuffled at all. Equal rows (id and text) are looked at once.

    Nulls: a null text is empty and has no spans; null ids are kept, as are repeated rows, each with its spans. An empty
    table gives no rows. Only doc_id and text are read, whatever the other columns are called.
    """
    scanned = written(_scanned(documents))
    nothing = F.array().cast("array<struct<start:long,kind:int,end:long>>")
    clean = scanned.where(F.size("parts") == 0).select("doc_id", nothing.alias("base"), nothing.alias("spans"))
    some = scanned.where(F.size("parts") > 0).groupBy("k1", "k2")
    some = some.agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("parts").alias("parts"))
    spans = written(_placed(some))
    kind = F.element_at(F.array(*[F.lit(KINDS.index(f.kind) if f.kind in KINDS else -1) for f in FORMS]), F.col("form") + 1)

    def listed(rows: DataFrame, name: str) -> DataFrame:
        span = F.struct("start", kind.alias("kind"), "end")
        return rows.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(span)).alias(name))

    base = spans.where(F.col("form") < len(BASE))
    of_base, of_weak = listed(base, "base"), listed(_linked(spans, reach), "more")
    rows = some.select("k1", "k2", "doc_id", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    rows = rows.join(of_base, ["k1", "k2"], "left").join(of_weak, ["k1", "k2"], "left")
    rows = rows.select("doc_id", F.coalesce("base", nothing).alias("base"), F.coalesce("more", nothing).alias("more"))
    return clean.unionByName(rows.select("doc_id", "base", F.array_sort(F.concat("base", "more")).alias("spans")))


def _text(spans: Column) -> Column:
    names = F.array(*[F.lit(kind) for kind in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: counts of the fixed forms, and spans as text."""
    found = find(documents)
    counts = [F.size(F.filter("base", lambda s: s["kind"] == F.lit(k))).cast("long").alias(f"n_{form.kind}") for k, form in enumerate(BASE)]  # noqa: B023
    return found.select("doc_id", *counts, F.sha2(_text(F.col("base")), 256).alias("base_sha256"), _text(F.col("spans")).alias("spans"))
