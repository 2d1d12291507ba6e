"""Each operator against a brute-force version, with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from promptloom.llm import hilbert, langid, line_dedup, mixing, packing, phrases, pii, quantised, simhash, toxicity
from promptloom.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, __keep string, doc string, k1 int"
SYLLABLES = ["ka", "lo", "mi", "ter", "san", "vu", "ren", "dol", "pi", "qua"]


def words(rng, n):
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n)]


def corpus():
    """Rows of DOCS, with columns whose names clash with those that operators make."""
    rng = random.Random(5)
    passage, line = words(rng, 60), "This very line is found in several documents."
    texts = [None, "", " ", "\n\n", "one", "Two  words", "x" * 50_000]
    for i in range(60):
        w = words(rng, rng.randint(1, 200))
        if i % 4 == 0:
            w[len(w) // 2 : len(w) // 2] = passage[: rng.randint(20, 60)]
        parts = [" ".join(w[a : a + 12]) for a in range(0, len(w), 12)]
        if i % 3 == 0:
            parts.insert(rng.randint(0, len(parts)), ("  " if i % 2 else "") + (line.upper() if i % 6 else line))
        texts.append("\n".join(parts))
    texts += [texts[20]] * 5 + [texts[30] + " more", "Ähnlich ß " * 30, "wort " * 4000]
    rows = [(i * 3 + 1, t, "en", f"s{i % 3}" if i % 7 else None, None, "x", "y", 1) for i, t in enumerate(texts)]
    return rows + [rows[25]] * 2 + [(None, texts[12], None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def texts_by_id():
    return {r[0]: r[1] or "" for r in corpus() if r[0] is not None}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(0, 80)] + [(200, 200 + i) for i in range(90)] + [(rng.randint(400, 500), rng.randint(400, 500)) for _ in range(60)]
    parent = {n: n for p in pairs for n in p}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r[0]: r[1] for r in components(spark.createDataFrame([*pairs, (None, 3), (7, 7)], "a long, b long")).collect()}
    assert got == {n: root(n) for p in pairs if p[0] != p[1] for n in p}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def lines_by_force(texts):
    keys = {i: [x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)}) for x in t.split("\n")] for i, t in texts.items()}
    held = defaultdict(set)
    for i, ks in keys.items():
        for k in ks:
            held[k].add(i)
    return {i: [x for x, k in zip(t.split("\n"), keys[i], strict=True) if len(k) < 20 or len(held[k]) < 3 or max(held[k]) == i] for i, t in texts.items()}


@pytest.mark.parametrize("batch", ["10000", "3"])
def test_line_dedup(spark, docs, nothing, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        want = lines_by_force(texts_by_id())
        got = line_dedup.line_digests(docs).collect()
        kept = line_dedup.drop_lines(docs, line_dedup.line_keep_bitmaps(docs)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == docs.count() and sum(r.n_dropped for r in got) > 10
    for r in got:
        if r.doc_id is not None:
            left = want[r.doc_id]
            whole = texts_by_id()[r.doc_id].split("\n")
            assert (r.n_lines, r.n_dropped, r.kept_sha256) == (len(whole), len(whole) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest())
        else:
            assert r.n_dropped == 0
    assert all(r.text == (None if r.doc_id == 1 else "\n".join(want[r.doc_id])) for r in kept if r.doc_id is not None)
    assert kept[0].asDict().keys() == set(docs.columns)
    assert line_dedup.line_digests(nothing).count() == 0


def test_line_dedup_hot_line_over_partitions(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(i, "the same line in every document\nown line of document " + str(i) * 4) for i in range(400)]
        got = {r.doc_id: r.n_dropped for r in line_dedup.line_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: int(i != 399) for i in range(400)}


def print_by_force(text):
    w = text.translate({c: c + 32 for c in range(65, 91)}).encode().split()
    runs = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    counts = Counter(b for r in runs for b in range(64) if xxhash.xxh64_intdigest(r, 42) >> b & 1)
    return sum(1 << b for b, c in counts.items() if 2 * c > len(runs))


def test_simhash(docs, nothing):
    texts = texts_by_id()
    prints = {i: print_by_force(t) for i, t in texts.items()}
    parent = {i: i for i in prints}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if bin(prints[a] ^ prints[b]).count("1") <= 3:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is not None:
            assert (r.fp & (1 << 64) - 1, r.component_id) == (prints[r.doc_id], root(r.doc_id))
    kept = [r.doc_id for r in simhash.keep_first(docs).collect()]
    assert Counter(k for k in kept if k is not None) == Counter(r[0] for r in corpus() if r[0] is not None and root(r[0]) == r[0])
    assert None in kept and simhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize(("radius", "blocks", "tile"), [(3, 5, 4096), (3, 5, 40), (2, 4, 16), (5, 8, 64)])
def test_simhash_links_lose_nothing(spark, radius, blocks, tile):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.int64).view(np.uint64)
    near = [s ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))) for s in seeds for _ in range(30)]
    prints = np.unique(np.array(near, np.uint64))
    frame = spark.createDataFrame([(int(p.view(np.int64)), i) for i, p in enumerate(prints)], "fp long, rep long")
    got = {r[0]: r[1] for r in components(simhash.near_links(frame, radius, blocks, tile)).collect()}
    apart = np.bitwise_count(prints[:, None] ^ prints[None])
    label = np.arange(len(prints))
    while True:
        after = np.where(apart <= radius, label[None], len(prints)).min(axis=1)
        if (after == label).all():
            break
        label = after
    assert [got.get(i, i) for i in range(len(prints))] == label.tolist()


def test_carry_save_counts():
    rng = np.random.default_rng(9)
    a, b = (rng.integers(0, 1 << 63, n, dtype=np.int64).view(np.uint64) for n in (130, 333))
    b[:100] = a[:100] ^ np.uint64(7)
    for radius in (0, 1, 2, 3, 5, 31):
        want = np.bitwise_count(a[:, None] ^ b[None]) <= radius
        got = np.zeros_like(want)
        got[simhash.close_pairs(a, b, radius)] = True
        assert (got == want).all()
        assert (simhash.close_rows(a, b[:130], radius) == want[np.arange(130), np.arange(130)]).all()


def test_mixing(spark, docs, nothing):
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for r in corpus():
        sizes[r[3]] += len((r[1] or "").encode().split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values()), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] for s in full} or {s: level * weight[s] for s in open_}
        left, open_ = left - sum(2 * sizes[s] for s in full), open_ - full if full else set()
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    counts = Counter(r.doc_id for r in mixed.collect())
    for r in mixing.mix(docs, whole=True).dropDuplicates(["doc_id"]).collect():
        rows = sum(1 for x in corpus() if x[0] == r.doc_id)
        assert counts[r.doc_id] == rows * (r.taken // r["size"] if r["size"] else 1)
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0


def test_packing(spark, docs, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.pack(docs, length=64, open_windows=4, fan_in=2).collect()
    ids = {r[0]: np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4") for r in corpus()}
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        windows[r.sequence_id].append((r.offset, r.length))
    times = Counter(r[0] for r in corpus())
    for doc, found in pieces.items():
        covered = Counter(i for a, n in found for i in range(a, a + n))
        assert set(covered.values()) == {times[doc]} and len(covered) == len(ids[doc])
    assert pieces.keys() == ids.keys()
    for found in windows.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 64
    assert len(windows) * 64 < 1.1 * sum(n for w in windows.values() for _, n in w)
    assert packing.pack(nothing).count() == 0


def repeats_by_force(texts, window):
    seen, out = set(), {}
    for i in sorted(texts):
        w = texts[i].encode().split()
        covered = [False] * len(w)
        for a in range(len(w) - window + 1):
            k = tuple(w[a : a + window])
            covered[a : a + window] = [True] * window if k in seen else covered[a : a + window]
            seen.add(k)
        out[i] = (len(w), sum(covered), b" ".join(x for x, c in zip(w, covered, strict=True) if not c).decode())
    return out


@pytest.mark.parametrize("batch", ["10000", "2"])
def test_phrases(spark, docs, nothing, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = phrases.remove_repeats(docs).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = repeats_by_force(texts_by_id(), 20)
    assert len(got) == docs.count() and sum(r.n_removed for r in got) > 500
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_words, r.n_removed, r.kept) == want[r.doc_id]
            assert r.n_removed == sum(b - a for a, b in zip(r.from_word, r.to_word, strict=True))
    assert phrases.remove_repeats(nothing).count() == 0


def test_phrases_are_located_by_the_automaton():
    """Only windows whose chosen phrase is among the confirmed ones come out, whatever else the shard holds."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 900, n)) for n in (400, 19, 60)]
    for size in (3, 8, 11, 40):
        window = size + 12
        words = phrases.Words([t.encode() for t in texts], phrases.Rolling(1))
        windows, chosen, _ = words.anchors(phrases.Rolling(1), window, size)
        spelling = phrases.Spelling(size)
        some = np.unique(chosen)[::5]
        spelt = spelling.spell(spelling.letters(words.hashes), some)
        letters = spelling.text(spelling.letters(words.hashes))
        assert sorted(spelling.read(*spelt)) == sorted({letters[a * spelling.width : (a + size) * spelling.width] for a in some})
        rows = [{"p1": int(a), "p2": int(b)} for a, b in zip(*spelt, strict=True)]
        kind = pa.list_(pa.struct([("p1", pa.int64()), ("p2", pa.int64())]))
        batch = pa.RecordBatch.from_arrays([pa.array([7, 8, 9]), pa.array(texts), pa.array([rows, rows[:1], rows[:2]], kind)], ["doc_id", "text", "phrases"])
        (out,) = phrases._candidates(window, size)([batch])
        at = windows[np.isin(chosen, some)]
        assert len(at) > 30
        places = [t & ((1 << 31) - 1) for t in out.column(3).to_pylist()]
        assert list(zip(out.column(2).to_pylist(), places, strict=True)) == [([7, 8, 9][words.of[a]], words.place[a]) for a in at]


def vectors():
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 16))
    rows = [(i, (base[i % 60] + (0 if i % 5 == 0 else 0.12) * rng.standard_normal(16)).tolist(), i % 3 if i % 11 else None) for i in range(300)]
    rows += [(1000 + i, base[3].tolist(), 1) for i in range(40)]
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] + [1.0] * 15, 1), (2003, [float("inf")] * 16, 1), (2004, [], 1)]
    return [*rows, (2005, [None] + [1.0] * 15, 1), (2006, [1.0, 2.0], 1), (None, base[0].tolist(), 0)]


VECTORS = "vec_id long, embedding array<double>, label int"


def takes_part(v):
    return v is not None and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)


def test_quantised(spark):
    got = {r.vec_id: r for r in quantised.near_duplicates(spark.createDataFrame(vectors(), VECTORS), 0.93, tile=50).collect()}
    rows = [r for r in vectors() if r[0] is not None and takes_part(r[1]) and r[2] is not None]
    x = np.array([r[1] for r in rows])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    links = (u @ u.T >= 0.93) & (label[:, None] == label[None]) & ~np.eye(len(rows), dtype=bool)
    assert 500 < links.sum()
    ids = np.array([r[0] for r in rows])
    low = ids.copy()
    while True:
        after = np.minimum(low, np.where(links, low[None], 1 << 60).min(axis=1))
        if (after == low).all():
            break
        low = after
    for i, r in enumerate(rows):
        assert (got[r[0]].n_links, got[r[0]].component_id, got[r[0]].kept) == (links[i].sum(), low[i], low[i] == r[0])
    for r in vectors():
        if r[0] not in set(ids):
            assert (got[r[0]].n_links, got[r[0]].component_id) == (0, r[0])
    assert quantised.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_quantised_bounds_hold():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 1500)) * rng.random((200, 1))
    tile = quantised.Tile(x)
    cosine, doubt = tile.bounds(slice(0, 200), tile)
    true = tile.unit @ tile.unit.T
    assert (np.abs(cosine - true) <= doubt).all() and doubt.max() < 0.05


def test_hilbert_curve_is_one():
    for axes, bits in ((2, 5), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes), -1).reshape(-1, axes)
        keys = hilbert.hilbert_keys(grid, bits)
        assert sorted(keys.tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_hilbert_search(spark):
    frame = spark.createDataFrame([*vectors(), vectors()[0]], VECTORS)
    got = defaultdict(list)
    for r in hilbert.search(frame, every=10, k=5, block_rows=16, reach=0.3).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    rows = {r[0]: np.array(r[1]) for r in vectors() if r[0] is not None and takes_part(r[1])}
    right = total = 0
    for q in (i for i in rows if i % 10 == 0):
        near = sorted((float(np.sqrt(((rows[i] - rows[q]) ** 2).sum())), i) for i in rows if i != q)[:5]
        assert [x[0] for x in got[q]] == [1, 2, 3, 4, 5]
        assert all(s == pytest.approx(np.linalg.norm(rows[i] - rows[q]), abs=1e-12) for _, i, s in got[q])
        assert [(s, i) for _, i, s in got[q]] == sorted((s, i) for _, i, s in got[q])
        right += len({i for _, i in near} & {i for _, i, _ in got[q]})
        total += 5
    assert got.keys() == {i for i in rows if i % 10 == 0} and right >= 0.9 * total
    assert hilbert.search(spark.createDataFrame([], VECTORS)).count() == 0


def test_language(spark, docs, nothing):
    rng = random.Random(3)
    alphabets = {"aa": "abcdefghij", "bb": "efghijklmnopq", "cc": "xyzäöüabc"}
    rows = [(i, " ".join("".join(rng.choices(a, k=5)) for _ in range(40)), lang) for i, (lang, a) in enumerate(list(alphabets.items()) * 60)]
    rows += [(1000, None, "aa"), (1001, "", None), (1002, "12 !? 34", "bb"), (None, "abc", "cc"), (1003, "z", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(frame, langid.fit(frame)).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002))
    held = [r for r in rows[:180] if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == len(rows)
    assert langid.identify(nothing, langid.fit(nothing)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}


def toxic_corpus(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        w = words(rng, rng.randint(3, 60))
        bad = i % 5 == 0
        if bad:
            w.insert(rng.randint(0, len(w)), rng.choice(["vilehead", "grubface", "Muckmind!"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(9000, None), (9001, ""), (None, "vilehead"), (9002, "Oh, VILEHEAD")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")


def test_toxicity(spark, nothing):
    documents, labels = toxic_corpus(spark)
    index = toxicity.fit(documents, labels)
    got = {r.doc_id: r.toxicity for r in toxicity.score(documents, index).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].predicted == int(i % 5 == 0) for i in held)
    assert got[9002].predicted == 1 and got[None].predicted == 1 and len(got[9002].neighbours) == 15
    assert got[9000].score == got[9001].score < 0.1
    kept = {r.doc_id for r in toxicity.drop_toxic(documents, labels).collect()}
    assert {i for i in held if i % 5} <= kept and not {i for i in held if i % 5 == 0} & kept and 9000 in kept
    assert toxicity.drop_toxic(nothing, labels).count() == 0
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.toxicity.predicted for r in toxicity.score(documents, toxicity.fit(documents, empty)).collect()} <= {0, 1}


def test_toxicity_of_two_label_sets_in_one_session(spark):
    """Single terms have the weights [1.0] in every index; workers stay between jobs."""
    documents, labels = toxic_corpus(spark)
    indexes = [toxicity.fit(documents, labels), toxicity.fit(documents, labels.selectExpr("doc_id", "1 - toxic AS toxic"))]
    got = [{r.doc_id: r.toxicity for r in toxicity.score(documents.repartition(16), index).collect()} for index in indexes]
    for index, scores in zip(indexes, got, strict=True):
        own = index.score(b"Oh, VILEHEAD")
        assert (scores[9002].score, scores[9002].neighbours) == own[:2]
    assert got[0][9002].predicted == got[0][None].predicted == 1 and got[1][9002].predicted == got[1][None].predicted == 0


def test_block_max_neighbours_are_exact():
    rng = random.Random(4)
    vocabulary = {str(i).encode(): i for i in range(40)}
    places = [sorted(rng.sample(range(40), rng.randint(0, 6))) for _ in range(900)]
    counts = [[rng.randint(1, 3) for _ in p] for p in places]
    idf = np.array([1 + rng.random() * 3 for _ in range(40)])
    index = toxicity.Index(vocabulary, idf, list(range(900)), [i % 2 for i in range(900)], places, counts, 15)
    dense = np.zeros((900, 40))
    for i, (p, c) in enumerate(zip(places, counts, strict=True)):
        p, w = index.weights(p, c)
        dense[i, p] = w
    for q in range(0, 900, 30):
        p, w = index.weights(places[q], counts[q])
        if len(p):
            rows, cosines = index.nearest(p, w)
            all_cosines = dense @ dense[q]
            want = sorted((-round(c, 12), i) for i, c in enumerate(all_cosines) if c > 0)[:15]
            assert index.ids[rows].tolist() == [i for _, i in want]
            assert cosines == pytest.approx([all_cosines[i] for _, i in want])


PII = [
    "Mail a.b+c@x-y.example.com_x@y.zz, @no.pe a@b me@host.org.",
    "10.0.0.1 999.1.1.1 1.2.3.4.5.6.7.8 01.002.03.255 256.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 378282246310005",
    "+1 (755) 555-9729 +49 30 123456 - +1 23",
    "",
    None,
    "x" * 30_000 + "@" + "1" * 30_000,
]


def spans_by_force(text):
    import re

    digits = lambda m: re.sub(r"[^0-9]", "", m)
    check = lambda d: sum(n if i % 2 == 0 else sum(divmod(2 * n, 10)) for i, n in enumerate(int(c) for c in reversed(d))) % 10 == 0
    forms = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and check(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return sorted((m.start(), k, m.end()) for k, (form, ok) in enumerate(forms) for m in re.finditer(form, text) if ok(m.group()))


def test_pii_forms(spark, nothing):
    rows = [(i, t) for i, t in enumerate(PII)] + [(None, PII[0]), (0, PII[0])]
    got = pii.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, t in enumerate(PII[:6]):
        spans = spans_by_force(t or "")
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert by_id[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and by_id[i].spans == listed
        assert [by_id[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == n for s in spans) for n in range(4)]
    assert pii.digests(nothing).count() == 0


def test_pii_discovers_by_context(spark):
    """Cards stand behind one phrase; so does a number of another form, which also stands alone elsewhere."""
    cards = ["4111111111111111", "5555555555554444", "378282246310005", "6011111111111117", "4012888888881881", "4222222222222220"]
    rows = [(i, f"words before charged card {c} was billed") for i, c in enumerate(cards)]
    rows += [(100, "then charged card XK-99-1234-77 was billed"), (101, "see XK-99-1234-77 there"), (102, "room 12-4567-89 is free")]
    got = {r.doc_id: r.spans for r in pii.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == "card:18:31" and got[101] == "card:4:17" and got[102] == ""


def test_pii_discovers_by_contexts_of_what_it_found(spark):
    """No seed stands behind the second phrase: only what the first one gave away."""
    cards = [next(c for c in (f"40000000000{i:02d}00{d}" for d in range(10)) if pii.luhn(c)) for i in range(12)]
    first = [f"XK-{i}9-1234-77" for i in range(4)]
    rows = [(i, f"words before charged card {c} was billed") for i, c in enumerate([*cards, *first])]
    rows += [(100 + i, f"sums paid from {t} today") for i, t in enumerate([*first, "QQ-55-4321"])] + [(200, "room 12-4567-89 is free")]
    got = {r.doc_id: r.spans for r in pii.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == "card:15:28" and got[104] == "card:15:25" and got[200] == ""


def test_neighbours_at_one_distance(spark):
    """All others equally far: the smallest ids; and an id that two vectors share, each with its own distance."""
    unit = [(i, [float(i == j) for j in range(64)]) for i in range(64)]
    rows = [(100 if i == 63 else i, v) for i, v in unit]
    got = hilbert.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=100, k=10).collect()
    assert sorted((r.rank, r.vec_id) for r in got if r.query_id == 100) == [(n + 1, n) for n in range(10)]
    rows = [(5, [1.0, 0.0]), (6, [1.0, 0.0]), (5, [0.0, 1.0]), (7, [0.0, 1.0]), (10, [1.0, 0.1])]
    got = hilbert.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=10, k=10).orderBy("rank").collect()
    assert [(r.vec_id, round(r.score, 3)) for r in got] == [(5, 0.1), (6, 0.1), (5, 1.345), (7, 1.345)]
    far = [(i, [1e8 + i * 1e-3, 1e8]) for i in range(40)]  # a common offset that squares would drown in
    got = hilbert.search(spark.createDataFrame(far, "vec_id long, embedding array<double>"), every=20, k=3).collect()
    gaps = sorted((abs(far[20][1][0] - v[0]), i) for i, v in far if i != 20)
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 20] == [i for _, i in gaps[:3]]


def test_toxicity_drops_nothing_without_evidence(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} text", "x") for i in range(60)], "doc_id long, text string, toxicity string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.drop_toxic(docs, none).count() == 60
    half = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")  # no word tells them apart
    alike = docs.withColumn("text", docs.toxicity)
    assert toxicity.drop_toxic(alike, half).count() == 60
    assert toxicity.drop_toxic(docs, none).columns == docs.columns


def test_toxicity_of_few_labels_and_repeated_ids(spark):
    """Under thirty labelled rows, toxic ones with one word in common; one id on many rows is one example."""
    rows = [(i, f"plain talk {i} " + ("vilehead" if i % 3 == 0 else "kindly")) for i in range(40)] + [(3, f"vilehead again {n}") for n in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(29)], "doc_id long, toxic int")
    index = toxicity.fit(docs, labels)
    assert len(index.ids) <= 29
    got = {r.doc_id for r in toxicity.drop_toxic(docs, labels).collect()}
    assert got == {i for i in range(40) if i % 3}


def test_language_sample_is_bounded_by_rows(spark):
    """One id on many rows, and more languages than the driver could hold unpacked."""
    rows = [(1, f"so many words of row {n} here", "en") for n in range(600)] + [(2 + i, f"lingua{i} lingua{i} parla {chr(97 + i % 26) * 5}", f"l{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, per_language=16)
    assert "en" in model.names and len(model.names) > 20
    plain = np.random.default_rng(1).integers(0, 2, (50, 64), dtype=np.uint8)
    packed = np.packbits(plain, axis=1)
    names = ["a" if r[:8].sum() > 4 else "b" for r in plain]
    one, many = (langid.Classifier(packed, names, 16, 1e-3, 3, at_once=n) for n in (7, 1000))
    assert np.allclose(one.scores(plain), many.scores(plain))
    # the kernel, the landmarks' map and the ridge against their plain forms
    inner = plain.astype(float) @ plain[:0:-1].T.astype(float)
    assert np.allclose(langid.kernel(plain, plain[:0:-1]), inner / np.sqrt(plain.sum(1))[:, None] / np.sqrt(plain[:0:-1].sum(1)), atol=1e-5)


def test_packing_looks_a_known_chunk_up_once():
    """The ids of known chunks cost one look-up each; fresh ones, also repeated or in odd forms, get the tokenizer's."""
    from promptloom.llm.packing import TOKENIZER, ChunkTokens

    class Counted(dict):
        asked = 0

        def get(self, key, default=None):
            self.asked += 1
            return super().get(key, default)

        def __getitem__(self, key):
            self.asked += 1
            return super().__getitem__(key)

        def __contains__(self, key):
            self.asked += 1
            return super().__contains__(key)

    texts = ["one two, two (three) it's 'tis", "", "Über <| x <|y z\u0301 \U0001f600! a1 <|", "two two one \x0b\x0c zz\x1cq \x85 end"]
    tokens = ChunkTokens(TOKENIZER)
    want = [np.array(tokens.tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert tokens([x.encode() for x in texts]) == want
    tokens.known = Counted(tokens.known)
    assert tokens([x.encode() for x in texts]) == want
    assert 0 < tokens.known.asked <= sum(len(x.encode().split()) for x in texts)


def test_packing_looks_up_and_tokenises_distinct_atoms_only(monkeypatch):
    """Words, signs and digits that come again, in whatever company, cost one look-up a batch and are tokenised once."""
    asked = Counter()

    class Counted(dict):
        def get(self, key, default=None):
            asked[key] += 1
            return super().get(key, default)

    tokens = packing.ChunkTokens(packing.TOKENIZER)
    tokens.known = Counted()
    learned = []
    for name in ("_encode", "_encode_letters"):
        monkeypatch.setattr(tokens, name, lambda atoms, by=getattr(tokens, name): learned.extend(atoms) or by(atoms))
    texts = ["Word " * 50 + "word, (word) word2 größe", "word22word\tGröße. (größe, 2)", "it's " * 9]
    want = [np.array(tokens.tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert tokens([x.encode() for x in texts]) == want
    assert sorted(learned) == sorted(x.encode() for x in ("word", "größe", ",", "(", ")", "2", "it's", "."))
    assert set(asked.values()) == {1}
    assert tokens([x.encode() for x in texts]) == want
    assert len(learned) == 8 and set(asked.values()) == {2}


def test_packing_ids_of_odd_texts(monkeypatch):
    """Ids equal to the tokenizer's on texts of odd bytes, marks, cases and special names; cut in blocks, and forgotten."""
    rng = random.Random(7)
    some = [*"abTWhIJ09 \t\n\x0b'\"!<|>-_.,\x00\x1c\x7f\x85\xa0\xdf\xc4\xe4\xf1\xd7\xf7\xff\u0100", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'T"]
    some += "\u0301\u0308\u0344\u0341\u212a\u0130\u03a3\u4e2d\ud55c\u1100\u1161\U0001f600\u0663\xb2\u2003\ufeff\u01c4"
    texts = ["", " ", "T\u0344 t\u0344 J\u0341", *("".join(rng.choices(some, k=rng.randint(1, 40))) for _ in range(1500))]
    tokens = packing.ChunkTokens(packing.TOKENIZER)
    want = [np.array(tokens.tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert tokens([]) == [] and tokens([b""]) == [b""]
    assert tokens([x.encode() for x in texts]) == want
    monkeypatch.setattr(packing, "BLOCK", 16)
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    assert tokens([x.encode() for x in texts]) == want
    assert len(tokens.known) < 200
