"""DuckDB reference SQL of the operators that SQL can express. The others rest on hashes that DuckDB lacks, learned
scores or token ids; tests/llm holds them against brute-force versions."""

from promptloom.llm.secrets import BASE, ENDPOINTS, FORMS, KINDS, WEAK

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORD = r"[^\x20\x09-\x0D]+"

OP4 = rf"""
WITH texts AS (SELECT doc_id, string_split(coalesce(text, ''), E'\n') AS l FROM documents),
lines AS (SELECT doc_id, generate_subscripts(l, 1) AS place, unnest(l) AS line FROM texts),
keyed AS (
  SELECT doc_id, place, line, translate(trim(line, E' \t\n\x0B\f\r'), '{_UPPER}', '{_UPPER.lower()}') AS k FROM lines),
shared AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT doc_id, place, line, coalesce(keeper <> doc_id, false) AS dropped FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, E'\n' ORDER BY place) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

OP5 = """
WITH vectors AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reached AS (
  WITH RECURSIVE r(vec_id, other) AS (
    SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN links l ON r.other = l.a)
  SELECT vec_id, min(other) AS component_id FROM r GROUP BY vec_id),
counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN reached USING (vec_id) LEFT JOIN counted USING (vec_id)
"""

OP6 = rf"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
windows AS (
  SELECT doc_id, place, array_to_string(w[place:place + 19], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS place FROM texts)),
later AS (
  SELECT doc_id, place FROM windows QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, place) > 1),
covered AS (SELECT DISTINCT doc_id, place + step AS place FROM later, range(0, 20) steps(step)),
words AS (SELECT doc_id, generate_subscripts(w, 1) AS place, unnest(w) AS word FROM texts),
judged AS (
  SELECT doc_id, place, word, c.place IS NOT NULL AS removed
  FROM words LEFT JOIN covered c USING (doc_id, place)),
summed AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (removed) AS gone,
    string_agg(word, ' ' ORDER BY place) FILTER (NOT removed) AS kept
  FROM judged GROUP BY doc_id)
SELECT t.doc_id, coalesce(n, 0) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts t LEFT JOIN summed USING (doc_id)
"""

OP11 = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
numbered AS (
  SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
words AS (SELECT lang, id, generate_subscripts(w, 1) AS place, unnest(w) AS word FROM numbered),
following AS (
  SELECT lang, word AS one, lead(word) OVER p AS two, lead(word, 2) OVER p AS three
  FROM words WINDOW p AS (PARTITION BY id ORDER BY place)),
grams AS (
  SELECT lang, 1 AS k, one AS phrase, count(*) AS f FROM following GROUP BY ALL
  UNION ALL SELECT lang, 2, one || ' ' || two, count(*) FROM following WHERE two IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, one || ' ' || two || ' ' || three, count(*) FROM following WHERE three IS NOT NULL GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE k >= 2 AND f >= 10),
parts AS (
  SELECT c.*, cut, x.f AS l, y.f AS r,
    CAST((CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM candidates c JOIN range(1, 3) cuts(cut) ON cut < c.k
  JOIN grams x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[:cut], ' ')
  JOIN grams y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1:], ' ')),
lowest AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_phrases AS (
  SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM candidates WHERE k = 3),
longer AS (SELECT lang, phrase, max(a) AS most FROM inner_phrases GROUP BY ALL),
ranked AS (
  SELECT x.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM lowest x LEFT JOIN longer USING (lang, phrase) WHERE k = 3 OR coalesce(100 * most < 50 * a, true))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""



def _forms(forms) -> str:
    return ", ".join(str(FORMS.index(f)) for f in forms)


def _matches(number: int) -> str:
    form = FORMS[number]
    pattern = form.pattern.replace("'", "''")
    good = " AND ".join([f"length(value) >= {form.least}", *[f"regexp_matches(part, '{needed}')" for needed in form.needs]])
    return f"""SELECT id, {number} AS form, i, gap, part, {good} AS ok FROM (
      SELECT id, generate_subscripts(m, 1) AS i, unnest(g[1:len(m)]) AS gap, unnest(m) AS part, unnest(v) AS value FROM (
        SELECT id, regexp_extract_all(t, '{pattern}') AS m, regexp_split_to_array(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}', 1) AS v
        FROM texts))"""


_APART = "greatest(a.start, b.start) - least(a.stop, b.stop)"
_IDS = _forms(f for f in FORMS if f.role == "id")
OP12 = f"""
WITH texts AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
matches AS ({" UNION ALL ".join(_matches(n) for n in range(len(FORMS)))}),
spans AS (
  SELECT id, form, stop - length(part) AS start, stop FROM (
    SELECT *, sum(length(gap) + length(part)) OVER (PARTITION BY id, form ORDER BY i) AS stop FROM matches) WHERE ok),
free AS (
  SELECT a.*, EXISTS (SELECT 1 FROM spans b WHERE b.id = a.id AND b.form IN ({_forms(ENDPOINTS)}) AND {_APART} <= 256) AS anchored
  FROM spans a WHERE form IN ({_forms(WEAK)})
    AND NOT EXISTS (SELECT 1 FROM spans b WHERE b.id = a.id AND b.form IN ({_forms(BASE)}) AND {_APART} < 0)),
parts AS (
  SELECT *, false AS strong FROM free UNION ALL SELECT *, false, true FROM spans WHERE form IN ({_forms(BASE)})),
linked AS (
  SELECT a.id, a.form, a.start, a.stop FROM parts a WHERE NOT a.strong AND EXISTS (
    SELECT 1 FROM parts b WHERE b.id = a.id AND {_APART} <= 256 AND (a.form IN ({_IDS})) <> (b.form IN ({_IDS}))
      AND (b.strong OR a.anchored AND b.anchored))),
listed AS (
  SELECT id, form, [{", ".join(repr(f.kind) for f in FORMS)}][form + 1] AS kind, start, stop FROM spans WHERE form IN ({_forms(BASE)})
  UNION ALL SELECT id, form, [{", ".join(repr(f.kind) for f in FORMS)}][form + 1], start, stop FROM linked),
texted AS (SELECT *, list_position([{", ".join(map(repr, KINDS))}], kind) AS place, concat_ws(':', kind, CAST(start AS BIGINT), CAST(stop AS BIGINT)) AS span FROM listed)
SELECT doc_id, {", ".join(f"count(*) FILTER (form = {k}) AS n_{f.kind}" for k, f in enumerate(BASE))},
  sha256(coalesce(string_agg(span, ',' ORDER BY start, place, stop) FILTER (form < {len(BASE)}), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY start, place, stop), '') AS spans
FROM texts LEFT JOIN texted USING (id) GROUP BY id, doc_id
"""

OP13 = """
WITH rows AS (
  SELECT row_number() OVER () AS id, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS v,
    CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.id AS a, a.vec_id AS anchor_id, b.id AS b, b.vec_id, a.label = b.label AS same,
    CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.id <> b.id AND len(a.v) = len(b.v)),
positives AS (
  SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, b) <= 5),
ranked AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, n.vec_id AS negative_id, n.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank
  FROM positives p JOIN scores n ON p.a = n.a AND NOT n.same
    AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""

ORACLE: dict[str, str] = {"op4_line_dedup": OP4, "op5_quantised": OP5, "op6_phrases": OP6, "op11_collocations": OP11, "op12_secrets": OP12, "op13_negatives": OP13}
