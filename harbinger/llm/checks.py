"""DuckDB's way to the rows of those queries that SQL can express."""

from __future__ import annotations

from harbinger.llm import licenses


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def license_check() -> str:
    known = ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in sorted(licenses.known_sentences().items()))
    rules = licenses.rule_sequences()
    steps = ",\n".join(
        f"  contains(r{i}, {quoted(s)}) AS h{i}, replace(r{i}, {quoted(s)}, '#') AS r{i + 1}" for i, (_, s) in enumerate(rules)
    )
    names = sorted({n for n, _ in rules})
    found = ", ".join(
        "CASE WHEN " + " OR ".join(f"h{i}" for i, (n, _) in enumerate(rules) if n == name) + f" THEN {quoted(name)} END"
        for name in names
    )
    cue = quoted(licenses.CUE)
    return f"""
WITH known AS (SELECT MAP {{{known}}} AS m),
cut AS (
  SELECT doc_id, list_filter(list_transform(string_split(
           regexp_replace(regexp_replace(text, {quoted(licenses.WRAPPED)}, '\\1 \\2', 'g'),
                          {quoted(licenses.ENDING)}, '\\1' || chr(10), 'g'), chr(10)),
           lambda s: trim(regexp_replace(lower(s), {quoted(licenses.DROPPED)}, ' ', 'g'))), lambda s: s <> '') AS parts
  FROM documents WHERE regexp_matches(text, {cue})),
spoken AS (
  SELECT doc_id, m, list_filter(parts, lambda s: regexp_matches(s, {cue}) OR m[s] IS NOT NULL) AS parts FROM cut, known),
ids AS (
  SELECT doc_id, len(parts) AS n, list_filter(list_transform(parts, lambda s: m[s]), lambda x: x IS NOT NULL) AS ids
  FROM spoken),
matched AS (
  SELECT *, coalesce(array_to_string(list_transform(ids, lambda x: '|' || x || '|'), ''), '') AS r0,
{steps}
  FROM ids)
SELECT d.doc_id, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
       coalesce(concat_ws(',', {found}), '') AS licenses,
       coalesce(n - len(ids), 0) AS n_unknown
FROM documents d LEFT JOIN matched m ON d.doc_id = m.doc_id"""


MIX_CHECK = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::VARCHAR) AS h
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
  FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST) AS k,
         sum(2.0 * source_size::DOUBLE) OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST) AS held,
         sum(w) OVER (ORDER BY 2.0 * source_size / w DESC, source DESC NULLS FIRST) - w AS unused,
         sum(w) OVER () - sum(w) OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST) AS rest,
         sum(source_size) OVER () AS total
  FROM sources),
rates AS (
  SELECT 0 AS k, 1.5::DOUBLE * sum(source_size) / sum(w) AS rate FROM sources
  UNION ALL SELECT k, (1.5::DOUBLE * total - held) / rest FROM ranked WHERE rest > 0),
chosen AS (
  SELECT r.rate FROM rates r JOIN ranked n ON n.k = r.k + 1 WHERE 2.0 * n.source_size > n.w * r.rate ORDER BY r.k LIMIT 1),
plan AS (
  SELECT source, source_size, least(2.0 * source_size::DOUBLE, w * coalesce((SELECT rate FROM chosen)::DOUBLE, 'infinity'::DOUBLE)) AS target
  FROM sources),
laid AS (
  SELECT doc_id, source, size,
         coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized)
SELECT doc_id, size::BIGINT AS size, source_size, target::DOUBLE AS target,
       CASE WHEN source_size = 0 THEN 0 ELSE (round(target)::BIGINT // source_size) * size
         + greatest(least(start + size, round(target)::BIGINT % source_size) - start, 0) END::BIGINT AS taken
FROM laid l JOIN plan p ON l.source IS NOT DISTINCT FROM p.source"""


DECONTAMINATION_CHECK = r"""
WITH docs AS (
  SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}]+', ' ', 'g')), ' ') AS w
  FROM documents WHERE trim(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}]+', ' ', 'g')) <> ''),
items AS (
  SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}]+', ' ', 'g')), ' ') AS w
  FROM benchmark WHERE trim(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}]+', ' ', 'g')) <> ''),
ds AS (
  SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS p FROM docs),
dh AS (SELECT doc_id, p, array_to_string(w[p + 1 : p + 5], ' ') AS s FROM ds),
its AS (
  SELECT item_id, w, unnest(range(greatest(len(w) - 4, 1))) AS q FROM items),
ih AS (SELECT item_id, len(w) AS n, q, array_to_string(w[q + 1 : q + 5], ' ') AS s FROM its),
starts AS (
  SELECT DISTINCT doc_id, item_id, n, p - q AS d FROM dh JOIN ih USING (s)),
windows AS (
  SELECT DISTINCT doc_id, item_id, n, greatest(least(d, len(w) - n), 0) AS a, w FROM starts JOIN docs USING (doc_id)),
shingled AS (
  SELECT doc_id, item_id, a,
         list_distinct(list_transform(range(greatest(len(w[a + 1 : a + n]) - 4, 1)), lambda i: array_to_string(w[a + 1 : a + n][i + 1 : i + 5], ' '))) AS x
  FROM windows),
wanted AS (SELECT item_id, list_distinct(list(s)) AS y FROM ih GROUP BY item_id),
weighed AS (
  SELECT doc_id, item_id,
    list_sum(list_transform(list_intersect(x, y), lambda s: length(replace(s, ' ', ''))))::DOUBLE AS shared,
    list_sum(list_transform(x, lambda s: length(replace(s, ' ', ''))))::DOUBLE AS a,
    list_sum(list_transform(y, lambda s: length(replace(s, ' ', ''))))::DOUBLE AS b
  FROM shingled JOIN wanted USING (item_id))
SELECT doc_id, item_id, round(max(shared / (a + b - shared)), 6) AS similarity
FROM weighed WHERE shared / (a + b - shared) >= 0.8 GROUP BY doc_id, item_id"""


NEAR_CHECK = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
spread AS (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS p FROM words WHERE len(w) > 0),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[p + 1 : p + 5], ' ') AS s FROM spread),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(m, doc_id)) AS class_id, coalesce(n, 0) AS n_links
FROM documents LEFT JOIN least ON least.a = doc_id LEFT JOIN counted ON counted.a = doc_id"""


def lloyd_check(rounds: int = 6, parts: int = 8, entries: int = 16) -> str:
    """Plain rounds over every part and entry, in integers."""
    nearest = (
        "SELECT p.id, p.part, arg_min(b.entry, (d.gap, b.entry)) AS entry, min(d.gap) AS gap FROM pieces p "
        "JOIN book{k} b ON b.part = p.part, LATERAL (SELECT list_sum(list_transform(range(1, len(p.x) + 1), "
        "lambda j: (p.x[j] - b.x[j]) * (p.x[j] - b.x[j]))) AS gap) d GROUP BY p.id, p.part"
    )
    steps = [
        f"""WITH kept AS (
          SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 4096) AS BIGINT)) AS v,
                 row_number() OVER (ORDER BY vec_id) AS id
          FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), pieces AS (
          SELECT id, CAST(part AS BIGINT) AS part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS x
          FROM kept, range({parts}) r(part)
        ), book0 AS (SELECT part, id - 1 AS entry, x FROM pieces WHERE id <= {entries})"""
    ]
    for k in range(rounds):
        steps.append(
            f"""near{k} AS MATERIALIZED ({nearest.format(k=k)}), parts{k} AS (
              SELECT n.part, n.entry, j, sum(p.x[j]) AS s, count(*) AS n FROM near{k} n JOIN pieces p USING (id, part),
                     range(1, 1 + (SELECT max(len(x)) FROM pieces)) r(j) GROUP BY n.part, n.entry, j
            ), means{k} AS (
              SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS x FROM parts{k} GROUP BY part, entry
            ), book{k + 1} AS MATERIALIZED (
              SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN means{k} m USING (part, entry)
            )"""
        )
    steps.append(
        f"""last AS ({nearest.format(k=rounds)}), coded AS (
          SELECT k.vec_id, k.label, string_agg(printf('%02x', l.entry), '' ORDER BY l.part) AS code, CAST(sum(l.gap) AS BIGINT) AS error
          FROM last l JOIN kept k USING (id) GROUP BY l.id, k.vec_id, k.label
        ), hashed AS (
          SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS h FROM book{rounds}
        )
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
        FROM coded, hashed"""
    )
    return ",\n".join(steps)
