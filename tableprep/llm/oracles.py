"""SQL that the text queries must agree with, where SQL can express them. Each states its own constants."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_HITS = f"""
WITH items AS (SELECT item_id::VARCHAR AS item_id, {_PLAIN} AS w FROM benchmark),
win AS (
  SELECT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM items, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i) WHERE len(w) > 0),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_PLAIN} AS w FROM documents),
ks AS (SELECT DISTINCT k FROM win),
spots AS (
  SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM docs, ks, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i)),
hits AS (SELECT DISTINCT s.r, s.k, s.i, win.item_id FROM spots s JOIN win ON s.k = win.k AND s.g = win.g)"""

DECONTAMINATION = f"""{_HITS},
words AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, k, i FROM hits)) GROUP BY r),
found AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r)"""

_PIECE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CONTAMINATED_SPANS = f"""{_HITS},
hit_words AS (SELECT DISTINCT r, unnest(range(i, i + k)) AS p FROM hits),
runs AS (
  SELECT r, min(p) AS a, max(p) AS b FROM (SELECT r, p, p - row_number() OVER (PARTITION BY r ORDER BY p) AS run FROM hit_words) GROUP BY r, run),
cut AS (SELECT r, regexp_extract_all(t, '{_PIECE}|{_GAP}') AS c FROM docs WHERE r IN (SELECT r FROM runs)),
pieces AS (SELECT r, unnest(c) AS x, unnest(range(1, len(c) + 1)) AS i FROM cut),
placed AS (
  SELECT r, i, regexp_full_match(x, '{_PIECE}') AS word,
    sum(length(x)) OVER (PARTITION BY r ORDER BY i) AS ends, length(x) AS n FROM pieces),
words AS (SELECT r, row_number() OVER (PARTITION BY r ORDER BY i) AS p, (ends - n)::BIGINT AS starts, ends::BIGINT AS ends FROM placed WHERE word)
SELECT doc_id, x.starts AS span_start, y.ends AS span_end, (b - a + 1)::BIGINT AS n_words
FROM runs JOIN docs USING (r) JOIN words x ON x.r = runs.r AND x.p = a JOIN words y ON y.r = runs.r AND y.p = b"""

LINE_FREQUENCY = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
raw_lines AS (SELECT r, host, unnest(string_split(t, chr(10))) AS line FROM docs),
lines AS (
  SELECT r, host, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw,
    array_to_string(regexp_extract_all(regexp_replace(
      translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g'), '[^\x20\x09-\x0D]+'), ' ') AS norm
  FROM raw_lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
doubles AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY r),
windows AS (
  SELECT r, i, array_to_string(w[i:i + 2], ' ') AS g FROM docs, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i)),
again AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
repeats AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r),
frequent AS (SELECT host, norm FROM lines GROUP BY host, norm HAVING count(DISTINCT r) >= 10),
removed AS (SELECT r, sum(len(lw)) AS n FROM lines JOIN frequent USING (host, norm) GROUP BY r),
base AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(d.n, 0)::BIGINT AS n_dup_lines,
    coalesce(p.n, 0)::BIGINT AS n_repeat_words, coalesce(v.n, 0)::BIGINT AS removed_words
  FROM docs LEFT JOIN doubles d USING (r) LEFT JOIN repeats p USING (r) LEFT JOIN removed v USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (n_words - removed_words < 20 OR removed_words > 0.5 * n_words) AS kept
FROM base"""

_HEAD = "'<|' || replace(x.role, '<|', '< |') || '|>' || chr(10)"
_BODY = "replace(x.text, '<|', '< |') || '<|end|>' || chr(10)"


def _shown(turns: str) -> str:
    return f"array_to_string(list_transform({turns}, lambda x: {_HEAD} || {_BODY}), '')"


def _mask(turns: str) -> str:
    sign = "CASE WHEN x.role = 'assistant' THEN '+' ELSE '-' END"
    return f"array_to_string(list_transform({turns}, lambda x: length({_HEAD})::VARCHAR || '-' || length({_BODY})::VARCHAR || {sign}), '')"


PREFERENCES = f"""
WITH said AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations),
talks AS (
  SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, role, text) AS t FROM said GROUP BY conv_id),
ends AS (SELECT *, coalesce(list_max(list_filter(range(1, len(t) + 1), lambda i: t[i].role = 'assistant')), 0) AS last FROM talks),
heads AS (SELECT *, CASE WHEN last > 0 THEN t[1:last] ELSE t END AS c, CASE WHEN last > 1 THEN t[1:last - 1] ELSE [] END AS h FROM ends),
alts AS (
  SELECT *, coalesce(list_filter(h, lambda x: x.role = 'assistant')[-1].text, list_filter(h, lambda x: x.role = 'user')[-1].text, '') AS other FROM heads),
pairs AS (
  SELECT conv_id, c, CASE WHEN last > 0 THEN list_concat(h, [struct_pack(role := 'assistant', text := other)]) ELSE c END AS j FROM alts),
cut AS (
  SELECT *, coalesce(list_min(list_filter(range(1, len(c) + 1), lambda i: c[i] IS DISTINCT FROM j[i])) - 1, len(c)) AS n FROM pairs)
SELECT conv_id, n::BIGINT AS n_prompt_turns, {_shown('c[1:n]')} AS prompt, {_shown('c[n + 1:]')} AS chosen, {_mask('c[n + 1:]')} AS chosen_mask,
  {_shown('j[n + 1:]')} AS rejected, {_mask('j[n + 1:]')} AS rejected_mask, c IS DISTINCT FROM j AS usable
FROM cut"""

NGRAM_JOIN = rf"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT r, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS g
  FROM docs, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i) WHERE len(w) > 0),
sizes AS (SELECT r, count(*) AS n FROM sets GROUP BY r),
shared AS (SELECT x.r AS a, y.r AS b, count(*) AS c FROM sets x JOIN sets y ON x.g = y.g AND x.r <> y.r GROUP BY x.r, y.r),
links AS (
  SELECT a, b FROM shared JOIN sizes m ON m.r = a JOIN sizes n ON n.r = b WHERE 100 * c >= 75 * (m.n + n.n - c)),
reach AS (SELECT r AS a, r AS b FROM docs UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least_id AS (SELECT reach.a AS r, min(docs.doc_id) AS component_id FROM reach JOIN docs ON docs.r = reach.b GROUP BY reach.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM docs LEFT JOIN sizes USING (r) JOIN least_id USING (r)"""

DISPLACEMENT = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
units AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '(?s)[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM docs),
drawn AS (
  SELECT r, doc_id, t, u, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b,
    ('0x' || h[17:24])::BIGINT % 100 AS c, ('0x' || h[25:32])::BIGINT % 100 AS d
  FROM units),
parts AS (
  SELECT doc_id, t, n, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m,
    array_to_string(u[greatest(a, b) + 1:], '') AS s,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts"""
