"""SQL for another engine that gives the rows of the queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = rf"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
places AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM base),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM places),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM
  (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE n > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM
  (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM base)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
measured AS (SELECT b.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(l.n, 0) AS n_lines, coalesce(l.dup, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM base b LEFT JOIN lines l USING (doc_id) LEFT JOIN covered c USING (doc_id)),
ledger AS (SELECT *, CAST(
  CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
  + CASE WHEN 100 * n_symbols > 10 * word_chars THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
  + CASE WHEN word_chars > 40 * n_words THEN 16 ELSE 0 END + CASE WHEN 2 * word_chars < 3 * n_words THEN 32 ELSE 0 END AS BIGINT) AS failed_bits
  FROM measured)
SELECT *, failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept FROM ledger
"""


def _escaped(text: str) -> str:
    from spindlewise.llm.chat_format import ESCAPES

    for plain, safe in ESCAPES:
        text = f"replace({text}, '{plain}', '{safe}')"
    return text


OP2 = f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS DISTINCT FROM role AS starts FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length({_escaped("text")}) + CASE WHEN starts
    THEN length('<|turn|>' || {_escaped("role")} || '<|text|>' || '<|end|>' || chr(10)) ELSE length('<|next|>') END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""

OP4 = rf"""
WITH RECURSIVE base AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM base WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM base WHERE len(w) BETWEEN 1 AND 4)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least_id AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a, min(b) AS least_id FROM reach GROUP BY a) ON a = d.doc_id
"""

OP7 = f"""
WITH base AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM base
"""

OP9 = """
WITH base AS (SELECT page_id, coalesce(html, '') AS h, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
firsts AS (SELECT page_id, h, n, min(page_id) OVER (PARTITION BY h) AS f FROM base)
SELECT page_id, n AS payload_bytes, sha256(h) AS payload_digest,
  CASE WHEN n >= 100 AND f < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND f < page_id THEN f END AS refers_to FROM firsts
"""

_LICENSE_WORDS = r"regexp_extract_all(translate(coalesce({text}, ''), '%s', '%s'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')" % (_UPPER, _LOWER)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _licenses() -> str:
    from spindlewise.llm.license_scan import LEAST_STEP, PHRASES, TEMPLATES, THRESHOLD

    phrases = ", ".join(f"(string_split('{phrase}', ' '), '{label}')" for phrase, label in PHRASES.items())
    templates = ", ".join(f"({number}, {_quoted(t.label)}, {_quoted(t.text)})" for number, t in enumerate(TEMPLATES))
    return f"""
WITH base AS (SELECT doc_id, {_LICENSE_WORDS.format(text="text")} AS w FROM documents),
phrases(p, label) AS (VALUES {phrases}),
places AS (SELECT doc_id, label, i FROM (SELECT doc_id, w, p, label, unnest(range(1, len(w) - len(p) + 2)) AS i FROM base, phrases)
  WHERE w[i:i + len(p) - 1] = p),
named AS (SELECT doc_id, count(*) AS n, min(i) - 1 AS first, max(i) - 1 AS last, list(DISTINCT label) AS labels FROM places GROUP BY doc_id),
given(template, label, text) AS (VALUES {templates}),
split AS (SELECT template, label, {_LICENSE_WORDS.format(text="text")} AS w FROM given),
sets AS (SELECT template, label, list_distinct(w) AS t, len(w) AS n FROM split),
steps AS (SELECT *, greatest({LEAST_STEP}, CAST(pow(2, ceil(log2(n))) AS BIGINT)) AS step FROM sets),
blocks AS (SELECT doc_id, step, list_distinct(w[k * step + 1:(k + 2) * step]) AS b FROM (
  SELECT doc_id, w, step, unnest(range(0, CAST(ceil(len(w) / step) AS BIGINT))) AS k FROM base, (SELECT DISTINCT step FROM steps))),
shared AS (SELECT doc_id, label, len(t) AS size, len(list_intersect(b, t)) AS overlap FROM blocks JOIN steps USING (step)),
met AS (SELECT doc_id, list(DISTINCT label) AS labels, max(overlap / size) AS share FROM shared
  WHERE 100 * overlap >= {THRESHOLD} * size GROUP BY doc_id)
SELECT b.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, first AS first_word, last AS last_word,
  coalesce(array_to_string(list_sort(named.labels), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(named.labels, []), coalesce(met.labels, [])))), ',') AS labels,
  CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0) END AS score
FROM base b LEFT JOIN named USING (doc_id) LEFT JOIN met USING (doc_id)
"""
OP12 = """
WITH rows AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN pairs n USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 3
"""


def _grams(n: int) -> str:
    return f"""SELECT lang, {n} AS length, array_to_string(w[i:i + {n} - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM pieces) GROUP BY ALL HAVING count(*) >= 30"""


OP13 = rf"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
pieces AS (SELECT lang, regexp_extract_all(p, '[^ 	]+') AS w FROM
  (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?
-
]')) AS p FROM texts)),
grams AS ({" UNION ALL ".join(_grams(n) for n in (1, 2, 3, 4))}),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
cuts AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, length)) AS k FROM grams WHERE length > 1),
halves AS (SELECT c.lang, c.phrase, a, k, h.f AS l, t.f AS r, CAST(CAST(2000000 AS HUGEINT) * a // (h.f + t.f) AS BIGINT) AS score FROM cuts c
  JOIN grams h ON h.lang = c.lang AND h.phrase = array_to_string(w[1:k], ' ')
  JOIN grams t ON t.lang = c.lang AND t.phrase = array_to_string(w[k + 1:], ' ')),
weakest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM halves),
parts AS (SELECT lang, f, w, length, i, unnest(range(2, length)) AS m FROM
  (SELECT lang, f, string_split(phrase, ' ') AS w, length, unnest(range(1, length)) AS i FROM grams WHERE length > 2)),
shadows AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(f) AS longer FROM parts WHERE i + m - 1 <= length GROUP BY ALL),
ranked AS (SELECT w.*, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, w.phrase) AS rank
  FROM weakest w LEFT JOIN shadows s ON s.lang = w.lang AND s.phrase = w.phrase
  WHERE place = 1 AND (longer IS NULL OR CAST(100 AS HUGEINT) * longer < CAST(80 AS HUGEINT) * a))
SELECT r.lang, rank, phrase, a, l, r.r, n, score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= 2000
"""


ORACLES = {
    "op1_quality_rules": OP1,
    "op2_chat_format": OP2,
    "op4_jaccard_join": OP4,
    "op7_exact_dedup": OP7,
    "op9_warc_zip": OP9,
    "op11_license_scan": _licenses(),
    "op12_hard_negatives": OP12,
    "op13_collocations": OP13,
}
