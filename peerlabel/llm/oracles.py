"""DuckDB SQL of the numbered operators that SQL can express.

Not here: op1 (a parser), op2 and op4 (tokenizers), op5 (checksums of bytes), op7 (a trained
model), and so the pipeline; the tests hold them against brute force.
"""

from __future__ import annotations

SPACES = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

NGRAM_JOIN = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(
           translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{SPACES}'), lambda w: w <> '') AS ws
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE
           WHEN len(ws) = 0 THEN []
           WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
           ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS shingle
  FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY ALL
), links AS (
  SELECT x, y FROM common JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y
  WHERE 100 * c >= 80 * (s.n + t.n - c)
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.other
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id)
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)
"""

DECONTAMINATION = rf"""
WITH documents_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(ws), 13) AS size,
         unnest(list_transform(range(1, len(ws) - least(len(ws), 13) + 2),
           lambda i: array_to_string(ws[i:i + least(len(ws), 13) - 1], ' '))) AS run
  FROM item_words WHERE len(ws) > 0
), sizes AS (
  SELECT DISTINCT size FROM windows
), runs AS (
  SELECT doc_id, size, unnest(range(1, len(ws) - size + 2)) AS place, ws
  FROM documents_words, sizes WHERE len(ws) >= size
), placed AS (
  SELECT doc_id, size, place, array_to_string(ws[place:place + size - 1], ' ') AS run FROM runs
), found AS (
  SELECT doc_id, item_id, placed.size, place FROM placed JOIN windows ON placed.size = windows.size AND placed.run = windows.run
), covered AS (
  SELECT doc_id, count(DISTINCT spot) AS n_hit
  FROM (SELECT doc_id, unnest(range(place, place + size)) AS spot FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM documents_words LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

# (name, score, least spread of a bulk, whether it is of the language alone)
MEASURES = (
    ("symbols", "n_symbols * 1000 // greatest(word_chars, 1)", 5, False),
    ("dup_lines", "n_dup_lines * 1000 // greatest(n_words, 1)", 10, False),
    ("repeats", "n_repeat_words * 1000 // greatest(n_words, 1)", 40, False),
    ("long_words", "word_chars * 1000 // greatest(n_words, 1)", 50, True),
    ("short_words", "- (word_chars * 1000 // greatest(n_words, 1))", 50, True),
)


def _quality() -> str:
    """A group's scores are 128 quantiles of its own, and of its language's and all rows' with the
    weight of the 20 rows that each lends to the next; from three quarters of them on, the middle
    of the first gap of six spreads is the threshold."""
    scores = ", ".join(f"{expression} AS m_{name}" for name, expression, *_ in MEASURES)
    long = " UNION ALL ".join(
        f"SELECT doc_id, lang, source, '{name}' AS m, m_{name} AS score, {least} AS least, {alone} AS alone FROM scored WHERE NOT base_failed"
        for name, _, least, alone in MEASURES
    )
    return rf"""
WITH split AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '{SPACES}'), lambda w: w <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), runs AS (
  SELECT doc_id, place, array_to_string(ws[place:place + 7], ' ') AS run
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS place FROM split WHERE len(ws) >= 8)
), repeated AS (
  SELECT doc_id, count(DISTINCT spot) AS n FROM (
    SELECT doc_id, unnest(range(place, place + 8)) AS spot
    FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS times FROM runs) WHERE times > 1
  ) GROUP BY doc_id
), counted AS (
  SELECT doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words
  FROM split LEFT JOIN repeated USING (doc_id)
), scored AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {scores} FROM counted
), long AS (
  {long}
), sorted AS (
  SELECT m, least, alone, lang, source, GROUPING(lang) AS of_all, GROUPING(source) AS of_lang, count(*) AS rows, list_sort(list(score)) AS vs
  FROM long GROUP BY GROUPING SETS ((m, least, alone, lang, source), (m, least, alone, lang), (m, least, alone))
), parts AS (
  SELECT g.m, g.lang, g.source, g.least, g.alone, l.rows AS l_rows,
         unnest([{{'vs': g.vs, 'w': g.rows::DOUBLE}},
                 {{'vs': l.vs, 'w': CASE WHEN g.alone THEN 20.0 ELSE 20.0 * l.rows / (l.rows + 20.0) END::DOUBLE}},
                 {{'vs': a.vs, 'w': CASE WHEN g.alone THEN 0.0 ELSE 400.0 / (l.rows + 20.0) END::DOUBLE}}]) AS p
  FROM sorted g JOIN sorted l ON l.m = g.m AND l.of_lang = 1 AND l.of_all = 0 AND l.lang IS NOT DISTINCT FROM g.lang
  JOIN sorted a ON a.m = g.m AND a.of_all = 1 WHERE g.of_lang = 0
), points AS (
  SELECT m, lang, source, least, alone, l_rows, p.vs[ceil(i * len(p.vs) / 128)::INTEGER] AS v, p.w AS w
  FROM parts, (SELECT unnest(range(1, 129)) AS i) WHERE p.w > 0
), summed AS (
  SELECT m, lang, source, least, alone, l_rows, v, sum(w) AS w FROM points GROUP BY ALL
), placed AS (
  SELECT *, sum(w) OVER (PARTITION BY m, lang, source ORDER BY v) / sum(w) OVER (PARTITION BY m, lang, source) AS share,
         lead(v) OVER (PARTITION BY m, lang, source ORDER BY v) AS following
  FROM summed
), bulks AS (
  SELECT *, min(v) FILTER (share >= 0.5 - 1e-9) OVER (PARTITION BY m, lang, source) AS median,
         min(v) FILTER (share >= 0.75 - 1e-9) OVER (PARTITION BY m, lang, source) AS bulk
  FROM placed
), limits AS (
  SELECT m, lang, source, arg_min(v + (following - v) // 2, v) AS middle FROM bulks
  WHERE v >= bulk AND following - v >= 6 * greatest(bulk - median, least)
    + CASE WHEN alone THEN floor(abs(bulk) * 200 / l_rows)::BIGINT ELSE 0 END
  GROUP BY m, lang, source
), odd AS (
  SELECT DISTINCT doc_id FROM long JOIN limits ON limits.m = long.m
  AND limits.lang IS NOT DISTINCT FROM long.lang AND limits.source IS NOT DISTINCT FROM long.source AND score > middle
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM odd) AS kept
FROM scored
"""


SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*://"

URL_FILTERS = rf"""
WITH split AS (
  SELECT page_id, nullif(lower(regexp_extract(url, '{SCHEME}(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host,
         list_filter(string_split(regexp_extract(url, '{SCHEME}[^/?#]*(/[^?#]*)?', 1), '/'), lambda s: s <> '') AS steps,
         string_split(regexp_extract(url, '{SCHEME}[^/?#]*/([^?#]*)', 1), '/')[1] AS step,
         DATE '2020-01-01' + CAST(CAST('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 6) AS BIGINT) % 1460 AS INTEGER) AS fetched
  FROM pages
), named AS (
  SELECT DISTINCT list, pattern FROM (
    SELECT 'spam' AS list, host AS pattern FROM split
    UNION ALL SELECT 'adult', host || '/' || step FROM split
    UNION ALL SELECT 'allow', CASE WHEN len(string_split(host, '.')) >= 2 THEN array_to_string(string_split(host, '.')[-2:], '.') END FROM split
  ) WHERE pattern IS NOT NULL AND pattern NOT LIKE '%/'
), hashed AS (
  SELECT list, pattern, md5(list || ':' || pattern) AS h FROM named
), chosen AS (
  SELECT list, pattern, CAST('0x' || substr(h, 1, 6) AS BIGINT) AS choice,
         CAST(CAST('0x' || substr(h, 7, 6) AS BIGINT) % 1200 AS INTEGER) AS beginning,
         CAST(CAST('0x' || substr(h, 13, 6) AS BIGINT) % 300 AS INTEGER) AS length,
         CAST('0x' || substr(h, 19, 6) AS BIGINT) % 2 AS ends
  FROM hashed
), entries AS (
  SELECT list, pattern, DATE '2020-01-01' + beginning AS since,
         CASE WHEN ends = 1 OR list <> 'spam' THEN DATE '2020-01-01' + (beginning + length) ELSE DATE '2100-01-01' END AS until
  FROM chosen WHERE choice % (CASE list WHEN 'spam' THEN 3 WHEN 'adult' THEN 5 ELSE 1 END) = 0
), asked AS (
  SELECT DISTINCT page_id, fetched, unnest(
    list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.'))
    || list_transform(range(1, len(steps) + 1), lambda i: host || '/' || array_to_string(steps[1:i], '/'))) AS pattern
  FROM split WHERE host IS NOT NULL
), matched AS (
  SELECT page_id, list, entries.pattern FROM asked JOIN entries
  ON asked.pattern = entries.pattern AND since <= fetched AND fetched < until
), summed AS (
  SELECT page_id, count(*) AS n_matches, string_agg(DISTINCT list, ',' ORDER BY list) AS lists,
         bool_or(list = 'allow') AS allowed, bool_or(list <> 'allow') AS listed
  FROM matched GROUP BY page_id
)
SELECT page_id, coalesce(n_matches, 0) AS n_matches, coalesce(lists, '') AS lists,
       coalesce(listed AND NOT allowed, false) AS blocked
FROM pages LEFT JOIN summed USING (page_id)
"""

WARC = """
WITH hashed AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), bits AS (
  SELECT page_id, payload_bytes, h, array_to_string(list_transform(range(1, 41),
           lambda i: substr(CAST(CAST('0x' || substr(h, i, 1) AS INTEGER)::BIT AS VARCHAR), 29, 4)), '') AS b FROM hashed
), coded AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32),
           lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(list_reduce(list_transform(range(1, 6),
             lambda j: CAST(substr(b, 5 * i + j, 1) AS INTEGER)), lambda x, y: 2 * x + y) AS INTEGER) + 1, 1)), '') AS payload_digest
  FROM bits
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM coded
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM firsts
"""


FILTER_AUDIT = rf"""
WITH split AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '{SPACES}'), lambda w: w <> '') AS ws
  FROM documents
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), judged AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         [len(ws) < 100, 100 * len(list_distinct(ws)) < 80 * len(ws),
          100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text),
          regexp_matches(text, '[#$%&*|]'),
          coalesce(split.doc_id > min(split.doc_id) OVER (PARTITION BY text), false)] AS fails
  FROM split LEFT JOIN marks ON marks.doc_id = split.doc_id
), cells AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY part, fails
), letters AS (
  SELECT unnest(range(1, 6)) AS i
), orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o
  FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), steps AS (
  SELECT o, step, o[step] AS f, array_to_string(list_transform(o, lambda x: substr('ABCDE', x, 1)), '') AS filter_order
  FROM orders, (SELECT unnest(range(1, 6)) AS step)
), seen AS (
  SELECT part, filter_order, step, f, n, good, toxic, fails[f] AS failed,
         len(list_filter(o[1:step - 1], lambda x: fails[x])) AS before,
         len(list_filter(fails, lambda x: x)) AS n_fails
  FROM cells, steps
), summed AS (
  SELECT part, filter_order, step, f,
         CAST(coalesce(sum(n) FILTER (before = 0 AND NOT failed), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (before = 0 AND failed), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (before > 0 AND failed), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (failed AND n_fails = 1), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(good) FILTER (before = 0 AND failed), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(toxic) FILTER (before = 0 AND failed), 0) AS BIGINT) AS toxic_lost
  FROM seen GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM summed
"""

HARD_NEGATIVES = """
WITH valid AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM valid a JOIN valid b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
), ranked AS (
  SELECT anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS place
  FROM positives JOIN scored USING (anchor_id)
  WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE place <= 10
"""

# A turn is "### role: text</turn>" and a line break. Escapes add a backslash to each control
# string, and to each backslash too where a text ends in one or has one before a special character.
CHAT_FORMAT = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), measured AS (
  SELECT *, length(role) + length(text) + 14 AS plain,
         len(regexp_extract_all(text, '### |</turn>')) + len(regexp_extract_all(role, '### |</turn>|:')) AS controls,
         len(regexp_extract_all(text || role, '\\')) AS slashes,
         regexp_matches(text, '\\([\\#<:]|$)') OR regexp_matches(role, '\\([\\#<:]|$)') AS hard
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(plain + controls + CASE WHEN hard THEN slashes ELSE 0 END) AS BIGINT) AS formatted_chars,
       true AS round_trip
FROM measured GROUP BY conv_id
"""


def all_sql() -> dict[str, str]:
    return {
        "op3_ngram_jaccard": NGRAM_JOIN,
        "op6_decontaminate": DECONTAMINATION,
        "op8_quality_rules": _quality(),
        "op9_url_filters": URL_FILTERS,
        "op10_warc": WARC,
        "op11_filter_audit": FILTER_AUDIT,
        "op12_hard_negatives": HARD_NEGATIVES,
        "op13_chat_format": CHAT_FORMAT,
    }
