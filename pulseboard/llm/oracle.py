"""DuckDB SQL of the queries that SQL can express: operators 1, 3, 7, 9, 11 and 12 by brute force."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_NOT_SPACE = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

DECONTAMINATE = f"""
WITH docs AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
items AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, len(win) AS n, array_to_string(win, ' ') AS win
    FROM (SELECT item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 13 THEN [w]
                 ELSE list_transform(range(1, len(w) - 11), lambda i: w[i:i + 12]) END) AS win FROM items)),
grams AS (
    SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
          FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, i, n FROM grams JOIN windows USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)"""

JACCARD_JOIN = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {_NOT_SPACE} AS w FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, s
    FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                 ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM docs)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles AS a JOIN shingles AS b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
    SELECT a, b FROM common JOIN sizes AS x ON x.doc_id = a JOIN sizes AS y ON y.doc_id = b
    WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach AS r JOIN links AS l ON l.a = r.b),
least_of AS (SELECT a AS doc_id, min(b) AS lowest FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(lowest, doc_id)) AS component_id
FROM docs LEFT JOIN sizes USING (doc_id) LEFT JOIN least_of USING (doc_id)"""

EMBEDDING_DEDUP = """
WITH RECURSIVE vectors AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v <> 0)) > 0
      AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = len(embedding)),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM vectors AS a
    JOIN vectors AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.98),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach AS r JOIN links AS l ON l.a = r.b),
degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a),
least_of AS (SELECT a AS vec_id, min(b) AS lowest FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(lowest, vec_id)) AS component_id,
       coalesce(lowest, vec_id) >= vec_id AS kept
FROM embeddings LEFT JOIN degree USING (vec_id) LEFT JOIN least_of USING (vec_id)"""

COLLOCATIONS = rf"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS p, w[i:i + k - 1] AS ws
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, p, any_value(ws) AS ws, count(*) AS c FROM grams GROUP BY lang, k, p),
sizes AS (SELECT lang, CAST(sum(c) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, p, ws, c AS a FROM f WHERE k >= 2 AND c >= 10),
cuts AS (
    SELECT c.lang, c.k, c.p, c.ws, c.a, j, x.c AS l, y.c AS r,
           (1000000::HUGEINT * c.a * c.a) // (x.c::HUGEINT * y.c) AS score
    FROM (SELECT *, unnest(range(1, k)) AS j FROM candidates) AS c
    JOIN f AS x ON x.lang = c.lang AND x.p = array_to_string(c.ws[1:j], ' ')
    JOIN f AS y ON y.lang = c.lang AND y.p = array_to_string(c.ws[j + 1:], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
covered AS (
    SELECT lang, p, max(a) AS above
    FROM (SELECT lang, array_to_string(ws[1:2], ' ') AS p, a FROM candidates WHERE k = 3
          UNION ALL SELECT lang, array_to_string(ws[2:3], ' ') AS p, a FROM candidates WHERE k = 3) GROUP BY lang, p),
ranked AS (
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank, p AS phrase, a, l, r, CAST(score AS BIGINT) AS score
    FROM lowest LEFT JOIN covered USING (lang, p) WHERE above IS NULL OR 100 * above < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000"""

HARD_NEGATIVES = """
WITH vectors AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda v: floor(256 * CAST(v AS DOUBLE))) AS x
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = len(embedding)),
scores AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
    FROM vectors AS a JOIN vectors AS b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE a.vec_id % 100 = 0),
positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 10"""

_URL_RULES = [("allow", "www.example.com/en/"), ("block", "example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"), ("allow", "com/")]  # longest first


def _fits(where: str) -> str:
    site, _, start = where.partition("/")
    return f"((host = '{site}' OR ends_with(host, '.{site}')) AND starts_with(path, '/{start}'))"


def url_rules(bad: str) -> str:
    """``bad`` is a SELECT of (id, bad). Mined rules by counting every subset of every labelled URL's tokens."""
    rule = " ".join(f"WHEN {_fits(where)} THEN '{where}'" for _, where in _URL_RULES)
    given = " ".join(f"WHEN {_fits(where)} THEN '{verdict}'" for verdict, where in _URL_RULES)
    return rf"""
WITH split AS (
    SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest,
           list_sort(list_distinct(list_transform(regexp_extract_all(lower(coalesce(url, '')), '[a-z0-9-]+'),
                                                  lambda w: CASE WHEN regexp_full_match(w, '[0-9]+') THEN '0' ELSE w END))) AS own
    FROM pages),
parts AS (
    SELECT page_id, url, own, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
    FROM split),
ruled AS (SELECT *, CASE {rule} END AS rule, CASE {given} END AS given FROM parts),
known AS ({bad}),
baskets AS (SELECT own, bad FROM parts JOIN known ON id = page_id WHERE bad IS NOT NULL AND len(own) + bad > 0),
size AS (SELECT count(*) AS n FROM baskets),
subsets AS (
    SELECT list_filter(own, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS items, bad
    FROM (SELECT own, bad, unnest(range(1, 1 << len(own))) AS mask FROM baskets)),
mined AS (
    SELECT items FROM subsets, size GROUP BY items, n
    HAVING n >= 20 AND sum(bad) >= ceil(greatest(0.002::DOUBLE, 20::DOUBLE / n) * n) AND sum(bad)::DOUBLE / count(*) >= 0.6),
hit AS (SELECT DISTINCT url FROM ruled JOIN mined ON list_has_all(own, items) WHERE given IS NULL AND url IS NOT NULL)
SELECT page_id, host, path, rule, coalesce(given, CASE WHEN h.url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled AS r LEFT JOIN hit AS h ON h.url = r.url"""


URL_RULES = url_rules("""
    SELECT doc_id AS id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END) AS bad
    FROM labels GROUP BY doc_id""")
#: Labels that follow from the URL: pages of plain http under net are bad.
URL_RULES_DERIVED = url_rules("""
    SELECT page_id AS id, CASE WHEN list_has_all(own, ['http', 'net']) THEN 1 ELSE 0 END AS bad FROM split""")

ORACLE_SQL = {"op7_url_rules": URL_RULES, "url_rules_on_derived_labels": URL_RULES_DERIVED, "op11_hard_negatives": HARD_NEGATIVES, "op12_collocations": COLLOCATIONS, "op1_decontaminate": DECONTAMINATE, "op3_jaccard_join": JACCARD_JOIN, "op9_embedding_dedup": EMBEDDING_DEDUP}
