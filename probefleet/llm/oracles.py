"""SQL for DuckDB that computes what some queries must give, from the same tables.

The others have no SQL form: they train models, parse HTML, tokenise, or write files. Tests hold those against
brute-force versions.
"""

from __future__ import annotations

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"
_PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str, pattern: str) -> str:
    return f"regexp_extract_all(coalesce({text}, ''), '{pattern}')"


SUBSTRINGS = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words('text', _WORD)} AS w FROM documents),
    windows AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS s
        FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM d)),
    lows AS (SELECT s, min(doc_id) AS low FROM windows GROUP BY s),
    gone AS (SELECT DISTINCT r, i + j AS p FROM
        (SELECT r, i, unnest(range(50)) AS j FROM windows JOIN lows USING (s) WHERE low < doc_id)),
    places AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
    kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS text FROM places ANTI JOIN gone USING (r, p) GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
    FROM d LEFT JOIN (SELECT r, count(*) AS n FROM gone GROUP BY r) USING (r) LEFT JOIN kept USING (r)"""

DECONTAMINATION = f"""WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_words(_LOWER, _PLAIN_WORD)} AS w
        FROM benchmark),
    items AS (SELECT item, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
    windows AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS s
        FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM items)),
    d AS (SELECT row_number() OVER () AS r, doc_id, {_words(_LOWER, _PLAIN_WORD)} AS w FROM documents),
    hits AS (SELECT r, i, k, item FROM (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM
        (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM windows)))
        JOIN windows USING (k, s)),
    words AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r),
    found AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, words.n IS NOT NULL AS contaminated
    FROM d LEFT JOIN words USING (r) LEFT JOIN found USING (r)"""

JACCARD_JOIN = f"""WITH RECURSIVE d AS (SELECT doc_id, {_words(_LOWER, _WORD)} AS w FROM documents),
    shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
        FROM (SELECT *, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b USING (s)
        WHERE a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
        WHERE 100 * shared.n >= 75 * (x.n + y.n - shared.n)),
    reached(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d LEFT JOIN sizes USING (doc_id)
    JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a) USING (doc_id)"""

COLLOCATIONS = r"""WITH texts AS (SELECT coalesce(lang, 'und') AS lang,
        unnest(regexp_split_to_array(LOWER_TEXT, '[.,;:!?\x0A-\x0D]')) AS t FROM documents),
    pieces AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM texts),
    totals AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
    grams AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS a FROM
        (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM pieces, (SELECT unnest(range(1, 6)) AS size))
        GROUP BY ALL HAVING count(*) >= 100),
    cuts AS (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, size)) AS k FROM grams WHERE size > 1),
    parts AS (SELECT lang, phrase, size, a, k, array_to_string(w[1:k], ' ') AS l, array_to_string(w[k + 1:], ' ') AS r FROM cuts),
    scores AS (SELECT p.lang, p.phrase, p.size, p.a, k, x.a AS l, y.a AS r, n,
        (1000 * CAST(p.a AS HUGEINT) * n) // (CAST(x.a AS HUGEINT) * y.a) AS score
        FROM parts p JOIN grams x ON x.lang = p.lang AND x.phrase = p.l JOIN grams y ON y.lang = p.lang AND y.phrase = p.r
        JOIN totals t ON t.lang = p.lang),
    best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inner_parts AS (SELECT DISTINCT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, a FROM
        (SELECT *, unnest(range(1, size - m + 2)) AS i FROM
        (SELECT lang, string_split(phrase, ' ') AS w, size, a, unnest(range(2, size)) AS m FROM grams WHERE size > 2))),
    kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM inner_parts i
        WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.a >= 100 * b.a))
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r,
    CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM kept QUALIFY rank <= 2000""".replace("LOWER_TEXT", f"coalesce({_LOWER}, '')")

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RANKED_SEARCH = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words(_LOWER, _TERM)} AS w FROM documents),
    total AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
    tfs AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL),
    weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * max(total.n) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight
        FROM tfs, total GROUP BY term),
    items AS (SELECT row_number() OVER () AS i, item_id, {_words(_LOWER, _TERM)} AS w FROM benchmark),
    asked AS (SELECT i, term, count(*) AS repeats FROM (SELECT i, unnest(w) AS term FROM items) GROUP BY ALL),
    norms AS (SELECT r, doc_id, 100 - 75 + (75 * len(w) * n) // l AS m FROM d, total WHERE len(w) > 0),
    scores AS (SELECT i, r, CAST(sum(repeats * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
        FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN norms USING (r) GROUP BY i, r),
    ranked AS (SELECT i, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank
        FROM scores JOIN norms USING (r) WHERE score > 0)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked JOIN items USING (i) WHERE rank <= 10"""

ORACLES = {
    "op4_substrings": SUBSTRINGS,
    "op8_decontamination": DECONTAMINATION,
    "op9_jaccard_join": JACCARD_JOIN,
    "op11_collocations": COLLOCATIONS,
    "op13_ranked_search": RANKED_SEARCH,
}
