"""DuckDB SQL for the rows of the registered queries that SQL can express."""

from __future__ import annotations

from . import collocations
from .line_dedup import SHORT
from .mixing import BUDGET, DIMENSIONS, REACH, SWEEPS, TEMPER, TOPICS

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = rf"regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+')"
_ALNUM = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

NEAR_DEDUP = f"""
    WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_SPACED} AS w FROM documents),
    s AS MATERIALIZED (
        SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
        FROM w, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0),
    n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS MATERIALIZED (
        SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
    e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
    m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
    SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.b, w.doc_id)) AS component_id,
           w.doc_id = least(w.doc_id, coalesce(m.b, w.doc_id)) AS kept
    FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = w.doc_id
"""

DECONTAMINATION = f"""
    WITH d AS MATERIALIZED (SELECT doc_id, {_ALNUM} AS w FROM documents),
    b AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
    x AS MATERIALIZED (
        SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS s
        FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
    p AS (
        SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
        FROM d, (SELECT DISTINCT n FROM x), unnest(range(1, len(w) - n + 2)) AS t(i)),
    h AS MATERIALIZED (SELECT DISTINCT doc_id, i, n, item_id FROM p JOIN x USING (n, s)),
    k AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM h, unnest(range(i, i + n)) AS t(j) GROUP BY doc_id),
    g AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN k USING (doc_id) LEFT JOIN g USING (doc_id)
"""

EMBEDDING_DEDUP = """
    WITH RECURSIVE v AS MATERIALIZED (
        SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    l AS MATERIALIZED (
        SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id AND len(x.v) = len(y.v)
        WHERE list_cosine_similarity(x.v, y.v) >= 0.98),
    e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
    m AS (SELECT a, min(b) AS b FROM r GROUP BY a),
    n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
    SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id,
           vec_id = least(vec_id, coalesce(b, vec_id)) AS kept
    FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN m ON m.a = vec_id
"""


def _mixing() -> str:
    """The rounds of raking, written out one after the other."""
    topics = " ".join(
        f"WHEN {' OR '.join(f"contains(text, '{p}')" for p in parts)} THEN '{name}'" for name, parts in TOPICS.items()
    )
    steps, last = [], "w0"
    for i in range(SWEEPS * len(DIMENSIONS)):
        d, name = DIMENSIONS[i % len(DIMENSIONS)], f"w{i + 1}"
        steps.append(
            f"{name} AS MATERIALIZED (SELECT * EXCLUDE (b, f, s) REPLACE (CASE WHEN w > 0 THEN least(greatest(w * s, tokens / {REACH:.0f}), tokens * {REACH:.0f}) ELSE 0 END AS w) FROM ("
            f"SELECT *, CASE WHEN v_{d} < b + f THEN greatest(CASE WHEN f > 0 THEN (v_{d} - b) / f ELSE 0 END, v_{d} / greatest(b + f, 1e-300)) "
            f"WHEN f > 0 THEN (v_{d} - b) / f ELSE 1 END AS s FROM ("
            f"SELECT *, sum(CASE WHEN w >= tokens THEN tokens ELSE 0 END) OVER (PARTITION BY {d}) AS b, "
            f"sum(CASE WHEN w >= tokens THEN 0 ELSE w END) OVER (PARTITION BY {d}) AS f FROM {last})))"
        )
        last = name
    # A value that holds less than its share of the budget gives all: those of the smallest n / t.
    targets = ", ".join(
        f"t{d} AS (SELECT {d}, sum(n) AS n, pow(sum(n), {TEMPER}) / sum(pow(sum(n), {TEMPER})) OVER () AS t FROM c GROUP BY {d} HAVING sum(n) > 0), "
        f"x{d} AS (SELECT *, t * (m.whole - sum(n) OVER up + n) / sum(t) OVER down >= n AS cut FROM t{d}, m "
        f"WINDOW up AS (ORDER BY n / t, {d} ROWS UNBOUNDED PRECEDING), down AS (ORDER BY n / t DESC, {d} DESC ROWS UNBOUNDED PRECEDING)), "
        f"v{d} AS (SELECT {d}, CASE WHEN cut THEN n ELSE t * (whole - coalesce(sum(n) FILTER (cut) OVER (), 0)) / sum(t) FILTER (NOT cut) OVER () END AS v_{d} FROM x{d})"
        for d in DIMENSIONS
    )
    joins = " ".join(f"LEFT JOIN v{d} USING ({d})" for d in DIMENSIONS)
    names = ", ".join(f"coalesce(v_{d}, 0) AS v_{d}" for d in DIMENSIONS)
    return rf"""
    WITH d AS MATERIALIZED (
        SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, CASE {topics} ELSE 'prose' END AS topic,
               len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS n
        FROM documents),
    c AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n) AS DOUBLE) AS n FROM d GROUP BY ALL),
    m AS (SELECT {BUDGET} * sum(n) AS whole FROM c),
    {targets},
    w0 AS MATERIALIZED (SELECT source, lang, topic, n AS tokens, {BUDGET} * n AS w, {names} FROM c {joins}),
    {", ".join(steps)},
    p AS (
        SELECT source, lang, topic, CASE WHEN tokens > 0 THEN least(w, tokens) / tokens ELSE 1 END AS p FROM {last})
    SELECT doc_id, topic, n AS n_tokens, round(p, 6) AS probability,
           CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT) / 281474976710656.0 < p AS sampled
    FROM d JOIN p USING (source, lang, topic)
"""


MIXING = _mixing()

LINE_DEDUP = rf"""
    WITH l AS MATERIALIZED (
        SELECT doc_id, i - 1 AS pos, string_split(text, chr(10))[i] AS line
        FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS t(i)),
    f AS MATERIALIZED (
        SELECT line, length(line) AS n, min((doc_id, pos)) AS first FROM l WHERE NOT regexp_full_match(line, '\s*') GROUP BY line),
    e AS (
        SELECT DISTINCT x.line FROM f x JOIN f y ON y.n BETWEEN x.n - 1 AND x.n + 1 AND y.first < x.first
        WHERE x.n >= {SHORT} AND y.n >= {SHORT} AND levenshtein(x.line, y.line) <= 1),
    k AS (
        SELECT doc_id, pos, l.line, f.line IS NOT NULL AND ((doc_id, pos) > f.first OR e.line IS NOT NULL) AS dropped
        FROM l LEFT JOIN f ON f.line = l.line LEFT JOIN e ON e.line = l.line)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
           md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_md5
    FROM k GROUP BY doc_id
"""


def _collocations() -> str:
    """Counts of all phrases, their cuts and the phrases inside longer ones."""
    least, longest = collocations.LEAST, collocations.LONGEST
    return rf"""
    WITH p AS MATERIALIZED (
        SELECT row_number() OVER () AS p, lang, regexp_extract_all(s, '[^\x20\x09]+') AS w
        FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOW}, '[.,;:!?\x0A-\x0D]')) AS s FROM documents)),
    t AS MATERIALIZED (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
    f AS MATERIALIZED (
        SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, m, count(*) AS f
        FROM p, unnest(range(1, {longest + 1})) AS s(m), unnest(range(1, len(w) - m + 2)) AS t(i)
        GROUP BY ALL HAVING count(*) >= {least}),
    c AS MATERIALIZED (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
    k AS (
        SELECT c.lang, c.phrase, a, l.f AS l, r.f AS r, k, CAST(n AS HUGEINT) AS n,
               CAST((CAST(1000 AS HUGEINT) * a * n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
        FROM c JOIN t USING (lang), unnest(range(1, c.m)) AS x(k)
        JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ')
        JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:c.m], ' ')),
    b AS (SELECT lang, phrase, min((score, k, a, l, r, n)) AS b FROM k GROUP BY lang, phrase),
    i AS (
        SELECT DISTINCT x.lang, x.phrase FROM c x JOIN c y ON x.lang = y.lang AND x.m < y.m
        WHERE contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' ') AND 100 * y.a >= {collocations.INSIDE_PERCENT} * x.a),
    o AS (
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY b[1] DESC, b[3] DESC, encode(phrase)) AS rank, phrase, b
        FROM b WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.lang = b.lang AND i.phrase = b.phrase))
    SELECT lang, rank, phrase, CAST(b[3] AS BIGINT) AS a, CAST(b[4] AS BIGINT) AS l, CAST(b[5] AS BIGINT) AS r,
           CAST(b[6] AS BIGINT) AS n, CAST(b[1] AS BIGINT) AS score
    FROM o WHERE rank <= {collocations.TOP}
"""


COLLOCATIONS = _collocations()
