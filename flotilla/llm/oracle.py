"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .decontaminate import NEED, SHORT, WINDOW
from .line_dedup import MIN_CHARS, SITES

# Blank, tab, vertical tab, form feed, carriage return.
ENDS = "' ' || chr(9) || chr(11) || chr(12) || chr(13)"



def substituted_overlaps() -> str:
    """Overlaps straight from the tokens, without seeds: agreeing places counted on every diagonal with a common token."""

    def words(table: str, key: str) -> str:
        clean = "trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g'))"
        return (
            f"SELECT row_number() OVER () AS r, {key}, CASE WHEN {clean} = '' THEN CAST([] AS VARCHAR[]) "
            f"ELSE string_split({clean}, ' ') END AS w FROM {table}"
        )

    return f"""
WITH docs AS ({words("documents", "doc_id")}), items AS ({words("benchmark", "item_id")}),
doc_tokens AS (SELECT r, unnest(w) AS token, generate_subscripts(w, 1) AS at FROM docs),
item_tokens AS (SELECT r, len(w) AS n, unnest(w) AS token, generate_subscripts(w, 1) AS at FROM items),
diagonals AS (
    SELECT d.r AS dr, i.r AS ir, d.at - i.at AS g, any_value(n) AS n, list(i.at) AS places
    FROM doc_tokens d JOIN item_tokens i USING (token) GROUP BY 1, 2, 3
    HAVING count(*) >= CASE WHEN any_value(n) < {SHORT} THEN any_value(n)
        ELSE ceil(least(any_value(n), {WINDOW}) * {NEED} / {WINDOW}) END
), rated AS (
    SELECT dr, ir, n, least(n, {WINDOW}) AS width, list_max(list_transform(places,
        lambda a: len(list_filter(places, lambda b: b >= a AND b < a + least(n, {WINDOW}))))) AS agree
    FROM diagonals
), leaks AS (
    SELECT dr, count(DISTINCT item_id) AS n FROM rated JOIN items ON ir = r
    WHERE CASE WHEN rated.n < {SHORT} THEN agree = rated.n ELSE agree * {WINDOW} >= {NEED} * width END GROUP BY dr
)
SELECT doc_id, coalesce(n, 0) > 0 AS contaminated, CAST(coalesce(n, 0) AS BIGINT) AS n_items
FROM docs LEFT JOIN leaks ON dr = r
"""

LINE_DEDUP = f"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, text, coalesce(source, '') AS site, string_split(text, chr(10)) AS lines
    FROM documents
), lines AS (
    SELECT r, doc_id, site, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM docs
), spread AS (
    SELECT trim(line, {ENDS}) AS line FROM lines WHERE length(trim(line, {ENDS})) >= {MIN_CHARS}
    GROUP BY 1 HAVING count(DISTINCT site) >= {SITES}
), placed AS (
    SELECT r, pos, line, trim(line, {ENDS}) IN (SELECT line FROM spread) AS common,
        row_number() OVER (PARTITION BY trim(line, {ENDS}) ORDER BY doc_id NULLS LAST, pos) AS nth
    FROM lines
), cleaned AS (
    SELECT r, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT common OR nth = 1) AS text,
        count(*) FILTER (common AND nth > 1) AS removed_lines
    FROM placed GROUP BY r
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(c.text, '') END AS text,
    CAST(coalesce(c.removed_lines, 0) AS BIGINT) AS removed_lines
FROM docs d LEFT JOIN cleaned c ON d.r = c.r
"""

TOP_K = """
WITH v AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(
        CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r AND len(q.v) = len(c.v)
), ranked AS (
    SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank, vec_id, score
    FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

# Every document walks through every order: the first filter that it fails removes it.
FILTER_AUDIT = """
WITH letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
    FROM letters a JOIN letters b ON b.x <> a.x JOIN letters c ON c.x NOT IN (a.x, b.x)
    JOIN letters d ON d.x NOT IN (a.x, b.x, c.x) JOIN letters e ON e.x NOT IN (a.x, b.x, c.x, d.x)
), docs AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), marks AS (
    SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), judged AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        CASE WHEN len(w) < 100 THEN 'A' ELSE '' END
        || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
        || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
    FROM docs LEFT JOIN marks USING (doc_id)
), grouped AS (
    SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM judged GROUP BY 1, 2
), walked AS (
    SELECT g.*, filter_order, coalesce(list_min(list_filter(list_transform(list_filter(string_split(fails, ''),
        lambda c: c <> ''), lambda c: instr(filter_order, c)), lambda p: p > 0)), 99) AS gone
    FROM grouped g CROSS JOIN orders
), stepped AS (
    SELECT part, filter_order, step, filter_order[step] AS filter,
        sum(CASE WHEN gone > step THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN gone = step THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN gone < step AND contains(fails, filter_order[step]) THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN fails = filter_order[step] THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN gone = step THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN gone = step THEN toxic ELSE 0 END) AS toxic_lost
    FROM walked CROSS JOIN (SELECT unnest(range(1, 6)) AS step) GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
    CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
    CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM stepped
"""

# Every n-gram counted from the words themselves.
COLLOCATIONS = """
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), cut AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
    SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase
    FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i
          FROM cut CROSS JOIN (SELECT unnest([1, 2, 3]) AS size) WHERE len(w) >= size)
), f AS (SELECT lang, size, phrase, CAST(count(*) AS HUGEINT) AS a FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(a) AS n FROM f WHERE size = 1 GROUP BY lang),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND a >= 10),
cuts AS (
    SELECT lang, phrase, a, k, array_to_string(w[:k], ' ') AS head, array_to_string(w[k + 1 :], ' ') AS rest
    FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)
), scored AS (
    SELECT cuts.lang, cuts.phrase, cuts.a, k, x.a AS l, y.a AS r, (1000000 * cuts.a * cuts.a) // (x.a * y.a) AS score
    FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = rest
), lowest AS (
    SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scored
), covered AS (
    SELECT DISTINCT s.lang, s.phrase FROM candidates s JOIN candidates b ON b.lang = s.lang AND b.size = 3 AND s.size = 2
        AND (s.phrase = array_to_string(b.w[1:2], ' ') OR s.phrase = array_to_string(b.w[2:3], ' ')) AND 100 * b.a >= 50 * s.a
), ranked AS (
    SELECT l.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
    FROM lowest l ANTI JOIN covered USING (lang, phrase) WHERE nth = 1
)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
    CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_site_spread_lines": LINE_DEDUP,
        "op5_spaced_seed_leaks": substituted_overlaps(),
        "op9_block_top_k": TOP_K,
        "op11_filter_potential": FILTER_AUDIT,
        "op13_phrase_collocations": COLLOCATIONS,
    }
