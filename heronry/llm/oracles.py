"""DuckDB SQL that gives the rows of those queries of this subpackage that SQL can express on whole tables."""

from __future__ import annotations

from . import secrets

# The base rules as the query's contract states them, apart from the operator's own: kind, expression, group,
# least length. A run of hex digits is asked for with its least length at once, as lists of all shorter runs would be long.
BASE_RULES = (
    ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _secret_spans() -> str:
    """A row a document with base_spans and spans: lists of structs (start, kind, end), in order."""
    rules = [*BASE_RULES, *((r.kind, r.pattern, r.group, r.least) for r in secrets.MORE)]
    names = [f"r{k}" for k in range(len(rules))]
    ctes = ["d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"]
    for kind, (name, (_, pattern, group, least)) in enumerate(zip(names, rules, strict=True)):
        rx = pattern.replace("'", "''")
        ctes.append(f"""{name} AS (
            SELECT doc_id, list_filter(list_transform(range(1, len(hits) + 1), lambda i: {{'start': before[i], 'kind': {kind}, 'end': before[i] + length(hits[i]), 'ok': length(vals[i]) >= {least}}}), lambda s: s.ok) AS spans
            FROM (SELECT *, list_transform(range(1, len(hits) + 1), lambda i: coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0)) AS before
                  FROM (SELECT doc_id, regexp_extract_all(t, '{rx}') AS hits, regexp_extract_all(t, '{rx}', {group}) AS vals, regexp_split_to_array(t, '{rx}') AS gaps FROM d)))""")
    n = len(BASE_RULES)
    joined = " ".join(f"JOIN {x} USING (doc_id)" for x in names)
    merged = lambda of: "list_sort(" + "list_concat(" * (len(of) - 1) + f"{of[0]}.spans" + "".join(f", {x}.spans)" for x in of[1:]) + ")"
    ctes.append(f"a AS (SELECT doc_id, {merged(names[:n])} AS base_spans, {merged(names)} AS spans FROM d {joined})")
    return ",\n".join(ctes)


_KIND_NAMES = "[" + ", ".join(f"'{kind}'" for kind in [r[0] for r in BASE_RULES] + [r.kind for r in secrets.MORE]) + "]"
_SHOWN = f"array_to_string(list_transform({{}}, lambda s: {_KIND_NAMES}[s.kind + 1] || ':' || CAST(s.start AS BIGINT) || ':' || CAST(s.\"end\" AS BIGINT)), ',')"

OP4 = f"""
WITH {_secret_spans()}
SELECT doc_id, {", ".join(f"CAST(len(list_filter(base_spans, lambda s: s.kind = {k})) AS BIGINT) AS n_{r[0]}" for k, r in enumerate(BASE_RULES))},
       sha256({_SHOWN.format("base_spans")}) AS base_sha256, {_SHOWN.format("spans")} AS spans
FROM a"""

OP6 = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i+7], ' '))) AS g FROM d WHERE len(ws) >= 8),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(8)) AS k) GROUP BY doc_id),
m AS (
    SELECT doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
           CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
           CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
    FROM d JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM b GROUP BY source),
o AS (SELECT sum(f) / sum(n) AS mean, sum(f * f / n) / sum(n) - pow(sum(f) / sum(n), 2) AS v, count(*) / sum(n) AS per_n, sum(n) AS all_n FROM h),
p AS (SELECT mean, CASE WHEN v > mean * (1 - mean) * per_n AND mean * (1 - mean) > v THEN (mean * (1 - mean) - v) / (v - mean * (1 - mean) * per_n) ELSE all_n END AS strength FROM o),
r AS (SELECT source, n + strength + 2e-6 AS total, (f + mean * strength + 1e-6) / (n + strength + 2e-6) AS rate FROM h, p),
x AS (SELECT source, rate - 2 * sqrt(rate * (1 - rate) / (total + 1)) > 0.5 AS rejected FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR rejected) AS kept
FROM b JOIN x ON b.source IS NOT DISTINCT FROM x.source"""

OP9 = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, n, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY d, n)
SELECT page_id, p.n AS payload_bytes, p.d AS payload_digest, CASE WHEN top > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top > page_id THEN top END AS refers_to
FROM p LEFT JOIN m ON p.d = m.d AND p.n = m.n"""

OP10 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
             ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(least.b, doc_id)) AS component_id,
       doc_id <= coalesce(least.b, doc_id) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN least ON doc_id = least.a"""

OP11 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
             ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(least.b, doc_id)) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN least ON doc_id = least.a"""

OP12 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
           FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
x AS (SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
             CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank
      FROM p JOIN s n ON p.anchor_id = n.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM x WHERE rank <= 3"""

ORACLE_SQL = {"op4_secrets": OP4, "op6_host_rules": OP6, "op9_warc": OP9, "op10_near_dup": OP10, "op11_ngram_join": OP11, "op12_hard_negatives": OP12}
