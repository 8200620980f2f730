"""DuckDB counterparts of the operators that SQL can express: plain definitions, without the operators' methods."""

from __future__ import annotations

from .urls import Rule, Tree

W = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"

#: Smallest node reachable from each node of edges e(a, b), which holds both directions.
REACH = "reach(node, least) AS (SELECT a, a FROM e UNION SELECT e.b, reach.least FROM reach JOIN e ON e.a = reach.node WHERE reach.least < e.b)"
LEAST = "g AS (SELECT node, min(least) AS least FROM reach GROUP BY node)"

CHAT = """
WITH t AS (SELECT DISTINCT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT *, coalesce('+' || role, '-') || chr(0) || coalesce('+' || text, '-') AS said, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10) AS shown FROM t),
c AS (SELECT conv_id, count(*) AS n, list(said ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS l, string_agg(shown, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rendered FROM s GROUP BY conv_id),
k AS (SELECT l, n, min(conv_id) AS conv_id, count(*) AS n_copies, min_by(rendered, conv_id) AS rendered FROM c GROUP BY l, n),
p AS (SELECT DISTINCT l[1:i] AS l FROM (SELECT l, unnest(range(1, n)) AS i FROM c))
SELECT conv_id, n AS n_turns, n_copies, rendered FROM k WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.l = k.l)
"""

VECTORS = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
e AS (SELECT p.vec_id AS a, q.vec_id AS b FROM ok p JOIN ok q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.x) = len(q.x) WHERE list_cosine_similarity(p.x, q.x) >= 0.98),
{REACH}, {LEAST}, n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, coalesce(g.least, v.vec_id) AS component_id, coalesce(g.least, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN g ON g.node = v.vec_id
"""

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, coalesce({W}, []) AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
f AS (SELECT k, min(doc_id) AS doc_id FROM s GROUP BY k),
gone AS (SELECT DISTINCT s.doc_id, s.i + j AS i FROM s JOIN f USING (k), range(0, 50) r(j) WHERE f.doc_id < s.doc_id),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS t, count(*) AS n FROM x ANTI JOIN gone ON gone.doc_id = x.doc_id AND gone.i = x.i GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce({W.replace("text", f"translate(text, '{UPPER}', '{LOWER}')")}, []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS shared FROM s p JOIN s q ON p.k = q.k AND p.doc_id < q.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
{REACH}, {LEAST}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(g.least, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN g ON g.node = d.doc_id
"""

#: The exponent in closed form: the least share repeats twice as often as the largest.
MIXING = f"""
WITH d AS (SELECT doc_id, coalesce('s:' || source, 'null') AS src, CAST(coalesce(len({W}), 0) AS BIGINT) AS n_tokens, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS doc_key FROM documents),
r AS (SELECT *, doc_key[1:3] AS block FROM d),
b AS (SELECT src, block, CAST(sum(n_tokens) AS BIGINT) AS block_tokens FROM r GROUP BY src, block),
s AS (SELECT src, CAST(sum(block_tokens) AS BIGINT) AS n_tokens FROM b GROUP BY src HAVING sum(block_tokens) > 0),
q AS (SELECT *, n_tokens / (SELECT sum(n_tokens) FROM s) AS share FROM s),
t AS (SELECT round(CASE WHEN min(share) = max(share) THEN 0 ELSE greatest(0, 1 + ln(2.0) / ln(min(share) / max(share))) END, 6) AS t FROM q),
w AS (SELECT src, n_tokens, pow(share, t) / share AS ratio FROM q, t),
p AS (SELECT src, n_tokens AS src_tokens, round(ratio / (SELECT min(ratio) FROM w), 4) AS repeats FROM w),
c AS (SELECT b.*, coalesce(repeats, 1.0) AS repeats, CAST(floor(coalesce(repeats, 1.0)) AS INTEGER) AS passes, coalesce(CAST(floor((repeats - floor(repeats)) * src_tokens) AS BIGINT), 0) AS budget FROM b LEFT JOIN p USING (src)),
m AS (SELECT *, budget - coalesce(sum(block_tokens) OVER (PARTITION BY src ORDER BY md5('mix:' || passes || ':' || block), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM c),
o AS (SELECT r.*, m.repeats, m.passes, m.room, m.block_tokens, coalesce(sum(r.n_tokens) OVER (PARTITION BY r.src, r.block ORDER BY doc_key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r JOIN m ON m.src = r.src AND m.block = r.block),
y AS (SELECT *, unnest(range(0, passes + CASE WHEN room > 0 AND (room >= block_tokens OR before < room) THEN 1 ELSE 0 END)) AS pass FROM o)
SELECT doc_id, src, n_tokens, CAST(pass AS INTEGER) AS pass, block, md5('mix:' || pass || ':' || block) || doc_key AS order_key, repeats FROM y
"""


def _kind(seg: str) -> str:
    stem, tail = (f"regexp_extract({seg}, '(?s)^(.*?)(\\.[A-Za-z]{{1,5}})?$', {i})" for i in (1, 2))
    tests = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "^[0-9]+$", "^[0-9a-fA-F]{8,}$", "^[A-Za-z]+([-_][A-Za-z0-9]+){3,}$"
    date, num, hexa, slug = (f"regexp_matches({stem}, '{t}')" for t in tests)
    return f"CASE WHEN {date} THEN '<date>' WHEN {num} THEN '<num>' WHEN {hexa} AND regexp_matches({stem}, '[0-9]') THEN '<hex>' WHEN {slug} THEN '<slug>' WHEN length({stem}) > 40 THEN '<long>' ELSE {stem} END || {tail}"


def templates(rules: list[Rule], tree: Tree = Tree()) -> str:
    """SQL of the path-template tree: one step for each level, as the operator defines them."""
    d = tree.depth
    verdict = pattern = ""
    for r in sorted(rules, key=lambda r: (-len(r.pattern), r.pattern)):
        fits = f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN"
        pattern, verdict = f"{pattern} {fits} '{r.pattern}'", f"{verdict} {fits} '{r.verdict}'"
    head = ", ".join(f"coalesce({_kind(f'parts[{i}]')}, '<end>')" for i in range(1, d + 1))
    steps = [f"""
u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
parted AS (SELECT *, string_split(regexp_replace(path, '^/', ''), '/') AS parts FROM u),
p AS (SELECT page_id, host, path, [{head}, CASE WHEN len(parts) > {d} THEN '<rest ' || (len(parts) - {d}) || '>' ELSE '<end>' END] AS shape FROM parted),
lab AS (SELECT doc_id AS page_id, min(quality) AS good FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
x0 AS (SELECT host, shape, CAST([] AS VARCHAR[]) AS node, count(*) AS n, count(good) AS l, coalesce(sum(good), 0) AS g FROM p LEFT JOIN lab USING (page_id) GROUP BY host, shape)"""]  # fmt: skip
    for i in range(d):
        steps.append(f"""
n{i} AS (SELECT host, node, shape[{i + 1}] AS seg, shape[{i + 2}] AS nxt, CAST(sum(n) AS DOUBLE) AS n, sum(l) AS l, sum(g) AS g FROM x{i} GROUP BY ALL),
e{i} AS (SELECT *, sum(n) OVER (PARTITION BY host, node, seg) * sum(n) OVER (PARTITION BY host, node, nxt) / sum(n) OVER (PARTITION BY host, node) AS expected, sum(l) OVER (PARTITION BY host, node) AS al, sum(g) OVER (PARTITION BY host, node) AS ag FROM n{i}),
s{i} AS (SELECT host, node, seg, sum(pow(n - expected, 2) / expected) + sum(n) - sum(expected) AS chi, greatest(count(*) - 1, 1) AS df, sum(l) AS l, sum(g) AS g, (max(ag) + 1) / (max(al) + 2) AS share FROM e{i} GROUP BY host, node, seg),
a{i} AS (SELECT host, node, seg, NOT starts_with(seg, '<') AS literal, NOT starts_with(seg, '<') AND chi <= df + {tree.spread} * sqrt(2 * df) AND abs(g - l * share) / sqrt(l * share * (1 - share) + 1) <= {tree.spread} AS alike FROM s{i}),
m{i} AS (SELECT host, node, seg, CASE WHEN literal AND count(*) FILTER (literal) OVER (PARTITION BY host, node) > {tree.max_values} THEN '<*>' WHEN alike AND count(*) FILTER (alike) OVER (PARTITION BY host, node) > 1 THEN '<=>' ELSE seg END AS name FROM a{i}),
x{i + 1} AS (SELECT x.host, x.shape, list_append(x.node, m.name) AS node, x.n, x.l, x.g FROM x{i} x JOIN m{i} m ON m.host = x.host AND m.node = x.node AND m.seg = x.shape[{i + 1}])""")
    steps.append(f"""
named AS (SELECT host, shape, '/' || array_to_string(list_filter(list_append(node, shape[{d + 1}]), lambda s: s <> '<end>'), '/') AS template, l, g FROM x{d}),
total AS (SELECT (sum(g) + 1) / (sum(l) + 2) AS overall FROM named),
pure AS (SELECT host, template, sum(l) AS l, (sum(g) + {tree.prior} * CAST(any_value(overall) AS DOUBLE)) / (sum(l) + {tree.prior}) AS purity FROM named, total GROUP BY host, template)
SELECT p.page_id, p.host, p.path, CASE{pattern.replace("host", "p.host").replace("path", "p.path")} END AS rule, CASE{verdict.replace("host", "p.host").replace("path", "p.path")} WHEN q.l >= {tree.min_labels} AND q.purity < {tree.min_purity} THEN 'block' ELSE 'allow' END AS verdict, t.template, q.purity
FROM p JOIN named t ON t.host = p.host AND t.shape = p.shape JOIN pure q ON q.host = t.host AND q.template = t.template""")
    return "WITH " + ",".join(steps)
