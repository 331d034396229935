"""SQL that says the same as the queries of the catalogue, for DuckDB over the same tables."""

from __future__ import annotations

_S = "s AS (SELECT DISTINCT id, file_id, file_path, name, qualified_name, kind, signature, summary, summary_source, start_line, end_line, start_byte, end_byte, exported FROM symbols WHERE id IS NOT NULL)"
_COLUMNS = {"name": 3, "qualified_name": 2, "signature": 1, "summary": 1}


def _words(col: str) -> str:
    return f"regexp_extract_all(lower(coalesce({col}, '')), '[\\p{{L}}\\p{{N}}]+')"


def _hits(tokens: str, phrase: list[str]) -> str:
    tests = [f"{tokens}[i + {k}] = '{w}'" for k, w in enumerate(phrase[:-1])] + [f"starts_with({tokens}[i + {len(phrase) - 1}], '{phrase[-1]}')"]
    return f"len(list_filter(range(1, len({tokens}) - {len(phrase)} + 2), lambda i: {' AND '.join(tests)}))"


def _bm25(phrases: list[list[str]]) -> str:
    """CTEs s, w (with the words), f (frequencies), t (totals) and b (id, bm25)."""
    words = ", ".join(f"{_words(c)} AS w_{c}" for c in _COLUMNS)
    freq = ", ".join("(" + " + ".join(f"{n} * {_hits(f'w_{c}', p)}" for c, n in _COLUMNS.items()) + f")::DOUBLE AS f{k}" for k, p in enumerate(phrases))
    length = " + ".join(f"len(w_{c})" for c in _COLUMNS)
    totals = ", ".join(f"count(*) FILTER (f{k} > 0)::DOUBLE AS n{k}" for k in range(len(phrases)))
    idf = lambda k: f"(CASE WHEN ln((n - n{k} + 0.5) / (n{k} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n{k} + 0.5) / (n{k} + 0.5)) END)"
    parts = " + ".join(f"{idf(k)} * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * d / m))" for k in range(len(phrases)))
    any_hit = " OR ".join(f"f{k} > 0" for k in range(len(phrases)))
    return f"{_S}, w AS (SELECT id, {words} FROM s), f AS (SELECT id, ({length})::DOUBLE AS d, {freq} FROM w), t AS (SELECT count(*)::DOUBLE AS n, avg(d) AS m, {totals} FROM f), b AS (SELECT id, -({parts}) AS bm25 FROM f, t WHERE {any_hit})"


def _score(query: str, tokens: list[str], intent: bool = False) -> str:
    n, q, g, m, p = (f"lower(coalesce({c}, ''))" for c in ("name", "qualified_name", "signature", "summary", "file_path"))
    hay = "lower(concat_ws(' ', coalesce(name, ''), coalesce(qualified_name, ''), coalesce(signature, ''), coalesce(summary, ''), coalesce(summary_source, ''), coalesce(file_path, ''), coalesce(kind, '')))"
    point = lambda c, v: f"(CASE WHEN {c} THEN {v} ELSE 0 END)"
    parts = [
        point(f"{n} = '{query}'", 1000), point(f"{q} = '{query}'", 900), point(f"starts_with({n}, '{query}')", 700), point(f"starts_with({q}, '{query}')", 650), point(f"contains({n}, '{query}')", 500), point(f"contains({q}, '{query}')", 450),
        point(f"contains({g}, '{query}')", 250), point(f"contains({m}, '{query}')", 200), point(f"contains({p}, '{query}')", 120), point(f"regexp_matches({hay}, '\\b{query}\\b')", 180), *(point(f"contains({hay}, '{t}')", 70) for t in tokens),
    ]
    if intent:
        evidence = "concat_ws(' ', coalesce(name, ''), coalesce(qualified_name, ''), coalesce(file_path, ''))"
        parts += [
            point(f"regexp_matches({evidence}, '(?i)(generate|generator|codegen|scaffold|template|emit)')", 360), point("regexp_matches(coalesce(file_path, ''), '(?i)(^|/)(tools?|scripts?|cli|generators?|codegen)(/|$)')", 120),
            point("regexp_matches(coalesce(file_path, ''), '(?i)(^|/)(tests?|__tests__|spec)(/|$)|\\.(test|spec)\\.[^/]+$')", -80),
        ]
    total = " + ".join(parts)
    return f"(CASE WHEN ({total}) > 0 AND exported THEN ({total}) + 20 ELSE ({total}) END)::BIGINT"


def _like(terms: list[str]) -> str:
    return "(" + " OR ".join(f"lower(coalesce({c}, '')) LIKE '%{t}%'" for t in terms for c in ("name", "qualified_name", "signature", "summary", "file_path")) + ")"


_ORDER = "score DESC, exported DESC, file_path, start_line, name, id"
_PHRASES = [["merge", "lease"], ["merge"], ["lease"]]
_TERMS = ["merge lease", "merge", "lease"]
_REASON = "CASE WHEN trim(lower(name)) = '{0}' OR trim(lower(coalesce(qualified_name, ''))) = '{0}' THEN 'exact_symbol_match' ELSE 'query_match' END"
_RANKED_WORD = f"""
WITH {_bm25([['session']])}, c AS (SELECT id FROM b ORDER BY bm25, id LIMIT 400), h AS (SELECT count(*) AS k FROM c),
r AS (SELECT s.*, CASE WHEN k > 0 THEN bm25 END AS bm25, {_score('session', ['session'])} AS score, {_REASON.format('session')} AS reason
      FROM s LEFT JOIN b ON s.id = b.id, h WHERE {_like(['session'])} AND (k = 0 OR s.id IN (SELECT id FROM c))),
x AS (SELECT * FROM r WHERE score > 0)
"""
_JSON = "length(to_json(struct_pack(id := id, name := name, \"qualifiedName\" := qualified_name, kind := kind, \"filePath\" := file_path, signature := signature, summary := summary, \"summarySource\" := summary_source, \"startLine\" := start_line, \"endLine\" := end_line, \"startByte\" := start_byte, \"endByte\" := end_byte, exported := exported))::VARCHAR)"

_LINES = "u AS (SELECT {id}, path, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM {rows})"
_PREVIEW = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


def _contains_phrase(phrases: list[list[str]]) -> str:
    return " OR ".join(f"{_hits('w', p)} > 0" for p in phrases)


def _extension(path: str) -> str:
    return f"lower(regexp_extract(regexp_replace({path}, '^.*/', ''), '^.+(\\.[^.]*)$', 1))"


def _language(path: str) -> str:
    from lodeglass.functions.languages import language_by_extension

    cases = " ".join(f"WHEN '{e}' THEN '{g}'" for e, g in language_by_extension().items())
    return f"(CASE {_extension(path)} {cases} END)"


def _tier(path: str) -> str:
    return f"(CASE WHEN {_language(path)} IN ('ts', 'tsx', 'js', 'jsx') THEN 'graph' WHEN {_language(path)} IS NOT NULL THEN 'structured' ELSE 'discovery' END)"


def _glob(path: str, include: tuple[str, ...], exclude: tuple[str, ...]) -> str:
    from lodeglass.functions.text import glob_regex

    test = lambda globs: " OR ".join(f"regexp_matches({path}, '{glob_regex(g)}')" for g in globs)
    return f"({test(include)}) AND NOT ({test(exclude)})"


_SECRET = r"sk-[A-Za-z0-9]{20,}|ghp_[A-Za-z0-9]{20,}|AIza[0-9A-Za-z\-_]{20,}|AKIA[0-9A-Z]{16}|-----BEGIN [A-Z ]*PRIVATE KEY-----"


def _redacted(col: str) -> str:
    for p in _SECRET.split("|"):
        col = f"regexp_replace({col}, '{p}', '[REDACTED:secret]', 'g')"
    return col


_TRADE = """
bought AS (SELECT DISTINCT o_custkey AS c, l_suppkey AS s, l_partkey AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
sold AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem),
sym AS (
  SELECT s || ':' || p AS id, 'suppliers/s' || s || '.ts' AS file_path, p_name || '#' || p AS name,
         CASE WHEN p_size < 10 THEN 'class' WHEN p_size < 30 THEN 'function' ELSE 'constant' END AS kind, p AS line, p_size % 2 = 0 AS exported, length(p_name || '#' || p) AS n
  FROM sold JOIN part ON p = p_partkey
  UNION ALL SELECT 'c' || c_custkey, 'customers/c' || c_custkey || '.ts', c_name, 'class', 1, true, length(c_name) FROM customer),
rep AS (SELECT file_path, id FROM sym QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY NOT exported, kind != 'class', kind != 'function', line, id) = 1),
edge AS (SELECT DISTINCT c, s, 'customers/c' || c || '.ts' AS importer_path, 'suppliers/s' || s || '.ts' AS target_path FROM bought),
wants AS (SELECT DISTINCT c, s, p, 'customers/c' || c || '.ts' AS importer_path, 'suppliers/s' || s || '.ts' AS target_path, p_name || '#' || p AS name FROM bought JOIN part ON p = p_partkey),
byname AS (SELECT file_path, name, id FROM sym QUALIFY row_number() OVER (PARTITION BY file_path, name ORDER BY NOT exported, line, id) = 1),
got AS (SELECT w.importer_path, w.target_path, w.name, b.id FROM wants w JOIN byname b ON b.file_path = w.target_path AND b.name = w.name),
dep AS (
  SELECT importer_path, id, target_path, name FROM got
  UNION ALL SELECT e.importer_path, r.id, e.target_path, '' FROM edge e JOIN rep r ON r.file_path = e.target_path
  WHERE NOT EXISTS (SELECT 1 FROM got g WHERE g.importer_path = e.importer_path AND g.target_path = e.target_path)),
imp AS (SELECT e.target_path, r.id, e.importer_path FROM edge e JOIN rep r ON r.file_path = e.importer_path)
"""
_JUDGED = """
WITH t AS (SELECT DISTINCT p_brand AS task, p_type AS target FROM part),
e AS (SELECT p_brand AS task, p_name || ' ' || p_type AS text, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part QUALIFY rank <= 10),
r AS (SELECT t.task, t.target, min(CASE WHEN contains(e.text, t.target) THEN e.rank END) AS rank FROM t LEFT JOIN e ON t.task = e.task GROUP BY 1, 2),
m AS (SELECT task, count(*) AS targets, count(rank) AS hits, round(100.0 * count(rank) / count(*), 1) AS recall_pct, min(rank) AS first_rank, coalesce(round(1.0 / min(rank), 3), 0.0) AS reciprocal_rank,
             round(count(*) FILTER (rank <= 3) / 3.0, 3) AS precision_at_3, coalesce(min(rank) = 1, false) AS top1, coalesce(min(rank) <= 3, false) AS top3 FROM r GROUP BY task)
"""
_FALLBACK = "CASE {e} WHEN '.md' THEN 'markdown-headings' WHEN '.mdx' THEN 'markdown-headings' WHEN '.yaml' THEN 'yaml-top-level-keys' WHEN '.yml' THEN 'yaml-top-level-keys' WHEN '.sql' THEN 'sql-schema-objects' ELSE 'text-lines' END"
_CLEAN = r"lower(regexp_replace({c}, '^\s+|\s+$', '', 'g'))"
_RECENT_ROWS = """
WITH f AS (SELECT path AS key, size_bytes AS bytes, updated_at AS used_at, coalesce(language = 'css', false) AS active FROM files WHERE size_bytes IS NOT NULL AND updated_at IS NOT NULL),
t AS (SELECT sum(bytes) AS total, CAST(floor(sum(bytes) / 2) AS BIGINT) AS half FROM f),
i AS (SELECT key, bytes, sum(bytes) OVER (ORDER BY used_at, key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - bytes AS freed FROM f WHERE NOT active)
"""

SQL = {
    "symbol_search": f"""
WITH {_bm25(_PHRASES)}, k AS (SELECT s.*, bm25 FROM s LEFT JOIN b ON s.id = b.id WHERE kind = 'function'),
c AS (SELECT id FROM k WHERE bm25 IS NOT NULL ORDER BY bm25, id LIMIT 400), h AS (SELECT count(*) AS n FROM c),
r AS (SELECT k.* EXCLUDE bm25, CASE WHEN h.n > 0 THEN bm25 END AS bm25, {_score('merge lease', ['merge', 'lease'])} AS score, {_REASON.format('merge lease')} AS reason FROM k, h WHERE {_like(_TERMS)} AND (h.n = 0 OR id IN (SELECT id FROM c)))
SELECT row_number() OVER (ORDER BY bm25 NULLS LAST, {_ORDER})::INTEGER AS rank, id, name, file_path, round(bm25, 6) AS bm25_score, score, reason FROM r WHERE score > 0 ORDER BY 1 LIMIT 8""",
    "symbol_search_fallback": f"""
WITH {_S}, r AS (SELECT *, {_score('ergelease', ['ergelease'])} AS score FROM s WHERE {_like(['ergelease'])})
SELECT row_number() OVER (ORDER BY {_ORDER})::INTEGER AS rank, id, name, file_path, score FROM r WHERE score > 0 ORDER BY 1 LIMIT 8""",
    "symbol_search_intent": f"""
WITH {_S}, r AS (SELECT *, {_score('generated message', ['generated', 'message'], True)} AS score FROM s WHERE {_like(['generated message', 'generated', 'message'])})
SELECT row_number() OVER (ORDER BY {_ORDER})::INTEGER AS rank, id, name, file_path, score FROM r WHERE score > 0 ORDER BY 1 LIMIT 8""",
    "symbol_bm25": f"WITH {_bm25(_PHRASES)} SELECT id, round(bm25, 6) AS bm25_score FROM b",
    "symbol_bm25_postings": f"WITH {_bm25(_PHRASES)} SELECT id, round(bm25, 6) AS bm25_score FROM b",
    "symbol_scores": f"WITH {_S} SELECT id, {_score('session', ['session'])} AS score FROM s WHERE {_score('session', ['session'])} > 0",
    "symbol_matches": _RANKED_WORD + "SELECT id, score, round(bm25, 6) AS bm25_score, reason FROM x",
    "search_result_envelope": _RANKED_WORD + f""",
a AS (SELECT count(*) AS total, sum({_JSON}) + greatest(count(*) - 1, 0) + 2 AS c FROM x),
y AS (SELECT *, {_JSON} AS j FROM x ORDER BY bm25 NULLS LAST, {_ORDER} LIMIT 8),
z AS (SELECT count(*) AS returned, sum(j) + greatest(count(*) - 1, 0) + 2 AS c FROM y),
d AS (SELECT regexp_replace(file_path, '/[^/]*$', '') AS v, count(*) AS n FROM y WHERE contains(file_path, '/') GROUP BY 1 ORDER BY n DESC, v LIMIT 1),
k AS (SELECT kind AS v, count(*) AS n FROM y GROUP BY 1 ORDER BY n DESC, v LIMIT 1),
n AS (SELECT total, returned, ceil(a.c / 4)::BIGINT AS b, ceil(z.c / 4)::BIGINT AS r FROM a, z)
SELECT total, returned, total > returned AS truncated, CASE WHEN total > returned THEN greatest(1, returned // 2) END::BIGINT AS hint_limit, CASE WHEN total > returned THEN (SELECT v FROM d) || '/**' END AS hint_file_pattern,
       CASE WHEN total > returned THEN (SELECT v FROM k) END AS hint_kind, b AS baseline_tokens, r AS returned_tokens, greatest(0, b - r)::BIGINT AS saved_tokens, round(100.0 * greatest(0, b - r) / b)::BIGINT AS saved_percent FROM n""",
    "text_search": f"WITH d AS (SELECT DISTINCT file_id, path, content FROM file_content WHERE content IS NOT NULL AND path IS NOT NULL), {_LINES.format(id='file_id', rows='d')} SELECT path AS file_path, line::BIGINT AS line, {_PREVIEW} AS preview FROM u WHERE contains(lower(text), 'seed list') ORDER BY path, line LIMIT 100",
    "text_search_narrowed": f"""
WITH d AS (SELECT DISTINCT file_id, path, content FROM file_content WHERE content IS NOT NULL AND path IS NOT NULL), w AS (SELECT file_id, {_words('content')} AS w FROM d),
h AS (SELECT DISTINCT file_id FROM w WHERE {_contains_phrase([['seed', 'list'], ['seed'], ['list']])} ORDER BY file_id LIMIT 200), e AS (SELECT * FROM d WHERE file_id IN (SELECT file_id FROM h) OR (SELECT count(*) FROM h) = 0),
{_LINES.format(id='file_id', rows='e')} SELECT path AS file_path, line::BIGINT AS line, {_PREVIEW} AS preview FROM u WHERE contains(lower(text), 'seed list') ORDER BY path, line LIMIT 100""",
    "document_lines": f"""
WITH d AS (SELECT DISTINCT doc_id, concat_ws('/', source, coalesce(lang, 'none'), 'doc_' || doc_id || '.txt') AS path, text AS content FROM documents WHERE text IS NOT NULL), {_LINES.format(id='doc_id', rows='d')}
SELECT path AS file_path, line::BIGINT AS line, {_PREVIEW} AS preview FROM u WHERE contains(lower(text), 'token budget') ORDER BY path, line LIMIT 100""",
    "file_search": f"""
WITH p AS (SELECT DISTINCT path, lower(path) AS f, regexp_replace(lower(path), '^.*/', '') AS n FROM files WHERE path IS NOT NULL AND {_glob('path', ('**/src/**',), ('zzz',))}),
m AS (SELECT *, CASE WHEN n = 'lease' THEN 500 WHEN f = 'lease' THEN 450 WHEN contains(n, 'lease') THEN 300 WHEN contains(f, 'lease') THEN 200 ELSE 0 END AS score, CASE WHEN n = 'lease' THEN 'name' WHEN f = 'lease' THEN 'path' WHEN contains(n, 'lease') THEN 'name' ELSE 'path' END AS match_reason FROM p)
SELECT path AS file_path, regexp_replace(path, '^.*/', '') AS file_name, {_language('path')} AS language, {_tier('path')} AS support_tier, true AS indexed, match_reason FROM m WHERE score > 0 ORDER BY score DESC, path LIMIT 50""",
    "glob_filter": "SELECT DISTINCT path FROM files WHERE " + _glob("path", ("*/packages/**/src/**/*.{ts,js}", "**/lib/*.py"), ("**/vendor/**", "**/*.min.js")),
    "repo_outline": f"WITH {_S}, n AS (SELECT file_id, count(*) AS n FROM s GROUP BY 1), f AS (SELECT DISTINCT file_id, language FROM files) SELECT language, count(*) AS files, CAST(coalesce(sum(n), 0) AS BIGINT) AS symbols FROM f LEFT JOIN n USING (file_id) GROUP BY 1",
    "file_tree": "SELECT DISTINCT path, language, coalesce(symbol_count, 0)::BIGINT AS symbol_count FROM files WHERE path IS NOT NULL",
    "query_suggestions": f"WITH {_S} SELECT row_number() OVER (ORDER BY exported DESC, kind = 'class' DESC, kind = 'function' DESC, name, id)::INTEGER AS rank, 'Inspect ' || kind || ' ' || name || ' in ' || file_path AS suggestion FROM s ORDER BY 1 LIMIT 5",
    "file_summaries": f"""
WITH {_S}, f AS (SELECT DISTINCT file_id, path FROM files WHERE path IS NOT NULL), c AS (SELECT DISTINCT file_id, content FROM file_content WHERE content IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY start_line, start_byte, id) AS n FROM s),
k AS (SELECT file_id, count(*) AS n, string_agg(DISTINCT kind, ', ' ORDER BY kind) AS kinds, string_agg(kind || ' ' || name || ' at line ' || start_line, '|' ORDER BY n) FILTER (n <= 3) AS top FROM o GROUP BY 1),
l AS (SELECT f.*, k.n, k.kinds, k.top, content, list_filter(list_transform(string_split_regex(content, '\\r?\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x != '') AS full_lines FROM f LEFT JOIN k USING (file_id) LEFT JOIN c USING (file_id))
SELECT path, CASE WHEN n IS NOT NULL THEN 'structured' ELSE 'discovery' END AS active_tier, CASE WHEN {_language('path')} IS NOT NULL THEN 'supported-language' ELSE 'generic-discovery' END AS support_reason,
       CASE WHEN n IS NOT NULL THEN 'structured' ELSE 'text-lines' END AS summary_source,
       CASE WHEN n IS NOT NULL THEN upper(regexp_replace({_extension('path')}, '^\\.', '')) || ' file with ' || n || ' indexed symbols' ELSE 'Discovery-only file with ' || len(full_lines) || ' non-empty line' || CASE WHEN len(full_lines) = 1 THEN '' ELSE 's' END END AS summary,
       'high' AS confidence, coalesce(n, 0)::BIGINT AS symbol_count, CASE WHEN n IS NOT NULL THEN 'symbol kinds: ' || kinds || '|' || top ELSE array_to_string(list_transform(full_lines[1:3], lambda x: x[1:120]), '|') END AS hints
FROM l WHERE n IS NOT NULL OR content IS NOT NULL""",
    "symbol_sources": f"""
WITH {_S}, c AS (SELECT DISTINCT file_id, content FROM file_content WHERE content IS NOT NULL), f AS (SELECT DISTINCT file_id, content_hash, integrity_hash, parser_backend, parser_fallback_used, parser_fallback_reason FROM files),
l AS (SELECT s.id, string_split(content, chr(10)) AS lines, content, start_line, end_line, content_hash, integrity_hash FROM s JOIN c USING (file_id) LEFT JOIN f USING (file_id)),
w AS (SELECT *, greatest(1, start_line - 1) AS a, least(len(lines), end_line + 1) AS b FROM l),
x AS (SELECT *, array_to_string(lines[a:b], chr(10)) AS src, CASE WHEN a > 1 THEN array_to_string(lines[1:a - 1], chr(10)) || chr(10) ELSE '' END AS pre FROM w)
SELECT id, 'sha256:' || sha256(src) AS source_hash, coalesce(integrity_hash = 'sha256:' || sha256(content) OR content_hash = sha256(content), false) AS verified, a::BIGINT AS source_start_line, b::BIGINT AS source_end_line, strlen(pre)::BIGINT AS source_start_byte, (strlen(pre) + strlen(src))::BIGINT AS source_end_byte FROM x""",
    "language_support": f"WITH f AS (SELECT DISTINCT path, language FROM files) SELECT language, {_language('path')} AS by_extension, {_tier('path')} AS tier, count(*) AS files FROM f GROUP BY 1, 2, 3",
    "integrity_verification": f"WITH c AS (SELECT DISTINCT file_id, content FROM file_content WHERE content IS NOT NULL) SELECT {_CLEAN.format(c='integrity_hash')} = 'sha256:' || sha256(content) AS integrity_holds, count(*) AS files FROM c JOIN files USING (file_id) GROUP BY 1",
    "token_estimates": "SELECT kind, CAST(sum(greatest(1, ceil(length(text) / 4))) AS BIGINT) AS tokens, count(*) AS documents FROM documents GROUP BY 1",
    "redacted_contents": f"WITH c AS (SELECT DISTINCT file_id, content FROM file_content WHERE content IS NOT NULL) SELECT file_id, sha256({_redacted('content')}) AS redacted_hash FROM c WHERE {_redacted('content')} != content",
    "representatives": f"WITH {_TRADE} SELECT file_path, id FROM rep",
    "dependency_picks": f"WITH {_TRADE} SELECT importer_path, count(DISTINCT id) AS picks, min(id) AS first_id, max(id) AS last_id FROM dep GROUP BY 1",
    "importer_picks": f"WITH {_TRADE} SELECT target_path, count(DISTINCT id) AS importers, min(id) AS first_id FROM imp GROUP BY 1",
    "reference_picks": f"WITH {_TRADE} SELECT w.target_path, w.name, count(DISTINCT w.importer_path) AS refs, min(r.id) AS first_id FROM wants w JOIN rep r ON r.file_path = w.importer_path GROUP BY 1, 2",
    "graph_expansion": f"""
WITH {_TRADE}, d0 AS (SELECT id, file_path FROM sym WHERE id IN ('c1', 'c2')),
r1 AS (SELECT DISTINCT d.id FROM d0 z JOIN dep d ON d.importer_path = z.file_path UNION SELECT DISTINCT i.id FROM d0 z JOIN imp i ON i.target_path = z.file_path),
d1 AS (SELECT s.id, s.file_path FROM r1 JOIN sym s USING (id) WHERE s.id NOT IN (SELECT id FROM d0)), f1 AS (SELECT DISTINCT file_path FROM d1),
r2 AS (SELECT DISTINCT d.id FROM f1 z JOIN dep d ON d.importer_path = z.file_path UNION SELECT DISTINCT i.id FROM f1 z JOIN imp i ON i.target_path = z.file_path),
d2 AS (SELECT id FROM r2 WHERE id NOT IN (SELECT id FROM d0) AND id NOT IN (SELECT id FROM d1))
SELECT 0 AS depth, count(*) AS symbols FROM d0 UNION ALL SELECT 1, count(*) FROM d1 UNION ALL SELECT 2, count(*) FROM d2""",
    "discovered_symbols": f"""
WITH {_TRADE}, d0 AS (SELECT id, file_path FROM sym WHERE id IN ('c1', 'c2')), r1 AS (SELECT DISTINCT d.id FROM d0 z JOIN dep d ON d.importer_path = z.file_path)
SELECT id, 0 AS depth, 'explicit_symbol_id' AS reasons, file_path, line::INTEGER AS start_line, exported FROM sym WHERE id IN ('c1', 'c2')
UNION ALL SELECT id, 1, 'imports_matched_file', file_path, line::INTEGER, exported FROM sym WHERE id IN (SELECT id FROM r1)""",
    "direct_importers": f"WITH {_TRADE} SELECT DISTINCT importer_path AS path FROM edge WHERE target_path IN (SELECT 'suppliers/s' || s_suppkey || '.ts' FROM supplier WHERE s_acctbal < 0)",
    "bundle_items": f"""
WITH {_TRADE}, k AS (SELECT importer_path, id, min(struct_pack(t := target_path, p := name)) AS place FROM dep WHERE importer_path IN ('customers/c1.ts', 'customers/c2.ts') GROUP BY 1, 2),
o AS (SELECT id, 0 AS depth, id AS parent, '' AS t, '' AS p FROM sym WHERE id IN ('c1', 'c2') UNION ALL SELECT id, 1, CASE importer_path WHEN 'customers/c1.ts' THEN 'c1' ELSE 'c2' END, place.t, place.p FROM k),
u AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY id ORDER BY depth, parent, t, p) = 1),
x AS (SELECT u.id, CASE WHEN depth = 0 THEN 'target' ELSE 'dependency' END AS role, CASE WHEN depth = 0 THEN 'explicit_symbol_id' ELSE 'imports_matched_file' END AS reason, (greatest(1, ceil(n / 4)) + 8)::BIGINT AS token_count, depth, parent, t, p FROM u JOIN sym s ON u.id = s.id),
y AS (SELECT *, sum(token_count) OVER (ORDER BY depth, parent, t, p, id) AS used FROM x)
SELECT id, role, reason, token_count FROM y WHERE used <= 400""",
    "bundle_summary": f"""
WITH {_TRADE}, u AS (SELECT DISTINCT id FROM dep WHERE importer_path IN ('customers/c1.ts', 'customers/c2.ts') UNION SELECT id FROM sym WHERE id IN ('c1', 'c2')),
k AS (SELECT importer_path, id, min(struct_pack(t := target_path, p := name)) AS place FROM dep WHERE importer_path IN ('customers/c1.ts', 'customers/c2.ts') GROUP BY 1, 2),
o AS (SELECT id, 0 AS depth, id AS parent, '' AS t, '' AS p FROM sym WHERE id IN ('c1', 'c2') UNION ALL SELECT id, 1, CASE importer_path WHEN 'customers/c1.ts' THEN 'c1' ELSE 'c2' END, place.t, place.p FROM k),
q AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY id ORDER BY depth, parent, t, p) = 1),
x AS (SELECT q.*, (greatest(1, ceil(n / 4)) + 8)::BIGINT AS c FROM q JOIN sym USING (id)), y AS (SELECT *, sum(c) OVER (ORDER BY depth, parent, t, p, id) AS used FROM x)
SELECT 400::BIGINT AS token_budget, sum(c)::BIGINT AS estimated_tokens, coalesce(sum(c) FILTER (used <= 400), 0)::BIGINT AS used_tokens, count(*) FILTER (used <= 400) AS item_count, sum(c) > 400 AS truncated FROM y""",
    "extracted_imports": r"""
WITH d AS (SELECT DISTINCT file_id, regexp_extract_all(content, '(?m)^[ \t]*(?:import|export)\s+(?:type\s+)?((?:[\w$*,\s]|\{[^}]*\})*?)\s*from\s*["'']([^"''\n]+)["'']', 1) AS a,
  regexp_extract_all(content, '(?m)^[ \t]*(?:import|export)\s+(?:type\s+)?((?:[\w$*,\s]|\{[^}]*\})*?)\s*from\s*["'']([^"''\n]+)["'']', 2) AS b FROM file_content WHERE content IS NOT NULL AND file_id IS NOT NULL),
z AS (SELECT DISTINCT file_id, unnest(b) AS source, unnest(a) AS c FROM d),
n AS (SELECT file_id, source, list_filter(list_transform(string_split(regexp_extract(c, '(?s)\{(.*)\}', 1), ','), lambda x: trim(x, e' \n\t\r')), lambda x: x != '') AS named, trim(string_split(c, ',')[1], e' \n\t\r') AS first, regexp_matches(c, '\*\s+as\s+') AS space FROM z),
k AS (SELECT file_id, source, len(named) + (first != '' AND first[1] NOT IN ('{', '*'))::INT + space::INT AS n FROM n)
SELECT source, count(DISTINCT file_id) AS files, CAST(sum(n) AS BIGINT) AS specifiers FROM k WHERE n > 0 GROUP BY 1""".replace("\\\\", "\\"),
    "parser_health": "SELECT count(*) AS indexed_files, count(*) FILTER (parser_backend IS NOT NULL) AS known_files, count(*) FILTER (parser_fallback_used) AS fallback_files, count(*) FILTER (parser_backend IS NULL) AS unknown_files, round(count(*) FILTER (parser_fallback_used) / nullif(count(*) FILTER (parser_backend IS NOT NULL), 0), 6) AS fallback_rate FROM files",
    "parser_fallback_reasons": "SELECT parser_fallback_reason AS reason, count(*) AS files FROM files WHERE parser_fallback_used AND parser_fallback_reason != '' GROUP BY 1",
    "summary_source_counts": f"WITH {_S} SELECT summary_source, count(*) AS symbols FROM s GROUP BY 1",
    "privacy_files": f"SELECT DISTINCT path FROM file_content WHERE path IS NOT NULL AND regexp_matches(content, '{_SECRET}')",
    "privacy_health": f"WITH p AS (SELECT DISTINCT path FROM file_content WHERE path IS NOT NULL AND regexp_matches(content, '{_SECRET}')) SELECT count(*) AS secret_like_files, coalesce((SELECT string_agg(path, '|' ORDER BY path) FROM (SELECT path FROM p ORDER BY path LIMIT 5)), '') AS sample_paths FROM p",
    "broken_specifiers": f"WITH {_TRADE} SELECT importer_path, count(*) AS broken FROM wants w WHERE NOT EXISTS (SELECT 1 FROM sym s WHERE s.file_path = w.target_path AND s.name = w.name AND s.exported) GROUP BY 1",
    "snapshot_drift": """
WITH l AS (SELECT repository_id || '/' || path AS path, content_hash FROM snapshot_entries QUALIFY row_number() OVER (PARTITION BY repository_id, path ORDER BY received_at DESC NULLS LAST, content_hash DESC NULLS LAST) = 1),
d AS (SELECT CASE WHEN f.path IS NULL THEN 'missing' WHEN l.path IS NULL THEN 'extra' WHEN l.content_hash IS DISTINCT FROM f.content_hash THEN 'changed' END AS state FROM l FULL JOIN files f ON l.path = f.path)
SELECT state, count(*) AS files FROM d WHERE state IS NOT NULL GROUP BY 1""",
    "unmapped_files": "WITH c AS (SELECT checkout_id FROM checkout_path_mappings GROUP BY 1 ORDER BY count(*) DESC, checkout_id LIMIT 1) SELECT DISTINCT path FROM files WHERE path IS NOT NULL AND path NOT IN (SELECT relative_path FROM checkout_path_mappings WHERE checkout_id = (SELECT checkout_id FROM c) AND relative_path IS NOT NULL)",
    "top_folders": """
WITH d AS (SELECT DISTINCT CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS path FROM files WHERE path IS NOT NULL)
SELECT path FROM d WHERE NOT EXISTS (SELECT 1 FROM d AS e WHERE starts_with(d.path, e.path || '/'))""",
    "event_report": """
WITH e AS (SELECT event_type IN ('purchase', 'click') AS done, value AS ms, CAST(props->>'$.k' AS DOUBLE) AS k, user_id % 2 = 0 AS ref FROM events)
SELECT count(*) FILTER (done) AS calls, CAST(coalesce(sum(k) FILTER (done), 0) AS BIGINT) AS token_budget_total, CAST(coalesce(sum(k) FILTER (NOT done), 0) AS BIGINT) AS delivered_tokens, CAST(coalesce(sum(k) FILTER (NOT done AND NOT ref), 0) AS BIGINT) AS saved_tokens,
       count(*) FILTER (NOT done AND ref) + greatest(0, count(*) FILTER (done) - count(*) FILTER (NOT done)) AS unavailable_savings, count(*) FILTER (done AND NOT ref) AS full_responses, count(*) FILTER (done AND ref) AS reference_responses,
       count(*) FILTER (done AND ms < 100) AS under_100_ms, count(*) FILTER (done AND ms >= 100 AND ms < 1000) AS under_1000_ms, count(*) FILTER (done AND ms >= 1000) AS over_1000_ms FROM e""",
    "event_latency": "SELECT event_type, count(*) AS calls, count(*) FILTER (value < 100) AS under_100, count(*) FILTER (value >= 100 AND value < 1000) AS under_1000, count(*) FILTER (value >= 1000) AS over_1000, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1",
    "session_references": """
WITH e AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 15 MINUTE, false) AS fresh FROM events),
g AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS span FROM e),
r AS (SELECT event_type AS content_id, CASE WHEN row_number() OVER (PARTITION BY user_id, span, event_type ORDER BY ts, event_id) > 1 THEN 'reference' ELSE 'full' END AS representation FROM g)
SELECT content_id, representation, count(*) AS answers FROM r GROUP BY 1, 2""",
    "judged_tasks": _JUDGED + "SELECT * FROM m",
    "judged_summary": _JUDGED + "SELECT workflow, count(*) AS tasks, CAST(sum(targets) AS BIGINT) AS targets, CAST(sum(hits) AS BIGINT) AS hits, round(100.0 * sum(hits) / sum(targets), 1) AS recall_pct, round(avg(reciprocal_rank), 3) AS mean_reciprocal_rank, round(avg(precision_at_3), 3) AS mean_precision_at_3, count(*) FILTER (top1) AS top1, count(*) FILTER (top3) AS top3 FROM (SELECT *, substr(task, 1, 7) AS workflow FROM m) GROUP BY ROLLUP (workflow)",
    "latest_mappings": "WITH l AS (SELECT checkout_id, relative_path, max(observed_at) AS t FROM checkout_path_mappings GROUP BY 1, 2) SELECT checkout_id, count(*) AS paths, max(t) AS last_at FROM l GROUP BY 1",
    "richest_artifacts": "SELECT artifact_key, parse_output_json, created_at FROM analysis_artifacts QUALIFY row_number() OVER (PARTITION BY artifact_key ORDER BY created_at DESC NULLS LAST, coalesce(length(parse_output_json), -1) DESC, parse_output_json DESC NULLS LAST) = 1",
    "cache_prune": _RECENT_ROWS + "SELECT key, bytes FROM i, t WHERE total - freed > half",
    "retained_events": "SELECT event_type, count(*) AS events FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 3 DAY GROUP BY 1",
}
