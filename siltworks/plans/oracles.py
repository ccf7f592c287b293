"""DuckDB SQL of the corpus engine's queries, written from the data's definition rather than from the Spark code."""

_EXT = "['.py', '.rs', '.ts', '.go', '.java', '.md', '.txt'][doc_id % 7 + 1]"
_FILES = f"files AS (SELECT doc_id, source || '/' || lang || '/doc_' || doc_id || {_EXT} AS path, octet_length(encode(text))::BIGINT AS size, text AS content FROM documents)"
_LANG = "CASE doc_id % 7 WHEN 0 THEN 'python' WHEN 1 THEN 'rust' WHEN 2 THEN 'typescript' WHEN 3 THEN 'go' WHEN 4 THEN 'java' WHEN 5 THEN 'markdown' ELSE 'text' END"
_LINES = r"CASE WHEN content = '' THEN [] ELSE string_split_regex(regexp_replace(content, '\r?\n\z', ''), '\r?\n') END"
_IGNORED = r"CASE WHEN regexp_matches(path, '(^|/)doc_.\.md(/|$)') OR path LIKE '%.txt' THEN TRUE WHEN path LIKE 'src1/en/%' THEN FALSE ELSE path LIKE 'src1/%' END"
_MINI = f"(list_max(list_transform({_LINES}, lambda x: octet_length(encode(x)))) >= 1000 AND (len(list_filter({_LINES}, lambda x: trim(x, E' \\t\\r\\n') <> '')) <= 5 OR list_max(list_transform({_LINES}, lambda x: octet_length(encode(x)))) > octet_length(encode(content)) // 2))"
_SCAN = f"""{_FILES},
judged AS (SELECT path, size, {_LANG} AS language, CASE WHEN {_IGNORED} THEN 'ignored' WHEN size > 8192 THEN 'oversized' WHEN size = 0 THEN 'empty' END AS reason FROM files),
early AS (SELECT path, language FROM judged WHERE reason IS NULL ORDER BY path LIMIT 400),
best AS (SELECT path FROM early ORDER BY CASE WHEN language IN ('markdown', 'text') THEN 2 ELSE 1 END, path LIMIT 100),
scanned AS (SELECT j.path, size, language, CASE WHEN reason IS NULL AND b.path IS NULL THEN 'priority' ELSE reason END AS reason FROM judged j LEFT JOIN best b USING (path))"""
_METRICS = """SELECT path, language, (n_full - comments)::BIGINT AS code_lines, comments::BIGINT AS comment_lines, (n_all - n_full)::BIGINT AS blank_lines, complexity::BIGINT AS complexity"""


def _count(words: list[str], text: str) -> str:
    return " + ".join(f"(length({text}) - length(replace({text}, '{w}', ''))) // {len(w)}" for w in words)


_KEYWORDS = {
    "python": ["if ", "elif ", "for ", "while ", "except ", "and ", "or "],
    "rust": ["if ", "else if ", "for ", "while ", "match ", "&&", "||"],
    "typescript": ["if ", "else if ", "for ", "while ", "switch ", "case ", "&&", "||", "? "],
    "go": ["if ", "else if ", "for ", "switch ", "case ", "&&", "||"],
    "java": ["if ", "else if ", "for ", "while ", "switch ", "case ", "&&", "||"],
}
_COMPLEX = "1 + CASE language " + " ".join(f"WHEN '{k}' THEN {_count(v, 'body')}" for k, v in _KEYWORDS.items()) + " ELSE 0 END"

# The synthetic modules as relations: k supplier, n nation, m number of its imports.
_SYN = """sup AS (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier),
raw_edges AS (SELECT l_suppkey AS src, l_partkey % (SELECT count(*) FROM supplier) AS dst FROM lineitem WHERE l_orderkey % 500 = 0),
paths AS (SELECT k, n, 'src/n' || n || '/s' || k || '.py' AS path FROM sup),
imp AS (SELECT p.path, p.k, row_number() OVER (PARTITION BY e.src ORDER BY e.dst) - 1 AS ord, 'n' || t.n || '.s' || t.k AS target, t.path AS resolved, t.k AS dst FROM raw_edges e JOIN paths p ON p.k = e.src JOIN paths t ON t.k = e.dst),
cnt AS (SELECT p.k, p.path, count(i.k) AS m FROM paths p LEFT JOIN imp i ON i.k = p.k GROUP BY p.k, p.path),
edges AS (SELECT path AS src, resolved AS dst FROM imp WHERE path <> resolved),
sym AS (SELECT k, path, 0 AS ord, 'get_' || (k // 4) AS name, 'function' AS kind, greatest(m, 1) + 3 AS line, 4 AS len, 'public' AS visibility, 'x:int,y:-' AS params, 'int' AS return_type, 'get_' || (k // 4) AS calls, '' AS fields FROM cnt
  UNION ALL SELECT k, path, 1, 'Box' || k, 'class', greatest(m, 1) + 8, 4, 'public', '', NULL, '', '' FROM cnt
  UNION ALL SELECT k, path, 2, 'fill_' || (k // 4), 'method', greatest(m, 1) + 9, 3, 'public', 'size:-', NULL, 'fill_' || (k // 4) || ',get_' || ((k + 4) // 4), '' FROM cnt
  UNION ALL SELECT k, path, 3, '_hide_' || k, 'function', greatest(m, 1) + 13, 4, 'private', 'y:-', NULL, '_hide_' || k, '' FROM cnt),
calls AS (SELECT DISTINCT path, name, unnest(string_split(calls, ',')) AS called FROM sym WHERE calls <> '')"""


def _pagerank(nodes: str, edges: str, start: str) -> str:
    return f"""{start}, g_nodes AS ({nodes}), g_w AS (SELECT src, dst, count(*)::DOUBLE AS w FROM ({edges}) GROUP BY src, dst), g_out AS (SELECT src, sum(w) AS total FROM g_w GROUP BY src), g_n AS (SELECT count(*)::DOUBLE AS n FROM g_nodes),
pr AS (
  SELECT 0 AS it, node, 1 / n AS r, 1e9::DOUBLE AS moved FROM g_nodes, g_n
  UNION ALL
  SELECT it + 1, node, new, sum(abs(new - r)) OVER () FROM (
    SELECT p.it, p.node, p.r, 0.15 / n + 0.85 * (coalesce(s.got, 0) + (SELECT coalesce(sum(q.r), 0) FROM pr q WHERE q.node NOT IN (SELECT src FROM g_out)) / n) AS new
    FROM pr p CROSS JOIN g_n LEFT JOIN (SELECT w.dst, sum(q.r * w.w / o.total) AS got FROM pr q JOIN g_w w ON w.src = q.node JOIN g_out o ON o.src = w.src GROUP BY w.dst) s ON s.dst = p.node
    WHERE p.it < 100 AND p.moved >= 1e-6
  )
),
final AS (SELECT node, r AS score FROM pr WHERE it = (SELECT max(it) FROM pr))"""


_CHUNKS = f"""{_FILES}, rows AS (SELECT path, unnest({_LINES}) AS line, generate_subscripts({_LINES}, 1) AS i FROM files),
chunk AS (SELECT path, (i - 1) // 30 AS chunk0, min(i) AS line_start, max(i) AS line_end, string_agg(line, chr(10) ORDER BY i) AS content FROM rows GROUP BY path, (i - 1) // 30),
chunks AS (SELECT path, (row_number() OVER (PARTITION BY path ORDER BY line_start) - 1)::BIGINT AS chunk, line_start::BIGINT AS line_start, line_end::BIGINT AS line_end, content FROM chunk WHERE regexp_matches(content, '\\S')),
toks AS (SELECT path, chunk, unnest(regexp_extract_all(lower(content), '[a-zA-Z_][\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]*')) AS token FROM chunks),
tf AS (SELECT path, chunk, token, count(*) AS tf FROM toks GROUP BY ALL),
idf AS (SELECT token, count(*) AS df, ln((SELECT count(*) FROM chunks)::DOUBLE / (count(*) + 1)) AS idf FROM tf GROUP BY token),
weights AS (SELECT path, chunk, token, tf * idf AS w FROM tf JOIN idf USING (token)),
norms AS (SELECT path, chunk, sqrt(sum(w * w)) AS norm FROM weights GROUP BY ALL)"""
_TOP = f"""{_CHUNKS}, asked AS (SELECT question, token, count(*) * any_value(idf) AS q FROM (SELECT item_id AS question, unnest(regexp_extract_all(lower(text), '[a-zA-Z_][\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]*')) AS token FROM benchmark) JOIN idf USING (token) GROUP BY ALL),
qn AS (SELECT question, sqrt(sum(q * q)) AS qn FROM asked GROUP BY question),
scored AS (SELECT question, path, chunk, round(sum(q * w) / (any_value(norm) * any_value(qn)), 9) AS score FROM weights JOIN asked USING (token) JOIN norms USING (path, chunk) JOIN qn USING (question) WHERE norm > 0 AND qn > 0 GROUP BY question, path, chunk),
top AS (SELECT question, row_number() OVER (PARTITION BY question ORDER BY score DESC, path, chunk) AS rank, path, chunk, score FROM scored QUALIFY rank <= 5)"""
_KV = "kv AS (SELECT user_id || ':' || event_type AS key, props AS value, epoch_us(ts) / 1e6 AS created_at, event_id FROM events), newest AS (SELECT * FROM kv QUALIFY row_number() OVER (PARTITION BY key ORDER BY created_at DESC, event_id DESC) = 1)"
_HASH = "substr(sha256({}), 1, 24)"
_TRADE = "SELECT s_nationkey::BIGINT AS src, c_nationkey::BIGINT AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> c_nationkey"
_USERS = "ue AS (SELECT user_id AS src, dst FROM (SELECT *, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events) WHERE event_type = 'error' AND user_id <> dst)"
_DEG = "deg AS (SELECT p.path AS node, coalesce(i.n, 0) AS n_in, coalesce(o.n, 0) AS n_out FROM paths p LEFT JOIN (SELECT dst, count(*) AS n FROM edges GROUP BY dst) i ON i.dst = p.path LEFT JOIN (SELECT src, count(*) AS n FROM edges GROUP BY src) o ON o.src = p.path)"
_MODS = "mods AS (SELECT DISTINCT string_split(src, '/')[2] AS src, string_split(dst, '/')[2] AS dst FROM edges WHERE string_split(src, '/')[2] <> string_split(dst, '/')[2])"
_SYN_TEXT = """bodies AS (SELECT k, path, coalesce((SELECT string_agg('import ' || target, chr(10) ORDER BY ord) FROM imp i WHERE i.k = c.k), '') || chr(10) || chr(10) || '# module s' || k || chr(10) || 'def get_' || (k // 4) || '(x: int, y=1) -> int:' || chr(10) || '    if x > ' || (k % 9) || ' and x < 100:' || chr(10) || '        return x' || chr(10) || '    return 0' || chr(10) || chr(10) || 'class Box' || k || ':' || chr(10) || '    def fill_' || (k // 4) || '(self, size=get_' || ((k + 4) // 4) || '(2)):' || chr(10) || '        self.size = size' || chr(10) || '        self.kind = ''k''' || chr(10) || chr(10) || 'def _hide_' || k || '(y):' || chr(10) || '    for i in range(3):' || chr(10) || '        y = y + i' || chr(10) || '    return y' || chr(10) AS content FROM cnt c)"""

ORACLES = {
    "repo_map_topn": f"WITH RECURSIVE {_pagerank('SELECT path AS node FROM paths', 'SELECT * FROM edges', _SYN)} SELECT node AS path, round(score, 6) AS score, 'python' AS language, (greatest(m, 1) + 17)::BIGINT AS lines FROM final JOIN cnt ON path = node ORDER BY round(score, 9) DESC, node LIMIT 20",
    "scan_report": f"WITH {_SCAN} SELECT count(*) FILTER (reason IS NULL OR reason <> 'ignored') AS candidates, count(*) FILTER (reason IS NULL) AS kept, count(*) FILTER (reason = 'oversized') AS oversized_count, 0::BIGINT AS binary_count, 0::BIGINT AS minified_count, count(*) FILTER (reason = 'priority') AS priority_dropped, coalesce(array_to_string(list(path ORDER BY path) FILTER (reason = 'oversized')[1:3], ','), '') AS oversized FROM scanned",
    "drop_reasons": f"WITH {_SCAN} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM scanned GROUP BY 1",
    "scan_kept_files": f"WITH {_SCAN} SELECT path, size, language FROM scanned WHERE reason IS NULL",
    "ignore_rules": f"WITH {_FILES} SELECT path, {_IGNORED} AS ignored FROM files",
    "minified_detection": f"WITH {_FILES} SELECT regexp_replace(path, '\\.[a-z]+$', '.min2.js') AS path, coalesce({_MINI}, FALSE) AS minified FROM files",
    "language_histogram": f"SELECT {_LANG} AS language, count(*) AS n_files, sum(octet_length(encode(text)))::BIGINT AS n_bytes FROM documents GROUP BY 1 ORDER BY n_files DESC, language LIMIT 10",
    "file_tree": f"WITH {_FILES} SELECT path AS entry FROM files UNION SELECT source || '/' FROM documents UNION SELECT source || '/' || lang || '/' FROM documents",
    "line_counts": f"WITH {_FILES} SELECT path, (length(content) - length(replace(content, chr(10), '')) + 1)::BIGINT AS lines FROM files",
    "previews": f"WITH {_FILES} SELECT path, FALSE AS is_config, FALSE AS is_entrypoint, {_HASH.format(f'array_to_string(({_LINES})[1:2], chr(10))')} AS preview_hash FROM files",
    "file_metrics": f"WITH {_FILES}, cut AS (SELECT path, {_LANG} AS language, list_transform({_LINES}, lambda x: trim(x, E' \\t\\r\\n')) AS rows FROM files), sized AS (SELECT path, language, len(rows) AS n_all, len(list_filter(rows, lambda x: x <> '')) AS n_full, array_to_string(list_filter(rows, lambda x: x <> ''), chr(10)) AS body, CASE language WHEN 'python' THEN len(list_filter(rows, lambda x: x LIKE '#%')) ELSE 0 END AS comments FROM cut), m AS (SELECT *, {_COMPLEX} AS complexity FROM sized) {_METRICS} FROM m",
    "file_metrics_synth": f"WITH {_SYN} SELECT path, 'python' AS language, (m + 12)::BIGINT AS code_lines, 1::BIGINT AS comment_lines, (CASE WHEN m = 0 THEN 4 ELSE 3 END)::BIGINT AS blank_lines, 5::BIGINT AS complexity FROM cnt",
    "imports_raw": f"WITH {_SYN} SELECT path, ord, target FROM imp",
    "imports_resolved": f"WITH {_SYN} SELECT path, ord, target, resolved FROM imp",
    "import_unresolved": f"WITH {_SYN} SELECT path, ord, target FROM imp WHERE k % 3 <> 0 AND dst % 3 = 0",
    "module_deps": f"WITH {_SYN}, {_MODS} SELECT src, dst FROM mods",
    "mermaid": f"WITH {_SYN}, {_MODS} SELECT 'graph LR' || chr(10) || coalesce(string_agg('    ' || src || ' --> ' || dst, chr(10) ORDER BY '    ' || src || ' --> ' || dst), '') AS text FROM mods",
    "module_rollup": f"WITH {_SYN} SELECT 'n' || n AS module, count(*) AS files, (4 * count(*))::BIGINT AS symbols, (5 * count(*))::BIGINT AS complexity FROM sup GROUP BY n",
    "py_symbols": f"WITH {_SYN} SELECT path, ord::BIGINT AS ord, name, kind, line::BIGINT AS line, (line + len - 1)::BIGINT AS end_line, visibility, params, return_type, calls, fields FROM sym",
    "symbol_index": f"WITH {_SYN} SELECT name, string_agg(path, ',' ORDER BY path, ord) AS paths, count(*) AS n FROM sym GROUP BY name",
    "exports": f"WITH {_SYN} SELECT path, string_agg(name, ',' ORDER BY ord) AS exports FROM sym WHERE visibility = 'public' GROUP BY path",
    "call_graph": f"WITH {_SYN} SELECT DISTINCT c.path AS from_file, c.name AS from_symbol, s.path AS to_file, s.name AS to_symbol FROM calls c JOIN sym s ON s.name = c.called WHERE c.path <> s.path",
    "ambiguous_names": f"WITH {_SYN} SELECT name, count(*) AS n FROM sym GROUP BY name HAVING count(*) > 1",
    "snippet_symbols": """SELECT 'snippet' || s_suppkey || '.' || a AS path, b::BIGINT AS ord, c AS name, d AS kind, e::BIGINT AS line, f::BIGINT AS end_line, g AS visibility FROM (VALUES
('rust', 0, 'open', 'function', 1, 3, 'public'), ('rust', 1, 'Point', 'struct', 4, 6, 'private'), ('rust', 2, 'Shape', 'enum', 7, 7, 'public'), ('rust', 3, 'fn', 'constant', 8, 8, 'private'), ('rust', 4, 'len', 'method', 10, 12, 'public'), ('rust', 5, 'twice', 'macro', 14, 14, 'private'),
('typescript', 0, 'Box', 'class', 1, 5, 'public'), ('typescript', 1, 'fill', 'method', 2, 4, 'private'), ('typescript', 2, 'pour', 'method', 3, 3, 'public'), ('typescript', 3, 'add', 'function', 6, 8, 'public'), ('typescript', 4, 'plain', 'function', 7, 8, 'private'), ('typescript', 5, 'Shape', 'interface', 9, 10, 'private'), ('typescript', 6, 'Id', 'type_alias', 11, 11, 'private'),
('go', 0, 'Open', 'function', 3, 4, 'public'), ('go', 1, 'fill', 'method', 5, 6, 'private'), ('go', 2, 'Box', 'struct', 7, 8, 'public'), ('go', 3, 'Shape', 'interface', 9, 10, 'public'), ('go', 4, 'Id', 'type_alias', 11, 11, 'public'),
('java', 0, 'Box', 'class', 1, 6, 'public'), ('java', 1, 'size', 'constant', 2, 2, 'private'), ('java', 2, 'fill', 'method', 3, 5, 'public'), ('java', 3, 'pour', 'method', 4, 4, 'public'), ('java', 4, 'Shape', 'interface', 7, 8, 'public')) t(a, b, c, d, e, f, g), supplier""",
    "pagerank_trade": f"WITH RECURSIVE {_pagerank('SELECT n_nationkey::BIGINT AS node FROM nation', 'SELECT * FROM trade', f'trade AS ({_TRADE})')} SELECT node, round(score, 6) AS score FROM final",
    "degrees": f"WITH {_USERS}, nodes AS (SELECT src AS node FROM ue UNION SELECT dst FROM ue) SELECT node, (SELECT count(*) FROM ue WHERE dst = node) AS n_in, (SELECT count(*) FROM ue WHERE src = node) AS n_out FROM nodes",
    "entry_points": f"WITH {_SYN}, {_DEG} SELECT node, n_in, n_out FROM deg WHERE n_in <= 1 AND n_out > 0",
    "isolated": f"WITH {_SYN}, {_DEG} SELECT node FROM deg WHERE n_in = 0 AND n_out = 0",
    "scc": f"WITH RECURSIVE {_SYN}, e AS (SELECT DISTINCT src, dst FROM edges), reach AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM reach r JOIN e ON e.src = r.dst), pairs AS (SELECT a.src AS node, a.dst AS other FROM reach a JOIN reach b ON b.src = a.dst AND b.dst = a.src) SELECT node, least(node, min(other)) AS component, count(DISTINCT other) AS size FROM pairs GROUP BY node HAVING count(DISTINCT other) > 1",
    "trace_flow": f"WITH RECURSIVE {_SYN}, c AS (SELECT DISTINCT path AS f, resolved AS t FROM imp), walk AS (SELECT f, t, 1 AS depth FROM c WHERE f = (SELECT path FROM paths WHERE k = (SELECT min(src) FROM raw_edges)) UNION SELECT c.f, c.t, w.depth + 1 FROM walk w JOIN c ON c.f = w.t WHERE w.depth < 4) SELECT f AS from_symbol, t AS to_symbol, min(depth)::BIGINT AS depth FROM walk GROUP BY f, t",
    "chunks": f"WITH {_CHUNKS} SELECT path, chunk, line_start, line_end, {_HASH.format('content')} AS hash FROM chunks",
    "tf": f"WITH {_CHUNKS} SELECT path, chunk, token, tf FROM tf",
    "idf": f"WITH {_CHUNKS} SELECT token, df, round(idf, 6) AS idf FROM idf",
    "chunk_norms": f"WITH {_CHUNKS} SELECT path, chunk, round(norm, 5) AS norm FROM norms",
    "retrieve_top5": f"WITH {_TOP} SELECT question, rank, path, chunk, round(score, 6) AS score FROM top WHERE score > 0",
    "rag_context": f"WITH {_TOP} SELECT item_id AS question, sha256(coalesce(t, 'No matching passages were found.')) AS context_sha256 FROM benchmark LEFT JOIN (SELECT question, string_agg('### ' || path || ':' || line_start || '-' || line_end || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS t FROM top JOIN chunks USING (path, chunk) WHERE score > 0 GROUP BY question) ON question = item_id",
    "content_hash": f"WITH {_FILES} SELECT path, {_HASH.format('content')} AS hash FROM files",
    "fingerprint": f"WITH {_SYN}, {_SYN_TEXT} SELECT substr(sha256(unhex(hex(encode('/corpus')) || string_agg(hex(encode(path)) || hex(encode(octet_length(encode(content))::VARCHAR)) || sha256(content), '' ORDER BY path))), 1, 24) AS fingerprint FROM bodies",
    "truncate_utf8": "SELECT doc_id, " + ", ".join(f"list_max(list_filter(list_transform(range(0, least(length(text), {n}) + 1), lambda i: octet_length(encode(left(text, i)))), lambda b: b <= {n}))::BIGINT AS bytes_{n}" for n in (50, 101)) + ", (CASE WHEN octet_length(encode(text)) <= 4096 THEN octet_length(encode(text)) ELSE list_max(list_filter(list_transform(range(0, 4), lambda j: octet_length(encode(regexp_replace(decode(encode(text)[1:0]), '', '')))), lambda b: b <= 4096)) END)::BIGINT AS bytes_4096 FROM documents",
    "cache_latest": f"WITH {_KV} SELECT key, value, round(created_at, 3) AS created_at FROM newest",
    "cache_ttl": f"WITH {_KV} SELECT key, value FROM newest WHERE epoch_us(TIMESTAMP '2024-01-31 00:00:00') / 1e6 - created_at <= 7 * 86400 AND json_valid(value)",
    "incremental_plan": "SELECT doc_id AS page_id, CASE doc_id % 10 WHEN 0 THEN 'written' WHEN 1 THEN 'removed' WHEN 2 THEN 'written' ELSE 'kept' END AS action FROM documents",
    "chat_window": f"SELECT conv_id, turn, role, {_HASH.format('text')} AS hash FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4 AND role IN ('user', 'assistant') AND regexp_matches(text, '\\S')",
    "normalize_path": f"WITH {_FILES} SELECT path, path AS normal FROM files",
    "module_names": f"WITH {_FILES}, p AS (SELECT doc_id % 4 AS i, doc_id, path FROM files) SELECT ['src/', 'crates/', 'lib/', ''][i + 1] || path AS path, CASE i WHEN 1 THEN 'crates' ELSE string_split(path, '/')[1] END AS graph_module, string_split(path, '/')[1] AS index_module FROM p",
    "rel_href": "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source || '/' || lang || '/doc_' || doc_id WHEN 1 THEN CASE WHEN source = 'src0' THEN '' ELSE '../src' || substr(source, 4) || '/' END || lang || '/doc_' || doc_id WHEN 2 THEN CASE WHEN source = 'src1' AND lang = 'en' THEN '' WHEN source = 'src1' THEN '../' || lang || '/' ELSE '../../' || source || '/' || lang || '/' END || 'doc_' || doc_id ELSE '../../../' || source || '/' || lang || '/doc_' || doc_id END || '.md' AS href FROM documents",
    "strip_md": "SELECT page_id, 'see [a](' || page_id || ') and [b](' || url || '.md) and [c](x/y)' AS text FROM pages",
    "html_escape": f"SELECT page_id, {_HASH.format(chr(10).join(['replace(replace(replace(replace(html, ', repr('&'), ',', repr('&amp;'), '),', repr('<'), ',', repr('&lt;'), '),', repr('>'), ',', repr('&gt;'), '),', repr(chr(34)), ',', repr('&quot;'), ')']))} AS hash FROM pages",
    "git_url_parse": "SELECT page_id, CASE WHEN page_id % 4 < 3 THEN ['github.com', 'gitlab.com', 'bitbucket.org'][page_id % 4 + 1] END AS host, CASE WHEN page_id % 4 < 3 THEN 'own' || page_id END AS owner, CASE WHEN page_id % 4 < 3 THEN 'repo' || page_id END AS repo FROM pages",
    "extract_json": """SELECT doc_id::VARCHAR AS key, CASE WHEN doc_id % 4 < 3 THEN '{"id": ' || doc_id || ', "k": [1, 2]}' END AS json FROM documents""",
    "completions": "SELECT item_id::VARCHAR AS key, (3 + length(text))::BIGINT AS chars FROM benchmark",
    "cross_links": f"WITH {_SYN}, spans AS (SELECT k, 'src/n0/s0.py' AS span FROM sup UNION SELECT k, 'Box' || k FROM sup UNION SELECT k, 'Box' || ((k + 1) % 7) FROM sup), targets AS (SELECT path AS span, 'files/' || k AS target FROM paths UNION ALL SELECT name, 'files/' || any_value(k) FROM sym GROUP BY name HAVING count(*) = 1) SELECT 'files/' || s.k AS page_id, s.span, t.target FROM spans s JOIN targets t USING (span) WHERE 'files/' || s.k <> t.target",
    "symbol_page_counts": f"WITH {_SYN} SELECT kind, 'n' || sup.n AS module, count(DISTINCT name) AS n FROM sym JOIN sup USING (k) GROUP BY ALL",
    "stream_incremental": f"SELECT doc_id, {_HASH.format('text')} AS content_hash, len(string_split(text, chr(10)))::BIGINT AS n_lines FROM documents",
}
_CODE = "'- `' || {} || '`'"
_SECTION = "coalesce((SELECT '## {}' || chr(10) || string_agg({}, chr(10) ORDER BY {}) || chr(10) FROM ({})), '')"
ORACLES["dependency_page"] = (
    f"WITH RECURSIVE {_pagerank('SELECT path AS node FROM paths', 'SELECT * FROM edges', _SYN)}, {_DEG}, {_MODS}, e AS (SELECT DISTINCT src, dst FROM edges), reach AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM reach r JOIN e ON e.src = r.dst), "
    "rings AS (SELECT component, count(*) AS n, string_agg(node, '` -> `' ORDER BY node) AS members FROM (SELECT a.src AS node, min(a.dst) AS component, count(DISTINCT a.dst) AS size FROM reach a JOIN reach b ON b.src = a.dst AND b.dst = a.src GROUP BY a.src) WHERE size > 1 GROUP BY component) SELECT 'dependencies' AS page_id, '# Dependencies' || chr(10) || "
    + " || ".join((
        _SECTION.format("Core files", _CODE.format("node"), "round(score, 9) DESC, node", "SELECT node, score FROM final ORDER BY round(score, 9) DESC, node LIMIT 10"),
        _SECTION.format("Entry points", _CODE.format("node"), "node", "SELECT node FROM deg WHERE n_in <= 1 AND n_out > 0 ORDER BY node LIMIT 10"),
        _SECTION.format("Cycles", _CODE.format("members"), "n DESC, component", "SELECT * FROM rings ORDER BY n DESC, component LIMIT 10"),
        _SECTION.format("Isolated files", _CODE.format("node"), "node", "SELECT node FROM deg WHERE n_in = 0 AND n_out = 0 ORDER BY node LIMIT 15"),
        "'## Modules' || chr(10) || '```mermaid' || chr(10) || (SELECT 'graph LR' || chr(10) || coalesce(string_agg('    ' || src || ' --> ' || dst, chr(10) ORDER BY '    ' || src || ' --> ' || dst), '') FROM mods) || chr(10) || '```' || chr(10)",
    ))
    + " AS content"
)
ORACLES["module_hash"] = f"WITH {_SYN}, {_SYN_TEXT} SELECT string_split(path, '/')[2] AS module, substr(sha256(string_agg(substr(sha256(content), 1, 24), ':' ORDER BY path)), 1, 24) AS hash FROM bodies GROUP BY 1"
ORACLES["module_context"] = f"""WITH {_SYN}, lines AS (SELECT path, ord, '- ' || kind || ' ' || name || '(' || CASE ord WHEN 0 THEN 'x: int, y' WHEN 2 THEN 'size' WHEN 3 THEN 'y' ELSE '' END || ')' || coalesce(' -> ' || return_type, '') AS t FROM sym),
per_file AS (SELECT path, '### ' || path || chr(10) || string_agg(t, chr(10) ORDER BY ord) AS t FROM lines GROUP BY path) SELECT string_split(path, '/')[2] AS module, string_agg(t, chr(10) || chr(10) ORDER BY path) AS context FROM per_file GROUP BY 1"""
ORACLES["module_summaries"] = "SELECT 'n' || s_nationkey AS module, 'Module containing ' || count(*) || ' files' AS purpose FROM supplier GROUP BY s_nationkey"
ORACLES["sidebar"] = "SELECT '- [Overview](index.md)' || chr(10) || '- Modules' || chr(10) || (SELECT string_agg('  - [n' || k || '](modules/n' || k || '.md)', chr(10) ORDER BY 'modules/n' || k) FROM (SELECT DISTINCT s_nationkey AS k FROM supplier)) || chr(10) || '- [Dependencies](dependencies.md)' || chr(10) || '- [Symbols](symbols.md)' AS text"
ORACLES["stream_text"] = "SELECT item_id::VARCHAR AS key, 'id ' || item_id AS text FROM benchmark"
ORACLES["usage_totals"] = "SELECT sum(item_id)::BIGINT AS prompt_tokens, (2 * count(*))::BIGINT AS completion_tokens FROM benchmark"
# Texts over the cut are left to the byte rule of truncate_utf8.
ORACLES["key_files_context"] = "WITH b AS (SELECT doc_id, text, octet_length(encode(text)) AS size, hex(encode(text)) AS h FROM documents WHERE doc_id % 50 = 0), cut AS (SELECT doc_id, CASE WHEN size <= 4096 THEN text ELSE decode(unhex(substr(h, 1, 2 * CASE WHEN substr(h, 8193, 1) NOT IN ('8', '9', 'A', 'B') THEN 4096 WHEN substr(h, 8191, 1) NOT IN ('8', '9', 'A', 'B') THEN 4095 WHEN substr(h, 8189, 1) NOT IN ('8', '9', 'A', 'B') THEN 4094 ELSE 4093 END))) END AS t FROM b) SELECT sha256(string_agg('## p' || doc_id || '/README.md' || chr(10) || t, chr(10) || chr(10) ORDER BY doc_id)) AS context_sha256 FROM cut"
# A cut at a byte count steps back over the followers of an unfinished character.
ORACLES["truncate_utf8"] = "WITH b AS (SELECT doc_id, octet_length(encode(text)) AS size, hex(encode(text)) AS h FROM documents) SELECT doc_id, " + ", ".join(
    f"(CASE WHEN size <= {n} THEN size WHEN substr(h, {2 * n + 1}, 1) NOT IN ('8', '9', 'A', 'B') THEN {n} WHEN substr(h, {2 * n - 1}, 1) NOT IN ('8', '9', 'A', 'B') THEN {n - 1} WHEN substr(h, {2 * n - 3}, 1) NOT IN ('8', '9', 'A', 'B') THEN {n - 2} ELSE {n - 3} END)::BIGINT AS bytes_{n}" for n in (50, 101, 4096)
) + " FROM b"
ORACLES["imports_indexed"] = f"WITH {_SYN} SELECT path, ord, 'import ' || target AS raw, resolved, '' AS symbols FROM imp"
ORACLES["module_internal_edges"] = f"WITH {_SYN} SELECT string_split(path, '/')[2] AS module, path AS src, resolved AS dst FROM imp WHERE string_split(path, '/')[2] = string_split(resolved, '/')[2]"
ORACLES["module_external_deps"] = f"WITH {_SYN}, {_MODS} SELECT src AS module, dst AS dependency FROM mods"
ORACLES["trace_calls"] = f"""WITH RECURSIVE {_SYN}, c AS (SELECT DISTINCT c.path AS f, c.name AS a, s.path AS t, s.name AS b FROM calls c JOIN sym s ON s.name = c.called WHERE c.path <> s.path),
walk AS (SELECT f, a, t, b, 1 AS depth FROM c WHERE a = 'fill_0' UNION SELECT c.f, c.a, c.t, c.b, w.depth + 1 FROM walk w JOIN c ON c.f = w.t AND c.a = w.b WHERE w.depth < 3)
SELECT a AS from_symbol, b AS to_symbol, min(depth)::BIGINT AS depth FROM walk GROUP BY a, b"""
