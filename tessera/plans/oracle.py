"""DuckDB twins of the catalog's queries."""

from __future__ import annotations

from tessera.functions.text import QUESTION_WORDS, STOP_WORDS
from tessera.plans.catalog import BUDGET, CAP, CASELESS, CONTEXT, EXACT, NAMES

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_LINES = r"""
parts AS (
  SELECT doc_id AS file_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL AND text <> ''
), raw AS (
  SELECT file_id, unnest(p) AS raw, generate_subscripts(p, 1) AS n, len(p) AS c FROM parts
), lines AS (
  SELECT file_id, line_number, line, start_byte, CAST(start_byte + strlen(line) AS BIGINT) AS end_byte FROM (
    SELECT file_id, CAST(n AS INTEGER) AS line_number, regexp_replace(raw, '\r$', '') AS line,
      CAST(coalesce(sum(strlen(raw) + 1) OVER (PARTITION BY file_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_byte
    FROM raw WHERE NOT (n = c AND raw = '')
  )
)"""
_FILES = "files AS (SELECT doc_id AS file_id, coalesce(source, '') || '/' || doc_id || '.' || coalesce(lang, '') AS path, lang AS language, text FROM documents)"


def _asked(queries: dict) -> str:
    rows = ", ".join(f"({q}, '{p if isinstance(p, str) else p[0]}')" for q, p in queries.items())
    return f"asked(query_id, query) AS (VALUES {rows})"


def _found(predicate: str, name: str = "found", where: str = "TRUE") -> str:
    return f"""{name} AS (
  SELECT CAST(query_id AS BIGINT) AS query_id, file_id, line_number, line, start_byte, end_byte FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, file_id ORDER BY line_number) AS k FROM lines, asked WHERE {predicate} AND {where}
  ) WHERE k <= {CAP}
)"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n"


_ALL_FOUND = "SELECT query_id, file_id, line_number, line, start_byte, end_byte FROM found"
_TERMS = rf"""
docs AS (
  SELECT * FROM (SELECT *, regexp_replace(line, '^\s+', '') AS plain FROM lines) WHERE regexp_matches(line, '\S') AND NOT starts_with(plain, '//') AND NOT starts_with(plain, '#')
), split AS (
  SELECT file_id, line_number, start_byte, end_byte, list_filter(regexp_split_to_array(lower(line), '[^\pL\pN]+'), lambda t: t <> '' AND t NOT IN ({_STOP})) AS t FROM docs
), terms AS (
  SELECT file_id, line_number, start_byte, end_byte, term, CAST(greatest(floor(count(*) * 100 / any_value(n)), 1) AS BIGINT) AS tf
  FROM (SELECT file_id, line_number, start_byte, end_byte, unnest(t) AS term, len(t) AS n FROM split) GROUP BY ALL
), idf AS (
  SELECT term, df, ln((SELECT count(*) FROM docs) / df) + 1 AS idf FROM (SELECT term, count(*) AS df FROM terms GROUP BY term)
), norms AS (
  SELECT file_id, line_number, sqrt(sum(tf * tf)) AS norm FROM terms GROUP BY ALL
)""".replace("GROUP BY ALL\n), idf", "GROUP BY file_id, line_number, start_byte, end_byte, term\n), idf")
_NEAR = rf"""
words AS (
  SELECT query_id, unnest(t) AS term, len(t) AS n FROM (
    SELECT query_id, list_filter(regexp_split_to_array(lower(query), '[^\pL\pN]+'), lambda t: t <> '' AND t NOT IN ({_STOP})) AS t FROM asked)
), weights AS (
  SELECT query_id, w.term, greatest(floor(c * 100 / n), 1) * idf AS weight FROM (SELECT query_id, term, n, count(*) AS c FROM words GROUP BY query_id, term, n) w JOIN idf USING (term)
), sizes AS (
  SELECT query_id, greatest(sqrt(sum(weight * weight)), 1e-10) AS size FROM weights GROUP BY query_id
), near AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, file_id, start_byte) AS k FROM (
      SELECT CAST(query_id AS BIGINT) AS query_id, file_id, line_number, start_byte, end_byte, sum(weight * tf) / (any_value(size) * any_value(norm)) AS score
      FROM terms JOIN weights USING (term) JOIN sizes USING (query_id) JOIN norms USING (file_id, line_number)
      GROUP BY query_id, file_id, line_number, start_byte, end_byte)
    WHERE score > 0) WHERE k <= 100
)"""


def _symbols(length: int) -> str:
    return rf"""
named AS (
  SELECT *, t[1] AS name, CAST(file_id * 4294967296 + start_byte AS BIGINT) AS symbol_id FROM (
    SELECT *, list_filter(regexp_split_to_array(lower(line), '[^\pL\pN]+'), lambda t: t <> '') AS t FROM lines) WHERE length(t[1]) >= {length}
), calls AS (
  SELECT symbol_id AS caller, file_id, callee FROM (SELECT symbol_id, file_id, name, unnest(t[2:]) AS callee FROM named) WHERE callee <> name
), edges AS (
  SELECT from_id, to_id, 'Calls' AS relationship FROM (
    SELECT c.caller AS from_id, coalesce(h.id, g.id) AS to_id FROM calls c
    JOIN (SELECT name, min(symbol_id) AS id FROM named GROUP BY name) g ON g.name = c.callee
    LEFT JOIN (SELECT name, file_id, min(symbol_id) AS id FROM named GROUP BY name, file_id) h ON h.name = c.callee AND h.file_id = c.file_id)
)"""


def _walk(near: str, far: str, length: int = 8) -> str:
    return (
        _with(_LINES, _symbols(length)).replace("WITH ", "WITH RECURSIVE ", 1)
        + f""", steps AS (SELECT DISTINCT {near} AS a, {far} AS b FROM edges
), walk AS (
  SELECT a AS root, b AS node, 1 AS depth FROM steps
  UNION SELECT w.root, s.b, w.depth + 1 FROM walk w JOIN steps s ON s.a = w.node WHERE w.depth < 3
) SELECT root, node, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY root, node"""
    )


_CANDIDATES = _with(_LINES, _asked(CONTEXT), _symbols(4), _TERMS, _NEAR, _found("contains(line, query)")) + r""", candidates AS (
  SELECT CAST(query_id AS BIGINT) AS query_id, 0 AS source, symbol_id, file_id, start_byte, end_byte, name, 40::DOUBLE AS reference, 0::DOUBLE AS similarity, query FROM named JOIN asked ON name = query
  UNION ALL SELECT query_id, 1, NULL, file_id, start_byte, end_byte, 'match:' || regexp_replace(regexp_replace(line, '^\s+', ''), '\s+$', ''), 0::DOUBLE, 0::DOUBLE, query FROM found JOIN asked USING (query_id)
  UNION ALL SELECT query_id, 2, NULL, file_id, start_byte, end_byte, 'semantic:' || file_id || ':' || start_byte, 0::DOUBLE, score::DOUBLE, query FROM near JOIN asked USING (query_id)
), ranked AS (
  SELECT *, symbol_match + definition + reference + semantic AS total FROM (
    SELECT *, CASE WHEN name = query THEN 100.0 WHEN contains(lower(name), lower(query)) THEN 50.0 ELSE 0.0 END AS symbol_match, 80.0 AS definition,
      similarity * 150::DOUBLE AS semantic FROM candidates)
)"""
_PLAN = _CANDIDATES.replace("WITH ", "WITH RECURSIVE ", 1) + f""", single AS (
  SELECT *, (end_byte - start_byte + 3) // 4 AS tokens FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, file_id, start_byte ORDER BY round(total, 9) DESC, source, symbol_id) AS k FROM ranked) WHERE k = 1
), steps AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(total, 9) DESC, source, file_id, start_byte) AS rn FROM single WHERE tokens <= {BUDGET.max_tokens}
), fold AS (
  SELECT query_id, 0::BIGINT AS rn, 0::BIGINT AS total, []::BIGINT[] AS files, 0::BIGINT AS n, FALSE AS taken FROM (SELECT DISTINCT query_id FROM steps)
  UNION ALL
  SELECT query_id, rn, CASE WHEN ok THEN total + tokens ELSE total END, CASE WHEN ok AND NOT list_contains(files, file_id) THEN list_append(files, file_id) ELSE files END,
    CASE WHEN ok THEN n + 1 ELSE n END, ok
  FROM (
    SELECT s.query_id, s.rn, f.total, f.files, f.n, s.tokens, s.file_id,
      f.total + s.tokens <= {BUDGET.max_tokens} AND (list_contains(f.files, s.file_id) OR len(f.files) < {BUDGET.max_files}) AS ok
    FROM fold f JOIN steps s ON s.query_id = f.query_id AND s.rn = f.rn + 1 WHERE f.n < {BUDGET.max_symbols} AND f.total < {BUDGET.max_tokens})
), plan AS (
  SELECT s.query_id, f.n - 1 AS position, s.file_id, s.start_byte, s.end_byte, CAST(s.tokens AS BIGINT) AS token_count, line AS content
  FROM fold f JOIN steps s ON s.query_id = f.query_id AND s.rn = f.rn JOIN lines l ON l.file_id = s.file_id AND l.start_byte = s.start_byte WHERE f.taken
)"""

ORACLES: dict[str, str] = {
    "context_plan": _PLAN + "SELECT * FROM plan",
    "context_totals": _PLAN + "SELECT query_id, CAST(sum(token_count) AS BIGINT) AS total_tokens, count(DISTINCT file_id) AS total_files, count(*) AS total_symbols FROM plan GROUP BY query_id",
    "lines_offsets": _with(_LINES) + "SELECT file_id, line_number, line, start_byte, end_byte FROM lines",
    "file_metadata": _with(_FILES) + r"""SELECT file_id, path, 'unknown' AS extension_language, CAST(strlen(text) AS BIGINT) AS size_bytes,
  CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INTEGER) AS line_count, contains(substring(text, 1, 8192), chr(0)) AS is_binary FROM files""",
    "token_estimate": "SELECT doc_id AS file_id, CAST((strlen(text) + 3) // 4 AS BIGINT) AS tokens FROM documents",
    "search_exact": _with(_LINES, _asked(EXACT), _found("contains(line, query)")) + _ALL_FOUND,
    "search_case_insensitive": _with(_LINES, _asked(CASELESS), _found("contains(lower(line), lower(query))")) + _ALL_FOUND,
    "search_identifier": _with(_LINES, _asked({1: "the", 2: "de"}), _found(r"list_contains(regexp_split_to_array(line, '\s+'), query)")) + _ALL_FOUND,
    "search_word": _with(_LINES, _asked({1: "The", 2: "die"}), _found(r"regexp_matches(line, '(^|[^\pL\pN\pM_])' || query || '($|[^\pL\pN\pM_])')")) + _ALL_FOUND,
    "search_regex": _with(_LINES, _asked({1: "^[A-Z][a-z]+ [a-z]+ of", 2: "[0-9]{3,}"}), _found("regexp_matches(line, query)")) + _ALL_FOUND,
    "search_in_files": _with(_LINES, _asked(EXACT), _found("contains(line, query)", where="file_id IN (SELECT doc_id FROM documents WHERE lang = 'de')")) + _ALL_FOUND,
    "match_summary": _with(_LINES, _asked(EXACT), _found("contains(line, query)")) + "SELECT query_id, count(*) AS matches, count(DISTINCT file_id) AS files FROM found GROUP BY query_id",
    "source_slice": _with(_LINES) + "SELECT file_id, start_byte, end_byte, line AS source FROM lines",
    "merge_ranges": _with(_LINES, _asked({1: "the", 2: "ing"}), _found("contains(line, query)"))
    + """, spans AS (SELECT file_id, start_byte, end_byte + 1 AS end_byte, line_number AS l FROM found
), marked AS (SELECT *, CASE WHEN max(end_byte) OVER (PARTITION BY file_id ORDER BY start_byte, end_byte, l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= start_byte THEN 0 ELSE 1 END AS fresh FROM spans
), islands AS (SELECT *, sum(fresh) OVER (PARTITION BY file_id ORDER BY start_byte, end_byte, l ROWS UNBOUNDED PRECEDING) AS island FROM marked)
SELECT file_id, min(start_byte) AS start_byte, max(end_byte) AS end_byte, min(l) AS start_line, max(l) AS end_line FROM islands GROUP BY file_id, island""",
    "analyze_query": rf"""SELECT item_id, CASE WHEN regexp_matches(lower(text), '{"|".join(QUESTION_WORDS)}')
  OR (strlen(text) > 20 AND NOT regexp_matches(text, '^[\pL\pN\pM_:]*$')) THEN 'hybrid' ELSE 'lexical' END AS mode FROM benchmark""",
    "term_counts": _with(_LINES, _TERMS) + "SELECT file_id, line_number, term, tf FROM terms",
    "idf": _with(_LINES, _TERMS) + "SELECT term, df, round(idf, 6) AS idf FROM idf",
    "norms": _with(_LINES, _TERMS) + "SELECT file_id, line_number, round(norm, 6) AS norm FROM norms",
    "vocabulary": _with(_LINES, _TERMS) + "SELECT DISTINCT term FROM terms",
    "semantic_topk": _with(_LINES, _asked(CONTEXT), _TERMS, _NEAR) + "SELECT query_id, file_id, line_number, round(score, 6) AS score FROM near",
    "hybrid_fusion": _with(_LINES, _asked(CONTEXT), _TERMS, _NEAR, _found("contains(lower(line), lower(query))"))
    + """, fused AS (
  SELECT query_id, file_id, start_byte, sum(l) AS l, sum(s) AS s FROM (
    SELECT query_id, file_id, start_byte, 0.5 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY file_id, line_number) - 1) AS l, 0.0 AS s FROM found
    UNION ALL SELECT query_id, file_id, start_byte, 0.0, 0.5 * score FROM near) GROUP BY query_id, file_id, start_byte
), cut AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(l + s, 9) DESC, file_id, start_byte) AS k FROM fused)
SELECT query_id, file_id, start_byte, round(l, 6) AS lexical_score, round(s, 6) AS semantic_score FROM cut WHERE k <= 100""",
    "symbols": _with(_LINES, _symbols(4)) + "SELECT symbol_id, name, file_id, start_byte, end_byte, line_number AS start_line FROM named",
    "find_symbol": _with(_LINES, _symbols(4)) + f"SELECT symbol_id, name, file_id, start_byte, end_byte, line_number AS start_line FROM named WHERE name IN ({', '.join(repr(x) for x in [*CONTEXT.values(), *NAMES])})",
    "symbols_in_file": _with(_LINES, _symbols(4)) + "SELECT file_id, count(*) AS symbols, min(name) AS least, count(DISTINCT name) AS names FROM named GROUP BY file_id",
    "call_edges": _with(_LINES, _symbols(4)) + "SELECT * FROM edges",
    "local_edges": _with(_LINES, _symbols(4)) + "SELECT caller AS from_id, h.id AS to_id, 'Calls' AS relationship FROM calls c JOIN (SELECT name, file_id, max(symbol_id) AS id FROM named GROUP BY name, file_id) h ON h.name = c.callee AND h.file_id = c.file_id",
    "changed_since": _with(_FILES) + "SELECT path, md5(coalesce(text, '')) AS content_hash FROM files WHERE NOT language <> 'fr'",
    "fragment_lines": _with(_LINES, _TERMS) + "SELECT file_id, count(*) AS fragments FROM docs GROUP BY file_id",
    "find_references": _with(_LINES, _symbols(4)) + "SELECT name, from_id, relationship FROM edges JOIN named ON symbol_id = to_id",
    "direct_callers": _with(_LINES, _symbols(8)) + "SELECT to_id AS root, from_id AS node FROM edges",
    "callers_upto_3": _walk("to_id", "from_id"),
    "callees_upto_3": _walk("from_id", "to_id"),
    "all_direct_callers": _with(_LINES, _symbols(4)) + "SELECT to_id AS root, from_id AS node FROM edges",
    "all_callers_upto_3": _walk("to_id", "from_id", 4),
    "all_callees_upto_3": _walk("from_id", "to_id", 4),
    "rank_candidates": _CANDIDATES + "SELECT query_id, source, file_id, start_byte, CAST(symbol_match AS DOUBLE) AS symbol_match, CAST(definition AS DOUBLE) AS definition, round(semantic, 6) AS semantic, round(total, 6) AS total FROM ranked",
    "compact_output": _with(_LINES, _asked(EXACT), _found("contains(line, query)"), _FILES)
    + "SELECT query_id, path || ':' || string_agg(line_number || '-' || line_number, ',' ORDER BY line_number) AS output FROM found JOIN files USING (file_id) GROUP BY query_id, file_id, path",
    "combine_scores": """SELECT doc_id, round(greatest(0.1, 0.5 * coalesce(avg(quality), 0) + CASE WHEN sum(toxic) > 0 THEN 0.5 ELSE 0 END), 6) AS score FROM labels GROUP BY doc_id""",
    "cache_diff": _with(_FILES)
    + """, old AS (SELECT path, md5(coalesce(text, '')) AS h FROM files
), new AS (
  SELECT path, md5(text || CASE WHEN file_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN '!' ELSE '' END) AS h FROM files WHERE language <> 'es'
  UNION ALL SELECT 'benchmark/' || item_id, md5(text) FROM benchmark)
SELECT coalesce(old.path, new.path) AS path, CASE WHEN old.path IS NULL THEN 'created' WHEN new.path IS NULL THEN 'deleted' ELSE 'modified' END AS op
FROM old FULL OUTER JOIN new ON old.path = new.path WHERE old.h IS DISTINCT FROM new.h""",
    "apply_changes": """WITH changes AS (
  SELECT user_id AS path, CASE event_type WHEN 'purchase' THEN 'deleted' WHEN 'signup' THEN 'created' ELSE 'modified' END AS op, event_id AS seq FROM events
), last AS (SELECT path, max(seq) AS seq, arg_max(op, seq) AS op FROM changes GROUP BY path)
SELECT c_custkey AS path, CAST(-1 AS BIGINT) AS seq FROM customer WHERE c_custkey NOT IN (SELECT path FROM last)
UNION ALL SELECT path, seq FROM last WHERE op <> 'deleted'""",
    "web_lines": (_with(_LINES, _asked({1: "<ARTICLE>", 2: "<nav"}), _found("CASE WHEN query_id = 1 THEN contains(lower(line), lower(query)) ELSE contains(line, query) END")) + "SELECT query_id, file_id, line_number, start_byte, end_byte FROM found")
    .replace("doc_id AS file_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL AND text <> ''", "page_id AS file_id, string_split(html, chr(10)) AS p FROM pages WHERE html IS NOT NULL AND html <> ''"),
}
