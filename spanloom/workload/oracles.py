"""DuckDB SQL with the expected rows of each registered query.

For the code corpus the rows come from the tables the files were derived from, not from the
file text, so an oracle does not repeat the method it checks.
"""

from __future__ import annotations

from ..functions.answers import FENCE
from ..operators.windows import (
    ANSWER_FORM,
    BODY_ASK,
    RETRY_HINT,
    prompt_head,
    window_ask,
)
from ..schema import CLASS, FUNCTION, RECORD_CALL, RETRY_WITH, found_action
from . import answer_log as al

assert FENCE == "```"


def _text(value: str) -> str:
    return "(" + " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in value.split("\n")) + ")"


# ---- the code corpus, from orders and customer ----

CODE = """
o AS (SELECT o_orderkey AS k, o_custkey AS c, regexp_replace(o_orderpriority, '[^A-Za-z0-9]', '_', 'g') AS p,
  CAST(floor(o_totalprice / 50000) AS INTEGER) + 1 AS m, 'src/orders/o' || o_orderkey || '.py' AS path FROM orders),
s AS (SELECT k, c, p, m, path, unnest(generate_series(1, m)) AS j FROM o),
lib AS (SELECT c_custkey AS k, c_nationkey AS n, 'src/lib/cust_' || (c_custkey // 64) || '.py' AS path,
  2 * row_number() OVER (PARTITION BY c_custkey // 64 ORDER BY c_custkey) - 1 AS line FROM customer),
alt AS (SELECT c_custkey AS k, 'src/lib/alt_' || (c_custkey // 640) || '.py' AS path,
  2 * row_number() OVER (PARTITION BY c_custkey // 640 ORDER BY c_custkey) - 1 AS line
  FROM customer WHERE c_custkey % 10 = 0),
pr AS (SELECT DISTINCT p, 'src/lib/prio_' || p || '.py' AS path FROM o),
fn AS (
  SELECT path, 'step_' || j AS name, 4 * j - 2 AS a, 4 * j AS b FROM s
  UNION ALL SELECT path, 'run_' || k, 4 * m + 2, 4 * m + 4 FROM o
  UNION ALL SELECT path, 'cust_' || k, line, line + 1 FROM lib
  UNION ALL SELECT path, 'cust_' || k, line, line + 1 FROM alt
  UNION ALL SELECT path, 'prio_' || p, 1, 2 FROM pr),
cls AS (SELECT path, 'Order_' || k AS name, 1 AS a, 4 * m AS b FROM o),
site AS (
  SELECT path || ':' || (4 * j - 2) || ':step_' || j AS caller_id, 'cust_' || c AS callee, path, 4 * j - 1 AS line FROM s
  UNION ALL SELECT path || ':' || (4 * j - 2) || ':step_' || j, 'prio_' || p, path, 4 * j FROM s
  UNION ALL SELECT path || ':' || (4 * m + 2) || ':run_' || k, 'Order_' || k, path, 4 * m + 3 FROM o
  UNION ALL SELECT path || ':' || (4 * m + 2) || ':run_' || k, 'step_1', path, 4 * m + 4 FROM o
  UNION ALL SELECT path || ':' || line || ':cust_' || k, 'nation_' || n, path, line + 1 FROM lib),
first AS (SELECT name, path, a, path || ':' || a || ':' || name AS id FROM
  (SELECT *, row_number() OVER (PARTITION BY name ORDER BY path, a) AS rn FROM fn) WHERE rn = 1),
edge AS (SELECT site.caller_id, first.id AS callee_id, site.path, site.line, site.callee
  FROM site JOIN first ON site.callee = first.name),
wins AS (SELECT path, n_lines, w AS window_id, greatest(1, 31 * w) AS a, least(n_lines, 31 * w + 30) AS b FROM
  (SELECT path, n_lines, unnest(generate_series(0, n_lines // 31)) AS w FROM (
    SELECT path, 4 * m + 4 AS n_lines FROM o
    UNION ALL SELECT path, max(line) + 1 FROM lib GROUP BY path
    UNION ALL SELECT path, max(line) + 1 FROM alt GROUP BY path
    UNION ALL SELECT path, 2 FROM pr)))
"""

# ---- documents as plain text ----

DOCS = r"""
d AS (SELECT doc_id, 'docs/' || doc_id || '.txt' AS path,
  regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS arr FROM documents),
dl AS (SELECT doc_id, path, CASE WHEN arr[len(arr)] = '' THEN arr[1:len(arr) - 1] ELSE arr END AS arr FROM d),
dn AS (SELECT doc_id, path, len(arr) AS n FROM dl),
l AS (SELECT path, unnest(range(1, len(arr) + 1)) AS line_no, unnest(arr) AS text FROM dl)
"""

# The read loop of the windows: the first has 30 lines, each next one starts after it with 31.
LOOP = """
w(doc_id, path, n, a, b) AS (
  SELECT doc_id, path, n, 1::BIGINT, least(30, n) FROM dn WHERE n > 0
  UNION ALL SELECT doc_id, path, n, b + 1, least(b + 31, n) FROM w WHERE b < n)
"""

REQUESTS = """
rq AS (SELECT doc_id, doc_id::VARCHAR AS request_id, 'docs/' || doc_id || '.txt' AS path,
  CASE WHEN doc_id % 11 = 0 THEN 0 ELSE doc_id % 7 + 1 END AS a,
  CASE WHEN doc_id % 11 = 0 THEN 0 ELSE doc_id % 7 + 1 END + doc_id % 40 AS b FROM documents),
re AS (SELECT rq.*, CASE WHEN a < 1 THEN 'start_before_first_line' WHEN b > n AND b >= a THEN 'end_after_last_line' END AS error
  FROM rq JOIN dn USING (path)),
sl AS (SELECT request_id, l.path, line_no - a AS pos, line_no, text FROM re JOIN l ON l.path = re.path
  AND line_no BETWEEN a AND b WHERE error IS NULL),
om AS (SELECT DISTINCT request_id, line_no FROM (
  SELECT doc_id::VARCHAR AS request_id, doc_id, unnest(generate_series(doc_id % 7 + 2, doc_id % 7 + 4)) AS line_no FROM documents
  UNION ALL SELECT doc_id::VARCHAR, doc_id, doc_id % 7 + 5 + doc_id % 2 FROM documents
  UNION ALL SELECT doc_id::VARCHAR, doc_id, unnest(generate_series(40, 60)) FROM documents WHERE doc_id % 13 = 1)
  WHERE doc_id % 3 <> 0),
runs AS (SELECT request_id, min(line_no) AS run_start, max(line_no) AS run_end FROM
  (SELECT *, line_no - row_number() OVER (PARTITION BY request_id ORDER BY line_no) AS g FROM om) GROUP BY request_id, g),
col AS (
  SELECT request_id, path, pos, line_no, text FROM sl
  WHERE NOT EXISTS (SELECT 1 FROM om WHERE om.request_id = sl.request_id AND om.line_no = sl.line_no)
  UNION ALL SELECT runs.request_id, re.path, run_end - a, -1,
    '[omitted lines: ' || CASE WHEN run_start = run_end THEN run_start::VARCHAR ELSE run_start || '-' || run_end END || ']'
  FROM runs JOIN re USING (request_id) WHERE error IS NULL AND run_end BETWEEN a AND b)
"""


def _prompt(target) -> str:
    head = prompt_head([found_action(target), RETRY_WITH]) + window_ask(target)
    return " || ".join(
        [
            _text(head), "'Path: '", "x.path", _text("\nLines in scope: "), "x.n", "chr(10)",
            _text(RETRY_HINT), _text("Part of the document:\n"), "x.excerpt", _text("\n\n" + ANSWER_FORM),
        ]
    )


PROMPTS = f"""
x AS (SELECT w.path, w.n, w.a, w.b, string_agg(l.line_no || ': ' || l.text, chr(10) ORDER BY l.line_no) AS excerpt
  FROM w JOIN l ON l.path = w.path AND l.line_no BETWEEN w.a AND w.b GROUP BY ALL),
pm AS (SELECT path || ':class:' || a || ':' || b || ':' AS request_id, path, 'class' AS target_id, {_prompt(CLASS)} AS prompt FROM x
  UNION ALL SELECT path || ':function:' || a || ':' || b || ':', path, 'function', {_prompt(FUNCTION)} FROM x)
"""

ANSWERS = f"{al.BASE_SQL}, {al.sql_actions()}"
_REASON = (
    "CASE shape "
    + " ".join(f"WHEN {shape} THEN '{reason}'" for shape, reason in al.REASONS.items())
    + " END"
)

# ---- golden graphs ----

GOLDEN = """
gn AS (SELECT path AS project, 'step_' || j AS name FROM s UNION ALL SELECT path, 'run_' || k FROM o
  UNION ALL SELECT path, 'ghost_' || k FROM o WHERE k % 5 = 1),
ge AS (SELECT path AS project, path || ':' || (4 * j - 2) || ':step_' || j AS caller_id,
    'src/lib/prio_' || p || '.py:1:prio_' || p AS callee_id FROM s
  UNION ALL SELECT path, path || ':' || (4 * m + 2) || ':run_' || k, 'nowhere' FROM o
  UNION ALL SELECT path, path || ':99:ghost', NULL FROM o WHERE k % 5 = 2),
e1 AS (SELECT path AS project, 'node_count' AS kind, 'expected ' || (m + 2) || ' nodes, found ' || (m + 1) AS detail
  FROM o WHERE k % 5 = 1),
e2 AS (SELECT path AS project, 'missing_function' AS kind, 'ghost_' || k AS detail FROM o WHERE k % 5 = 1),
e3 AS (SELECT path AS project, 'missing_caller' AS kind, path || ':99:ghost' AS detail FROM o WHERE k % 5 = 2),
ae AS (SELECT DISTINCT path AS project, caller_id, callee_id FROM edge WHERE path LIKE 'src/orders/%'),
gd AS (SELECT DISTINCT project, caller_id, callee_id FROM ge WHERE callee_id IS NOT NULL),
e4 AS (SELECT g.project, 'missing_edge' AS kind, g.caller_id || ' -> ' || g.callee_id AS detail FROM gd g
    WHERE EXISTS (SELECT 1 FROM ae WHERE ae.project = g.project AND ae.caller_id = g.caller_id)
    AND NOT EXISTS (SELECT 1 FROM ae WHERE ae.project = g.project AND ae.caller_id = g.caller_id AND ae.callee_id = g.callee_id)
  UNION ALL SELECT a.project, 'extra_edge', a.caller_id || ' -> ' || a.callee_id FROM ae a
    WHERE EXISTS (SELECT 1 FROM gd WHERE gd.project = a.project AND gd.caller_id = a.caller_id)
    AND NOT EXISTS (SELECT 1 FROM gd WHERE gd.project = a.project AND gd.caller_id = a.caller_id AND gd.callee_id = a.callee_id))
"""


def _q(parts: list[str], select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(p.strip() for p in parts)} {select}"


def _code(select: str) -> str:
    return _q([CODE], select)


def _docs(select: str) -> str:
    return _q([DOCS], select)


def _req(select: str) -> str:
    return _q([DOCS, REQUESTS], select)


def _win(select: str) -> str:
    return _q([DOCS, LOOP], select, recursive=True)


def _pmt(select: str) -> str:
    return _q([DOCS, LOOP, PROMPTS], select, recursive=True)


def _ans(select: str) -> str:
    return _q([ANSWERS], select)


def _gold(select: str) -> str:
    return _q([CODE, GOLDEN], select)


_NODE = "path || ':' || a || ':' || name"
_BODY_PROMPT = " || ".join(
    [
        _text(prompt_head([RECORD_CALL]) + BODY_ASK + "Source:\n"),
        "t.excerpt",
        _text("\n\n" + ANSWER_FORM),
    ]
)
_DOT = "translate({0}, ':/.-', '____')"
_ALL_ERRORS = "(SELECT * FROM e1 UNION ALL SELECT * FROM e2 UNION ALL SELECT * FROM e3 UNION ALL SELECT * FROM e4)"

ORACLES: dict[str, str] = {
    "most_called_functions": _code("SELECT callee_id, count(*) AS n_calls FROM edge GROUP BY 1"),
    "order_files": _q(
        [CODE],
        """SELECT path, 'class Order_' || k || ':' || chr(10) || string_agg('    def step_' || j || '(self):' || chr(10)
          || '        cust_' || c || '()' || chr(10) || '        prio_' || p || '()' || chr(10), chr(10) ORDER BY j)
          || chr(10) || 'def run_' || k || '():' || chr(10) || '    Order_' || k || '()' || chr(10)
          || '    step_1()' || chr(10) AS content FROM s GROUP BY path, k""",
    ),
    "split_lines": _docs("SELECT path, line_no::INTEGER AS line_no, text FROM l"),
    "line_counts": _docs("SELECT path, n::INTEGER AS n_lines FROM dn"),
    "plan_windows": _win(
        """SELECT path, (row_number() OVER (PARTITION BY path ORDER BY a) - 1)::INTEGER AS window_id,
        a::INTEGER AS start_line, b::INTEGER AS end_line FROM w"""
    ),
    "find_functions": _code("SELECT path, name, a::INTEGER AS start_line FROM fn"),
    "find_classes": _code("SELECT path, name, a::INTEGER AS start_line FROM cls"),
    "span_ends": _code(
        """SELECT path, 'function' AS target_id, name, a::INTEGER AS start_line, b::INTEGER AS end_line FROM fn
        UNION ALL SELECT path, 'class', name, a::INTEGER, b::INTEGER FROM cls"""
    ),
    "build_nodes": _code(
        f"SELECT {_NODE} AS node_id, name, path AS file, a::INTEGER AS line_start, b::INTEGER AS line_end FROM fn"
    ),
    "find_calls": _code("SELECT caller_id, callee AS callee_name, path AS file, line::INTEGER AS line_no FROM site"),
    "resolve_callees": _code("SELECT caller_id, callee AS callee_name, callee_id, line::INTEGER AS line_no FROM edge"),
    "unresolved_calls": _code(
        """SELECT callee AS callee_name, count(*) AS n_calls FROM site
        WHERE callee NOT IN (SELECT name FROM fn) GROUP BY 1"""
    ),
    "name_candidates": _code(
        f"""SELECT caller_id, callee AS callee_name, line::INTEGER AS line_no, coalesce(n, 0) AS n_candidates,
        CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END AS status,
        CASE WHEN n = 1 THEN id END AS candidate_id
        FROM site LEFT JOIN (SELECT name, count(*) AS n, min({_NODE}) AS id FROM fn GROUP BY 1) ON name = callee"""
    ),
    "build_edges": _code(
        """SELECT caller_id, callee_id, path AS file, line::INTEGER AS line_start, line::INTEGER AS line_end FROM edge"""
    ),
    "edges_with_endpoints": _code(
        f"""SELECT f.name AS caller_name, edge.callee AS callee_name, edge.path AS file, line::INTEGER AS line_start
        FROM edge JOIN (SELECT *, {_NODE} AS id FROM fn) f ON f.id = caller_id"""
    ),
    "graph_summary": _code(
        "SELECT (SELECT count(*) FROM fn) AS n_nodes, (SELECT count(*) FROM edge) AS n_edges"
    ),
    "dot_ids": _code(
        f"SELECT {_NODE} AS node_id, {_DOT.format(_NODE)} AS dot_id, 1::BIGINT AS n_sharing FROM fn"
    ),
    "dot_id_collisions": _code(f"SELECT count(*) AS n_collisions FROM fn WHERE {_NODE} LIKE '%1'"),
    "adjacency": _code(
        """SELECT caller_id, part, string_agg(callee_id, ' ' ORDER BY line, callee_id) AS callees FROM (
            SELECT caller_id, line, callee_id,
            ((row_number() OVER (PARTITION BY caller_id ORDER BY line, callee_id) - 1) // 4096)::INTEGER AS part FROM edge
        ) GROUP BY 1, 2"""
    ),
    "nest_methods": _code(
        """SELECT path, 'step_' || j AS name, (4 * j - 2)::INTEGER AS start_line, (4 * j)::INTEGER AS end_line,
        path || ':1:Order_' || k AS parent_id FROM s"""
    ),
    "nested_view": _code(
        """SELECT path, path || ':1:Order_' || k AS parent_id, 0::INTEGER AS part,
        string_agg('step_' || j, ' ' ORDER BY j) AS children FROM s GROUP BY path, k"""
    ),
    "exclude_claimed": _code(
        """SELECT path, name, a::INTEGER AS start_line, b::INTEGER AS end_line FROM fn WHERE name NOT LIKE 'step\\_%' ESCAPE '\\'"""
    ),
    "windows_within": _code(
        """SELECT path, name, w::INTEGER AS window_id, greatest(a, 31 * w)::INTEGER AS start_line,
        least(b, 31 * w + 30)::INTEGER AS end_line
        FROM (SELECT *, unnest(generate_series(a // 31, b // 31)) AS w FROM cls)"""
    ),
    "subtract_claimed": _code(
        """, ln AS (SELECT wins.path, window_id, unnest(generate_series(a, b)) AS x FROM wins),
        cl AS (SELECT DISTINCT path, unnest(generate_series(a, b)) AS x FROM fn WHERE name NOT LIKE 'run\\_%' ESCAPE '\\'),
        fr AS (SELECT path, window_id, x, x - row_number() OVER (PARTITION BY path, window_id ORDER BY x) AS g
          FROM ln ANTI JOIN cl USING (path, x))
        SELECT path, window_id::INTEGER AS window_id, min(x)::INTEGER AS start_line, max(x)::INTEGER AS end_line
        FROM fr GROUP BY path, window_id, g"""
    ),
    "check_requests": _req(
        "SELECT request_id, path, a::INTEGER AS start, b::INTEGER AS \"end\", error FROM re WHERE error IS NOT NULL"
    ),
    "slice_lines": _req(
        "SELECT request_id, path, pos::INTEGER AS pos, line_no::INTEGER AS line_no, text FROM sl"
    ),
    "expand_omissions": _req("SELECT request_id, line_no::INTEGER AS line_no FROM om"),
    "bad_omissions": _req(
        """SELECT doc_id::VARCHAR AS request_id, 'bad_omission' AS reason, 'x' AS raw FROM documents
        WHERE doc_id % 3 <> 0 AND doc_id % 13 = 0"""
    ),
    "omission_runs": _req(
        "SELECT request_id, run_start::INTEGER AS run_start, run_end::INTEGER AS run_end FROM runs"
    ),
    "collapse_omissions": _req(
        "SELECT request_id, path, pos::INTEGER AS pos, line_no::INTEGER AS line_no, text FROM col"
    ),
    "render_excerpts": _req(
        """SELECT request_id, path, 0::INTEGER AS part, string_agg(CASE WHEN line_no = -1 THEN text
        ELSE line_no || ': ' || text END, chr(10) ORDER BY pos) AS excerpt FROM col GROUP BY 1, 2"""
    ),
    "window_requests": _win(
        """SELECT path || ':' || t || ':' || a || ':' || b || ':' AS request_id, path, t AS target_id,
        a::INTEGER AS start, b::INTEGER AS "end" FROM w, (VALUES ('class'), ('function')) v(t)"""
    ),
    "build_prompts": _pmt(
        "SELECT request_id, path, target_id, sha256(prompt) AS prompt_key, length(prompt)::INTEGER AS n_chars FROM pm"
    ),
    "build_body_prompts": _code(
        f""", ord AS (SELECT path, 1 AS x, 'class Order_' || k || ':' AS text FROM o
          UNION ALL SELECT path, 4 * j - 2, '    def step_' || j || '(self):' FROM s
          UNION ALL SELECT path, 4 * j - 1, '        cust_' || c || '()' FROM s
          UNION ALL SELECT path, 4 * j, '        prio_' || p || '()' FROM s
          UNION ALL SELECT path, 4 * m + 2, 'def run_' || k || '():' FROM o
          UNION ALL SELECT path, 4 * m + 3, '    Order_' || k || '()' FROM o
          UNION ALL SELECT path, 4 * m + 4, '    step_1()' FROM o
          UNION ALL SELECT path, line, 'def cust_' || k || '():' FROM lib
          UNION ALL SELECT path, line + 1, '    nation_' || n || '()' FROM lib
          UNION ALL SELECT path, line, 'def cust_' || k || '():' FROM alt
          UNION ALL SELECT path, line + 1, '    pass' FROM alt
          UNION ALL SELECT path, 1, 'def prio_' || p || '():' FROM pr
          UNION ALL SELECT path, 2, '    pass' FROM pr),
        t AS (SELECT fn.path || ':' || a || ':' || name AS request_id, string_agg(x || ': ' || text, chr(10) ORDER BY x) AS excerpt
          FROM fn JOIN ord ON ord.path = fn.path AND x BETWEEN a AND b GROUP BY 1)
        SELECT request_id, 0::INTEGER AS part, sha256({_BODY_PROMPT}) AS prompt_key FROM t"""
    ),
    "attach_responses": _pmt(
        """SELECT request_id, CASE length(prompt) % 3 WHEN 1 THEN 'first ' ELSE 'second ' END || length(prompt) AS raw
        FROM pm WHERE length(prompt) % 3 > 0"""
    ),
    "open_prompts": _pmt("SELECT request_id FROM pm WHERE length(prompt) % 3 = 0"),
    "extract_with": _pmt("SELECT DISTINCT sha256(prompt) AS prompt_key, length(prompt)::VARCHAR AS raw FROM pm"),
    "clean_answers": _ans(f"SELECT k AS request_id, {al.sql_case(1)} AS clean FROM ev"),
    "parse_answers": _ans("SELECT request_id, ordinal::INTEGER AS ordinal, name, key, first, second FROM act"),
    "bad_answers": _ans(
        f"SELECT k AS request_id, 'bad_json' AS reason, {al.sql_case(0)} AS raw FROM ev WHERE event_id % {al.N} = 8"
    ),
    "route_actions": _ans(
        """SELECT request_id, ordinal::INTEGER AS ordinal, name,
        CASE WHEN name = 'open_door' THEN 'unknown_action' END AS reason FROM act"""
    ),
    "check_required": _ans(
        f"SELECT request_id, ordinal::INTEGER AS ordinal, name, {_REASON} AS reason FROM act"
    ),
    "quarantine": _ans(f"SELECT request_id, {_REASON} AS reason FROM act WHERE shape IN (5, 6, 7)"),
    "answers_to_found": _ans(
        """SELECT path, 'function' AS target_id, key AS name, first::INTEGER AS start_line, second::INTEGER AS end_line,
        CASE WHEN shape = 3 THEN 'http://x/' || request_id || '.py' ELSE path END AS file FROM act WHERE shape < 5"""
    ),
    "map_fields": _ans(
        """SELECT key AS name, CASE WHEN shape = 3 THEN 'http://x/' || request_id || '.py' ELSE path END AS file,
        first::INTEGER AS line_start, second::INTEGER AS line_end FROM act WHERE shape < 5"""
    ),
    "answers_to_calls": _ans(
        """SELECT path || ':1:caller' AS caller_id, key AS callee_name, path AS file, first::INTEGER AS line_no
        FROM act WHERE shape = 11"""
    ),
    "next_round": _q(
        [DOCS, ANSWERS],
        """SELECT DISTINCT path || ':function:' || a || ':' || b || ':' || spec AS request_id, path, 'function' AS target_id,
        a::INTEGER AS start, b::INTEGER AS "end", spec
        FROM (SELECT *, CASE WHEN a > 3 OR b < 2 THEN '' ELSE '2-3' END AS spec FROM (SELECT act.path, first::INTEGER AS a, least(second::INTEGER, n) AS b FROM act JOIN dn ON dn.path = act.path
          WHERE shape = 10 AND ordinal = 1)) WHERE a <= b""",
    ),
    "request_chain": _docs(
        """, r AS (SELECT path, n, k, 10 * k + 1 AS a, least(10 * k + 10, n) AS b FROM dn, range(6) t(k) WHERE n > 10 * k),
        s AS (SELECT *, CASE WHEN k = 0 OR a + 1 > b THEN '' ELSE (a + 1)::VARCHAR END AS spec FROM r)
        SELECT path || ':function:' || a || ':' || b || ':' || spec AS request_id, path, 'function' AS target_id,
        a::INTEGER AS start, b::INTEGER AS "end", spec FROM s"""
    ),
    "usage_rollup": """SELECT event_type AS stage, sum(user_id)::BIGINT AS in_tokens, sum(length(props))::BIGINT AS out_tokens,
        sum(value::DECIMAL(18, 2))::DOUBLE AS time_secs, count(*) AS n_calls FROM events GROUP BY 1""",
    "estimated_tokens": _ans(
        f"""SELECT k AS request_id, len(regexp_extract_all(raw, '\\w+|[^\\w\\s]'))::BIGINT AS out_tokens
        FROM (SELECT k, {al.sql_case(0)} AS raw FROM ev)"""
    ),
    "golden_nodes": _gold("SELECT * FROM gn"),
    "golden_edges": _gold("SELECT * FROM ge"),
    "golden_findings": """SELECT 'src/orders/o' || o_orderkey || '.py' AS project, 'golden' AS kind,
        CASE o_orderkey % 7 WHEN 0 THEN 'metadata.json not found' ELSE 'metadata.json not readable' END AS detail
        FROM orders WHERE o_orderkey % 7 IN (0, 3)""",
    "node_count_diff": _gold("SELECT * FROM e1"),
    "missing_functions": _gold("SELECT * FROM e2"),
    "missing_callers": _gold("SELECT * FROM e3"),
    "edge_diff": _gold("SELECT * FROM e4"),
    "verdict": _gold(
        f"""SELECT o.path AS project, count(e.project) = 0 AS success, count(e.project) AS n_errors
        FROM o LEFT JOIN {_ALL_ERRORS} e ON e.project = o.path GROUP BY 1"""
    ),
    "early_verdict": _gold(
        f""", ep AS (SELECT path AS project FROM o UNION SELECT 'proj/' || (c_custkey // 3) FROM customer),
        ee AS (SELECT project FROM {_ALL_ERRORS} UNION ALL SELECT path FROM o WHERE k % 7 IN (0, 3)
          UNION ALL SELECT 'proj/' || (c_custkey // 3) FROM customer GROUP BY 1 HAVING count(*) FILTER (WHERE c_nationkey % 5 < 2) = 0)
        SELECT ep.project, count(ee.project) = 0 AS success, count(ee.project) AS n_errors FROM ep LEFT JOIN ee USING (project) GROUP BY 1"""
    ),
    "pick_source_file": """SELECT 'proj/' || (c_custkey // 3) AS project, min(CASE c_nationkey % 5
        WHEN 0 THEN 'proj/' || (c_custkey // 3) || '/main.py' WHEN 1 THEN 'proj/' || (c_custkey // 3) || '/main.rs' END) AS path
        FROM customer GROUP BY 1""",
    "missing_sources": """SELECT 'proj/' || (c_custkey // 3) AS project, 'no_source_file' AS kind,
        'proj/' || (c_custkey // 3) AS detail FROM customer GROUP BY 1
        HAVING count(*) FILTER (WHERE c_nationkey % 5 < 2) = 0""",
    "overlay_files": """SELECT 'docs/' || doc_id || '.txt' AS path,
        CASE WHEN doc_id % 4 = 0 THEN 'edit 2 of ' || doc_id ELSE text END AS content FROM documents
        UNION ALL SELECT 'docs/new_' || doc_id || '.txt', 'a new file' FROM documents WHERE doc_id % 50 = 0""",
    "filter_paths": """SELECT 'docs/' || doc_id || '.txt' AS path FROM documents
        WHERE doc_id::VARCHAR LIKE '1%' OR doc_id::VARCHAR LIKE '25%'""",
    "filter_paths_by_table": """SELECT 'docs/' || doc_id || '.txt' AS path FROM documents
        WHERE EXISTS (SELECT 1 FROM nation WHERE starts_with(doc_id::VARCHAR, (n_nationkey * 7)::VARCHAR))""",
    "scan_files": _docs("SELECT sum(len(arr))::BIGINT AS n_lines FROM d"),
    "graph_json": _code(
        """SELECT '{"name":"' || name || '","loc":{"file":"' || path || '","line_start":' || a || ',"line_end":' || b || '}}' AS value FROM fn
        UNION ALL SELECT '{"caller_id":"' || caller_id || '","callee_id":"' || callee_id || '","attributes":{"loc":{"file":"'
          || path || '","line_start":' || line || ',"line_end":' || line || '}}}' FROM edge"""
    ),
    "graph_dot": _code(
        f"""SELECT 0::INTEGER AS section, unnest(['digraph CallGraph {{', '  rankdir=LR;', '  node [shape=box];', '']) AS value
        UNION ALL SELECT 1, '  ' || {_DOT.format(_NODE)} || ' [label="' || name || '\\n' || path || ':' || a || '"];' FROM fn
        UNION ALL SELECT 2, '' UNION ALL SELECT 3, '  ' || {_DOT.format('caller_id')} || ' -> ' || {_DOT.format('callee_id')} || ';' FROM edge
        UNION ALL SELECT 4, '}}'"""
    ),
    "graph_report": _code(
        f"""SELECT 0::INTEGER AS section, unnest(['Call Graph Summary:', '  Nodes (Functions): ' || (SELECT count(*) FROM fn),
          '  Edges (Calls): ' || (SELECT count(*) FROM edge), '', 'Functions:']) AS value
        UNION ALL SELECT 1, '  - ' || name || ' (' || path || ':' || a || '-' || b || ')' FROM fn
        UNION ALL SELECT 2, unnest(['', 'Function Calls:'])
        UNION ALL SELECT 3, '  - ' || f.name || ' -> ' || edge.callee || ' (at ' || edge.path || ':' || line || ')'
          FROM edge JOIN (SELECT *, {_NODE} AS id FROM fn) f ON f.id = caller_id"""
    ),
}


# ---- the brace languages, from customer: definitions (kind, name, first and last line), calls (owner, its line, callee, line) ----

_BRACE = {
    "c": (
        [("function", "'fast_' || k", "2", "6"), ("function", "'pick_' || k", "7", "9"), ("function", "'sum_' || k", "11", "16 + m"),
         ("function", "'sum_' || k", "13", "16 + m"), ("function", "'last_' || k", "17 + m", "17 + m")],
        [("'fast_' || k", "2", "'nation_' || n", "4"), ("'pick_' || k", "7", "'seg_' || s", "8"), ("'sum_' || k", "11", "'fast_' || k", "15"),
         ("'sum_' || k", "13", "'fast_' || k", "15"), ("'sum_' || k", "11", "STEP", "15 + j"), ("'sum_' || k", "13", "STEP", "15 + j"),
         ("'last_' || k", "17 + m", "'sum_' || k", "17 + m")],
    ),
    "cpp": (
        [("class", "'Box_' || k", "2", "9 + m"), ("function", "'Box_' || k", "4", "4"), ("function", "'marked_' || k", "5", "5"),
         ("function", "'operator+'", "6", "6"), ("function", "'operator()'", "7", "8 + m"), ("function", "'total_' || k", "10 + m", "14 + m")],
        [("'Box_' || k", "4", "'nation_' || n", "4"), ("'marked_' || k", "5", "'seg_' || s", "5"), ("'operator+'", "6", "'merge_' || k", "6"),
         ("'operator()'", "7", "STEP", "7 + j"), ("'total_' || k", "10 + m", "'deep_' || k", "12 + m")],
    ),
    "go": (
        [("class", "'Box_' || k", "3", "5"), ("class", "'Doer_' || k", "6", "6"), ("function", "'Map_' || k", "8", "14 + m"),
         ("function", "'Get_' || k", "15 + m", "15 + m")],
        [("'Map_' || k", "8", "'Gen_' || n", "11"), ("'Map_' || k", "8", "STEP", "12 + j"), ("'Get_' || k", "15 + m", "'seg_' || s", "15 + m")],
    ),
    "rs": (
        [("class", "'Box_' || k", "2", "2"), ("class", "'Box_' || k", "3", "12 + m"), ("function", "'fmt_' || k", "4", "11 + m"),
         ("function", "'top_' || k", "13 + m", "13 + m")],
        [("'fmt_' || k", "4", "'nation_' || n", "8"), ("'fmt_' || k", "4", "STEP", "9 + j"), ("'fmt_' || k", "4", "'seg_' || s", "10 + m"),
         ("'top_' || k", "13 + m", "'last_' || k", "13 + m")],
    ),
}


def _brace(suffix: str) -> str:
    found, calls = _BRACE[suffix]
    parts = [
        f"SELECT path, '{kind}' AS kind, {name} AS name, '' AS owner, ({a})::INTEGER AS start_line, ({b})::INTEGER AS end_line FROM b"
        for kind, name, a, b in found
    ]
    for owner, at, callee, line in calls:
        source = "(SELECT *, unnest(generate_series(1, m)) AS j FROM b)" if callee == "STEP" else "b"
        name = "'step_' || j" if callee == "STEP" else callee
        parts.append(f"SELECT path, 'call', {name}, path || ':' || ({at}) || ':' || {owner}, ({line})::INTEGER, ({line})::INTEGER FROM {source}")
    head = f"""b AS (SELECT c_custkey AS k, c_nationkey AS n, regexp_replace(c_mktsegment, '[^A-Za-z0-9]', '_', 'g') AS s,
    (c_custkey % 4 + 1)::INTEGER AS m, 'src/{suffix}/c' || c_custkey || '.{suffix}' AS path FROM customer)"""
    return _q([head], " UNION ALL ".join(parts))


ORACLES["cut_excerpts"] = ORACLES["render_excerpts"]
ORACLES |= {f"code_{suffix}": _brace(suffix) for suffix in _BRACE}
