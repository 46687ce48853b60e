"""DuckDB counterparts of the corpora and of the visits table, as common table expressions."""

_EVENTS = """rows_ AS (
  SELECT dense_rank() OVER (ORDER BY user_id) - 1 AS path_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p,
         2 * dense_rank() OVER (ORDER BY event_type) AS node FROM events
)"""
_ORDERS = """rows_ AS (
  SELECT dense_rank() OVER (ORDER BY l_orderkey) - 1 AS path_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS p,
         2 * (l_suppkey + 1) AS node FROM lineitem
)"""
_TALKS = """rows_ AS (
  SELECT dense_rank() OVER (ORDER BY conv_id) - 1 AS path_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p,
         2 * dense_rank() OVER (ORDER BY role) AS node FROM conversations
)"""
ROWS = {"events": _EVENTS, "orders": _ORDERS, "conversations": _TALKS}

SEQS = """both_ AS (
  SELECT 2 * path_id AS seq_id, p AS pos, node FROM rows_
  UNION ALL SELECT 2 * path_id + 1, count(*) OVER (PARTITION BY path_id) + 1 - p, xor(node, 1) FROM rows_
), seqs AS (SELECT seq_id, list(node ORDER BY pos) AS path FROM both_ GROUP BY seq_id)"""

#: From ``both_`` (seq_id, pos >= 1, node) and ``seqs`` (every seq_id) to ``visits``.
RANKED = """pref_ AS (
  SELECT seq_id, pos, node, list_append(coalesce(list_reverse(list(node) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), []), 0) AS prefix FROM both_
), rank_ AS (
  SELECT seq_id, pos, node, row_number() OVER (PARTITION BY node ORDER BY prefix, seq_id) - 1 AS off FROM pref_
  UNION ALL SELECT seq_id, 0, 0, seq_id FROM seqs
), visits AS (
  SELECT node, off, seq_id, pos, coalesce(lead(node) OVER w, 0) AS next, lead(off) OVER w AS next_off, lag(node) OVER w AS prev, lag(off) OVER w AS prev_off
  FROM rank_ WINDOW w AS (PARTITION BY seq_id ORDER BY pos)
)"""
EDGES = """counts_ AS (SELECT node AS src, next AS dst, count(*) AS cnt FROM visits GROUP BY ALL), edges AS (
  SELECT src, dst, cnt, CASE WHEN dst = 0 THEN 0 ELSE coalesce(sum(cnt) OVER (PARTITION BY dst ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END::BIGINT AS rank_off FROM counts_
)"""
RUNS = """marks_ AS (
  SELECT *, CASE WHEN next IS DISTINCT FROM lag(next) OVER (PARTITION BY node ORDER BY off) OR off = 0 THEN 1 ELSE 0 END AS c,
            CASE WHEN next IS DISTINCT FROM lag(next) OVER (PARTITION BY node ORDER BY off) OR off = 0 OR next = 0 THEN 1 ELSE 0 END AS l FROM visits
), ids_ AS (
  SELECT *, sum(c) OVER (PARTITION BY node ORDER BY off) - 1 AS cr, sum(l) OVER (PARTITION BY node ORDER BY off) - 1 AS lr FROM marks_
), runs AS (
  SELECT node, cr::BIGINT AS run_id, min(off) AS start_off, count(*) AS len, any_value(next) AS successor FROM ids_ GROUP BY node, cr
), logical AS (
  SELECT node, lr::BIGINT AS run_id, min(off) AS start_off, count(*) AS len, any_value(next) AS successor FROM ids_ GROUP BY node, lr
)"""
PATTERNS = """own_ AS (SELECT path_id, list(node ORDER BY p) AS path FROM rows_ GROUP BY path_id), cut_ AS (
  SELECT path_id, path[3:{stop}] AS pattern FROM own_ WHERE len(path) >= {least}
), patterns AS (
  SELECT 2 * path_id AS query_id, pattern FROM cut_
  UNION ALL SELECT 2 * path_id + 1, list_append(pattern[1:{short}], pattern[{length}] + 2) FROM cut_
)"""


def patterns_sql(length: int = 4) -> str:
    return PATTERNS.format(stop=length + 2, least=length + 2, short=length - 1, length=length)


#: The direct search: the last node's visits whose preceding nodes spell the pattern.
FOUND = """found AS (
  SELECT query_id, v.node, min(off) AS sp, max(off) AS ep, count(*) AS cnt
  FROM patterns q JOIN visits v ON v.node = q.pattern[-1] JOIN seqs s USING (seq_id)
  WHERE v.pos >= len(pattern) AND s.path[v.pos - len(pattern) + 1 : v.pos] = q.pattern GROUP BY query_id, v.node
)"""


def sql(tail: str, *parts: str, corpus: str = "events") -> str:
    """A query over ``visits`` and what ``parts`` add."""
    return "WITH " + ",\n".join([ROWS[corpus], SEQS, RANKED, *parts]) + "\n" + tail


#: A fixed collection of seven paths and their metadata, for operators that need more than a corpus.
def values(name: str, columns: str, rows: list[tuple]) -> str:
    """A CTE of literal rows."""
    lit = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int | float) else str(list(x)) if isinstance(x, list | tuple) else "'" + x.replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {body})"
