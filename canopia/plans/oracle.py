"""The domain tables in the oracle's SQL, each as a common table expression with what it builds on."""

from __future__ import annotations

_TEXT = {
    "points": """points AS (SELECT CAST(label AS BIGINT) AS tree_id, vec_id * 21 + k AS pid, CAST(embedding[3 * k + 1] AS DOUBLE) AS x,
  CAST(embedding[3 * k + 2] AS DOUBLE) AS y, CAST(embedding[3 * k + 3] AS DOUBLE) AS z
  FROM (SELECT label, vec_id, embedding, unnest(range(0, 21)) AS k FROM embeddings WHERE label IS NOT NULL))""",
    "branch": """branch_rank AS (SELECT o_custkey AS tree_id, CAST(o_orderkey AS BIGINT) AS branch, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders),
branch AS (SELECT b.tree_id, b.branch, b.rank, p.branch AS parent, CAST(length(bin(b.rank)) - 1 AS INTEGER) AS branch_order
  FROM branch_rank b LEFT JOIN branch_rank p ON p.tree_id = b.tree_id AND p.rank = CAST(floor(b.rank / 2.0) AS BIGINT))""",
    "cylinder": """cyl_line AS (SELECT CAST(l_orderkey AS BIGINT) AS branch, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS position,
  l_quantity / 1003.0 AS radius, l_extendedprice / 99991.0 AS length, sin(l_discount * 10) * cos(l_tax * 70) + 0.0 AS ax, sin(l_discount * 10) * sin(l_tax * 70) + 0.0 AS ay, cos(l_discount * 10) AS az FROM lineitem),
cyl_start AS (SELECT *, coalesce(sum(length * ax) OVER w, 0.0) AS sx, coalesce(sum(length * ay) OVER w, 0.0) AS sy, coalesce(sum(length * az) OVER w, 0.0) AS z0
  FROM cyl_line WINDOW w AS (PARTITION BY branch ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cyl_id AS MATERIALIZED (SELECT c.*, b.tree_id, b.branch_order, b.parent AS above, c.z0 + (b.rank - 1) * 0.3 AS sz, row_number() OVER (PARTITION BY b.tree_id ORDER BY c.branch, c.position) AS cyl
  FROM cyl_start c JOIN branch b USING (branch)),
cylinder AS MATERIALIZED (SELECT c.tree_id, c.branch, c.branch_order, c.position, c.cyl, CASE WHEN c.position > 1 THEN c.cyl - 1 ELSE p.cyl END AS parent, c.radius, c.length, c.sx, c.sy, c.sz, c.ax, c.ay, c.az
  FROM cyl_id c LEFT JOIN cyl_id p ON p.tree_id = c.tree_id AND p.branch = c.above AND p.position = 1)""",
    "reading": """reading AS (SELECT CASE event_type WHEN 'view' THEN 'A' ELSE 'B' END AS kind, CAST(ts AS DATE) AS day, event_id AS seq, epoch_us(ts) AS micros, CAST(value AS DOUBLE) AS value
  FROM events WHERE event_type IN ('view', 'click'))""",
    "run": """run AS (SELECT 'ModelData_plot_winter_' || CAST(o_custkey AS VARCHAR) || '-0.08-0.09-5-0.04-0.045-3-5-1-' || CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS VARCHAR) || '.mat' AS file,
  o_totalprice / 997.0 AS volume, (o_orderkey % 300) / 9.7 AS height, (o_orderkey % 77) / 97.0 AS dbh FROM orders)""",
    "pixel": """pixel AS (SELECT vec_id AS image, CAST(label AS BIGINT) AS band, CAST(floor(k / 8.0) AS BIGINT) AS "row", k % 8 AS col, CAST(embedding[k + 1] AS DOUBLE) AS value
  FROM (SELECT vec_id, label, embedding, unnest(range(0, 64)) AS k FROM embeddings WHERE label IS NOT NULL))""",
}
_NEEDS = {"cylinder": ["branch"]}


def with_tables(query: str, *names: str, recursive: bool = False) -> str:
    """``query`` preceded by the named tables; ``query`` may start with further ones, as ``, name AS (...) SELECT ...``."""
    wanted: list[str] = []
    for n in names:
        wanted += [m for m in [*_NEEDS.get(n, []), n] if m not in wanted]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(_TEXT[n] for n in wanted) + "\n" + query.strip()


def off_ties(query: str) -> str:
    """``query`` with every ``round(x, n) + 0.0`` of a result moved off the middle between two results first, as the Spark side does."""
    for n in (3, 4, 6):
        query = query.replace(f", {n}) + 0.0", f" + CAST({1.7 * 10.0 ** -(n + 2)!r} AS DOUBLE), {n}) + 0.0")
    return query
