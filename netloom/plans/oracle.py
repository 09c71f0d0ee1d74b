"""SQL for the queries, run by another engine on the same tables.

Written apart from the operators: joins where they use conditions, recursion where
they use numbering, nested comparisons where they use bins.
"""

from __future__ import annotations

from netloom.functions.catalogues import DEFAULT
from netloom.sources.tables import RESTRICTION_TYPES, SHAPES


def _values(rows: tuple) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def _relation(name: str, schema: str, rows: tuple) -> str:
    fields = [f.split() for f in schema.split(", ")]
    casts = ", ".join(f"CAST({c} AS {kind}) AS {c}" for c, kind in fields)
    return f"{name} AS (SELECT {casts} FROM (VALUES {_values(rows)}) v({', '.join(c for c, _ in fields)}))"


KINDS = ", ".join(f"'{t}'" for t in RESTRICTION_TYPES)

SIDES = ", ".join(str((kind, ring, k, *a, *b)) for kind, shape in enumerate(SHAPES) for ring, points in enumerate(shape) for k, (a, b) in enumerate(zip(points, (*points[1:], points[0]), strict=True)))


def point_segment(px: str, py: str, ax: str, ay: str, bx: str, by: str) -> str:
    """The distance from a point to a segment."""
    t = f"greatest(0.0, least(1.0, (({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay})) / (({bx} - {ax}) * ({bx} - {ax}) + ({by} - {ay}) * ({by} - {ay}))))"
    return f"sqrt(pow({px} - {ax} - {t} * ({bx} - {ax}), 2) + pow({py} - {ay} - {t} * ({by} - {ay}), 2))"


def ray_meets(x: str, y: str) -> str:
    """Whether the ray to the right of a point meets a side."""
    return f"((ay > {y}) <> (by_ > {y}) AND {x} < (bx - ax) * ({y} - ay) / nullif(by_ - ay, 0) + ax)"


CTES = {
    "edges": """edges AS (SELECT l_orderkey AS tree, n, n // 2 AS parent, CAST(5 + floor(l_extendedprice / 1000) AS BIGINT) AS len_m,
      CAST(floor(l_quantity) AS BIGINT) AS flow, l_returnflag AS rtype
      FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INT) AS n FROM lineitem))""",
    "loose_edges": """edges AS (SELECT l_orderkey AS tree, 1000 - k AS n, CASE WHEN b > 0 THEN 1000 - b ELSE 0 END AS parent, CAST(5 + floor(l_extendedprice / 1000) AS BIGINT) AS len_m,
      CAST(floor(l_quantity) AS BIGINT) AS flow, l_returnflag AS rtype
      FROM (SELECT *, CAST(CASE WHEN k = 1 OR l_partkey % 9 = 0 THEN 0 WHEN l_partkey % 2 = 0 THEN k - 1 ELSE 1 + l_suppkey % (k - 1) END AS INT) AS b
      FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INT) AS k FROM lineitem)))""",
    "cps": "cps AS (SELECT c_custkey AS cp_id, c_custkey * 7919 % 2000 AS x, c_custkey * 104729 % 1600 AS y, 1 + c_custkey % 77 AS flow FROM customer)",
    "net_nodes": "net_nodes AS (SELECT s_suppkey AS node_id, 20 * s_suppkey AS x, 800 + (s_suppkey * 37 % 21 - 10) AS y, s_suppkey % 3 = 0 AS is_chamber FROM supplier)",
    "net_segments": """net_segments AS (SELECT a.node_id AS seg_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, CAST(100 + a.node_id % 4 * 100 AS INT) AS dn
      FROM net_nodes a JOIN net_nodes b ON b.node_id = a.node_id + 1)""",
    "rects": f"""rects AS (SELECT p_partkey AS r_id, list_element([{KINDS}], CAST(p_partkey % {len(RESTRICTION_TYPES)} AS INT) + 1) AS rtype, p_partkey * 613 % 1950 AS x0, p_partkey * 353 % 1550 AS y0,
      p_partkey * 613 % 1950 + p_size AS x1, p_partkey * 353 % 1550 + 1 + p_partkey % 30 AS y1 FROM part)""",
    "plot_sides": f"""plot_sides AS (SELECT r_id, rtype, ring, k, CAST(x0 + fax * 0.25 * (x1 - x0) AS DOUBLE) AS ax, CAST(y0 + fay * 0.25 * (y1 - y0) AS DOUBLE) AS ay, CAST(x0 + fbx * 0.25 * (x1 - x0) AS DOUBLE) AS bx, CAST(y0 + fby * 0.25 * (y1 - y0) AS DOUBLE) AS by_
      FROM rects JOIN (VALUES {SIDES}) v(kind, ring, k, fax, fay, fbx, fby) ON r_id % 3 = kind)""",
    "variants": "variants AS (SELECT o_orderkey AS tree, o_custkey AS plan, 1 + o_orderkey % 3 AS variant FROM orders)",
    "run_events": """run_events AS (SELECT user_id AS run_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS seq, ts, event_type AS stage,
      CAST(least(100, floor(value / 5)) AS INT) AS progress FROM events)""",
    "cat": _relation("cat", "dn INT, capacity BIGINT, max_len BIGINT, price BIGINT", DEFAULT.diameters),
    "env": _relation("env", "dn INT, width BIGINT", DEFAULT.envelopes),
    "rules": _relation("rules", "rtype VARCHAR, mode VARCHAR, min_dist BIGINT, factor BIGINT", DEFAULT.rules),
    "bands": _relation("bands", "rtype VARCHAR, max_dn INT, dist BIGINT", DEFAULT.bands),
    "chambers": _relation("chambers", "max_dn INT, price BIGINT", DEFAULT.chambers),
    # The path from each edge to the root, by following parents.
    "up": """up AS (SELECT tree, n AS below, n, 0 AS steps, len_m, flow FROM edges
      UNION ALL SELECT up.tree, up.below, e.parent, up.steps + 1, up.len_m, up.flow FROM up JOIN edges e ON e.tree = up.tree AND e.n = up.n WHERE e.parent > 0)""",
    "carried": "carried AS (SELECT tree, n, CAST(sum(flow) AS BIGINT) AS total_flow FROM up GROUP BY tree, n)",
    "designed": """designed AS (SELECT e.*, c.total_flow, coalesce((SELECT min(dn) FROM cat WHERE capacity >= c.total_flow), (SELECT max(dn) FROM cat)) AS dn
      FROM edges e JOIN carried c ON c.tree = e.tree AND c.n = e.n)""",
    "ends": "ends AS (SELECT tree, parent AS node, dn FROM designed UNION ALL SELECT tree, n, dn FROM designed)",
    "totals": """totals AS (SELECT p.tree, pipe_cost, chamber_cost, tie_ins, length_m FROM
      (SELECT d.tree, CAST(sum(floor(d.len_m * c.price + 0.5)) AS BIGINT) AS pipe_cost, CAST(sum(d.len_m) AS BIGINT) AS length_m, count(*) FILTER (WHERE d.parent = 0) AS tie_ins FROM designed d JOIN cat c ON c.dn = d.dn GROUP BY d.tree) p
      JOIN (SELECT tree, CAST(sum(price) AS BIGINT) AS chamber_cost FROM (SELECT n.tree, (SELECT min(price) FROM chambers WHERE max_dn >= n.max_dn) AS price FROM (SELECT tree, node, max(dn) AS max_dn, count(*) AS degree FROM ends GROUP BY tree, node) n WHERE degree >= 3 OR node = 0) GROUP BY tree) q ON q.tree = p.tree)""",
}
NEEDS = {"plot_sides": ["rects"], "net_segments": ["net_nodes"], "up": ["edges"], "carried": ["up"], "designed": ["carried", "cat"], "ends": ["designed"], "totals": ["ends", "chambers"]}


def with_(names: str, body: str, instead: dict[str, str] | None = None) -> str:
    """The statement with the relations it names, and those they need, before it; some by another's definition."""
    instead = instead or {}
    order: list[str] = []

    def add(name: str) -> None:
        for other in NEEDS.get(name, []):
            add(other)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    ctes = ", ".join(CTES[instead.get(n, n)] for n in order)
    if not ctes:
        return body
    return f"WITH RECURSIVE {ctes}{body}" if body.startswith(",") else f"WITH RECURSIVE {ctes}\n{body}"
