"""The forests of `operators.trees` in SQL: the same bins, draws and splits, a level of all trees at a time."""

from __future__ import annotations

import math

from ..operators.trees import MISSING, POISSON, PRIME


def draw_sql(source: str, x: str, *salts: str) -> str:
    """A query of the rows of `source` (a query) with u, the `trees.draw` of x; each step is a query around the last."""
    q, k = f"SELECT *, ({x})::BIGINT % {PRIME} AS _x0 FROM ({source})", 0
    for s in salts:
        for step in (f"({{x}} + (({s})::BIGINT % {PRIME}) * 1000003 % {PRIME} + 1) % {PRIME} * 48271 % {PRIME}",
                     f"({{x}} * {{x}} + 69069 * {{x}} + 7) % {PRIME}", f"({{x}} * {{x}} + 40692 * {{x}} + 11) % {PRIME}"):
            q, k = f"SELECT * EXCLUDE (_x{k}), {step.format(x=f'_x{k}')} AS _x{k + 1} FROM ({q})", k + 1
    return f"SELECT * EXCLUDE (_x{k}), _x{k} AS u FROM ({q})"


#: CTEs edges and cells (row, f, bin) of fv (row, f, x).
EDGES_SQL = f"""edges AS MATERIALIZED (SELECT f, list_distinct(list_transform(quantile_cont(x, [{", ".join(f"{j / MISSING!r}::DOUBLE" for j in range(1, MISSING))}]),
    lambda e: ROUND(e, 9))) AS e FROM fv GROUP BY f),
    cells AS MATERIALIZED (SELECT row, f, len(list_filter(e, lambda v: v < x))::INTEGER AS bin FROM fv JOIN edges USING (f))"""


def bins_sql(source: str, features: list[str], key: str, label: str, hashed: str) -> str:
    """CTEs fv (row, f, x), edges, cells and rows (row, h, y) of `source`, whose features are scaled already."""
    lists = ", ".join(f'"{c}"' for c in features)
    return f"""fv AS MATERIALIZED (SELECT {key} AS row, UNNEST(range(0, {len(features)}))::INTEGER AS f, UNNEST([{lists}]) AS x FROM {source}),
    {EDGES_SQL}, rows AS MATERIALIZED (SELECT {key} AS row, {hashed} AS h, {label} AS y FROM {source})"""


def _worth(a: str, b: str) -> str:
    return f"(-2.0::DOUBLE * ({b})::DOUBLE * (({a}) - ({b}))::DOUBLE / ({a})::DOUBLE)"


def tried_count(d: int, tried: str = "sqrt") -> int:
    return d if tried == "all" else math.ceil(math.sqrt(d))


def forest_sql(p: str, trees: str, allowed: str, used: str, d: int, depth: int = 10, tried: str = "sqrt", bootstrap: bool = True,
               held: str | None = None) -> str:
    """CTEs that begin with `p`: {p}imp (seed, f, weight), and with `held` {p}score (seed, row, score).

    trees: (tree, seed, number); allowed: (seed, f); used and held: (seed, row)."""
    wide = 1 << depth + 2  # a node is its tree times this plus its heap number
    count = "CASE " + " ".join(f"WHEN u < {t} THEN {i}" for i, t in enumerate(POISSON)) + f" ELSE {len(POISSON)} END"
    trained = f"SELECT tree, seed, number, row, h, y FROM {trees} JOIN {used} USING (seed) JOIN rows USING (row)"
    drawn = f"SELECT *, {count} AS w FROM ({draw_sql(trained, 'h', 'seed', 'number', '1')})" if bootstrap else f"SELECT *, 1 AS w FROM ({trained})"
    out = [f"{p}p0 AS MATERIALIZED (SELECT tree * {wide} + 1 AS node, row, w::BIGINT AS w, (w * y)::BIGINT AS wy FROM ({drawn}) WHERE w > 0)"]
    m = tried_count(d, tried)
    below = f"(node // {wide}) * {wide} + 2 * (node % {wide}) + CASE WHEN bin <= cut THEN 0 ELSE 1 END AS node"
    for i in range(depth):
        pairs = f"SELECT node, f, seed, number FROM {p}n{i} n JOIN {trees} t ON t.tree = n.node // {wide} JOIN {allowed} USING (seed) WHERE n.open"
        pick = f"SELECT node, f FROM ({pairs})" if m == d else (
            f"SELECT node, f FROM ({draw_sql(pairs, f'(node % {wide} % {PRIME}) * 65537 + f', 'seed', 'number', '2')}) "
            f"QUALIFY ROW_NUMBER() OVER (PARTITION BY node ORDER BY u, f) <= {m}")
        out += [
            f"""{p}n{i} AS MATERIALIZED (SELECT node, SUM(w)::BIGINT AS a, SUM(wy)::BIGINT AS b,
    SUM(wy) > 0 AND SUM(wy) < SUM(w) AND SUM(w) >= 2 AS open FROM {p}p{i} GROUP BY node)""",
            f"""{p}s{i} AS MATERIALIZED (SELECT node, -(best.f) AS f, -(best.cut) AS cut, best.g - {_worth('a', 'b')} AS gain FROM (
    SELECT c.node, n.a, n.b, MAX({{'g': {_worth('c.la', 'c.lb')} + {_worth('(n.a - c.la)', '(n.b - c.lb)')}, 'f': -c.f, 'cut': -c.bin}}) AS best FROM (
    SELECT k // 65536 AS node, k // 64 % 1024 AS f, k % 64 AS bin, SUM(a) OVER w AS la, SUM(b) OVER w AS lb FROM (
    SELECT (node * 1024 + f) * 64 + bin AS k, SUM(w)::BIGINT AS a, SUM(wy)::BIGINT AS b FROM {p}p{i} JOIN ({pick}) USING (node) JOIN cells USING (row, f) GROUP BY k)
    WINDOW w AS (PARTITION BY k // 64 ORDER BY k)) c JOIN {p}n{i} n USING (node) WHERE n.a - c.la >= 1 GROUP BY c.node, n.a, n.b)
    WHERE best.g - {_worth('a', 'b')} > 1e-12::DOUBLE)""",
            f"{p}p{i + 1} AS MATERIALIZED (SELECT {below}, row, w, wy FROM {p}p{i} JOIN {p}s{i} USING (node) JOIN cells USING (row, f))"]
    gains = " UNION ALL ".join(f"SELECT node // {wide} AS tree, f, gain FROM {p}s{i}" for i in range(depth))
    out += [f"{p}each AS (SELECT tree, f, SUM(gain) / SUM(SUM(gain)) OVER (PARTITION BY tree) AS w FROM ({gains}) GROUP BY tree, f)",
            f"""{p}imp AS MATERIALIZED (SELECT seed, f, CASE WHEN t > 0 THEN w / t ELSE 0 END AS weight FROM (SELECT a.seed, a.f, COALESCE(s.w, 0) AS w,
    SUM(COALESCE(s.w, 0)) OVER (PARTITION BY a.seed) AS t FROM {allowed} a LEFT JOIN (SELECT seed, f, SUM(w) AS w FROM {p}each JOIN {trees} USING (tree) GROUP BY seed, f) s
    USING (seed, f)))"""]
    if held:
        out += [f"{p}n{depth} AS (SELECT node, SUM(w)::BIGINT AS a, SUM(wy)::BIGINT AS b FROM {p}p{depth} GROUP BY node)",
                f"{p}q0 AS MATERIALIZED (SELECT tree * {wide} + 1 AS node, row FROM {trees} JOIN {held} USING (seed))"]
        ends = []
        for i in range(depth):
            out.append(f"{p}q{i + 1} AS MATERIALIZED (SELECT {below}, row FROM {p}q{i} JOIN {p}s{i} USING (node) JOIN cells USING (row, f))")
            ends.append(f"SELECT node, row, b / a::DOUBLE AS v FROM (SELECT * FROM {p}q{i} ANTI JOIN {p}s{i} USING (node)) JOIN {p}n{i} USING (node)")
        ends.append(f"SELECT node, row, b / a::DOUBLE AS v FROM {p}q{depth} JOIN {p}n{depth} USING (node)")
        out.append(f"{p}score AS MATERIALIZED (SELECT seed, row, AVG(v) AS score FROM ({' UNION ALL '.join(ends)}) e JOIN {trees} t ON t.tree = e.node // {wide} GROUP BY seed, row)")
    return ",\n    ".join(out)


def tree_rows(seeds: list[int], trees: int) -> str:
    """A CTE body (tree, seed, number)."""
    return (f"SELECT i * {trees} + number AS tree, seed, number FROM (SELECT UNNEST({list(seeds)})::BIGINT AS seed, "
            f"UNNEST(range(0, {len(seeds)})) AS i), (SELECT UNNEST(range(0, {trees})) AS number)")


def elimination_sql(seeds: list[int], d: int, n_select: int, trees: int = 100, used: str = "used", held: str | None = None, tag: str = "e",
                    depth: int = 10) -> str:
    """CTEs {tag}drop (seed, f, size): the feature that leaves when `size` are there, down to `n_select`; with `held` also
    {tag}err (seed, size, error). `used` and `held` are CTEs (seed, row)."""
    out = [f"{tag}trees AS MATERIALIZED ({tree_rows(seeds, trees)})",
           f"{tag}a{d} AS MATERIALIZED (SELECT UNNEST({list(seeds)})::BIGINT AS seed, f FROM (SELECT UNNEST(range(0, {d}))::INTEGER AS f))"]
    last = n_select if held else n_select + 1
    for size in range(d, last - 1, -1):
        p = f"{tag}{size}_"
        out.append(forest_sql(p, f"{tag}trees", f"{tag}a{size}", used, size, depth, held=held))
        if size > n_select:
            out += [f"{p}drop AS MATERIALIZED (SELECT seed, f FROM {p}imp QUALIFY ROW_NUMBER() OVER (PARTITION BY seed ORDER BY ROUND(weight, 12), f) = 1)",
                    f"{tag}a{size - 1} AS MATERIALIZED (SELECT * FROM {tag}a{size} ANTI JOIN {p}drop USING (seed, f))"]
    drops = " UNION ALL ".join(f"SELECT seed, f, {size} AS size FROM {tag}{size}_drop" for size in range(d, n_select, -1))
    out.append(f"{tag}drop AS MATERIALIZED ({drops})")
    if held:
        errors = " UNION ALL ".join(
            f"SELECT seed, {size} AS size, AVG(CASE WHEN (ROUND(score, 9) > 0.5::DOUBLE) <> (y = 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS error "
            f"FROM {tag}{size}_score JOIN rows USING (row) GROUP BY seed" for size in range(d, last - 1, -1))
        out.append(f"{tag}err AS MATERIALIZED ({errors})")
    return ",\n    ".join(out)
