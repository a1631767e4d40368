"""Register of runnable queries and their DuckDB twins."""

from __future__ import annotations

import functools

from roadframe.operators.common import plan_by_measured_sizes
from roadframe.plans.fixture_sql import FIXTURE_SQL, NEEDS

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark, sf):
            plan_by_measured_sizes(spark)
            return fn(spark, sf)
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def _closure(names):
    out = []
    for n in names:
        for m in _closure(NEEDS.get(n, [])):
            if m not in out:
                out.append(m)
        if n not in out:
            out.append(n)
    return out


def sql(fixtures: str, body: str, recursive: bool = False) -> str:
    """`body` after the WITH list of the named fixtures; it may go on with further `name AS (...)` items."""
    parts = [f"{n} AS MATERIALIZED ({FIXTURE_SQL[n].strip()})" for n in _closure(fixtures.split())]
    body = body.strip()
    tail = body.lower().startswith("select")
    if not parts:
        return body if tail else f"WITH {'RECURSIVE ' if recursive else ''}{body}"
    head = "WITH " + ("RECURSIVE " if recursive else "") + ",\n".join(parts)
    return head + ("\n" if tail else ",\n") + body


def r6(e: str) -> str:
    return f"(CASE WHEN abs({e}) < 5e-7 THEN 0e0 ELSE round({e}, 6) END)"


def pmod(a: str, b: str) -> str:
    return f"((({a}) % ({b})) + ({b})) % ({b})"


def mix(a: str, b: str) -> str:
    """The integer hash, in SQL."""
    return f"((CAST({a} AS BIGINT)*1103515245 + CAST({b} AS BIGINT)*12345 + 42) % 2147483648)"


def pick(a: str, b: str, n: str) -> str:
    h = mix(a, b)
    return f"(CAST(({h} - {h} % 65536) / 65536 AS BIGINT) % ({n}))"


# ------------------------------------------------------------------ SQL building blocks for rasters
BIG = 1 << 31


def blur_sql(name: str, src: str, fields: list[str], sigma: float, mode: str = "reflect", n: int = 64,
             key: str = "image_id", weights: list[float] | None = None, nearest: bool = False) -> str:
    """CTE items `{name}` (key, y, x, fields): separable Gaussian of the dense n x n images in `src`."""
    from roadframe.functions.kernels import gaussian_weights
    w = weights or gaussian_weights(sigma)
    r = len(w) // 2
    vals = ",".join(f"({d - r},CAST({v!r} AS DOUBLE))" for d, v in enumerate(w))

    def idx(e):
        if mode == "wrap":
            return pmod(e, str(n))
        m = pmod(e, str(2 * n))
        return f"(CASE WHEN {m} >= {n} THEN {2 * n - 1} - ({m}) ELSE {m} END)"
    agg = ", ".join(f"sum(b.{f}*m.w) AS {f}" for f in fields)
    return f"""{name}_k(d, w) AS (VALUES {vals}),
{name}_m AS (SELECT CAST(t.t AS INT) AS o, CAST({idx('t.t + k.d')} AS INT) AS s, sum(k.w) AS w FROM range({n}) AS t(t) CROSS JOIN {name}_k k GROUP BY 1, 2),
{name}_h AS (SELECT b.{key}, b.y, m.o AS x, {agg} FROM {src} b JOIN {name}_m m ON b.x = m.s GROUP BY 1, 2, 3),
{name} AS (SELECT b.{key}, m.o AS y, b.x, {agg} FROM {name}_h b JOIN {name}_m m ON b.y = m.s GROUP BY 1, 2, 3)"""


def regions_sql(name: str, src: str, eight: bool = False) -> str:
    """CTE item `{name}` (image_id, y, x, label) for the sparse pixels of `src`. Needs WITH RECURSIVE."""
    g = 1 if eight else 0
    return f"""{name}_i AS (SELECT image_id, y, x, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS grp FROM {src}),
{name}_r AS (SELECT image_id, y, min(x) AS x0, max(x) AS x1, y*CAST({BIG} AS BIGINT) + min(x) AS id FROM {name}_i GROUP BY image_id, y, grp),
{name}_e AS (SELECT a.image_id, a.id AS u, b.id AS v FROM {name}_r a JOIN {name}_r b ON a.image_id = b.image_id AND b.y = a.y + 1 AND a.x0 <= b.x1 + {g} AND b.x0 <= a.x1 + {g}),
{name}_s AS (SELECT image_id, u, v FROM {name}_e UNION ALL SELECT image_id, v, u FROM {name}_e),
{name}_c AS (SELECT image_id, id AS src, id AS cur FROM {name}_r UNION SELECT c.image_id, c.src, s.v FROM {name}_c c JOIN {name}_s s ON s.image_id = c.image_id AND s.u = c.cur),
{name}_l AS (SELECT image_id, src, min(cur) AS label FROM {name}_c GROUP BY 1, 2),
{name} AS (SELECT r.image_id, CAST(r.y AS INT) AS y, CAST(p.x AS INT) AS x, l.label FROM {name}_r r JOIN {name}_l l ON l.image_id = r.image_id AND l.src = r.id JOIN {src} p ON p.image_id = r.image_id AND p.y = r.y AND p.x BETWEEN r.x0 AND r.x1)"""


def nearest_sql(name: str, src: str, target: str) -> str:
    """CTE item `{name}` (image_id, y, x, d2, ty, tx): nearest pixel of `src` for which `target` holds."""
    return f"""{name}_c AS (SELECT image_id, y, x, max(CASE WHEN {target} THEN y END) OVER (PARTITION BY image_id, x ORDER BY y) AS u,
 min(CASE WHEN {target} THEN y END) OVER (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS d FROM {src}),
{name}_g AS (SELECT image_id, y, x, least(coalesce(y - u, 1048576), coalesce(d - y, 1048576)) AS g, CASE WHEN coalesce(y - u, 1048576) <= coalesce(d - y, 1048576) THEN u ELSE d END AS ty FROM {name}_c),
{name} AS (SELECT a.image_id, a.y, a.x, min(CAST(b.g AS BIGINT)*b.g + (a.x - b.x)*(a.x - b.x)) AS d2,
 arg_min(b.ty, (CAST(b.g AS BIGINT)*b.g + (a.x - b.x)*(a.x - b.x)) * 1000000 + b.ty * 1000 + b.x) AS ty,
 arg_min(b.x, (CAST(b.g AS BIGINT)*b.g + (a.x - b.x)*(a.x - b.x)) * 1000000 + b.ty * 1000 + b.x) AS tx
 FROM {name}_g a JOIN {name}_g b ON a.image_id = b.image_id AND a.y = b.y AND abs(a.x - b.x) <= a.g AND b.g < 1048576 GROUP BY 1, 2, 3)"""


def gray(e: str = "") -> str:
    p = e + "." if e else ""
    return f"((19595*{p}r + 38470*{p}g + 7471*{p}b + 32768) // 65536)"
