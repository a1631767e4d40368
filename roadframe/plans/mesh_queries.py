"""Bridges, meshes, outlines, object copies and point inspection."""

import os
import uuid

from pyspark.sql import functions as F

from roadframe.functions.scalars import smoothstep
from roadframe.operators import bridges as B, geometry as Q, memory as M, mesh as E, routing as RT
from roadframe.operators.common import checkpoint_root, materialize
from roadframe.plans import geometry_queries as GQ, network_queries as NQ, synth_queries as SQ, training_queries as TQ
from roadframe.plans.memory_queries import BOTH
from roadframe.plans.registry import query, regions_sql, sql
from roadframe.plans.stages import stage
from roadframe.sources import fixtures as X

R = lambda *cs: [F.round(c, 6).alias(c) for c in cs]
_S = lambda t: f"(least(1e0, greatest(0e0, {t}))*least(1e0, greatest(0e0, {t}))*(3 - 2*least(1e0, greatest(0e0, {t}))))"


@query("smoothstep", sql("review_log", f"SELECT step_id, round({_S('value/1e2 - 2e-1')}, 6) AS t FROM review_log"))
def smoothstep_q(spark, sf):
    return X.review_log(spark, sf).select("step_id", F.round(smoothstep(F.col("value") / 100.0 - 0.2), 6).alias("t"))


# ------------------------------------------------------------------ bridges
def lattice_ends(spark, sf):
    l = GQ.lattice(spark, sf)
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    n = F.hypot(dx, dy)
    e = l.select("image_id", "street_id", n.alias("length"), F.explode(F.array(
        F.struct(F.lit(0).alias("which"), F.col("node0").alias("node"), F.col("x0").alias("x"), F.col("y0").alias("y"), (dx / n).alias("ux"), (dy / n).alias("uy")),
        F.struct(F.lit(1).alias("which"), F.col("node1").alias("node"), F.col("x1").alias("x"), F.col("y1").alias("y"), (-dx / n).alias("ux"), (-dy / n).alias("uy")))).alias("e"))
    return e.select("image_id", "street_id", "length", "e.*")


WALKED = GQ.NODE + """, le AS (SELECT image_id, street_id, 0 AS which, node0 AS node, x0 AS x, y0 AS y, (x1-x0)/sqrt(pow(x1-x0,2)+pow(y1-y0,2)) AS ux, (y1-y0)/sqrt(pow(x1-x0,2)+pow(y1-y0,2)) AS uy, sqrt(pow(x1-x0,2)+pow(y1-y0,2)) AS len FROM lattice_street
 UNION ALL SELECT image_id, street_id, 1, node1, x1, y1, (x0-x1)/sqrt(pow(x1-x0,2)+pow(y1-y0,2)), (y0-y1)/sqrt(pow(x1-x0,2)+pow(y1-y0,2)), sqrt(pow(x1-x0,2)+pow(y1-y0,2)) FROM lattice_street),
wk(hop, image_id, first, street_id, which, turn, len, sides, used) AS (SELECT 0, image_id, street_id, street_id, 0, 0e0, len, CAST(0 AS BIGINT), [street_id] FROM le WHERE which = 0 UNION ALL
 SELECT hop+1, image_id, first, b.s2, b.w2, b.turn, b.l, sides, list_append(used, b.s2) FROM (
  SELECT w.hop, w.image_id, w.first, any_value(w.used) AS used, count(*) - 2 AS sides, arg_min({'s2': n.street_id, 'w2': n.which, 'turn': round(degrees(acos(least(1e0, greatest(-1e0, -f.ux*n.ux - f.uy*n.uy)))), 6), 'l': w.len + sqrt(pow(c.cx-f.x,2)+pow(c.cy-f.y,2)) + sqrt(pow(n.x-c.cx,2)+pow(n.y-c.cy,2)) + n.len},
   round(degrees(acos(least(1e0, greatest(-1e0, -f.ux*n.ux - f.uy*n.uy)))), 6)*1000000 + n.street_id*2 + n.which) FILTER (NOT list_contains(w.used, n.street_id) AND round(degrees(acos(least(1e0, greatest(-1e0, -f.ux*n.ux - f.uy*n.uy)))), 6) <= 35) AS b
  FROM wk w JOIN le f ON f.image_id=w.image_id AND f.street_id=w.street_id AND f.which=1-w.which JOIN nd c ON c.image_id=f.image_id AND c.root=f.node JOIN le n ON n.image_id=f.image_id AND n.node=f.node WHERE w.len < 350 GROUP BY 1, 2, 3) q WHERE b IS NOT NULL)"""
PATCHED = WALKED.replace("c.root=f.node JOIN", "c.root=f.node AND (c.root + c.image_id) % 5 <> 0 JOIN")
OUT = "\nSELECT image_id*100 + first AS walker, hop, image_id, street_id, which, turn, round(len, 6) AS length, sides FROM wk"


@query("follow_straightest", sql("lattice_street", WALKED + OUT, recursive=True))
def follow_straightest(spark, sf):
    nodes = GQ.lattice_nodes(spark, sf).select("image_id", F.col("root").cast("int").alias("node"), "cx", "cy")
    w = GQ.lattice(spark, sf).select((F.col("image_id") * 100 + F.col("street_id")).alias("walker"), "image_id", "street_id", F.lit(0).alias("which"), F.lit(350.0).alias("need"))
    return B.follow_straightest(w, lattice_ends(spark, sf), nodes).withColumn("length", F.round("length", 6))


def patched_walks(spark, sf):
    """Walks that end at nodes that are no patch: every fifth of an image."""
    nodes = GQ.lattice_nodes(spark, sf).select("image_id", F.col("root").cast("int").alias("node"), "cx", "cy", ((F.col("root") + F.col("image_id")) % 5 != 0).alias("patch"))
    w = GQ.lattice(spark, sf).select((F.col("image_id") * 100 + F.col("street_id")).alias("walker"), "image_id", "street_id", F.lit(0).alias("which"), F.lit(350.0).alias("need"))
    return stage(spark, sf, "patched_walks", lambda: B.follow_straightest(w, lattice_ends(spark, sf), nodes))


@query("follow_patches", sql("lattice_street", PATCHED + OUT, recursive=True))
def follow_patches(spark, sf):
    return patched_walks(spark, sf).withColumn("length", F.round("length", 6))


@query("side_streets", sql("lattice_street", PATCHED + """
SELECT o.image_id*100 + o.first AS walker, o.hop, o.image_id, e.node, e.street_id, e.which FROM wk o JOIN wk b ON b.image_id=o.image_id AND b.first=o.first AND b.hop=o.hop-1
 JOIN le a ON a.image_id=o.image_id AND a.street_id=o.street_id AND a.which=o.which JOIN le e ON e.image_id=a.image_id AND e.node=a.node AND e.street_id <> o.street_id AND e.street_id <> b.street_id""", recursive=True))
def side_streets(spark, sf):
    return B.side_streets(patched_walks(spark, sf), lattice_ends(spark, sf))


def paths(spark, sf):
    return stage(spark, sf, "paths", lambda: Q.order_path(NQ.segments(spark, sf)))


PLAN = NQ.S_SEG + "," + GQ.WALK + f""", br AS (SELECT s_suppkey AS image_id, 0 AS idx, CAST(32 AS DOUBLE) AS cx, CAST(32 AS DOUBLE) AS cy, 16e0 + s_suppkey % 9 AS length, 1e1 AS width, 15e0 * (s_suppkey % 12) AS angle FROM supplier),
pi AS (SELECT w.image_id, b.idx, w.label, w.k, w.x, w.y, b.angle FROM wk w JOIN br b USING (image_id) WHERE {GQ._RECT('w.x', 'w.y')}),
pg AS (SELECT image_id, idx, label, any_value(angle) AS angle, count(*) AS n, arg_max(x, k) - arg_min(x, k) AS dx, arg_max(y, k) - arg_min(y, k) AS dy FROM pi GROUP BY 1, 2, 3 HAVING count(*) >= 2),
pb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, idx ORDER BY n DESC, label) AS rn FROM pg WHERE abs(dx*cos(radians(angle)) + dy*sin(radians(angle)))/CASE WHEN dx=0 AND dy=0 THEN 1e0 ELSE sqrt(CAST(dx AS DOUBLE)*dx+dy*dy) END > 8e-1) WHERE rn = 1),
ln AS (SELECT w.image_id, b.idx, w.k, w.x, w.y, coalesce(sqrt(pow(w.x - lag(w.x) OVER o, 2) + pow(w.y - lag(w.y) OVER o, 2)), 0e0) AS st FROM wk w JOIN pb b ON b.image_id=w.image_id AND b.label=w.label WINDOW o AS (PARTITION BY w.image_id ORDER BY w.k)),
la AS (SELECT image_id, idx, x, y, 25e-2*sum(st) OVER (PARTITION BY image_id, idx ORDER BY k) AS arc FROM ln),
pl AS (SELECT b.image_id, b.idx, min(arc) FILTER ({GQ._RECT('l.x', 'l.y')}) AS s_in, max(arc) FILTER ({GQ._RECT('l.x', 'l.y')}) AS s_out, max(arc) AS len FROM br b LEFT JOIN la l ON l.image_id=b.image_id GROUP BY 1, 2),
pr AS (SELECT *, CASE WHEN s_in IS NOT NULL THEN least(8e0, s_in) END AS rb, CASE WHEN s_in IS NOT NULL THEN least(8e0, len - s_out) END AS ra FROM pl), ps AS (SELECT *, greatest(CASE WHEN rb > 0 THEN 75e-1/rb END, CASE WHEN ra > 0 THEN 75e-1/ra END) AS steep FROM pr)"""


def rects(spark, sf):
    return X.bridges(spark, sf)


def bridge_lines(spark, sf):
    st = paths(spark, sf).select("image_id", F.col("label").alias("street_id"), "seq", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    best = B.aligned_road(st, rects(spark, sf))
    return st.join(best, ["image_id", "street_id"]).select("image_id", "idx", "seq", "x", "y")


@query("bridge_plan", NQ.Q(PLAN, """SELECT image_id, idx, s_in IS NOT NULL AS ok, round(s_in, 6) AS s_in, round(s_out, 6) AS s_out, round(rb, 6) AS r_before, round(ra, 6) AS r_after, round(steep*100, 6) AS steepest_pct,
 concat_ws('; ', CASE WHEN len IS NULL THEN 'no_road' END, CASE WHEN len IS NOT NULL AND s_in IS NULL THEN 'outside' END, CASE WHEN rb < 7 THEN 'short_ramp_start' END, CASE WHEN ra < 7 THEN 'short_ramp_end' END,
 CASE WHEN s_in IS NOT NULL AND coalesce(steep, 1e9) > 8e-2 THEN 'too_steep' END) AS warnings FROM ps"""))
def bridge_plan(spark, sf):
    p = B.bridge_plan(bridge_lines(spark, sf), rects(spark, sf), 0.25, 5.0, 8.0)
    return p.select("image_id", "idx", "ok", *R("s_in", "s_out", "r_before", "r_after", "steepest_pct"), "warnings")


@query("height_profile", sql("polyline", GQ.ARC + f""", l AS (SELECT *, max(arc) OVER (PARTITION BY street_id) AS len FROM arc), p AS (SELECT *, 3e-1*len AS si, 6e-1*len AS so, least(2e1, 3e-1*len) AS rb, least(2e1, 4e-1*len) AS ra FROM l)
SELECT street_id, seq, round(CASE WHEN arc < si THEN CASE WHEN rb > 0 THEN 5*{_S('((arc - (si - rb))/rb)')} ELSE 0 END WHEN arc > so THEN CASE WHEN ra > 0 THEN 5*{_S('((so + ra - arc)/ra)')} ELSE 0 END ELSE 5 END, 6) AS height FROM p"""))
def height_profile(spark, sf):
    a = GQ.arc(spark, sf)
    d = a.join(a.groupBy("street_id").agg(F.max("arc").alias("len")), "street_id")
    l = F.col("len")
    h = B.height_profile(F.col("arc"), F.lit(5.0), l * 0.3, l * 0.6, F.least(F.lit(20.0), l * 0.3), F.least(F.lit(20.0), l * 0.4))
    return d.select("street_id", "seq", F.round(h, 6).alias("height"))


@query("vertex_lifts", sql("mesh_vertex mesh_quad", f"""
fo AS (SELECT DISTINCT mesh_id, owner, unnest([a, b, c, d]) AS vid FROM mesh_quad), sx AS (SELECT vid, mesh_id, x, z AS y, least(1e1, greatest(0e0, x)) AS s FROM mesh_vertex),
pf AS (SELECT *, CASE WHEN s < 4 THEN 5*{_S('((s - 1)/3e0)')} WHEN s > 6 THEN 5*{_S('((9 - s)/3e0)')} ELSE 5e0 END AS h FROM sx), mn AS (SELECT DISTINCT mesh_id, vid FROM fo WHERE owner IN (1, 2)), sd AS (SELECT DISTINCT f.mesh_id, f.vid FROM fo f WHERE owner = 4 AND NOT EXISTS (SELECT 1 FROM mn WHERE mn.mesh_id=f.mesh_id AND mn.vid=f.vid))
SELECT p.mesh_id, p.vid, round(CASE WHEN m.vid IS NOT NULL THEN p.h WHEN s.vid IS NOT NULL THEN 5*{_S('(2/3e0)')}*{_S('(1 - (sqrt(pow(p.x-3,2)+pow(p.y-5,2)) - 1)*2/3e1)')} ELSE 0e0 END, 6) AS lift FROM pf p LEFT JOIN mn m ON m.mesh_id=p.mesh_id AND m.vid=p.vid LEFT JOIN sd s ON s.mesh_id=p.mesh_id AND s.vid=p.vid"""))
def vertex_lifts(spark, sf):
    v = X.mesh_vertex(spark, sf).select("mesh_id", "vid", "x", F.col("z").alias("y"))
    f = X.mesh_quad(spark, sf).select("mesh_id", "owner", F.explode(F.array("a", "b", "c", "d")).alias("vid")).distinct()
    ids = X.mesh_vertex(spark, sf).select("mesh_id").distinct()
    plan = ids.select("mesh_id", F.lit(0).alias("idx"), *[F.lit(x).alias(n) for n, x in (("height", 5.0), ("s_in", 4.0), ("s_out", 6.0), ("r_before", 3.0), ("r_after", 3.0))])
    own = ids.select("mesh_id", F.lit(0).alias("idx"), F.explode(F.array(F.lit(1), F.lit(2))).alias("owner"))
    line = ids.select("mesh_id", F.lit(0).alias("idx"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("seq")).select("mesh_id", "idx", "seq", (F.col("seq") * 2.0).alias("x"), F.lit(5.0).alias("y"), (F.col("seq") * 2.0).alias("arc"))
    side = ids.select("mesh_id", F.lit(0).alias("idx"), F.lit(3.0).alias("cx"), F.lit(5.0).alias("cy"), F.lit(1.0).alias("r"), F.lit(4).alias("owner"))
    return B.vertex_lifts(v, f, plan, own, line, side, 2.0).select("mesh_id", "vid", *R("lift"))


# ------------------------------------------------------------------ meshes
def verts(spark, sf):
    return stage(spark, sf, "mesh_vertex", lambda: X.mesh_vertex(spark, sf))


def quads(spark, sf):
    return stage(spark, sf, "mesh_quad", lambda: X.mesh_quad(spark, sf))


def tris(spark, sf):
    return stage(spark, sf, "mesh_tris", lambda: E.split_quads(quads(spark, sf), verts(spark, sf)))


_U = lambda p, q, r: f"(({q}.z-{p}.z)*({r}.x-{p}.x) - ({q}.x-{p}.x)*({r}.z-{p}.z))"
MV = "mv AS MATERIALIZED (SELECT mesh_id*64 + vid AS k, x, h, z FROM mesh_vertex)"
QUAD = MV + f""", q0 AS (SELECT q.mesh_id, q.fid, q.part, q.owner, a AS ai, c AS ci, CASE WHEN {_U('va','vb','vc')} + {_U('va','vc','vd')} < 0 THEN d ELSE b END AS bi, CASE WHEN {_U('va','vb','vc')} + {_U('va','vc','vd')} < 0 THEN b ELSE d END AS di FROM mesh_quad q
 JOIN mv va ON va.k=q.mesh_id*64+q.a JOIN mv vb ON vb.k=q.mesh_id*64+q.b JOIN mv vc ON vc.k=q.mesh_id*64+q.c JOIN mv vd ON vd.k=q.mesh_id*64+q.d),
q1 AS (SELECT q.*, {_U('va','vb','vc')} > 2e-4 AS abc, {_U('va','vc','vd')} > 2e-4 AS acd, {_U('va','vb','vd')} > 2e-4 AS abd, {_U('vb','vc','vd')} > 2e-4 AS bcd FROM q0 q
 JOIN mv va ON va.k=q.mesh_id*64+q.ai JOIN mv vb ON vb.k=q.mesh_id*64+q.bi JOIN mv vc ON vc.k=q.mesh_id*64+q.ci JOIN mv vd ON vd.k=q.mesh_id*64+q.di),
q2 AS (SELECT *, abc AND acd AS ac2, NOT (abc AND acd) AND abd AND bcd AS bd2 FROM q1),
tri AS (SELECT mesh_id, fid, part, owner, 0 AS half, ai AS a, bi AS b, ci AS c, false AS other_diagonal FROM q2 WHERE ac2 OR (NOT bd2 AND abc)
 UNION ALL SELECT mesh_id, fid, part, owner, 1, ai, ci, di, false FROM q2 WHERE ac2 OR (NOT bd2 AND NOT abc AND acd)
 UNION ALL SELECT mesh_id, fid, part, owner, 0, ai, bi, di, true FROM q2 WHERE bd2 OR (NOT ac2 AND NOT abc AND NOT acd AND abd)
 UNION ALL SELECT mesh_id, fid, part, owner, 1, bi, ci, di, true FROM q2 WHERE bd2 OR (NOT ac2 AND NOT abc AND NOT acd AND NOT abd AND bcd))"""


@query("world_coords", sql("candidates", "SELECT image_id, cand_id, round(x*25e-2 - 125e0, 6) AS wx, round(y*25e-2 - 125e0, 6) AS wz, round(x/1e3, 6) AS u, round(y/1e3, 6) AS v FROM candidates"))
def world_coords(spark, sf):
    d = X.candidates(spark, sf).withColumn("w", F.lit(1000)).withColumn("h", F.lit(1000))
    return E.world_coords(d, 0.25).select("image_id", "cand_id", *R("wx", "wz", "u", "v"))


@query("fix_winding", sql("mesh_vertex mesh_quad", MV + f""", t AS (SELECT q.mesh_id, q.fid, q.a, q.b, q.c, {_U('va','vb','vc')} AS ny FROM mesh_quad q JOIN mv va ON va.k=q.mesh_id*64+q.a JOIN mv vb ON vb.k=q.mesh_id*64+q.b JOIN mv vc ON vc.k=q.mesh_id*64+q.c)
SELECT mesh_id, fid, a, CASE WHEN ny < 0 THEN c ELSE b END AS b, CASE WHEN ny < 0 THEN b ELSE c END AS c, ny < 0 AS flipped FROM t WHERE abs(ny)*5e-1 > 1e-3"""))
def fix_winding(spark, sf):
    return E.fix_winding(quads(spark, sf).select("mesh_id", "fid", "a", "b", "c"), verts(spark, sf))


@query("split_quads", sql("mesh_vertex mesh_quad", QUAD + " SELECT * FROM tri"))
def split_quads(spark, sf):
    return E.split_quads(quads(spark, sf), verts(spark, sf))


@query("mesh_volume_stats", sql("mesh_vertex mesh_quad", QUAD + """, f AS (SELECT mesh_id, fid, count(*) AS n, bool_and(other_diagonal) AS o FROM tri GROUP BY 1, 2), k AS (SELECT mesh_id, CAST(sum(n) AS BIGINT) AS t, count(*) AS kept, count(*) FILTER (o AND n = 2) AS od FROM f GROUP BY 1)
SELECT v.mesh_id, v.n AS vertices, q.n AS quads, k.t AS triangles, q.n - k.kept AS dropped, k.od AS other_diagonal, v.sx AS size_x, v.sz AS size_z FROM (SELECT mesh_id, count(*) AS n, max(x)-min(x) AS sx, max(z)-min(z) AS sz FROM mesh_vertex GROUP BY 1) v JOIN (SELECT mesh_id, count(*) AS n FROM mesh_quad GROUP BY 1) q USING (mesh_id) JOIN k USING (mesh_id)"""))
def mesh_volume_stats(spark, sf):
    return E.mesh_volume_stats(quads(spark, sf), verts(spark, sf))


RAST = QUAD + """, tc AS (SELECT t.mesh_id, t.fid, 3*va.x AS x0, 3*va.z AS z0, va.h AS h0, 3*vb.x AS x1, 3*vb.z AS z1, vb.h AS h1, 3*vc.x AS x2, 3*vc.z AS z2, vc.h AS h2 FROM tri t JOIN mv va ON va.k=t.mesh_id*64+t.a JOIN mv vb ON vb.k=t.mesh_id*64+t.b JOIN mv vc ON vc.k=t.mesh_id*64+t.c),
tp AS (SELECT t.*, CAST(y.i AS INTEGER) AS py, CAST(x.i AS INTEGER) AS px, (z1-z2)*(x0-x2)+(x2-x1)*(z0-z2) AS den FROM tc t JOIN range(64) AS y(i) ON y.i BETWEEN least(z0,z1,z2) AND greatest(z0,z1,z2) JOIN range(64) AS x(i) ON x.i BETWEEN least(x0,x1,x2) AND greatest(x0,x1,x2)),
tw AS (SELECT *, ((z1-z2)*(px-x2)+(x2-x1)*(py-z2))/den AS w0, ((z2-z0)*(px-x2)+(x0-x2)*(py-z2))/den AS w1 FROM tp WHERE abs(den) > 1e-12),
ras AS (SELECT mesh_id, py AS y, px AS x, max(w0*h0 + w1*h1 + (1-w0-w1)*h2) AS h FROM tw WHERE w0 >= -1e-6 AND w1 >= -1e-6 AND 1-w0-w1 >= -1e-6 GROUP BY 1, 2, 3)"""


@query("rasterise_faces", sql("mesh_vertex mesh_quad", RAST + " SELECT mesh_id, y, x, round(h, 6) AS h FROM ras"))
def rasterise_faces(spark, sf):
    return E.rasterise_faces(tris(spark, sf).select("mesh_id", "fid", "a", "b", "c"), verts(spark, sf), 3.0).select("mesh_id", "y", "x", *R("h"))


@query("coverage_audit", sql("mask_px mesh_vertex mesh_quad", NQ.S_CLEAN + "," + RAST + ", ba AS (SELECT r.* FROM road r WHERE NOT EXISTS (SELECT 1 FROM ras c WHERE c.mesh_id=r.image_id AND c.y=r.y AND c.x=r.x))," + regions_sql("bq", "ba") + """
SELECT image_id, label, count(*) AS pixels, round(avg(y), 6) AS cy, round(avg(x), 6) AS cx FROM bq GROUP BY 1, 2 HAVING count(*) >= 12""", recursive=True))
def coverage_audit(spark, sf):
    cov = E.rasterise_faces(tris(spark, sf).select("mesh_id", "fid", "a", "b", "c"), verts(spark, sf), 3.0).withColumnRenamed("mesh_id", "image_id")
    return E.coverage_audit(NQ.road(spark, sf), cov).select("image_id", "label", "pixels", *R("cy", "cx"))


CLS = """s AS (SELECT street_id, avg(hw)/2e1 AS width_m FROM polyline GROUP BY 1), w AS (SELECT round(width_m*100, 1) AS w, row_number() OVER (ORDER BY round(width_m*100, 1)) - 1 AS i, count(*) OVER () AS n FROM s),
g AS (SELECT w, CASE WHEN i < (n % 3)*(n//3 + 1) THEN i // (n//3 + 1) ELSE n % 3 + (i - (n % 3)*(n//3 + 1)) // (n//3) END AS g FROM w), m AS (SELECT DISTINCT greatest(5, CAST(round_even(q/5, 0) AS INTEGER)*5) AS cm FROM (SELECT g, quantile_cont(w, 5e-1) AS q FROM g GROUP BY 1))"""


@query("dash_width_classes", sql("polyline", CLS + " SELECT s.street_id, arg_min(m.cm, round(abs(m.cm - width_m*100), 6)*1000 + m.cm/1e3) AS cm FROM s CROSS JOIN m GROUP BY 1"))
def dash_width_classes(spark, sf):
    s = GQ.lines(spark, sf).groupBy("street_id").agg((F.avg("hw") / 20.0).alias("width_m"))
    return E.dash_width_classes(s)[1]


@query("group_faces", sql("mesh_vertex mesh_quad", QUAD + """, v AS (SELECT DISTINCT mesh_id, part, owner, unnest([a, b, c]) AS vid FROM tri), r AS (SELECT *, row_number() OVER (PARTITION BY mesh_id, part ORDER BY vid, owner) - 1 AS i FROM v)
SELECT t.mesh_id, t.part, t.fid, t.half, CAST(ra.i AS INTEGER) AS ia, CAST(rb.i AS INTEGER) AS ib, CAST(rc.i AS INTEGER) AS ic FROM tri t JOIN r ra ON ra.mesh_id=t.mesh_id AND ra.part=t.part AND ra.owner=t.owner AND ra.vid=t.a JOIN r rb ON rb.mesh_id=t.mesh_id AND rb.part=t.part AND rb.owner=t.owner AND rb.vid=t.b JOIN r rc ON rc.mesh_id=t.mesh_id AND rc.part=t.part AND rc.owner=t.owner AND rc.vid=t.c"""))
def group_faces(spark, sf):
    return E.group_faces(tris(spark, sf), ["part"])[1]


@query("vertex_normals", sql("mesh_vertex mesh_quad", QUAD + """, c3 AS (SELECT t.mesh_id, [t.a, t.b, t.c] AS vs, (vb.h-va.h)*(vc.z-va.z)-(vb.z-va.z)*(vc.h-va.h) AS nx, (vb.z-va.z)*(vc.x-va.x)-(vb.x-va.x)*(vc.z-va.z) AS nh, (vb.x-va.x)*(vc.h-va.h)-(vb.h-va.h)*(vc.x-va.x) AS nz FROM tri t JOIN mv va ON va.k=t.mesh_id*64+t.a JOIN mv vb ON vb.k=t.mesh_id*64+t.b JOIN mv vc ON vc.k=t.mesh_id*64+t.c),
n3 AS (SELECT mesh_id, unnest(vs) AS vid, nx, nh, nz FROM c3), s3 AS (SELECT mesh_id, vid, sum(nx) AS nx, sum(nh) AS nh, sum(nz) AS nz FROM n3 GROUP BY 1, 2), l3 AS (SELECT *, sqrt(nx*nx+nh*nh+nz*nz) AS l FROM s3)
SELECT v.mesh_id, v.vid, round(CASE WHEN l > 1e-12 THEN nx/l ELSE 0e0 END, 6) AS nx, round(CASE WHEN l > 1e-12 THEN nh/l ELSE 1e0 END, 6) AS nh, round(CASE WHEN l > 1e-12 THEN nz/l ELSE 0e0 END, 6) AS nz FROM mesh_vertex v LEFT JOIN l3 n USING (mesh_id, vid)"""))
def vertex_normals(spark, sf):
    return E.vertex_normals(tris(spark, sf).select("mesh_id", "fid", "a", "b", "c"), verts(spark, sf)).select("mesh_id", "vid", *R("nx", "nh", "nz"))


@query("normalise_object", sql("mesh_vertex mesh_quad", """b AS (SELECT mesh_id, min(x) AS x0, max(x) AS x1, min(h) AS h0, max(h) AS h1, min(z) AS z0, max(z) AS z1, count(DISTINCT vid % 3) AS parts FROM mesh_vertex GROUP BY 1), f AS (SELECT mesh_id, count(*) AS n FROM mesh_quad GROUP BY 1)
SELECT mesh_id AS object_id, round(x1-x0, 3) AS width_m, round(z1-z0, 3) AS depth_m, round(h1-h0, 3) AS height_m, f.n AS triangles, parts, greatest(x1-x0, z1-z0, h1-h0) > 8 AS too_big, round((SELECT sum(abs(v.x - (x0+x1)/2) + (v.h - h0) + abs(v.z - (z0+z1)/2)) FROM mesh_vertex v WHERE v.mesh_id = b.mesh_id), 6) AS checksum FROM b JOIN f USING (mesh_id)"""))
def normalise_object(spark, sf):
    p = verts(spark, sf).select(F.col("mesh_id").alias("object_id"), (F.col("vid") % 3).alias("part"), "vid", "x", "h", "z")
    moved, info = E.normalise_object(p, quads(spark, sf).select(F.col("mesh_id").alias("object_id")), 8.0)
    s = moved.groupBy("object_id").agg(F.round(F.sum(F.abs("x") + F.col("h") + F.abs("z")), 6).alias("checksum"))
    return info.join(s, "object_id")


CONTOUR = GQ.COV + """, pd AS (SELECT s_suppkey AS image_id, CAST(y.i AS INTEGER) AS cy, CAST(x.i AS INTEGER) AS cx FROM supplier CROSS JOIN range(-1, 64) AS y(i) CROSS JOIN range(-1, 64) AS x(i)),
c4 AS (SELECT p.*, coalesce(a.c, 0e0) AS v00, coalesce(b.c, 0e0) AS v01, coalesce(d.c, 0e0) AS v10, coalesce(e.c, 0e0) AS v11 FROM pd p LEFT JOIN cov a ON a.image_id=p.image_id AND a.y=p.cy AND a.x=p.cx LEFT JOIN cov b ON b.image_id=p.image_id AND b.y=p.cy AND b.x=p.cx+1
 LEFT JOIN cov d ON d.image_id=p.image_id AND d.y=p.cy+1 AND d.x=p.cx LEFT JOIN cov e ON e.image_id=p.image_id AND e.y=p.cy+1 AND e.x=p.cx+1),
k AS (SELECT *, (CASE WHEN v00 >= 5e-1 THEN 1 ELSE 0 END) + (CASE WHEN v01 >= 5e-1 THEN 2 ELSE 0 END) + (CASE WHEN v11 >= 5e-1 THEN 4 ELSE 0 END) + (CASE WHEN v10 >= 5e-1 THEN 8 ELSE 0 END) AS kase FROM c4),
tb(kase, p, q) AS (VALUES (1,'L','T'),(2,'T','R'),(3,'L','R'),(4,'R','B'),(5,'L','T'),(5,'R','B'),(6,'T','B'),(7,'L','B'),(8,'L','B'),(9,'T','B'),(10,'T','R'),(10,'L','B'),(11,'R','B'),(12,'L','R'),(13,'T','R'),(14,'L','T')),
xy AS (SELECT k.image_id, k.cy, k.cx, t.p, t.q, cx + (5e-1-v00)/nullif(v01-v00, 0) AS tx, cx + (5e-1-v10)/nullif(v11-v10, 0) AS bx, cy + (5e-1-v00)/nullif(v10-v00, 0) AS ly, cy + (5e-1-v01)/nullif(v11-v01, 0) AS ry FROM k JOIN tb t USING (kase)),
sg AS (SELECT image_id, cy, cx, CASE p WHEN 'T' THEN tx WHEN 'B' THEN bx WHEN 'L' THEN cx ELSE cx+1 END AS x0, CASE p WHEN 'T' THEN cy WHEN 'B' THEN cy+1 WHEN 'L' THEN ly ELSE ry END AS y0,
 CASE q WHEN 'T' THEN tx WHEN 'B' THEN bx WHEN 'L' THEN cx ELSE cx+1 END AS x1, CASE q WHEN 'T' THEN cy WHEN 'B' THEN cy+1 WHEN 'L' THEN ly ELSE ry END AS y1,
 ((cy + 1 + CASE WHEN p = 'B' THEN 1 ELSE 0 END)*2147483648 + cx + 1 + CASE WHEN p = 'R' THEN 1 ELSE 0 END)*2 + CASE WHEN p IN ('L', 'R') THEN 1 ELSE 0 END AS u,
 ((cy + 1 + CASE WHEN q = 'B' THEN 1 ELSE 0 END)*2147483648 + cx + 1 + CASE WHEN q = 'R' THEN 1 ELSE 0 END)*2 + CASE WHEN q IN ('L', 'R') THEN 1 ELSE 0 END AS v FROM xy)"""


@query("contour_segments", sql("mask_px", CONTOUR + "SELECT image_id, cy, cx, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1 FROM sg", recursive=True))
def contour_segments(spark, sf):
    return E.contour_segments(SQ.coverage(spark, sf).select("image_id", "y", "x", "coverage")).select("image_id", "cy", "cx", *R("x0", "y0", "x1", "y1"))


@query("contour_rings", sql("mask_px", CONTOUR + """, ed AS MATERIALIZED (SELECT image_id, u AS a, v AS b FROM sg UNION SELECT image_id, v, u FROM sg),
re AS (SELECT image_id, a AS src, a AS cur FROM ed UNION SELECT r.image_id, r.src, e.b FROM re r JOIN ed e ON e.image_id = r.image_id AND e.a = r.cur),
lb AS (SELECT image_id, src, min(cur) AS ring FROM re GROUP BY 1, 2),
sr AS MATERIALIZED (SELECT s.*, l.ring FROM sg s JOIN lb l ON l.image_id = s.image_id AND l.src = s.u),
rr AS (SELECT image_id, ring, count(*) AS pieces, round(sum(sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0))), 6) AS length, min({'y': y0, 'x': x0}) AS p FROM sr GROUP BY 1, 2)
SELECT r.image_id, CAST(r.ring AS BIGINT) AS ring, r.pieces, r.length, (SELECT count(*) FROM sr e WHERE e.image_id = r.image_id AND e.ring <> r.ring AND (e.y0 > r.p.y) <> (e.y1 > r.p.y)
 AND r.p.x < (e.x1-e.x0)*(r.p.y-e.y0)/(e.y1-e.y0) + e.x0) % 2 = 1 AS hole FROM rr r""", recursive=True))
def contour_rings(spark, sf):
    return E.contour_rings(materialize(E.contour_segments(SQ.coverage(spark, sf).select("image_id", "y", "x", "coverage")))).withColumn("length", F.round("length", 6))


@query("grid_cells", NQ.Q(NQ.S_CLEAN, ", bp AS (SELECT image_id, y, x FROM roadall WHERE NOT road)," + regions_sql("bl", "bp") + """, bz AS (SELECT b.* FROM bl b JOIN (SELECT image_id, label FROM bl GROUP BY 1, 2 HAVING count(*)*625e-4 >= 4) USING (image_id, label)),
gc AS (SELECT image_id, label, y // 8 AS gy, x // 8 AS gx, count(*) AS n FROM bz GROUP BY 1, 2, 3, 4), gv AS (SELECT DISTINCT image_id, gy + a.i AS vy, gx + b.i AS vx FROM gc CROSS JOIN range(2) AS a(i) CROSS JOIN range(2) AS b(i) WHERE n = 64)
SELECT g.image_id, count(*) FILTER (n = 64) AS quads, count(*) FILTER (n < 64) AS cut, any_value(coalesce(v.n2, 0)) AS vertices FROM gc g LEFT JOIN (SELECT image_id, count(*) AS n2 FROM gv GROUP BY 1) v USING (image_id) GROUP BY 1"""))
def grid_cells(spark, sf):
    c, v = E.grid_cells(Q.block_areas(NQ.road(spark, sf), 0.25), 8)
    n = v.groupBy("image_id").agg(F.count(F.lit(1)).alias("vertices"))
    return c.groupBy("image_id").agg(F.count_if("full").alias("quads"), F.count_if(~F.col("full")).alias("cut")).join(n, "image_id", "left").na.fill(0, ["vertices"])


@query("write_mesh_tables", sql("mesh_vertex mesh_quad", QUAD + " SELECT t.mesh_id, t.part, count(*) AS faces, count(DISTINCT t.owner) AS owners, (SELECT count(*) FROM mesh_vertex v WHERE v.mesh_id = t.mesh_id) AS vertices FROM tri t GROUP BY 1, 2"))
def write_mesh_tables(spark, sf):
    path = os.path.join(checkpoint_root(spark), "mesh-" + uuid.uuid4().hex)
    E.write_mesh_tables(verts(spark, sf), tris(spark, sf), path)
    v, f = E.read_mesh_tables(spark, path)
    n = v.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("vertices"))
    return f.groupBy("mesh_id", "part").agg(F.count(F.lit(1)).alias("faces"), F.count_distinct("owner").alias("owners")).join(n, "mesh_id")


# ------------------------------------------------------------------ object copies (one pixel is one metre here)
COPY = """pl AS (SELECT p.*, CASE WHEN o.turn % 2 = 1 THEN o.depth_m*o.scale ELSE o.width_m*o.scale END AS ow, CASE WHEN o.turn % 2 = 1 THEN o.width_m*o.scale ELSE o.depth_m*o.scale END AS od, o.turn FROM placements p JOIN objects o USING (object_id)),
pe AS (SELECT *, CAST(a.i AS INTEGER) AS i, CAST(b.j AS INTEGER) AS j FROM pl JOIN range(8) AS a(i) ON a.i < nx JOIN range(8) AS b(j) ON b.j < ny),
pu AS (SELECT *, -(nx*ow + (nx-1)*gap_x)/2 + ow/2 + i*(ow+gap_x) AS du, -(ny*od + (ny-1)*gap_y)/2 + od/2 + j*(od+gap_y) AS dv, radians(angle) AS t FROM pe),
cp AS (SELECT placement_id, object_id, image_id, i, j, angle, cx + cos(t)*du - sin(t)*dv AS mx, cy + sin(t)*du + cos(t)*dv AS my, ow AS width, od AS depth, sin(-(t + (turn % 4)*pi()/2)/2) AS qy, cos(-(t + (turn % 4)*pi()/2)/2) AS qw FROM pu)"""


def copies(spark, sf):
    return stage(spark, sf, "copies", lambda: E.expand_placements(X.placements(spark, sf), X.objects(spark, sf), 1.0))


@query("expand_placements", sql("placements objects", COPY + " SELECT placement_id, object_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(mx, 6) AS mx, round(my, 6) AS my, width, depth, round(qy, 6) AS qy, round(qw, 6) AS qw FROM cp"))
def expand_placements(spark, sf):
    return E.expand_placements(X.placements(spark, sf), X.objects(spark, sf), 1.0).select("placement_id", "object_id", "i", "j", *R("mx", "my"), "width", "depth", *R("qy", "qw"))


@query("filter_on_road", sql("placements objects mask_px", NQ.S_CLEAN + "," + COPY + """, fc AS (SELECT c.placement_id, c.i, c.j, c.image_id, CAST(y.i AS INTEGER) AS y, CAST(x.i AS INTEGER) AS x FROM cp c JOIN range(-16, 96) AS y(i) ON y.i BETWEEN floor(my - sqrt(width*width+depth*depth)/2) AND ceil(my + sqrt(width*width+depth*depth)/2) JOIN range(-16, 96) AS x(i) ON x.i BETWEEN floor(mx - sqrt(width*width+depth*depth)/2) AND ceil(mx + sqrt(width*width+depth*depth)/2)
 WHERE abs((x.i-mx)*cos(radians(angle)) + (y.i-my)*sin(radians(angle))) <= width/2 AND abs(-(x.i-mx)*sin(radians(angle)) + (y.i-my)*cos(radians(angle))) <= depth/2),
fs AS (SELECT f.placement_id, f.i, f.j, count(r.image_id)/CAST(count(*) AS DOUBLE) AS s FROM fc f LEFT JOIN road r ON r.image_id=f.image_id AND r.y=f.y AND r.x=f.x GROUP BY 1, 2, 3)
SELECT c.image_id, count(*) FILTER (coalesce(s, 0) > 2e-2) AS skipped, count(*) FILTER (coalesce(s, 0) <= 2e-2) AS placed FROM cp c LEFT JOIN fs USING (placement_id, i, j) GROUP BY 1""", recursive=True))
def filter_on_road(spark, sf):
    d = E.filter_on_road(copies(spark, sf), NQ.road(spark, sf), 1.0)
    return d.groupBy("image_id").agg(F.count_if("on_road").alias("skipped"), F.count_if(~F.col("on_road")).alias("placed"))


@query("probe_on_road", sql("placements objects mask_px", NQ.S_CLEAN + "," + COPY + """, pb AS (SELECT c.placement_id, c.i, c.j, c.image_id, floor(mx + cos(radians(angle))*width*s.a/2 - sin(radians(angle))*depth*s.b/2 + 5e-1) AS x, floor(my + sin(radians(angle))*width*s.a/2 + cos(radians(angle))*depth*s.b/2 + 5e-1) AS y FROM cp c CROSS JOIN (VALUES (-1,-1),(-1,1),(1,-1),(1,1),(0,0)) AS s(a, b)),
ph AS (SELECT DISTINCT p.placement_id, p.i, p.j FROM pb p JOIN road r ON r.image_id=p.image_id AND r.y=p.y AND r.x=p.x)
SELECT c.image_id, count(h.placement_id) AS skipped, count(*) - count(h.placement_id) AS placed FROM cp c LEFT JOIN ph h ON h.placement_id=c.placement_id AND h.i=c.i AND h.j=c.j GROUP BY 1""", recursive=True))
def probe_on_road(spark, sf):
    d = E.filter_on_road(copies(spark, sf), NQ.road(spark, sf), 1.0, "probe")
    return d.groupBy("image_id").agg(F.count_if("on_road").alias("skipped"), F.count_if(~F.col("on_road")).alias("placed"))


@query("snap_copies", sql("placements objects", "SELECT placement_id, greatest(1, CAST(floor((cx + gap_x)/(width_m + gap_x) + 5e-1) AS INTEGER)) AS nx, greatest(1, CAST(floor((cy + gap_y)/(depth_m + gap_y) + 5e-1) AS INTEGER)) AS ny FROM placements JOIN objects USING (object_id)"))
def snap_copies(spark, sf):
    d = X.placements(spark, sf).join(X.objects(spark, sf), "object_id")
    return d.select("placement_id", E.snap_copies(F.col("cx"), F.col("width_m"), F.col("gap_x")).alias("nx"), E.snap_copies(F.col("cy"), F.col("depth_m"), F.col("gap_y")).alias("ny"))


# ------------------------------------------------------------------ inspection
CHOICE = """us AS (SELECT * FROM idx WHERE patches >= 6), pk AS (SELECT part, arg_min(pair_id, rank) FILTER (cooldown = 0) AS f, arg_min(pair_id, rank) AS fst, count(*) AS n, count(*) FILTER (cooldown > 0) AS sit FROM us GROUP BY 1),
rj AS (SELECT p.part, EXISTS (SELECT 1 FROM review_log l WHERE l.part = p.part AND l.outcome = 'rejected' AND l.value > 100) AS pr FROM (VALUES ('open'), ('edge'), ('junction')) AS p(part)),
op AS (SELECT coalesce(k.f, CASE WHEN r.pr THEN k.fst END) AS f FROM rj r LEFT JOIN pk k USING (part) WHERE r.part = 'open'),
cq0 AS (SELECT r.part, r.pr, coalesce(u.pair_id, k.f, CASE WHEN r.pr THEN k.fst END) AS pair_id, u.pair_id IS NULL AND k.f IS NULL AND r.pr AS exhausted, coalesce(k.n, 0) AS n, coalesce(k.sit, 0) AS sit
 FROM rj r LEFT JOIN pk k USING (part) LEFT JOIN us u ON u.part = r.part AND u.cooldown = 0 AND u.pair_id = (SELECT f FROM op)),
choice AS (SELECT c.part, c.pr, 'material|junction=' || CASE WHEN c.part = 'junction' THEN 'y' ELSE 'n' END || '|part=' || c.part AS key, c.pair_id, 'material.' || c.part || coalesce('@' || CAST(c.pair_id AS VARCHAR), '.primed') AS route, c.exhausted,
 CAST(CASE WHEN c.pair_id IS NULL THEN c.n + 1 ELSE u.rank END AS BIGINT) AS rank, CASE WHEN c.pair_id IS NULL THEN 5e-1 ELSE u.confidence END AS confidence, CAST(CASE WHEN c.pair_id IS NULL THEN 0 ELSE u.patches END AS BIGINT) AS patches, u.size_px,
 c.n + 1 AS candidates, c.sit + CASE WHEN c.pr THEN 1 ELSE 0 END AS rejected FROM cq0 c LEFT JOIN us u ON u.part = c.part AND u.pair_id = c.pair_id)"""


def choices(spark, sf):
    def build():
        log = X.review_log(spark, sf)
        # reviews above this value stand for those of the primed library of the part
        key = M.situation_key(F.lit("material"), {"part": ("text", F.col("part")), "junction": ("bool", F.col("part") == "junction")})
        no = log.filter("outcome = 'rejected' and value > 100").select(key.alias("key"), F.concat(F.lit("material."), "part", F.lit(".primed")).alias("route"))
        return RT.part_choices(index_now(spark, sf), no)
    return stage(spark, sf, "choices", build)


def index_now(spark, sf):
    return stage(spark, sf, "index_now", lambda: M.replay_index(X.library_rows(spark, sf), X.review_log(spark, sf)))


@query("inspect_point", sql("mask_px photo_px placements library_rows review_log", SQ.S_CODE + "," + BOTH + "," + CHOICE + """,
ipt AS (SELECT p.placement_id, p.image_id, CAST(p.cy AS INTEGER) AS y, CAST(p.cx AS INTEGER) AS x FROM placements p),
hz AS (SELECT t.placement_id, t.image_id, t.y, t.x, c.junction_id, CASE c.code WHEN 1 THEN 'junction' WHEN 2 THEN 'edge' WHEN 3 THEN 'open' END AS part, d.dist FROM ipt t JOIN code c USING (image_id, y, x) LEFT JOIN dt d USING (image_id, y, x))
SELECT h.placement_id, h.part IS NOT NULL AS on_road, h.part, CASE WHEN h.part IS NOT NULL THEN round(coalesce(h.dist, 0e0)*25e-2, 2) END AS edge_m, CASE WHEN h.part='junction' AND j.type IS NOT NULL THEN h.junction_id END AS junction_id,
 CASE WHEN h.part='junction' THEN j.type END AS junction_type, c.key, c.pair_id, c.route, c.exhausted, c.rank, c.confidence, c.patches, c.size_px, c.candidates, c.rejected
 FROM hz h LEFT JOIN tj j ON j.image_id=h.image_id AND j.jid=h.junction_id LEFT JOIN choice c ON c.part=h.part""", recursive=True))
def inspect_point(spark, sf):
    pts = X.placements(spark, sf).select("placement_id", "image_id", F.col("cy").cast("int").alias("y"), F.col("cx").cast("int").alias("x"))
    return RT.inspect_point(pts, SQ.codes(spark, sf), NQ.dt(spark, sf), SQ.numbered(spark, sf), choices(spark, sf), 0.25)


@query("inspect_candidates", sql("library_rows review_log", BOTH + "," + CHOICE + """
SELECT u.part, 'material.' || u.part || '@' || CAST(u.pair_id AS VARCHAR) AS route, u.pair_id, CAST(u.rank AS BIGINT) AS rank, u.confidence, round(u.weight, 6) AS weight, CAST(u.patches AS BIGINT) AS patches, u.size_px, u.rejections, u.acceptances, u.cooldown > 0 AS rejected,
 c.pair_id IS NOT NULL AND c.pair_id = u.pair_id AS chosen FROM us u JOIN choice c USING (part)
UNION ALL SELECT part, 'material.' || part || '.primed', NULL, candidates, 5e-1, 0e0, 0, NULL, 0, 0, pr, pair_id IS NULL FROM choice"""))
def inspect_candidates(spark, sf):
    return RT.part_candidates(index_now(spark, sf), choices(spark, sf)).withColumn("weight", F.round("weight", 6))
