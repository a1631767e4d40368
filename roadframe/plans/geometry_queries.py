"""Street lines, widths, dashes and plane geometry over the derived streets, rings and lattices."""

from pyspark.sql import functions as F

from roadframe.functions.kernels import gaussian_weights
from roadframe.operators import geometry as Q, network as N
from roadframe.plans import network_queries as NQ, synth_queries as SQ
from roadframe.plans.registry import blur_sql, query, regions_sql, sql
from roadframe.plans.stages import stage
from roadframe.sources import fixtures as X

R = lambda *cs: [F.round(c, 6).alias(c) for c in cs]
NN = "nn AS (SELECT *, count(*) OVER (PARTITION BY street_id) AS n FROM polyline)"
ARC = "st AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0e0) AS st FROM polyline WINDOW w AS (PARTITION BY street_id ORDER BY seq)), arc AS (SELECT street_id, seq, x, y, hw, sum(st) OVER (PARTITION BY street_id ORDER BY seq) AS arc FROM st)"
SEG = ARC + ", sg AS (SELECT *, lead(arc) OVER w AS a1, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(hw) OVER w AS hw1, max(arc) OVER (PARTITION BY street_id) AS len FROM arc WINDOW w AS (PARTITION BY street_id ORDER BY seq)), sgm AS (SELECT * FROM sg WHERE a1 > arc)"


def lines(spark, sf):
    return stage(spark, sf, "polyline", lambda: X.polyline(spark, sf))


def arc(spark, sf):
    return stage(spark, sf, "arc", lambda: Q.arc_length(lines(spark, sf)))


def ring(spark, sf):
    return stage(spark, sf, "ring", lambda: X.ring(spark, sf))


@query("smooth_path", sql("polyline", NN + """ SELECT a.street_id, a.seq, round(CASE WHEN a.n < 7 OR a.seq < 3 OR a.seq >= a.n-3 THEN a.x ELSE avg(b.x) END, 6) AS x, round(CASE WHEN a.n < 7 OR a.seq < 3 OR a.seq >= a.n-3 THEN a.y ELSE avg(b.y) END, 6) AS y
 FROM nn a JOIN polyline b ON a.street_id=b.street_id AND b.seq BETWEEN a.seq-3 AND a.seq+3 GROUP BY a.street_id, a.seq, a.x, a.y, a.n"""))
def smooth_path(spark, sf):
    return Q.smooth_path(lines(spark, sf)).select("street_id", "seq", *R("x", "y"))


@query("arc_length", sql("polyline", ARC + " SELECT street_id, seq, round(arc, 6) AS arc FROM arc"))
def arc_length(spark, sf):
    return Q.arc_length(lines(spark, sf)).select("street_id", "seq", *R("arc"))


DASH = SEG + """, hwm AS (SELECT street_id, quantile_cont(hw, 5e-1) AS w, max(arc) AS len FROM arc GROUP BY 1),
dl AS (SELECT *, len - 2*5e0 AS usable, greatest(5e-1, w*2e-1) AS half FROM hwm), dn AS (SELECT *, greatest(1, CAST(round_even(usable/2e1, 0) AS INT)) AS n FROM dl WHERE usable > 12),
dash AS (SELECT d.street_id, CAST(i.i AS INT) AS dash, 5e0 + i.i*(usable/n) AS a, 5e0 + i.i*(usable/n) + (usable/n)*6e-1 AS b, half FROM dn d JOIN range(100000) AS i(i) ON i.i < d.n)"""


def dashes(spark, sf):
    return stage(spark, sf, "dashes", lambda: Q.place_dashes(arc(spark, sf), 20.0, 0.6, 5.0, 1.0, 0.2))


@query("place_dashes", sql("polyline", DASH + " SELECT street_id, dash, round(a, 6) AS a, round(b, 6) AS b, round(half, 6) AS half FROM dash"))
def place_dashes(spark, sf):
    return Q.place_dashes(arc(spark, sf), 20.0, 0.6, 5.0, 1.0, 0.2).select("street_id", "dash", *R("a", "b", "half"))


@query("interpolate_along", sql("polyline", SEG + """, ak AS (SELECT street_id, seq AS k, seq*37e-1 AS d FROM polyline)
SELECT a.street_id, a.k, round(s.x + (s.x1-s.x)*(least(a.d, s.len)-s.arc)/(s.a1-s.arc), 6) AS x, round(s.y + (s.y1-s.y)*(least(a.d, s.len)-s.arc)/(s.a1-s.arc), 6) AS y FROM ak a JOIN sgm s ON s.street_id=a.street_id AND least(a.d, s.len) >= s.arc AND (least(a.d, s.len) < s.a1 OR (s.a1 = s.len AND least(a.d, s.len) >= s.len))"""))
def interpolate_along(spark, sf):
    asks = lines(spark, sf).select("street_id", (F.col("seq") * 3.7).alias("d"), F.col("seq").alias("k"))
    return Q.interpolate_along(asks, arc(spark, sf), ["x", "y"]).select("street_id", "k", F.round("at_x", 6).alias("x"), F.round("at_y", 6).alias("y"))


STROKE = DASH + """, de AS (SELECT street_id, dash, half, a AS d FROM dash UNION ALL SELECT street_id, dash, half, b FROM dash),
dp AS (SELECT e.street_id, e.dash, e.half, e.d AS arc, s.x + (s.x1-s.x)*(e.d-s.arc)/(s.a1-s.arc) AS x, s.y + (s.y1-s.y)*(e.d-s.arc)/(s.a1-s.arc) AS y FROM de e JOIN sgm s ON s.street_id=e.street_id AND e.d >= s.arc AND e.d < s.a1
 UNION ALL SELECT d.street_id, d.dash, d.half, p.arc, p.x, p.y FROM dash d JOIN arc p ON p.street_id=d.street_id AND p.arc > d.a + 1e-9 AND p.arc < d.b - 1e-9),
dq AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM dp WINDOW w AS (PARTITION BY street_id, dash ORDER BY arc)), dr AS (SELECT * FROM dq WHERE x1 IS NOT NULL),
dx AS (SELECT r.*, CAST(iy.i AS INT) AS py, CAST(ix.i AS INT) AS px FROM dr r JOIN range(0, 4096) AS iy(i) ON iy.i BETWEEN greatest(0, floor(least(y,y1)-half-2)) AND greatest(0, ceil(greatest(y,y1)+half+2)) JOIN range(0, 4096) AS ix(i) ON ix.i BETWEEN greatest(0, floor(least(x,x1)-half-2)) AND greatest(0, ceil(greatest(x,x1)+half+2))),
dt1 AS (SELECT *, (x1-x)*(x1-x)+(y1-y)*(y1-y) AS l2 FROM dx), dt2 AS (SELECT *, CASE WHEN l2 < 1e-12 THEN 0e0 ELSE least(1e0, greatest(0e0, ((px-x)*(x1-x)+(py-y)*(y1-y))/l2)) END AS t FROM dt1),
dc AS (SELECT *, least(1e0, greatest(0e0, half + 5e-1 - sqrt(pow(px-(x+t*(x1-x)), 2)+pow(py-(y+t*(y1-y)), 2)))) AS c FROM dt2)"""


@query("stroke_coverage", sql("polyline", STROKE + " SELECT street_id, py AS y, px AS x, round(max(c), 6) AS coverage FROM dc WHERE c > 1e-9 GROUP BY 1, 2, 3"))
def stroke_coverage(spark, sf):
    d = Q.stroke_coverage(Q.dash_lines(dashes(spark, sf), arc(spark, sf)))
    return d.filter("coverage > 1e-9").select("street_id", "y", "x", *R("coverage"))


@query("smooth_line", sql("polyline", NN + """, ww AS (SELECT *, least(9, CASE WHEN (n-1) % 2 = 1 THEN n-1 ELSE n-2 END) AS w0 FROM nn), wv AS (SELECT *, CASE WHEN w0 % 2 = 0 THEN w0-1 ELSE w0 END AS w FROM ww), k AS (SELECT unnest(range(-4, 5)) AS k)
SELECT a.street_id, a.seq, round(CASE WHEN any_value(a.n) < 5 OR any_value(a.w) < 3 OR a.seq = 0 OR a.seq = any_value(a.n)-1 THEN any_value(a.x) ELSE avg(b.x) END, 6) AS x, round(CASE WHEN any_value(a.n) < 5 OR any_value(a.w) < 3 OR a.seq = 0 OR a.seq = any_value(a.n)-1 THEN any_value(a.y) ELSE avg(b.y) END, 6) AS y
 FROM wv a JOIN k ON abs(k.k) <= a.w // 2 JOIN polyline b ON b.street_id=a.street_id AND b.seq = least(greatest(a.seq+k.k, 0), a.n-1) GROUP BY 1, 2"""))
def smooth_line(spark, sf):
    return Q.smooth_line(lines(spark, sf), 9).select("street_id", "seq", *R("x", "y"))


@query("resample_line", sql("polyline", SEG + """, nl AS (SELECT street_id, max(arc) AS len, greatest(1, CAST(ceil(max(arc)/6) AS INT)) AS n FROM arc GROUP BY 1), ak AS (SELECT l.street_id, CAST(i.i AS INT) AS seq, l.len*i.i/l.n AS d FROM nl l JOIN range(100000) AS i(i) ON i.i <= l.n)
SELECT a.street_id, a.seq, round(a.d, 6) AS arc, round(s.x + (s.x1-s.x)*(a.d-s.arc)/(s.a1-s.arc), 6) AS x, round(s.y + (s.y1-s.y)*(a.d-s.arc)/(s.a1-s.arc), 6) AS y FROM ak a JOIN sgm s ON s.street_id=a.street_id AND a.d >= s.arc AND (a.d < s.a1 OR (s.a1 = s.len AND a.d >= s.len))"""))
def resample_line(spark, sf):
    return Q.resample_line(lines(spark, sf), 6.0).select("street_id", "seq", *R("arc", "x", "y"))


CLOSED = "cl AS (SELECT ring_id, seq, x, y FROM ring UNION ALL SELECT ring_id, 16, x, y FROM ring WHERE seq = 0), ce AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM cl WINDOW w AS (PARTITION BY ring_id ORDER BY seq)), eg AS (SELECT ring_id, seq, x AS x0, y AS y0, x1, y1, sqrt(pow(x1-x,2)+pow(y1-y,2)) AS l FROM ce WHERE x1 IS NOT NULL), ea AS (SELECT *, sum(l) OVER (PARTITION BY ring_id ORDER BY seq) - l AS a0, sum(l) OVER (PARTITION BY ring_id ORDER BY seq) AS a1, sum(l) OVER (PARTITION BY ring_id) AS len FROM eg)"


@query("resample_ring", sql("ring", CLOSED + """, nl AS (SELECT DISTINCT ring_id, len, greatest(8, CAST(floor(len/3) AS INT)) AS n FROM ea), ak AS (SELECT ring_id, CAST(i.i AS INT) AS seq, len*i.i/n AS d FROM nl JOIN range(100000) AS i(i) ON i.i < n)
SELECT a.ring_id, a.seq, round(e.x0 + (e.x1-e.x0)*(a.d-e.a0)/e.l, 6) AS x, round(e.y0 + (e.y1-e.y0)*(a.d-e.a0)/e.l, 6) AS y FROM ak a JOIN ea e ON e.ring_id=a.ring_id AND e.l > 0 AND a.d >= e.a0 AND a.d < e.a1"""))
def resample_ring(spark, sf):
    return Q.resample_ring(ring(spark, sf), 3.0).select("ring_id", "seq", *R("x", "y"))


TAN = ARC + """, gd AS (SELECT *, CASE WHEN lag(x) OVER w IS NULL THEN lead(x) OVER w - x WHEN lead(x) OVER w IS NULL THEN x - lag(x) OVER w ELSE (lead(x) OVER w - lag(x) OVER w)/2 END AS gx, CASE WHEN lag(y) OVER w IS NULL THEN lead(y) OVER w - y WHEN lead(y) OVER w IS NULL THEN y - lag(y) OVER w ELSE (lead(y) OVER w - lag(y) OVER w)/2 END AS gy FROM arc WINDOW w AS (PARTITION BY street_id ORDER BY seq)),
tg AS (SELECT street_id, seq, x, y, hw, arc, gx/sqrt(gx*gx+gy*gy) AS tx, gy/sqrt(gx*gx+gy*gy) AS ty FROM gd)"""


def tang(spark, sf):
    return stage(spark, sf, "tang", lambda: Q.tangents(arc(spark, sf)))


def rows(spark, sf):
    return tang(spark, sf).withColumn("sx", -F.col("ty")).withColumn("sy", F.col("tx"))


@query("tangents", sql("polyline", TAN + " SELECT street_id, seq, round(tx, 6) AS tx, round(ty, 6) AS ty FROM tg"))
def tangents(spark, sf):
    return Q.tangents(lines(spark, sf)).select("street_id", "seq", *R("tx", "ty"))


# ------------------------------------------------------------------ rays on the coverage map
COV = SQ.S_SDF + ", cov AS (SELECT image_id, y, x, least(1e0, greatest(0e0, v + 5e-1)) AS c FROM sd)"


def bil(px, py):
    return f"""(SELECT CASE WHEN {px} < 0 OR {py} < 0 OR {px} > 63 OR {py} > 63 THEN 0e0 ELSE coalesce(sum(c.c*(1-abs({px}-c.x))*(1-abs({py}-c.y))), 0e0) END FROM cov c WHERE c.image_id = s.image_id AND c.y IN (floor({py}), floor({py})+1) AND c.x IN (floor({px}), floor({px})+1) AND abs({px}-c.x) < 1 AND abs({py}-c.y) < 1)"""


@query("sample_bilinear", sql("mask_px candidates", COV + """, s AS (SELECT cand_id, image_id + 1 AS image_id, x*63/1e3 AS px, y*63/1e3 AS py FROM candidates),
cl AS (SELECT s.*, floor(py)+a.i AS cy, floor(px)+b.i AS cx, (1-abs(py-floor(py)-a.i))*(1-abs(px-floor(px)-b.i)) AS wt FROM s CROSS JOIN range(2) AS a(i) CROSS JOIN range(2) AS b(i))
SELECT l.image_id, l.cand_id, round(sum(coalesce(c.c, 0e0)*wt), 6) AS sample FROM cl l LEFT JOIN cov c ON c.image_id=l.image_id AND c.y=l.cy AND c.x=l.cx GROUP BY 1, 2 HAVING l.image_id <= (SELECT max(s_suppkey) FROM supplier)""", recursive=True))
def sample_bilinear(spark, sf):
    p = X.candidates(spark, sf).select((F.col("image_id") + 1).alias("image_id"), "cand_id", (F.col("x") * 63 / 1000.0).alias("px"), (F.col("y") * 63 / 1000.0).alias("py"))
    return Q.sample_bilinear(p, SQ.coverage(spark, sf), NQ.dims(spark, sf), "coverage").select("image_id", "cand_id", *R("sample"))


def kerb_rays(spark, sf):
    p = NQ.sk(spark, sf).join(NQ.dt(spark, sf).select("image_id", "y", "x", "dist"), ["image_id", "y", "x"])
    p = p.withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1))))
    return p.select("image_id", ((F.col("y") * 64 + F.col("x")) * 2 + F.when(F.col("side") > 0, 0).otherwise(1)).alias("ray_id"), F.col("x").cast("double").alias("ox"),
                    F.col("y").cast("double").alias("oy"), F.lit(0.0).alias("nx"), F.col("side").cast("double").alias("ny"), (F.col("dist") * 2 + 2).alias("maxd"))


RAY = COV[:0] + NQ.S_SK + SQ.S_SDF[len(NQ.S_CLEAN):] + """, cov AS (SELECT image_id, y, x, least(1e0, greatest(0e0, v + 5e-1)) AS c FROM sd),
ry AS (SELECT s.image_id, (s.y*64+s.x)*2 + CASE WHEN d.sd > 0 THEN 0 ELSE 1 END AS ray_id, s.x, s.y, d.sd, t.dist, 2*t.dist + 2 AS maxd FROM sk s JOIN dt t USING (image_id, y, x) CROSS JOIN (VALUES (1), (-1)) AS d(sd)),
rs AS (SELECT r.*, i.i, r.y + r.sd*i.i*25e-2 AS py FROM ry r JOIN range(400) AS i(i) ON i.i <= greatest(0, CAST(ceil(r.maxd/25e-2) AS INT) - 1)),
rv AS (SELECT s.image_id, s.ray_id, s.i, CASE WHEN s.py < 0 OR s.py > 63 THEN 0e0 ELSE coalesce(a.c, 0e0)*(1-(s.py-floor(s.py))) + coalesce(b.c, 0e0)*(s.py-floor(s.py)) END AS v FROM rs s LEFT JOIN cov a ON a.image_id=s.image_id AND a.x=s.x AND a.y=CAST(floor(s.py) AS INT) LEFT JOIN cov b ON b.image_id=s.image_id AND b.x=s.x AND b.y=CAST(floor(s.py) AS INT)+1),
rf AS (SELECT image_id, ray_id, greatest(1, coalesce(min(i) FILTER (v < 5e-1), max(i))) AS i1 FROM rv GROUP BY 1, 2),
kd AS (SELECT f.image_id, f.ray_id, (f.i1 - 1 + least(1e0, greatest(0e0, (a.v - 5e-1)/greatest(a.v - b.v, 1e-6))))*25e-2 AS dist FROM rf f JOIN rv a ON a.image_id=f.image_id AND a.ray_id=f.ray_id AND a.i=f.i1-1 JOIN rv b ON b.image_id=f.image_id AND b.ray_id=f.ray_id AND b.i=f.i1)"""


def kerbs(spark, sf):
    return stage(spark, sf, "kerbs", lambda: Q.kerb_distance(kerb_rays(spark, sf), SQ.coverage(spark, sf), NQ.dims(spark, sf)))


@query("kerb_distance", sql("mask_px", RAY + " SELECT image_id, CAST(ray_id AS INTEGER) AS ray_id, round(dist, 6) AS dist FROM kd", recursive=True))
def kerb_distance(spark, sf):
    return kerbs(spark, sf).select("image_id", "ray_id", *R("dist"))


@query("centre_and_width", sql("mask_px", RAY + """, pr AS (SELECT r.image_id, r.y, r.x, r.dist AS guess, p.dist AS dp, m.dist AS dm FROM ry r JOIN kd p ON p.image_id=r.image_id AND p.ray_id=r.ray_id JOIN kd m ON m.image_id=r.image_id AND m.ray_id=r.ray_id+1 WHERE r.sd > 0)
SELECT image_id, y, x, round(y + CASE WHEN dp < 22e-1*guess+1 AND dm < 22e-1*guess+1 THEN (dp-dm)/2 ELSE 0 END, 6) AS cy, round(CASE WHEN dp < 22e-1*guess+1 AND dm < 22e-1*guess+1 THEN (dp+dm)/2 ELSE guess END, 6) AS hw FROM pr""", recursive=True))
def centre_and_width(spark, sf):
    k = kerbs(spark, sf)
    base = F.floor(F.col("ray_id") / 2).cast("int")
    d = k.groupBy("image_id", base.alias("p")).agg(F.max(F.when(F.col("ray_id") % 2 == 0, F.col("dist"))).alias("d_plus"), F.max(F.when(F.col("ray_id") % 2 == 1, F.col("dist"))).alias("d_minus"))
    d = d.select("image_id", F.floor(F.col("p") / 64).cast("int").alias("y"), (F.col("p") % 64).alias("x"), "d_plus", "d_minus")
    d = d.join(NQ.dt(spark, sf).select("image_id", "y", "x", F.col("dist").alias("guess")), ["image_id", "y", "x"]).withColumn("sx", F.lit(0.0)).withColumn("sy", F.lit(1.0))
    return Q.centre_and_width(d).select("image_id", "y", "x", *R("cy", "hw"))


@query("free_space", sql("mask_px", RAY.replace("2*t.dist + 2 AS maxd", "2e1 AS maxd").replace("i.i*25e-2 AS py", "(75e-2 + i.i*25e-2) AS py").replace("ceil(r.maxd/25e-2)", "ceil((r.maxd-75e-2)/25e-2)") + """,
ex AS (SELECT image_id, ray_id, coalesce(min(i) FILTER (v < 5e-1), 1000) AS e FROM rv GROUP BY 1, 2)
SELECT r.image_id, CAST(r.ray_id AS INTEGER) AS ray_id, coalesce(round(75e-2 + 25e-2*min(r.i) FILTER (r.v >= 5e-1 AND r.i > x.e), 6), -1e0) AS free FROM rv r JOIN ex x USING (image_id, ray_id) GROUP BY 1, 2""", recursive=True))
def free_space(spark, sf):
    rays = kerb_rays(spark, sf).withColumn("maxd", F.lit(20.0))
    d = Q.free_space(rays, SQ.coverage(spark, sf), NQ.dims(spark, sf))
    return d.select("image_id", "ray_id", F.when(F.col("free") == float("inf"), -1.0).otherwise(F.round("free", 6)).alias("free"))


_W2 = ",".join(f"({i - len(gaussian_weights(2.0)) // 2},CAST({v!r} AS DOUBLE))" for i, v in enumerate(gaussian_weights(2.0)))
_W1 = ",".join(f"({i - len(gaussian_weights(1.0)) // 2},CAST({v!r} AS DOUBLE))" for i, v in enumerate(gaussian_weights(1.0)))


@query("robust_width", sql("polyline", NN + f""", ic AS (SELECT street_id, quantile_cont(hw, 5e-1) AS c FROM nn WHERE seq >= floor(n*15e-2) AND seq < greatest(floor(n*85e-2), floor(n*15e-2)+1) GROUP BY 1), k5 AS (SELECT unnest(range(-2, 3)) AS k),
m5 AS (SELECT a.street_id, a.seq, any_value(a.n) AS n, any_value(a.hw) AS hw, quantile_cont(b.hw, 5e-1) AS med FROM nn a JOIN k5 ON abs(k) <= CASE WHEN a.n >= 5 THEN 2 WHEN a.n >= 3 THEN 1 ELSE 0 END JOIN polyline b ON b.street_id=a.street_id AND b.seq = CASE WHEN a.seq+k < 0 THEN -1-(a.seq+k) WHEN a.seq+k >= a.n THEN 2*a.n-1-(a.seq+k) ELSE a.seq+k END GROUP BY 1, 2),
g(k, w) AS (VALUES {_W2}), sm AS (SELECT a.street_id, a.seq, any_value(a.hw) AS hw, CASE WHEN any_value(a.n) >= 3 THEN sum(b.med*g.w) ELSE any_value(a.med) END AS s FROM m5 a CROSS JOIN g JOIN m5 b ON b.street_id=a.street_id AND b.seq = least(greatest(a.seq+g.k, 0), a.n-1) GROUP BY 1, 2)
SELECT s.street_id, s.seq, s.hw, round(least(s.s, 125e-2*c.c) + (c.c - least(s.s, 125e-2*c.c))*4e-1, 6) AS width FROM sm s JOIN ic c USING (street_id)"""))
def robust_width(spark, sf):
    return Q.robust_width(lines(spark, sf), 0.4).select("street_id", "seq", "hw", *R("width"))


CROSS = TAN + """, cr AS (SELECT street_id, seq, x, y, -ty AS sx, tx AS sy, arc, hw, least(6e0, hw*5e-1) AS kb FROM tg), cv AS (SELECT *, unnest([0,1,2,3,4]) AS col, unnest([hw, hw-kb, 0e0, -(hw-kb), -hw]) AS off FROM cr)"""


@query("cross_rows", sql("polyline", CROSS + " SELECT street_id, seq, col, round(x+sx*off, 6) AS vx, round(y+sy*off, 6) AS vy, round(arc*25e-2, 6) AS along, round(-off*25e-2, 6) AS across, CASE WHEN col IN (0,4) THEN 'kerb' ELSE 'open' END AS role FROM cv"))
def cross_rows(spark, sf):
    return Q.cross_rows(rows(spark, sf), 0.25).select("street_id", "seq", "col", *R("vx", "vy", "along", "across"), "role")


@query("row_faces", sql("polyline", """n AS (SELECT street_id, seq, lead(seq) OVER (PARTITION BY street_id ORDER BY seq) AS next_seq FROM polyline)
SELECT street_id, seq, next_seq, CAST(c.c AS INTEGER) AS col, CASE WHEN c.c IN (0,3) THEN 'edge' ELSE 'open' END AS part FROM n CROSS JOIN range(4) AS c(c) WHERE next_seq IS NOT NULL"""))
def row_faces(spark, sf):
    return Q.row_faces(lines(spark, sf))


KEEP = TAN + """, ky AS (SELECT street_id, n, usable/n AS step FROM (SELECT *, greatest(1, CAST(round_even(usable/9, 0) AS INT)) AS n FROM (SELECT street_id, max(arc)*25e-2 - 4 AS usable FROM tg GROUP BY 1) WHERE usable >= 54e-1) WHERE n >= 2),
ke AS (SELECT street_id, min(seq) FILTER (arc*25e-2 >= 2 - (1 - 6e-1)*step + 5e-2) AS i0, max(seq) FILTER (arc*25e-2 <= 2 + n*step - 5e-2) AS i1 FROM tg JOIN ky USING (street_id) GROUP BY 1),
kb AS (SELECT DISTINCT p.street_id FROM polyline p JOIN bridges b ON b.image_id = p.street_id WHERE sqrt(pow(p.x-b.cx, 2) + pow(p.y-b.cy, 2)) < b.length/2 + 150/25e-2),
rk AS (SELECT t.*, max(seq) OVER (PARTITION BY t.street_id) AS n, i0, i1, CASE WHEN kb.street_id IS NULL THEN 20 ELSE 4 END AS gap FROM tg t LEFT JOIN ke USING (street_id) LEFT JOIN kb USING (street_id)),
wk(street_id, last, prev, flag) AS (SELECT DISTINCT street_id, 0, -1, false FROM rk UNION ALL SELECT street_id, nx, last, turned FROM (
 SELECT w.street_id, w.last, min(b.seq) AS nx, arg_min(degrees(acos(least(1e0, greatest(-1e0, a.tx*b.tx+a.ty*b.ty)))) >= 40 OR abs(b.hw-a.hw) > 5e-1*greatest(a.hw, 1e-6), b.seq) AS turned FROM wk w JOIN rk a ON a.street_id=w.street_id AND a.seq=w.last JOIN rk b ON b.street_id=w.street_id AND b.seq > w.last
 AND (b.seq = b.n OR b.seq = b.i0 OR b.seq = b.i1 OR degrees(acos(least(1e0, greatest(-1e0, a.tx*b.tx+a.ty*b.ty)))) >= 40 OR abs(b.hw-a.hw) > 5e-1*greatest(a.hw, 1e-6) OR (b.arc-a.arc)*25e-2 >= b.gap) GROUP BY 1, 2) q)
SELECT street_id, CAST(last AS BIGINT) AS seq FROM wk UNION SELECT street_id, CAST(last - 1 AS BIGINT) FROM wk WHERE flag AND last - 1 > prev"""


@query("row_keep", sql("polyline bridges", KEEP, recursive=True))
def row_keep(spark, sf):
    """Streets with the dashes of street_dashes; a bridge is over the street of its image's number."""
    d = tang(spark, sf).select("street_id", "seq", "x", "y", "tx", "ty", "hw", (F.col("arc") * 0.25).alias("arc"))
    layout = Q.dash_layout(d, 9.0, 0.6, 2.0, 0.15, None, False, 2).withColumn("setback", F.lit(2.0)).withColumn("share", F.lit(0.6))
    near = Q.near_bridges(d, X.bridges(spark, sf).withColumnRenamed("image_id", "street_id"), 0.25, on=("street_id",))
    return Q.row_keep(d, 20.0, 40.0, 0.5, layout, near=near)


@query("adaptive_keep", sql("ring", """p AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, coalesce(lead(x) OVER w, first_value(x) OVER w) AS qx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS qy FROM ring WINDOW w AS (PARTITION BY ring_id ORDER BY seq)),
l AS (SELECT *, sqrt(pow(x-px,2)+pow(y-py,2)) AS la, sqrt(pow(qx-x,2)+pow(qy-y,2)) AS lb FROM p), h AS (SELECT ring_id, seq, coalesce(la, 0) AS la, CASE WHEN la > 1e-9 AND lb > 1e-9 THEN degrees(acos(least(1e0, greatest(-1e0, ((x-px)*(qx-x)+(y-py)*(qy-y))/(la*lb))))) ELSE 0e0 END AS here FROM l),
t AS (SELECT ring_id, seq, here, sum(la) OVER w AS run, sum(here) OVER w AS turn FROM h WINDOW w AS (PARTITION BY ring_id ORDER BY seq)),
wk(ring_id, last) AS (SELECT DISTINCT ring_id, 0 FROM t UNION ALL SELECT ring_id, nx FROM (SELECT w.ring_id, w.last, min(b.seq) AS nx FROM wk w JOIN t a ON a.ring_id=w.ring_id AND a.seq=w.last JOIN t b ON b.ring_id=w.ring_id AND b.seq > w.last AND (b.here >= 60 OR b.run-a.run >= 12 - 1e-9 OR (b.turn-a.turn >= 40 AND b.run-a.run >= 6 - 1e-9)) GROUP BY 1, 2) q)
SELECT ring_id, CAST(last AS BIGINT) AS seq FROM wk""", recursive=True))
def adaptive_keep(spark, sf):
    return Q.adaptive_keep(ring(spark, sf), 6.0, 12.0, 40.0, corner_deg=60.0)


@query("street_dashes", sql("polyline", TAN + """, mr AS (SELECT street_id, seq, x, y, -ty AS sx, tx AS sy, hw, arc*25e-2 AS arc FROM tg), ml AS (SELECT street_id, max(arc) AS len FROM mr GROUP BY 1), mn AS (SELECT street_id, greatest(1, CAST(round_even((len-4)/9, 0) AS INT)) AS n, len-4 AS usable FROM ml WHERE len-4 >= 54e-1),
my AS (SELECT street_id, n, usable/n AS step FROM mn WHERE n >= 2), me AS (SELECT street_id, CAST(i.i AS INT) AS dash, 2 + (i.i + e.e)*step AS d FROM my JOIN range(100000) AS i(i) ON i.i < n CROSS JOIN (VALUES (0e0), (6e-1)) AS e(e)),
ms AS (SELECT *, lead(arc) OVER w AS a1, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(sx) OVER w AS sx1, lead(sy) OVER w AS sy1 FROM mr WINDOW w AS (PARTITION BY street_id ORDER BY seq)),
mi AS (SELECT e.street_id, e.dash, e.d AS arc, s.x+(s.x1-s.x)*(e.d-s.arc)/(a1-s.arc) AS x, s.y+(s.y1-s.y)*(e.d-s.arc)/(a1-s.arc) AS y, s.sx+(s.sx1-s.sx)*(e.d-s.arc)/(a1-s.arc) AS sx, s.sy+(s.sy1-s.sy)*(e.d-s.arc)/(a1-s.arc) AS sy FROM me e JOIN ms s ON s.street_id=e.street_id AND s.a1 > s.arc AND e.d >= s.arc AND e.d < s.a1
 UNION ALL SELECT r.street_id, CAST(i.i AS INT), r.arc, r.x, r.y, r.sx, r.sy FROM mr r JOIN my USING (street_id) JOIN range(100000) AS i(i) ON i.i < n AND r.arc > 2 + i.i*step + 1e-9 AND r.arc < 2 + i.i*step + step*6e-1 - 1e-9)
SELECT street_id, dash, round(arc, 6) AS arc, round(x + sx/sqrt(sx*sx+sy*sy)*3e-1, 6) AS lx, round(y + sy/sqrt(sx*sx+sy*sy)*3e-1, 6) AS ly, round(x - sx/sqrt(sx*sx+sy*sy)*3e-1, 6) AS rx, round(y - sy/sqrt(sx*sx+sy*sy)*3e-1, 6) AS ry FROM mi"""))
def street_dashes(spark, sf):
    return Q.street_dashes(rows(spark, sf), 0.25, min_cycles=2).select("street_id", "dash", *R("arc", "lx", "ly", "rx", "ry"))


# ------------------------------------------------------------------ junction mouths, rectangles, clusters
def lattice(spark, sf):
    return stage(spark, sf, "lattice", lambda: X.lattice_street(spark, sf))


def lattice_nodes(spark, sf):
    l = lattice(spark, sf)
    e = l.select("image_id", F.col("node0").alias("root"), F.col("x0").alias("x"), F.col("y0").alias("y")).unionByName(
        l.select("image_id", F.col("node1").alias("root"), F.col("x1").alias("x"), F.col("y1").alias("y")))
    return e.groupBy("image_id", F.col("root").cast("bigint").alias("root")).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy")).withColumn("r", F.lit(6.0) + F.col("root") % 5)


NODE = """en AS (SELECT image_id, street_id, 0 AS which, x0 AS x, y0 AS y, node0 AS node FROM lattice_street UNION ALL SELECT image_id, street_id, 1, x1, y1, node1 FROM lattice_street),
nd AS (SELECT image_id, CAST(node AS BIGINT) AS root, avg(x) AS cx, avg(y) AS cy, 6e0 + CAST(node AS BIGINT) % 5 AS r FROM en GROUP BY 1, 2),
mo AS (SELECT e.image_id, n.root, e.street_id, e.which, e.x, e.y, n.cx, n.cy FROM en e JOIN nd n ON n.image_id=e.image_id AND (e.x-n.cx)*(e.x-n.cx)+(e.y-n.cy)*(e.y-n.cy) <= (n.r+4)*(n.r+4))"""


def mouths(spark, sf):
    return Q.street_mouths(lattice(spark, sf), lattice_nodes(spark, sf))[0]


@query("street_mouths", sql("lattice_street", NODE + " SELECT n.image_id, n.root, count(m.street_id) AS mouths, count(m.street_id) < 2 AS fallback FROM nd n LEFT JOIN mo m ON m.image_id=n.image_id AND m.root=n.root GROUP BY 1, 2"))
def street_mouths(spark, sf):
    return Q.street_mouths(lattice(spark, sf), lattice_nodes(spark, sf))[1]


@query("sidewalk_width", sql("polyline", NN + f""", fr AS (SELECT *, least(least(greatest(hw*2*25e-2*25e-2, 15e-1), 25e-1)/25e-2, (2 + abs(y)/4)/2) AS w0, 2 + abs(y)/4 AS free FROM nn), g(k, w) AS (VALUES {_W1}),
sm AS (SELECT a.street_id, a.seq, any_value(a.n) AS n, any_value(a.w0) AS w0, any_value(a.free) AS free, sum(b.w0*g.w) AS s FROM fr a CROSS JOIN g JOIN fr b ON b.street_id=a.street_id AND b.seq = least(greatest(a.seq+g.k, 0), a.n-1) GROUP BY 1, 2), z AS (SELECT street_id, seq, CASE WHEN n >= 3 THEN least(s, free/2) ELSE w0 END AS width FROM sm)
SELECT street_id, seq, round(width, 6) AS width, width > 12e-1 AS ok FROM z"""))
def sidewalk_width(spark, sf):
    d = lines(spark, sf).withColumn("free", F.abs("y") / 4 + 2)
    return Q.sidewalk_width(d, 0.25).select("street_id", "seq", *R("width"), "ok")


@query("drop_short_runs", sql("polyline", """r AS (SELECT street_id, seq, y < 4 AS ok, x AS along FROM polyline), s AS (SELECT *, CASE WHEN lag(ok) OVER w IS DISTINCT FROM ok THEN 1 ELSE 0 END AS s FROM r WINDOW w AS (PARTITION BY street_id ORDER BY seq)),
g AS (SELECT *, sum(s) OVER (PARTITION BY street_id ORDER BY seq) AS g FROM s) SELECT street_id, seq, ok AND max(along) OVER (PARTITION BY street_id, g) - min(along) OVER (PARTITION BY street_id, g) >= 8 AS ok, along FROM g"""))
def drop_short_runs(spark, sf):
    return Q.drop_short_runs(lines(spark, sf).select("street_id", "seq", (F.col("y") < 4).alias("ok"), F.col("x").alias("along")), 8.0)


@query("runs_circular", sql("ring", """r AS (SELECT ring_id, seq, x < 34 AS ok FROM ring), d AS (SELECT ring_id, seq, ok, row_number() OVER (PARTITION BY ring_id ORDER BY seq) - row_number() OVER (PARTITION BY ring_id, ok ORDER BY seq) AS g FROM r),
n AS (SELECT ring_id, min(seq) AS s, max(seq) AS e FROM d WHERE ok GROUP BY ring_id, g), z AS (SELECT ring_id, CASE WHEN s = 0 AND count(*) OVER (PARTITION BY ring_id) > 1 THEN coalesce(max(CASE WHEN e = 15 THEN s END) OVER (PARTITION BY ring_id), s) ELSE s END AS start, e - s + 1 AS len FROM n)
SELECT ring_id, start, CAST(sum(len) AS BIGINT) AS len FROM z GROUP BY 1, 2"""))
def runs_circular(spark, sf):
    return Q.runs_circular(ring(spark, sf).select("ring_id", "seq", (F.col("x") < 34).alias("ok")))


_RECT = lambda x, y: f"abs(({x}-b.cx)*cos(radians(b.angle)) + ({y}-b.cy)*sin(radians(b.angle))) <= b.length/2 AND abs(-({x}-b.cx)*sin(radians(b.angle)) + ({y}-b.cy)*cos(radians(b.angle))) <= b.width/2"


@query("in_rotated_rect", sql("mask_px bridges", f"SELECT m.image_id, count(*) FILTER (v > 128) AS road_px, count(*) AS pixels FROM mask_px m JOIN bridges b USING (image_id) WHERE {_RECT('m.x', 'm.y')} GROUP BY 1"))
def in_rotated_rect(spark, sf):
    d = Q.in_rects(NQ.mask(spark, sf), X.bridges(spark, sf))
    return d.groupBy("image_id").agg(F.count_if(F.col("v") > 128).alias("road_px"), F.count(F.lit(1)).alias("pixels"))


def wide_mouths(spark, sf):
    """Mouths of the lattice taken at the far end of each street, so that directions are well defined."""
    l, n = lattice(spark, sf), lattice_nodes(spark, sf).select("image_id", "root", "cx", "cy")
    e = l.select("image_id", "street_id", F.explode(F.array(
        F.struct(F.lit(0).alias("which"), F.col("node0").cast("bigint").alias("root"), F.col("x1").alias("x"), F.col("y1").alias("y")),
        F.struct(F.lit(1).alias("which"), F.col("node1").cast("bigint").alias("root"), F.col("x0").alias("x"), F.col("y0").alias("y")))).alias("e")).select("image_id", "street_id", "e.*")
    return e.join(n, ["image_id", "root"])


@query("crossing_pair", sql("lattice_street bridges", NODE + """, wm AS (SELECT image_id, CAST(node0 AS BIGINT) AS root, street_id*2 AS mid, x1 AS x, y1 AS y FROM lattice_street UNION ALL SELECT image_id, node1, street_id*2+1, x0, y0 FROM lattice_street),
u AS (SELECT w.image_id, b.idx, w.root, w.mid, (w.x-n.cx)/sqrt(pow(w.x-n.cx,2)+pow(w.y-n.cy,2)) AS ux, (w.y-n.cy)/sqrt(pow(w.x-n.cx,2)+pow(w.y-n.cy,2)) AS uy, b.angle FROM wm w JOIN nd n ON n.image_id=w.image_id AND n.root=w.root JOIN bridges b ON b.image_id=w.image_id),
al AS (SELECT *, ux*cos(radians(angle))+uy*sin(radians(angle)) AS al FROM u), p AS (SELECT a.image_id, a.idx, a.root, a.mid, b.mid AS mid_b, a.al, b.al AS alb, a.ux*b.ux+a.uy*b.uy AS dot FROM al a JOIN al b ON a.image_id=b.image_id AND a.idx=b.idx AND a.root=b.root AND a.mid < b.mid),
ok AS (SELECT *, row_number() OVER (PARTITION BY image_id, idx, root ORDER BY round(abs(al)+abs(alb), 9) DESC, mid, mid_b) AS rn FROM p WHERE al*alb < 0 AND least(abs(al), abs(alb)) > 7e-1 AND dot < -7e-1), bs AS (SELECT * FROM ok WHERE rn = 1),
ct AS (SELECT image_id, idx, root, count(*) - 2 AS l FROM al GROUP BY 1, 2, 3),
un AS (SELECT p.image_id, p.idx, p.root, p.mid, p.mid_b FROM p JOIN bs b ON b.image_id=p.image_id AND b.idx=p.idx AND b.root=p.root AND p.mid NOT IN (b.mid, b.mid_b) AND p.mid_b NOT IN (b.mid, b.mid_b) JOIN ct c ON c.image_id=p.image_id AND c.idx=p.idx AND c.root=p.root WHERE c.l = 2 AND p.dot < -7e-1)
SELECT b.image_id, b.idx, b.root, b.mid AS over_a, b.mid_b AS over_b, u.mid AS under_a, u.mid_b AS under_b FROM bs b LEFT JOIN un u ON u.image_id=b.image_id AND u.idx=b.idx AND u.root=b.root"""))
def crossing_pair(spark, sf):
    return Q.crossing_pair(wide_mouths(spark, sf), X.bridges(spark, sf))


def cand_js(spark, sf):
    return stage(spark, sf, "cand_js", lambda: N.junction_summary(N.merge_candidates(X.candidates(spark, sf))).select("image_id", "root", "cx", "cy", "r"))


def islands(spark, sf):
    """Background regions that do not touch the border and are small enough."""
    def build():
        lab = N.materialize(N.label_regions(NQ.road(spark, sf).filter("not road").select("image_id", "y", "x")))
        b = lab.join(NQ.dims(spark, sf), "image_id").groupBy("image_id", "label").agg(F.bool_or(F.expr("y = 0 or x = 0 or y = h - 1 or x = w - 1")).alias("edge"), F.count(F.lit(1)).alias("n"))
        return lab.join(b.filter("not edge and n * 0.0625 <= 2500").select("image_id", "label"), ["image_id", "label"], "left_semi")
    return stage(spark, sf, "islands", build)


CLUST = NQ.S_CLEAN + "," + NQ.merge_sql("candidates") + ", ip AS (SELECT image_id, y, x FROM roadall WHERE NOT road)," + regions_sql("il", "ip") + """,
ib AS (SELECT image_id, label FROM il GROUP BY 1, 2 HAVING min(y) > 0 AND min(x) > 0 AND max(y) < 63 AND max(x) < 63 AND count(*)*625e-4 <= 2500),
jt AS (SELECT DISTINCT i.image_id, i.label, j.root FROM il i JOIN ib USING (image_id, label) JOIN mg_j j ON j.image_id=i.image_id AND (i.y-j.cy)*(i.y-j.cy)+(i.x-j.cx)*(i.x-j.cx) <= (j.r+12)*(j.r+12)),
je AS (SELECT a.image_id, a.root AS u, b.root AS v FROM mg_j a JOIN mg_j b ON a.image_id=b.image_id AND a.root<>b.root AND sqrt(pow(a.cx-b.cx,2)+pow(a.cy-b.cy,2)) < a.r+b.r+8 UNION SELECT a.image_id, a.root, b.root FROM jt a JOIN jt b ON a.image_id=b.image_id AND a.label=b.label AND a.root<>b.root),
jc AS (SELECT image_id, root AS src, root AS cur FROM mg_j UNION SELECT c.image_id, c.src, e.v FROM jc c JOIN je e ON e.image_id=c.image_id AND e.u=c.cur), jz AS (SELECT image_id, src AS root, min(cur) AS cluster FROM jc GROUP BY 1, 2)"""


@query("junction_clusters", sql("candidates mask_px", CLUST + " SELECT * FROM jz", recursive=True))
def junction_clusters(spark, sf):
    return Q.junction_clusters(cand_js(spark, sf), islands(spark, sf), 8.0, 1.25)


@query("merge_clusters", sql("candidates mask_px", CLUST + """, me AS (SELECT DISTINCT ca.image_id, ca.cluster AS u, cb.cluster AS v FROM mg_j a JOIN mg_j b ON a.image_id=b.image_id AND a.root<>b.root AND sqrt(pow(a.cx-b.cx,2)+pow(a.cy-b.cy,2)) < a.r+b.r+4+3 JOIN jz ca ON ca.image_id=a.image_id AND ca.root=a.root JOIN jz cb ON cb.image_id=b.image_id AND cb.root=b.root WHERE ca.cluster <> cb.cluster),
mc AS (SELECT DISTINCT image_id, cluster AS src, cluster AS cur FROM jz UNION SELECT c.image_id, c.src, e.v FROM mc c JOIN me e ON e.image_id=c.image_id AND e.u=c.cur), mz AS (SELECT image_id, src, min(cur) AS l FROM mc GROUP BY 1, 2)
SELECT j.image_id, j.root, m.l AS cluster FROM jz j JOIN mz m ON m.image_id=j.image_id AND m.src=j.cluster""", recursive=True))
def merge_clusters(spark, sf):
    # a narrow road, so that only the closest clusters merge
    c = N.materialize(Q.junction_clusters(cand_js(spark, sf), islands(spark, sf), 8.0, 1.25))
    return Q.merge_clusters(c, cand_js(spark, sf), 1.0)


def grid_points(spark, sf):
    m = NQ.mask(spark, sf)
    return m.select(F.col("image_id").alias("ring_id"), (F.col("y") * 64 + F.col("x")).alias("pid"), (F.col("x") + 0.25).alias("x"), (F.col("y") + 0.375).alias("y"))


@query("points_in_region", sql("ring mask_px", CLOSED + """, pt AS (SELECT image_id AS ring_id, y*64+x AS pid, x+25e-2 AS x, y+375e-3 AS y FROM mask_px)
SELECT p.ring_id, p.pid, p.x, p.y FROM pt p JOIN eg e ON e.ring_id=p.ring_id AND (e.y0 > p.y) <> (e.y1 > p.y) AND p.x < (e.x1-e.x0)*(p.y-e.y0)/(e.y1-e.y0)+e.x0 GROUP BY 1, 2, 3, 4 HAVING count(*) % 2 = 1"""))
def points_in_region(spark, sf):
    return Q.points_in_region(grid_points(spark, sf), ring(spark, sf))


@query("taubin_smooth", sql("ring", """it(k, ring_id, seq, x, y) AS (SELECT 0, ring_id, seq, x, y FROM ring UNION ALL SELECT a.k+1, a.ring_id, a.seq,
 a.x + CASE WHEN a.k % 2 = 0 THEN 5e-1 ELSE -53e-2 END*((p.x+n.x)/2 - a.x), a.y + CASE WHEN a.k % 2 = 0 THEN 5e-1 ELSE -53e-2 END*((p.y+n.y)/2 - a.y)
 FROM it a JOIN it p ON p.ring_id=a.ring_id AND p.seq=(a.seq+15) % 16 JOIN it n ON n.ring_id=a.ring_id AND n.seq=(a.seq+1) % 16 WHERE a.k < 20)
SELECT ring_id, seq, round(x, 6) AS x, round(y, 6) AS y FROM it WHERE k = 20""", recursive=True))
def taubin_smooth(spark, sf):
    return Q.taubin_smooth(ring(spark, sf), 10, 64.0, 64.0).select("ring_id", "seq", *R("x", "y"))


@query("nearest_neighbour", sql("candidates supplier_refs".replace(" supplier_refs", ""), """rf AS (SELECT s_suppkey AS rid, CAST(s_nationkey AS BIGINT) AS image_id, CAST((s_suppkey*7919*31) % 1000 AS DOUBLE) AS x, CAST((s_suppkey*104729*17) % 1000 AS DOUBLE) AS y FROM supplier)
SELECT c.image_id, c.cand_id AS pid, arg_min(r.rid, round(sqrt(pow(c.x-r.x,2)+pow(c.y-r.y,2)), 6)*100000 + r.rid/1e4) AS rid, round(min(sqrt(pow(c.x-r.x,2)+pow(c.y-r.y,2))), 6) AS dist FROM candidates c JOIN rf r USING (image_id) GROUP BY 1, 2"""))
def nearest_neighbour(spark, sf):
    s = X.table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    refs = s.select(F.col("s_nationkey").cast("bigint").alias("image_id"), k.alias("rid"), ((k * 7919 * 31) % 1000).cast("double").alias("x"), ((k * 104729 * 17) % 1000).cast("double").alias("y"))
    pts = X.candidates(spark, sf).select("image_id", F.col("cand_id").alias("pid"), "x", "y")
    return Q.nearest_neighbour(pts, refs, ["image_id"], 32.0).select("image_id", "pid", "rid", *R("dist"))


_SEGD = "sqrt(pow(p.x-(e.x0+t*(e.x1-e.x0)),2)+pow(p.y-(e.y0+t*(e.y1-e.y0)),2))"
INNER = """ip AS (SELECT ring_id, seq AS pid, 32 + (x-32)*8e-1 AS x, 32 + (y-32)*8e-1 AS y FROM ring), pe AS (SELECT p.ring_id, p.pid, p.x, p.y, e.seq AS sid, e.x0, e.y0, e.x1, e.y1, e.a0, e.a1, e.len, least(1e0, greatest(0e0, ((p.x-e.x0)*(e.x1-e.x0)+(p.y-e.y0)*(e.y1-e.y0))/(e.l*e.l))) AS t FROM ip p JOIN ea e ON e.ring_id=p.ring_id AND e.l > 0),
pd AS (SELECT *, round(sqrt(pow(x-(x0+t*(x1-x0)),2)+pow(y-(y0+t*(y1-y0)),2)), 9) AS dist FROM pe), nr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ring_id, pid ORDER BY dist, sid) AS rn FROM pd) WHERE rn = 1), pj AS (SELECT ring_id, pid, x, y, dist, len, a0+t*(a1-a0) AS along, x0+t*(x1-x0) AS nx, y0+t*(y1-y0) AS ny FROM nr)"""


def inner(spark, sf):
    return ring(spark, sf).select("ring_id", F.col("seq").alias("pid"), ((F.col("x") - 32) * 0.8 + 32).alias("x"), ((F.col("y") - 32) * 0.8 + 32).alias("y"))


@query("project_monotonic", sql("ring", CLOSED + "," + INNER + """, rl AS (SELECT *, ((along - first_value(along) OVER w) % len + len) % len AS rel, first_value(along) OVER w AS s0 FROM pj WINDOW w AS (PARTITION BY ring_id ORDER BY pid)),
tu AS (SELECT *, CASE WHEN rel - lag(rel) OVER w > len/2 THEN -1 WHEN rel - lag(rel) OVER w < -len/2 THEN 1 ELSE 0 END AS t1 FROM rl WINDOW w AS (PARTITION BY ring_id ORDER BY pid)), uw AS (SELECT *, rel + len*sum(t1) OVER (PARTITION BY ring_id ORDER BY pid) AS u FROM tu)
SELECT ring_id, pid, round(max(u) OVER (PARTITION BY ring_id ORDER BY pid), 6) AS fwd FROM uw"""))
def project_monotonic(spark, sf):
    return Q.project_monotonic(inner(spark, sf), ring(spark, sf), ["ring_id"]).select("ring_id", "pid", *R("fwd"))


@query("snap_points", sql("ring", CLOSED + "," + INNER + " SELECT ring_id, pid, round(CASE WHEN dist > 1e-6 AND dist < 15e-1 THEN nx ELSE x END, 6) AS x, round(CASE WHEN dist > 1e-6 AND dist < 15e-1 THEN ny ELSE y END, 6) AS y, dist > 1e-6 AND dist < 15e-1 AS moved FROM pj"))
def snap_points(spark, sf):
    segs = Q.ring_edges(ring(spark, sf), ["ring_id"]).withColumnRenamed("seq", "sid")
    return Q.snap_points(inner(spark, sf), segs, ["ring_id"], 1.5).select("ring_id", "pid", *R("x", "y"), "moved")


PROJ = SEG + """, pq AS (SELECT street_id, seq AS pid, x + 5e-1 AS x, y*9e-1 + 1 AS y FROM polyline), pe AS (SELECT p.street_id, p.pid, p.x AS px, p.y AS py, s.seq AS sid, s.x, s.y, s.x1, s.y1, s.arc, s.a1, least(1e0, greatest(0e0, ((p.x-s.x)*(s.x1-s.x)+(p.y-s.y)*(s.y1-s.y))/(pow(s.x1-s.x,2)+pow(s.y1-s.y,2)))) AS t FROM pq p JOIN sgm s ON s.street_id=p.street_id),
pd AS (SELECT street_id, pid, sid, arc + t*(a1-arc) AS along, round(sqrt(pow(px-(x+t*(x1-x)),2)+pow(py-(y+t*(y1-y)),2)), 9) AS dist FROM pe), pj AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY street_id, pid ORDER BY dist, sid) AS rn FROM pd) WHERE rn = 1)"""


@query("project_to_polyline", sql("polyline", PROJ + " SELECT street_id, pid, round(dist, 6) AS dist, round(along, 6) AS along FROM pj"))
def project_to_polyline(spark, sf):
    pts = lines(spark, sf).select("street_id", F.col("seq").alias("pid"), (F.col("x") + 0.5).alias("x"), (F.col("y") * 0.9 + 1).alias("y"))
    return Q.project_to_polyline(pts, arc(spark, sf), ["street_id"]).select("street_id", "pid", *R("dist", "along"))


WALK = """sz AS (SELECT image_id, label, count(*) AS n, sum(y) AS sy, sum(x) AS sx FROM seg GROUP BY 1, 2), sf0 AS (SELECT * FROM (SELECT s.image_id, s.label, s.y, s.x, row_number() OVER (PARTITION BY s.image_id, s.label ORDER BY pow(z.n*s.y-z.sy,2)+pow(z.n*s.x-z.sx,2) DESC, s.y, s.x) AS rn FROM seg s JOIN sz z USING (image_id, label)) WHERE rn = 1),
wk(k, image_id, label, y, x, seen) AS (SELECT 0, image_id, label, y, x, [y*64+x] FROM sf0 UNION ALL SELECT k+1, image_id, label, c // 64 % 64, c % 64, list_append(seen, c) FROM (
 SELECT w.k, w.image_id, w.label, any_value(w.seen) AS seen, arg_min(s.y*64+s.x, (abs(s.y-w.y)+abs(s.x-w.x))*100 + (s.y-w.y+1)*10 + (s.x-w.x+1)) AS c FROM wk w JOIN seg s ON s.image_id=w.image_id AND s.label=w.label AND s.y BETWEEN w.y-1 AND w.y+1 AND s.x BETWEEN w.x-1 AND w.x+1 AND NOT list_contains(w.seen, s.y*64+s.x) GROUP BY 1, 2, 3) q)"""


@query("order_path", NQ.Q(NQ.S_SEG, "," + WALK + " SELECT image_id, label, CAST(k AS INTEGER) AS seq, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x FROM wk"))
def order_path(spark, sf):
    return Q.order_path(NQ.segments(spark, sf))


@query("block_areas", NQ.Q(NQ.S_CLEAN, ", bp AS (SELECT image_id, y, x FROM roadall WHERE NOT road)," + regions_sql("bl", "bp") + " SELECT image_id, label, count(*) AS pixels FROM bl GROUP BY 1, 2 HAVING count(*)*625e-4 >= 4"))
def block_areas(spark, sf):
    return Q.block_areas(NQ.road(spark, sf), 0.25).groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("pixels"))


@query("knots_and_pieces")
def knots_and_pieces(spark, sf):
    g = N.in_discs(NQ.sk(spark, sf), NQ.junctions(spark, sf), 6.0).groupBy("image_id", "y", "x").agg(F.min("root").alias("group"))
    return Q.knots_and_pieces(NQ.sk(spark, sf), NQ.deg(spark, sf), NQ.dt(spark, sf), g)[1]
