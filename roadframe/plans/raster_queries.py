"""Raster statistics over the derived photos and masks."""

from pyspark.sql import functions as F

from roadframe.operators import network as NW, raster as A
from roadframe.operators.common import materialize
from roadframe.plans.registry import blur_sql, gray, mix, nearest_sql, pick, query, r6, regions_sql, sql
from roadframe.sources import fixtures as X

R = lambda *cs: [F.round(c, 6).alias(c) for c in cs]
G = f"gr AS (SELECT image_id, y, x, {gray()} AS v FROM photo_px)"
FINE = G + "," + blur_sql("lo", "gr", ["v"], 2.0) + ", fine AS (SELECT g.image_id, g.y, g.x, g.v - l.v AS f FROM gr g JOIN lo l USING (image_id, y, x))"


def photo_gray(spark, sf):
    return A.to_gray(X.photo_px(spark, sf))


@query("to_gray", sql("photo_px", f"SELECT image_id, y, x, CAST({gray()} AS INTEGER) AS luma, r + g + b AS band_sum FROM photo_px"))
def to_gray(spark, sf):
    return X.photo_px(spark, sf).select("image_id", "y", "x", A.gray601("r", "g", "b").alias("luma"),
                                        (F.col("r") + F.col("g") + F.col("b")).alias("band_sum"))


@query("local_contrast", sql("photo_px", G + """, o(dy, dx) AS (VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1))
, sh AS (SELECT image_id, (y + dy + 64) % 64 AS y, (x + dx + 64) % 64 AS x, v FROM gr CROSS JOIN o)
SELECT a.image_id, round(avg(abs(a.v - b.v)), 6) AS local_contrast FROM gr a JOIN sh b USING (image_id, y, x) GROUP BY 1"""))
def local_contrast(spark, sf):
    return A.local_contrast(photo_gray(spark, sf)).select("image_id", *R("local_contrast"))


@query("tone_stats", sql("photo_px", G + """ SELECT image_id, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std,
 round(quantile_cont(v, 5e-2), 6) AS p5, round(quantile_cont(v, 95e-2), 6) AS p95 FROM gr GROUP BY 1"""))
def tone_stats(spark, sf):
    return A.tone_stats(photo_gray(spark, sf)).select("image_id", *R("mean", "std", "p5", "p95"))


@query("gaussian_blur", sql("photo_px", G + "," + blur_sql("lo", "gr", ["v"], 2.0) + " SELECT image_id, y, x, round(v, 6) AS v FROM lo"))
def gaussian_blur(spark, sf):
    return A.gaussian_blur(photo_gray(spark, sf), 2.0).select("image_id", "y", "x", *R("v"))


@query("grain", sql("photo_px", FINE + " SELECT image_id, round(stddev_pop(f), 6) AS grain FROM fine GROUP BY 1"))
def grain(spark, sf):
    return A.grain(photo_gray(spark, sf)).select("image_id", *R("grain"))


@query("grain_size", sql("photo_px", FINE + """, c AS (SELECT image_id, y, x, f - avg(f) OVER (PARTITION BY image_id) AS f FROM fine),
t AS (SELECT image_id, sum(f*f) AS d FROM c GROUP BY 1), lags AS (SELECT unnest(range(1, 12)) AS lag),
r AS (SELECT a.image_id, l.lag, sum(a.f*b.f) AS s FROM c a CROSS JOIN lags l JOIN c b ON a.image_id = b.image_id AND a.y = b.y AND b.x = a.x + l.lag GROUP BY 1, 2)
SELECT t.image_id, CAST(coalesce(min(r.lag) FILTER (r.s/t.d < 2e-1), 11) AS INTEGER) AS grain_size_px FROM t JOIN r USING (image_id) GROUP BY 1"""))
def grain_size(spark, sf):
    return A.grain_size(A.fine_detail(photo_gray(spark, sf)))


@query("structure_tensor", sql("photo_px", G + "," + blur_sql("b1", "gr", ["v"], 1.0) + """,
gd AS (SELECT a.image_id, a.y, a.x, (coalesce(r.v, a.v) - coalesce(l.v, a.v)) / (CASE WHEN r.v IS NULL OR l.v IS NULL THEN 1e0 ELSE 2e0 END) AS gx,
 (coalesce(d.v, a.v) - coalesce(u.v, a.v)) / (CASE WHEN d.v IS NULL OR u.v IS NULL THEN 1e0 ELSE 2e0 END) AS gy FROM b1 a
 LEFT JOIN b1 r ON r.image_id=a.image_id AND r.y=a.y AND r.x=a.x+1 LEFT JOIN b1 l ON l.image_id=a.image_id AND l.y=a.y AND l.x=a.x-1
 LEFT JOIN b1 d ON d.image_id=a.image_id AND d.y=a.y+1 AND d.x=a.x LEFT JOIN b1 u ON u.image_id=a.image_id AND u.y=a.y-1 AND u.x=a.x),
pr AS (SELECT image_id, y, x, gx*gx AS xx, gy*gy AS yy, gx*gy AS xy FROM gd),""" + blur_sql("b3", "pr", ["xx", "yy", "xy"], 3.0) + """,
j AS (SELECT image_id, sum(xx) AS a, sum(yy) AS b, sum(xy) AS c FROM b3 GROUP BY 1),
k AS (SELECT *, sqrt(greatest((a+b)*(a+b)/4 - (a*b - c*c), 0e0)) AS disc FROM j)
SELECT image_id, round(CASE WHEN (a+b)/2+disc > 1e-9 THEN 2*disc/((a+b)/2+disc) ELSE 0e0 END, 6) AS anisotropy,
 round(CASE WHEN degrees(5e-1*atan2(2*c, a-b)) < 0 THEN degrees(5e-1*atan2(2*c, a-b)) + 180 ELSE degrees(5e-1*atan2(2*c, a-b)) END, 4) AS direction_deg FROM k"""))
def structure_tensor(spark, sf):
    return A.structure_tensor(photo_gray(spark, sf)).select("image_id", *R("anisotropy"), F.round("direction_deg", 4).alias("direction_deg"))


@query("surface_reading", sql("photo_px", FINE + """, t AS (SELECT image_id, stddev_pop(f) AS g FROM fine GROUP BY 1)
SELECT image_id, CASE WHEN g < 1 THEN 'flat colour, no grain' WHEN image_id % 7 <= 3 THEN 'fine even grain' ELSE 'coarse grain' END AS reading FROM t"""))
def surface_reading(spark, sf):
    return A.grain(photo_gray(spark, sf)).select("image_id", A.surface_reading(F.col("grain"), F.col("image_id") % 7).alias("reading"))


PROF = G + """, prof AS (SELECT image_id, 'x' AS axis, x AS pos, avg(v) AS p FROM gr GROUP BY 1, 3 UNION ALL SELECT image_id, 'y', y, avg(v) FROM gr GROUP BY 1, 3)"""
AC = PROF + """, ce AS (SELECT image_id, axis, pos, p - avg(p) OVER (PARTITION BY image_id, axis) AS c, stddev_pop(p) OVER (PARTITION BY image_id, axis) AS variation FROM prof),
lags AS (SELECT unnest(range(0, 22)) AS lag),
sm AS (SELECT a.image_id, a.axis, CAST(l.lag AS INT) AS lag, any_value(a.variation) AS variation, sum(a.c*b.c) AS s FROM ce a CROSS JOIN lags l JOIN ce b ON b.image_id=a.image_id AND b.axis=a.axis AND b.pos=a.pos+l.lag GROUP BY 1, 2, 3),
ac AS (SELECT *, s / (CASE WHEN max(CASE WHEN lag=0 THEN s END) OVER w = 0 THEN 1e0 ELSE max(CASE WHEN lag=0 THEN s END) OVER w END) AS ac FROM sm WINDOW w AS (PARTITION BY image_id, axis))"""


@query("profiles", sql("photo_px", PROF + " SELECT image_id, axis, pos, round(p, 6) AS p FROM prof"))
def profiles(spark, sf):
    return A.profiles(photo_gray(spark, sf)).select("image_id", "axis", "pos", *R("p"))


@query("autocorrelation", sql("photo_px", AC + " SELECT image_id, axis, lag, round(ac, 6) AS ac FROM ac"))
def autocorrelation(spark, sf):
    return A.autocorrelation(A.profiles(photo_gray(spark, sf))).select("image_id", "axis", "lag", *R("ac"))


PER = AC + """, w AS (SELECT *, lag(ac) OVER o AS prev, lead(ac) OVER o AS nxt, min(CASE WHEN lag >= 3 THEN ac END) OVER (PARTITION BY image_id, axis ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS tr
 FROM ac WINDOW o AS (PARTITION BY image_id, axis ORDER BY lag)),
pk AS (SELECT * FROM w WHERE lag >= 3 AND lag < 21 AND ac > prev AND ac >= nxt AND ac > 35e-2 AND ac - (CASE WHEN lag > 3 THEN tr ELSE ac END) > 8e-2 AND variation >= 5e-1),
bx AS (SELECT image_id, axis, arg_max(lag, ac) AS p, max(ac) AS s FROM pk GROUP BY 1, 2),
per AS (SELECT i.image_id, x.p AS period_x, y.p AS period_y, CASE WHEN round(coalesce(x.s, 0), 3) >= round(coalesce(y.s, 0), 3) THEN x.p ELSE y.p END AS period_px, greatest(coalesce(x.s, 0e0), coalesce(y.s, 0e0)) AS strength
 FROM (SELECT DISTINCT image_id FROM gr) i LEFT JOIN bx x ON x.image_id=i.image_id AND x.axis='x' LEFT JOIN bx y ON y.image_id=i.image_id AND y.axis='y')"""


@query("periodicity", sql("photo_px", PER + " SELECT image_id, period_x, period_y, period_px, round(strength, 6) AS strength, period_px IS NOT NULL AS repeats FROM per"))
def periodicity(spark, sf):
    return A.periodicity(A.autocorrelation(A.profiles(photo_gray(spark, sf)))).select(
        "image_id", "period_x", "period_y", "period_px", *R("strength"), "repeats")


@query("run_length", sql("mask_px", """
a AS (SELECT image_id, y, x, v > 128 AS f, CASE WHEN lag(v > 128) OVER w IS DISTINCT FROM (v > 128) THEN 1 ELSE 0 END AS s FROM mask_px WINDOW w AS (PARTITION BY image_id, y ORDER BY x)),
b AS (SELECT *, CAST(sum(s) OVER (PARTITION BY image_id, y ORDER BY x) AS BIGINT) AS run FROM a)
SELECT image_id, y, run, min(x) AS start, count(*) AS len, bool_and(f) AS value FROM b GROUP BY 1, 2, 3"""))
def run_length(spark, sf):
    m = X.mask_px(spark, sf).select("image_id", "y", "x", (F.col("v") > 128).alias("f"))
    return A.run_length(m, ["image_id", "y"], "x", "f")


@query("dash_pattern", sql("photo_px", G + """, bb AS (SELECT image_id, (max(y)-min(y)) >= (max(x)-min(x)) AS vert, count(*) AS n FROM gr WHERE v > 128 GROUP BY 1 HAVING count(*) >= 20),
pj AS (SELECT g.image_id, b.vert, CASE WHEN b.vert THEN y ELSE x END AS pos, count(*) FILTER (v > 128) AS n FROM gr g JOIN bb b USING (image_id) GROUP BY 1, 2, 3),
a AS (SELECT *, n > 0 AS f, CASE WHEN lag(n > 0) OVER w IS DISTINCT FROM (n > 0) THEN 1 ELSE 0 END AS s FROM pj WINDOW w AS (PARTITION BY image_id ORDER BY pos)),
r AS (SELECT image_id, vert, f, run, count(*) AS len FROM (SELECT *, sum(s) OVER (PARTITION BY image_id ORDER BY pos) AS run FROM a) GROUP BY 1, 2, 3, 4),
e AS (SELECT *, max(run) OVER (PARTITION BY image_id) AS last FROM r),
d AS (SELECT image_id, vert, quantile_cont(len, 5e-1) FILTER (f) AS dash, quantile_cont(len, 5e-1) FILTER (NOT f AND run > 1 AND run < last) AS gap, count(*) FILTER (f) AS k FROM e GROUP BY 1, 2),
wd AS (SELECT image_id, CAST(trunc(quantile_cont(n, 5e-1)) AS INTEGER) AS width FROM pj WHERE n > 0 GROUP BY 1)
SELECT d.image_id, dash IS NOT NULL AND gap IS NOT NULL AS found, CASE WHEN gap IS NOT NULL THEN CASE WHEN vert THEN 'vertical' ELSE 'horizontal' END END AS orientation,
 CASE WHEN gap IS NOT NULL THEN dash END AS dash_px, gap AS gap_px, dash + gap AS cycle_px, CASE WHEN gap IS NOT NULL THEN width END AS width_px, round(dash / gap, 6) AS ratio, CASE WHEN gap IS NOT NULL THEN k END AS dashes_measured FROM d JOIN wd USING (image_id)"""))
def dash_pattern(spark, sf):
    return A.dash_pattern(photo_gray(spark, sf)).withColumn("ratio", F.round("ratio", 6))


# ------------------------------------------------------------------ patches
PATCH = 8
COUNT = 48


def patch_input(spark, sf):
    m = X.mask_px(spark, sf).select("image_id", "y", "x", F.when(F.col("v") > 128, 1).otherwise(0).alias("inside"))
    p = X.photo_px(spark, sf)
    lum = A.gray601("r", "g", "b")
    return m.join(p, ["image_id", "y", "x"]).select(
        "image_id", "y", "x", "inside", F.when(lum > 128, 1).otherwise(0).alias("exclude"), (F.col("r") + F.col("g") + F.col("b")).alias("tone"))


def sampled(spark, sf):
    px = materialize(patch_input(spark, sf))
    sizes = A.dims(px).withColumn("size", F.lit(PATCH))
    return A.patch_sample(A.patch_origins(sizes, COUNT), px, COUNT)


SAMPLE = f"""px AS (SELECT m.image_id, m.y, m.x, CASE WHEN m.v > 128 THEN 1 ELSE 0 END AS inside, CASE WHEN {gray('p')} > 128 THEN 1 ELSE 0 END AS excl, p.r+p.g+p.b AS tone
 FROM mask_px m JOIN photo_px p ON p.image_id=m.image_id AND p.y=m.y AND p.x=m.x),
org AS (SELECT s.s_suppkey AS image_id, CAST(t.t AS INT) AS try, CAST({pick(mix('s.s_suppkey', '7'), 't.t*2', '64-8')} AS INT) AS y, CAST({pick(mix('s.s_suppkey', '7'), 't.t*2+1', '64-8')} AS INT) AS x
 FROM supplier s CROSS JOIN range({COUNT * 40}) AS t(t)),
sat1 AS (SELECT image_id, y, x, sum(inside) OVER w AS i, sum(excl) OVER w AS e, sum(tone) OVER w AS t, sum(tone*tone) OVER w AS t2 FROM px WINDOW w AS (PARTITION BY image_id, y ORDER BY x)),
bs AS (SELECT a.image_id, a.y, a.x, a.i - coalesce(b.i, 0) AS i, a.e - coalesce(b.e, 0) AS e, a.t - coalesce(b.t, 0) AS t, a.t2 - coalesce(b.t2, 0) AS t2 FROM sat1 a LEFT JOIN sat1 b ON b.image_id=a.image_id AND b.y=a.y AND b.x=a.x-8),
ws AS (SELECT o.image_id, o.try, o.y, o.x, sum(b.i) AS i, sum(b.e) AS e, sum(b.t) AS t, sum(b.t2) AS t2 FROM org o JOIN bs b ON b.image_id=o.image_id AND b.x=o.x+7 AND b.y BETWEEN o.y AND o.y+7 GROUP BY 1, 2, 3, 4),
fl AS (SELECT *, i/64e0 >= 6e-1 AND e = 0 AS ok, i/64e0 >= 6e-1 AND e > 0 AS painted FROM ws),
cn AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY image_id ORDER BY try) AS k FROM fl),
live AS (SELECT * FROM cn WHERE k < {COUNT} OR (ok AND k = {COUNT}))"""


@query("patch_sample", sql("mask_px photo_px", SAMPLE + " SELECT image_id, try, y, x, CAST(t AS BIGINT) AS tone FROM live WHERE ok"))
def patch_sample(spark, sf):
    return sampled(spark, sf).filter("ok").select("image_id", "try", "y", "x", F.col("sum_tone").alias("tone"))


@query("patch_stats", sql("mask_px photo_px", SAMPLE + """, z AS (SELECT image_id, ok, painted, CASE WHEN ok THEN t/192e0 END AS m, CASE WHEN ok THEN sqrt((t2*64 - t*t)/(64e0*64*9)) END AS s FROM live)
SELECT image_id, 8 AS size, count(*) FILTER (ok) AS count, round(avg(m), 6) AS patch_mean, round(avg(s), 6) AS patch_std, round(stddev_pop(m), 6) AS variation,
 8*count(*) FILTER (ok) AS placements, count(*) FILTER (painted) AS rejected_for_paint FROM z GROUP BY 1"""))
def patch_stats(spark, sf):
    return A.patch_stats(sampled(spark, sf)).select("image_id", "size", "count", *R("patch_mean", "patch_std", "variation"),
                                                    "placements", "rejected_for_paint")


@query("patch_orientations", sql("patch_px", """c AS (SELECT unnest(range(8)) AS code),
r AS (SELECT vec_id, code, v, CASE code // 2 WHEN 0 THEN y WHEN 1 THEN 7-x WHEN 2 THEN 7-y ELSE x END AS ny, CASE code // 2 WHEN 0 THEN x WHEN 1 THEN y WHEN 2 THEN 7-x ELSE 7-y END AS nx FROM patch_px CROSS JOIN c)
SELECT vec_id, CAST(code AS INTEGER) AS code, round(sum(v * (ny*8 + CASE WHEN code % 2 = 1 THEN 7-nx ELSE nx END)), 6) AS checksum, round(sum(CASE WHEN ny = 0 THEN v ELSE 0 END), 6) AS top FROM r GROUP BY 1, 2"""))
def patch_orientations(spark, sf):
    d = A.patch_orientations(X.patch_px(spark, sf), 8)
    return d.groupBy("vec_id", "code").agg(F.round(F.sum(F.col("v") * (F.col("y") * 8 + F.col("x"))), 6).alias("checksum"),
                                           F.round(F.sum(F.when(F.col("y") == 0, F.col("v")).otherwise(0.0)), 6).alias("top"))


@query("paint_tone", sql("photo_px", f"""g AS (SELECT *, {gray()} AS v FROM photo_px)
SELECT image_id, round(avg(v) FILTER (v > 128), 6) AS mean, round(stddev_pop(v) FILTER (v > 128), 6) AS std, round(quantile_cont(v, 5e-2) FILTER (v > 128), 6) AS p5,
 round(quantile_cont(v, 95e-2) FILTER (v > 128), 6) AS p95, round(count(*) FILTER (v > 128) / CAST(count(*) AS DOUBLE), 6) AS coverage,
 round(avg(r) FILTER (v > 128), 6) AS mean_r, round(avg(g) FILTER (v > 128), 6) AS mean_g, round(avg(b) FILTER (v > 128), 6) AS mean_b FROM g GROUP BY 1"""))
def paint_tone(spark, sf):
    return A.paint_tone(X.photo_px(spark, sf)).select("image_id", *R("mean", "std", "p5", "p95", "coverage", "mean_r", "mean_g", "mean_b"))


def both_photos(spark, sf):
    p = X.raster_pair(spark, sf)
    side = lambda s: p.select("image_id", "y", "x", *[F.col(f"{c}{s}").alias(c) for c in "rgb"])
    return side("a"), side("b")


DIFF = "df AS (SELECT image_id, y, x, least(255, abs((ra+ga+ba) - (rb+gb+bb))) AS v FROM raster_pair)"


@query("noise_features", sql("raster_pair", DIFF + ", st AS (SELECT * FROM df WHERE v > 20)," + regions_sql("cc", "st") + "," + nearest_sql("nt", "df", "v <= 20") + """,
ar AS (SELECT image_id, label, count(*) AS a FROM cc GROUP BY 1, 2), mk AS (SELECT image_id, count(*) AS features, quantile_cont(a, 5e-1) AS median_area FROM ar GROUP BY 1),
th AS (SELECT n.image_id, avg(sqrt(n.d2))*2 AS t FROM nt n JOIN st s USING (image_id, y, x) GROUP BY 1), tt AS (SELECT image_id, count(*) FILTER (v > 20)/CAST(count(*) AS DOUBLE) AS c FROM df GROUP BY 1)
SELECT tt.image_id, round(tt.c, 6) AS coverage, coalesce(features, 0) AS features, round(coalesce(median_area, 0e0), 6) AS median_area, round(coalesce(t, 0e0), 6) AS thickness_px FROM tt LEFT JOIN mk USING (image_id) LEFT JOIN th USING (image_id)""", recursive=True))
def noise_features(spark, sf):
    diff, _ = A.isolate_noise(*both_photos(spark, sf))
    return A.noise_features(materialize(diff)).select("image_id", *R("coverage"), "features", *R("median_area", "thickness_px"))


@query("isolate_noise", sql("raster_pair", DIFF + " SELECT image_id, round(avg(v), 6) AS mean, max(v) AS max, round(count(*) FILTER (v > 20)/CAST(count(*) AS DOUBLE), 6) AS covered FROM df GROUP BY 1"))
def isolate_noise(spark, sf):
    return A.noise_summary(A.isolate_noise(*both_photos(spark, sf))[0]).select("image_id", *R("mean"), "max", *R("covered"))


@query("road_pixels", sql("mask_px", "SELECT image_id, count(*) FILTER (v > 128) AS road_px FROM mask_px GROUP BY 1"))
def road_pixels(spark, sf):
    return A.road_pixels(X.mask_px(spark, sf))


@query("prime_trees", sql("photo_px tree_leaf", G + """, m AS (SELECT image_id, round(avg(v), 2) AS tone, round(stddev_pop(v), 3) AS grain, round(count(*) FILTER (v > 128)/CAST(count(*) AS DOUBLE), 4) AS coverage, CAST(max(v) AS DOUBLE) AS thickness, 12e0 AS cycle_px FROM gr GROUP BY 1)
SELECT image_id, tree, path, route_id, fallbacks, 5e-1 AS confidence, CASE WHEN route_id='material.open' THEN tone END AS tone, CASE WHEN route_id='material.open' THEN grain END AS grain,
 CASE WHEN tree='noise' THEN coverage END AS coverage, CASE WHEN route_id='noise.open' THEN thickness END AS thickness, CASE WHEN route_id='lines.dash' THEN cycle_px END AS cycle_px FROM m CROSS JOIN tree_leaf"""))
def prime_trees(spark, sf):
    m = photo_gray(spark, sf).groupBy("image_id").agg(
        F.round(F.avg("v"), 2).alias("tone"), F.round(F.stddev_pop("v"), 3).alias("grain"),
        F.round(F.count_if(F.col("v") > 128) / F.count(F.lit(1)), 4).alias("coverage"), F.max("v").cast("double").alias("thickness"),
        F.lit(12.0).alias("cycle_px"))
    return A.prime_trees(m)
