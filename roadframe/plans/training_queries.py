"""Measuring aligned pairs and folding them into the index."""

from pyspark.sql import functions as F

from roadframe.operators import memory as M, network as N, raster as A, training as T
from roadframe.plans import network_queries as NQ
from roadframe.plans.memory_queries import BOTH, PAIRS, kept_pairs, out_index
from roadframe.plans.raster_queries import FINE, G
from roadframe.plans.registry import gray, mix, nearest_sql, pick, query, r6, regions_sql, sql
from roadframe.plans.stages import stage
from roadframe.sources import fixtures as X

R = lambda *cs: [F.round(c, 6).alias(c) for c in cs]
MPP = 0.25


def photo(spark, sf):
    return stage(spark, sf, "photo", lambda: X.photo_px(spark, sf, NQ.mask(spark, sf)))


def photo_gray(spark, sf):
    return stage(spark, sf, "gray", lambda: A.to_gray(photo(spark, sf)))


def road_gray(spark, sf):
    return stage(spark, sf, "road_gray", lambda: NQ.dt(spark, sf).join(photo_gray(spark, sf), ["image_id", "y", "x"]).select("image_id", "y", "x", "dist", "v"))


def bands(spark, sf):
    return stage(spark, sf, "bands", lambda: T.kerb_band(NQ.sk(spark, sf), NQ.dt(spark, sf), NQ.dims(spark, sf), MPP))


def paint(spark, sf):
    return stage(spark, sf, "paint", lambda: T.paint_pixels(road_gray(spark, sf), T.paint_threshold(road_gray(spark, sf)))[1])


def parts(spark, sf):
    def build():
        surface = road_gray(spark, sf).join(paint(spark, sf), ["image_id", "y", "x"], "left_anti")
        return T.classify_pixels(surface, NQ.typed(spark, sf), bands(spark, sf), MPP)
    return stage(spark, sf, "parts", build)


S_BAND = """bd AS (SELECT i.image_id, coalesce(w.w, 8e0) AS road_width FROM (SELECT DISTINCT image_id FROM mask_px) i LEFT JOIN (SELECT s.image_id, 2*quantile_cont(d.dist, 5e-1) AS w FROM sk s JOIN dt d USING (image_id, y, x) GROUP BY 1) w USING (image_id)),
band AS (SELECT *, least(15e-1, greatest(5e-2, road_width*25e-2*25e-2)) AS band_m FROM bd)"""
S_PAINT = f"""rgy AS (SELECT d.image_id, d.y, d.x, d.dist, {gray('p')} AS v FROM dt d JOIN photo_px p USING (image_id, y, x)), md AS (SELECT image_id, quantile_cont(v, 5e-1) AS med FROM rgy GROUP BY 1),
mm AS (SELECT r.image_id, any_value(m.med) AS med, quantile_cont(abs(r.v - m.med), 5e-1) AS mad FROM rgy r JOIN md m USING (image_id) GROUP BY 1),
lim AS (SELECT *, med + greatest(3*greatest(mad*14826e-4, 1e0), 25e0) AS threshold FROM mm), core AS (SELECT r.image_id, r.y, r.x FROM rgy r JOIN lim l USING (image_id) WHERE v > threshold),
pls(dy, dx) AS (VALUES (0,0),(-1,0),(1,0),(0,-1),(0,1)), pt AS (SELECT DISTINCT c.image_id, c.y + dy AS y, c.x + dx AS x FROM core c CROSS JOIN pls), paint AS (SELECT p.* FROM pt p JOIN rgy USING (image_id, y, x))"""
S_PART = """parts AS (SELECT r.image_id, r.y, r.x, r.dist, r.v, CASE WHEN EXISTS (SELECT 1 FROM ty j WHERE j.image_id=r.image_id AND j.type NOT IN ('interchange (flagged)','not a junction') AND (r.y-j.cy)*(r.y-j.cy)+(r.x-j.cx)*(r.x-j.cx) <= j.r*j.r) THEN 'junction'
 WHEN r.dist*25e-2 <= b.band_m THEN 'edge' ELSE 'open' END AS part FROM rgy r JOIN band b USING (image_id) WHERE NOT EXISTS (SELECT 1 FROM paint p WHERE p.image_id=r.image_id AND p.y=r.y AND p.x=r.x))"""
P = lambda chain, tail: sql("mask_px photo_px", chain + " " + tail, recursive=True)
ALL = NQ.S_TYPE + "," + S_BAND + "," + S_PAINT + "," + S_PART


@query("check_alignment", sql("mask_px photo_px", """m AS (SELECT image_id, max(y)+1 AS h, max(x)+1 AS w FROM mask_px GROUP BY 1), p AS (SELECT image_id, max(y)+1 AS h, max(CASE WHEN image_id % 10 = 0 THEN least(x, 62) ELSE x END)+1 AS w FROM photo_px GROUP BY 1)
SELECT m.image_id, m.h, m.w, p.h AS photo_h, p.w AS photo_w, m.h = p.h AND m.w = p.w AS ok FROM m JOIN p USING (image_id)"""))
def check_alignment(spark, sf):
    cropped = photo(spark, sf).withColumn("x", F.when(F.col("image_id") % 10 == 0, F.least("x", F.lit(62))).otherwise(F.col("x")))
    return T.check_alignment(NQ.mask(spark, sf), cropped)


@query("kerb_band", NQ.Q(NQ.S_SK, "," + S_BAND + " SELECT image_id, round(road_width, 6) AS road_width, round(band_m, 6) AS band_m, band_m < 15e-1 - 1e-6 AS capped FROM band"))
def kerb_band(spark, sf):
    return T.kerb_band(NQ.sk(spark, sf), NQ.dt(spark, sf), NQ.dims(spark, sf), MPP).select("image_id", *R("road_width", "band_m"), "capped")


@query("paint_threshold", P(NQ.S_DT + "," + S_PAINT, "SELECT l.image_id, l.med, l.mad, round(l.threshold, 6) AS threshold, (SELECT count(*) FROM paint p WHERE p.image_id = l.image_id) AS paint_px FROM lim l"))
def paint_threshold(spark, sf):
    lim = T.paint_threshold(road_gray(spark, sf))
    n = T.paint_pixels(road_gray(spark, sf), lim)[1].groupBy("image_id").agg(F.count(F.lit(1)).alias("paint_px"))
    return lim.join(n, "image_id", "left").select("image_id", "med", "mad", *R("threshold"), F.coalesce("paint_px", F.lit(0)).alias("paint_px"))


@query("classify_pixels", P(ALL, "SELECT image_id, y, x, part FROM parts"))
def classify_pixels(spark, sf):
    surface = road_gray(spark, sf).join(paint(spark, sf), ["image_id", "y", "x"], "left_anti")
    return T.classify_pixels(surface, NQ.typed(spark, sf), bands(spark, sf), MPP).select("image_id", "y", "x", "part")


S_STATS = ALL + "," + FINE + """, o4(dy, dx) AS (VALUES (-1,0),(1,0),(0,-1),(0,1)), n4 AS (SELECT image_id, (y+dy+64) % 64 AS y, (x+dx+64) % 64 AS x, v FROM gr CROSS JOIN o4),
df4 AS (SELECT g.image_id, g.y, g.x, avg(abs(g.v - n.v)) AS diff FROM gr g JOIN n4 n USING (image_id, y, x) GROUP BY 1, 2, 3),
gs AS (SELECT p.image_id, p.part, count(*) AS pixels, avg(p.v) AS mean, stddev_pop(p.v) AS std, quantile_cont(p.v, 5e-2) AS p5, quantile_cont(p.v, 95e-2) AS p95, avg(d.diff) AS local_contrast, stddev_pop(f.f) AS grain
 FROM parts p JOIN fine f USING (image_id, y, x) JOIN df4 d USING (image_id, y, x) GROUP BY 1, 2)"""


def stats(spark, sf):
    return stage(spark, sf, "group_stats", lambda: T.group_stats(parts(spark, sf), photo_gray(spark, sf)))


@query("group_stats", P(S_STATS, """SELECT image_id, part, pixels, CASE WHEN pixels >= 50 THEN round(mean, 6) END AS mean, CASE WHEN pixels >= 50 THEN round(std, 6) END AS std, CASE WHEN pixels >= 50 THEN round(p5, 6) END AS p5, CASE WHEN pixels >= 50 THEN round(p95, 6) END AS p95,
 CASE WHEN pixels >= 50 THEN round(local_contrast, 6) END AS local_contrast, CASE WHEN pixels >= 50 THEN round(grain, 6) END AS grain, CASE WHEN pixels < 50 THEN 'too few pixels to measure' WHEN grain < 1 THEN 'flat, almost no grain' WHEN grain < 6 THEN 'fine grain' ELSE 'coarse, heavily worn' END AS reading,
 round(pixels / CAST(sum(pixels) OVER (PARTITION BY image_id) AS DOUBLE), 6) AS share FROM gs"""))
def group_stats(spark, sf):
    return T.group_stats(parts(spark, sf), photo_gray(spark, sf)).select(
        "image_id", "part", "pixels", *R("mean", "std", "p5", "p95", "local_contrast", "grain"), "reading", *R("share"))


S_LINE = S_BAND + "," + S_PAINT + "," + regions_sql("pl", "paint") + """, bg AS (SELECT image_id, label FROM pl GROUP BY 1, 2 HAVING count(*) >= 12), str0 AS (SELECT p.image_id, p.y, p.x FROM pl p JOIN bg USING (image_id, label)),
np AS (SELECT image_id, count(*) AS paint_px FROM paint GROUP BY 1), ns AS (SELECT image_id, count(*) AS stroke_px FROM str0 GROUP BY 1), str AS (SELECT s.* FROM str0 s JOIN ns USING (image_id) JOIN np USING (image_id) WHERE stroke_px >= 50 AND paint_px >= 50),
strall AS (SELECT m.image_id, m.y, m.x, s.image_id IS NOT NULL AS inside FROM mask_px m LEFT JOIN str s USING (image_id, y, x)),""" + nearest_sql("sdn", "strall", "NOT inside") + "," + NQ.thin_sql("ssk", "str", 8) + """,
lw AS (SELECT k.image_id, quantile_cont(2*sqrt(d.d2) - 1, 5e-1) AS w FROM ssk k JOIN sdn d USING (image_id, y, x) GROUP BY 1),
lr AS (SELECT b.image_id, CASE WHEN w > 0 THEN w END AS line_width_px, CASE WHEN w > 0 THEN w/b.road_width END AS line_ratio, CASE WHEN w > 0 THEN stroke_px ELSE coalesce(paint_px, 0) END AS paint_px FROM band b LEFT JOIN np USING (image_id) LEFT JOIN ns USING (image_id) LEFT JOIN lw USING (image_id))"""


def line_rows(spark, sf):
    return stage(spark, sf, "line_rows", lambda: T.line_width_ratio(paint(spark, sf), bands(spark, sf), NQ.dims(spark, sf)))


@query("line_width_ratio", P(NQ.S_SK + "," + S_LINE, "SELECT image_id, round(line_width_px, 6) AS line_width_px, round(line_ratio, 6) AS line_ratio, paint_px FROM lr"))
def line_width_ratio(spark, sf):
    return line_rows(spark, sf).select("image_id", *R("line_width_px", "line_ratio"), "paint_px")


@query("weighted_line_ratio", P(NQ.S_SK + "," + S_LINE, """, sm AS (SELECT round(line_ratio, 4) AS ratio, paint_px FROM lr WHERE line_ratio IS NOT NULL), ru AS (SELECT ratio, sum(paint_px) OVER (ORDER BY ratio, paint_px ROWS UNBOUNDED PRECEDING) AS run FROM sm)
SELECT (SELECT min(ratio) FROM ru WHERE run >= (SELECT sum(paint_px) FROM sm)/2e0) AS line_ratio, (SELECT count(*) FROM sm) AS pairs"""))
def weighted_line_ratio(spark, sf):
    return T.weighted_line_ratio(line_rows(spark, sf).select(F.col("line_ratio").alias("ratio"), "paint_px"))


def size_input(spark, sf):
    r = NQ.typed(spark, sf).filter("type <> 'not a junction'").groupBy("image_id").agg(F.percentile("r", F.lit(0.5)).alias("junction_r"))
    return bands(spark, sf).join(r, "image_id", "left")


S_SIZE = """jr AS (SELECT image_id, quantile_cont(r, 5e-1) AS jr FROM ty WHERE type <> 'not a junction' GROUP BY 1),
sz AS (SELECT image_id, CAST(least(64, greatest(6, round_even(road_width*9e-1, 0))) AS INTEGER) AS open, CAST(least(48, greatest(4, round_even(least(road_width*5e-1, band_m/25e-2*9e-1), 0))) AS INTEGER) AS edge,
 CAST(least(64, greatest(6, round_even(coalesce(jr, road_width)*9e-1, 0))) AS INTEGER) AS junction FROM band LEFT JOIN jr USING (image_id))"""


@query("patch_size_rule", P(NQ.S_TYPE + "," + S_BAND + "," + S_SIZE, "SELECT * FROM sz"))
def patch_size_rule(spark, sf):
    return T.patch_size_rule(size_input(spark, sf), MPP)


COUNT = 16


def libraries(spark, sf):
    def build():
        s = T.patch_size_rule(size_input(spark, sf), MPP).join(NQ.dims(spark, sf), "image_id")
        sizes = s.select("image_id", "h", "w", F.expr("stack(3, 'open', open, 'edge', edge, 'junction', junction) as (part, size)"))
        px = (photo(spark, sf).select("image_id", "y", "x")
              .join(parts(spark, sf).select("image_id", "y", "x", "part"), ["image_id", "y", "x"], "left")
              .join(paint(spark, sf).withColumn("exclude", F.lit(1)), ["image_id", "y", "x"], "left").na.fill(0, ["exclude"]))
        return T.build_library(sizes, px, COUNT)
    return stage(spark, sf, "libraries", build)


S_LIB = S_SIZE + f""", s0 AS (SELECT image_id, 'open' AS part, open AS s FROM sz UNION ALL SELECT image_id, 'edge', edge FROM sz UNION ALL SELECT image_id, 'junction', junction FROM sz),
s1 AS (SELECT image_id, part, least(s, 32) AS a, CASE WHEN least(s,32) > 4 THEN greatest(4, CAST(floor(least(s,32)*6e-1+1e-9) AS INT)) END AS b FROM s0), s2 AS (SELECT *, CASE WHEN b > 4 THEN greatest(4, CAST(floor(b*6e-1+1e-9) AS INT)) END AS c FROM s1),
s3 AS (SELECT *, CASE WHEN c > 4 THEN greatest(4, CAST(floor(c*6e-1+1e-9) AS INT)) END AS d FROM s2),
atm AS (SELECT image_id, part, 0 AS attempt, a AS size FROM s3 UNION ALL SELECT image_id, part, 1, b FROM s3 WHERE b IS NOT NULL UNION ALL SELECT image_id, part, 2, c FROM s3 WHERE c IS NOT NULL UNION ALL SELECT image_id, part, 3, d FROM s3 WHERE d IS NOT NULL),
og AS (SELECT image_id, size, t, {pick(mix('image_id', '7'), 't*2', '64-size')} AS y0, {pick(mix('image_id', '7'), 't*2+1', '64-size')} AS x0 FROM (SELECT DISTINCT image_id, size FROM atm) CROSS JOIN range({COUNT * 40}) AS r(t)),
lx AS (SELECT m.image_id, m.y, m.x, p.part, CASE WHEN t.image_id IS NULL THEN 0 ELSE 1 END AS ex FROM mask_px m LEFT JOIN parts p USING (image_id, y, x) LEFT JOIN paint t USING (image_id, y, x)),
rw AS (SELECT image_id, y, x, sum(CASE WHEN part='open' THEN 1 ELSE 0 END) OVER w AS o, sum(CASE WHEN part='edge' THEN 1 ELSE 0 END) OVER w AS e, sum(CASE WHEN part='junction' THEN 1 ELSE 0 END) OVER w AS j, sum(ex) OVER w AS q FROM lx WINDOW w AS (PARTITION BY image_id, y ORDER BY x)),
sa AS (SELECT image_id, y, x, sum(o) OVER w AS o, sum(e) OVER w AS e, sum(j) OVER w AS j, sum(q) OVER w AS q FROM rw WINDOW w AS (PARTITION BY image_id, x ORDER BY y)),
wn AS (SELECT g.image_id, g.size, g.t, d.o - coalesce(b.o,0) - coalesce(c.o,0) + coalesce(a.o,0) AS o, d.e - coalesce(b.e,0) - coalesce(c.e,0) + coalesce(a.e,0) AS e, d.j - coalesce(b.j,0) - coalesce(c.j,0) + coalesce(a.j,0) AS j, d.q - coalesce(b.q,0) - coalesce(c.q,0) + coalesce(a.q,0) AS q
 FROM og g JOIN sa d ON d.image_id=g.image_id AND d.y=g.y0+g.size-1 AND d.x=g.x0+g.size-1 LEFT JOIN sa b ON b.image_id=g.image_id AND b.y=g.y0-1 AND b.x=g.x0+g.size-1
 LEFT JOIN sa c ON c.image_id=g.image_id AND c.y=g.y0+g.size-1 AND c.x=g.x0-1 LEFT JOIN sa a ON a.image_id=g.image_id AND a.y=g.y0-1 AND a.x=g.x0-1),
nn AS (SELECT t.image_id, t.part, t.attempt, t.size, least({COUNT}, count(*) FILTER ((CASE t.part WHEN 'open' THEN o WHEN 'edge' THEN e ELSE j END) / CAST(t.size*t.size AS DOUBLE) >= CASE t.part WHEN 'edge' THEN 5e-1 ELSE 6e-1 END AND q = 0)) AS patches
 FROM atm t JOIN wn USING (image_id, size) GROUP BY 1, 2, 3, 4),
lb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, part ORDER BY CASE WHEN patches < 6 AND size > 4 THEN 1 ELSE 0 END, CASE WHEN patches >= 6 THEN attempt ELSE -attempt END) AS rn FROM nn) WHERE rn = 1)"""


@query("build_library", P(ALL + "," + S_LIB, "SELECT image_id, part, attempt, size, patches, patches >= 6 AS usable FROM lb"))
def build_library(spark, sf):
    return libraries(spark, sf)


@query("usable_groups", P(ALL + "," + S_LIB, "SELECT l.image_id, l.part, l.patches, patches >= 6 AS usable, road_width >= 20 AS resolution_ok FROM lb l JOIN band USING (image_id)"))
def usable_groups(spark, sf):
    return T.usable_groups(libraries(spark, sf), bands(spark, sf))


def measured(spark, sf):
    st = stats(spark, sf).select("image_id", "part", "pixels", "mean", "grain", "local_contrast")
    return libraries(spark, sf).join(st, ["image_id", "part"], "left").select(
        "part", F.col("image_id").alias("pair_id"), (F.col("usable") & F.col("mean").isNotNull()).alias("usable"), "pixels", "mean", "grain",
        "local_contrast", "patches", F.col("size").alias("size_px"))


S_MEAS = ALL + "," + S_LIB + "," + S_STATS[len(ALL) + 1:] + """,
ms AS (SELECT l.part, l.image_id AS pair_id, l.patches >= 6 AND coalesce(g.pixels, 0) >= 50 AS usable, g.pixels, g.mean, g.grain, g.local_contrast, l.patches, l.size AS size_px FROM lb l LEFT JOIN gs g USING (image_id, part)),
ac AS (SELECT part, CAST(sum(pixels) FILTER (usable) AS BIGINT) AS pixels, CAST(sum(patches) FILTER (usable) AS BIGINT) AS patches, sum(mean*pixels) FILTER (usable) AS t, sum(grain*pixels) FILTER (usable) AS g, sum(local_contrast*pixels) FILTER (usable) AS c,
 count(*) FILTER (usable) AS pairs, count(*) FILTER (NOT usable) AS skipped, coalesce(list(pair_id ORDER BY pair_id) FILTER (usable), []) AS pair_ids, coalesce(list(pair_id ORDER BY pair_id) FILTER (NOT usable), []) AS skipped_ids,
 coalesce(list(patches ORDER BY pair_id) FILTER (usable), []) AS library_patches, coalesce(list(size_px ORDER BY pair_id) FILTER (usable), []) AS library_sizes FROM ms GROUP BY 1)"""


@query("accumulate_groups", P(S_MEAS, "SELECT part, coalesce(pixels > 0, false) AS usable, pixels, patches, round(t/pixels, 6) AS tone, round(g/pixels, 6) AS grain, round(c/pixels, 6) AS contrast, pairs, skipped, pair_ids, skipped_ids, library_patches, library_sizes FROM ac"))
def accumulate_groups(spark, sf):
    return T.accumulate_groups(measured(spark, sf)).select("part", "usable", "pixels", "patches", *R("tone", "grain", "contrast"), "pairs", "skipped",
                                                              "pair_ids", "skipped_ids", "library_patches", "library_sizes")


@query("rebuild_index", sql("library_rows review_log", BOTH + """,
r2 AS (SELECT part, pair_id, pixels, patches, size_px, confidence, rejections, acceptances, cooldown, pixels*confidence AS weight FROM idx WHERE patches >= 190)
SELECT part, pair_id, pixels, patches, size_px, confidence, rejections, acceptances, cooldown, round(weight, 6) AS weight, row_number() OVER (PARTITION BY part ORDER BY weight DESC, pixels DESC, pair_id) AS rank FROM r2"""))
def rebuild_index(spark, sf):
    old = M.replay_index(X.library_rows(spark, sf), X.review_log(spark, sf), ranked=False)
    groups = X.library_rows(spark, sf).withColumn("usable", F.col("patches") >= 190)
    return out_index(T.rebuild_index(groups, old))


@query("train_incremental", sql("", PAIRS + """,
asked AS (SELECT l_orderkey*10 + l_linenumber AS request_id, l_partkey AS mask_id, l_suppkey AS photo_id, l_tax AS scale FROM lineitem)
SELECT a.request_id, a.mask_id, a.photo_id, a.scale FROM asked a WHERE a.request_id NOT IN (SELECT b.request_id FROM asked b JOIN kept k ON b.mask_id=k.mask_id AND b.photo_id=k.photo_id AND abs(b.scale-k.scale) < 1e-6)"""))
def train_incremental(spark, sf):
    asked = X.table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("request_id"), F.col("l_partkey").alias("mask_id"),
                                                  F.col("l_suppkey").alias("photo_id"), F.col("l_tax").alias("scale"))
    return T.train_incremental(asked, kept_pairs(spark, sf))


MERGED = f"""
t AS (SELECT part, sum(pixels) AS t, CAST(trunc(quantile_cont(size_px, 5e-1)) AS INTEGER) AS cs FROM library_rows GROUP BY 1),
w AS (SELECT l.*, t.t, t.cs, CAST(l.pixels*300 // t.t AS BIGINT) AS base, l.pixels*300 % t.t AS rest FROM library_rows l JOIN t USING (part)),
k AS (SELECT *, least(patches, base + CASE WHEN row_number() OVER (PARTITION BY part ORDER BY rest DESC, pair_id) <= 300 - sum(base) OVER (PARTITION BY part) THEN 1 ELSE 0 END) AS kept FROM w),
p AS (SELECT k.part, k.pair_id, k.cs, k.kept, r.i AS patch, row_number() OVER (PARTITION BY k.part, k.pair_id ORDER BY {mix('k.pair_id', 'r.i')}, r.i) AS rn FROM k JOIN range(100000) AS r(i) ON r.i < k.patches)
SELECT part, pair_id, CAST(patch AS INTEGER) AS patch, cs AS common_size FROM p WHERE """


@query("merge_libraries", sql("library_rows", MERGED + "true"))
def merge_libraries(spark, sf):
    return T.merge_libraries(X.library_rows(spark, sf))


@query("merge_libraries_capped", sql("library_rows", MERGED + "rn <= kept"))
def merge_libraries_capped(spark, sf):
    return T.merge_libraries(X.library_rows(spark, sf), 300)


def patch_libraries(spark, sf):
    """The patches as libraries of pairs: 60 patches a pair, dealt to three parts, cut to the side that suits the pair."""
    def build():
        pair = F.floor(F.col("vec_id") / 60).cast("bigint")
        d = X.patch_px(spark, sf).withColumn("pair_id", pair).filter((F.col("y") < 4 + F.col("pair_id") % 5) & (F.col("x") < 4 + F.col("pair_id") % 5))
        part = F.when(F.col("vec_id") % 3 == 0, "junction").when(F.col("vec_id") % 3 == 1, "edge").otherwise("open")
        number = M.range_rank(d.filter("y = 0 and x = 0").select(part.alias("part"), "pair_id", "vec_id"), ["part", "pair_id"], [F.col("vec_id").asc()], "_n")
        return d.join(number.select("part", "vec_id", (F.col("_n") - 1).cast("int").alias("patch")), "vec_id").select("part", "pair_id", "patch", "y", "x", "v")
    return stage(spark, sf, "patch_libraries", build)


POOLED = """pl0 AS (SELECT vec_id, vec_id // 60 AS pair_id, CASE vec_id % 3 WHEN 0 THEN 'junction' WHEN 1 THEN 'edge' ELSE 'open' END AS part, y, x, v FROM patch_px WHERE y < 4 + (vec_id // 60) % 5 AND x < 4 + (vec_id // 60) % 5),
pl AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY part, pair_id ORDER BY vec_id) - 1 AS INTEGER) AS patch FROM pl0),
ms AS (SELECT part, pair_id, count(*) AS pixels, count(DISTINCT patch) AS patches, max(y) + 1 AS size_px, avg(v) AS mean, stddev_pop(v) AS grain FROM pl GROUP BY 1, 2),
lc AS (SELECT part, pair_id, avg(sd) AS local_contrast FROM (SELECT part, pair_id, patch, stddev_pop(v) AS sd FROM pl GROUP BY 1, 2, 3) q GROUP BY 1, 2),
cs AS (SELECT part, CAST(trunc(quantile_cont(size_px, 5e-1)) AS INTEGER) AS size_px FROM ms GROUP BY 1)"""


@query("merged_patches", sql("patch_px", POOLED + """,
wt AS (SELECT n, m, o, i, CASE WHEN m < n THEN greatest(0, least((o+1)*n, (i+1)*m) - greatest(o*n, i*m)) / CAST(n AS DOUBLE)
  ELSE greatest(0, 2*m - abs(least(greatest((2*o+1)*n - m, 0), 2*m*(n-1)) - 2*m*i)) / (2e0*m) END AS w FROM range(4, 9) AS a(n), range(4, 9) AS b(m), range(8) AS c(o), range(8) AS d(i) WHERE o < m AND i < n)
SELECT p.part, p.pair_id, p.patch, c.size_px, CAST(a.o AS INTEGER) AS y, CAST(b.o AS INTEGER) AS x, round(sum(p.v*a.w*b.w), 6) AS v FROM pl p JOIN ms s ON s.part=p.part AND s.pair_id=p.pair_id JOIN cs c ON c.part=p.part
 JOIN wt a ON a.n=s.size_px AND a.m=c.size_px AND a.i=p.y JOIN wt b ON b.n=s.size_px AND b.m=c.size_px AND b.i=p.x GROUP BY 1, 2, 3, 4, 5, 6"""))
def merged_patches(spark, sf):
    px = patch_libraries(spark, sf)
    return T.merged_patches(T.library_measures(px, "v"), px, ["v"]).withColumn("v", F.round("v", 6))


@query("merged_statistics", sql("patch_px", POOLED + """
SELECT m.part, c.size_px, CAST(sum(m.patches) AS BIGINT) AS count, count(*) AS pairs, CAST(sum(m.pixels) AS BIGINT) AS pixels, round(sum(m.mean*m.pixels)/sum(m.pixels), 2) AS tone,
 round(sum(m.grain*m.pixels)/sum(m.pixels), 3) AS grain, round(sum(l.local_contrast*m.pixels)/sum(m.pixels), 3) AS contrast, list_sort(list(DISTINCT m.size_px)) AS sizes_seen
FROM ms m JOIN lc l USING (part, pair_id) JOIN cs c ON c.part=m.part GROUP BY 1, 2"""))
def merged_statistics(spark, sf):
    return T.merged_statistics(T.library_measures(patch_libraries(spark, sf), "v"))


@query("upgrade_routes", sql("tree_leaf library_rows", """
m AS (SELECT part, count(*) FILTER (patches >= 190) AS pairs, CAST(sum(pixels) FILTER (patches >= 190) AS BIGINT) AS px FROM library_rows GROUP BY 1),
r AS (SELECT t.*, CASE WHEN tree='lines' THEN 'lines' ELSE split_part(route_id, '.', 2) END AS part FROM tree_leaf t)
SELECT r.route_id, r.part, CASE WHEN m.pairs > 0 THEN round(least(85e-2, 6e-1 + 5e-2*m.pairs), 2) ELSE r.confidence END AS confidence,
 CASE WHEN m.pairs > 0 THEN 'stage B, ' || CAST(m.pairs AS VARCHAR) || ' pair' || CASE WHEN m.pairs > 1 THEN 's' ELSE '' END ELSE r.source END AS source,
 CASE WHEN m.pairs > 0 THEN r.route_id || '.primed' || CASE WHEN r.fallbacks = '' THEN '' ELSE ',' || r.fallbacks END ELSE r.fallbacks END AS fallbacks,
 CASE WHEN m.pairs > 0 THEN r.route_id || '.primed' END AS primed_id, CASE WHEN m.pairs > 0 THEN 'from ' || CAST(m.px AS VARCHAR) || ' pixels' ELSE 'left as primed' END AS lesson FROM r LEFT JOIN m USING (part)"""))
def upgrade_routes(spark, sf):
    lib = X.library_rows(spark, sf).select("part", "pair_id", (F.col("patches") >= 190).alias("usable"), "pixels", F.lit(1.0).alias("mean"),
                                           F.lit(1.0).alias("grain"), F.lit(1.0).alias("local_contrast"), "patches", "size_px")
    routes = X.tree_leaf(spark).select("route_id", F.when(F.col("tree") == "lines", "lines").otherwise(F.substring_index("route_id", ".", -1)).alias("part"),
                                       "fallbacks", "confidence", "source", F.lit(None).cast("string").alias("primed_id"))
    return T.upgrade_routes(routes, T.accumulate_groups(lib))
