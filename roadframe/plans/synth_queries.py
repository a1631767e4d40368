"""Raster synthesis and tiles over the derived photos, masks and patches."""

from pyspark.sql import functions as F

from roadframe.functions.kernels import gaussian_weights
from roadframe.operators import memory as M, network as N, raster as A, synth as S
from roadframe.operators.common import materialize
from roadframe.plans import network_queries as NQ, training_queries as TQ
from roadframe.plans.memory_queries import BOTH
from roadframe.plans.raster_queries import AC, G, PER
from roadframe.plans.registry import blur_sql, gray, mix, nearest_sql, pick, pmod, query, sql
from roadframe.plans.stages import stage
from roadframe.sources import fixtures as X

R = lambda *cs: [F.round(c, 6).alias(c) for c in cs]
N_PATCH = "(SELECT count(*) FROM embeddings)"  # all patches of the library


def canvas(spark, sf):
    return NQ.dims(spark, sf)


def patches(spark, sf):
    p = X.patch_px(spark, sf)
    return p.select(F.col("vec_id").cast("int").alias("patch"), "y", "x", (F.col("v") > -0.1).alias("on_road"), "v")


_A, _B = mix("image_id", "7"), "(gy*65536+gx)*8"
PLACE = f"""pc AS (SELECT s_suppkey AS image_id, CAST(a.i AS INTEGER) AS gy, CAST(b.i AS INTEGER) AS gx FROM supplier CROSS JOIN range(14) AS a(i) CROSS JOIN range(14) AS b(i)),
pl AS (SELECT image_id, gy, gx, CAST(gy*6 - 8 + {pick(_A, _B, '5')} - 2 AS INTEGER) AS y, CAST(gx*6 - 8 + {pick(_A, _B + '+1', '5')} - 2 AS INTEGER) AS x, CAST({pick(_A, _B + '+2', N_PATCH)} AS INTEGER) AS patch,
 CAST({pick(_A, _B + '+3', '4')} AS INTEGER) AS k, CAST({pick(_A, _B + '+4', '2')} AS INTEGER) AS flip FROM pc)"""
LAYER = PLACE + """, pp AS (SELECT vec_id AS patch, y AS py, x AS px, v FROM patch_px WHERE v > -1e-1),
o1 AS (SELECT l.image_id, l.y, l.x, l.flip, v, CASE l.k WHEN 0 THEN py WHEN 1 THEN 7-px WHEN 2 THEN 7-py ELSE px END AS oy, CASE l.k WHEN 0 THEN px WHEN 1 THEN py WHEN 2 THEN 7-px ELSE 7-py END AS ox0 FROM pl l JOIN pp USING (patch)),
o2 AS (SELECT image_id, y, x, v, oy, CASE WHEN flip = 1 THEN 7-ox0 ELSE ox0 END AS ox FROM o1),
o3 AS (SELECT image_id, y+oy AS y, x+ox AS x, v, pow((least(oy,7-oy)+1)*(least(ox,7-ox)+1)/16e0, 3) AS w FROM o2),
layer AS (SELECT image_id, y, x, sum(v*w)/sum(w) AS v FROM o3 WHERE y BETWEEN 0 AND 63 AND x BETWEEN 0 AND 63 GROUP BY 1, 2, 3)"""


def places(spark, sf):
    return S.place_patches(canvas(spark, sf), 8, X.table(spark, sf, "embeddings").count())


def layer(spark, sf):
    return stage(spark, sf, "layer", lambda: S.synth_layer(places(spark, sf), patches(spark, sf), canvas(spark, sf), 8, ["v"]))


@query("place_patches", sql("", PLACE + " SELECT * FROM pl"))
def place_patches(spark, sf):
    return places(spark, sf)


@query("synth_layer", sql("patch_px", LAYER + " SELECT image_id, y, x, round(v, 6) AS v FROM layer"))
def synth_layer(spark, sf):
    return S.synth_layer(places(spark, sf), patches(spark, sf), canvas(spark, sf), 8, ["v"]).select("image_id", "y", "x", *R("v"))


@query("fill_nearest", sql("mask_px photo_px", f"fm AS (SELECT m.image_id, m.y, m.x, m.v > 128 AS f, {gray('p')} AS v FROM mask_px m JOIN photo_px p USING (image_id, y, x))," + nearest_sql("nf", "fm", "f") + """
SELECT n.image_id, n.y, n.x, s.v FROM nf n JOIN fm s ON s.image_id=n.image_id AND s.y=n.ty AND s.x=n.tx"""))
def fill_nearest(spark, sf):
    d = NQ.mask(spark, sf).select("image_id", "y", "x", (F.col("v") > 128).alias("f")).join(TQ.photo_gray(spark, sf), ["image_id", "y", "x"])
    return S.fill_nearest(d, "f", ["v"])


def _resize_sql(n, m):
    vals = ",".join(f"({o},{i},CAST({v!r} AS DOUBLE))" for o, i, v in S.resize_weights(n, m))
    return f"wt(o, i, w) AS (VALUES {vals})"


@query("resize_patches", sql("patch_px", _resize_sql(8, 5) + """ SELECT p.vec_id, CAST(a.o AS INTEGER) AS y, CAST(b.o AS INTEGER) AS x, round(sum(p.v*a.w*b.w), 6) AS v FROM patch_px p JOIN wt a ON a.i = p.y JOIN wt b ON b.i = p.x GROUP BY 1, 2, 3"""))
def resize_patches(spark, sf):
    return S.resize_patches(X.patch_px(spark, sf), ["vec_id"], 8, 0.6, ["v"]).select("vec_id", "y", "x", *R("v"))


@query("upscale_patches", sql("patch_px", _resize_sql(8, 12) + """ SELECT p.vec_id, CAST(a.o AS INTEGER) AS y, CAST(b.o AS INTEGER) AS x, round(sum(p.v*a.w*b.w), 6) AS v FROM patch_px p JOIN wt a ON a.i = p.y JOIN wt b ON b.i = p.x GROUP BY 1, 2, 3"""))
def upscale_patches(spark, sf):
    return S.resize_patches(X.patch_px(spark, sf), ["vec_id"], 8, 1.5, ["v"]).select("vec_id", "y", "x", *R("v"))


S_SDF = NQ.S_CLEAN + "," + nearest_sql("na", "roadall", "NOT road") + "," + nearest_sql("nb", "roadall", "road") + """,
sd0 AS (SELECT r.image_id, r.y, r.x, CASE WHEN r.road THEN sqrt(a.d2) - 5e-1 ELSE -(sqrt(b.d2) - 5e-1) END AS v FROM roadall r JOIN na a USING (image_id, y, x) JOIN nb b USING (image_id, y, x)),""" + blur_sql("sd", "sd0", ["v"], 1.0)


def coverage(spark, sf):
    return stage(spark, sf, "coverage", lambda: S.signed_distance(NQ.road(spark, sf), 1))


@query("signed_distance", NQ.Q(S_SDF, """, z(o, i, w) AS (SELECT o, i, CASE WHEN i = f THEN 1 - (c - f) ELSE c - f END FROM (SELECT o, o*63/127e0 AS c, floor(o*63/127e0) AS f FROM range(128) AS r(o)) q JOIN range(64) AS s(i) ON s.i = q.f OR (s.i = q.f + 1)),
u AS (SELECT d.image_id, a.o AS y, d.x, sum(d.v*a.w) AS v FROM sd d JOIN z a ON a.i = d.y GROUP BY 1, 2, 3), u2 AS (SELECT u.image_id, u.y, b.o AS x, 2*sum(u.v*b.w) AS v FROM u JOIN z b ON b.i = u.x GROUP BY 1, 2, 3)
SELECT image_id, count(*) AS pixels, round(avg(v), 6) AS mean_sdf, round(max(v), 6) AS max_sdf, round(sum(least(1e0, greatest(0e0, v + 5e-1)))/1e3, 6) AS covered, round(sum(v*(y*3 + x))/1e6, 6) AS checksum FROM u2 GROUP BY 1"""))
def signed_distance(spark, sf):
    d = S.signed_distance(NQ.road(spark, sf), 2)
    return d.groupBy("image_id").agg(F.count(F.lit(1)).alias("pixels"), F.round(F.avg("sdf"), 6).alias("mean_sdf"), F.round(F.max("sdf"), 6).alias("max_sdf"),
                                     F.round(F.sum("coverage") / 1000, 6).alias("covered"), F.round(F.sum(F.col("sdf") * (F.col("y") * 3 + F.col("x"))) / 1e6, 6).alias("checksum"))


def part_layers(spark, sf):
    p = TQ.photo(spark, sf).join(TQ.parts(spark, sf).select("image_id", "y", "x", "part"), ["image_id", "y", "x"], "left")
    return p.select("image_id", "y", "x", F.col("r").alias("layer_open"), F.col("g").alias("layer_edge"), F.col("b").alias("layer_junction"),
                    *[F.when(F.col("part") == q, 1.0).otherwise(0.0).alias(f"in_{q}") for q in ("open", "edge", "junction")])


@query("blend_groups", TQ.P(TQ.ALL, """, mk AS (SELECT f.image_id, f.y, f.x, f.r, f.g, f.b, CASE WHEN p.part='open' THEN 1e0 ELSE 0e0 END AS o, CASE WHEN p.part='edge' THEN 1e0 ELSE 0e0 END AS e, CASE WHEN p.part='junction' THEN 1e0 ELSE 0e0 END AS j FROM photo_px f LEFT JOIN parts p USING (image_id, y, x)),"""
                            + blur_sql("mb", "mk", ["o", "e", "j"], 1.5) + " SELECT k.image_id, k.y, k.x, round((k.r*b.o + k.g*b.e + k.b*b.j)/greatest(b.o+b.e+b.j, 1e-6), 6) AS v FROM mk k JOIN mb b USING (image_id, y, x)"))
def blend_groups(spark, sf):
    return S.blend_groups(part_layers(spark, sf), ["open", "edge", "junction"]).select("image_id", "y", "x", *R("v"))


@query("scale_grain", sql("photo_px", G + "," + blur_sql("lo", "gr", ["v"], 1.2) + " SELECT g.image_id, g.y, g.x, round(l.v + (g.v - l.v)*5e-1, 6) AS v FROM gr g JOIN lo l USING (image_id, y, x)"))
def scale_grain(spark, sf):
    return S.scale_grain(TQ.photo_gray(spark, sf), ["v"], 0.5).select("image_id", "y", "x", *R("v"))


def on_road_photo(spark, sf):
    return TQ.photo(spark, sf).join(NQ.road(spark, sf).withColumnRenamed("road", "on_road"), ["image_id", "y", "x"])


@query("match_tone", sql("mask_px photo_px", NQ.S_CLEAN + """, m AS (SELECT p.image_id, avg((p.r+p.g+p.b)/3e0) AS m FROM photo_px p JOIN road USING (image_id, y, x) GROUP BY 1)
SELECT p.image_id, round(avg(p.r + 1e2 - m.m), 6) AS r, round(avg(p.g + 1e2 - m.m), 6) AS g, round(avg(p.b + 1e2 - m.m), 6) AS b FROM photo_px p JOIN m USING (image_id) GROUP BY 1""", recursive=True))
def match_tone(spark, sf):
    d = S.match_tone(on_road_photo(spark, sf), ["r", "g", "b"], 100.0)
    return d.groupBy("image_id").agg(*[F.round(F.avg(c), 6).alias(c) for c in "rgb"])


def wear_layer(spark, sf):
    return layer(spark, sf).join(NQ.road(spark, sf).withColumnRenamed("road", "on_road"), ["image_id", "y", "x"])


S_WEAR = NQ.S_CLEAN + "," + LAYER + """, lq AS (SELECT l.image_id, quantile_cont(l.v, 5e-2) AS lo, quantile_cont(l.v, 95e-2) AS hi FROM layer l JOIN road USING (image_id, y, x) GROUP BY 1),
wr AS (SELECT l.image_id, l.y, l.x, least(1e0, greatest(0e0, (l.v - lo)/greatest(hi - lo, 1e-6))) AS wear FROM layer l JOIN lq USING (image_id))"""


def wear(spark, sf):
    return stage(spark, sf, "wear", lambda: S.wear_map(wear_layer(spark, sf)))


@query("wear_map", sql("mask_px patch_px", S_WEAR + " SELECT image_id, y, x, round(wear, 6) AS wear, round(200e0*(1 - 45e-2*5e-1*wear), 6) AS worn FROM wr", recursive=True))
def wear_map(spark, sf):
    d = S.wear_map(wear_layer(spark, sf))
    return d.select("image_id", "y", "x", *R("wear"), F.round(S.worn(F.lit(200.0), F.col("wear"), 0.5), 6).alias("worn"))


@query("composite_paint", sql("mask_px photo_px patch_px", S_SDF + S_WEAR[len(NQ.S_CLEAN):] + "," + """
cp AS (SELECT p.image_id, p.y, p.x, r.road, least(1e0, greatest(0e0, d.v + 5e-1)) AS cov, CASE WHEN r.road AND p.y = 32 AND p.x % 12 < 7 THEN 75e-2 ELSE 0e0 END AS a, coalesce(w.wear, 0e0) AS wear, p.r, p.g, p.b FROM photo_px p JOIN roadall r USING (image_id, y, x) JOIN sd d USING (image_id, y, x) LEFT JOIN wr w USING (image_id, y, x)),
cm AS (SELECT image_id, y, x, road, cov, r*(1-a) + a*235*(1 - wear*125e-3) AS r, g*(1-a) + a*232*(1 - wear*125e-3) AS g, b*(1-a) + a*222*(1 - wear*125e-3) AS b FROM cp),
fi AS (SELECT c.image_id, c.y, c.x, c.cov, s.r, s.g, s.b FROM cm c JOIN nb n USING (image_id, y, x) JOIN cm s ON s.image_id=c.image_id AND s.y=n.ty AND s.x=n.tx)
SELECT image_id, y, x, round(r*cov + 18*(1-cov), 6) AS r, round(g*cov + 18*(1-cov), 6) AS g, round(b*cov + 20*(1-cov), 6) AS b FROM fi""", recursive=True))
def composite_paint(spark, sf):
    d = (on_road_photo(spark, sf).join(coverage(spark, sf).select("image_id", "y", "x", "coverage"), ["image_id", "y", "x"])
         .join(wear(spark, sf).select("image_id", "y", "x", "wear"), ["image_id", "y", "x"], "left").na.fill(0.0, ["wear"]))
    d = d.withColumn("paint", F.when(F.col("on_road") & (F.col("y") == 32) & (F.col("x") % 12 < 7), 0.75).otherwise(0.0))
    return S.composite_paint(d, 0.5).select("image_id", "y", "x", *R("r", "g", "b"))


def numbered(spark, sf):
    from pyspark.sql import Window as W
    j = NQ.typed(spark, sf).filter("type <> 'not a junction'")
    # junctions of one image: a short list
    return j.withColumn("jid", F.row_number().over(W.partitionBy("image_id").orderBy("root")).cast("bigint"))


S_CODE = TQ.ALL + """, tj AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY root) AS jid FROM ty WHERE type <> 'not a junction'),
code AS (SELECT r.image_id, r.y, r.x, r.road, CASE p.part WHEN 'junction' THEN 1 WHEN 'edge' THEN 2 WHEN 'open' THEN 3 ELSE 0 END AS code,
 CASE WHEN r.road THEN coalesce((SELECT max(jid) FROM tj j WHERE j.image_id=r.image_id AND (r.y-j.cy)*(r.y-j.cy)+(r.x-j.cx)*(r.x-j.cx) <= j.r*j.r), 0) ELSE 0 END AS junction_id FROM roadall r LEFT JOIN parts p USING (image_id, y, x))"""


def codes(spark, sf):
    return stage(spark, sf, "codes", lambda: S.group_code_map(TQ.parts(spark, sf), NQ.road(spark, sf), numbered(spark, sf)))


@query("group_code_map", TQ.P(S_CODE, "SELECT image_id, y, x, code, junction_id FROM code"))
def group_code_map(spark, sf):
    return S.group_code_map(TQ.parts(spark, sf), NQ.road(spark, sf), numbered(spark, sf))


@query("generation_summary", TQ.P(S_CODE, """SELECT image_id, count(*) FILTER (code > 0) AS road_px, round(count(*) FILTER (code = 3)/greatest(1e0, count(*) FILTER (code > 0)), 6) AS open, round(count(*) FILTER (code = 2)/greatest(1e0, count(*) FILTER (code > 0)), 6) AS edge,
 round(count(*) FILTER (code = 1)/greatest(1e0, count(*) FILTER (code > 0)), 6) AS junction, count(DISTINCT junction_id) FILTER (junction_id > 0) AS junctions FROM code GROUP BY 1"""))
def generation_summary(spark, sf):
    return S.generation_summary(codes(spark, sf)).select("image_id", "road_px", *R("open", "edge", "junction"), "junctions")


# ------------------------------------------------------------------ tiles: 32 px, patches of 16 px
_TA = mix("image_id", "1")
TORUS = f"""tc AS (SELECT s_suppkey AS image_id, a.i AS gy, b.i AS gx FROM supplier CROSS JOIN range(3) AS a(i) CROSS JOIN range(3) AS b(i)),
tp AS (SELECT image_id, gy, gx, gy*12 + {pick(_TA, _B, '3')} - 1 AS y, gx*12 + {pick(_TA, _B + '+1', '3')} - 1 AS x, {pick(_TA, _B + '+2', '48')} AS sy, {pick(_TA, _B + '+3', '48')} AS sx, {pick(_TA, _B + '+4', '4')} AS k, {pick(_TA, _B + '+5', '2')} AS flip FROM tc),
t1 AS (SELECT t.*, p.i AS py, q.i AS px, CASE k WHEN 0 THEN p.i WHEN 1 THEN 15-q.i WHEN 2 THEN 15-p.i ELSE q.i END AS oy, CASE k WHEN 0 THEN q.i WHEN 1 THEN p.i WHEN 2 THEN 15-q.i ELSE 15-p.i END AS ox0 FROM tp t CROSS JOIN range(16) AS p(i) CROSS JOIN range(16) AS q(i)),
t2 AS (SELECT image_id, sy+py AS sy, sx+px AS sx, y, x, oy, CASE WHEN flip = 1 THEN 15-ox0 ELSE ox0 END AS ox FROM t1),
t3 AS (SELECT image_id, sy, sx, (y+oy+32) % 32 AS y, (x+ox+32) % 32 AS x, pow((least(oy,15-oy)+1)*(least(ox,15-ox)+1)/64e0, 3) AS w FROM t2),
tile AS (SELECT t.image_id, CAST(t.y AS INTEGER) AS y, CAST(t.x AS INTEGER) AS x, sum(p.r*w)/sum(w) AS r, sum(p.g*w)/sum(w) AS g, sum(p.b*w)/sum(w) AS b FROM t3 t JOIN photo_px p ON p.image_id=t.image_id AND p.y=t.sy AND p.x=t.sx GROUP BY 1, 2, 3)"""


def tile(spark, sf):
    return stage(spark, sf, "tile", lambda: S.torus_synth(S.torus_places(canvas(spark, sf), 32, 16), TQ.photo(spark, sf), 32, 16, ["r", "g", "b"]))


@query("torus_synth", sql("mask_px photo_px", TORUS + " SELECT image_id, y, x, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM tile"))
def torus_synth(spark, sf):
    return S.torus_synth(S.torus_places(canvas(spark, sf), 32, 16), TQ.photo(spark, sf), 32, 16, ["r", "g", "b"]).select("image_id", "y", "x", *R("r", "g", "b"))


CALM = TORUS + "," + blur_sql("tb", "tile", ["r", "g", "b"], 32 / 12, "wrap", 32) + """, tm AS (SELECT image_id, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM tile GROUP BY 1),
tf AS (SELECT t.image_id, t.y, t.x, t.r-b.r+m.r AS r, t.g-b.g+m.g AS g, t.b-b.b+m.b AS b FROM tile t JOIN tb b USING (image_id, y, x) JOIN tm m USING (image_id)),
tl AS (SELECT image_id, avg((r+g+b)/3) AS mu, stddev_pop((r+g+b)/3) + 1e-6 AS sd FROM tf GROUP BY 1),
tz AS (SELECT f.*, ((r+g+b)/3 - mu)/sd AS z, sd FROM tf f JOIN tl USING (image_id)),
calm AS (SELECT image_id, y, x, r + (tanh(z/25e-1)*25e-1 - z)*sd AS r, g + (tanh(z/25e-1)*25e-1 - z)*sd AS g, b + (tanh(z/25e-1)*25e-1 - z)*sd AS b FROM tz)"""


def calm(spark, sf):
    return stage(spark, sf, "calm", lambda: S.calm_tile(tile(spark, sf), 32))


@query("calm_tile", sql("mask_px photo_px", CALM + " SELECT image_id, y, x, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM calm"))
def calm_tile(spark, sf):
    return S.calm_tile(tile(spark, sf), 32).select("image_id", "y", "x", *R("r", "g", "b"))


@query("retone_tile", sql("mask_px photo_px", CALM + """, cmn AS (SELECT image_id, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM calm GROUP BY 1)
SELECT c.image_id, c.y, c.x, round(least(255, greatest(0, m.r - ((m.r+m.g+m.b)/3 - 120) + (c.r-m.r)*least(2e0, greatest(4e-1, c.image_id/5e1)))), 6) AS r,
 round(least(255, greatest(0, m.g - ((m.r+m.g+m.b)/3 - 120) + (c.g-m.g)*least(2e0, greatest(4e-1, c.image_id/5e1)))), 6) AS g, round(least(255, greatest(0, m.b - ((m.r+m.g+m.b)/3 - 120) + (c.b-m.b)*least(2e0, greatest(4e-1, c.image_id/5e1)))), 6) AS b FROM calm c JOIN cmn m USING (image_id)"""))
def retone_tile(spark, sf):
    return S.retone_tile(calm(spark, sf), F.col("image_id") / 50.0, F.lit(120.0)).select("image_id", "y", "x", *R("r", "g", "b"))


LUMA = CALM + ", lu AS (SELECT image_id, y, x, (r+g+b)/3 AS v FROM calm)"


def luma(spark, sf):
    return calm(spark, sf).select("image_id", "y", "x", ((F.col("r") + F.col("g") + F.col("b")) / 3.0).alias("v"))


SEAM = """dd AS (SELECT image_id, avg(abs(v - px)) AS dx, avg(abs(v - py)) AS dy FROM (SELECT *, lag(v) OVER (PARTITION BY image_id, y ORDER BY x) AS px, lag(v) OVER (PARTITION BY image_id, x ORDER BY y) AS py FROM lu) GROUP BY 1),
ax AS (SELECT a.image_id, avg(abs(a.v-b.v)) AS c FROM lu a JOIN lu b ON a.image_id=b.image_id AND a.y=b.y AND a.x=0 AND b.x=31 GROUP BY 1), ay AS (SELECT a.image_id, avg(abs(a.v-b.v)) AS c FROM lu a JOIN lu b ON a.image_id=b.image_id AND a.x=b.x AND a.y=0 AND b.y=31 GROUP BY 1)"""


@query("seam_score", sql("mask_px photo_px", LUMA + "," + SEAM + """
SELECT d.image_id, round((ax.c+ay.c)/2/greatest((dx+dy)/2, 1e-6), 6) AS seam FROM dd d JOIN ax USING (image_id) JOIN ay USING (image_id)"""))
def seam_score(spark, sf):
    return S.seam_score(luma(spark, sf)).select("image_id", *R("seam"))


@query("noticeability", sql("mask_px photo_px", LUMA + "," + blur_sql("nm", "lu", ["v"], 32 / 40, "wrap", 32) + "," + blur_sql("nv", "lu", ["v"], 1.5, "wrap", 32) + """
SELECT l.image_id, round(stddev_pop(m.v)/greatest(stddev_pop(l.v - f.v), 1e-6), 6) AS noticeability FROM lu l JOIN nm m USING (image_id, y, x) JOIN nv f USING (image_id, y, x) GROUP BY 1"""))
def noticeability(spark, sf):
    return S.noticeability(luma(spark, sf), 32).select("image_id", *R("noticeability"))


# the slab photo: the photo with joints every 9 columns and 7 rows
SLAB = f"gr AS (SELECT image_id, y, x, CASE WHEN x % 9 = 2 OR y % 7 = 3 THEN 20 ELSE 90 + (r + g + b + x*7 + y*13 + (x*y)%31) % 40 END AS v FROM photo_px)"
S_CROP = PER.replace(G, SLAB) + """, pq AS (SELECT p.image_id, p.axis, p.pos, p.p, CASE WHEN p.axis='x' THEN r.period_x ELSE r.period_y END AS k FROM prof p JOIN per r USING (image_id) WHERE r.period_x IS NOT NULL AND r.period_y IS NOT NULL),
mvm AS (SELECT a.image_id, a.axis, a.pos, any_value(a.p) AS p, sum(b.p)/any_value(a.k) AS m FROM pq a JOIN range(64) AS j(j) ON j.j < a.k JOIN pq b ON b.image_id=a.image_id AND b.axis=a.axis AND b.pos = (a.pos + j.j - a.k//2 + 64) % 64 WHERE a.pos < a.k GROUP BY 1, 2, 3),
phs AS (SELECT image_id, axis, arg_min(pos, round(-abs(p - m), 9)*1000000 + pos*1e-4) AS ph FROM mvm GROUP BY 1, 2),
cr AS (SELECT r.image_id, x.ph AS phx, y.ph AS phy, r.period_x AS kx, r.period_y AS ky, greatest(1, CAST(round_even(16e-1/(r.period_x*2e0/64), 0) AS INTEGER)) AS nx, greatest(1, CAST(round_even(16e-1/(r.period_y*2e0/64), 0) AS INTEGER)) AS ny FROM per r JOIN phs x ON x.image_id=r.image_id AND x.axis='x' JOIN phs y ON y.image_id=r.image_id AND y.axis='y'),
cz AS (SELECT *, nx*kx AS cw, ny*ky AS ch FROM cr), c3 AS (SELECT * FROM cz WHERE cw <= 64 AND ch <= 64),
c4 AS (SELECT *, phx + kx*""" + pick(mix("image_id", "1"), "0", "greatest(1, CAST(floor((64-phx-cw)/CAST(kx AS DOUBLE)) AS BIGINT)+1)") + " AS ax, phy + ky*" + pick(mix("image_id", "1"), "1", "greatest(1, CAST(floor((64-phy-ch)/CAST(ky AS DOUBLE)) AS BIGINT)+1)") + """ AS ay FROM c3)
SELECT image_id, CAST(CASE WHEN ax+cw > 64 OR ay+ch > 64 THEN phx ELSE ax END AS INTEGER) AS x0, CAST(CASE WHEN ax+cw > 64 OR ay+ch > 64 THEN phy ELSE ay END AS INTEGER) AS y0, cw, ch, nx, ny FROM c4"""


@query("period_crop", sql("photo_px", S_CROP))
def period_crop(spark, sf):
    x, y = F.col("x"), F.col("y")
    tone = (F.col("r") + F.col("g") + F.col("b") + x * 7 + y * 13 + (x * y) % 31) % 40 + 90
    g = TQ.photo(spark, sf).select("image_id", "y", "x", F.when((x % 9 == 2) | (y % 7 == 3), 20).otherwise(tone).alias("v"))
    prof = materialize(A.profiles(g))
    per = materialize(A.periodicity(A.autocorrelation(prof)))
    return S.period_crop(prof, per, canvas(spark, sf), 2.0, 1.6)


@query("tile_set", sql("library_rows review_log", BOTH + """,
ms AS (SELECT part, pair_id, 80 + size_px*2e0 AS mean, CASE WHEN pair_id % 5 = 0 THEN NULL ELSE 1 + patches/1e2 END AS lc FROM library_rows),
tp AS (SELECT i.part, m.mean, m.lc FROM idx i JOIN ms m USING (part, pair_id) WHERE i.rank = 1),
v AS (SELECT (SELECT mean FROM tp WHERE part='open') AS ot, coalesce((SELECT lc FROM tp WHERE part='open'), (SELECT lc FROM tp WHERE part='edge'), (SELECT lc FROM tp WHERE part='junction')) AS base),
r AS (SELECT tp.part, v.ot AS tone, coalesce(tp.lc/v.base, 1e0) AS ratio, tp.mean AS part_tone FROM tp CROSS JOIN v UNION ALL SELECT 'sidewalk', 165e0, 6e-1, 165e0)
SELECT part, tone, round(ratio, 6) AS ratio, part_tone, CAST(n.n AS INTEGER) AS variant FROM r CROSS JOIN range(1, 4) AS n(n)"""))
def tile_set(spark, sf):
    return part_tiles(spark, sf, 3).select("part", "tone", *R("ratio"), "part_tone", "variant")


def part_tiles(spark, sf, variants):
    lib = X.library_rows(spark, sf)
    m = lib.select("part", "pair_id", (F.col("size_px") * 2.0 + 80).alias("mean"), F.when(F.col("pair_id") % 5 == 0, None).otherwise(F.col("patches") / 100.0 + 1).alias("local_contrast"))
    return S.tile_set(M.replay_index(lib, X.review_log(spark, sf)), m, variants)


_RETONED = lambda c: f"least(255, greatest(0, m.{c} - coalesce((m.r+m.g+m.b)/3 - s.tone, 0) + (c.{c}-m.{c})*least(2e0, greatest(4e-1, s.ratio)))) AS {c}"


@query("tile_scores", sql("mask_px photo_px library_rows review_log", CALM + "," + BOTH + f""",
sms AS (SELECT part, pair_id, 80 + size_px*2e0 AS mean, CASE WHEN pair_id % 5 = 0 THEN NULL ELSE 1 + patches/1e2 END AS lc FROM library_rows), stp AS (SELECT i.part, m.mean, m.lc FROM idx i JOIN sms m USING (part, pair_id) WHERE i.rank = 1),
sv AS (SELECT (SELECT mean FROM stp WHERE part='open') AS ot, coalesce((SELECT lc FROM stp WHERE part='open'), (SELECT lc FROM stp WHERE part='edge'), (SELECT lc FROM stp WHERE part='junction')) AS base),
st AS (SELECT stp.part, sv.ot AS tone, coalesce(stp.lc/sv.base, 1e0) AS ratio FROM stp CROSS JOIN sv UNION ALL SELECT 'sidewalk', 165e0, 6e-1),
cmn AS (SELECT image_id, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM calm GROUP BY 1),
rt AS (SELECT s.part || '/' || CAST(c.image_id AS VARCHAR) AS image_id, c.y, c.x, {_RETONED('r')}, {_RETONED('g')}, {_RETONED('b')} FROM calm c JOIN cmn m USING (image_id) CROSS JOIN st s),
lu AS (SELECT image_id, y, x, (r+g+b)/3 AS v FROM rt), {{SEAM}}, """ .replace("{SEAM}", SEAM) + blur_sql("nm", "lu", ["v"], 32 / 40, "wrap", 32) + "," + blur_sql("nv", "lu", ["v"], 1.5, "wrap", 32) + """,
nt AS (SELECT l.image_id, stddev_pop(m.v)/greatest(stddev_pop(l.v - f.v), 1e-6) AS n FROM lu l JOIN nm m USING (image_id, y, x) JOIN nv f USING (image_id, y, x) GROUP BY 1)
SELECT s.part, CAST(split_part(d.image_id, '/', 2) AS BIGINT) AS variant, s.tone, round(s.ratio, 6) AS ratio, round((ax.c+ay.c)/2/greatest((dx+dy)/2, 1e-6), 6) AS seam, round(n.n, 6) AS noticeability
 FROM dd d JOIN ax USING (image_id) JOIN ay USING (image_id) JOIN nt n USING (image_id) JOIN st s ON s.part = split_part(d.image_id, '/', 1)"""))
def tile_scores(spark, sf):
    # a tile set's variants are the tiles made from the photos of the table
    tiles = calm(spark, sf).withColumnRenamed("image_id", "variant")
    return S.tile_scores(part_tiles(spark, sf, 1), tiles, 32).select("part", "variant", "tone", *R("ratio", "seam", "noticeability"))


@query("tile_settings", sql("review_log", """
s AS (SELECT DISTINCT pair_id AS set_id, CASE part WHEN 'open' THEN 'tile_m' WHEN 'edge' THEN 'px' ELSE 'variants' END AS name, CAST(pair_id AS DOUBLE) AS value FROM review_log WHERE outcome = 'accepted'),
a AS (SELECT pair_id AS set_id, 'px' AS name, max(value) AS value FROM review_log WHERE outcome = 'flagged' GROUP BY 1),
d(name, d) AS (VALUES ('photo_width_m', 2e0), ('tile_m', 4e0), ('px', 1024e0), ('variants', 3e0), ('sidewalk_width_m', 2e0)), i AS (SELECT set_id FROM s UNION SELECT set_id FROM a)
SELECT i.set_id, d.name, coalesce(a.value, s.value, d.d) AS value FROM i CROSS JOIN d LEFT JOIN s ON s.set_id=i.set_id AND s.name=d.name LEFT JOIN a ON a.set_id=i.set_id AND a.name=d.name"""))
def tile_settings(spark, sf):
    log = X.review_log(spark, sf)
    name = F.when(F.col("part") == "open", "tile_m").when(F.col("part") == "edge", "px").otherwise("variants")
    saved = log.filter("outcome = 'accepted'").select(F.col("pair_id").alias("set_id"), name.alias("name"), F.col("pair_id").cast("double").alias("value")).distinct()
    asked = log.filter("outcome = 'flagged'").groupBy(F.col("pair_id").alias("set_id")).agg(F.max("value").alias("value")).withColumn("name", F.lit("px"))
    return S.tile_settings(saved, asked)


@query("lag_repeat_check", sql("polyline", """p AS (SELECT street_id, seq, y AS v, count(*) OVER (PARTITION BY street_id) AS n, y - avg(y) OVER (PARTITION BY street_id) AS c FROM polyline),
l(lag) AS (VALUES (10), (8), (11), (12)), r AS (SELECT a.street_id, l.lag, sum(a.c*b.c)/greatest(sqrt(sum(a.c*a.c)*sum(b.c*b.c)), 1e-9) AS r FROM p a CROSS JOIN l JOIN p b ON b.street_id=a.street_id AND b.seq = a.seq + l.lag WHERE a.n >= 40 GROUP BY 1, 2)
SELECT street_id, round(max(r) FILTER (lag=10) - (2*max(r) FILTER (lag=8) + max(r) FILTER (lag=11) + max(r) FILTER (lag=12))/4, 6) AS repeat FROM r GROUP BY 1"""))
def lag_repeat_check(spark, sf):
    p = X.polyline(spark, sf).select("street_id", "seq", F.col("y").alias("v"))
    return S.lag_repeat_check(p, "street_id", 10).select("street_id", *R("repeat"))


@query("variation_factor", sql("mask_px photo_px", NQ.S_CLEAN + f""", vg AS (SELECT r.image_id, r.y, r.x, r.road AND {gray('p')} <= 128 AS good, CAST({gray('p')} AS DOUBLE) AS v FROM roadall r JOIN photo_px p USING (image_id, y, x)),""" + nearest_sql("vn", "vg", "good") + """,
vf AS (SELECT n.image_id, n.y, n.x, s.v FROM vn n JOIN vg s ON s.image_id=n.image_id AND s.y=n.ty AND s.x=n.tx),""" + blur_sql("vb", "vf", ["v"], 6.0) + """, vm AS (SELECT b.image_id, quantile_cont(b.v, 5e-1) AS med FROM vb b JOIN vg g USING (image_id, y, x) WHERE g.good GROUP BY 1)
SELECT b.image_id, b.y, b.x, round(least(13e-1, greatest(7e-1, 1 + (b.v/greatest(m.med, 1e-6) - 1)*8e-1)), 6) AS factor FROM vb b JOIN vm m USING (image_id)""", recursive=True))
def variation_factor(spark, sf):
    d = NQ.road(spark, sf).join(TQ.photo_gray(spark, sf), ["image_id", "y", "x"]).select("image_id", "y", "x", "v", (F.col("road") & (F.col("v") <= 128)).alias("good"))
    return S.variation_factor(d, 0.5, 0.8).select("image_id", "y", "x", *R("factor"))
