"""Road masks to junctions, arms and streets."""

from pyspark.sql import functions as F

from roadframe.operators import network as N
from roadframe.plans.registry import BIG, nearest_sql, query, r6, regions_sql, sql
from roadframe.plans.stages import stage
from roadframe.sources import fixtures as X

R = lambda *cs: [F.round(c, 6).alias(c) for c in cs]

# ------------------------------------------------------------------ stages
def mask(spark, sf):
    return stage(spark, sf, "mask", lambda: X.mask_px(spark, sf))


def road(spark, sf):
    return stage(spark, sf, "road", lambda: N.clean_mask(mask(spark, sf))[0])


def dims(spark, sf):
    return stage(spark, sf, "dims", lambda: mask(spark, sf).groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w")))


def dt(spark, sf):
    return stage(spark, sf, "dt", lambda: N.distance_transform(road(spark, sf).select("image_id", "y", "x", F.col("road").alias("inside"))).filter("inside"))


def sk(spark, sf):
    return stage(spark, sf, "sk", lambda: N.skeleton(road(spark, sf).filter("road").select("image_id", "y", "x")))


def deg(spark, sf):
    return stage(spark, sf, "deg", lambda: N.skeleton_degree(sk(spark, sf)))


def cands(spark, sf):
    return stage(spark, sf, "cands", lambda: N.junction_candidates(deg(spark, sf), dt(spark, sf)))


def junctions(spark, sf):
    return stage(spark, sf, "js", lambda: N.junction_summary(N.merge_candidates(cands(spark, sf))))


def segments(spark, sf):
    return stage(spark, sf, "seg", lambda: N.street_segments(sk(spark, sf), junctions(spark, sf)))


def arms(spark, sf):
    def build():
        a = N.junction_arms(junctions(spark, sf), segments(spark, sf), dt(spark, sf))
        a = N.materialize(a)
        return a.unionByName(N.border_arms(junctions(spark, sf), road(spark, sf), dims(spark, sf), a))
    return stage(spark, sf, "arms", build)


def typed(spark, sf):
    return stage(spark, sf, "typed", lambda: N.junction_type(junctions(spark, sf), N.arm_gaps(arms(spark, sf))))


# ------------------------------------------------------------------ the same chain in SQL
S_CLEAN = ("hp AS (SELECT image_id, y, x FROM mask_px WHERE v <= 128)," + regions_sql("hl", "hp") + "," + nearest_sql("hd", "mask_px", "v > 128") + """,
hr AS (SELECT l.image_id, l.label, 2*max(sqrt(d.d2)) AS gap, count(*) AS area FROM hl l JOIN hd d USING (image_id, y, x) GROUP BY 1, 2),
hw AS (SELECT *, CASE WHEN gap <= 3 AND area < 40 THEN 'speck' WHEN gap <= 6 AND area >= 40 THEN 'divider' WHEN area >= 40 AND gap/2 <= 12 THEN 'left' END AS what FROM hr),
on1 AS (SELECT image_id, y, x FROM mask_px WHERE v > 128 UNION ALL SELECT l.image_id, l.y, l.x FROM hl l JOIN hw w ON w.image_id=l.image_id AND w.label=l.label WHERE w.what IN ('speck','divider')),"""
           + regions_sql("rl", "on1") + """,
road AS (SELECT l.image_id, l.y, l.x FROM rl l JOIN (SELECT image_id, label FROM rl GROUP BY 1, 2 HAVING count(*) >= 60) b USING (image_id, label)),
roadall AS (SELECT m.image_id, m.y, m.x, r.image_id IS NOT NULL AS road FROM mask_px m LEFT JOIN road r USING (image_id, y, x))""")
S_DT = S_CLEAN + "," + nearest_sql("nd", "roadall", "NOT road") + ", dt AS (SELECT n.image_id, n.y, n.x, sqrt(n.d2) AS dist FROM nd n JOIN road USING (image_id, y, x))"


def thin_sql(name: str, src: str, rounds: int = 16) -> str:
    # offsets clockwise from the pixel above; bit i of nb is set when that neighbour is present
    return f"""{name}_o(dy, dx, bit) AS (VALUES (-1,0,1),(-1,1,2),(0,1,4),(1,1,8),(1,0,16),(1,-1,32),(0,-1,64),(-1,-1,128)),
{name}_t(it, image_id, y, x) AS (SELECT 0, image_id, y, x FROM {src} UNION ALL
 SELECT it, image_id, y, x FROM (
  SELECT c.it + 1 AS it, c.image_id, c.y, c.x, coalesce(n.nb, 0) AS nb FROM {name}_t c LEFT JOIN
   (SELECT t.image_id, t.y - o.dy AS y, t.x - o.dx AS x, CAST(sum(o.bit) AS INT) AS nb FROM {name}_t t CROSS JOIN {name}_o o GROUP BY 1, 2, 3) n
   ON n.image_id = c.image_id AND n.y = c.y AND n.x = c.x WHERE c.it < {2 * rounds}) q
 WHERE NOT (bit_count(nb) BETWEEN 2 AND 6 AND bit_count((~nb) & ((nb >> 1) | ((nb & 1) << 7)) & 255) = 1
  AND CASE WHEN it % 2 = 1 THEN (nb & 21) <> 21 AND (nb & 84) <> 84 ELSE (nb & 69) <> 69 AND (nb & 81) <> 81 END)),
{name} AS (SELECT image_id, y, x FROM {name}_t WHERE it = {2 * rounds})"""


S_SK = S_DT + "," + thin_sql("sk", "road")
S_DEG = S_SK + """, o8(dy, dx) AS (VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)),
dn AS (SELECT image_id, y+dy AS y, x+dx AS x, count(*) AS n FROM sk CROSS JOIN o8 GROUP BY 1, 2, 3),
deg AS (SELECT s.image_id, s.y, s.x, CAST(coalesce(n.n, 0) AS INTEGER) AS deg FROM sk s LEFT JOIN dn n USING (image_id, y, x))"""
S_CAND = S_DEG + """, o5(dy, dx) AS (VALUES (0,0),(-1,0),(1,0),(0,-1),(0,1)),
gw AS (SELECT DISTINCT image_id, y+dy AS y, x+dx AS x FROM deg CROSS JOIN o5 WHERE deg >= 3), sp AS (SELECT g.* FROM gw g JOIN sk USING (image_id, y, x)),""" + regions_sql("cl", "sp") + """,
c0 AS (SELECT image_id, label AS cand_id, avg(y) AS y, avg(x) AS x FROM cl GROUP BY 1, 2),
cand AS (SELECT c.image_id, c.cand_id, c.y, c.x, coalesce((SELECT max(d.dist) FROM dt d WHERE d.image_id = c.image_id AND d.y BETWEEN floor(c.y)-6 AND floor(c.y)+6 AND d.x BETWEEN floor(c.x)-6 AND floor(c.x)+6), 0e0) AS hw FROM c0 c)"""


def merge_sql(src: str, name: str = "mg") -> str:
    return f"""{name}_e AS (SELECT a.image_id, a.cand_id AS u, b.cand_id AS v FROM {src} a JOIN {src} b ON a.image_id=b.image_id AND a.cand_id<>b.cand_id AND sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) < 16e-1*(a.hw+b.hw)),
{name}_c AS (SELECT image_id, cand_id AS src, cand_id AS cur FROM {src} UNION SELECT c.image_id, c.src, e.v FROM {name}_c c JOIN {name}_e e ON e.image_id=c.image_id AND e.u=c.cur),
{name} AS (SELECT s.image_id, s.cand_id, s.x, s.y, s.hw, r.root FROM {src} s JOIN (SELECT image_id, src, min(cur) AS root FROM {name}_c GROUP BY 1, 2) r ON r.image_id=s.image_id AND r.src=s.cand_id),
{name}_m AS (SELECT image_id, root, avg(y) AS cy, avg(x) AS cx, max(hw) AS hw, count(*) AS n_cand FROM {name} GROUP BY 1, 2),
{name}_j AS (SELECT m.image_id, m.root, m.cy, m.cx, m.hw, m.n_cand, s.spread, greatest(6e0, 2*m.hw + s.spread) AS r FROM {name}_m m
 JOIN (SELECT g.image_id, g.root, max(sqrt((g.x-m.cx)*(g.x-m.cx)+(g.y-m.cy)*(g.y-m.cy))) AS spread FROM {name} g JOIN {name}_m m USING (image_id, root) GROUP BY 1, 2) s USING (image_id, root))"""


S_JS = S_CAND + "," + merge_sql("cand")
S_SEG = S_JS + """, so AS (SELECT s.* FROM sk s WHERE NOT EXISTS (SELECT 1 FROM mg_j j WHERE j.image_id = s.image_id AND (s.y-j.cy)*(s.y-j.cy)+(s.x-j.cx)*(s.x-j.cx) <= j.r*j.r)),""" + regions_sql("seg", "so", True)
_ANG = lambda dy, dx: f"round((CASE WHEN degrees(atan2(-({dy}), {dx})) < 0 THEN degrees(atan2(-({dy}), {dx})) + 360 ELSE degrees(atan2(-({dy}), {dx})) END), 1)"
S_ARM = S_SEG + f""", sd AS (SELECT s.*, d.dist, j.root, j.cy, j.cx, j.r, j.hw, sqrt((s.y-j.cy)*(s.y-j.cy)+(s.x-j.cx)*(s.x-j.cx)) AS q FROM seg s JOIN dt d USING (image_id, y, x) JOIN mg_j j ON j.image_id = s.image_id),
rg AS (SELECT DISTINCT image_id, root, label FROM sd WHERE q <= r + 25e-1),
am AS (SELECT sd.image_id, sd.root, sd.label, any_value(cy) AS cy, any_value(cx) AS cx, count(*) FILTER (q >= r AND q <= r + greatest(12, 4*hw)) AS n,
 avg(y) FILTER (q >= r AND q <= r + greatest(12, 4*hw)) AS y0, avg(x) FILTER (q >= r AND q <= r + greatest(12, 4*hw)) AS x0, quantile_cont(dist, 5e-1) FILTER (q >= r AND q <= r + greatest(12, 4*hw)) AS w0,
 avg(y) FILTER (q <= r + 12) AS y1, avg(x) FILTER (q <= r + 12) AS x1, quantile_cont(dist, 5e-1) FILTER (q <= r + 12) AS w1 FROM sd JOIN rg USING (image_id, root, label) GROUP BY 1, 2, 3),
arms1 AS (SELECT image_id, root, label AS segment, CASE WHEN n >= 3 THEN {_ANG('y0-cy', 'x0-cx')} ELSE {_ANG('y1-cy', 'x1-cx')} END AS angle, round(2*CASE WHEN n >= 3 THEN w0 ELSE w1 END, 1) AS width_px FROM am)"""
S_BORDER = S_ARM + f""", rim AS (SELECT r.image_id*100000000 + CAST(floor(j.root / {BIG}.0) * 1000 + j.root % {BIG} AS BIGINT) AS image_id, r.image_id AS img, j.root, j.cy, j.cx, r.y, r.x FROM road r JOIN mg_j j ON j.image_id = r.image_id
 WHERE (r.y IN (0, 63) OR r.x IN (0, 63)) AND (r.y-j.cy)*(r.y-j.cy)+(r.x-j.cx)*(r.x-j.cx) <= (j.r+8)*(j.r+8)),""" + regions_sql("bl", "rim", True) + f""",
bc AS (SELECT t.img AS image_id, t.root, b.label, {_ANG('avg(t.y)-any_value(t.cy)', 'avg(t.x)-any_value(t.cx)')} AS angle, CAST(count(*) AS DOUBLE) AS width_px FROM rim t JOIN bl b USING (image_id, y, x) GROUP BY 1, 2, 3),
bf AS (SELECT c.* FROM bc c WHERE NOT EXISTS (SELECT 1 FROM arms1 a WHERE a.image_id=c.image_id AND a.root=c.root AND abs(((c.angle-a.angle+180+360) % 360) - 180) <= 25)),
bo AS (SELECT *, row_number() OVER (PARTITION BY image_id, root ORDER BY label) AS n FROM bf),
bg AS (SELECT image_id, root, n, angle, width_px, true AS good, [angle] AS kept FROM bo WHERE n = 1
 UNION ALL SELECT image_id, root, n, angle, width_px, good, CASE WHEN good THEN list_append(kept, angle) ELSE kept END FROM
 (SELECT b.image_id, b.root, b.n, b.angle, b.width_px, len([k FOR k IN g.kept IF abs(((b.angle-k+180+360) % 360) - 180) <= 25]) = 0 AS good, g.kept
  FROM bg g JOIN bo b ON b.image_id=g.image_id AND b.root=g.root AND b.n = g.n + 1)),
bk AS (SELECT * FROM bg WHERE good),
arms AS (SELECT image_id, root, segment, angle, width_px, false AS off_image FROM arms1 UNION ALL SELECT image_id, root, NULL, angle, width_px, true FROM bk)"""
S_GAP = S_BORDER + """, gp AS (SELECT *, coalesce(lead(angle) OVER w, first_value(angle) OVER w) AS nx FROM arms WINDOW w AS (PARTITION BY image_id, root ORDER BY angle, coalesce(segment, -1))),
gaps AS (SELECT image_id, root, segment, angle, width_px, off_image, round((nx - angle + 360) % 360, 1) AS gap FROM gp)"""
S_TYPE = S_GAP + """, kk AS (SELECT image_id, root, count(*) AS k, bool_and(abs(gap - 90) <= 20) AS square FROM gaps GROUP BY 1, 2),
st AS (SELECT a.image_id, a.root, bool_or(abs(((a.angle-b.angle+360) % 360) - 180) <= 20) AS straight FROM arms a JOIN arms b ON a.image_id=b.image_id AND a.root=b.root AND a.angle <> b.angle GROUP BY 1, 2),
ty AS (SELECT j.*, coalesce(k.k, 0) AS k, CASE WHEN n_cand >= 5 OR coalesce(k.k, 0) >= 7 THEN 'interchange (flagged)' WHEN coalesce(k.k, 0) <= 2 THEN 'not a junction' WHEN k.k = 3 THEN CASE WHEN straight THEN 'T-junction' ELSE 'Y / skewed' END
 WHEN k.k = 4 THEN CASE WHEN square THEN 'crossroads' ELSE 'skewed crossroads' END ELSE 'complex' END AS type FROM mg_j j LEFT JOIN kk k USING (image_id, root) LEFT JOIN st USING (image_id, root))"""
Q = lambda chain, tail: sql("mask_px", chain + " " + tail, recursive=True)


@query("clean_mask", Q(S_CLEAN, """SELECT image_id, count(*) FILTER (what='speck') AS specks_filled, count(*) FILTER (what='divider') AS dividers_merged, count(*) FILTER (what='left') AS gaps_left_split,
 any_value((SELECT count(*) FROM road r WHERE r.image_id = hw.image_id)) AS road_px FROM hw GROUP BY 1"""))
def clean_mask(spark, sf):
    r, counts = N.clean_mask(mask(spark, sf))
    return counts.join(r.groupBy("image_id").agg(F.count_if("road").alias("road_px")), "image_id")


@query("label_components", sql("mask_px", "rp AS (SELECT image_id, y, x FROM mask_px WHERE v > 128)," + regions_sql("cc", "rp") + " SELECT image_id, label, count(*) AS pixels, max(y) AS y1, max(x) AS x1 FROM cc GROUP BY 1, 2", recursive=True))
def label_components(spark, sf):
    return N.label_components(X.mask_px(spark, sf).filter("v > 128")).groupBy("image_id", "label").agg(
        F.count(F.lit(1)).alias("pixels"), F.max("y").alias("y1"), F.max("x").alias("x1"))


@query("distance_transform", sql("mask_px", nearest_sql("nd", "mask_px", "v <= 128") + " SELECT n.image_id, n.y, n.x, round(sqrt(n.d2), 6) AS dist FROM nd n"))
def distance_transform(spark, sf):
    m = X.mask_px(spark, sf).select("image_id", "y", "x", (F.col("v") > 128).alias("inside"))
    return N.distance_transform(m).select("image_id", "y", "x", *R("dist"))


@query("skeleton", Q(S_SK, "SELECT * FROM sk"))
def skeleton(spark, sf):
    return N.skeleton(road(spark, sf).filter("road").select("image_id", "y", "x"))


@query("prune_spurs")
def prune_spurs(spark, sf):
    return N.prune_spurs(sk(spark, sf), dt(spark, sf), dims(spark, sf))[0]


@query("skeleton_degree", Q(S_DEG, "SELECT * FROM deg"))
def skeleton_degree(spark, sf):
    return N.skeleton_degree(sk(spark, sf))


@query("junction_candidates", Q(S_CAND, "SELECT image_id, cand_id, round(y, 6) AS y, round(x, 6) AS x, round(hw, 6) AS hw FROM cand"))
def junction_candidates(spark, sf):
    return N.junction_candidates(deg(spark, sf), dt(spark, sf)).select("image_id", "cand_id", *R("y", "x", "hw"))


@query("merge_candidates", sql("candidates", merge_sql("candidates") + " SELECT image_id, cand_id, root FROM mg", recursive=True))
def merge_candidates(spark, sf):
    return N.merge_candidates(X.candidates(spark, sf)).select("image_id", "cand_id", "root")


@query("junction_summary", sql("candidates", merge_sql("candidates") + " SELECT image_id, root, round(cy, 6) AS cy, round(cx, 6) AS cx, hw, n_cand, round(spread, 6) AS spread, round(r, 6) AS r FROM mg_j", recursive=True))
def junction_summary(spark, sf):
    return N.junction_summary(N.merge_candidates(X.candidates(spark, sf))).select("image_id", "root", *R("cy", "cx"), "hw", "n_cand", *R("spread", "r"))


@query("street_segments", Q(S_SEG, "SELECT image_id, label, count(*) AS pixels, min(y) < 3 OR min(x) < 3 OR max(y) >= 61 OR max(x) >= 61 AS off_image FROM seg GROUP BY 1, 2"))
def street_segments(spark, sf):
    return N.segments_off_image(N.street_segments(sk(spark, sf), junctions(spark, sf)), dims(spark, sf))


@query("junction_arms", Q(S_ARM, "SELECT image_id, root, segment, angle, width_px FROM arms1"))
def junction_arms(spark, sf):
    return N.junction_arms(junctions(spark, sf), segments(spark, sf), dt(spark, sf)).drop("off_image")


@query("border_arms", Q(S_BORDER, "SELECT image_id, root, angle, width_px, off_image FROM arms WHERE off_image"))
def border_arms(spark, sf):
    a = N.junction_arms(junctions(spark, sf), segments(spark, sf), dt(spark, sf))
    return N.border_arms(junctions(spark, sf), road(spark, sf), dims(spark, sf), a).drop("segment")


@query("arm_gaps", Q(S_GAP, "SELECT image_id, root, segment, angle, gap FROM gaps"))
def arm_gaps(spark, sf):
    return N.arm_gaps(arms(spark, sf)).select("image_id", "root", "segment", "angle", "gap")


@query("junction_type", Q(S_TYPE, "SELECT image_id, root, n_cand, k, type FROM ty"))
def junction_type(spark, sf):
    return N.junction_type(junctions(spark, sf), N.arm_gaps(arms(spark, sf))).select("image_id", "root", "n_cand", "k", "type")


@query("mouth_lines", Q(S_BORDER, """SELECT a.image_id, a.root, a.angle, round(j.cx + cos(radians(angle))*j.r + sin(radians(angle))*greatest(3e0, 7e-1*width_px), 6) AS x0,
 round(j.cy - sin(radians(angle))*j.r + cos(radians(angle))*greatest(3e0, 7e-1*width_px), 6) AS y0, round(j.cx + cos(radians(angle))*j.r - sin(radians(angle))*greatest(3e0, 7e-1*width_px), 6) AS x1,
 round(j.cy - sin(radians(angle))*j.r - cos(radians(angle))*greatest(3e0, 7e-1*width_px), 6) AS y1 FROM arms a JOIN mg_j j USING (image_id, root)"""))
def mouth_lines(spark, sf):
    return N.mouth_lines(arms(spark, sf), junctions(spark, sf)).select("image_id", "root", "angle", *R("x0", "y0", "x1", "y1"))


@query("network_summary", Q(S_TYPE, """, wd AS (SELECT s.image_id, 2*quantile_cont(d.dist, 5e-1) AS m, 2*max(d.dist) AS x FROM sk s JOIN dt d USING (image_id, y, x) GROUP BY 1),
kd AS (SELECT image_id, type, count(*) AS n FROM ty WHERE type <> 'not a junction' GROUP BY 1, 2), kb AS (SELECT image_id, string_agg(type || '=' || CAST(n AS VARCHAR), ';' ORDER BY type) AS by_type, CAST(sum(n) AS BIGINT) AS junctions FROM kd GROUP BY 1),
sc AS (SELECT image_id, count(DISTINCT label) AS segments FROM seg GROUP BY 1)
SELECT r.image_id, r.road_px, round(coalesce(w.m, 0e0), 6) AS width_median, round(coalesce(w.x, 0e0), 6) AS width_max, coalesce(by_type, '') AS by_type, coalesce(junctions, 0) AS junctions, coalesce(segments, 0) AS segments
 FROM (SELECT image_id, count(*) FILTER (road) AS road_px FROM roadall GROUP BY 1) r LEFT JOIN wd w USING (image_id) LEFT JOIN kb USING (image_id) LEFT JOIN sc USING (image_id)"""))
def network_summary(spark, sf):
    s = N.network_summary(road(spark, sf), sk(spark, sf), dt(spark, sf), typed(spark, sf), segments(spark, sf))
    return s.select("image_id", "road_px", *R("width_median", "width_max"), "by_type", "junctions", "segments")


@query("detect_network")
def detect_network(spark, sf):
    d = N.detect(X.mask_px(spark, sf))
    return N.network_summary(d["road"], d["skeleton"], d["dt"], d["junctions"], d["segments"])
