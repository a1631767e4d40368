"""Route and library choice, and review rules."""

from pyspark.sql import functions as F

from roadframe.operators import memory as M, routing as R
from roadframe.plans.memory_queries import ATTEMPTS, BOTH, attempts, fold
from roadframe.plans.registry import query, r6, sql
from roadframe.sources import fixtures as X


# ------------------------------------------------------------------ trees, one per supplier
def tree_nodes(spark, sf):
    s = X.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("tree"), F.col("s_acctbal").alias("bal"))
    rows = [(0, None, None, None), (1, 0, "yes", "junction"), (2, 0, "no", None), (3, 2, "under 1.5 m", "edge"),
            (4, 2, "1.5 m or more", "open")]
    tmpl = F.array(*[F.struct(F.lit(n).alias("node"), F.lit(p).cast("int").alias("parent"),
                              F.lit(a).cast("string").alias("answer"), F.lit(r).cast("string").alias("route"))
                     for n, p, a, r in rows])
    d = s.select("tree", "bal", F.explode(tmpl).alias("t")).select("tree", "bal", "t.*")
    rid = F.concat(F.lit("material."), "route")
    return d.select("tree", "node", "parent", "answer", rid.alias("route_id"),
                    F.when(F.col("bal") > 4000, F.concat(rid, F.lit(".primed"))).alias("primed_id"))


@query("index_routes", sql("", """
t(path, route) AS (VALUES ('yes','junction'),('no/under 1.5 m','edge'),('no/1.5 m or more','open'))
SELECT s_suppkey AS tree, path, 'material.' || route AS route_id, false AS is_primed FROM supplier CROSS JOIN t
UNION ALL SELECT s_suppkey, path, 'material.' || route || '.primed', true FROM supplier CROSS JOIN t WHERE s_acctbal > 4000"""))
def index_routes(spark, sf):
    return R.index_routes(tree_nodes(spark, sf))


TYPES = ["T-junction", "Y / skewed", "crossroads", "interchange (flagged)"]


@query("features_for", sql("review_log", """
SELECT step_id, part, CASE WHEN part='junction' THEN 'y' ELSE 'n' END AS junction,
 CASE WHEN part='junction' THEN CASE step_id % 4 WHEN 0 THEN 'T-junction' WHEN 1 THEN 'Y_/_skewed' WHEN 2 THEN 'crossroads' ELSE 'interchange_flagged' END END AS type FROM review_log"""))
def features_for(spark, sf):
    kind = F.get(F.array(*[F.lit(t) for t in TYPES]), (F.col("step_id") % 4).cast("int"))
    d = X.review_log(spark, sf).select("step_id", R.features_for(F.col("part"), kind).alias("f"))
    return d.select("step_id", *[F.col("f")[k].alias(k) for k in ("part", "junction", "type")])


def leaf_routes(spark):
    return X.tree_leaf(spark).select("tree", "route_id", "fallbacks",
                                     F.concat("route_id", F.lit(".primed")).alias("primed_id"))


@query("candidates_for", sql("review_log tree_leaf", """
base AS (SELECT part, count(*) AS reviews FROM review_log GROUP BY part),
c AS (SELECT route_id, 0 AS pos, route_id AS cand FROM tree_leaf UNION ALL
 SELECT t.route_id, 1, t.fallbacks FROM tree_leaf t WHERE fallbacks IN (SELECT route_id FROM tree_leaf) UNION ALL
 SELECT route_id, 1048576, route_id || '.primed' FROM tree_leaf)
SELECT b.part, b.reviews, c.pos, c.cand FROM base b JOIN c ON c.route_id = 'material.' || b.part"""))
def candidates_for(spark, sf):
    base = X.review_log(spark, sf).groupBy("part").agg(F.count(F.lit(1)).alias("reviews"))
    c = R.candidates_for(leaf_routes(spark))
    return base.join(c, F.concat(F.lit("material."), "part") == F.col("route_id")).select("part", "reviews", "pos", "cand")


def route_attempts(spark, sf):
    return X.review_log(spark, sf).select(
        F.concat("part", F.lit("/"), F.floor(F.col("step_id") / 30).cast("string")).alias("key"), "step_id", "outcome", "part",
        F.when(F.col("step_id") % 97 < 50, F.concat(F.lit("material."), "part")).otherwise("material.open").alias("route"))


@query("choose_route", sql("review_log tree_leaf", """
a AS (SELECT part || '/' || CAST(step_id // 30 AS VARCHAR) AS key, part, outcome, CASE WHEN step_id % 97 < 50 THEN 'material.' || part ELSE 'material.open' END AS route FROM review_log),
k AS (SELECT DISTINCT key, part FROM a),
c AS (SELECT route_id, 0 AS pos, route_id AS cand FROM tree_leaf UNION ALL
 SELECT t.route_id, 1, t.fallbacks FROM tree_leaf t WHERE fallbacks IN (SELECT route_id FROM tree_leaf) UNION ALL
 SELECT route_id, 1048576, route_id || '.primed' FROM tree_leaf),
x AS (SELECT k.key, c.cand, c.pos, EXISTS (SELECT 1 FROM a WHERE a.key = k.key AND a.outcome = 'rejected' AND a.route = c.cand) AS rej FROM k JOIN c ON c.route_id = 'material.' || k.part)
SELECT key, arg_min(cand, pos + CASE WHEN rej THEN 10000000 ELSE 0 END) AS route, bool_and(rej) AS exhausted FROM x GROUP BY key"""))
def choose_route(spark, sf):
    a = route_attempts(spark, sf)
    asks = a.select("key", F.concat(F.lit("material."), "part").alias("route_id")).distinct()
    return R.choose_route(asks, R.candidates_for(leaf_routes(spark)), a)


@query("route_for_group", sql("review_log tree_leaf", """
p AS (SELECT step_id, part, value, CASE step_id % 3 WHEN 0 THEN 'material' WHEN 1 THEN 'noise' ELSE 'lines' END AS tree FROM review_log),
q AS (SELECT step_id, tree, CASE tree WHEN 'material' THEN CASE part WHEN 'junction' THEN 'yes' WHEN 'edge' THEN 'no/under 1.5 m' ELSE 'no/1.5 m or more' END
 WHEN 'noise' THEN CASE part WHEN 'junction' THEN 'yes' ELSE 'no' END
 ELSE CASE WHEN value >= 50 THEN 'no' WHEN part = 'junction' THEN 'yes/yes' ELSE 'yes/no' END END AS path FROM p)
SELECT q.step_id, q.tree, q.path, t.route_id FROM q JOIN tree_leaf t ON t.tree = q.tree AND t.path = q.path"""))
def route_for_group(spark, sf):
    m = F.col("step_id") % 3
    d = X.review_log(spark, sf).withColumn("tree", F.when(m == 0, "material").when(m == 1, "noise").otherwise("lines"))
    d = d.select("step_id", "tree", R.route_for_group(F.col("tree"), F.col("part"), F.col("part") == "junction",
                                                      F.col("value") < 50).alias("path"))
    return d.join(F.broadcast(X.tree_leaf(spark).select("tree", "path", "route_id")), ["tree", "path"])


@query("route_outcome", sql("review_log", """
e AS (SELECT 'material.' || part || '@' || CAST(pair_id AS VARCHAR) AS route_id, step_id, outcome FROM review_log WHERE outcome IN ('accepted','rejected','flagged')),
f AS (SELECT route_id, list(CASE outcome WHEN 'accepted' THEN -1 ELSE -2 END ORDER BY step_id) FILTER (outcome <> 'flagged') AS l, count(*) AS visits,
 count(*) FILTER (outcome='accepted') AS successes, count(*) FILTER (outcome='rejected') AS failures FROM e GROUP BY 1)
SELECT route_id, visits, successes, failures, visits AS notes, round(list_reduce(list_prepend(CAST(50 AS BIGINT), CAST(l AS BIGINT[])),
 lambda a, x: CASE WHEN x = -1 THEN least(98, a + 5) ELSE greatest(5, a - 10) END) / 1e2, 2) AS confidence FROM f"""))
def route_outcome(spark, sf):
    d = attempts(spark, sf).select(F.col("route").alias("route_id"), "step_id", "outcome", "reason")
    return R.route_outcome(d)


# ------------------------------------------------------------------ libraries
def asks(spark, sf):
    g = X.review_log(spark, sf).filter("outcome = 'generate'")
    return g.select(F.col("step_id").alias("ask_id"), "part", F.col("pair_id").alias("prefer_pair"),
                    (F.col("value") > 100).alias("primed_rejected"))


PICK = """use AS (SELECT * FROM idx WHERE patches >= 190),
pp AS (SELECT part, arg_min(pair_id, rank) FILTER (cooldown = 0) AS f, arg_min(pair_id, rank) AS first FROM use GROUP BY part)"""


def usable_index(spark, sf):
    # only libraries with plenty of patches count as usable here, so that some requests run out of choices
    idx = M.replay_index(X.library_rows(spark, sf), X.review_log(spark, sf))
    return idx.withColumn("patches", F.when(F.col("patches") >= 190, F.col("patches")).otherwise(0))


@query("choose_pair", sql("library_rows review_log", BOTH + "," + PICK + """,
a AS (SELECT step_id AS ask_id, part, pair_id AS prefer, value > 100 AS pr FROM review_log WHERE outcome='generate'),
d AS (SELECT a.*, coalesce(u.pair_id, pp.f) AS best, pp.first FROM a LEFT JOIN pp ON pp.part = a.part LEFT JOIN use u ON u.part = a.part AND u.pair_id = a.prefer AND u.cooldown = 0)
SELECT ask_id, part, coalesce(best, CASE WHEN pr THEN first END) AS pair_id, best IS NULL AND pr AS exhausted,
 'material.' || part || coalesce('@' || CAST(coalesce(best, CASE WHEN pr THEN first END) AS VARCHAR), '.primed') AS route FROM d"""))
def choose_pair(spark, sf):
    return R.choose_pair(usable_index(spark, sf), asks(spark, sf))


@query("choose_parts", sql("library_rows review_log", BOTH + "," + PICK + """,
a AS (SELECT step_id AS ask_id, value > 100 AS pr FROM review_log WHERE outcome='generate'),
o AS (SELECT a.ask_id, a.pr, coalesce((SELECT f FROM pp WHERE part='open'), CASE WHEN a.pr THEN (SELECT first FROM pp WHERE part='open') END) AS po,
 (SELECT f FROM pp WHERE part='open') IS NULL AND a.pr AS exhausted FROM a),
r AS (SELECT o.ask_id, p.part, o.pr, coalesce(u.pair_id, pp.f) AS best, pp.first FROM o CROSS JOIN (VALUES ('edge'),('junction')) AS p(part)
 LEFT JOIN pp ON pp.part = p.part LEFT JOIN use u ON u.part = p.part AND u.pair_id = o.po AND u.cooldown = 0),
z AS (SELECT ask_id, 'open' AS part, po AS pair_id, exhausted FROM o UNION ALL
 SELECT ask_id, part, coalesce(best, CASE WHEN pr THEN first END), best IS NULL AND pr FROM r)
SELECT *, 'material.' || part || coalesce('@' || CAST(pair_id AS VARCHAR), '.primed') AS route FROM z"""))
def choose_parts(spark, sf):
    return R.choose_parts(usable_index(spark, sf), asks(spark, sf).select("ask_id", "primed_rejected"))


_LAST = """last AS (SELECT part, max(step_id) AS s, arg_max(pair_id, step_id) AS pair_id FROM review_log WHERE outcome IN ('accepted','rejected') GROUP BY part)"""


def _named(suffix: str) -> str:
    t = BOTH
    for n in ("ev", "gen", "folded", "idx"):
        t = t.replace(f"{n} AS (", f"{n}_{suffix} AS (")
    return (t.replace("JOIN ev e", f"JOIN ev_{suffix} e").replace("CROSS JOIN gen", f"CROSS JOIN gen_{suffix}")
             .replace("FROM folded", f"FROM folded_{suffix}").replace("gen.g", f"gen_{suffix}.g"))


@query("rank_move", sql("library_rows review_log", _LAST + "," + BOTH + "," +
                        _named("b").replace("FROM review_log", "FROM (SELECT r.* FROM review_log r LEFT JOIN last l ON l.part = r.part AND l.s = r.step_id WHERE l.s IS NULL) review_log") + """
SELECT l.part, l.pair_id, i.confidence, coalesce(i.rejections, 0) AS rejections, b.rank AS rank_before, i.rank AS rank_after FROM last l
LEFT JOIN idx i ON i.part = l.part AND i.pair_id = l.pair_id LEFT JOIN idx_b b ON b.part = l.part AND b.pair_id = l.pair_id"""))
def rank_move(spark, sf):
    return R.rank_move(X.library_rows(spark, sf), X.review_log(spark, sf))


# ------------------------------------------------------------------ review rules
CORR = """c AS (SELECT step_id, part, pair_id, outcome, CAST(regexp_extract(payload, '(\\d+)', 1) AS INT) AS k FROM review_log),
cr AS (SELECT *, CASE k % 6 WHEN 0 THEN 'material_too_noisy' WHEN 1 THEN 'material_too_flat' WHEN 2 THEN 'lines_not_aligned' WHEN 3 THEN 'bad_quality' WHEN 4 THEN 'wrong_library' END AS correction FROM c)"""


def corrected(spark, sf):
    k = F.get_json_object("payload", "$.k").cast("int") % 6
    names = ["material_too_noisy", "material_too_flat", "lines_not_aligned", "bad_quality", "wrong_library"]
    return X.review_log(spark, sf).withColumn("correction", F.get(F.array(*[F.lit(n) for n in names]), k)).select(
        "step_id", "part", "pair_id", "outcome", "correction")


@query("correction_rules", sql("review_log correction_rules", CORR + """,
e AS (SELECT cr.step_id, cr.correction, r.setting, r.delta, CASE WHEN r.correction IS NOT NULL AND NOT r.rejects_library THEN 'adjusted' ELSE cr.outcome END AS outcome
 FROM cr LEFT JOIN correction_rules r ON r.correction = cr.correction)
SELECT * FROM e WHERE outcome IN ('accepted','rejected','flagged','adjusted')"""))
def correction_rules(spark, sf):
    return R.correction_rules(corrected(spark, sf), X.correction_rules(spark)).select(
        "step_id", "correction", "setting", "delta", "outcome")


@query("apply_adjustments", sql("review_log correction_rules", CORR + """,
e AS (SELECT cr.part || CAST(cr.pair_id AS VARCHAR) AS session, cr.step_id, r.setting, CAST(r.delta AS BIGINT) AS delta FROM cr JOIN correction_rules r ON r.correction = cr.correction),
g AS (SELECT session, list_reduce(list_prepend(CAST(1050 AS BIGINT), list(delta ORDER BY step_id)), lambda a, x: 1000 + least(100, greatest(0, a - 1000 + x))) - 1000 AS grain FROM e WHERE setting='grain' GROUP BY 1),
q AS (SELECT session, list_reduce(list_prepend(CAST(1 AS BIGINT), list(delta ORDER BY step_id)), lambda a, x: least(3, greatest(1, a + x))) AS quality FROM e WHERE setting='quality' GROUP BY 1)
SELECT s.session, coalesce(g.grain, 50) AS grain, CAST(50 AS BIGINT) AS wear, coalesce(q.quality, 1) AS quality, s.al AS align_lines
FROM (SELECT session, count(*) FILTER (setting='align_lines') > 0 AS al FROM e GROUP BY 1) s LEFT JOIN g USING (session) LEFT JOIN q USING (session)"""))
def apply_adjustments(spark, sf):
    d = corrected(spark, sf).join(F.broadcast(X.correction_rules(spark)), "correction").select(
        F.concat("part", F.col("pair_id").cast("string")).alias("session"), "step_id", "setting", "delta")
    return R.apply_adjustments(d)


@query("validate_review", sql("review_log", """
v AS (SELECT step_id, CASE WHEN value < 5 THEN '' ELSE part END AS key, CASE WHEN value > 90 THEN NULL ELSE part || CAST(pair_id AS VARCHAR) END AS route, outcome FROM review_log)
SELECT step_id, coalesce(key <> '' AND route IS NOT NULL AND outcome IN ('accepted','rejected','flagged'), false) AS valid FROM v"""))
def validate_review(spark, sf):
    d = X.review_log(spark, sf).select(
        "step_id", F.when(F.col("value") < 5, "").otherwise(F.col("part")).alias("key"),
        F.when(F.col("value") > 90, None).otherwise(F.concat("part", F.col("pair_id").cast("string"))).alias("route"), "outcome")
    return R.validate_review(d).select("step_id", "valid")


@query("library_choice", sql("library_rows review_log", _LAST + "," + BOTH + "," +
                             _named("b").replace("FROM review_log", "FROM (SELECT r.* FROM review_log r LEFT JOIN last l ON l.part = r.part AND l.s = r.step_id WHERE l.s IS NULL) review_log") + """,
op AS (SELECT arg_min(pair_id, rank) AS p FROM idx WHERE part='open' AND patches >= 6 AND cooldown = 0),
pick AS (SELECT part, coalesce(max(pair_id) FILTER (pair_id = (SELECT p FROM op)), arg_min(pair_id, rank)) AS used_pair FROM idx WHERE patches >= 6 AND cooldown = 0 GROUP BY part)
SELECT l.part, k.used_pair, l.pair_id AS moved_pair, i.confidence, coalesce(i.rejections, 0) AS rejections, b.rank AS rank_before, i.rank AS rank_after FROM last l JOIN pick k ON k.part = l.part
LEFT JOIN idx i ON i.part = l.part AND i.pair_id = l.pair_id LEFT JOIN idx_b b ON b.part = l.part AND b.pair_id = l.pair_id"""))
def library_choice(spark, sf):
    """Which library each part uses after all reviews, and where the newest review moved a library."""
    lib, log = X.library_rows(spark, sf), X.review_log(spark, sf)
    one = spark.range(1).select(F.lit(0).alias("ask_id"), F.lit(False).alias("primed_rejected"))
    now = M.materialize(M.replay_index(lib, log))
    use = R.choose_parts(now, one).select("part", F.col("pair_id").alias("used_pair"))
    return use.join(R.rank_move(lib, log, now).withColumnRenamed("pair_id", "moved_pair"), "part")
