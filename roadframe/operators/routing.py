"""Choosing a route or a library, and what each review does to the choice."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, functions as F

from roadframe.operators.common import CHUNK, materialize, merge_rounds, position_chunks
from roadframe.operators import memory as M

MIN_USABLE = 6                      # patches a library needs before it may be used
KERB_BRANCH = 1.5                   # metres
PRIMED_CONFIDENCE = 0.5             # of a library from priming


# ---------------------------------------------------------------- trees
def index_routes(nodes: DataFrame) -> DataFrame:
    """Leaf routes of every tree with their path, and the primed fallback of a leaf as a route of its own.

    nodes(tree, node, parent, answer, route_id, primed_id). One join per level, until a level is empty. A tree cannot be
    deeper than it has nodes; one that seems to be has a cycle, which is an error.
    """
    level = nodes.filter("parent is null").select("tree", "node", F.lit("").alias("path"), "route_id", "primed_id")
    found = level.filter("route_id is not null")
    deepest = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    for depth in itertools.count(1):
        up = level.filter("route_id is null").select("tree", F.col("node").alias("parent"), F.col("path").alias("_up"))
        level = materialize(nodes.join(up, ["tree", "parent"]).select(
            "tree", "node", F.concat_ws("/", F.when(F.col("_up") != "", F.col("_up")), "answer").alias("path"),
            "route_id", "primed_id"))
        if level.isEmpty():
            break
        if depth >= deepest:
            raise ValueError("a tree has a cycle")
        found = found.unionByName(level.filter("route_id is not null"))
    primed = found.filter("primed_id is not null").select(
        "tree", "path", F.col("primed_id").alias("route_id"), F.lit(True).alias("is_primed"))
    return found.select("tree", "path", "route_id", F.lit(False).alias("is_primed")).unionByName(primed)


def junction_type_feature(kind: Column) -> Column:
    return F.translate(kind, " ()", "_")


def features_for(part: Column, junction_type: Column | None = None) -> Column:
    """Map of what is known about a spot: its part and, for a junction, the junction type."""
    base = F.create_map(F.lit("part"), part, F.lit("junction"), F.when(part == "junction", "y").otherwise("n"))
    if junction_type is None:
        return base
    extra = F.create_map(F.lit("type"), junction_type_feature(junction_type))
    return F.when((part == "junction") & junction_type.isNotNull(), F.map_concat(base, extra)).otherwise(base)


def candidates_for(routes: DataFrame) -> DataFrame:
    """Ordered candidates per route: itself, its fallbacks that exist, then its primed route.

    routes(tree, route_id, fallbacks comma text, primed_id).
    """
    ids = F.concat(F.array("route_id"), F.filter(F.split("fallbacks", ","), lambda c: c != ""))
    exp = routes.select("tree", "route_id", F.posexplode(F.array_distinct(ids)).alias("pos", "cand"))
    known = routes.select("tree", F.col("route_id").alias("cand"))
    live = exp.join(known, ["tree", "cand"], "left_semi").select("tree", "route_id", "pos", "cand")
    primed = routes.filter("primed_id is not null").filter(~F.array_contains(ids, F.col("primed_id"))).select(
        "tree", "route_id", F.lit(1 << 20).alias("pos"), F.col("primed_id").alias("cand"))
    return live.unionByName(primed)


def choose_route(asks: DataFrame, cands: DataFrame, attempts: DataFrame) -> DataFrame:
    """asks(key, route_id): the first candidate not rejected under the key; all rejected -> the first one."""
    rejected = attempts.filter("outcome = 'rejected'").select("key", F.col("route").alias("cand")).distinct()
    c = asks.join(cands, "route_id").join(rejected.withColumn("_rej", F.lit(True)), ["key", "cand"], "left")
    rank = F.struct(F.coalesce("_rej", F.lit(False)), "pos")
    return c.groupBy("key").agg(F.min_by("cand", rank).alias("route"),
                                F.bool_and(F.coalesce("_rej", F.lit(False))).alias("exhausted"))


def route_for_group(tree: Column, part: Column, near_junction: Column | None = None,
                    centreline: Column | None = None) -> Column:
    """Path of the leaf that answers for a part of the road in the given tree."""
    material = F.when(part == "junction", "yes").when(part == "edge", "no/under 1.5 m").otherwise("no/1.5 m or more")
    noise = F.when(part == "junction", "yes").otherwise("no")
    if near_junction is None:
        lines = F.lit(None).cast("string")
    else:
        lines = F.when(~centreline, "no").when(near_junction, "yes/yes").otherwise("yes/no")
    return F.when(tree == "material", material).when(tree == "noise", noise).when(tree == "lines", lines)


# ---------------------------------------------------------------- clamped running settings
_NO = 1 << 40


def clamped_replay(events: DataFrame, keys: list[str], lo: Column, hi: Column, delta: Column,
                   chunk: int = CHUNK, fan: int = 16) -> DataFrame:
    """Composition, in step order, of moves x -> min(hi, max(lo, x + delta)); one (d, lo, hi) per key.

    Such moves compose to another of the same form, so chunks (by position, ids may be sparse) are reduced
    independently and combined in rounds; no key is ever collected whole.
    """
    def then(a, b):
        sq = lambda v: F.least(b["hi"], F.greatest(b["lo"], v + b["d"]))
        return F.struct((a["d"] + b["d"]).alias("d"), sq(a["lo"]).alias("lo"), sq(a["hi"]).alias("hi"))

    unit = F.struct(F.lit(0).cast("bigint").alias("d"), F.lit(-_NO).cast("bigint").alias("lo"),
                    F.lit(_NO).cast("bigint").alias("hi"))

    m = F.struct(delta.cast("bigint").alias("d"), lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi")).alias("m")
    placed, chunks = position_chunks(events.select(*keys, "step_id", m), [*keys, "step_id"], chunk)
    squeezed = lambda ms: F.aggregate(ms, unit, then)
    pieces = placed.groupBy(*keys, "_chunk").agg(squeezed(F.transform(
        F.array_sort(F.collect_list(F.struct("step_id", "m"))), lambda s: s["m"])).alias("piece"))
    return merge_rounds(pieces, keys, chunks, fan, squeezed).select(*keys, "piece.*")


def after(start: Column) -> Column:
    """Value reached from `start` under a composed move in columns d, lo, hi."""
    return F.least(F.col("hi"), F.greatest(F.col("lo"), start + F.col("d")))


def route_outcome(reviews: DataFrame, start: float = 0.5, chunk: int = CHUNK) -> DataFrame:
    """Per route: confidence in hundredths after every review, visits, successes, failures and versions saved.

    reviews(route_id, step_id, outcome, reason).
    """
    o = F.col("outcome")
    moves = clamped_replay(
        reviews.filter(o.isin("accepted", "rejected")), ["route_id"],
        lo=F.when(o == "rejected", 5).otherwise(-_NO), hi=F.when(o == "accepted", 98).otherwise(_NO),
        delta=F.when(o == "accepted", 5).otherwise(-10), chunk=chunk)
    counts = reviews.groupBy("route_id").agg(
        F.count(F.lit(1)).alias("visits"), F.count_if(o == "accepted").alias("successes"),
        F.count_if(o == "rejected").alias("failures"), F.count("reason").alias("notes"))
    s = F.lit(round(start * 100)).cast("bigint")
    return counts.join(moves, "route_id", "left").select(
        "route_id", "visits", "successes", "failures", "notes",
        F.round(F.coalesce(after(s), s) / 100.0, 2).alias("confidence"))


def apply_adjustments(adjust: DataFrame, grain0: int = 50, quality0: int = 1, chunk: int = CHUNK) -> DataFrame:
    """Settings of a session after its corrections: adjust(session, step_id, setting, delta)."""
    def setting(name, lo, hi, start):
        d = clamped_replay(adjust.filter(F.col("setting") == name), ["session"], F.lit(lo), F.lit(hi), F.col("delta"), chunk)
        return d.select("session", after(F.lit(start).cast("bigint")).alias(name))
    flags = adjust.groupBy("session").agg(F.count_if(F.col("setting") == "align_lines").alias("_al"))
    out = flags
    for name, lo, hi, start in (("grain", 0, 100, grain0), ("wear", 0, 100, 50), ("quality", 1, 3, quality0)):
        out = out.join(setting(name, lo, hi, start), "session", "left").withColumn(
            name, F.coalesce(name, F.lit(start).cast("bigint")))
    return out.select("session", "grain", "wear", "quality", (F.col("_al") > 0).alias("align_lines"))


# ---------------------------------------------------------------- libraries
def choose_pair(index: DataFrame, asks: DataFrame) -> DataFrame:
    """asks(ask_id, part, prefer_pair, primed_rejected) -> chosen library.

    The preferred pair if it is usable and not sitting out, else the first such pair by rank, else the primed
    library unless it was rejected, else (exhausted) the first candidate. Parts are few, so the per-part
    answers are one aggregate; only the preferred pair is looked up by key.
    """
    use = index.filter(F.col("patches") >= MIN_USABLE).select("part", "pair_id", "rank", "cooldown", "confidence")
    free = F.col("cooldown") == 0
    per_part = use.groupBy("part").agg(
        F.min_by("pair_id", F.when(free, F.col("rank"))).alias("_free"),
        F.min_by("pair_id", "rank").alias("_first"))
    pref = use.filter(free).select("part", F.col("pair_id").alias("prefer_pair"), F.lit(True).alias("_ok"))
    d = asks.join(per_part, "part", "left").join(pref, ["part", "prefer_pair"], "left")
    best = F.when(F.col("_ok"), F.col("prefer_pair")).otherwise(F.col("_free"))
    primed_ok = ~F.coalesce("primed_rejected", F.lit(False))
    exhausted = best.isNull() & ~primed_ok
    pair = F.coalesce(best, F.when(~primed_ok, F.col("_first")))
    return d.select("ask_id", "part", pair.alias("pair_id"), exhausted.alias("exhausted")).withColumn(
        "route", F.when(F.col("pair_id").isNull(), F.concat(F.lit("material."), "part", F.lit(".primed")))
        .otherwise(F.concat(F.lit("material."), "part", F.lit("@"), F.col("pair_id").cast("string"))))


def choose_parts(index: DataFrame, asks: DataFrame) -> DataFrame:
    """asks(ask_id, primed_rejected): open road picks first, kerb and junction prefer the same pair."""
    none = F.lit(None).cast("bigint").alias("prefer_pair")
    op = choose_pair(index, asks.select("ask_id", F.lit("open").alias("part"), none, "primed_rejected"))
    rest = (op.select("ask_id", F.col("pair_id").alias("prefer_pair")).join(asks, "ask_id")
            .withColumn("part", F.explode(F.array(F.lit("edge"), F.lit("junction")))))
    return op.unionByName(choose_pair(index, rest.select("ask_id", "part", "prefer_pair", "primed_rejected")))


def rank_move(library: DataFrame, log: DataFrame, now: DataFrame | None = None) -> DataFrame:
    """What the newest deciding review of each part did: confidence, rejections, rank before and after.

    `now` is the replayed index if it is at hand. Only the pairs of the newest reviews are replayed without them; all
    other pairs stood where they stand now.
    """
    deciding = log.filter(F.col("outcome").isin("accepted", "rejected"))
    last = materialize(deciding.groupBy("part").agg(F.max("step_id").alias("_last"), F.max_by("pair_id", "step_id").alias("pair_id")))
    now = materialize(now if now is not None else M.replay_index(library, log))
    # one row per part of the road
    few = F.broadcast(last)
    before = log.join(few, ["part", "pair_id"]).filter(F.col("step_id") != F.col("_last")).drop("_last")
    undone = materialize(M.replay_index(library.join(F.broadcast(last.select("part", "pair_id")), ["part", "pair_id"], "left_semi"), before, ranked=False))
    then = now.select("part", "pair_id", "pixels", "weight").join(F.broadcast(last.select("part", "pair_id")), ["part", "pair_id"], "left_anti").unionByName(
        undone.select("part", "pair_id", "pixels", "weight"))
    # a rank is one more than the rows before it: one aggregate instead of ordering every pair
    at = undone.select("part", F.col("pair_id").alias("_p"), F.col("weight").alias("_w"), F.col("pixels").alias("_x"))
    ahead = F.struct("weight", "pixels", -F.col("pair_id")) > F.struct(F.col("_w").alias("weight"), F.col("_x").alias("pixels"), (-F.col("_p")).alias("pair_id"))
    b = then.join(F.broadcast(at), "part").groupBy("part", F.col("_p").alias("pair_id")).agg((F.count_if(ahead) + 1).alias("rank_before"))
    a = now.select("part", "pair_id", "confidence", "rejections", F.col("rank").alias("rank_after"))
    # a reviewed pair without a library has no confidence and no rank
    d = last.select("part", "pair_id").join(a, ["part", "pair_id"], "left").join(b, ["part", "pair_id"], "left")
    return d.withColumn("rejections", F.coalesce("rejections", F.lit(0).cast("bigint")))


# ---------------------------------------------------------------- reviews
def correction_rules(reviews: DataFrame, rules: DataFrame) -> DataFrame:
    """Effective outcome of a review: a settings correction turns it into 'adjusted'; unknown outcomes drop out.

    The rule table is a handful of fixed rows.
    """
    d = reviews.join(F.broadcast(rules), "correction", "left")
    eff = F.when(F.col("setting").isNotNull() & ~F.col("rejects_library"), "adjusted").otherwise(F.col("outcome"))
    return d.withColumn("outcome", eff).filter(F.col("outcome").isin("accepted", "rejected", "flagged", "adjusted"))


def validate_review(reviews: DataFrame) -> DataFrame:
    ok = (F.coalesce("key", F.lit("")) != "") & (F.coalesce("route", F.lit("")) != "") & F.coalesce(
        F.col("outcome").isin("accepted", "rejected", "flagged"), F.lit(False))
    return reviews.withColumn("valid", ok)


def part_choices(index: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """One row per part of the road: its situation key, the library used there now and how many candidates it was chosen from.

    rejected(key, route) holds the routes reviewers turned down by situation; of it only the primed libraries matter, all
    others are judged by their cooldown. A primed library is always the last candidate; it has no patches of its own.
    """
    spark = index.sparkSession
    parts = spark.createDataFrame([(0, p) for p in ("open", "edge", "junction")], "ask_id int, part string")
    key = M.situation_key(F.lit("material"), {"part": ("text", F.col("part")), "junction": ("bool", F.col("part") == "junction")})
    parts = parts.withColumn("key", key).withColumn("_primed", F.concat(F.lit("material."), "part", F.lit(".primed")))
    if rejected is None:
        parts = parts.withColumn("primed_rejected", F.lit(False))
    else:
        no = rejected.select("key", F.col("route").alias("_primed")).distinct().withColumn("_no", F.lit(True))
        parts = parts.join(no, ["key", "_primed"], "left").withColumn("primed_rejected", F.coalesce("_no", F.lit(False))).drop("_no")
    none = F.lit(None).cast("bigint").alias("prefer_pair")
    op = choose_pair(index, parts.filter("part = 'open'").select("ask_id", "part", none, "primed_rejected"))
    rest = parts.filter("part <> 'open'").join(op.select("ask_id", F.col("pair_id").alias("prefer_pair")), "ask_id")
    pick = op.unionByName(choose_pair(index, rest.select("ask_id", "part", "prefer_pair", "primed_rejected"))).drop("ask_id")
    usable = index.filter(F.col("patches") >= MIN_USABLE)
    of = usable.groupBy("part").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("cooldown") > 0).alias("_out"))
    used = usable.select("part", "pair_id", "rank", "confidence", "patches", "size_px")
    d = parts.select("part", "key", "primed_rejected").join(pick, "part").join(of, "part", "left").join(used, ["part", "pair_id"], "left")
    n, primed = F.coalesce("_n", F.lit(0)), F.col("pair_id").isNull()
    return d.select("part", "key", "pair_id", "route", "exhausted", F.when(primed, n + 1).otherwise(F.col("rank")).cast("bigint").alias("rank"),
                    F.when(primed, PRIMED_CONFIDENCE).otherwise(F.col("confidence")).alias("confidence"),
                    F.when(primed, 0).otherwise(F.col("patches")).cast("bigint").alias("patches"), "size_px", (n + 1).alias("candidates"),
                    (F.coalesce("_out", F.lit(0)) + F.col("primed_rejected").cast("int")).alias("rejected"), "primed_rejected")


def part_candidates(index: DataFrame, choices: DataFrame) -> DataFrame:
    """The candidates behind `part_choices`, one row per part and library in order of rank, the primed library last.

    They are the same for every point of a part, so points carry their number and join here by part.
    """
    few = F.broadcast(choices.select("part", "candidates", "primed_rejected", F.col("route").alias("_chosen")))
    own = index.filter(F.col("patches") >= MIN_USABLE).join(few, "part").select(
        "part", F.concat(F.lit("material."), "part", F.lit("@"), F.col("pair_id").cast("string")).alias("route"), "pair_id", F.col("rank").cast("bigint").alias("rank"),
        "confidence", "weight", F.col("patches").cast("bigint").alias("patches"), "size_px", "rejections", "acceptances", (F.col("cooldown") > 0).alias("rejected"), "_chosen")
    zero, kinds = F.lit(0).cast("bigint"), dict(own.dtypes)
    null = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    primed = choices.select(
        "part", F.concat(F.lit("material."), "part", F.lit(".primed")).alias("route"), null("pair_id"), F.col("candidates").cast("bigint").alias("rank"),
        F.lit(PRIMED_CONFIDENCE).alias("confidence"), F.lit(0.0).alias("weight"), zero.alias("patches"), null("size_px"), zero.alias("rejections"),
        zero.alias("acceptances"), F.col("primed_rejected").alias("rejected"), F.col("route").alias("_chosen"))
    return own.unionByName(primed).withColumn("chosen", F.col("route") == F.col("_chosen")).drop("_chosen")


def inspect_point(points: DataFrame, codes: DataFrame, dt: DataFrame, js: DataFrame, choices: DataFrame, mpp: float) -> DataFrame:
    """points(placement_id, image_id, y, x): part, kerb distance, junction, situation key and the library used there.

    The choice depends on the part alone, so it is made once per part (`part_choices`) and looked up. Off the road all
    columns but `on_road` are null; points outside the image have no row.
    """
    part = F.when(F.col("code") == 1, "junction").when(F.col("code") == 2, "edge").when(F.col("code") == 3, "open")
    d = points.join(codes, ["image_id", "y", "x"]).join(dt.select("image_id", "y", "x", "dist"), ["image_id", "y", "x"], "left").withColumn("part", part)
    j = js.select("image_id", F.col("jid").alias("junction_id"), "type")
    # one row per part of the road
    d = d.join(j, ["image_id", "junction_id"], "left").join(F.broadcast(choices.drop("primed_rejected")), "part", "left")
    on, known = F.col("part").isNotNull(), (F.col("part") == "junction") & F.col("type").isNotNull()
    return d.select("placement_id", on.alias("on_road"), "part", F.when(on, F.round(F.coalesce("dist", F.lit(0.0)) * mpp, 2)).alias("edge_m"),
                    F.when(known, F.col("junction_id")).alias("junction_id"), F.when(known, F.col("type")).alias("junction_type"),
                    *[c for c in choices.columns if c not in ("part", "primed_rejected")])
