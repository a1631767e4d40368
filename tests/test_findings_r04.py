"""Steps that the fourth review round found missing."""

import math
import random

import __spark_entry__ as E
from roadframe.operators import geometry as Q, training as TR

MEASURED = "part string, pair_id long, usable boolean, pixels long, mean double, grain double, local_contrast double, patches int, size_px int"


def test_groups_list_their_pairs_and_libraries(spark):
    rows = [("open", 7, True, 100, 10.0, 1.0, 2.0, 6, 32), ("open", 3, True, 300, 20.0, 2.0, 4.0, 9, 19), ("open", 5, False, None, None, None, None, 2, 4),
            ("open", 1, None, 50, 90.0, 9.0, 9.0, 8, 8), ("open", None, True, 0, 0.0, 0.0, 0.0, 1, 8), ("edge", 4, False, 20, 1.0, 1.0, 1.0, 1, 4), ("junction", 2, True, 0, 0.0, 0.0, 0.0, 0, 4)]
    got = {r.part: r for r in TR.accumulate_groups(spark.createDataFrame(rows, MEASURED)).collect()}
    o = got["open"]
    assert (o.usable, o.pixels, o.patches, o.tone, o.grain, o.contrast, o.pairs, o.skipped) == (True, 400, 16, 17.5, 1.75, 3.5, 3, 2)
    assert o.pair_ids == [None, 3, 7] and o.skipped_ids == [1, 5] and o.library_patches == [1, 9, 6] and o.library_sizes == [8, 19, 32]
    e = got["edge"]
    assert (e.usable, e.pixels, e.pairs, e.pair_ids, e.skipped_ids, e.library_patches) == (False, None, 0, [], [4], [])
    assert got["junction"].usable is False and got["junction"].pair_ids == [2] and got["junction"].tone is None


def kept_of(rows, layout, gap, turn=2.0, width=0.05):
    """The reference's loop over one street: rows of (tx, ty, hw, arc)."""
    must = {0, len(rows) - 1}
    if layout:
        setback, step, n, share = layout
        i0 = sum(r[3] < setback - (1 - share) * step + 0.05 for r in rows)
        i1 = sum(r[3] <= setback + n * step - 0.05 for r in rows) - 1
        must |= {i for i in (i0, i1) if 0 <= i < len(rows)}
    keep, last = {0}, 0
    for i in range(1, len(rows)):
        a, b = rows[last], rows[i]
        turned = math.degrees(math.acos(max(-1.0, min(1.0, a[0] * b[0] + a[1] * b[1])))) >= turn
        wider = abs(b[2] - a[2]) > width * max(a[2], 1e-6)
        if i in must or turned or wider or b[3] - a[3] >= gap:
            keep |= {i - 1, i} if (turned or wider) and i - 1 > last else {i}
            last = i
    return keep


def test_rows_stay_at_dashes_and_close_together_near_bridges(spark):
    rnd, rows, layouts, near, want = random.Random(4), [], [], [], set()
    for street in range(24):
        at, angle, hw, line = 0.0, 0.0, 4.0, []
        for i in range(rnd.randint(2, 90)):
            line.append((math.cos(angle), math.sin(angle), hw, at))
            at += rnd.choice([0.9, 1.1, 2.3])
            angle += rnd.choice([0, 0, 0, 0, 0.03, 0.1]) if street % 3 == 0 else 0
            hw *= rnd.choice([1, 1, 1, 1, 1, 1.1]) if street % 3 == 1 else 1
        layout = (2.0, rnd.uniform(5, 9), rnd.randint(1, 12), 0.6) if street % 4 else None
        rows += [(street, i, *r) for i, r in enumerate(line)]
        layouts += [(street, *layout)] if layout else []
        near += [(street,)] if street % 2 else []
        want |= {(street, i) for i in kept_of(line, layout, 4.0 if street % 2 else 20.0)}
    d = spark.createDataFrame(rows, "street_id long, seq int, tx double, ty double, hw double, arc double")
    dashes = spark.createDataFrame(layouts, "street_id long, setback double, step double, n int, share double")
    got = [tuple(r) for r in Q.row_keep(d, layout=dashes, near=spark.createDataFrame(near * 2, "street_id long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_streets_near_a_bridge(spark):
    pts = spark.createDataFrame([(i, s, float(x), 0.0) for i in (1, 2) for s in (1, 2, 3) for x in (1000 * s, 1000 * s + 10)], "image_id long, street_id long, x double, y double")
    over = spark.createDataFrame([(1, 1000.0, 619.0, 40.0), (1, 1000.0, 600.0, 40.0), (2, 3010.0, 620.0, 40.0)], "image_id long, cx double, cy double, length double")
    got = Q.near_bridges(pts, over, 0.25, key=("image_id", "street_id")).collect()
    assert [tuple(r) for r in got] == [(1, 1)]


def test_the_query_keeps_rows_at_dashes_and_bridges(spark, sf, monkeypatch):
    seen = {}
    whole = Q.row_keep
    monkeypatch.setattr(Q, "row_keep", lambda d, *a, **k: seen.update(d=d, layout=a[3], near=k["near"]) or whole(d, *a, **k))
    kept = {(r.street_id, r.seq) for r in E.queries()["row_keep"](spark, sf).collect()}
    near = {r.street_id for r in seen["near"].collect()}
    dashed = {r.street_id: r.setback + r.n * r.step - 0.05 for r in seen["layout"].collect()}
    rows = seen["d"].orderBy("street_id", "seq").collect()
    assert near and len({r.street_id for r in rows}) > len(near) and dashed
    assert all((s, max(r.seq for r in rows if r.street_id == s and r.arc <= stop)) in kept for s, stop in dashed.items())
    for a, b in zip(at := [r for r in rows if (r.street_id, r.seq) in kept], at[1:]):
        if a.street_id == b.street_id and b.seq > a.seq + 1:  # more than one row apart: the rows between are within the gap
            assert [r for r in rows if r.street_id == a.street_id and r.seq == b.seq - 1][0].arc - a.arc < (4 if a.street_id in near else 20)
