"""SQL text of the derived input tables, one per name, for the cross-engine check.

The text is the one in FIXTURES.md; the Spark side builds the same rows with the DataFrame API (sources/fixtures.py).
"""

FIXTURE_SQL = {
    "mask_px": """
SELECT s.s_suppkey AS image_id, CAST(ry.y AS INT) AS y, CAST(rx.x AS INT) AS x,
 CASE WHEN abs(ry.y-32) <= 3 + s.s_suppkey % 4 THEN 255
      WHEN s.s_suppkey % 3 = 1 AND abs(rx.x-32) <= 4 AND ry.y <= 32 THEN 255
      WHEN s.s_suppkey % 3 = 2 AND abs(rx.x-32) <= 4 THEN 255
      WHEN (rx.x*31 + ry.y*17 + s.s_suppkey*7) % 997 = 0 THEN 255 ELSE 0 END AS v
 FROM supplier s CROSS JOIN range(64) AS ry(y) CROSS JOIN range(64) AS rx(x)
""",
    "photo_px": """
SELECT m.image_id, m.y, m.x,
 CASE WHEN m.v=0 THEN 18 WHEN m.y=32 AND m.x % 12 < 7 THEN 235 ELSE 90 + CAST((m.x*7+m.y*13+(m.x*m.y)%31+m.image_id*17)%40 AS INT) END AS r,
 CASE WHEN m.v=0 THEN 18 WHEN m.y=32 AND m.x % 12 < 7 THEN 232 ELSE 88 + CAST((m.x*11+m.y*5+(m.x*m.y)%29+m.image_id*13)%40 AS INT) END AS g,
 CASE WHEN m.v=0 THEN 20 WHEN m.y=32 AND m.x % 12 < 7 THEN 222 ELSE 86 + CAST((m.x*3+m.y*19+(m.x*m.y)%37+m.image_id*11)%40 AS INT) END AS b
 FROM mask_px m
""",
    "raster_pair": """
SELECT p.image_id, p.y, p.x, p.r AS ra, p.g AS ga, p.b AS ba,
 CASE WHEN (p.x*5 + p.y*3 + p.image_id) % 23 = 0 THEN greatest(p.r - 60, 0) ELSE p.r END AS rb, p.g AS gb, p.b AS bb FROM photo_px p
""",
    "library_rows": """
SELECT CASE l_returnflag WHEN 'A' THEN 'junction' WHEN 'N' THEN 'open' ELSE 'edge' END AS part, l_suppkey AS pair_id,
 CAST(sum(l_quantity) AS BIGINT) AS pixels, CAST(count(*) AS BIGINT) AS patches, CAST(4 + l_suppkey % 29 AS INT) AS size_px, 6e-1 AS confidence0
 FROM lineitem GROUP BY 1,2
""",
    "review_log": """
SELECT event_id AS step_id, ts,
 CASE user_id % 3 WHEN 0 THEN 'junction' WHEN 1 THEN 'edge' ELSE 'open' END AS part,
 1 + user_id % 20 AS pair_id,
 CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'rejected' WHEN 'signup' THEN 'flagged' WHEN 'click' THEN 'adjusted' ELSE 'generate' END AS outcome,
 props AS payload, value FROM events
""",
    "candidates": """
SELECT c_custkey AS cand_id, CAST(c_nationkey AS BIGINT) AS image_id, CAST((c_custkey*7919) % 1000 AS DOUBLE) AS x, CAST((c_custkey*104729) % 1000 AS DOUBLE) AS y, 2e0 + c_custkey % 7 AS hw FROM customer
""",
    "polyline": """
SELECT user_id AS street_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INT) - 1 AS seq,
 4e0 * (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) AS x, CAST(value AS DOUBLE) / 10 AS y, 3e0 + event_id % 5 AS hw FROM events
""",
    "ring": """
SELECT s.s_suppkey AS ring_id, CAST(k.k AS INT) AS seq,
 CAST(32 + 5*(abs((k.k+4)%16 - 8) - 4) + (k.k*7 + s.s_suppkey)%3 AS DOUBLE) AS x,
 CAST(32 + 5*(abs(k.k - 8) - 4) + (k.k*5 + s.s_suppkey)%3 AS DOUBLE) AS y
 FROM supplier s CROSS JOIN range(16) AS k(k)
""",
    "lattice_street": """
SELECT s.s_suppkey AS image_id, CAST(i.i*6 + j.j + 36*d.d AS INT) AS street_id,
 CAST(i.i*100 + (i.i*7+j.j*3+s.s_suppkey)%9 AS DOUBLE) AS x0, CAST(j.j*100 + (i.i*3+j.j*5+s.s_suppkey)%9 AS DOUBLE) AS y0,
 CAST((i.i+1-d.d)*100 + ((i.i+1-d.d)*7+(j.j+d.d)*3+s.s_suppkey)%9 AS DOUBLE) AS x1, CAST((j.j+d.d)*100 + ((i.i+1-d.d)*3+(j.j+d.d)*5+s.s_suppkey)%9 AS DOUBLE) AS y1,
 CAST(i.i*6+j.j AS INT) AS node0, CAST((i.i+1-d.d)*6+(j.j+d.d) AS INT) AS node1
 FROM supplier s CROSS JOIN range(6) AS i(i) CROSS JOIN range(6) AS j(j) CROSS JOIN range(2) AS d(d)
 WHERE i.i+1-d.d < 6 AND j.j+d.d < 6
""",
    "placements": """
SELECT o_orderkey AS placement_id, CAST(o_custkey % 25 AS INT) AS object_id, CAST(1 + o_orderkey % (SELECT count(*) FROM supplier) AS BIGINT) AS image_id, CAST(o_custkey % 64 AS DOUBLE) AS cx, CAST(o_orderkey % 61 AS DOUBLE) AS cy,
 15e0 * (o_orderkey % 24) AS angle, CAST(1 + o_orderkey % 3 AS INT) AS nx, CAST(1 + o_orderkey % 2 AS INT) AS ny, 5e-1 * (o_orderkey % 3) AS gap_x, 25e-2 * (o_orderkey % 5) AS gap_y FROM orders
""",
    "objects": """
SELECT n_nationkey AS object_id, n_name AS name, 1e0 + n_nationkey % 5 AS width_m, 5e-1 + n_nationkey % 4 AS depth_m, 1e0 AS scale, n_nationkey % 4 AS turn FROM nation
""",
    "bridges": """
SELECT s_suppkey AS image_id, 0 AS idx, CAST(32 AS DOUBLE) AS cx, CAST(32 AS DOUBLE) AS cy, 16e0 + s_suppkey % 9 AS length, 1e1 AS width, 15e0 * (s_suppkey % 12) AS angle FROM supplier
""",
    "mesh_vertex": """
SELECT s.s_suppkey AS mesh_id, CAST(i.i*6+j.j AS INT) AS vid, CAST(i.i AS DOUBLE)*2 AS x, 1e-1*((i.i*j.j+s.s_suppkey)%5) AS h, CAST(j.j AS DOUBLE)*2 AS z
 FROM supplier s CROSS JOIN range(6) AS i(i) CROSS JOIN range(6) AS j(j)
""",
    "mesh_quad": """
SELECT s.s_suppkey AS mesh_id, CAST(i.i*5+j.j AS INT) AS fid, CAST(i.i*6+j.j AS INT) AS a,
 CAST(CASE WHEN (i.i+j.j)%7=0 THEN (i.i+1)*6+j.j ELSE i.i*6+j.j+1 END AS INT) AS b, CAST((i.i+1)*6+j.j+1 AS INT) AS c,
 CAST(CASE WHEN (i.i+j.j)%7=0 THEN i.i*6+j.j+1 WHEN (i.i*j.j)%11=10 THEN (i.i+1)*6+j.j+1 ELSE (i.i+1)*6+j.j END AS INT) AS d,
 CASE WHEN j.j IN (0,4) THEN 'edge' ELSE 'open' END AS part, CAST(i.i + 1 AS INT) AS owner
 FROM supplier s CROSS JOIN range(5) AS i(i) CROSS JOIN range(5) AS j(j)
""",
    "tree_leaf": """
SELECT * FROM (VALUES
 ('material','yes','material.junction','material.open',5e-1,'stage A'),
 ('material','no/under 1.5 m','material.edge','material.open',5e-1,'stage A'),
 ('material','no/1.5 m or more','material.open','',5e-1,'stage A'),
 ('noise','yes','noise.junction','noise.open',5e-1,'stage A'),
 ('noise','no','noise.open','noise.junction',5e-1,'stage A'),
 ('lines','yes/yes','lines.junction_clear','',5e-1,'stage A'),
 ('lines','yes/no','lines.dash','',5e-1,'stage A'),
 ('lines','no','lines.none','',5e-1,'stage A')) AS t(tree, path, route_id, fallbacks, confidence, source)
""",
    "correction_rules": """
SELECT * FROM (VALUES ('material_too_noisy','grain',-15,false),('material_too_flat','grain',15,false),
 ('lines_not_aligned','align_lines',1,false),('bad_quality','quality',1,false),('wrong_library','',0,true)) AS t(correction, setting, delta, rejects_library)
""",
    "asset_log": """
SELECT doc_id AS asset_id, source AS role, lang AS kind, text AS content, n_chars FROM documents
""",
    "step_log": """
SELECT conv_id * 1000 + turn AS step_id, role AS kind, text AS summary FROM conversations
""",
}

NEEDS = {"photo_px": ["mask_px"], "raster_pair": ["photo_px"]}

# embeddings read as a one-band 8x8 patch library
FIXTURE_SQL["patch_px"] = """
SELECT vec_id, label, CAST((p.p - p.p % 8) / 8 AS INT) AS y, CAST(p.p % 8 AS INT) AS x,
 CAST(embedding[p.p + 1] AS DOUBLE) AS v
 FROM embeddings CROSS JOIN range(64) AS p(p)
"""
