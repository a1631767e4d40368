"""The derived input tables themselves, checked row for row against their SQL text."""

from roadframe.plans.registry import query, sql
from roadframe.sources import fixtures as X

for _n in ("mask_px photo_px raster_pair library_rows review_log candidates polyline ring lattice_street placements "
           "objects bridges mesh_vertex mesh_quad tree_leaf correction_rules asset_log step_log patch_px").split():
    query(f"fixture_{_n}", sql(_n, f"SELECT * FROM {_n}"))(lambda spark, sf, _n=_n: getattr(X, _n)(spark, sf))
