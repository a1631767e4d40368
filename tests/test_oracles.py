"""A cross-section of the registered queries against DuckDB at the smallest scale (all of them: oracle_check.py)."""

import pytest

import __spark_entry__ as E
import oracle_check as O

NAMES = ["fixture"] + ["library_choice", "tree_as_of", "situation_key", "route_outcome", "apply_adjustments", "ingest_assets",
                       "local_contrast", "periodicity", "patch_stats", "distance_transform", "junction_type", "merge_candidates",
                       "smooth_line", "row_keep", "taubin_smooth", "split_quads", "rasterise_faces", "stream_replay_index"]


@pytest.mark.parametrize("name", NAMES[1:])
def test_matches_duckdb(spark, sf, name):
    msg, _, _ = O.compare(spark, O.duck(sf), name, E.queries()[name], E.oracle_sql()[name], sf)
    assert msg.startswith("ok") and "TYPES" not in msg, msg


@pytest.mark.parametrize("name", "mask_px photo_px raster_pair library_rows review_log candidates polyline ring lattice_street placements "
                                 "objects bridges mesh_vertex mesh_quad tree_leaf correction_rules asset_log step_log patch_px".split())
def test_derived_tables(spark, sf, name):
    from roadframe.plans.registry import sql
    from roadframe.sources import fixtures as X
    msg, _, _ = O.compare(spark, O.duck(sf), name, lambda s, f: getattr(X, name)(s, f), sql(name, f"SELECT * FROM {name}"), sf)
    assert msg.startswith("ok") and "TYPES" not in msg, msg


def test_entry(spark):
    assert E.entry(spark).count() == 3


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
