"""Registered queries: each binds an operator to the shared tables and names its SQL twin."""

from __future__ import annotations

import importlib

MODULES = ("memory_queries", "io_queries", "routing_queries", "raster_queries", "network_queries", "training_queries", "synth_queries", "geometry_queries", "mesh_queries", "stream_queries")


def load():
    from roadframe.plans import registry
    for m in MODULES:
        importlib.import_module(f"roadframe.plans.{m}")
    return registry.QUERIES, registry.ORACLES
