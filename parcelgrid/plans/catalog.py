"""Imports every module that registers queries."""

from parcelgrid.plans import queries_generate, queries_geometry, queries_io, queries_network, queries_raster, queries_rules  # noqa: F401
from parcelgrid.plans.registry import ORACLES, QUERIES  # noqa: F401
