"""All registered queries."""

from . import catalog_clean, catalog_joins, catalog_knn, catalog_model, catalog_panel, catalog_raster, catalog_series, catalog_sources, catalog_spatial  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
