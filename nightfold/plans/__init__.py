"""Plans that compose the operators, and the catalogue of registered queries."""

from importlib import import_module

from nightfold.plans.registry import CATALOG, Entry

PARTS = ("catalog_time", "catalog_verify", "catalog_quality", "catalog_spatial", "catalog_models", "catalog_fits", "catalog_blend", "catalog_sky", "catalog_forecast", "catalog_edges", "catalog_sources")


def load_catalog() -> dict[str, Entry]:
    for part in PARTS:
        import_module(f"nightfold.plans.{part}")
    return dict(CATALOG)
