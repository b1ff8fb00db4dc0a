"""Plans: registered queries and the staged pipeline."""

from importlib import import_module

QUERY_MODULES = ("dashboard_queries", "profile_queries", "pipeline_queries", "export_queries", "function_queries", "store_queries", "file_queries")


def load_all() -> None:
    """Import the modules that register queries."""
    for name in QUERY_MODULES:
        import_module(f"tidewarden.plans.{name}")
