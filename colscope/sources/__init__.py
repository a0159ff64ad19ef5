from colscope.sources.tables import load_tables, register_views, schema_columns, table_columns_meta
from colscope.sources.store import (
    save_catalog, load_catalog, list_catalogs, catalog_exists, clear_store, write_versioned,
)

__all__ = [
    "load_tables", "register_views", "schema_columns", "table_columns_meta",
    "save_catalog", "load_catalog", "list_catalogs", "catalog_exists", "clear_store",
    "write_versioned",
]
