"""Readers and writers."""

from .fixtures import fixture_tables
from .raw import RAW_SCHEMAS, check_bad_lines, load_raw, read_raw, read_raw_quarantined
from .sinks import export_table, list_columns, register_views, run_sql, save_table, table_catalog
from .spine import date_spine

__all__ = ["RAW_SCHEMAS", "check_bad_lines", "date_spine", "export_table", "fixture_tables", "list_columns", "load_raw",
           "read_raw", "read_raw_quarantined", "register_views", "run_sql", "save_table", "table_catalog"]
