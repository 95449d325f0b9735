from .io import read_table, write_table, write_splits, nan_to_null
from .fixtures import applications, applications_sql, load_tables

__all__ = ["read_table", "write_table", "write_splits", "nan_to_null",
           "applications", "applications_sql", "load_tables"]
