"""Readers and writers: delimited text in and out, laid-out Parquet."""

from longstats.sources.delimited import (
    read_delimited,
    read_dimension,
    read_escaped,
    read_lines,
    read_with_quarantine,
    split_escaped,
    unescape,
)
from longstats.sources.export import escape, export_check, export_delimited, export_manifest
from longstats.sources.layout import load_table, write_table
from longstats.sources.reload import Reloaded, commit_partitions, reload_years, replace_partitions, table_files

__all__ = [
    "Reloaded", "commit_partitions", "escape", "export_check", "load_table", "export_delimited", "export_manifest", "read_delimited",
    "read_dimension", "read_escaped", "read_lines", "read_with_quarantine", "split_escaped",
    "reload_years", "replace_partitions", "table_files", "unescape", "write_table",
]
