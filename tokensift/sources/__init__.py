"""Reading tables and keeping intermediate tables in the shared folder."""

from tokensift.sources.tables import laid_out, materialized, shared_dir, table, work_path

__all__ = ["laid_out", "materialized", "shared_dir", "table", "work_path"]
