"""DuckDB SQL for each query, over the same parquet tables."""

from .sql import oracle_queries

__all__ = ["oracle_queries"]
