"""Incremental refresh of derived tables with Structured Streaming."""

from supplylens.streaming.refresh import refresh_table

__all__ = ["refresh_table"]
