"""Sources and sinks: domain tables, literal dimensions, list parameters."""

from waterbook.sources.tables import Tables

__all__ = ["Tables"]
