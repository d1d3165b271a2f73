"""Places for queries that write and read back."""

from quire.sources.shared import scratch

__all__ = ["scratch"]
