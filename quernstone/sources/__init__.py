"""Table readers and writers."""
from quernstone.sources.tables import table

__all__ = ["table"]
