"""All registered queries of the library and their SQL."""

from . import files as _files  # noqa: F401  registers its queries
from .single import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
