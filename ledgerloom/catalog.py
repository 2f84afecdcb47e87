"""All queries of the engine by name, and equivalent SQL."""

from __future__ import annotations

from .plans import archives, artifacts, bills, configs, inifiles, material, scalars, trees
from .plans.base import QUERIES, SQL

FLAGSHIP = "m01_roots"
__all__ = ["FLAGSHIP", "QUERIES", "SQL", "archives", "artifacts", "bills", "configs", "inifiles", "material", "scalars", "trees"]
