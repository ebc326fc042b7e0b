"""All timeline queries by name, and the SQL that they are held against."""

from __future__ import annotations

from reelspan.plans import queries
from reelspan.plans.oracles import ORACLES

QUERIES = {name: getattr(queries, name) for name in ORACLES}

__all__ = ["ORACLES", "QUERIES"]
