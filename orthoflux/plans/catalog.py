"""All registered queries of the engine and their DuckDB SQL."""

from __future__ import annotations

from . import q_model, q_scalar, q_spatial  # noqa: F401  they register
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
