"""All queries of the engine's own operators, with their SQL."""

from __future__ import annotations

from . import figures, jobs, layout, shapes, texts, typeset  # noqa: F401
from .register import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
