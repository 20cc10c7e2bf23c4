"""Queries by the names of the survey, each with SQL for comparison."""

from __future__ import annotations

from . import changes, files, inputs, matches, reads, scalars, streams  # noqa: F401
from .tables import ORACLE_SQL, QUERIES  # noqa: F401
