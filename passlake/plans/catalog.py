"""All registered queries of the library's own operators, and their DuckDB SQL."""

from __future__ import annotations

from passlake.plans import changes, folds, lifecycle, models, recognition, rules, shapes, spatial, surface  # noqa: F401
from passlake.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
