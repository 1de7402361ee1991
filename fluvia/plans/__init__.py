"""Queries over the driver's tables, by name."""

from __future__ import annotations

from fluvia.plans import geometry, patterns, runoff, select, series, space  # noqa: F401
from fluvia.plans.registry import PLANS, SQL


def queries() -> dict:
    return dict(PLANS)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
