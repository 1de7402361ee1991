"""Registry of queries: a Spark plan over the driver's tables and, where there is one, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia import adapt

PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(views: str = "", sql: str | None = None):
    """Register a plan under its name; views are those of fluvia.adapt that the SQL reads."""

    def add(plan):
        PLANS[plan.__name__] = plan
        if sql:
            SQL[plan.__name__] = adapt.sql(views, sql)
        return plan

    return add


def r6(c: Column | str) -> Column:
    """Rounded so that the order of summation doesn't show; zero has no sign."""
    return F.round(c, 6) + 0.0
