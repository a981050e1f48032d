"""Constraint registry: named checks whose violating rows are counted in one report."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Constraint:
    name: str
    violations: DataFrame
    key: str


def report(constraints: list[Constraint]) -> DataFrame:
    """(check_name, violations, example): zero rows violate a constraint that holds; example is the least key."""
    parts = [c.violations.agg(F.count("*").alias("violations"), F.min(F.col(c.key).cast("string")).alias("example")).select(F.lit(c.name).alias("check_name"), "violations", "example") for c in constraints]
    return reduce(DataFrame.unionByName, parts)
