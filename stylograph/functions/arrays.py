"""Column expressions on arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scaled(x: Column, std: Column) -> Column:
    """x / std by position; where std is 0, x stays."""
    return F.zip_with(x, std, lambda a, s: a / F.when(s > 0, s).otherwise(1.0))
