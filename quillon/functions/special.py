"""Special functions as built-in expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_factorial(n: Column) -> Column:
    """ln(n!) for n >= 0: exact to n = 20, then Stirling's series."""
    x = F.greatest(n, F.lit(21)).cast("double")
    series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def log2(x: Column) -> Column:
    """Base 2; null where x is 0 or less."""
    return F.when(x > 0, F.log2(x))
