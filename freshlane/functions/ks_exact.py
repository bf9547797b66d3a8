"""Exact p-value of the two-sample Kolmogorov-Smirnov statistic, by counting lattice paths.

Under the null hypothesis every merge order of the two samples is as likely as any other: a path from (0, 0) to
(n1, n2). The p-value is the share of paths that leave the band |i / n1 - j / n2| < d. Inside the band a row of path
counts is the running sum of the row before; rows are scaled as they grow and their logarithms added up.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from freshlane.session import show_package_to_workers

#: Up to so many rows a side the p-value is exact, beyond it is that of the limit distribution.
EXACT_ROWS = 10_000


def path_pvalue(d: float, n1: int, n2: int) -> float:
    """Share of the merge orders of n1 and n2 values whose greatest distance reaches ``d``."""
    step1, step2 = n2 // math.gcd(n1, n2), n1 // math.gcd(n1, n2)
    width = round(d * n1 * step1)               # the statistic in whole steps: d is a multiple of 1 / lcm
    if width <= 0:
        return 1.0
    counts, low, scale = np.ones(1), 0, 0.0     # paths inside the band to (i, low), (i, low + 1), ...
    for i in range(n1 + 1):
        at = i * step1
        first = max(0, (at - width) // step2 + 1)
        last = min(n2, -((-at - width) // step2) - 1)
        if first > last:
            return 1.0
        row = np.zeros(last - first + 1)
        if i == 0:
            row[:] = 1.0                        # one path along the edge
        else:
            keep = counts[max(0, first - low):last - low + 1]
            row[max(0, low - first):max(0, low - first) + len(keep)] = keep
            row = np.cumsum(row)
        top = row.max()
        if top == 0.0:
            return 1.0
        counts, low, scale = row / top, first, scale + math.log(top)
    if low + len(counts) - 1 < n2:
        return 1.0
    ways = math.lgamma(n1 + n2 + 1) - math.lgamma(n1 + 1) - math.lgamma(n2 + 1)
    inside = math.exp(min(0.0, scale + math.log(counts[-1]) - ways)) if counts[-1] > 0 else 0.0
    return min(1.0, max(0.0, 1.0 - inside))


def _of_rows(d: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return pd.Series([path_pvalue(float(x), int(a), int(b)) if x == x and a > 0 and b > 0 else None
                      for x, a, b in zip(d, n1, n2)], dtype="float64")


def ks_exact_pvalue(d: Column, n1: Column, n2: Column, beyond: Column, most: int = EXACT_ROWS) -> Column:
    """The exact p-value where both sides have at most ``most`` rows, else ``beyond``. A row is a feature, not a value."""
    show_package_to_workers(SparkSession.active())
    small = (n1 <= most) & (n2 <= most)
    asked = [F.when(small, c).otherwise(F.lit(0)) for c in (d.cast("double"), n1, n2)]
    return F.when(small, F.pandas_udf(_of_rows, DoubleType())(*asked)).otherwise(beyond)
