"""The exact KS p-value: fixed values, all merge orders of small samples, the limit law for large ones."""

import itertools

import pytest
from pyspark.sql import functions as F

from freshlane.functions.ks_exact import ks_exact_pvalue, path_pvalue
from freshlane.operators.monitor import ks, ks_pvalue

# Tail probabilities of the two-sample statistic.
KNOWN = [(1.0, 3, 3, 2 / 20), (1.0, 5, 5, 2 / 252), (0.8, 5, 5, 20 / 252), (0.6, 5, 5, 90 / 252), (0.4, 5, 5, 220 / 252),
         (1.0, 4, 5, 2 / 126), (1.0, 1, 9, 2 / 10), (0.0, 4, 4, 1.0)]


@pytest.mark.parametrize("d, n1, n2, p", KNOWN)
def test_fixed_values(d, n1, n2, p):
    assert abs(path_pvalue(d, n1, n2) - p) < 1e-12


@pytest.mark.parametrize("n1, n2", [(3, 4), (5, 2), (4, 6), (6, 6)])
def test_all_orders(n1, n2):
    found = []
    for ones in itertools.combinations(range(n1 + n2), n1):
        i = j = top = 0
        for k in range(n1 + n2):
            i, j = (i + 1, j) if k in ones else (i, j + 1)
            top = max(top, abs(i * n2 - j * n1))
        found.append(top)
    for d in sorted(set(found)):
        want = sum(x >= d for x in found) / len(found)
        assert abs(path_pvalue(d / (n1 * n2), n1, n2) - want) < 1e-12


def test_beyond_the_limit(spark):
    rows = spark.createDataFrame([(0.03, 9000, 8000), (0.5, 10, 10), (0.03, 10001, 20), (0.02, 30000, 4000)], "d double, n1 long, n2 long")
    limit = ks_pvalue(F.col("d"), F.col("n1").cast("double"), F.col("n2").cast("double"))
    got = rows.select("*", ks_exact_pvalue(F.col("d"), F.col("n1"), F.col("n2"), limit).alias("p"), limit.alias("a")).collect()
    assert got[2].p == got[2].a and got[3].p == got[3].a
    assert got[0].p != got[0].a and abs(got[0].p - got[0].a) < 0.01          # exact, near the limit law
    assert abs(got[1].p - path_pvalue(0.5, 10, 10)) < 1e-15


def test_report_uses_it(spark):
    rows = [("f", side, float(v)) for side, values in (("train", (1, 2, 3, 4, 5)), ("recent", (4.5, 6, 7, 8, 9))) for v in values]
    long = spark.createDataFrame(rows, "feature string, sample string, v double")
    got = ks(long, exact=True).first()
    assert abs(got["ks_statistic"] - 0.8) < 1e-12 and abs(got["p"] - 20 / 252) < 1e-12
