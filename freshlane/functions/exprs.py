"""Reusable Column expressions (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Retail category of each part type (alphabetical index).
CATEGORY_INDEX = {"ECONOMY": 1, "LARGE": 2, "MEDIUM": 3, "PROMO": 4, "SMALL": 5, "STANDARD": 6}
# Average shelf days per category index 1..6.
CATEGORY_SHELF_DAYS = (3, 5, 14, 30, 90, 365)
# Store type by region key % 3, and its model encoding.
STORE_TYPES = ("urban", "suburban", "rural")
STORE_TYPE_CODE = {"urban": 0, "suburban": 1, "rural": 2}
# Public holidays as month*100+day.
HOLIDAYS_MMDD = (101, 120, 214, 217, 526, 704)
# Calendar origin of the derived retail dates.
SHIP_EPOCH = "1995-01-01"
RETAIL_EPOCH = "2025-01-01"
RETAIL_DAYS = 240


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def case_map(c: str | Column, mapping: dict, default=None) -> Column:
    """CASE c WHEN k THEN v ... END from a small fixed dict."""
    c = col(c)
    out = None
    for k, v in mapping.items():
        out = F.when(c == F.lit(k), F.lit(v)) if out is None else out.when(c == F.lit(k), F.lit(v))
    return out.otherwise(F.lit(default)) if default is not None else out


def category_index(p_type: str | Column) -> Column:
    return case_map(p_type, CATEGORY_INDEX)


def shelf_days_for(cat: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in CATEGORY_SHELF_DAYS]), cat.cast("int"))


def safe_div(num: str | Column, den: str | Column) -> Column:
    """num / den, NULL when den is 0 or NULL (ANSI-safe, never NaN)."""
    num, den = col(num), col(den)
    return F.when(den != 0, num.cast("double") / den.cast("double"))


def idiv(a: str | Column, b: str | Column) -> Column:
    """Floor division of integers (b > 0), exact for any long: (a - pmod(a, b)) is a
    multiple of b, so the DECIMAL(38,0) division has no remainder to round."""
    a, b = col(a).cast("long"), col(b).cast("long")
    return ((a - F.pmod(a, b)).cast("decimal(38,0)") / b.cast("decimal(38,0)")).cast("long")


def pct1(num: str | Column, den: str | Column) -> Column:
    """ROUND(num / NULLIF(den, 0) * 100, 1) for non-negative integers, computed
    exactly with integer arithmetic: floor((2000*num + den) / (2*den)) / 10."""
    num, den = col(num).cast("long"), col(den).cast("long")
    k = F.when(den != 0, idiv(F.lit(2000) * num + den, F.lit(2) * den))
    return k.cast("double") / F.lit(10.0)


def avg1(total: str | Column, n: str | Column) -> Column:
    """ROUND(total / n, 1) for non-negative integer totals (exact)."""
    total, n = col(total).cast("long"), col(n).cast("long")
    return F.when(n != 0, idiv(F.lit(20) * total + n, F.lit(2) * n)).cast("double") / F.lit(10.0)


def _whole(c: str | Column) -> Column:
    return col(c).cast("decimal(31,0)")


def ratio6(num: str | Column, den: str | Column) -> Column:
    """num / den for integers (den > 0), rounded half away from zero to 6 dp exactly
    (integer micro-units in DECIMAL(38), for any |num|, den < 10**18 or decimal products of such below
    10**31). NULL when den is 0 / NULL."""
    n, d = _whole(num), _whole(den)
    top = (F.abs(n) * 2000000 + d).cast("decimal(38,0)")
    bottom = (d * 2).cast("decimal(38,0)")
    q = ((top - top % bottom) / bottom).cast("decimal(38,0)").cast("double")
    return F.when(d > 0, F.signum(n) * q / F.lit(1e6))


def round6(c: str | Column) -> Column:
    """Round a double to 6 dp in binary: nearest integer of x * 10^6, halves away from
    zero, then / 10^6. (Spark's round(x, 6) rounds the shortest decimal repr instead,
    which differs from SQL engines on values like 41/640 that print as a tie.)"""
    return F.round(col(c).cast("double") * F.lit(1e6)) / F.lit(1e6)


def to_dec(c: str | Column, precision: int, scale: int) -> Column:
    """double -> DECIMAL(precision, scale), rounding in binary like round6."""
    m = 10 ** scale
    q = F.round(col(c).cast("double") * F.lit(float(m)))
    return (q.cast(f"decimal({precision},0)") / F.lit(m)).cast(f"decimal({precision},{scale})")


def risk_tier(score: str | Column) -> Column:
    """[0,.2) low, [.2,.5) medium, [.5,.8) high, anything else critical."""
    s = col(score)
    return (F.when((s >= 0) & (s < 0.2), "low")
             .when((s >= 0.2) & (s < 0.5), "medium")
             .when((s >= 0.5) & (s < 0.8), "high")
             .otherwise("critical"))


def markdown_pct(risk: str | Column, days_until_expiry: str | Column) -> Column:
    r, d = col(risk), col(days_until_expiry)
    return (F.when(d.isNotNull() & (d <= 1), 50)
             .when(r >= 0.8, 40)
             .when(r >= 0.6, 25)
             .otherwise(15))


def retail_date(ship_ts: str | Column) -> Column:
    """2025-01-01 + (days since 1995-01-01 of the ship date) % 240."""
    days = F.datediff(F.to_date(col(ship_ts)), F.lit(SHIP_EPOCH).cast("date"))
    return F.date_add(F.lit(RETAIL_EPOCH).cast("date"), (days % RETAIL_DAYS).cast("int"))


def days_since_epoch(d: str | Column) -> Column:
    return F.datediff(col(d), F.lit(RETAIL_EPOCH).cast("date"))
