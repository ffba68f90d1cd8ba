"""Column-expression builders. All built-in Spark functions (codegen, no UDFs)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --------------------------------------------------------------------------- missing values

def nan_to_null(c) -> Column:
    """A double with NaN turned into NULL (Spark sorts NaN above every number)."""
    c = _c(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def csv_na_to_null(c) -> Column:
    """A CSV text with the pandas missing-value tokens turned into NULL."""
    c = _c(c)
    return F.when(c.isin(*S.CSV_NA_TOKENS), F.lit(None).cast("string")).otherwise(c)


WHITESPACE = " \t\n\x0b\x0c\r"


def strip_ws(c) -> Column:
    """Trim leading/trailing white space (tabs and newlines too); no regex."""
    return F.btrim(_c(c), F.lit(WHITESPACE))


def request_missing(c, trimmed=None) -> Column:
    """True where a request text means "missing": NULL, exactly empty, a
    missing token in any case, or a text that parses to NaN."""
    c = _c(c)
    t = strip_ws(c) if trimmed is None else _c(trimmed)
    return (
        c.isNull()
        | (c == F.lit(""))
        | F.lower(c).isin(*S.REQUEST_NA_TOKENS)
        | F.lower(t).isin("nan", "+nan", "-nan")
    )


def finite(num) -> Column:
    """Non-NULL, not NaN, not infinite (NULL in gives False)."""
    num = _c(num)
    return F.coalesce(num.isNotNull() & ~F.isnan(num) & (F.abs(num) != F.lit(float("inf"))),
                      F.lit(False))


# --------------------------------------------------------------------------- strata

def row_mean(cols: Sequence[str]) -> Column:
    """Mean of the non-null values of a row; NULL when all are NULL."""
    total = None
    count = None
    for name in cols:
        v = F.coalesce(F.col(name), F.lit(0.0))
        n = F.col(name).isNotNull().cast("int")
        total = v if total is None else total + v
        count = n if count is None else count + n
    return F.when(count > 0, total / count)


def equal_width_bin(x, mn, mx, labels: Sequence[str]) -> Column:
    """Equal-width, right-closed bin label over [mn, mx] with ``len(labels)`` bins.

    Edges are ``mn + i * ((mx - mn) / k)``; a value goes to the first bin whose
    upper edge it does not exceed. A constant column (mn == mx) lands in the
    middle bin ``(k + 1) // 2``. NULL in, NULL out.
    """
    x = _c(x)
    mn = mn if isinstance(mn, Column) else F.lit(float(mn) if mn is not None else None)
    mx = mx if isinstance(mx, Column) else F.lit(float(mx) if mx is not None else None)
    k = len(labels)
    step = (mx - mn) / F.lit(float(k))
    expr = F.when(x.isNull(), F.lit(None).cast("string"))
    expr = expr.when(mn == mx, F.lit(labels[(k + 1) // 2 - 1]))
    for i in range(1, k):
        expr = expr.when(x <= mn + F.lit(float(i)) * step, F.lit(labels[i - 1]))
    return expr.otherwise(F.lit(labels[-1]))


# --------------------------------------------------------------------------- ordering

def hash_order(key, tag: str) -> Column:
    """Seeded pseudo-random order: md5 of ``tag || key`` (same text in DuckDB)."""
    return F.md5(F.concat(F.lit(tag), _c(key).cast("string")))


def hash_prefix(h) -> Column:
    """First 60 bits of an md5 hex text as a non-negative bigint; monotone in the text."""
    return F.conv(F.substring(_c(h), 1, 15), 16, 10).cast("long")


# --------------------------------------------------------------------------- status

def status(floor_weeks, clamp_negative: bool = False) -> Column:
    """Component status from floor weeks; NULL for a NULL floor."""
    f = _c(floor_weeks)
    if clamp_negative:
        f = F.greatest(f, F.lit(0.0))
    return (
        F.when(f.isNull(), F.lit(None).cast("string"))
        .when(f == 0, F.lit(S.STATUS_CRITICAL))
        .when(f <= S.URGENT_MAX_WEEKS, F.lit(S.STATUS_URGENT))
        .when(f <= S.SOON_MAX_WEEKS, F.lit(S.STATUS_SOON))
        .when(f <= S.NORMAL_MAX_WEEKS, F.lit(S.STATUS_NORMAL))
        .otherwise(F.lit(S.STATUS_GOOD))
    )


def _recommendation(min_floor, part: int) -> Column:
    f = _c(min_floor)
    r = S.RECOMMENDATIONS
    return (
        F.when(f.isNull(), F.lit(None).cast("string"))
        .when(f == 0, F.lit(r["critical"][part]))
        .when(f <= S.URGENT_MAX_WEEKS, F.lit(r["urgent"][part]))
        .when(f <= S.SOON_MAX_WEEKS, F.lit(r["soon"][part]))
        .when(f <= S.NORMAL_MAX_WEEKS, F.lit(r["normal"][part]))
        .otherwise(F.lit(r["good"][part]))
    )


def recommendation_title(min_floor) -> Column:
    return _recommendation(min_floor, 0)


def recommendation_detail(min_floor) -> Column:
    return _recommendation(min_floor, 1)


def priority(floor_weeks) -> Column:
    f = _c(floor_weeks)
    return (
        F.when(f.isNull(), F.lit(None).cast("string"))
        .when(f <= S.URGENT_MAX_WEEKS, F.lit(S.PRIORITY_HIGH))
        .when(f <= S.SOON_MAX_WEEKS, F.lit(S.PRIORITY_MEDIUM))
        .otherwise(F.lit(S.PRIORITY_LOW))
    )


def days_since_guidance(feature) -> Column:
    """``Days since <third '_' part> maintenance``."""
    part = F.split(_c(feature), "_").getItem(2)
    return F.concat(F.lit("Days since "), part, F.lit(" maintenance"))
