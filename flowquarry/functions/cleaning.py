"""Cleaning expressions for ids, periods and amounts, all inside the JVM.

Every function takes a column or its name and returns a column; null in gives null out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = " \t\r\n\x0b\x0c"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def canonical_id(c: Column | str) -> Column:
    """Text id trimmed, without a decimal tail of zeros and without leading zeros; blank gives null.

    An id of zeros only becomes ``'0'``.
    """
    c = _col(c).cast("string")
    t = F.btrim(c, F.lit(WHITESPACE))
    t = F.regexp_replace(t, r"\.0+$", "")
    t = F.regexp_replace(t, r"^0+(.)", "$1")
    # Most ids are clean already; one cheap test spares them two replacements.
    return F.when(c.rlike(r"^[1-9][0-9]*$"), c).otherwise(F.nullif(t, F.lit("")))


def _digits(c: Column | str) -> Column:
    return F.translate(_col(c).cast("string"), "-/.: T" + WHITESPACE[1:], "")


def month_key(c: Column | str) -> Column:
    """``YYYY-MM`` of a month or day in any of the notations YYYY-MM, YYYYMM, YYYY/MM or with a day; else null."""
    d = _digits(c)
    return F.when(d.rlike(r"^[0-9]{4}(0[1-9]|1[0-2])"), F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2)))


def day_date(c: Column | str) -> Column:
    """DATE of a day in the notations YYYY-MM-DD, YYYYMMDD or YYYY/MM/DD; else null."""
    d = F.substring(_digits(c), 1, 8)
    return F.try_to_timestamp(d, F.lit("yyyyMMdd")).cast("date")


def month_index(month: Column | str) -> Column:
    """year * 12 + month - 1 of a ``YYYY-MM`` key."""
    m = _col(month)
    return F.substring(m, 1, 4).cast("int") * 12 + F.substring(m, 6, 2).cast("int") - 1


def cents(c: Column | str) -> Column:
    """Dollars as whole cents (bigint); non-finite amounts give null."""
    c = _col(c).cast("double")
    finite = ~F.isnan(c) & (F.abs(c) < F.lit(9.0e16))
    return F.when(finite, F.round(c * 100).cast("bigint"))


def zip3(c: Column | str) -> Column:
    """Zip3 padded to three digits; blank gives null."""
    t = F.nullif(F.btrim(_col(c).cast("string"), F.lit(WHITESPACE)), F.lit(""))
    return F.when(F.length(t) < 3, F.lpad(t, 3, "0")).otherwise(t)


def located(lat: Column | str, lon: Column | str) -> Column:
    """True if both coordinates are finite, not both 0 and within +-90 and +-180; never null."""
    lat, lon = _col(lat), _col(lon)
    ok = ~F.isnan(lat) & ~F.isnan(lon) & lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0) & ~((lat == 0) & (lon == 0))
    return F.coalesce(ok, F.lit(False))


def safe_divide(n: Column | str, d: Column | str) -> Column:
    """n / d where d > 0, else null."""
    n, d = _col(n), _col(d)
    return F.when(d > 0, n / F.when(d > 0, d))


# The same rules as SQL text, for the reference queries that run beside Spark's.


def sql_id(c: str) -> str:
    t = rf"regexp_replace(trim({c}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '\.0+$', '')"
    return rf"nullif(regexp_replace({t}, '^0+(.)', '\1'), '')"


def sql_digits(c: str) -> str:
    return f"replace(replace(replace(trim({c}), '-', ''), '/', ''), '.', '')"


def sql_month(c: str) -> str:
    d = sql_digits(c)
    return f"(substr({d}, 1, 4) || '-' || substr({d}, 5, 2))"


def sql_day(c: str) -> str:
    return f"CAST(strptime(substr({sql_digits(c)}, 1, 8), '%Y%m%d') AS DATE)"


def sql_cents(c: str) -> str:
    return f"CAST(round({c} * 100) AS BIGINT)"
