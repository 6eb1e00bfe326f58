"""Column expressions of the panel. Missing is always NULL; division by zero is NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_number(x: Column | str) -> Column:
    """Numeric value, NULL for text that is none and for NaN."""
    d = col(x).try_cast("double")
    return F.when(~F.isnan(d), d)


def to_date(x: Column | str, open_mark: str | None = None) -> Column:
    """Date value, NULL for text that is none and for the mark of an open end."""
    value = col(x).cast("string")
    if open_mark is not None:
        value = F.nullif(value, F.lit(open_mark))
    return value.try_cast("date")


def absolute_price(prc: Column | str) -> Column:
    """Prices are stored negative where they are quote midpoints."""
    return F.abs(col(prc))


def adjusted_return(ret: Column | str = "ret", dlret: Column | str = "dlret") -> Column:
    """Return compounded with the delisting return; NULL without a return."""
    return (1 + col(ret)) * (1 + F.coalesce(col(dlret), F.lit(0.0))) - 1


def market_cap(prc: Column | str = "prc", shrout: Column | str = "shrout") -> Column:
    return col(prc) * col(shrout)


def yyyymm(month: Column | str = "month") -> Column:
    return F.year(col(month)) * 100 + F.month(col(month))


def month_of(code: Column | str) -> Column:
    """First day of the month of a yyyymm number."""
    c = col(code).cast("int")
    return F.make_date((c / 100).cast("int"), c % 100, F.lit(1))


def month_start(day: Column | str) -> Column:
    return F.trunc(col(day), "month")


def not_currency(curcd: Column | str, excluded: str = "CAD") -> Column:
    """True unless the currency is the excluded one; rows without a currency stay."""
    return ~col(curcd).eqNullSafe(F.lit(excluded))


def available_from(day: Column | str, lag_months: int = 6) -> Column:
    """Publication date of figures for a period that ended on `day`."""
    return F.add_months(col(day), lag_months)


def shift_month(month: Column | str, n: int) -> Column:
    return F.add_months(col(month), n)


def month_end(day: Column | str) -> Column:
    return F.last_day(col(day))


def decimal_month(x: Column | str) -> Column:
    """Month end of a decimal year such as 1975.01; month parts outside 1..12 are moved inside."""
    part = F.round((col(x) % 1) * 100).cast("int")
    return F.last_day(F.make_date(F.floor(col(x)).cast("int"), F.least(F.greatest(part, F.lit(1)), F.lit(12)), F.lit(1)))


def ratio(x: Column | str, y: Column | str) -> Column:
    return F.try_divide(col(x), col(y))


def book_equity(ceq="ceq", txditc="txditc", pstk="pstk") -> Column:
    return col(ceq) + F.coalesce(col(txditc), F.lit(0.0)) - F.coalesce(col(pstk), F.lit(0.0))


def net_operating_assets(at="at_total", che="che", lt="lt", dltt="dltt") -> Column:
    return (col(at) - col(che)) - (col(lt) - col(dltt))


def book_to_market(be="be", cap="market_cap", epsilon: float = 1e-8) -> Column:
    return F.try_divide(col(be), col(cap) + F.lit(epsilon))


def illiquidity(ret="ret", prc="prc", vol="vol") -> Column:
    return F.try_divide(F.abs(col(ret)), col(prc) * col(vol))


def industry(siccd: Column | str = "siccd", digits: int = 2, divide: bool = False) -> Column:
    """Industry group: the code's first digits as text, or the code divided by ten; 'unknown' without a code."""
    code = (col(siccd).cast("int") / 10).cast("int").cast("string") if divide else F.substring(col(siccd).cast("string"), 1, digits)
    return F.coalesce(code, F.lit("unknown"))


def band(x: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """'LOW' below the first limit, 'HIGH' above the second, else 'OK'; NULL is 'OK'."""
    out = F.lit("OK")
    if high is not None:
        out = F.when(col(x) > high, "HIGH").otherwise(out)
    if low is not None:
        out = F.when(col(x) < low, "LOW").otherwise(out)
    return out


def macro_spreads(long="gs10", short="tb3ms", inflation="inflation", baa="baa", aaa="aaa") -> dict[str, Column]:
    return {"term_spread": col(long) - col(short), "real_short_rate": col(short) - col(inflation), "default_spread": col(baa) - col(aaa)}
