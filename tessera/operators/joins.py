"""Joins of panels: memberships, validity intervals, as-of, aligned series and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Months of a series; a series of this length or less may be broadcast.
SERIES_ROWS = 20_000


def members_only(df: DataFrame, membership: DataFrame, keys: tuple[str, ...] = ("permno", "month")) -> DataFrame:
    """Rows whose key is in the membership table, which need not be unique."""
    return df.join(membership.select(*keys), list(keys), "left_semi")


def with_series(df: DataFrame, series: DataFrame, month: str = "month") -> DataFrame:
    """Left join of monthly series, one row per month; an error where a column would be doubled."""
    twice = set(df.columns) & set(series.columns) - {month}
    if twice:
        raise ValueError(f"columns on both sides: {sorted(twice)}")
    return df.join(F.broadcast(series) if series.count() <= SERIES_ROWS else series, month, "left")


def link_join(figures: DataFrame, links: DataFrame, valid_dates: bool = True, primary: tuple[str, ...] = ("P", "C")) -> DataFrame:
    """figures (gvkey, available) with the permno of each primary link, valid on the day the figures are available."""
    usable = links.filter(F.col("linkprim").isin(*primary)).select(F.col("gvkey"), F.col("lpermno").alias("permno"), "linkdt", "linkenddt")
    out = figures.join(usable, "gvkey")
    if valid_dates:
        out = out.filter((F.col("linkdt") <= F.col("available")) & (F.col("linkenddt").isNull() | (F.col("available") <= F.col("linkenddt"))))
    return out.drop("linkdt", "linkenddt")


def link_join_by_year(figures: DataFrame, links: DataFrame, stock: DataFrame, year: str = "fyear", primary: tuple[str, ...] = ("P", "C")) -> DataFrame:
    """figures of each linked permno beside all its stock rows of the same calendar year, whatever the link's dates."""
    linked = link_join(figures, links, False, primary).distinct()
    return linked.join(stock.withColumn(year, F.year("month")), ["permno", year])


#: Parts that left rows without an entity are dealt to.
NO_ENTITY_PARTS = 1024


def asof_backward(left: DataFrame, right: DataFrame, entity: str = "permno", at: str = "month", from_: str = "available", max_age: int | None = None, order: str | None = None) -> DataFrame:
    """Each left row with the entity's latest right row of from_ <= at, or NULLs.

    Both sides are united and sorted once by entity and time, right rows first; a left row gets
    the last right row before it, so no left row meets more than its own. Of right rows with one
    (entity, from_) the last by `order` counts. `max_age` limits the distance in days. Left rows
    without an entity or a time meet nothing.
    """
    keep = [n for n in right.columns if n != entity]
    nothing = lambda df, names: F.lit(None).cast(df.select(F.struct(*names)).schema[0].dataType)
    whole, row = F.struct(*(F.col(f"`{n}`") for n in left.columns)), F.struct(*(F.col(f"`{n}`") for n in keep))
    rank = F.col(order) if order is not None else F.lit(0)
    part = F.when(F.col(entity).isNull(), F.pmod(F.xxhash64(*(F.col(f"`{n}`") for n in left.columns)), F.lit(NO_ENTITY_PARTS)))
    asks = left.select(F.col(entity).alias("_e"), part.alias("_part"), F.col(at).alias("_at"), F.lit(1).alias("_side"), (F.lit(None).cast(right.schema[order].dataType) if order is not None else F.lit(0)).alias("_rank"), whole.alias("_left"), nothing(right, keep).alias("_right"))
    known = right.filter(F.col(entity).isNotNull() & F.col(from_).isNotNull())
    known = known.select(F.col(entity).alias("_e"), F.lit(None).cast("bigint").alias("_part"), F.col(from_).alias("_at"), F.lit(0).alias("_side"), rank.alias("_rank"), nothing(left, left.columns).alias("_left"), row.alias("_right"))
    over = Window.partitionBy("_e", "_part").orderBy("_at", "_side", "_rank").rowsBetween(Window.unboundedPreceding, 0)
    latest = F.last("_right", ignorenulls=True).over(over)
    found = asks.unionByName(known).withColumn("_right", latest).filter("_side = 1")
    if max_age is not None:
        found = found.withColumn("_right", F.when(F.datediff("_at", F.col("_right")[from_]) <= max_age, F.col("_right")))
    return found.select(*(F.col("_left")[n].alias(n) for n in left.columns), *(F.col("_right")[n].alias(n) for n in keep))


def fill_forward(months: DataFrame, series: DataFrame, names: list[str], month: str = "month") -> DataFrame:
    """For every month the series' last row at or before it: a window over the union, as both are short."""
    both = months.select(month, F.lit(1).alias("_ask")).join(series, month, "full_outer")
    w = Window.orderBy(month).rowsBetween(Window.unboundedPreceding, 0)
    row = F.last(F.when(F.col(names[0]).isNotNull(), F.struct(*names)), ignorenulls=True).over(w)
    return both.withColumn("_row", row).filter("_ask = 1").select(month, *(F.col("_row")[n].alias(n) for n in names))


def aligned(a: DataFrame, b: DataFrame, keys: list[str], value: str = "weight") -> DataFrame:
    """Both values on the union of the keys, 0 where one side lacks the key."""
    x = a.select(*keys, F.col(value).alias("a"))
    y = b.select(*keys, F.col(value).alias("b"))
    return x.join(y, keys, "full_outer").select(*keys, F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))


def lagged_pairs(target: DataFrame, series: DataFrame, months: int = 1, month: str = "month") -> DataFrame:
    """target rows beside the series' row `months` earlier; months that either lacks are dropped."""
    return target.join(series.withColumn(month, F.add_months(month, months)), month)


def splice(first: DataFrame, second: DataFrame, value: str, least_overlap: int = 13, month: str = "month") -> DataFrame:
    """first where it has a value, else second, rescaled by the ratio of the means where both have one.

    With fewer than `least_overlap` common months the scale is 1.
    """
    both = first.select(month, F.col(value).alias("a")).join(second.select(month, F.col(value).alias("b")), month, "full_outer")
    common = F.col("a").isNotNull() & F.col("b").isNotNull()
    scale = both.agg(F.when(F.count_if(common) >= least_overlap, F.try_divide(F.avg(F.when(common, F.col("a"))), F.avg(F.when(common, F.col("b"))))).otherwise(1.0).alias("scale"))
    return both.crossJoin(F.broadcast(scale)).select(month, F.coalesce("a", F.col("b") * F.col("scale")).alias(value))


def trailing_window(panel: DataFrame, forms: DataFrame, months: int, month: str = "month") -> DataFrame:
    """Every panel row once for each formation month whose last `months` months hold it.

    A short list of formation months (up to SERIES_ROWS) picks a row's months before it is multiplied.
    """
    known = [r[0] for r in forms.select("form_month").distinct().limit(SERIES_ROWS + 1).collect()]
    ahead = F.transform(F.sequence(F.lit(0), F.lit(months - 1)), lambda k: F.add_months(F.col(month), k))
    if len(known) <= SERIES_ROWS:
        wanted = F.array(*(F.lit(d) for d in sorted(known))).cast("array<date>")
        return panel.select("*", F.explode(F.array_intersect(ahead, wanted)).alias("form_month"))
    return panel.select("*", F.explode(ahead).alias("form_month")).join(forms.select("form_month"), "form_month", "left_semi")
