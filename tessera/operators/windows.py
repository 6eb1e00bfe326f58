"""Window operators over (entity, month) panels. Frames count rows unless a calendar is asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import col


def by_entity(entity: str = "permno", month: str = "month"):
    return Window.partitionBy(entity).orderBy(month)


def lag(x: str | Column, n: int = 1, entity: str = "permno", month: str = "month") -> Column:
    return F.lag(col(x), n).over(by_entity(entity, month))


def rolling(fn, x: str | Column, n: int, least: int, entity: str = "permno", month: str = "month", calendar: bool = False) -> Column:
    """fn over the last n rows (with `calendar` the last n months), NULL below `least` values."""
    if calendar:
        index = F.year(month) * 12 + F.month(month)
        w = Window.partitionBy(entity).orderBy(index).rangeBetween(-(n - 1), 0)
    else:
        w = by_entity(entity, month).rowsBetween(-(n - 1), 0)
    return F.when(F.count(col(x)).over(w) >= least, fn(col(x)).over(w))


def log_return(ret: str | Column = "ret_adjusted") -> Column:
    return F.log1p(col(ret))


def prior_count(x: str, entity: str = "permno", month: str = "month") -> Column:
    """Values before this row; 0 on the first."""
    return F.count(x).over(by_entity(entity, month).rowsBetween(Window.unboundedPreceding, -1))


def rank_to_unit(df: DataFrame, names: list[str], month: str = "month", suffix: str = "") -> DataFrame:
    """Ranks within the month scaled to (-1, 1): 2 * average rank / (n + 1) - 1; NULL stays NULL.

    A single value in a month gets 0. All columns share one exchange by month; NULLs rank in
    a part of their own.
    """
    out = {}
    for name in names:
        part = Window.partitionBy(month, F.isnull(name)).orderBy(name)  # one sort gives ranks and ties
        ties = F.count(name).over(part.rangeBetween(Window.currentRow, Window.currentRow))
        average = F.rank().over(part) + (ties - 1) / 2
        out[name + suffix] = F.when(F.col(name).isNotNull(), 2 * average / (F.count(name).over(Window.partitionBy(month)) + 1) - 1)
    return df.withColumns(out)


#: Rows of one (month, column) up to which they are ranked together; more are cut into bands of values.
BAND_ROWS = 100_000
#: Bands at most, and rows drawn for each to place its edges.
MOST_BANDS, DRAWN = 128, 64
#: Parts over which rows on an edge are spread.
SPREAD = 64


def banded(long: DataFrame, keys: list[str], part: list[str], band_rows: int = BAND_ROWS) -> DataFrame:
    """long (keys, part, value) with `band`, which rises with value within its part, and `single`: whether the band is one value.

    The edges are evenly spaced ranks of rows drawn by a hash of their content, so they are the same
    whenever a task runs again. Each edge is a band of its own, hence a value that fills a large share of a part is
    almost surely one. Parts of up to band_rows rows are one band.
    """
    n, bands = F.col("_n"), F.col("_bands")
    sizes = long.groupBy(*part).agg(F.count("*").alias("_n")).filter(n > band_rows)
    sizes = sizes.withColumn("_bands", F.least(F.lit(MOST_BANDS), F.ceil(n / band_rows).cast("int")))
    each = F.greatest(F.lit(1), F.floor(n / (bands * DRAWN)))
    drawn = long.join(sizes, part).filter(F.pmod(F.xxhash64(*keys, *part, "value"), each) == 0)
    sample = drawn.groupBy(*part, "_bands").agg(F.array_sort(F.collect_list("value")).alias("_s"))
    at = F.transform(F.sequence(F.lit(1), bands - 1), lambda k: F.get("_s", F.floor(F.size("_s") * k / bands).cast("int")))
    edges = sample.select(*part, F.array_distinct(at).alias("_edges"))
    found = long.join(edges, part, "left")
    below = F.coalesce(F.size(F.filter("_edges", lambda e: e < F.col("value"))), F.lit(0))
    single = F.coalesce(F.array_contains("_edges", F.col("value")), F.lit(False))
    below = F.when(F.col("_edges").isNull(), 0).otherwise(below)
    return found.select(*long.columns, (2 * below + single.cast("int")).alias("band"), single.alias("single"))


def rank_long(df: DataFrame, names: list[str], keys: list[str], month: str = "month", band_rows: int = BAND_ROWS) -> DataFrame:
    """The same ranks for many columns at once: unpivoted, ranked by (month, name), long form (keys, name, score).

    A distributed rank: rows are ranked within bands of values, to which the counts of the bands below
    are added. So a large month is no one task's, and a value that many rows share needs no
    sorting: its rows are spread, and their rank follows from the counts alone.
    """
    part = [month, "name"]
    long = df.unpivot([*keys, month], names, "name", "value").filter("value IS NOT NULL")
    rows = banded(long, keys, part, band_rows)
    counts = rows.groupBy(*part, "band").agg(F.count("*").alias("_in"))
    counts = counts.select("_in", F.sum("_in").over(Window.partitionBy(*part)).alias("_n"), F.sum("_in").over(Window.partitionBy(*part).orderBy("band")).alias("_upto"), *(F.col(k).alias(f"_{k}") for k in [*part, "band"]))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*part, "band"]]  # also a missing month is a month
    spread = F.when(F.col("single"), F.pmod(F.xxhash64(*keys), F.lit(SPREAD))).otherwise(0)
    local = Window.partitionBy(*part, "band", "_spread").orderBy("value")
    peers = F.count("*").over(local.rangeBetween(Window.currentRow, Window.currentRow))
    ranked = rows.withColumn("_spread", spread).withColumn("_local", F.rank().over(local) + (peers - 1) / 2)
    within = F.when(F.col("single"), (F.col("_in") + 1) / 2).otherwise(F.col("_local"))
    return ranked.join(counts, same).select(*keys, month, "name", (2 * (F.col("_upto") - F.col("_in") + within) / (F.col("_n") + 1) - 1).alias("score"))


def top_k(df: DataFrame, by: str, k: int, group: str | list[str], tie: str = "permno", missing: float | None = None) -> DataFrame:
    """The k rows with the largest `by` of each group, ties by `tie`; NULLs last, or ranked as `missing`.

    Written so that Spark limits each task's rows to k a group before they are shuffled
    (k below spark.sql.optimizer.windowGroupLimitThreshold, by default 1000).
    """
    value = F.coalesce(by, F.lit(missing)) if missing is not None else F.col(by)
    rank = F.row_number().over(Window.partitionBy(*([group] if isinstance(group, str) else group)).orderBy(value.desc_nulls_last(), F.col(tie)))
    return df.withColumn("top_rank", rank).filter(F.col("top_rank") <= k)


def demean(x: str | Column, *group: str) -> Column:
    return col(x) - F.avg(col(x)).over(Window.partitionBy(*group))


def year_over_year(df: DataFrame, x: str, entity: str = "gvkey", month: str = "month") -> Column:
    """The value in the same calendar month of the entity's previous row for that month; NULL without an entity."""
    w = Window.partitionBy(entity, F.month(month)).orderBy(month)
    return F.when(F.col(entity).isNotNull(), F.lag(x).over(w))


def percent_change(x: str | Column, n: int, order: str = "month") -> Column:
    """Change over n rows of a series; the series is one part, so it must be small (months)."""
    before = F.lag(col(x), n).over(Window.orderBy(order))
    return F.try_divide(col(x), before) - 1


def winsorise(df: DataFrame, x: str, p: float = 0.01, group: str = "month", out: str | None = None) -> DataFrame:
    """x limited to its p and 1 - p quantiles within the group."""
    from tessera.operators.aggregates import quantiles  # which needs this module

    limits = quantiles(df, [x], [p, 1 - p], group).groupBy(group).agg(F.min("value").alias("_low"), F.max("value").alias("_high"))
    bounded = F.least(F.greatest(F.col(x), F.col("_low")), F.col("_high"))
    return df.join(limits.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g")), "left").withColumn(out or x, F.when(F.col(x).isNotNull(), bounded)).drop("_g", "_low", "_high")


def trailing_rank_mean(df: DataFrame, x: str, months: int = 3, entity: str = "permno", month: str = "month") -> DataFrame:
    """(entity, month, smooth): the mean of the last `months` months' cross-sectional ranks, over those present."""
    ranked = rank_to_unit(df.select(entity, month, x), [x], month, "_rank").filter(F.col(f"{x}_rank").isNotNull())
    spread = ranked.select(entity, F.explode(F.transform(F.sequence(F.lit(0), F.lit(months - 1)), lambda k: F.add_months(F.col(month), k))).alias(month), F.col(f"{x}_rank").alias("_r"))
    present = df.select(F.col(month)).distinct()
    return spread.join(F.broadcast(present), month, "left_semi").groupBy(entity, month).agg(F.avg("_r").alias("smooth"))


def spans(df: DataFrame, flag: str, order: str = "month") -> DataFrame:
    """(state, first, last, n) of the runs of a 0/1 series, in order."""
    w = Window.orderBy(order)
    turn = F.when(F.col(flag).eqNullSafe(F.lag(flag).over(w)), 0).otherwise(1)
    marked = df.withColumn("_turn", turn).withColumn("_run", F.sum("_turn").over(w))
    return marked.groupBy("_run", F.col(flag).alias("state")).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("_run")


def closed_spans(df: DataFrame, flag: str, order: str = "month") -> DataFrame:
    """(start, end) of the runs of 1: to the row that ends them, or to the month end of the last row."""
    w = Window.orderBy(order)
    runs = spans(df, flag, order).filter("state = 1")
    following = df.select(F.col(order).alias("last"), F.lead(order).over(w).alias("_next"))
    return runs.join(following, "last").select(F.col("first").alias("start"), F.coalesce("_next", F.last_day("last")).alias("end"))


def nav(ret: str = "net_return", group: str = "model", month: str = "month") -> Column:
    """Cumulative product of 1 + return."""
    return F.exp(F.sum(F.log1p(ret)).over(Window.partitionBy(group).orderBy(month)))


def drawdown(df: DataFrame, ret: str = "net_return", group: str = "model", month: str = "month") -> DataFrame:
    """nav, peak and drawdown of each row."""
    at = df.withColumn("nav", nav(ret, group, month))
    at = at.withColumn("peak", F.max("nav").over(Window.partitionBy(group).orderBy(month)))
    return at.withColumn("drawdown", F.col("nav") / F.col("peak") - 1)


def rolling_sharpe(x: str, n: int = 60, group: str = "model", month: str = "month") -> Column:
    """Annualised mean over population deviation of the last n rows; NULL before, or without variation."""
    w = Window.partitionBy(group).orderBy(month).rowsBetween(-(n - 1), 0)
    sd = F.stddev_pop(x).over(w)
    return F.when((F.count(x).over(w) >= n) & (sd > 1e-10), F.avg(x).over(w) / sd * F.sqrt(F.lit(12.0)))


def rolling_mean(x: str | Column, n: int = 12, group: str = "model", month: str = "month") -> Column:
    w = Window.partitionBy(group).orderBy(month).rowsBetween(-(n - 1), 0)
    return F.when(F.count(col(x)).over(w) >= n, F.avg(col(x)).over(w))
