"""Aggregations: breakpoints, coverage, funnels, fits and series statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tessera.operators.windows import rank_to_unit


#: Rows up to which all of a group's values are looked through; of larger groups only those around the rank are.
BAND_ROWS = 100_000
#: Of the sketch that finds them: its ranks are off by n / SKETCH at most.
SKETCH = 10_000


def quantiles(df: DataFrame, names: Sequence[str], qs: Sequence[float], group: str | None = None, band_rows: int = BAND_ROWS, sketch: int = SKETCH) -> DataFrame:
    """(group,) name, q, value, n: interpolated quantiles of the non-NULL values, exact at any size.

    Distributed selection: a sketch of each column brackets the wanted rank, with ranks to spare for
    its error. The next pass counts what lies below the bracket as one row and the values inside
    one by one, both added up before they are sent. So a task holds the values around one rank, of large
    groups a share of 6 / sketch, and never a whole group.
    """
    keys = [group] if group else []
    long = df.select(*keys, *(F.col(n).cast("double").alias(n) for n in names)).unpivot(keys, list(names), "name", "value").filter("value IS NOT NULL")
    keys = [*keys, "name"]
    ends = [min(1.0, max(0.0, q + side * 3 / sketch)) for q in qs for side in (-1, 1)]
    rough = long.groupBy(*keys).agg(F.count("*").alias("n"), F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.percentile_approx("value", F.array(*(F.lit(e) for e in ends)), sketch).alias("_at"))
    small = F.col("n") <= band_rows
    bands = F.array(*(F.struct(F.lit(float(q)).alias("q"), F.when(small, F.col("_lo")).otherwise(F.col("_at")[2 * k]).alias("lo"), F.when(small, F.col("_hi")).otherwise(F.col("_at")[2 * k + 1]).alias("hi")) for k, q in enumerate(qs)))
    rough = rough.select(*(F.col(k).alias(f"_{k}") for k in keys), "n", bands.alias("bands"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    near = long.join(rough, same).select(*keys, "value", "n", F.explode("bands").alias("band")).filter(F.col("value") <= F.col("band.hi"))
    inside = F.col("value") >= F.col("band.lo")
    counts = near.groupBy(*keys, "n", F.col("band.q").alias("q"), F.when(inside, F.col("value")).alias("value"), inside.alias("inside")).agg(F.count("*").alias("c"))
    # false sorts first: the one row of all values below
    upto = F.sum("c").over(Window.partitionBy(*keys, "q").orderBy("inside", "value").rowsBetween(Window.unboundedPreceding, 0))
    place = (F.col("n") - 1) * F.col("q")
    at = lambda rank: F.min(F.when(F.col("inside") & (F.col("upto") > rank), F.col("value")))
    found = counts.withColumn("upto", upto).groupBy(*keys, "q", "n").agg(at(F.floor(place)).alias("low"), at(F.ceil(place)).alias("high"))
    share = place - F.floor(place)
    return found.select(*keys, "q", F.when(share == 0, F.col("low")).otherwise((1 - share) * F.col("low") + share * F.col("high")).alias("value"), "n")


def group_quantile(df: DataFrame, x: str, q: float, group: str, where: Column | None = None, entity: str = "permno") -> DataFrame:
    """group, threshold (interpolated quantile) and n (distinct entities) over the rows that `where` selects."""
    base = df.filter(where) if where is not None else df
    counts = base.groupBy(F.col(group).alias("_g")).agg(F.count_distinct(entity).alias("n"))
    limits = quantiles(base, [x], [q], group).select(group, F.col("value").alias("threshold"))
    return counts.join(limits, F.col("_g").eqNullSafe(F.col(group)), "left").select(F.col("_g").alias(group), "threshold", "n")


def funnel(df: DataFrame, conditions: dict[str, Column], group: str) -> DataFrame:
    """Rows of each group that pass the first, the first two, ... conditions, in one pass."""
    passed, out = F.lit(True), []
    for name, condition in conditions.items():
        passed = passed & F.coalesce(condition, F.lit(False))
        out.append(F.count_if(passed).alias(name))
    return df.groupBy(group).agg(F.count("*").alias("n_all"), *out)


def coverage(df: DataFrame, names: Sequence[str], group: str | None = None) -> DataFrame:
    """(group,) name, coverage: the share of non-NULL values of each column, from one pass."""
    keys = [group] if group else []
    shares = df.groupBy(*keys).agg(*(F.avg(F.col(n).isNotNull().cast("int")).alias(n) for n in names))
    return shares.unpivot(keys, list(names), "name", "coverage")


def mean_missing(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The mean over columns of each column's missing share, as one row."""
    return coverage(df, names).agg((1 - F.avg("coverage")).alias("mean_missing"))


def dense_columns(df: DataFrame, names: Sequence[str], most_missing: float) -> list[str]:
    """Names whose missing share is at most the limit, in their order."""
    shares = {r["name"]: r["coverage"] for r in coverage(df, names).collect()}
    return [n for n in names if shares[n] is not None and 1 - shares[n] <= most_missing]


def compound(x: str = "ret") -> Column:
    """Geometric compounding; returns above -100 % are needed for the logarithm, a total loss gives -1."""
    total_loss = F.max(F.when(F.col(x) <= -1, 1).otherwise(0)) == 1
    return F.when(total_loss, -1.0).otherwise(F.expm1(F.sum(F.when(F.col(x) > -1, F.log1p(x)))))


def collapse(df: DataFrame, keys: Sequence[str], *values: str) -> DataFrame:
    """One row per key with the means of its rows."""
    return df.groupBy(*keys).agg(*(F.avg(v).alias(v) for v in values))


def medians(df: DataFrame, names: Sequence[str], group: str | None = None, least: int = 5) -> DataFrame:
    """Overall or group medians, exact at any size; a group's is NULL below `least` values."""
    keys = [group] if group else []
    found = quantiles(df, names, [0.5], group)
    wide = found.groupBy(*keys).agg(*(F.max(F.when((F.col("name") == n) & (F.col("n") >= (least if group else 1)), F.col("value"))).alias(n) for n in names))
    if group is None:
        return wide
    every = df.select(F.col(group).alias("_g")).distinct()  # also groups without a value
    return every.join(wide, F.col("_g").eqNullSafe(F.col(group)), "left").select(F.col("_g").alias(group), *names)


def scaler(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """name, mean, std (sample; 1 where it is nearly 0 or missing) of each column."""
    long = df.unpivot([], list(names), "name", "value")
    std = F.stddev_samp("value")
    return long.groupBy("name").agg(F.avg("value").alias("mean"), F.when(std < 1e-12, 1.0).otherwise(F.coalesce(std, F.lit(1.0))).alias("std"))


def zero_r2(df: DataFrame, y: str = "y", p: str = "p", group: str | None = None, least: int = 5) -> DataFrame:
    """1 - sum of squared errors over sum of squares (benchmark 0), overall or per group with `least` rows."""
    at = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
    r2 = 1 - F.try_divide(F.sum((F.col(y) - F.col(p)) * (F.col(y) - F.col(p))), F.sum(F.col(y) * F.col(y)))
    out = at.groupBy(*([group] if group else [])).agg(F.count("*").alias("n"), r2.alias("r2"))
    return out.filter(F.col("n") >= least) if group else out


def rank_correlation(df: DataFrame, x: str, entity: str = "permno", year: str = "year", least: int = 20) -> DataFrame:
    """year, n, rank_corr of entities' yearly means with those of the year before, over common entities."""
    means = df.groupBy(entity, year).agg(F.avg(x).alias("m"))
    both = means.join(means.select(entity, (F.col(year) + 1).alias(year), F.col("m").alias("before")), [entity, year]).filter("m IS NOT NULL AND before IS NOT NULL")
    ranked = rank_to_unit(both, ["m", "before"], year, "_rank")
    return ranked.groupBy(year).agg(F.count("*").alias("n"), F.corr("m_rank", "before_rank").alias("rank_corr")).filter(F.col("n") >= least)


def describe(df: DataFrame, x: str, group: str) -> DataFrame:
    """Mean, median (exact, by distributed selection), least, largest and most common value of each group; of equally common the least."""
    counts = df.filter(F.col(x).isNotNull()).groupBy(group, x).agg(F.count("*").alias("_n"))
    modes = counts.groupBy(group).agg(F.min_by(x, F.struct(-F.col("_n"), F.col(x))).alias("mode"))
    stats = df.groupBy(group).agg(F.avg(x).alias("mean"), F.min(x).alias("low"), F.max(x).alias("high"))
    middle = quantiles(df, [x], [0.5], group).select(F.col(group).alias("_g"), F.col("value").alias("median"))
    stats = stats.join(middle, F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g")
    modes = modes.withColumnRenamed(group, "_g")
    return stats.join(modes, F.col(group).eqNullSafe(F.col("_g")), "left").select(group, "mean", "median", "low", "high", "mode")


def last_of_month(df: DataFrame, x: str, day: str) -> DataFrame:
    """month_end and the last non-NULL value of each calendar month."""
    return df.filter(F.col(x).isNotNull()).groupBy(F.last_day(day).alias("month_end")).agg(F.max_by(x, day).alias(x))


def dispersion(df: DataFrame, x: str, group: str = "year") -> DataFrame:
    """Sample deviation of x within each group."""
    return df.groupBy(group).agg(F.stddev_samp(x).alias("std"))


def common_window(df: DataFrame, group: str = "model", month: str = "month") -> DataFrame:
    """Rows between the latest first and the earliest last month of the groups."""
    ends = df.groupBy(group).agg(F.min(month).alias("lo"), F.max(month).alias("hi")).agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"))
    return df.join(F.broadcast(ends), F.col(month).between(F.col("lo"), F.col("hi")), "left_semi")


def entity_sample(df: DataFrame, n: int, entity: str = "permno", seed: int = 42) -> DataFrame:
    """Rows of n entities, the same for the same seed."""
    chosen = df.select(entity).distinct().orderBy(F.md5(F.concat_ws(":", F.col(entity).cast("string"), F.lit(str(seed)))), entity).limit(n)
    return df.join(F.broadcast(chosen) if n <= 100_000 else chosen, entity, "left_semi")


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in the given order, which should be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df with a check in its plan: whatever reads it fails at a repeated key and names it; no job of its own."""
    message = F.concat(F.lit("key "), F.to_json(F.struct(*keys)), F.lit(" occurs "), F.col("_times").cast("string"), F.lit(" times"))
    counted = df.withColumn("_times", F.count("*").over(Window.partitionBy(*keys)))
    return counted.filter(F.when(F.col("_times") > 1, F.raise_error(message).cast("boolean")).otherwise(True)).drop("_times")


def assert_before(train: DataFrame, test: DataFrame, month: str = "month") -> DataFrame:
    """test with a check in its plan: reading it fails unless all its months lie after those of train."""
    end = train.agg(F.max(month).alias("_end"))  # one row
    message = F.concat(F.lit("training data reach "), F.col("_end").cast("string"), F.lit(", test data have "), F.col(month).cast("string"))
    early = F.col(month) <= F.col("_end")
    return test.crossJoin(F.broadcast(end)).filter(F.when(early, F.raise_error(message).cast("boolean")).otherwise(True)).drop("_end")


def watch_nulls(df: DataFrame, names: Sequence[str], where: Column) -> tuple[DataFrame, Observation]:
    """df, and an observation that holds the missing shares of the columns inside a window once df has been written or read."""
    seen = Observation("nulls")
    inside = F.coalesce(where, F.lit(False))
    return df.observe(seen, *(F.try_divide(F.count_if(inside & F.col(n).isNull()), F.count_if(inside)).alias(n) for n in names)), seen


def null_rates(df: DataFrame, names: Sequence[str], where: Column) -> DataFrame:
    """name, missing: NULL shares of the columns inside a window."""
    return coverage(df.filter(where), names).select("name", (1 - F.col("coverage")).alias("missing"))
