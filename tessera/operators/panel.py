"""Panel recipes: universes, characteristics, point-in-time accounting data, macro and signal tables, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import columns as c
from tessera.operators import aggregates as a
from tessera.operators import joins as j
from tessera.operators import windows as w
from tessera.sources import readers


def snapshots(stock: DataFrame, month: int = 6) -> DataFrame:
    """The stock rows of one calendar month, with `year` and the number of earlier returns."""
    counted = stock.withColumn("n_prior", w.prior_count("ret"))
    return counted.filter(F.month("month") == month).withColumn("year", F.year("month"))


def screened(stock: DataFrame, q: float = 0.35, exchange: int = 0, least_price: float = 1.0, least_history: int = 24) -> DataFrame:
    """June snapshots beside the year's size threshold and the three screens."""
    june = snapshots(stock)
    limits = a.group_quantile(june, "market_cap", q, "year", F.col("exchcd") == exchange).withColumnRenamed("n", "n_reference")
    return june.join(limits, "year", "left").withColumns(
        {"by_size": F.col("market_cap") >= F.col("threshold"), "by_price": F.col("prc") >= least_price, "by_history": F.col("n_prior") >= least_history}
    )


def holding_months(yearly: DataFrame, first_month: int = 7, months: int = 12) -> DataFrame:
    """permno, month: each yearly member held for `months` months from `first_month` of its year."""
    start = F.make_date("year", F.lit(first_month), F.lit(1))
    return yearly.select("permno", F.explode(F.transform(F.sequence(F.lit(0), F.lit(months - 1)), lambda k: F.add_months(start, k))).alias("month"))


def yearly_members(stock: DataFrame, cap: int = 1500, **screens) -> DataFrame:
    """year, permno, market_cap of the members chosen each June."""
    passed = screened(stock, **screens).filter("by_size AND by_price AND by_history")
    return w.top_k(passed, "market_cap", cap, "year").select("year", "permno", "market_cap")


def seed_members(stock: DataFrame, q: float = 0.35, exchange: int = 0, least_price: float = 1.0) -> DataFrame:
    """permno, month: January to June of the table's first year, before any June: January's rows above the
    reference exchange's size quantile and the least price, without a history screen or a cap."""
    first = stock.agg(F.year(F.min("month")).alias("year"))
    january = stock.filter(F.month("month") == 1).withColumn("year", F.year("month")).join(F.broadcast(first), "year", "left_semi")
    limits = a.group_quantile(january, "market_cap", q, "year", F.col("exchcd") == exchange).drop("n")
    passed = january.join(F.broadcast(limits), "year").filter((F.col("market_cap") >= F.col("threshold")) & (F.col("prc") >= least_price))
    return holding_months(passed.select("year", "permno").distinct(), 1, 6)


def size_breakpoint_universe(stock: DataFrame, cap: int = 1500, **screens) -> DataFrame:
    """permno, month: members from July to the next June, and seed members before the first June.

    Screens: size quantile of the reference exchange, price, history.
    """
    seed = seed_members(stock, **{k: v for k, v in screens.items() if k != "least_history"})
    return holding_months(yearly_members(stock, cap, **screens)).unionByName(seed).distinct()


def topn_universe(stock: DataFrame, n: int = 500) -> DataFrame:
    """permno, month: the n largest of December for the next calendar year; the first year by its first month."""
    december = w.top_k(snapshots(stock, 12), "market_cap", n, "year").select((F.col("year") + 1).alias("year"), "permno")
    start = stock.agg(F.min("month").alias("month"))
    first = stock.join(F.broadcast(start), "month").withColumn("year", F.year("month"))
    both = december.unionByName(w.top_k(first, "market_cap", n, "year").select("year", "permno")).distinct()
    return holding_months(both, 1)


def membership_turnover(yearly: DataFrame, high: float = 0.25) -> DataFrame:
    """year, n, n_exits, turnover (exits over members of the year computed before), flag; for years with one before."""
    sizes = yearly.groupBy("year").agg(F.count("*").alias("n"))
    order = Window.orderBy("year")  # a row for each year
    years = sizes.withColumns({"before": F.lag("year").over(order), "n_before": F.lag("n").over(order)}).filter("before IS NOT NULL")
    following = years.select(F.col("before").alias("year"), F.col("year").alias("after"))
    exits = yearly.join(following, "year").select(F.col("after").alias("year"), "permno").join(yearly, ["year", "permno"], "left_anti").groupBy("year").agg(F.count("*").alias("n_exits"))
    rate = F.coalesce("n_exits", F.lit(0)) / F.col("n_before")
    return years.join(exits, "year", "left").select("year", "n", F.coalesce("n_exits", F.lit(0)).cast("long").alias("n_exits"), rate.alias("turnover"), c.band(rate, high=high).alias("flag"))


def universe_funnel(stock: DataFrame, cap: int = 1500, **screens) -> DataFrame:
    """Per year: the threshold, snapshot rows, how many pass size, then price, then history, and how many the cap leaves."""
    at = screened(stock, **screens).filter("threshold IS NOT NULL")
    steps = a.funnel(at, {"n_size": F.col("by_size"), "n_price": F.col("by_price"), "n_history": F.col("by_history")}, "year")
    limits = at.groupBy("year").agg(F.first("threshold").alias("threshold"))
    return steps.withColumn("n_final", F.least("n_history", F.lit(cap).cast("long"))).join(limits, "year")


def universe_summary(stock: DataFrame, universe: DataFrame, low: float = 1000, high: float = 1600) -> DataFrame:
    """Per year: member months, members, mean, least and largest market cap, members of a mean month with their LOW / HIGH flag."""
    held = j.members_only(stock, universe).withColumn("year", F.year("month"))
    figures = held.groupBy("year").agg(
        F.count("*").alias("n_rows"), F.count_distinct("permno").alias("n_members"), F.avg("market_cap").alias("mean_cap"), F.min("market_cap").alias("low_cap"), F.max("market_cap").alias("high_cap"),
        (F.count("*") / F.count_distinct("month")).alias("avg_members"),
    )
    return figures.withColumn("flag", c.band("avg_members", low, high))


def market_characteristics(stock: DataFrame) -> DataFrame:
    """Adds ret_adjusted, illiquidity and reversal_st (one row back), momentum and reversal_lt."""
    at = stock.withColumns({"ret_adjusted": c.adjusted_return(), "_illiq": c.illiquidity()}).withColumn("_log", w.log_return())
    at = at.withColumn("_log1", w.lag("_log"))
    year1, year5 = w.rolling(F.sum, "_log", 12, 11), w.rolling(F.sum, "_log", 60, 48)
    return at.withColumns(
        {
            "illiquidity": w.lag("_illiq"),
            "reversal_st": w.lag("ret"),
            "momentum": F.expm1(w.rolling(F.sum, "_log1", 12, 11) - F.col("_log1")),
            "reversal_lt": F.expm1(year5 - year1),
        }
    ).drop("_illiq", "_log", "_log1")


def accounting_characteristics(accounting: DataFrame) -> DataFrame:
    """One row per (gvkey, fyear), the last by datadate, with ratios, asset growth and accruals. CAD rows go."""
    at = accounting.filter(c.not_currency("curcd")) if "curcd" in accounting.columns else accounting
    at = a.keep_one(at, ["gvkey", "fyear"], [F.desc("datadate")])
    at = at.withColumns(
        {
            "be": c.book_equity(),
            "noa": c.net_operating_assets(),
            "gp": c.ratio(F.col("sale") - F.col("cogs"), "at_total"),
            "roa": c.ratio("ni", "at_total"),
            "capinv": c.ratio("capx", "at_total"),
            "leverage": c.ratio("dltt", "at_total"),
        }
    )
    before = lambda x: w.lag(x, 1, "gvkey", "fyear")
    return at.withColumns({"asset_growth": c.ratio(F.col("at_total") - before("at_total"), before("at_total")), "accruals": c.ratio(F.col("noa") - before("noa"), before("noa"))})


def point_in_time_join(stock: DataFrame, accounting: DataFrame, links: DataFrame, lag_months: int = 6, valid_dates: bool = True) -> DataFrame:
    """Stock rows with the latest published accounting row of their linked company, has_accounting, and bm."""
    figures = accounting.withColumn("available", c.available_from("datadate", lag_months))
    linked = j.link_join(figures, links, valid_dates)
    extra = [n for n in linked.columns if n not in stock.columns]
    joined = j.asof_backward(stock, linked.select("permno", *extra), from_="available", order="datadate")
    return joined.withColumns({"has_accounting": F.col("gvkey").isNotNull(), "bm": c.book_to_market()})


def derived_signals(panel: DataFrame) -> DataFrame:
    """Adds what the columns there allow: betasq, std_dolvol, stdacc, sgr and the industry-adjusted signals."""
    has, out = set(panel.columns), {}
    at = panel.withColumn("_ind", c.industry("siccd")) if "siccd" in has else panel
    if "beta" in has:
        out["betasq"] = F.col("beta") * F.col("beta")
    if "dolvol" in has:
        out["std_dolvol"] = w.rolling(F.stddev_samp, "dolvol", 12, 6)
    if "accruals" in has:
        out["stdacc"] = w.rolling(F.stddev_samp, "accruals", 36, 24)
    if "sale" in has:
        out["sgr"] = c.ratio("sale", w.year_over_year(panel, "sale")) - 1
    if "siccd" in has:
        out |= {f"{new}_ia": w.demean(x, "_ind", "month") for x, new in (("bm", "bm"), ("cfp", "cfp"), ("mvel1", "mve")) if x in has}
        if {"ni", "sale"} <= has:
            at = at.withColumn("_pm", c.ratio("ni", F.nullif("sale", F.lit(0.0))))
            at = at.withColumn("_delta", F.col("_pm") - w.year_over_year(at, "_pm"))
            out["chpmia"] = w.demean("_delta", "_ind", "month")
    return at.withColumns(out).drop("_ind", "_pm", "_delta")


def macro_series(series: DataFrame, volatility: DataFrame | None = None) -> DataFrame:
    """month and six predictors from a monthly table (month, dp, gs10, tb3ms, cpi, baa, aaa, indpro, market_ret).

    Inflation is the change over twelve months, growth a log difference over twelve, volatility the
    deviation of twelve market returns in percent per year, behind a market index of it where given.
    """
    one = Window.orderBy("month")
    last12 = one.rowsBetween(-11, 0)
    at = series.withColumn("inflation", w.percent_change("cpi", 12))
    realised = F.when(F.count("market_ret").over(last12) >= 12, F.stddev_samp("market_ret").over(last12) * F.sqrt(F.lit(12.0)) * 100)
    out = at.select("month", F.ln("dp").alias("dp_ratio"), *(x.alias(n) for n, x in c.macro_spreads().items()), (F.ln("indpro") - F.ln(F.lag("indpro", 12).over(one))).alias("indpro_growth"), realised.alias("volatility"))
    return out if volatility is None else out.drop("volatility").join(j.splice(volatility, out.select("month", "volatility"), "volatility"), "month", "left")


def signal_panel(wide: DataFrame, universe: DataFrame, keep: Sequence[str], drop: Sequence[str] = (), names: dict[str, str] | None = None) -> DataFrame:
    """Signals of universe members: columns trimmed and renamed, one row per (permno, month), the one with most values."""
    trimmed = readers.scan_wide(wide, ["permno", "yyyymm", *keep], drop)
    at = trimmed.withColumn("month", c.month_of("yyyymm")).drop("yyyymm")
    at = readers.rename(j.members_only(at, universe), names or {})
    filled = sum((F.col(n).isNotNull().cast("int") for n in at.columns if n not in ("permno", "month")), F.lit(0))
    return a.keep_one(at, ["permno", "month"], [filled.desc(), F.xxhash64(*at.columns)])


def panel_summary(panel: DataFrame, names: Sequence[str]) -> DataFrame:
    """name, n, coverage, first and last month of each column."""
    out = panel.agg(*(F.struct(F.count(n).alias("n"), F.avg(F.col(n).isNotNull().cast("int")).alias("coverage"), F.min(F.when(F.col(n).isNotNull(), F.col("month"))).alias("first"), F.max(F.when(F.col(n).isNotNull(), F.col("month"))).alias("last")).alias(n) for n in names))
    return out.unpivot([], list(names), "name", "s").select("name", "s.*")


def coverage_by_year(panel: DataFrame, flag: str = "has_accounting") -> DataFrame:
    """year, n_rows, n_with, percent."""
    at = panel.groupBy(F.year("month").alias("year")).agg(F.count("*").alias("n_rows"), F.count_if(flag).alias("n_with"))
    return at.withColumn("percent", 100 * F.col("n_with") / F.col("n_rows"))
