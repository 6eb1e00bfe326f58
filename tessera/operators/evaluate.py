"""Evaluation and report tables over backtest logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import aggregates as a
from tessera.operators import estimators as e
from tessera.operators import joins as j
from tessera.operators import windows as w

METRICS = ("net_sharpe", "gross_sharpe", "gross_return", "net_return", "volatility", "max_drawdown", "avg_turnover", "avg_cost_bps", "downside_deviation", "sortino")


def performance(log: DataFrame, rf: DataFrame | None = None, keys: Sequence[str] = ("model",), digits: int | None = None) -> DataFrame:
    """keys, n_months and the ten metrics. rf (month, rf) is joined by return month; without it excess is return.

    The first month's turnover, which buys the portfolio, is left out of the mean; its cost is not.
    """
    at = log if rf is None else j.with_series(log, rf.select(F.col("month").alias("ret_month"), "rf"), "ret_month")
    risk_free = F.lit(0.0) if rf is None else F.coalesce("rf", F.lit(0.0))
    at = at.withColumns({"_xn": F.col("net_return") - risk_free, "_xg": F.col("gross_return") - risk_free})
    over = Window.partitionBy(*keys).orderBy("form_month")
    at = at.withColumn("_n", F.row_number().over(over)).withColumn("_nav", F.exp(F.sum(F.log1p("net_return")).over(over)))
    at = at.withColumn("_dd", F.col("_nav") / F.max("_nav").over(over) - 1)
    year = F.sqrt(F.lit(12.0))
    grown = lambda x: F.exp(F.sum(F.log1p(x)) * 12 / F.count("*")) - 1
    low = F.least(F.col("_xn"), F.lit(0.0))
    out = at.groupBy(*keys).agg(
        F.count("*").alias("n_months"),
        (F.try_divide(F.avg("_xn"), F.stddev_samp("_xn")) * year).alias("net_sharpe"),
        (F.try_divide(F.avg("_xg"), F.stddev_samp("_xg")) * year).alias("gross_sharpe"),
        grown("gross_return").alias("gross_return"),
        grown("net_return").alias("net_return"),
        (F.stddev_samp("net_return") * year).alias("volatility"),
        F.min("_dd").alias("max_drawdown"),
        F.avg(F.when(F.col("_n") > 1, F.col("turnover"))).alias("avg_turnover"),
        (F.avg("cost") * 1e4).alias("avg_cost_bps"),
        (F.sqrt(F.avg(low * low)) * year).alias("downside_deviation"),
        (F.avg("_xn") * 12).alias("_mean"),
    )
    out = out.withColumn("sortino", F.when(F.col("downside_deviation") > 0, F.col("_mean") / F.col("downside_deviation"))).drop("_mean")
    return out if digits is None else out.select(*keys, "n_months", *(F.round(m, 6 if m == "downside_deviation" else digits).alias(m) for m in METRICS))


def compare(log: DataFrame, rf: DataFrame | None = None) -> DataFrame:
    """The metrics of all models over the months that all of them have."""
    return performance(a.common_window(log, "model", "form_month"), rf)


def against_benchmark(log: DataFrame, benchmark: str, rf: DataFrame | None = None) -> DataFrame:
    """model, metric, value, benchmark, delta, each model over the months it shares with the benchmark."""
    base = log.filter(F.col("model") == benchmark)
    others = log.filter(F.col("model") != benchmark)
    ends = others.groupBy("model").agg(F.min("form_month").alias("lo"), F.max("form_month").alias("hi"))
    span = base.agg(F.min("form_month").alias("blo"), F.max("form_month").alias("bhi"))
    ends = ends.crossJoin(F.broadcast(span)).select("model", F.greatest("lo", "blo").alias("lo"), F.least("hi", "bhi").alias("hi"))
    inside = F.col("form_month").between(F.col("lo"), F.col("hi"))
    mine = performance(others.join(F.broadcast(ends), "model").filter(inside).drop("lo", "hi"), rf)
    theirs = performance(base.drop("model").join(F.broadcast(ends), inside).drop("lo", "hi"), rf)
    long = lambda t, n: t.unpivot(["model"], list(METRICS), "metric", n)
    return long(mine, "value").join(long(theirs, "benchmark"), ["model", "metric"]).withColumn("delta", F.col("value") - F.col("benchmark"))


def summary_table(log: DataFrame, market: DataFrame, models: Sequence[str] | None = None) -> DataFrame:
    """metric by model: the metrics and the market regression of net excess returns, turned on their side.

    market holds month, mkt_rf and rf; a row of the log belongs to its return month.
    """
    at = j.with_series(log, market.select(F.col("month").alias("ret_month"), "mkt_rf", "rf"), "ret_month")
    fit = e.market_regression(at.withColumn("excess", F.col("net_return") - F.col("rf")))
    both = performance(log, market.select("month", "rf")).join(fit.withColumn("alpha", F.col("alpha") * 12).drop("n"), "model")
    names = [*METRICS, "alpha", "beta", "alpha_t", "alpha_p", "r2"]
    long = both.unpivot(["model"], names, "metric", "value")
    return long.groupBy("metric").pivot("model", list(models) if models else None).agg(F.first("value"))


def calendar_years(log: DataFrame, models: Sequence[str] | None = None, month: str = "form_month") -> DataFrame:
    """year by model: compounded net returns, by formation or return month."""
    yearly = log.groupBy("model", F.year(month).alias("year")).agg(a.compound("net_return").alias("r"))
    return yearly.groupBy("year").pivot("model", list(models) if models else None).agg(F.first("r"))


def cost_drag(log: DataFrame, rf: DataFrame | None = None) -> DataFrame:
    """model, gross_sharpe, net_sharpe, drag, avg_turnover."""
    return performance(log, rf).select("model", "gross_sharpe", "net_sharpe", (F.col("net_sharpe") - F.col("gross_sharpe")).alias("drag"), "avg_turnover")


def chart_series(log: DataFrame, sharpe_months: int = 60, turnover_months: int = 12) -> DataFrame:
    """model, form_month, nav, drawdown, rolling_sharpe, rolling_turnover (first month left out)."""
    first = F.row_number().over(Window.partitionBy("model").orderBy("form_month")) == 1
    at = w.drawdown(log, month="form_month").withColumn("_t", F.when(~first, F.col("turnover")))
    return at.select(
        "model", "form_month", "nav", "drawdown", w.rolling_sharpe("net_return", sharpe_months, month="form_month").alias("rolling_sharpe"), w.rolling_mean("_t", turnover_months, month="form_month").alias("rolling_turnover")
    )
