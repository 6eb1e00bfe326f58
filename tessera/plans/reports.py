"""Queries of portfolio and report tables, on two equal-weight portfolios over a 24-month window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import columns as c
from tessera.operators import aggregates as a
from tessera.operators import estimators as e
from tessera.operators import evaluate as v
from tessera.operators import portfolio as b
from tessera.operators import windows as w
from tessera.plans.catalog import Tables, query
from tessera.plans.standins import folder, settled
from tessera.sources import readers

MONTHS, TOP = 24, {"broad": 500, "large": 10}

_WINDOW = """
x AS (SELECT *, (1 + ret) * (1 + coalesce(dlret, 0)) - 1 AS ra FROM stock),
fm AS (SELECT DISTINCT month AS form_month FROM stock ),
lw AS (SELECT form_month, x.month, permno, ra AS r FROM fm JOIN x ON x.month > form_month - INTERVAL 24 MONTH AND x.month <= form_month WHERE ra IS NOT NULL),
ct AS (SELECT form_month, permno, count(*) AS n, avg(r) AS mean FROM lw GROUP BY 1, 2 HAVING count(*) >= 20),
cp AS (SELECT ct.*, s.market_cap, count(s.market_cap) OVER (PARTITION BY ct.form_month) AS caps FROM ct LEFT JOIN stock s ON s.permno = ct.permno AND s.month = ct.form_month),
rk AS (SELECT *, row_number() OVER (PARTITION BY form_month ORDER BY coalesce(market_cap, 0) DESC, permno) AS i FROM cp)"""

_LOG = f"""{_WINDOW},
wt AS (SELECT 'broad' AS model, form_month, permno, 1.0::DOUBLE / count(*) OVER (PARTITION BY form_month) AS weight FROM rk WHERE i <= 500 OR caps < 50
       UNION ALL SELECT 'large', form_month, permno, 1.0::DOUBLE / count(*) OVER (PARTITION BY form_month) FROM rk WHERE i <= 10 OR caps < 50),
mo AS (SELECT model, form_month, lag(form_month) OVER (PARTITION BY model ORDER BY form_month) AS before FROM (SELECT DISTINCT model, form_month FROM wt)),
mv AS (SELECT model, form_month, permno, sum(d) AS d FROM (SELECT model, form_month, permno, weight AS d FROM wt
       UNION ALL SELECT mo.model, mo.form_month, wt.permno, -wt.weight FROM mo JOIN wt ON wt.model = mo.model AND wt.form_month = mo.before) GROUP BY 1, 2, 3),
tn AS (SELECT mo.model, mo.form_month, CASE WHEN any_value(mo.before) IS NULL THEN 1.0 ELSE sum(abs(d)) / 2 END AS turnover FROM mo JOIN mv ON mo.model = mv.model AND mo.form_month = mv.form_month GROUP BY 1, 2),
gr AS (SELECT wt.model, wt.form_month, sum(wt.weight * x.ra) / sum(wt.weight) AS gross_return FROM wt JOIN x ON x.permno = wt.permno AND x.month = wt.form_month + INTERVAL 1 MONTH WHERE x.ra IS NOT NULL GROUP BY 1, 2),
lg AS (SELECT gr.model, gr.form_month, CAST(gr.form_month + INTERVAL 1 MONTH AS DATE) AS ret_month, n.n_assets, n.n_active, gr.gross_return, tn.turnover, tn.turnover * 0.001 AS cost, gr.gross_return - tn.turnover * 0.001 AS net_return
       FROM gr JOIN tn ON gr.model = tn.model AND gr.form_month = tn.form_month
       JOIN (SELECT model, form_month, count(*) AS n_assets, count(*) FILTER (weight > 1e-4) AS n_active FROM wt GROUP BY 1, 2) n ON n.model = gr.model AND n.form_month = gr.form_month)"""

_METRICS = """
nv AS (SELECT *, exp(sum(ln(1 + net_return)) OVER o) AS nav, row_number() OVER o AS i FROM {log} WINDOW o AS (PARTITION BY model ORDER BY form_month)),
dd AS (SELECT *, nav / max(nav) OVER (PARTITION BY model ORDER BY form_month) - 1 AS dd FROM nv),
pf AS (SELECT model, count(*) AS n_months, avg(net_return - {rf}) / stddev_samp(net_return - {rf}) * sqrt(12) AS net_sharpe, avg(gross_return - {rf}) / stddev_samp(gross_return - {rf}) * sqrt(12) AS gross_sharpe,
       exp(sum(ln(1 + gross_return)) * 12 / count(*)) - 1 AS gross_return, exp(sum(ln(1 + net_return)) * 12 / count(*)) - 1 AS net_return, stddev_samp(net_return) * sqrt(12) AS volatility, min(dd) AS max_drawdown,
       avg(turnover) FILTER (i > 1) AS avg_turnover, avg(cost) * 10000 AS avg_cost_bps, sqrt(avg(least(net_return - {rf}, 0) * least(net_return - {rf}, 0))) * sqrt(12) AS downside_deviation,
       avg(net_return - {rf}) * 12 / nullif(sqrt(avg(least(net_return - {rf}, 0) * least(net_return - {rf}, 0))) * sqrt(12), 0) AS sortino FROM dd GROUP BY model)"""

_ALL = " ".join(v.METRICS)


def adjusted(t: Tables) -> DataFrame:
    return t.settled("stock").withColumn("ret_adjusted", c.adjusted_return())


def windows(t: Tables, top: int = 500, months: int = MONTHS, ranked: bool = False) -> DataFrame:
    forms = t.monthly.select(F.col("month").alias("form_month"))
    return e.returns_window(adjusted(t), forms, months, top=top, ranked=ranked)


def weights(t: Tables) -> DataFrame:
    """Both portfolios from the members of one window, each the largest of it."""
    forms = t.monthly.select(F.col("month").alias("form_month"))
    window = settled(e.window_members(adjusted(t), forms, MONTHS, top=max(TOP.values())))
    parts = [b.equal_weights(window.filter(F.col("rank") <= top)).select(F.lit(name).alias("model"), "form_month", "permno", "weight") for name, top in TOP.items()]
    return settled(parts[0].unionByName(parts[1]))


def log(t: Tables) -> DataFrame:
    return settled(b.backtest_log(weights(t), adjusted(t)))


def risk_free(t: Tables) -> DataFrame:
    return t.factors.select("month", "rf")


@query("e1_returns_window", f"""
WITH {_WINDOW}, ch AS (SELECT form_month, permno, mean FROM rk WHERE i <= 500 OR caps < 50),
lv AS (SELECT DISTINCT lw.form_month, lw.month FROM lw JOIN ch ON lw.form_month = ch.form_month AND lw.permno = ch.permno)
SELECT ch.form_month, lv.month, ch.permno, coalesce(lw.r, ch.mean) AS r, lw.r IS NULL AS imputed FROM ch JOIN lv ON ch.form_month = lv.form_month
LEFT JOIN lw ON lw.form_month = ch.form_month AND lw.permno = ch.permno AND lw.month = lv.month""", "r")
def _(t):
    return windows(t)


@query("b1_b3_b5_j9_backtest_log", f"WITH {_LOG} SELECT * FROM lg", "gross_return turnover cost net_return")
def _(t):
    return log(t)


@query("b6_rounded_log", f"WITH {_LOG} SELECT model, form_month, ret_month, n_assets, n_active, round(gross_return, 6) AS gross_return, round(turnover, 4) AS turnover, round(cost, 6) AS cost, round(net_return, 6) AS net_return FROM lg", "gross_return turnover cost net_return")
def _(t):
    return b.backtest_log(weights(t), adjusted(t), digits=6)


@query("b4_capped_chain")
def _(t):
    """Weights after caps that bind: the smaller portfolio turns over more than 1 % a month."""
    capped = b.capped_weights(weights(t), b.cap_table(t.spark, [0.01, 0.05]))
    return capped.groupBy("model", "cap_label", "form_month").agg(F.count("*").alias("n"), F.sum("weight").alias("total"), F.max("weight").alias("top"), F.max("at_cap").alias("at_cap"))


@query("b4_uncapped_chain", f"WITH {_LOG} SELECT model, 'none' AS cap_label, count(*) AS n, sum(weight) AS total FROM wt GROUP BY 1", "total")
def _(t):
    return b.capped_weights(weights(t), b.cap_table(t.spark, [None])).groupBy("model", "cap_label").agg(F.count("*").alias("n"), F.sum("weight").alias("total"))


@query("b8_frontier")
def _(t):
    return b.frontier(weights(t), adjusted(t), b.cap_table(t.spark))


@query("b9_primary_frontier", f"""
WITH {_LOG}, cm AS (SELECT model, 'none' AS cap_label, avg(net_return) AS net FROM lg WHERE model = 'large' GROUP BY 1),
st AS (SELECT model, 'none' AS cap_label, avg(gross_return) AS net FROM lg GROUP BY 1 UNION ALL SELECT model, 'year ' || year(form_month), avg(gross_return) FROM lg GROUP BY 1, 2)
SELECT * FROM cm UNION ALL SELECT * FROM st WHERE NOT (model = 'large' AND cap_label = 'none')""", "net")
def _(t):
    """The frontier computed now for one model, before that of an earlier run, which was stored and is read back."""
    at = log(t)
    path = folder(t.spark)
    stored = at.groupBy("model").agg(F.avg("gross_return").alias("net")).select("model", F.lit("none").alias("cap_label"), "net")
    by_year = at.groupBy("model", F.concat(F.lit("year "), F.year("form_month")).alias("cap_label")).agg(F.avg("gross_return").alias("net"))
    readers.write_table(stored.unionByName(by_year), path)
    computed = at.filter("model = 'large'").groupBy("model").agg(F.avg("net_return").alias("net")).select("model", F.lit("none").alias("cap_label"), "net")
    return b.primary_frontier(computed, t.spark.read.parquet(path))


@query("v1_performance", f"WITH {_LOG}, lr AS (SELECT lg.*, coalesce(f.rf, 0) AS rf FROM lg LEFT JOIN factors f ON f.month = lg.ret_month), {_METRICS.format(log='lr', rf='rf')} SELECT * FROM pf", _ALL)
def _(t):
    return v.performance(log(t), risk_free(t))


@query("v2_against_benchmark", f"""
WITH {_LOG}, {_METRICS.format(log='lg', rf='0')}, u AS (UNPIVOT (SELECT * EXCLUDE n_months FROM pf) ON COLUMNS(* EXCLUDE model) INTO NAME metric VALUE value)
SELECT a.model, a.metric, a.value, b.value AS benchmark, a.value - b.value AS delta FROM u a JOIN u b ON a.metric = b.metric WHERE a.model = 'large' AND b.model = 'broad'""", "value benchmark delta")
def _(t):
    return v.against_benchmark(log(t), "broad")


@query("v3_p22_compare", f"""
WITH {_LOG}, sh AS (SELECT * FROM lg WHERE model = 'broad' OR form_month >= DATE '1999-01-01'), cw AS (SELECT max(lo) AS lo, min(hi) AS hi FROM (SELECT min(form_month) AS lo, max(form_month) AS hi FROM sh GROUP BY model)),
cl AS (SELECT sh.* FROM sh, cw WHERE form_month BETWEEN lo AND hi), {_METRICS.format(log='cl', rf='0')} SELECT * FROM pf""", _ALL)
def _(t):
    return v.compare(log(t).filter("model = 'broad' OR form_month >= DATE '1999-01-01'"))


#: The two-sided p-value of Student's t in SQL: one less the density's integral between -t and t, by Simpson's rule.
_REGRESSION = """
z AS (SELECT lg.model, lg.net_return - f.rf AS y, f.mkt_rf AS x FROM lg JOIN factors f ON f.month = lg.ret_month),
rg AS (SELECT model, count(*) AS n, regr_slope(y, x) AS beta, regr_intercept(y, x) AS alpha, regr_r2(y, x) AS r2, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, avg(x) AS mx FROM z WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY model),
kt AS (SELECT model, n, alpha, beta, alpha / sqrt((syy - beta * beta * sxx) / (n - 2) * (1.0 / n + mx * mx / sxx)) AS alpha_t, r2, n - 2 AS v FROM rg),
gd AS (SELECT kt.*, abs(alpha_t) * i / 2000 AS u, CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS c FROM kt, range(2001) s(i)),
ft AS (SELECT model, n, alpha, beta, alpha_t, 1 - 2 * sum(c * exp(lgamma((v + 1) / 2.0) - lgamma(v / 2.0)) / sqrt(v * pi()) * power(1 + u * u / v, -(v + 1) / 2.0)) * abs(alpha_t) / 6000 AS alpha_p, r2 FROM gd GROUP BY model, n, alpha, beta, alpha_t, r2)"""


@query("e11_market_regression", f"WITH {_LOG}, {_REGRESSION} SELECT * FROM ft", "alpha beta alpha_t alpha_p r2")
def _(t):
    at = log(t).join(t.factors.withColumnRenamed("month", "ret_month"), "ret_month").withColumn("excess", F.col("net_return") - F.col("rf"))
    return e.market_regression(at)


@query("v4_u7_summary_table", f"""
WITH {_LOG}, lr AS (SELECT lg.*, coalesce(f.rf, 0) AS rf FROM lg LEFT JOIN factors f ON f.month = lg.ret_month), {_METRICS.format(log='lr', rf='rf')}, {_REGRESSION},
bo AS (SELECT pf.* EXCLUDE n_months, ft.alpha * 12 AS alpha, ft.beta, ft.alpha_t, ft.alpha_p, ft.r2 FROM pf JOIN ft ON ft.model = pf.model),
u AS (UNPIVOT bo ON COLUMNS(* EXCLUDE model) INTO NAME metric VALUE value)
SELECT metric, max(value) FILTER (model = 'broad') AS broad, max(value) FILTER (model = 'large') AS large FROM u GROUP BY 1""", "broad large")
def _(t):
    return v.summary_table(log(t), t.factors, list(TOP))


@query("v5_calendar_years", f"WITH {_LOG} SELECT year(form_month) AS year, product(1 + net_return) FILTER (model = 'broad') - 1 AS broad, product(1 + net_return) FILTER (model = 'large') - 1 AS large FROM lg GROUP BY 1", "broad large")
def _(t):
    return v.calendar_years(log(t), list(TOP))


@query("v6_cost_drag", f"WITH {_LOG}, {_METRICS.format(log='lg', rf='0')} SELECT model, gross_sharpe, net_sharpe, net_sharpe - gross_sharpe AS drag, avg_turnover FROM pf", "gross_sharpe net_sharpe drag avg_turnover")
def _(t):
    return v.cost_drag(log(t))


@query("v7_w11_w12_w13_chart_series", f"""
WITH {_LOG}, q AS (SELECT *, exp(sum(ln(1 + net_return)) OVER o) AS nav, CASE WHEN row_number() OVER o > 1 THEN turnover END AS tv FROM lg WINDOW o AS (PARTITION BY model ORDER BY form_month))
SELECT model, form_month, nav, nav / max(nav) OVER (PARTITION BY model ORDER BY form_month) - 1 AS drawdown, CASE WHEN count(*) OVER s >= 24 AND stddev_pop(net_return) OVER s > 1e-10 THEN avg(net_return) OVER s / stddev_pop(net_return) OVER s * sqrt(12) END AS rolling_sharpe,
       CASE WHEN count(tv) OVER z >= 12 THEN avg(tv) OVER z END AS rolling_turnover FROM q WINDOW s AS (PARTITION BY model ORDER BY form_month ROWS 23 PRECEDING), z AS (PARTITION BY model ORDER BY form_month ROWS 11 PRECEDING)""", "nav drawdown rolling_sharpe rolling_turnover")
def _(t):
    return v.chart_series(log(t), 24)


@query("u4_exits", f"""
WITH {_LOG} SELECT o.model, CAST(o.form_month + INTERVAL 1 MONTH AS DATE) AS form_month, count(*) AS n FROM wt o WHERE o.form_month < (SELECT max(form_month) FROM wt)
AND NOT EXISTS (SELECT 1 FROM wt z WHERE z.model = o.model AND z.permno = o.permno AND z.form_month = o.form_month + INTERVAL 1 MONTH) GROUP BY 1, 2""")
def _(t):
    x = weights(t)
    last = x.agg(F.max("form_month").alias("last"))
    before = x.join(F.broadcast(last), F.col("form_month") < F.col("last"), "left_semi").select("model", F.add_months("form_month", 1).alias("form_month"), "permno")
    return before.join(x, ["model", "form_month", "permno"], "left_anti").groupBy("model", "form_month").agg(F.count("*").alias("n"))


@query("w4_rank_of_weights")
def _(t):
    return w.trailing_rank_mean(adjusted(t), "market_cap", 6).groupBy("month").agg(F.count("*").alias("n"), F.max("smooth").alias("top"))


@query("a8_null_rates", "SELECT 'ret' AS name, avg(CASE WHEN ret IS NULL THEN 1.0 ELSE 0 END) AS missing FROM stock WHERE year(month) = 1995 UNION ALL SELECT 'prc', 0.0::DOUBLE", "missing")
def _(t):
    return a.null_rates(t.stock, ["ret", "prc"], F.year("month") == 1995)
