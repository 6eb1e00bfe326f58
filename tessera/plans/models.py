"""Queries of estimators and learned models, with windows that fit the stand-in calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import aggregates as a
from tessera.operators import estimators as e
from tessera.operators import joins as j
from tessera.operators import learn as m
from tessera.operators import panel as p
from tessera.operators import portfolio as b
from tessera.operators import windows as w
from tessera.plans.catalog import Tables, query
from tessera.plans.reports import adjusted, windows
from tessera.plans.standins import settled, stored

MONTHS, LEAST = 36, 24


def excess(t: Tables) -> DataFrame:
    return j.with_series(adjusted(t), t.factors.select("month", "rf")).withColumn("excess", F.col("ret_adjusted") - F.col("rf")).drop("rf")


def factors(t: Tables) -> DataFrame:
    return t.factors.filter("mkt_rf IS NOT NULL").select("month", *e.FACTORS)


def betas(t: Tables) -> DataFrame:
    return e.rolling_betas(excess(t).select("permno", "month", "market_cap", "excess"), factors(t), MONTHS, LEAST)


def forms(t: Tables) -> DataFrame:
    return t.monthly.select(F.col("month").alias("form_month"))


@query("e2_single_factor_beta", """
WITH x AS (SELECT s.permno, s.month, (1 + s.ret) * (1 + coalesce(s.dlret, 0)) - 1 - f.rf AS y, f.mkt_rf AS x FROM stock s JOIN factors f ON s.month = f.month),
r AS (SELECT permno, month, count(CASE WHEN y IS NOT NULL AND x IS NOT NULL THEN 1 END) OVER o AS n_obs, regr_slope(y, x) OVER o AS beta, regr_intercept(y, x) OVER o AS alpha FROM x
      WINDOW o AS (PARTITION BY permno ORDER BY year(month) * 12 + month(month) RANGE BETWEEN 35 PRECEDING AND CURRENT ROW))
SELECT permno, month, n_obs, CASE WHEN n_obs >= 24 THEN alpha END AS alpha, CASE WHEN n_obs >= 24 THEN beta END AS beta FROM r""", "alpha beta")
def _(t):
    at = e.rolling_betas(excess(t).select("permno", "month", "excess"), factors(t).select("month", "mkt_rf"), MONTHS, LEAST, ("mkt_rf",))
    return at.select("permno", "month", "n_obs", F.col("betas")[0].alias("alpha"), F.col("betas")[1].alias("beta"))


@query("e2_five_factor_betas")
def _(t):
    return betas(t).select("permno", "month", "n_obs", *(F.col("betas")[i].alias(n) for i, n in enumerate(("alpha", *e.FACTORS))), "idio_var", "r2")


@query("e3_mean_premia", """
SELECT month AS form_month, avg(rf) OVER o AS rf, avg(mkt_rf) OVER o AS mkt, avg(cma) OVER o AS cma FROM factors
WINDOW o AS (ORDER BY year(month) * 12 + month(month) RANGE BETWEEN 35 PRECEDING AND CURRENT ROW)""", "rf mkt cma")
def _(t):
    return e.mean_premia(t.factors, MONTHS).select("form_month", "rf", F.col("premia")[0].alias("mkt"), F.col("premia")[4].alias("cma"))


@query("e3_forecast")
def _(t):
    return e.forecast(betas(t), e.mean_premia(t.factors, MONTHS))


def conditioned(t: Tables) -> DataFrame:
    return e.conditioning_windows(t.factors.filter("mkt_rf IS NOT NULL"), t.macro.filter("volatility IS NOT NULL"), forms(t), MONTHS)


@query("e4_ridge_premia")
def _(t):
    return e.ridge_premia(conditioned(t), least=30).select("form_month", *(F.col("premia")[i].alias(n) for i, n in enumerate(e.FACTORS)))


@query("e5_e6_e7_var_premia")
def _(t):
    return e.var_premia(conditioned(t), tau=3, least_var=30).select("form_month", "var_ok", "pricing_ok", "fallback", "radius", *(F.col("premia")[i].alias(n) for i, n in enumerate(e.FACTORS)))


def bounded(t: Tables, n: int = 500) -> DataFrame:
    """Betas of the n largest entities of each formation month; the pair tables have n squared rows, so n bounds the operator."""
    return w.top_k(betas(t).filter(F.col("betas").isNotNull()), "market_cap", n, "month").drop("top_rank")


@query("e8_conditional_covariance")
def _(t):
    return e.conditional_covariance(bounded(t), e.var_premia(conditioned(t), tau=3, least_var=30), 3)


@query("e10_factor_covariance")
def _(t):
    return e.factor_covariance(bounded(t), t.factors.filter("mkt_rf IS NOT NULL"), MONTHS)


@query("e10_single_factor_covariance", """
WITH x AS (SELECT s.permno, s.month, s.market_cap, (1 + s.ret) * (1 + coalesce(s.dlret, 0)) - 1 - f.rf AS y, f.mkt_rf AS x FROM stock s JOIN factors f ON s.month = f.month),
r AS (SELECT permno, month, market_cap, regr_count(y, x) OVER o AS n, regr_slope(y, x) OVER o AS b, regr_syy(y, x) OVER o - regr_slope(y, x) OVER o * regr_sxy(y, x) OVER o AS sse FROM x
      WINDOW o AS (PARTITION BY permno ORDER BY year(month) * 12 + month(month) RANGE BETWEEN 35 PRECEDING AND CURRENT ROW)),
top AS (SELECT *, greatest(sse / (n - 2), 1e-8) AS own FROM r WHERE n >= 24 QUALIFY row_number() OVER (PARTITION BY month ORDER BY market_cap DESC NULLS LAST, permno) <= 500),
core AS (SELECT month, var_samp(mkt_rf) OVER (ORDER BY year(month) * 12 + month(month) RANGE BETWEEN 35 PRECEDING AND CURRENT ROW) AS v FROM factors WHERE mkt_rf IS NOT NULL)
SELECT p.month AS form_month, p.permno AS i, q.permno AS j, p.b * q.b * v + CASE WHEN p.permno = q.permno THEN p.own ELSE 0 END AS cov
FROM top p JOIN top q ON p.month = q.month AND p.permno <= q.permno JOIN core ON core.month = p.month""", "cov")
def _(t):
    at = e.rolling_betas(excess(t).select("permno", "month", "market_cap", "excess"), factors(t).select("month", "mkt_rf"), MONTHS, LEAST, ("mkt_rf",))
    top = w.top_k(at.filter(F.col("betas").isNotNull()), "market_cap", 500, "month").drop("top_rank")
    return e.factor_covariance(top, t.factors.filter("mkt_rf IS NOT NULL"), MONTHS, names=("mkt_rf",))


@query("e10_average_r2")
def _(t):
    return e.average_r2(betas(t))


_SHRINK = """
x AS (SELECT *, (1 + ret) * (1 + coalesce(dlret, 0)) - 1 AS ra FROM stock),
fm AS (SELECT DISTINCT month AS form_month FROM stock),
lw AS (SELECT form_month, x.month, permno, ra AS r FROM fm JOIN x ON x.month > form_month - INTERVAL 24 MONTH AND x.month <= form_month WHERE ra IS NOT NULL),
ct AS (SELECT form_month, permno, avg(r) AS mean FROM lw GROUP BY 1, 2 HAVING count(*) >= 20),
cp AS (SELECT ct.*, s.market_cap, count(s.market_cap) OVER (PARTITION BY ct.form_month) AS caps FROM ct LEFT JOIN stock s ON s.permno = ct.permno AND s.month = ct.form_month),
rk AS (SELECT *, row_number() OVER (PARTITION BY form_month ORDER BY coalesce(market_cap, 0) DESC, permno) AS i FROM cp),
ch AS (SELECT * FROM rk WHERE i <= 500 OR caps < 50), lv AS (SELECT DISTINCT lw.form_month, lw.month FROM lw JOIN ch ON lw.form_month = ch.form_month AND lw.permno = ch.permno),
wd AS (SELECT ch.form_month, lv.month, ch.permno, coalesce(lw.r, ch.mean) AS r FROM ch JOIN lv ON ch.form_month = lv.form_month LEFT JOIN lw ON lw.form_month = ch.form_month AND lw.permno = ch.permno AND lw.month = lv.month),
cx AS (SELECT *, r - avg(r) OVER (PARTITION BY form_month, permno) AS c FROM wd),
cv AS (SELECT a.form_month, a.permno AS i, b.permno AS j, sum(a.c * b.c) AS s, count(*) AS t FROM cx a JOIN cx b ON a.form_month = b.form_month AND a.month = b.month GROUP BY 1, 2, 3),
d AS (SELECT form_month, max(t) AS n_months, count(DISTINCT i) AS n_assets, sum(CASE WHEN i = j THEN s / t ELSE 0 END) / count(DISTINCT i) AS mu, sum(s / t * s / t) / count(DISTINCT i) AS second FROM cv GROUP BY 1),
q AS (SELECT form_month, sum(nn * nn) AS d2 FROM (SELECT form_month, month, sum(c * c) AS nn FROM cx GROUP BY 1, 2) GROUP BY 1),
ro AS (SELECT a.form_month, avg(a.s / sqrt(b.s * e.s)) AS rho FROM cv a JOIN cv b ON b.form_month = a.form_month AND b.i = a.i AND b.j = a.i JOIN cv e ON e.form_month = a.form_month AND e.i = a.j AND e.j = a.j WHERE a.i <> a.j GROUP BY 1)"""


@query("e9_shrinkage", f"""
WITH {_SHRINK} SELECT d.form_month, n_months, n_assets, greatest(0, least(1, least(second - mu * mu, (q.d2 / n_months - second * n_assets) / (n_assets * n_months)) / (second - mu * mu))) AS delta, rho
FROM d JOIN q ON d.form_month = q.form_month JOIN ro ON ro.form_month = d.form_month""", "delta rho")
def _(t):
    return e.shrinkage(windows(t))


def solved(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    window = settled(windows(t))
    shrunk = settled(e.shrinkage(window))
    mu = settled(e.forecast(betas(t), e.mean_premia(t.factors, MONTHS)).withColumn("model", F.lit("five_factor")))
    return window, shrunk, mu, settled(b.mean_variance_weights(window, shrunk, mu, cap=0.1))


@query("b2_mean_variance_weights")
def _(t):
    return solved(t)[3]


@query("b10_optimality")
def _(t):
    window, shrunk, mu, weights = solved(t)
    chosen = mu.join(window.select("form_month", "permno").distinct(), ["form_month", "permno"], "left_semi")
    return b.optimality_summary(b.optimality(window, shrunk, chosen, weights, cap=0.1))


@query("b11_optimality_by_model")
def _(t):
    window, shrunk, mu, weights = solved(t)
    chosen = mu.join(window.select("form_month", "permno").distinct(), ["form_month", "permno"], "left_semi")
    return b.optimality_by_model(b.optimality_summary(b.optimality(window, shrunk, chosen, weights, cap=0.1)))


# --- models as plug-ins: functions of the tables that return forecasts ----------------------------


@b.model("trailing_mean")
def _(t):
    at = adjusted(t).select("permno", "month", w.rolling(F.avg, "ret_adjusted", MONTHS, LEAST, calendar=True).alias("mu"))
    return at.filter("mu IS NOT NULL").select(F.col("month").alias("form_month"), "permno", "mu")


@b.model("market_beta")
def _(t):
    at = e.rolling_betas(excess(t).select("permno", "month", "excess"), factors(t).select("month", "mkt_rf"), MONTHS, LEAST, ("mkt_rf",))
    return e.forecast(at, e.mean_premia(t.factors, MONTHS, ("mkt_rf",)))


@b.model("five_factor")
def _(t):
    return e.forecast(betas(t), e.mean_premia(t.factors, MONTHS))


@query("b7_model_forecasts", """
WITH x AS (SELECT s.permno, s.month, (1 + s.ret) * (1 + coalesce(s.dlret, 0)) - 1 AS ra FROM stock s),
tm AS (SELECT permno, month, CASE WHEN count(ra) OVER o >= 24 THEN avg(ra) OVER o END AS mu FROM x WINDOW o AS (PARTITION BY permno ORDER BY year(month) * 12 + month(month) RANGE BETWEEN 35 PRECEDING AND CURRENT ROW)),
y AS (SELECT x.permno, x.month, x.ra - f.rf AS y, f.mkt_rf AS x FROM x JOIN factors f ON x.month = f.month),
bt AS (SELECT permno, month, CASE WHEN count(CASE WHEN y IS NOT NULL AND x IS NOT NULL THEN 1 END) OVER o >= 24 THEN regr_slope(y, x) OVER o END AS beta FROM y WINDOW o AS (PARTITION BY permno ORDER BY year(month) * 12 + month(month) RANGE BETWEEN 35 PRECEDING AND CURRENT ROW)),
pr AS (SELECT month, avg(rf) OVER o AS rf, avg(mkt_rf) OVER o AS mkt FROM factors WINDOW o AS (ORDER BY year(month) * 12 + month(month) RANGE BETWEEN 35 PRECEDING AND CURRENT ROW))
SELECT 'trailing_mean' AS model, month AS form_month, permno, mu FROM tm WHERE mu IS NOT NULL
UNION ALL SELECT 'market_beta', bt.month, permno, pr.rf + beta * pr.mkt FROM bt JOIN pr ON bt.month = pr.month WHERE beta IS NOT NULL""", "mu")
def _(t):
    return b.forecasts(t, ["trailing_mean", "market_beta"])


@b.model("equal")
def _(t):
    return b.equal_weights(windows(t))


@b.model("by_size")
def _(t):
    """Weights by market cap over all that are there at the formation month."""
    at = t.stock.filter("market_cap IS NOT NULL").select(F.col("month").alias("form_month"), "permno", "market_cap")
    return at.withColumn("weight", F.col("market_cap") / F.sum("market_cap").over(w.Window.partitionBy("form_month")))


@query("b7_direct_weights", f"""
WITH {_SHRINK.split("cx AS")[0].rstrip().rstrip(",")}
SELECT 'equal' AS model, form_month, permno, 1.0 / count(*) OVER (PARTITION BY form_month) AS weight, NULL::DOUBLE AS delta FROM (SELECT DISTINCT form_month, permno FROM wd)
UNION ALL SELECT 'by_size', z.month, z.permno, z.weight, NULL FROM (SELECT month, permno, market_cap / sum(market_cap) OVER (PARTITION BY month) AS weight FROM stock) z SEMI JOIN wd ON wd.form_month = z.month AND wd.permno = z.permno""", "weight delta")
def _(t):
    return b.model_weights(t, ["equal", "by_size"], windows(t))


# --- learned models ------------------------------------------------------------------------------

CHARACTERISTICS, MACROS = ("reversal_st", "momentum", "illiquidity", "bm", "gp", "dlret"), ("dp_ratio", "volatility")


def learning_panel(t: Tables) -> DataFrame:
    at = p.point_in_time_join(p.market_characteristics(t.stock), p.accounting_characteristics(t.accounting), t.links)
    at = j.with_series(j.with_series(at, t.factors.select("month", "rf")), t.macro.select("month", *MACROS))
    return stored(m.with_target(at).select("permno", "month", "siccd", "y", *CHARACTERISTICS, *MACROS))


def builder() -> m.FeatureBuilder:
    return m.FeatureBuilder(CHARACTERISTICS, MACROS)


def halves(t: Tables) -> tuple[m.FeatureBuilder, DataFrame, DataFrame]:
    panel = learning_panel(t)
    train, test = m.between(panel, (1995, 1998)), m.between(panel, (1999, 2001))
    test = a.assert_before(train, test)
    fitted = builder().fit(train)
    return fitted, stored(fitted.transform(train)), stored(fitted.transform(test))


@query("m1_target", "SELECT s.permno, s.month, (1 + ret) * (1 + coalesce(dlret, 0)) - 1 - f.rf AS y FROM stock s JOIN factors f ON s.month = f.month WHERE ret IS NOT NULL", "y")
def _(t):
    return m.with_target(j.with_series(adjusted(t), t.factors.select("month", "rf"))).select("permno", "month", "y")


@query("m2_m5_features")
def _(t):
    from pyspark.ml.functions import vector_to_array

    _, _, test = halves(t)
    x = vector_to_array("features")
    return test.select("permno", "month", F.size(x).alias("width"), F.array_max(x).alias("high"), F.array_min(x).alias("low"))


_THREE = " UNION ALL ".join("SELECT permno, month, ind, dp_ratio, volatility, '{0}' AS name, {0} AS v FROM {{0}}".format(n) for n in ("ret", "prc", "vol"))


@query("m2_m5_plain_features", f"""
WITH pn AS (SELECT s.permno, s.month, coalesce(substr(CAST(siccd AS STRING), 1, 2), 'unknown') AS ind, ret, prc, CASE WHEN permno % 4 = 0 THEN NULL ELSE vol END AS vol, dp_ratio, volatility FROM stock s LEFT JOIN macro m ON m.month = s.month),
tr AS (SELECT * FROM pn WHERE year(month) <= 1998), te AS (SELECT * FROM pn WHERE year(month) >= 1999), lt AS ({_THREE.format("tr")}), lx AS ({_THREE.format("te")}),
ov AS (SELECT name, quantile_cont(v, 0.5) AS om FROM lt GROUP BY 1), gm AS (SELECT ind, name, CASE WHEN count(v) >= 5 THEN quantile_cont(v, 0.5) END AS im FROM lt GROUP BY 1, 2),
sc AS (SELECT avg(dp_ratio) AS da, stddev_samp(dp_ratio) AS ds, avg(volatility) AS va, stddev_samp(volatility) AS vs FROM (SELECT DISTINCT month, dp_ratio, volatility FROM tr)),
fl AS (SELECT permno, month, dp_ratio, volatility, lx.name, coalesce(v, im, om) AS v FROM lx JOIN ov ON ov.name = lx.name LEFT JOIN gm ON gm.name = lx.name AND gm.ind = lx.ind),
rk AS (SELECT *, 2 * (rank() OVER (PARTITION BY month, name ORDER BY v) + (count(*) OVER (PARTITION BY month, name, v) - 1) / 2.0::DOUBLE) / (count(*) OVER (PARTITION BY month, name) + 1) - 1 AS r FROM fl)
SELECT permno, month, name || '*1' AS name, r AS value FROM rk
UNION ALL SELECT permno, month, name || '*dp_ratio', r * coalesce((dp_ratio - da) / ds, 0) FROM rk, sc UNION ALL SELECT permno, month, name || '*volatility', r * coalesce((volatility - va) / vs, 0) FROM rk, sc
UNION ALL SELECT permno, month, 'industry=' || i.ind, CASE WHEN te.ind = i.ind THEN 1.0::DOUBLE ELSE 0.0 END FROM te, (SELECT DISTINCT ind FROM tr) i""", "value")
def _(t):
    """Every feature of every test row; a quarter of the volumes is missing, and dlret is too empty to be kept."""
    from pyspark.ml.functions import vector_to_array

    at = t.stock.withColumn("vol", F.when(F.col("permno") % 4 != 0, F.col("vol"))).select("permno", "month", "siccd", "ret", "prc", "vol", "dlret")
    at = settled(j.with_series(at, t.macro.select("month", *MACROS)))
    fitted = m.FeatureBuilder(("ret", "prc", "vol", "dlret"), MACROS).fit(m.between(at, (1995, 1998)))
    named = F.arrays_zip(F.array(*(F.lit(n) for n in fitted.names)).alias("name"), vector_to_array("features").alias("value"))
    rows = fitted.transform(m.between(at, (1999, 2001))).select("permno", "month", F.explode(named).alias("f"))
    return rows.select("permno", "month", F.col("f.name").alias("name"), F.col("f.value").alias("value"))


@query("m6_splits", """
SELECT y AS test_year, r AS role, count(*) AS n, min(month) AS first, max(month) AS last FROM stock, range(1999, 2002) t(y), (VALUES ('tune'), ('validation'), ('train'), ('test')) v(r)
WHERE ret IS NOT NULL AND year(month) BETWEEN CASE r WHEN 'test' THEN y WHEN 'validation' THEN y - 2 ELSE 1995 END AND CASE r WHEN 'tune' THEN y - 3 WHEN 'test' THEN y ELSE y - 1 END GROUP BY 1, 2""")
def _(t):
    """The rows of each window as expanding_forecasts() cuts them, tests after their training."""
    at, parts = t.stock.filter("ret IS NOT NULL"), []
    for s in m.splits(1999, 2001, 1995, 2):
        cut = {role: m.between(at, s[role]) for role in ("tune", "validation", "train", "test")}
        cut["test"] = a.assert_before(cut["train"], cut["test"])
        parts += [x.select(F.lit(s["test_year"]).alias("test_year"), F.lit(role).alias("role"), "month") for role, x in cut.items()]
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    return every.groupBy("test_year", "role").agg(F.count("*").alias("n"), F.min("month").alias("first"), F.max("month").alias("last"))


@query("c2_test_after_training", "SELECT permno, month FROM stock WHERE year(month) BETWEEN 1999 AND 2001")
def _(t):
    return a.assert_before(m.between(t.stock, (1995, 1998)), m.between(t.stock, (1999, 2001))).select("permno", "month")


@query("m7_m8_m10_surface")
def _(t):
    _, train, test = halves(t)
    projection = m.Projection().fit(train)
    return m.elastic_net_surface(projection.transform(train), projection.transform(test))


#: Every cell of the grid for two features in closed form: of the nine patterns of signs the one with the least objective.
@query("m8_two_feature_surface", """
WITH base AS (SELECT s.month, (1 + ret) * (1 + coalesce(dlret, 0)) - 1 - f.rf AS y, ln(prc) AS p, ln(vol) AS v FROM stock s JOIN factors f ON s.month = f.month WHERE ret IS NOT NULL),
tune AS (SELECT * FROM base WHERE year(month) <= 1998), test AS (SELECT * FROM base WHERE year(month) >= 1999),
k AS (SELECT count(*) AS n, avg(y) AS my, avg(p) AS mp, avg(v) AS mv, stddev_pop(p) AS sp, stddev_pop(v) AS sv, covar_pop(p, v) / (stddev_pop(p) * stddev_pop(v)) AS c, covar_pop(p, y) / stddev_pop(p) AS g1, covar_pop(v, y) / stddev_pop(v) AS g2 FROM tune),
cells AS (SELECT power(10, -5 + 6 * i / 19.0) AS alpha, l1 FROM range(20) a(i), (VALUES (0.0::DOUBLE), (0.01::DOUBLE), (0.1::DOUBLE), (0.3::DOUBLE), (0.5::DOUBLE)) r(l1)),
cost AS (SELECT *, CASE WHEN l1 < 0.05 THEN 0 ELSE alpha * l1 END AS lasso, CASE WHEN l1 < 0.05 THEN alpha / n ELSE alpha * (1 - l1) END AS ridge FROM cells, k),
signs AS (SELECT cost.*, a, b, 1 + ridge AS d FROM cost, (VALUES (-1), (0), (1)) x(a), (VALUES (-1), (0), (1)) z(b)),
points AS (SELECT *, CASE WHEN a = 0 THEN 0 WHEN b = 0 THEN (g1 - a * lasso) / d ELSE (d * (g1 - a * lasso) - c * (g2 - b * lasso)) / (d * d - c * c) END AS w1,
    CASE WHEN b = 0 THEN 0 WHEN a = 0 THEN (g2 - b * lasso) / d ELSE (d * (g2 - b * lasso) - c * (g1 - a * lasso)) / (d * d - c * c) END AS w2 FROM signs),
best AS (SELECT * FROM points QUALIFY row_number() OVER (PARTITION BY alpha, l1 ORDER BY (w1 * w1 + w2 * w2) * d / 2 + c * w1 * w2 - g1 * w1 - g2 * w2 + lasso * (abs(w1) + abs(w2)), a, b) = 1),
scored AS (SELECT alpha, l1, 1 - sum((y - my - w1 * (p - mp) / sp - w2 * (v - mv) / sv) ** 2) / sum(y * y) AS r2 FROM best, test GROUP BY 1, 2)
SELECT alpha, l1, r2 FROM scored""", "alpha r2")
def _(t):
    from pyspark.ml.functions import array_to_vector

    at = m.with_target(j.with_series(adjusted(t), t.factors.select("month", "rf"))).filter("y IS NOT NULL")
    at = at.select("month", "y", array_to_vector(F.array(F.ln("prc"), F.ln("vol"))).alias("features"))
    return m.elastic_net_surface(m.between(at, (1995, 1998)), m.between(at, (1999, 2001)), features="features").select("alpha", "l1", "r2")


@query("m6_m11_m15_expanding_forecasts")
def _(t):
    return m.expanding_forecasts(learning_panel(t), builder, m.splits(2000, 2001, 1995, 2), m.ALPHAS, m.RATIOS, keep=stored)[0]


@query("m15_chosen_parameters")
def _(t):
    return m.expanding_forecasts(learning_panel(t), builder, m.splits(2000, 2001, 1995, 2), m.ALPHAS, m.RATIOS)[2]


@query("m9_huber")
def _(t):
    _, train, test = halves(t)
    projection = m.Projection().fit(train)
    weights, level = m.huber_elastic_net(projection.transform(train), 1e-3, 0.5, 0.7)
    return a.zero_r2(m.predict_linear(projection.transform(test), weights, level), "y", "prediction", "month")


@query("m9_epsilon_grid")
def _(t):
    _, train, test = halves(t)
    projection = m.Projection().fit(train)
    return m.choose_epsilon(projection.transform(train), projection.transform(test), 1e-3, 0.5)


@query("m11_forecast_table", """
WITH q AS (SELECT month, quantile_cont(ret, 0.01) AS lo, quantile_cont(ret, 0.99) AS hi FROM stock GROUP BY month)
SELECT permno, s.month, CASE WHEN ret IS NOT NULL THEN least(greatest(ret, lo), hi) END AS expected_ret, ret AS raw_ret FROM stock s JOIN q ON q.month = s.month""", "expected_ret raw_ret")
def _(t):
    return m.forecast_table(t.stock.withColumn("prediction", F.col("ret")))


@query("m12_l3_importance", """
WITH x AS (SELECT (1 + ret) * (1 + coalesce(dlret, 0)) - 1 - f.rf AS y, ln(prc) AS a, ln(vol) AS b, ln(market_cap) AS c FROM stock s JOIN factors f ON s.month = f.month WHERE ret IS NOT NULL),
p AS (SELECT *, 0.1 + 0.02 * a - 0.03 * b + 0.001 * c AS p FROM x)
SELECT 'price' AS name, 1 - sum((y - p) ** 2) / sum(y * y) - (1 - sum((y - p + 0.02 * a) ** 2) / sum(y * y)) AS drop FROM p
UNION ALL SELECT 'volume', 1 - sum((y - p) ** 2) / sum(y * y) - (1 - sum((y - p - 0.03 * b) ** 2) / sum(y * y)) FROM p""", "drop")
def _(t):
    """A linear model of three features, of which the two with the largest weights are asked for."""
    from pyspark.ml.functions import array_to_vector

    at = m.with_target(j.with_series(adjusted(t), t.factors.select("month", "rf"))).filter("y IS NOT NULL")
    at = at.select("y", array_to_vector(F.array(F.ln("prc"), F.ln("vol"), F.ln("market_cap"))).alias("features"))
    return m.zero_out_importance(m.predict_linear(at, [0.02, -0.03, 0.001], 0.1, "features"), [0.02, -0.03, 0.001], ["price", "volume", "size"], top=2)


@query("m12_importance")
def _(t):
    fitted, train, test = halves(t)
    model = m.elastic_net(train, 1e-3, 0.5, 1.0, "features")
    return m.zero_out_importance(model.transform(test), model.coefficients.toArray().tolist(), fitted.names, top=10)


@query("m13_forest")
def _(t):
    _, train, test = halves(t)
    model = m.forest(train, 10, 4, "sqrt", 20)
    return a.zero_r2(model.transform(test), "y", "prediction", "month")


@query("m13_forest_surface")
def _(t):
    _, train, test = halves(t)
    return m.forest_surface(train, test, least_leaf=200)


@query("m14_forest_report")
def _(t):
    fitted, train, _ = halves(t)
    return m.forest_report(m.forest(train, 10, 4, "sqrt", 20), fitted.names, t.spark, max_depth=4)[0]


@query("m14_forest_depths")
def _(t):
    fitted, train, test = halves(t)
    model = m.forest(train, 10, 4, "sqrt", 20)
    fits = [m.r2(model.transform(x)) for x in (train, test)]
    return m.forest_report(model, fitted.names, t.spark, *fits, max_depth=4)[1]
