"""Portfolio tables: weights, turnover, capped trades, costs, realised returns, frontiers and optimality checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import estimators as e

#: Models by name: functions from the panel, or any holder of its tables, to (form_month, permno, mu).
MODELS: dict[str, Callable[..., DataFrame]] = {}


def model(name: str):
    """Register a function that returns forecasts (mu) or weights for every formation month."""

    def add(fn):
        MODELS[name] = fn
        return fn

    return add


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def forecasts(panel, names: Sequence[str]) -> DataFrame:
    """model, form_month, permno, mu of the named models; an error for one that gives weights."""
    made = {n: MODELS[n](panel) for n in names}
    if direct := [n for n, x in made.items() if "mu" not in x.columns]:
        raise ValueError(f"models without forecasts: {direct}; model_weights() takes them")
    return _union([x.select(F.lit(n).alias("model"), "form_month", "permno", "mu") for n, x in made.items()])


def model_weights(panel, names: Sequence[str], window: DataFrame, shrunk: DataFrame | None = None, **options) -> DataFrame:
    """model, form_month, permno, weight, delta of the named models, over the entities of each window.

    A model that gives weights is taken as it is and has no delta, without any covariance; one that
    gives forecasts goes through mean_variance_weights(), for which `shrunk` and `options` are.
    """
    members = window.select("form_month", "permno").distinct()
    parts, mus = [], []
    for n in names:
        made = MODELS[n](panel)
        if "weight" in made.columns:
            own = made.select(F.lit(n).alias("model"), "form_month", "permno", F.col("weight").cast("double").alias("weight"), F.lit(None).cast("double").alias("delta"))
            parts.append(own.filter("weight IS NOT NULL").join(members, ["form_month", "permno"], "left_semi"))
        else:
            mus.append(made.select(F.lit(n).alias("model"), "form_month", "permno", "mu"))
    if mus:
        solved = mean_variance_weights(window, shrunk, _union(mus), **options)
        parts.append(solved.join(shrunk.select("form_month", "delta"), "form_month").select("model", "form_month", "permno", "weight", "delta"))
    return _union(parts)


def equal_weights(window: DataFrame) -> DataFrame:
    """form_month, permno, weight over the entities of each window."""
    members = window.select("form_month", "permno").distinct()
    return members.withColumn("weight", 1.0 / F.count("*").over(Window.partitionBy("form_month")))


def _capped_simplex(v: np.ndarray, cap: float) -> np.ndarray:
    """Nearest point with sum 1 and entries in [0, cap]."""
    lo, hi = v.min() - cap - 1, v.max() + 1
    for _ in range(100):
        mid = (lo + hi) / 2
        if np.clip(v - mid, 0, cap).sum() > 1:
            lo = mid
        else:
            hi = mid
    return np.clip(v - hi, 0, cap)


def _solve(x: np.ndarray, mu: np.ndarray, delta: float, rho: float, aversion: float, cap: float, steps: int) -> np.ndarray:
    """Mean-variance weights by accelerated projected gradient; the covariance is only multiplied, never formed."""
    n, cap = len(mu), max(cap, 1 / len(mu))
    s = x.std(axis=0, ddof=1)

    def times(w):
        return (1 - delta) * (x.T @ (x @ w)) / (len(x) - 1) + delta * (rho * s * (s @ w) + (1 - rho) * s * s * w)

    top, v = 0.0, np.ones(n) / np.sqrt(n)
    for _ in range(50):
        u = times(v)
        top = np.linalg.norm(u)
        if top == 0:
            break
        v = u / top
    rate = 1 / (aversion * max(top, 1e-12) * 1.1)
    w = y = np.full(n, 1 / n)
    k = 1.0
    for _ in range(steps):
        new = _capped_simplex(y - rate * (aversion * times(y) - mu), cap)
        if (new - w) @ (y - new) > 0:  # restart where momentum turns uphill
            k = 1.0
        nk = (1 + np.sqrt(1 + 4 * k * k)) / 2
        y = new + (k - 1) / nk * (new - w)
        done = np.abs(new - w).max() < 1e-10
        w, k = new, nk
        if done:
            break
    w = np.clip(w, 0, cap)
    return w / w.sum()


def mean_variance_weights(window: DataFrame, shrunk: DataFrame, mu: DataFrame, aversion: float = 5.0, cap: float = 0.05, least: int = 10, steps: int = 3000) -> DataFrame:
    """model, form_month, permno, weight: max mu'w - aversion/2 w'Sw with sum 1 and 0 <= w <= cap.

    Entities without a forecast are left out; months with fewer than `least` are skipped; if the
    solution is not finite the weights are equal. A group is one window of one model, which
    returns_window bounds (months x top entities).
    """
    rows = window.groupBy("form_month", "permno").agg(F.array_sort(F.collect_list(F.struct("month", "r"))).alias("m"))
    at = mu.filter(F.col("mu").isNotNull()).join(rows.select("form_month", "permno", F.transform("m", lambda m: m["r"]).alias("r")), ["form_month", "permno"]).join(shrunk.select("form_month", "delta", "rho"), "form_month")

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("permno")
        if len(g) < least:
            return pd.DataFrame({"model": [], "form_month": [], "permno": [], "weight": []})
        r = np.array(g["r"].tolist()).T
        w = _solve(r - r.mean(axis=0), g["mu"].to_numpy(), float(g["delta"].iloc[0]), float(g["rho"].fillna(0).iloc[0]), aversion, cap, steps)
        if not np.isfinite(w).all():
            w = np.full(len(g), 1 / len(g))
        return pd.DataFrame({"model": g["model"], "form_month": g["form_month"], "permno": g["permno"], "weight": w})

    return at.groupBy("model", "form_month").applyInPandas(solve, "model string, form_month date, permno long, weight double")


def _months(weights: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, form_month and the computed month before it."""
    return weights.select(*keys, "form_month").distinct().withColumn("before", F.lag("form_month").over(Window.partitionBy(*keys).orderBy("form_month")))


def turnover(weights: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """keys, form_month, turnover: half the sum of weight changes against the month computed before; 1 in the first."""
    months = _months(weights, keys)
    now = weights.select(*keys, "form_month", "permno", F.col("weight").alias("new"), F.lit(0.0).alias("old"))
    following = months.filter("before IS NOT NULL").select(*keys, "form_month", "before")
    old = weights.withColumnRenamed("form_month", "before").join(following, [*keys, "before"]).select(*keys, "form_month", "permno", F.lit(0.0).alias("new"), F.col("weight").alias("old"))
    moved = now.unionByName(old).groupBy(*keys, "form_month", "permno").agg((F.sum("new") - F.sum("old")).alias("d"))
    total = moved.groupBy(*keys, "form_month").agg((F.sum(F.abs("d")) / 2).alias("turnover"))
    return total.join(months, [*keys, "form_month"]).select(*keys, "form_month", F.when(F.col("before").isNull(), 1.0).otherwise(F.col("turnover")).alias("turnover"))


def capped_weights(weights: DataFrame, caps: DataFrame, keys: Sequence[str] = ("model",), dust: float = 1e-8) -> DataFrame:
    """keys, cap_label, cap_value, form_month, permno, weight, at_cap: trades scaled back to the month's turnover cap.

    Each month starts from the capped weights of the month before, so months follow each other;
    models and caps run side by side. A NULL cap leaves the weights as they are.
    """
    at = weights.select(*keys, "form_month", "permno", "weight").join(F.broadcast(caps), how="cross")

    def chain(g: pd.DataFrame) -> pd.DataFrame:
        cap, out, before = g["cap_value"].iloc[0], [], None
        for month, rows in g.sort_values(["form_month", "permno"]).groupby("form_month", sort=True):
            w, bound = pd.Series(rows["weight"].to_numpy(), rows["permno"].to_numpy()), False
            if before is not None and not pd.isna(cap):
                ids = before.index.union(w.index)
                old, new = before.reindex(ids, fill_value=0.0), w.reindex(ids, fill_value=0.0)
                moved = 0.5 * (new - old).abs().sum()
                if moved > cap:
                    w, bound = (old + cap / moved * (new - old)).clip(lower=0.0), True
                    w = w / w.sum()
                    w = w[w >= dust]
            before = w
            out.append(pd.DataFrame({"form_month": month, "permno": w.index, "weight": w.to_numpy(), "at_cap": bound}))
        done = pd.concat(out)
        for n in (*keys, "cap_label", "cap_value"):
            done[n] = g[n].iloc[0]
        return done[[*keys, "cap_label", "cap_value", "form_month", "permno", "weight", "at_cap"]]

    kinds = dict(weights.dtypes)
    schema = ", ".join([*(f"{n} {kinds[n]}" for n in keys), "cap_label string, cap_value double, form_month date, permno long, weight double, at_cap boolean"])
    return at.groupBy(*keys, "cap_label").applyInPandas(chain, schema)


def realised(weights: DataFrame, stock: DataFrame, keys: Sequence[str] = ("model",), ret: str = "ret_adjusted") -> DataFrame:
    """keys, form_month, gross_return next month, over the entities with a return, weights rescaled to 1."""
    later = stock.filter(F.col(ret).isNotNull()).groupBy("permno", F.add_months("month", -1).alias("form_month")).agg(F.avg(ret).alias("r"))
    return weights.join(later, ["permno", "form_month"]).groupBy(*keys, "form_month").agg(F.try_divide(F.sum(F.col("weight") * F.col("r")), F.sum("weight")).alias("gross_return"))


def backtest_log(weights: DataFrame, stock: DataFrame, cost_bps: float = 10.0, keys: Sequence[str] = ("model",), digits: int | None = None) -> DataFrame:
    """keys, form_month, ret_month, n_assets, n_active, gross_return, turnover, cost, net_return.

    Months without a next month's return are dropped; cost is flat per unit of turnover.
    """
    sizes = weights.groupBy(*keys, "form_month").agg(F.count("*").alias("n_assets"), F.count_if(F.col("weight") > 1e-4).alias("n_active"))
    at = sizes.join(realised(weights, stock, keys), [*keys, "form_month"]).join(turnover(weights, keys), [*keys, "form_month"])
    at = at.withColumn("cost", F.col("turnover") * F.lit(cost_bps / 1e4)).withColumn("net_return", F.col("gross_return") - F.col("cost"))
    r = (lambda n, d: F.round(n, d)) if digits else (lambda n, d: F.col(n))
    return at.select(*keys, "form_month", F.add_months("form_month", 1).alias("ret_month"), "n_assets", "n_active", r("gross_return", 6).alias("gross_return"), r("turnover", 4).alias("turnover"), r("cost", 6).alias("cost"), r("net_return", 6).alias("net_return"))


def frontier(weights: DataFrame, stock: DataFrame, caps: DataFrame, cost_bps: float = 10.0) -> DataFrame:
    """One row per model and cap: the performance of the capped weights and the share of months at the cap."""
    from tessera.operators.evaluate import performance

    capped = capped_weights(weights, caps)
    keys = ("model", "cap_label")
    bound = capped.groupBy(*keys, "cap_value", "form_month").agg(F.max(F.col("at_cap").cast("int")).alias("b")).groupBy(*keys, "cap_value").agg((100 * F.avg("b")).alias("pct_months_at_cap"))
    return performance(backtest_log(capped, stock, cost_bps, keys), keys=keys).join(bound, list(keys))


def primary_frontier(computed: DataFrame, stored: DataFrame, keys: Sequence[str] = ("model", "cap_label")) -> DataFrame:
    """Computed rows, and stored ones of the keys that were not computed."""
    both = computed.withColumn("_order", F.lit(0)).unionByName(stored.withColumn("_order", F.lit(1)), allowMissingColumns=True)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_order"))
    return both.withColumn("_n", rank).filter("_n = 1").drop("_n", "_order")


def optimality(window: DataFrame, shrunk: DataFrame, mu: DataFrame, weights: DataFrame, aversion: float = 5.0, cap: float = 0.05, cost_bps: float = 10.0) -> DataFrame:
    """model, form_month, permno, weight, mu, mu_net, g, status: gradients of the solved portfolios.

    g = aversion * S w - mu + nu with nu = -median over interior names (over held ones where
    none is interior). At an optimum g is 0 inside, >= 0 at zero and <= 0 at the cap. mu_net
    takes the cost of the trade since the month before off.
    """
    keys = ["model", "form_month"]
    at = mu.filter(F.col("mu").isNotNull()).join(weights, [*keys, "permno"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    at = at.join(weights.select(*keys).distinct(), keys, "left_semi")
    sw = e.covariance_times(window, shrunk, at.select(*keys, "permno", "weight"), keys).drop("weight")
    at = at.join(sw, [*keys, "permno"]).withColumn("grad", aversion * F.col("sw") - F.col("mu"))
    inside = (F.col("weight") > 1e-6) & (F.col("weight") < cap - 1e-6)
    nu = at.groupBy(*keys).agg((-F.coalesce(F.median(F.when(inside, F.col("grad"))), F.median(F.when(F.col("weight") > 1e-6, F.col("grad"))), F.lit(0.0))).alias("nu"))
    before = weights.withColumnRenamed("form_month", "before").withColumnRenamed("weight", "w_prev").join(_months(weights, ["model"]).filter("before IS NOT NULL"), ["model", "before"]).select(*keys, "permno", "w_prev")
    at = at.join(nu, keys).join(before, [*keys, "permno"], "left")
    trade = F.col("weight") - F.coalesce("w_prev", F.lit(0.0))
    status = F.when(F.col("weight") < 1e-6, "zero").when(F.col("weight") > cap - 1e-6, "cap").otherwise("interior")
    return at.select(*keys, "permno", "weight", "mu", (F.col("mu") - cost_bps / 1e4 * F.signum(trade)).alias("mu_net"), (F.col("grad") + F.col("nu")).alias("g"), "nu", status.alias("status"))


def optimality_summary(checked: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Per model and month: counts by status, residuals of interior names and violations by kind."""
    s, g = F.col("status"), F.col("g")
    inner = (s == "interior") & (F.abs(g) > tolerance)
    zero, top = (s == "zero") & (g < -tolerance), (s == "cap") & (g > tolerance)
    return checked.groupBy("model", "form_month").agg(
        F.count("*").alias("n_assets"),
        F.count_if(F.col("weight") > 1e-6).alias("n_held"),
        F.count_if(s == "interior").alias("n_interior"),
        F.count_if(s == "zero").alias("n_at_zero"),
        F.count_if(s == "cap").alias("n_at_cap"),
        F.first("nu").alias("nu"),
        F.avg(F.when(s == "interior", F.abs(g))).alias("mean_abs_residual"),
        F.max(F.when(s == "interior", F.abs(g))).alias("max_abs_residual"),
        F.count_if(inner).alias("n_interior_viol"),
        F.count_if(zero).alias("n_zero_viol"),
        F.count_if(top).alias("n_cap_viol"),
        F.count_if(inner | zero | top).alias("n_violations"),
    )


def optimality_by_model(summary: DataFrame) -> DataFrame:
    return summary.groupBy("model").agg(F.count("*").alias("n_months"), F.count_if(F.col("n_violations") == 0).alias("n_clean"), F.sum("n_violations").alias("n_violations"), F.max("max_abs_residual").alias("max_abs_residual"), F.avg("n_held").alias("mean_held"))


def cap_table(spark: SparkSession, caps: Sequence[float | None] = (None, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5)) -> DataFrame:
    return spark.createDataFrame([("none" if c is None else f"{c:.0%}", c) for c in caps], "cap_label string, cap_value double")
