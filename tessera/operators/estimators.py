"""Rolling estimators: betas, premia, shrunk and factor covariances, and the market regression.

Sums over windows are DataFrame work; Python sees small bounded groups only (one 6 x 6 system
per row, one window of at most a few hundred months by a few hundred entities per group).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessera.operators import joins as j
from tessera.operators.moments import Moments

FACTORS = ("mkt_rf", "smb", "hml", "rmw", "cma")
MACROS = ("dp_ratio", "term_spread", "real_short_rate", "default_spread", "indpro_growth", "volatility")


def _chosen(found: DataFrame, stock: DataFrame, top: int) -> DataFrame:
    """found (form_month, permno, ...) of the `top` largest by market cap in the formation month, with rank (0 where all stay)."""
    caps = stock.select(F.col("month").alias("form_month"), "permno", "market_cap")
    at = found.join(caps, ["form_month", "permno"], "left").withColumn("_caps", F.count("market_cap").over(Window.partitionBy("form_month")))
    rank = F.row_number().over(Window.partitionBy("form_month").orderBy(F.coalesce("market_cap", F.lit(0.0)).desc(), "permno"))
    few = F.col("_caps") < 50
    return at.withColumn("rank", rank).filter((F.col("rank") <= top) | few).select(*found.columns, F.when(few, 0).otherwise(F.col("rank")).alias("rank"))


def window_members(stock: DataFrame, forms: DataFrame, months: int = 60, least_share: float = 0.8, top: int = 500, ret: str = "ret_adjusted") -> DataFrame:
    """form_month, permno, rank of the entities of returns_window(), by counts alone: no returns are packed."""
    long = j.trailing_window(stock.filter(F.col(ret).isNotNull()).select("permno", "month"), forms, months)
    found = long.groupBy("form_month", "permno").agg(F.count("*").alias("_n")).filter(F.col("_n") >= math.ceil(months * least_share)).drop("_n")
    return _chosen(found, stock, top)


def returns_window(stock: DataFrame, forms: DataFrame, months: int = 60, least_share: float = 0.8, top: int = 500, ret: str = "ret_adjusted", ranked: bool = False) -> DataFrame:
    """form_month, month, permno, r, imputed: trailing returns of the entities chosen at each formation month.

    Entities need `least_share` of the window's returns; of these the `top` largest by market cap
    in the formation month (a missing cap counts as 0; without 50 caps all stay). Gaps get the
    entity's mean; months in which no entity has a return are dropped. With `ranked` also rank by
    market cap (0 where all stay), so that smaller choices can be cut from one window.
    """
    long = j.trailing_window(stock.filter(F.col(ret).isNotNull()).select("permno", "month", F.col(ret).alias("r")), forms, months)
    packed = long.groupBy("form_month", "permno").agg(F.avg("r").alias("mean"), F.map_from_entries(F.collect_list(F.struct("month", "r"))).alias("rs")).filter(F.size("rs") >= math.ceil(months * least_share))
    chosen = _chosen(packed, stock, top)
    live = chosen.select("form_month", F.explode(F.map_keys("rs")).alias("month")).distinct()
    r = F.try_element_at("rs", F.col("month"))
    return chosen.join(live, "form_month").select("form_month", "month", "permno", F.coalesce(r, "mean").alias("r"), r.isNull().alias("imputed"), *(["rank"] if ranked else []))


def _running(z: np.ndarray, first: np.ndarray, forward: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number, means and centred products of z over each block from its start to a row, or from a row to its end.

    first marks the blocks' first rows. Values are taken from a middle of their block, so running
    sums stay small whatever the level; nothing is ever subtracted from a sum.
    """
    block = np.cumsum(first) - 1
    begin = np.flatnonzero(first)
    count = np.diff(np.append(begin, len(z)))
    middle = (np.add.reduceat(z, begin, axis=0) / count[:, None])[block]
    low = z - middle
    products = low[:, :, None] * low[:, None, :]
    if not forward:
        low, products = low[::-1], products[::-1]
    starts = begin if forward else (len(z) - 1 - (begin + count - 1))[::-1]
    sums, squares = np.empty_like(low), np.empty_like(products)
    for lo, hi in zip(starts, [*starts[1:], len(z)], strict=True):
        np.cumsum(low[lo:hi], axis=0, out=sums[lo:hi])
        np.cumsum(products[lo:hi], axis=0, out=squares[lo:hi])
    place = np.arange(len(z))
    n = (place - begin[block] + 1) if forward else (begin + count)[block] - place
    if not forward:
        sums, squares = sums[::-1], squares[::-1]
    mean = sums / n[:, None]
    return n, middle + mean, squares - n[:, None, None] * mean[:, :, None] * mean[:, None, :]


def sliding_moments(index: np.ndarray, z: np.ndarray, months: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number, means and centred products of z over the rows within the last `months` of every row, index being sorted.

    The time line is cut into blocks of one window's length. A window is the end of one block and
    the start of the next, whose running moments are merged, so its length costs nothing.
    """
    if not len(index):
        k = z.shape[1]
        return np.zeros(0, np.int64), np.zeros((0, k)), np.zeros((0, k, k))
    block = index // months
    first = np.append(True, block[1:] != block[:-1])
    n, mean, products = _running(z, first, True)
    m, mean_b, products_b = _running(z, first, False)
    # rows of one month see each other, so the start of a block runs to the last row of the month
    to = np.searchsorted(index, index, "right") - 1
    n, mean, products = n[to], mean[to], products[to]
    at = np.searchsorted(index, index - months, "right")  # the window's first row
    split = block[at] != block
    m = np.where(split, m[at], 0)
    gap = (mean_b[at] - mean) * split[:, None]
    total = n + m
    weight = (n * m / total)[:, None, None]
    both = products + products_b[at] * split[:, None, None] + gap[:, :, None] * gap[:, None, :] * weight
    return total, mean + gap * (m / total)[:, None], both


def least_squares(total: np.ndarray, mean: np.ndarray, products: np.ndarray, least: int, rank: float = 1e-12) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which rows have a unique fit of the last column on the others, and their betas (intercept first), sums of squared errors and R2.

    Systems are scaled to correlations and eliminated together; a pivot below `rank` means that
    a column follows from those before it.
    """
    k = products.shape[1] - 1
    size = np.sqrt(np.maximum(products[:, range(k), range(k)], 0))
    scale = np.where(size > 0, size, 1)
    a = products[:, :k, :k] / (scale[:, :, None] * scale[:, None, :])
    b = products[:, :k, k] / scale
    good = (total >= least) & (size > 0).all(axis=1) & (total > k)
    r, v = a.copy(), b.copy()
    for j in range(k):
        pivot = r[:, j, j]
        good &= pivot > rank
        safe = np.where(pivot > rank, pivot, 1)
        for i in range(j + 1, k):
            f = r[:, i, j] / safe
            r[:, i] -= f[:, None] * r[:, j]
            v[:, i] -= f * v[:, j]
    w = np.zeros_like(v)
    for j in reversed(range(k)):
        w[:, j] = (v[:, j] - (r[:, j, j + 1 :] * w[:, j + 1 :]).sum(axis=1)) / np.where(good, r[:, j, j], 1)
    beta = w / scale
    level = mean[:, k] - (beta * mean[:, :k]).sum(axis=1)
    sst = products[:, k, k]
    sse = np.maximum(sst - 2 * (w * b).sum(axis=1) + np.einsum("ni,nij,nj->n", w, a, w), 0)
    return good, np.column_stack([level, beta]), sse, np.where(sst > 0, 1 - sse / np.where(sst > 0, sst, 1), np.nan)


def rolling_betas(stock: DataFrame, factors: DataFrame, months: int = 60, least: int = 48, names: Sequence[str] = FACTORS, y: str = "excess") -> DataFrame:
    """Adds n_obs, betas (intercept first, NULL below `least` rows or without a unique solution), idio_var and r2.

    The windows are calendar months, so gaps shorten them; rows with a NULL among y and factors
    count for none. An entity's history is one group, read in order; the window's length costs
    nothing, and moments are centred, so levels do not blur them.
    """
    at = j.with_series(stock, factors).withColumns({"_index": F.year("month") * 12 + F.month("month") - 1, "_z": F.array(*(F.col(n).cast("double") for n in (*names, y)))})
    k = len(names) + 1

    def fit(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, [("_index", "ascending")]))
        index = t["_index"].to_numpy()
        z = t["_z"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, k).astype(float)
        seen = np.isfinite(z).all(axis=1)
        total, mean, products = sliding_moments(index[seen], z[seen], months)
        # a row without values has the window of the last seen row, less what has left it since: asked for by a value of no weight
        n_obs, betas = np.zeros(len(t), np.int64), np.full((len(t), k), np.nan)
        idio, fits = np.full(len(t), np.nan), np.full(len(t), np.nan)
        where = np.flatnonzero(seen)
        rest = np.flatnonzero(~seen)
        lo, hi = (np.searchsorted(index[seen], x, "right") for x in (index[rest] - months, index[rest]))
        n_obs[where], n_obs[rest] = total, hi - lo
        if len(rest):  # few rows: each window anew
            some = [Moments.of(z[seen][a:b]) for a, b in zip(lo, hi, strict=True)]
            total, mean, products = (np.concatenate([x, np.array(s)]) for x, s in ((total, [s.n for s in some]), (mean, [s.mean for s in some]), (products, [s.products for s in some])))
        good, beta, sse, r2 = least_squares(total, mean, products, least)
        order = np.concatenate([where, rest])
        use = order[good]
        betas[use], idio[use], fits[use] = beta[good], sse[good] / np.maximum(total[good] - k, 1), r2[good]
        idio[n_obs <= k] = np.nan
        fitted = np.isin(np.arange(len(t)), use)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(fitted * k))), pa.int32()), pa.array(betas[fitted].ravel()), mask=pa.array(~fitted))
        out = t.drop_columns(["_index", "_z"])
        return out.append_column("n_obs", pa.array(n_obs)).append_column("betas", lists).append_column("idio_var", pa.array(idio, from_pandas=True)).append_column("r2", pa.array(fits, from_pandas=True))

    wanted = at.select(*stock.columns, "_index", "_z")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in stock.schema), "n_obs long, betas array<double>, idio_var double, r2 double"])
    # rows without an entity are no group that could be fitted
    whole = wanted.filter("permno IS NOT NULL").groupBy("permno").applyInArrow(fit, schema)
    none = wanted.filter("permno IS NULL").select(*stock.columns, F.lit(0).cast("long").alias("n_obs"), F.lit(None).cast("array<double>").alias("betas"), F.lit(None).cast("double").alias("idio_var"), F.lit(None).cast("double").alias("r2"))
    return whole.unionByName(none)


def mean_premia(factors: DataFrame, months: int = 60, names: Sequence[str] = FACTORS) -> DataFrame:
    """form_month, rf, premia: trailing means of the factors, a window over a short series."""
    over = Window.orderBy(F.year("month") * 12 + F.month("month")).rangeBetween(-(months - 1), 0)
    return factors.select(F.col("month").alias("form_month"), F.avg("rf").over(over).alias("rf"), F.array(*(F.avg(n).over(over) for n in names)).alias("premia"))


def forecast(betas: DataFrame, premia: DataFrame) -> DataFrame:
    """form_month, permno, mu = mean rf + betas without the intercept times premia."""
    at = betas.filter("betas IS NOT NULL").select(F.col("month").alias("form_month"), "permno", "betas")
    both = at.join(F.broadcast(premia) if premia.count() <= j.SERIES_ROWS else premia, "form_month")
    dot = F.aggregate(F.zip_with(F.slice("betas", F.lit(2), F.size("premia")), "premia", lambda b, p: b * p), F.lit(0.0), lambda s, v: s + v)
    return both.select("form_month", "permno", (F.col("rf") + dot).alias("mu"))


def conditioning_windows(factors: DataFrame, macro: DataFrame, forms: DataFrame, months: int = 60, keys: Sequence[str] = ()) -> DataFrame:
    """form_month, month, factors f, macro row of the month x, of the month before x_lag: one group per formation month (and key)."""
    f = factors.select("month", F.array(*FACTORS).alias("f"), *keys)
    x = macro.select("month", F.array(*MACROS).alias("x"))
    before = x.select(F.add_months("month", 1).alias("month"), F.col("x").alias("x_lag"))
    return j.trailing_window(f.join(x, "month", "left").join(before, "month", "left"), forms, months)


def _complete(rows) -> np.ndarray:
    return np.array([r is not None and all(v is not None and math.isfinite(v) for v in r) for r in rows], bool)


class _Prefix:
    """Cross-products of the first rows of x and y for every number of rows, from one running sum each."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.z = np.hstack([x, y])
        self.q = x.shape[1]
        self.sums = np.vstack([np.zeros(self.z.shape[1]), np.cumsum(self.z, axis=0)])
        self.products = np.concatenate([np.zeros((1, self.z.shape[1], self.z.shape[1])), np.cumsum(self.z[:, :, None] * self.z[:, None, :], axis=0)])

    def ridge(self, rows: int, alphas: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
        """Slopes (alphas x columns of x x columns of y) and levels of ridge on the first rows; all alphas from one eigendecomposition."""
        mean = self.sums[rows] / rows
        s = self.products[rows] - rows * np.outer(mean, mean)
        value, vector = np.linalg.eigh(s[: self.q, : self.q])
        turned = vector.T @ s[: self.q, self.q :]
        beta = np.stack([vector @ (turned / (np.maximum(value, 0) + alpha)[:, None]) for alpha in alphas])
        return beta, mean[self.q :] - mean[: self.q] @ beta


def ridge_premia(windows: DataFrame, least: int = 60, alphas: Sequence[float] = (0.01, 0.1, 1.0, 10.0, 100.0), folds: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    """form_month, premia, alphas: each factor on last month's macro state by ridge, else its mean.

    The penalty is chosen by forward folds: the rows are cut into folds + 1 parts in time and
    each part but the first is predicted from all rows before it, by prefix sums of their products.
    """

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("month")
        form = g["form_month"].iloc[0]
        f = np.array([[np.nan if v is None else v for v in r] for r in g["f"]], float)
        premia, chosen = np.nanmean(f, axis=0), [None] * f.shape[1]
        valid = _complete(g["x_lag"])
        now = g["x"][_complete(g["x"])]
        if valid.sum() >= least and len(now):
            x = np.array(g["x_lag"][valid].tolist())
            mean, sd = x.mean(axis=0), x.std(axis=0)
            sd[sd == 0] = 1
            x, x_now = (x - mean) / sd, (np.array(now.iloc[-1]) - mean) / sd
            n, part = len(x), len(x) // (folds + 1)
            starts = [n - part * k for k in range(folds, 0, -1)]
            full = np.flatnonzero(np.isfinite(f[valid]).all(axis=0))
            y = f[valid][:, full]
            if len(full):
                sums = _Prefix(x, y)
                miss = []
                for s in starts:
                    beta, level = sums.ridge(s, alphas)
                    miss.append(((y[s : s + part] - x[s : s + part] @ beta - level[:, None, :]) ** 2).mean(axis=1))
                best = np.mean(miss, axis=0).argmin(axis=0)
                beta, level = sums.ridge(n, alphas)
                for k, pick, at in zip(full, best, range(len(full)), strict=True):
                    premia[k], chosen[k] = x_now @ beta[pick, :, at] + level[pick, at], alphas[pick]
        return pd.DataFrame({**{n: [g[n].iloc[0]] for n in keys}, "form_month": [form], "premia": [premia.tolist()], "alphas": [chosen]})

    schema = ", ".join([*(f"{n} {dict(windows.dtypes)[n]}" for n in keys), "form_month date, premia array<double>, alphas array<double>"])
    return windows.groupBy(*keys, "form_month").applyInPandas(fit, schema)


def var_premia(windows: DataFrame, tau: int = 1, least_var: int = 36, least_price: int = 24, keys: Sequence[str] = ()) -> DataFrame:
    """form_month, premia, var_ok, pricing_ok, fallback, radius, and the fitted matrices flattened by rows.

    The macro state follows a first-order vector autoregression (a, c, omega); factors are priced
    on it (p, c_f, gamma). Premia are c_f + p times the mean of the next tau forecasts, or the
    factors' means where a step fails.
    """

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("month")
        f = np.array([[np.nan if v is None else v for v in r] for r in g["f"]], float)
        out = {n: g[n].iloc[0] for n in keys} | {"form_month": g["form_month"].iloc[0], "premia": np.nanmean(f, axis=0).tolist(), "var_ok": False, "pricing_ok": False, "fallback": True, "radius": None}
        out |= dict.fromkeys(("a", "c", "omega", "p", "c_f", "gamma"))
        state = _complete(g["x"])
        pairs = state & _complete(g["x_lag"])
        pairs[0] = False  # the window's first month has no month before it inside the window
        if pairs.sum() >= least_var:
            lagged, now = (np.array(g[n][pairs].tolist()) for n in ("x_lag", "x"))
            design = np.column_stack([np.ones(len(now)), lagged])
            coef = np.linalg.lstsq(design, now, rcond=None)[0]
            rest = now - design @ coef
            a, c = coef[1:].T, coef[0]
            out |= {"var_ok": True, "radius": float(np.abs(np.linalg.eigvals(a)).max()), "a": a.ravel().tolist(), "c": c.tolist(), "omega": (rest.T @ rest / (len(now) - design.shape[1])).ravel().tolist()}
            both = state & np.isfinite(f).all(axis=1)
            if both.sum() >= least_price:
                design = np.column_stack([np.ones(both.sum()), np.array(g["x"][both].tolist())])
                price = np.linalg.lstsq(design, f[both], rcond=None)[0]
                rest = f[both] - design @ price
                p, c_f = price[1:].T, price[0]
                out |= {"pricing_ok": True, "p": p.ravel().tolist(), "c_f": c_f.tolist(), "gamma": (rest.T @ rest / max(1, both.sum() - design.shape[1])).ravel().tolist()}
                x, total = np.array(g["x"][state].iloc[-1]), 0.0
                for _ in range(tau):
                    x = c + a @ x
                    total = total + x
                premia = c_f + p @ (total / tau)
                if np.isfinite(premia).all():
                    out |= {"premia": premia.tolist(), "fallback": False}
        return pd.DataFrame([out])

    matrices = ", ".join(f"{n} array<double>" for n in ("a", "c", "omega", "p", "c_f", "gamma"))
    schema = ", ".join([*(f"{n} {dict(windows.dtypes)[n]}" for n in keys), "form_month date, premia array<double>, var_ok boolean, pricing_ok boolean, fallback boolean, radius double", matrices])
    return windows.groupBy(*keys, "form_month").applyInPandas(fit, schema)


def conditional_covariance(betas: DataFrame, fits: DataFrame, tau: int = 1) -> DataFrame:
    """form_month, i, j (i <= j), cov over tau months: state risk through the pricing matrix, pricing errors, own risk.

    The core between factors is one small matrix per formation month; the result has a row for each
    pair of entities of it, so their number bounds the operator.
    """
    k, q = len(FACTORS), len(MACROS)

    @F.pandas_udf("array<double>")
    def core(a: pd.Series, omega: pd.Series, p: pd.Series, gamma: pd.Series) -> pd.Series:
        out = []
        for ai, oi, pi, gi in zip(a, omega, p, gamma, strict=True):
            a_, o_, p_, g_ = np.reshape(ai, (q, q)), np.reshape(oi, (q, q)), np.reshape(pi, (k, q)), np.reshape(gi, (k, k))
            total, s, power = np.zeros((q, q)), np.zeros((q, q)), np.eye(q)
            for _ in range(tau):
                s = s + power
                total += s @ o_ @ s.T
                power = a_ @ power
            out.append((p_ @ total @ p_.T + tau * g_).ravel().tolist())
        return pd.Series(out)

    cores = fits.filter("var_ok AND pricing_ok").select("form_month", core("a", "omega", "p", "gamma").alias("core"))
    return _pair_covariances(betas, cores, k, tau * F.col("idio_var"))


def _pair_covariances(betas: DataFrame, cores: DataFrame, k: int, own: Column, block: int = 128) -> DataFrame:
    """form_month, i, j (i <= j), cov = loadings times core, and `own` on the diagonal, by blocks of entities.

    A formation month's loadings are packed once (k numbers an entity); a task multiplies one block
    of them with all and sends the pairs as a batch, so pairs cost a product and no join.
    """
    rows = betas.filter("betas IS NOT NULL").select(F.col("month").alias("form_month"), F.struct("permno", F.slice("betas", 2, k).alias("b"), own.alias("own")).alias("row"))
    packed = rows.groupBy("form_month").agg(F.array_sort(F.collect_list("row")).alias("rows")).join(cores, "form_month")
    blocks = packed.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("rows") - 1, F.lit(block)))).repartition("form_month", "at")

    def multiply(batches):
        for batch in batches:
            for form, rows_, core, at in zip(batch.column("form_month"), batch.column("rows"), batch.column("core").to_pylist(), batch.column("at").to_pylist(), strict=True):
                struct = rows_.values
                b = struct.field("b").flatten().to_numpy().reshape(len(struct), k)
                ids, own_ = struct.field("permno").to_numpy(), struct.field("own").to_numpy(zero_copy_only=False)
                here = slice(at, at + block)
                cov = b[here] @ np.reshape(core, (k, k)) @ b.T
                i, j_ = np.nonzero(np.arange(len(ids))[None, :] >= np.arange(len(ids))[here][:, None])
                value = cov[i, j_] + np.where(i + at == j_, own_[j_], 0.0)
                yield pa.RecordBatch.from_arrays([pa.array([form.as_py()] * len(i), pa.date32()), pa.array(ids[i + at]), pa.array(ids[j_]), pa.array(value, from_pandas=True)], names=["form_month", "i", "j", "cov"])

    return blocks.select("form_month", "rows", "core", "at").mapInArrow(multiply, "form_month date, i long, j long, cov double")


def factor_covariance(betas: DataFrame, factors: DataFrame, months: int = 60, floor: float = 1e-8, names: Sequence[str] = FACTORS) -> DataFrame:
    """form_month, i, j (i <= j), cov = betas times factor covariance plus own variance on the diagonal."""
    over = Window.orderBy(F.year("month") * 12 + F.month("month")).rangeBetween(-(months - 1), 0)
    core = factors.select(F.col("month").alias("form_month"), F.array(*(F.covar_samp(a, b).over(over) for a in names for b in names)).alias("core"))
    return _pair_covariances(betas, core.filter(~F.exists("core", lambda v: v.isNull())), len(names), F.greatest("idio_var", F.lit(floor)))


def average_r2(betas: DataFrame) -> DataFrame:
    return betas.filter("r2 IS NOT NULL").groupBy(F.col("month").alias("form_month")).agg(F.avg("r2").alias("mean_r2"), F.count("*").alias("n"))


def shrinkage(window: DataFrame) -> DataFrame:
    """form_month, n_months, n_assets, delta, rho: shrinkage intensity and mean correlation of each window.

    Everything follows from the months-by-months products of centred returns, so no matrix
    over entities is formed. A task adds up the products of its entities, and one small matrix for
    each task and formation month is shuffled. The intensity is that for a scaled identity target,
    limited to [0, 1]. Entities of a window have the same months, as returns_window() makes them.
    """
    rows = window.groupBy("form_month", "permno").agg(F.transform(F.array_sort(F.collect_list(F.struct("month", "r"))), lambda x: x["r"]).alias("r"))

    def add(batches):
        held: dict = {}
        for batch in batches:
            form, lists = batch.column("form_month").to_pylist(), batch.column("r")
            flat, size = lists.flatten().to_numpy(), np.array([len(x) for x in lists])
            start = np.cumsum(size) - size
            where: dict = {}
            for k, f in enumerate(form):
                where.setdefault(f, []).append(k)
            for f, ks in where.items():
                if len({int(size[k]) for k in ks}) > 1:
                    raise ValueError(f"entities of the window {f} differ in their months")
                x = flat[start[ks][:, None] + np.arange(size[ks[0]])]
                x = x - x.mean(axis=1, keepdims=True)
                s = x.std(axis=1, ddof=1)[:, None] if x.shape[1] > 1 else np.zeros((len(x), 1))
                part = len(ks), int((s > 0).sum()), x.T @ x, (x[s[:, 0] > 0] / s[s > 0][:, None]).sum(axis=0)
                held[f] = tuple(p + q for p, q in zip(held[f], part, strict=True)) if f in held else part
        if held:
            n, n_z, gram, z = zip(*held.values(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.date32()), pa.array(n, pa.int64()), pa.array(n_z, pa.int64()), pa.array([g.ravel() for g in gram], pa.list_(pa.float64())), pa.array(list(z), pa.list_(pa.float64()))], names=["form_month", "n", "n_z", "gram", "z"])

    def finish(t: pa.Table) -> pa.Table:
        n, n_z = sum(t["n"].to_pylist()), sum(t["n_z"].to_pylist())
        gram, z = (np.sum([np.array(x) for x in t[c].to_pylist()], axis=0) for c in ("gram", "z"))
        months = len(z)
        gram = gram.reshape(months, months)
        diagonal = np.diag(gram)
        mu, second = diagonal.sum() / months / n, (gram**2).sum() / months**2 / n
        gap = second - mu * mu
        noise = min(gap, ((diagonal**2).sum() / months - (gram**2).sum() / months**2) / (n * months))
        delta = max(0.0, min(1.0, noise / gap)) if gap > 0 else 0.0
        rho = ((z @ z) / (months - 1) - n_z) / (n_z * (n_z - 1)) if n_z > 1 and months > 1 else None
        return pa.table({"form_month": t["form_month"].slice(0, 1), "n_months": pa.array([months], pa.int64()), "n_assets": pa.array([n], pa.int64()), "delta": pa.array([delta]), "rho": pa.array([rho], pa.float64())})

    parts = rows.select("form_month", "r").mapInArrow(add, "form_month date, n long, n_z long, gram array<double>, z array<double>")
    return parts.groupBy("form_month").applyInArrow(finish, "form_month date, n_months long, n_assets long, delta double, rho double")


def covariance_times(window: DataFrame, shrunk: DataFrame, weights: DataFrame, keys: Sequence[str] = ("form_month",)) -> DataFrame:
    """keys, permno, sw: the shrunk covariance times the weights, by two aggregations and no matrix.

    Target: own variances with the mean correlation between entities.
    """
    own = Window.partitionBy("form_month", "permno")
    x = window.withColumns({"x": F.col("r") - F.avg("r").over(own), "s": F.stddev_samp("r").over(own)}).join(shrunk, "form_month")
    at = x.join(weights, ["form_month", "permno"])
    p = at.groupBy(*keys, "month").agg(F.sum(F.col("x") * F.col("weight")).alias("p"))
    total = at.groupBy(*keys, "permno").agg(F.first(F.col("s") * F.col("weight")).alias("sw1")).groupBy(*keys).agg(F.sum("sw1").alias("total"))
    both = at.join(p, [*keys, "month"]).groupBy(*keys, "permno").agg(
        F.sum(F.col("x") * F.col("p")).alias("xp"), F.first("s").alias("s"), F.first("weight").alias("weight"), F.first("n_months").alias("t"), F.first("delta").alias("d"), F.first("rho").alias("rho")
    )
    s, d, rho = F.col("s"), F.col("d"), F.col("rho")
    value = (1 - d) * F.col("xp") / (F.col("t") - 1) + d * (rho * s * F.col("total") + (1 - rho) * s * s * F.col("weight"))
    return both.join(total, list(keys)).select(*keys, "permno", "weight", value.alias("sw"))


def _t_tail(t: float, df: float) -> float:
    """Two-sided p-value of Student's t, by the incomplete beta function's continued fraction."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))

    def fraction(a, b, x):
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d or 1e-300)
        h = d
        for m in range(1, 300):
            for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + step * d or 1e-300)
                c = 1 + step / c or 1e-300
                h *= d * c
        return h

    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) else _t_tail(a, b) for a, b in zip(t, df, strict=True)], dtype="float64")


def market_regression(df: DataFrame, y: str = "excess", x: str = "mkt_rf", group: str = "model", least: int = 12) -> DataFrame:
    """group, n, alpha, beta, alpha_t, alpha_p, r2 of y on x; the figures are NULL below `least` rows."""
    s = df.filter(F.col(y).isNotNull() & F.col(x).isNotNull()).groupBy(group).agg(
        F.count("*").alias("n"), F.regr_slope(y, x).alias("beta"), F.regr_intercept(y, x).alias("alpha"), F.regr_r2(y, x).alias("r2"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.avg(x).alias("mx")
    )
    sigma2 = F.try_divide(F.col("syy") - F.col("beta") * F.col("beta") * F.col("sxx"), F.col("n") - 2)
    t = F.try_divide(F.col("alpha"), F.sqrt(sigma2 * (1 / F.col("n") + F.try_divide(F.col("mx") * F.col("mx"), F.col("sxx")))))
    enough = lambda e: F.when(F.col("n") >= least, e)
    out = s.withColumn("alpha_t", enough(t))
    return out.select(group, "n", enough(F.col("alpha")).alias("alpha"), enough(F.col("beta")).alias("beta"), "alpha_t", t_p_value("alpha_t", F.col("n") - 2).alias("alpha_p"), enough(F.col("r2")).alias("r2"))
