"""Estimators, learned models and capped portfolios against NumPy on small frames."""

import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tessera.operators import estimators as e
from tessera.operators import evaluate as v
from tessera.operators import learn as m
from tessera.operators import moments as mo
from tessera.operators import portfolio as b
from tessera.plans import catalog, models

K, Q = len(e.FACTORS), len(e.MACROS)


def month(n):
    return dt.date(1990 + n // 12, n % 12 + 1, 1)


def series(spark, names, values):
    return spark.createDataFrame([(month(k), *map(float, row)) for k, row in enumerate(values)], "month date, " + ", ".join(f"{n} double" for n in names))


@pytest.fixture(scope="module")
def states():
    """Macro states of a stable autoregression without noise, and factors that are priced on the state of the month."""
    r = np.random.RandomState(4)
    q, _ = np.linalg.qr(r.normal(size=(Q, Q)))
    a = 0.97 * q  # a turning map keeps all states excited
    c, p, level = r.normal(size=Q), r.normal(size=(K, Q)), r.normal(size=K)
    x = [r.normal(size=Q) * 3]
    for _ in range(59):
        x.append(a @ x[-1] + c)
    x = np.array(x)
    return a, c, p, level, x, x @ p.T + level


def test_var_premia_of_an_exact_system(spark, states):
    a, c, p, level, x, f = states
    windows = e.conditioning_windows(series(spark, e.FACTORS, f), series(spark, e.MACROS, x), spark.createDataFrame([(month(59),)], "form_month date"), 60)
    got = e.var_premia(windows, tau=3).first()
    assert got.var_ok and got.pricing_ok and not got.fallback and got.radius == pytest.approx(0.97, abs=1e-6)
    assert np.allclose(np.reshape(got.a, (Q, Q)), a, atol=1e-6) and np.allclose(np.reshape(got.p, (K, Q)), p, atol=1e-6)
    ahead, now = np.zeros(Q), x[-1]
    for _ in range(3):
        now = c + a @ now
        ahead += now / 3
    assert np.allclose(got.premia, level + p @ ahead, atol=1e-6)
    few = e.var_premia(windows.filter(F.col("month") > month(40)), tau=3).first()
    assert few.fallback and not few.var_ok and np.allclose(few.premia, f[41:].mean(axis=0))


def test_ridge_premia_against_normal_equations(spark, states):
    _, _, _, _, x, f = states
    noisy = f + np.random.RandomState(5).normal(size=f.shape)
    windows = e.conditioning_windows(series(spark, e.FACTORS, noisy), series(spark, e.MACROS, x), spark.createDataFrame([(month(59),)], "form_month date"), 60)
    got = e.ridge_premia(windows, least=40).first()
    lag, y = x[:-1], noisy[1:]
    z, now = (lag - lag.mean(0)) / lag.std(0), (x[-1] - lag.mean(0)) / lag.std(0)

    def predict(xs, ys, alpha, at):  # by an augmented least-squares problem
        mean = xs.mean(0)
        beta = np.linalg.lstsq(np.vstack([xs - mean, np.sqrt(alpha) * np.eye(Q)]), np.concatenate([ys - ys.mean(), np.zeros(Q)]), rcond=None)[0]
        return (at - mean) @ beta + ys.mean()

    n, part = len(z), len(z) // 6
    for k in range(K):
        loss = {al: np.mean([np.mean((y[s : s + part, k] - predict(z[:s], y[:s, k], al, z[s : s + part])) ** 2) for s in range(n - 5 * part, n, part)]) for al in (0.01, 0.1, 1.0, 10.0, 100.0)}
        best = min(loss, key=loss.get)
        assert got.alphas[k] == best and got.premia[k] == pytest.approx(predict(z, y[:, k], best, now), rel=1e-6)


def test_pair_covariances(spark):
    r = np.random.RandomState(6)
    beta, own = r.normal(size=(4, K)), r.uniform(0.5, 1, 4)
    betas = spark.createDataFrame([(month(59), i, [0.0, *map(float, beta[i])], float(own[i])) for i in range(4)], "month date, permno long, betas array<double>, idio_var double")
    f = r.normal(size=(60, K))
    sigma = np.cov(f[-36:].T)
    got = {(x.i, x.j): x.cov for x in e.factor_covariance(betas, series(spark, e.FACTORS, f), 36).collect()}
    full = beta @ sigma @ beta.T + np.diag(own)
    assert got == pytest.approx({(i, j): full[i, j] for i in range(4) for j in range(i, 4)})
    a, om, p, ga = r.normal(size=(Q, Q)) * 0.3, np.eye(Q), r.normal(size=(K, Q)), np.eye(K) * 0.1
    fits = spark.createDataFrame([(month(59), True, True, *(m_.ravel().tolist() for m_ in (a, om, p, ga)))], "form_month date, var_ok boolean, pricing_ok boolean, a array<double>, omega array<double>, p array<double>, gamma array<double>")
    state = om + (np.eye(Q) + a) @ om @ (np.eye(Q) + a).T
    full = beta @ (p @ state @ p.T + 2 * ga) @ beta.T + 2 * np.diag(own)
    got = {(x.i, x.j): x.cov for x in e.conditional_covariance(betas, fits, 2).collect()}
    assert got == pytest.approx({(i, j): full[i, j] for i in range(4) for j in range(i, 4)})


@pytest.mark.parametrize(("t", "df", "p"), [(12.7062047, 1, 0.05), (2.2281389, 10, 0.05), (2.0422725, 30, 0.05), (3.1692727, 10, 0.01), (0.0, 7, 1.0), (1.9599640, 10**6, 0.05)])
def test_t_tails(t, df, p):
    """Values of the printed tables of Student's t."""
    assert e._t_tail(t, df) == pytest.approx(p, abs=1e-6)


def test_summary_table(spark):
    r = np.random.RandomState(8)
    x, y = r.normal(size=40) * 0.05, {}
    rows = []
    for name in ("p", "q"):
        y[name] = 0.01 + 0.8 * x + r.normal(size=40) * 0.02
        rows += [(name, month(k), month(k + 1), float(y[name][k] + 0.003), 0.1, 0.001, float(y[name][k] + 0.002)) for k in range(40)]
    log = spark.createDataFrame(rows, "model string, form_month date, ret_month date, gross_return double, turnover double, cost double, net_return double")
    market = spark.createDataFrame([(month(k + 1), float(x[k]), 0.002) for k in range(40)], "month date, mkt_rf double, rf double")
    got = {z.metric: z for z in v.summary_table(log, market, ["p", "q"]).collect()}
    for name in ("p", "q"):
        beta, alpha = np.polyfit(x, y[name], 1)
        assert got["beta"][name] == pytest.approx(beta) and got["alpha"][name] == pytest.approx(12 * alpha)
        assert got["net_sharpe"][name] == pytest.approx(y[name].mean() / y[name].std(ddof=1) * np.sqrt(12))
        assert 0 <= got["alpha_p"][name] <= 1


def brute_caps(target, cap):
    """Weights month by month: trades shrunk to the cap."""
    out, before = [], None
    for w in target:
        bound = False
        if before is not None and cap is not None:
            names = set(before) | set(w)
            moved = sum(abs(w.get(n, 0) - before.get(n, 0)) for n in names) / 2
            if moved > cap:
                w = {n: max(0.0, before.get(n, 0) + cap / moved * (w.get(n, 0) - before.get(n, 0))) for n in names}
                total = sum(w.values())
                w, bound = {n: x / total for n, x in w.items() if x / total >= 1e-8}, True
        out.append((w, bound))
        before = w
    return out


def test_capped_chain_and_frontier(spark):
    r = np.random.RandomState(9)
    target = []
    for _ in range(14):
        names = sorted(r.choice(8, 5, replace=False).tolist())
        target.append(dict(zip(names, r.dirichlet(np.ones(5)), strict=True)))
    ret = r.normal(size=(16, 8)) * 0.05
    weights = spark.createDataFrame([("m", month(k), n, float(x)) for k, w in enumerate(target) for n, x in w.items()], "model string, form_month date, permno long, weight double")
    stock = spark.createDataFrame([(n, month(k), float(ret[k, n])) for k in range(16) for n in range(8)], "permno long, month date, ret_adjusted double")
    caps = b.cap_table(spark, [None, 0.05, 0.3])
    got = {(x.cap_label, x.form_month, x.permno): (x.weight, x.at_cap) for x in b.capped_weights(weights, caps).collect()}
    rows = {x.cap_label: x for x in b.frontier(weights, stock, caps).collect()}
    for label, cap in (("none", None), ("5%", 0.05), ("30%", 0.3)):
        chain = brute_caps(target, cap)
        expected = {(label, month(k), n): x for k, (w, _) in enumerate(chain) for n, x in w.items()}
        assert {k: x for k, (x, _) in got.items() if k[0] == label} == pytest.approx(expected)
        assert rows[label].pct_months_at_cap == pytest.approx(100 * np.mean([bound for _, bound in chain]))
        moved = [sum(abs(u.get(n, 0) - w.get(n, 0)) for n in range(8)) / 2 for (w, _), (u, _) in itertools.pairwise(chain)]
        gross = np.array([sum(x * ret[k + 1, n] for n, x in w.items()) / sum(w.values()) for k, (w, _) in enumerate(chain)])
        net = gross - 0.001 * np.array([1.0, *moved])
        assert rows[label].net_sharpe == pytest.approx(net.mean() / net.std(ddof=1) * np.sqrt(12)) and rows[label].avg_turnover == pytest.approx(np.mean(moved))
    assert rows["5%"].pct_months_at_cap >= rows["30%"].pct_months_at_cap > 0 == rows["none"].pct_months_at_cap


# --- learned models ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def sample(spark):
    r = np.random.RandomState(10)
    x = r.normal(size=(200, 6)) @ r.normal(size=(6, 6)) + r.normal(size=6)
    y = x @ np.array([0.5, -0.3, 0, 0, 0.2, 0]) + 0.3 + r.normal(size=200) * 0.5
    rows = [(k, month(k // 20), float(y[k]), x[k].tolist()) for k in range(200)]
    df = spark.createDataFrame(rows, "permno long, month date, y double, x array<double>").select("permno", "month", "y", array_to_vector("x").alias("features")).cache()
    return df, x, y


def test_features_by_hand(spark):
    r = np.random.RandomState(11)
    rows = [(k, month(k % 3), 1000 + 100 * (k % 2), float(r.normal()) if k % 5 else None, None, float(k % 3)) for k in range(30)]
    df = spark.createDataFrame(rows, "permno long, month date, siccd int, a double, empty double, z double")
    built = m.FeatureBuilder(("a", "empty"), ("z",)).fit(df)
    assert built.kept == ["a"] and built.names == ["a*1", "a*z", "industry=10", "industry=11"]
    got = {x.permno: x.f for x in built.transform(df).select("permno", vector_to_array("features").alias("f")).collect()}
    mid = {s: np.median([x[3] for x in rows if x[2] == s and x[3] is not None]) for s in (1000, 1100)}
    filled = {x[0]: x[3] if x[3] is not None else mid[x[2]] for x in rows}
    z = np.array([0.0, 1.0, 2.0])
    for k, when, sic, _, _, state in rows:
        mates = [filled[x[0]] for x in rows if x[1] == when]
        rank = np.mean([i + 1 for i, u in enumerate(sorted(mates)) if u == filled[k]])
        unit = 2 * rank / (len(mates) + 1) - 1
        assert got[k] == pytest.approx([unit, unit * (state - z.mean()) / z.std(ddof=1), float(sic == 1000), float(sic == 1100)])
    unseen = built.transform(spark.createDataFrame([(99, month(0), 7700, 1.0, None, None)], df.schema)).select(vector_to_array("features").alias("f")).first().f
    assert unseen == [0.0, 0.0, 0.0, 0.0]


def test_projection_is_the_svd(sample):
    df, x, _ = sample
    got = np.array([r.c for r in m.Projection(3).fit(df).transform(df).orderBy("permno").select(vector_to_array("components").alias("c")).collect()])
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    _, _, vt = np.linalg.svd(z, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(z @ vt[:3].T), atol=1e-8)


def test_elastic_net_is_optimal(sample):
    df, x, y = sample
    sd = x.std(0, ddof=1)
    z, centred = (x - x.mean(0)) / sd, y - y.mean()
    for alpha, l1 in ((0.05, 0.5), (0.2, 0.9), (0.01, 0.2)):
        fit = m.elastic_net(df, alpha, l1, float(y.std(ddof=1)), "features")
        w = fit.coefficients.toArray() * sd
        slope = z.T @ (centred - z @ w) / len(y) - alpha * (1 - l1) * w
        on = np.abs(w) > 1e-7
        assert np.allclose(slope[on], alpha * l1 * np.sign(w[on]), atol=1e-3) and (np.abs(slope[~on]) <= alpha * l1 + 1e-3).all(), (alpha, l1)
    ridge = m.elastic_net(df, 3.0, 0.0, float(y.std(ddof=1)), "features", rows=200)
    assert np.allclose(ridge.coefficients.toArray() * sd, np.linalg.solve(z.T @ z / 200 + 3.0 / 200 * np.eye(6), z.T @ centred / 200), atol=1e-3)


def test_surface_picks_the_best_cell(sample):
    df, _, _ = sample
    tune, validation = df.filter("permno < 120"), df.filter("permno >= 120")
    got = {(r.alpha, r.l1): r for r in m.elastic_net_surface(tune, validation, (1e-3, 0.3), (0.0, 0.5), "features").collect()}
    assert len(got) == 4 and sum(r.best for r in got.values()) == 1
    top = max(got.values(), key=lambda r: r.r2)
    assert top.best and top.alpha_at_edge and top.l1_at_edge
    ys = np.array([r.y for r in validation.orderBy("permno").collect()])
    fit = m.elastic_net(tune, 0.3, 0.5, float(np.std([r.y for r in tune.collect()])), "features", rows=120)
    p = np.array([r.prediction for r in fit.transform(validation).orderBy("permno").collect()])
    assert got[0.3, 0.5].r2 == pytest.approx(1 - ((ys - p) ** 2).sum() / (ys**2).sum(), abs=1e-6)


def test_grid_costs_two_passes(sample, spark):
    """All 100 cells equal a NumPy fit of their own, and take as many jobs as four cells."""
    df, x, y = sample
    tune, validation = df.filter("permno < 120").cache(), df.filter("permno >= 120").cache()
    jobs = []
    for name, alphas, ratios in (("few", (1e-3, 0.3), (0.0, 0.5)), ("all", m.ALPHAS, m.RATIOS)):
        spark.sparkContext.setJobGroup(name, name)
        got = {(r.alpha, r.l1): r.r2 for r in m.elastic_net_surface(tune, validation, alphas, ratios, "features").collect()}
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(got) == 100 and jobs[1] <= jobs[0]  # the first run also fills the cache
    rows = sorted(tune.collect(), key=lambda r: r.permno)
    x, y = np.array([r.features.toArray() for r in rows]), np.array([r.y for r in rows])
    other = sorted(validation.collect(), key=lambda r: r.permno)
    xv, yv = np.array([r.features.toArray() for r in other]), np.array([r.y for r in other])
    mean, sd = x.mean(0), x.std(0)
    z, c = (x - mean) / sd, y - y.mean()
    for (alpha, l1), r2 in got.items():
        if l1 < 0.05:
            w = np.linalg.solve(z.T @ z / len(y) + alpha / len(y) * np.eye(z.shape[1]), z.T @ c / len(y))
        else:
            w, rate = np.zeros(z.shape[1]), 1 / (np.linalg.eigvalsh(z.T @ z / len(y))[-1] + alpha * (1 - l1))
            for _ in range(4000):  # proximal gradient
                step = w + rate * (z.T @ (c - z @ w) / len(y) - alpha * (1 - l1) * w)
                w = np.sign(step) * np.maximum(np.abs(step) - rate * alpha * l1, 0)
        p = y.mean() + (xv - mean) / sd @ w
        assert r2 == pytest.approx(1 - ((yv - p) ** 2).sum() / (yv**2).sum(), abs=1e-8), (alpha, l1)


def test_moments_merge_exactly():
    r = np.random.RandomState(2)
    x = r.randn(1000, 4) * [1, 1e-3, 5, 1] + [1e6, 3, -1e4, 0]
    parts = [mo.Moments.of(p) for p in np.array_split(x, [10, 11, 11, 400])]
    total = parts[3] + parts[0] + (parts[4] + parts[2]) + parts[1]
    assert total.n == 1000 and np.allclose(total.products / 999, np.cov(x.T), rtol=1e-9, atol=1e-12)


def test_huber_is_optimal(sample):
    df, x, y = sample
    alpha, l1, eps = 0.05, 0.5, 0.4
    (fits, passes) = mo.huber_paths(df, alpha, l1, (eps, 0.9, 5.0))
    assert passes <= 20
    w, level = fits[eps]
    assert np.allclose(np.append(w, level), np.append(*m.huber_elastic_net(df, alpha, l1, eps, "features")), atol=1e-7)
    pull = np.clip(y - x @ w - level, -eps, eps)
    slope = x.T @ pull / len(y) - alpha * (1 - l1) * w
    on = np.abs(w) > 1e-6
    assert abs(pull.mean()) < 1e-7 and np.allclose(slope[on], alpha * l1 * np.sign(w[on]), atol=1e-7) and (np.abs(slope[~on]) <= alpha * l1 + 1e-7).all()
    picked = m.choose_epsilon(df.filter("permno < 120"), df.filter("permno >= 120"), alpha, l1, (0.4, 5.0), features="features").collect()
    assert sum(r.best for r in picked) == 1 and max(picked, key=lambda r: r.r2).best


def test_importance_and_forecasts(sample, spark):
    df, x, y = sample
    fit = m.elastic_net(df, 1e-3, 0.5, 1.0, "features")
    w, p = fit.coefficients.toArray(), fit.transform(df).select("permno", "month", "y", "features", "prediction").cache()
    got = {r.name: r.drop for r in m.zero_out_importance(p, w.tolist(), [f"f{i}" for i in range(6)], top=3).collect()}
    full = x @ w + fit.intercept
    r2 = lambda q: 1 - ((y - q) ** 2).sum() / (y**2).sum()
    kept = sorted(range(6), key=lambda i: -abs(w[i]))[:3]
    assert got == pytest.approx({f"f{i}": r2(full) - r2(full - w[i] * x[:, i]) for i in kept})
    table = {r.permno: r for r in m.forecast_table(p, 0.1).collect()}
    for t in range(10):
        raw = full[20 * t : 20 * t + 20]
        lo, hi = np.quantile(raw, [0.1, 0.9])
        assert [table[20 * t + i].expected_ret for i in range(20)] == pytest.approx(np.clip(raw, lo, hi).tolist())


def test_forest_of_steps(spark):
    r = np.random.RandomState(12)
    x = r.uniform(size=(400, 3))
    y = np.where(x[:, 1] > 0.5, 2.0, -1.0)
    df = spark.createDataFrame([(month(k // 100), float(y[k]), x[k].tolist()) for k in range(400)], "month date, y double, x array<double>").select("month", "y", array_to_vector("x").alias("features"))
    model = m.forest(df, 5, 3, "all", 5, 1.0)
    p = [(z.y, z.prediction) for z in model.transform(df).collect()]
    assert np.mean([abs(u - q) < 0.2 for u, q in p]) > 0.95
    importance, shape = m.forest_report(model, ["a", "b", "c"], spark, 0.9, 0.8, max_depth=3)
    assert {z.name: round(z.importance, 1) for z in importance.collect()}["b"] == 1.0
    row = shape.first()
    assert 1 <= row.min_depth <= row.mean_depth <= row.max_depth <= 3 and row.overfit
    grid = m.forest_surface(df, df, (2, 5), (1, 2), ("all",), 5, least_leaf=5).collect()
    assert len(grid) == 4 and [z for z in grid if z.best][0].r2 == max(z.r2 for z in grid)
    assert m.forest(df, 2, 2, "all", 5, last_rows=150).numFeatures == 3


def test_expanding_forecasts(spark):
    r = np.random.RandomState(13)
    rows = []
    for k in range(96):
        for i in range(12):
            s = float(r.normal())
            rows.append((i, month(k), 1000, 0.5 * s + float(r.normal()) * 0.2, s))
    panel = spark.createDataFrame(rows, "permno long, month date, siccd int, y double, s double")
    forecasts, surfaces, chosen = m.expanding_forecasts(panel, lambda: m.FeatureBuilder(("s",)), m.splits(1996, 1997, 1990, 2), (1e-3, 1.0), (0.5,), 5)
    got = {z.reest_year: z for z in chosen.collect()}
    assert set(got) == {1996, 1997} and got[1997].n_train == 7 * 144 and got[1996].n_train == 6 * 144 and got[1996].train_to == 1995
    assert all(z.alpha == 1e-3 and z.validation_r2 > 0.5 for z in got.values())
    assert surfaces.count() == 4 and forecasts.select(F.year("month")).distinct().count() == 2
    both = forecasts.join(panel, ["permno", "month"])
    assert both.stat.corr("raw_ret", "y") > 0.8


def test_expanding_forecasts_make_features_once(spark, monkeypatch):
    """One table of features a window, and the forecasts of scaler, components and grid fitted on the rows one after another."""
    r = np.random.RandomState(14)
    rows = [(i, month(k), (1000, 2000, 3000)[i % 3], *map(float, r.normal(size=3))) for k in range(72) for i in range(15)]
    rows = [(*x[:3], None if n % 50 == 0 else 0.4 * x[3] + 0.1 * x[4], *x[3:5]) for n, x in enumerate(rows)]
    panel = spark.createDataFrame(rows, "permno long, month date, siccd int, y double, s double, t double").cache()
    builder, made = (lambda: m.FeatureBuilder(("s", "t"))), []
    plain = m.FeatureBuilder.transform

    def counted(self, df):
        times = spark.sparkContext.accumulator(0)
        made.append(times)

        def look(batches):
            times.add(1)
            yield from batches

        return plain(self, df.repartition(1).mapInArrow(look, df.schema))

    monkeypatch.setattr(m.FeatureBuilder, "transform", counted)
    plan, k = m.splits(1995, 1995, 1990, 2), 3
    forecasts, surfaces, chosen = m.expanding_forecasts(panel, builder, plan, (1e-3, 1.0), (0.0, 0.5), k)
    assert [x.value for x in made] == [1, 1, 1, 0]  # tuning, validation, training; the test waits for its reader
    monkeypatch.setattr(m.FeatureBuilder, "transform", plain)
    tune, validation, train, test = (m.between(panel, plan[0][x]) for x in ("tune", "validation", "train", "test"))
    fitted = builder().fit(tune)
    projection = m.Projection(k).fit(fitted.transform(tune))
    expected = m.elastic_net_surface(*(projection.transform(fitted.transform(x)) for x in (tune, validation)), (1e-3, 1.0), (0.0, 0.5))
    assert [x.r2 for x in surfaces.collect()] == pytest.approx([x.r2 for x in expected.collect()], abs=1e-9)
    best, row = expected.filter("best").first(), chosen.first()
    assert (row.alpha, row.l1, row.n_components) == (best.alpha, best.l1, k)
    fitted = builder().fit(train)
    projection = m.Projection(k).fit(fitted.transform(train))
    known = mo.moments(mo.with_target(projection.transform(fitted.transform(train)), "components"))
    weights, level = mo.elastic_net_path(known, (best.alpha,), (best.l1,))[best.alpha, best.l1]
    other = {(x.permno, x.month): x.prediction for x in m.predict_linear(projection.transform(fitted.transform(test)), weights, level).collect()}
    got = {(x.permno, x.month): x.raw_ret for x in forecasts.collect()}
    assert row.n_train == known.n and got == pytest.approx(other, abs=1e-9) and len(got) == 12 * 15
    panel.unpersist()


def test_forest_surface_sends_histograms_of_few_tasks(spark, monkeypatch):
    """The rows are dealt to two tasks a core, however many partitions they come in."""
    r = np.random.RandomState(15)
    df = spark.createDataFrame([(float(v[0] > 0.5), v.tolist()) for v in r.uniform(size=(300, 2))], "y double, x array<double>").repartition(90).select("y", array_to_vector("x").alias("features"))
    seen, plain = [], m.forest
    monkeypatch.setattr(m, "forest", lambda train, *args, **options: seen.append((train.rdd.getNumPartitions(), train.count())) or plain(train, *args, **options))
    grid = m.forest_surface(df, df, (2,), (1,), ("all",), 2, least_leaf=5).collect()
    assert len(grid) == 1 and grid[0].r2 > 0.5
    assert seen == [(2 * spark.sparkContext.defaultParallelism, 300)]


def test_forest_surface_grows_all_trees_of_a_cell(spark, monkeypatch):
    """Every number of trees is scored by a forest of that size, the first trees of the largest."""
    r = np.random.RandomState(16)
    df = spark.createDataFrame([(float(v[0] > 0.5) + 0.1 * float(v[2]), v.tolist()) for v in r.uniform(size=(300, 3))], "y double, x array<double>").select("y", array_to_vector("x").alias("features"))
    made, plain = [], m.forest
    monkeypatch.setattr(m, "forest", lambda *args, **options: made.append(plain(*args, **options)) or made[-1])
    monkeypatch.setattr(m, "TREES_AT_ONCE", 3, raising=False)
    got = {x.trees: x.r2 for x in m.forest_surface(df, df, (2, 5, 9), (2,), ("onethird",), least_leaf=5).collect()}
    assert [x.getNumTrees for x in made] == [2, 1, 2, 1, 3]
    assert len({t.toDebugString for x in made for t in x.trees}) > 5  # parts differ
    y = np.array([x.y for x in df.collect()])
    p = np.array([[t.predict(x.features) for f in made for t in f.trees] for x in df.collect()])
    for n in (2, 5, 9):
        assert got[n] == pytest.approx(1 - ((y - p[:, :n].mean(axis=1)) ** 2).sum() / (y**2).sum(), abs=1e-9)
    # the registered query tunes with all the trees of its grid
    seen = []
    monkeypatch.setattr(m, "forest_surface", lambda *args, **options: seen.append((args, options)) or df.select("y"))
    monkeypatch.setattr(models, "halves", lambda t: (None, df, df))
    catalog.queries()["m13_forest_surface"](spark, None)
    assert len(seen[0][0]) == 2 and seen[0][1] == {"least_leaf": 200}


def test_target_of_a_later_row(spark):
    df = spark.createDataFrame([(1, month(k), 1000, 0.1 * k, 0.01) for k in range(4)], "permno long, month date, siccd int, ret_adjusted double, rf double")
    got = [x.y for x in m.with_target(df, target_lead=1).orderBy("month").collect()]
    assert got == pytest.approx([0.09, 0.19, 0.29])
    two = df.unionByName(df.withColumn("permno", F.lit(2)).withColumn("ret_adjusted", F.col("ret_adjusted") + 1))
    assert sorted({round(x.y, 9) for x in m.with_target(two, industry_demean=True).collect()}) == [-0.5, 0.5]


def test_sliding_moments_of_any_window():
    """Equal to least squares over each window, with nearly collinear columns, a large level, gaps and months that repeat."""
    r = np.random.RandomState(0)
    index = np.sort(r.choice(400, 300))
    z = r.randn(300, 4) + [1e5, 0, 3, 50]
    z[:, 1] = z[:, 2] + 1e-3 * r.randn(300)
    for months in (1, 36, 1000):
        total, mean, products = e.sliding_moments(index, z, months)
        good, beta, sse, _ = e.least_squares(total, mean, products, 24)
        for k in range(300):
            seen = z[(index > index[k] - months) & (index <= index[k])]
            assert total[k] == len(seen) and np.allclose(mean[k], seen.mean(0), rtol=1e-12)
            assert good[k] == (len(seen) >= 24)
            if good[k]:
                x = seen[:, :3] - seen[:, :3].mean(0)
                w = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), seen[:, 3], rcond=None)[0][1:]
                assert np.allclose(beta[k, 1:], w, rtol=1e-8, atol=1e-8 * np.abs(w).max())
                assert np.isclose(sse[k], ((seen[:, 3] - seen[:, 3].mean() - x @ w) ** 2).sum(), rtol=1e-8)
    assert not e.least_squares(*e.sliding_moments(index, z[:, [0, 0, 1]], 36), 24)[0].any()  # one column twice


def test_betas_with_gaps(spark):
    """Rows without a value take the window of those before, rows without an entity or enough rows have no betas."""
    r = np.random.RandomState(3)
    months = [dt.date(2000 + k // 12, k % 12 + 1, 1) for k in range(30)]
    f = r.randn(30, 2)
    y = 0.5 + f @ [1.5, -2.0] + 0.1 * r.randn(30)
    rows = [(1, d, None if k in (4, 20, 29) else float(y[k])) for k, d in enumerate(months) if k != 11] + [(None, months[0], 1.0), (2, months[0], 1.0)]
    factors = spark.createDataFrame([(d, *map(float, x)) for d, x in zip(months, f, strict=True)], "month date, a double, b double")
    got = {(x.permno, x.month): x for x in e.rolling_betas(spark.createDataFrame(rows, "permno long, month date, excess double"), factors, 24, 10, ("a", "b")).collect()}
    assert len(got) == 31 and got[None, months[0]].betas is None and got[2, months[0]].n_obs == 1 and got[2, months[0]].idio_var is None
    for k in (9, 15, 20, 29):
        seen = [i for i in range(max(0, k - 23), k + 1) if i not in (4, 11, 20, 29)]
        x = np.column_stack([np.ones(len(seen)), f[seen]])
        row = got[1, months[k]]
        assert row.n_obs == len(seen) and (row.betas is None) == (len(seen) < 10)
        if row.betas:
            assert np.allclose(row.betas, np.linalg.lstsq(x, y[seen], rcond=None)[0], atol=1e-10)


def test_pairs_of_many_entities(spark):
    """500 entities: every pair of every block."""
    r = np.random.RandomState(4)
    b, own, f = r.randn(500, 5), r.rand(500), r.randn(40, 5)
    months = [dt.date(2000 + k // 12, k % 12 + 1, 1) for k in range(40)]
    betas = spark.createDataFrame([(i, months[-1], [0.0, *map(float, x)], float(s)) for i, (x, s) in enumerate(zip(b, own, strict=True))], "permno long, month date, betas array<double>, idio_var double")
    factors = spark.createDataFrame([(d, *map(float, x)) for d, x in zip(months, f, strict=True)], "month date, mkt_rf double, smb double, hml double, rmw double, cma double")
    got = e.factor_covariance(betas, factors, 40).toPandas()
    expected = b @ np.cov(f.T) @ b.T + np.diag(own)
    assert len(got) == 500 * 501 // 2 and np.allclose(got["cov"], expected[got["i"], got["j"]], atol=1e-10)
