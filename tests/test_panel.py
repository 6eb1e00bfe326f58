"""Rules of the panel operators on hand-made frames, and properties of what SQL cannot express."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tessera.functions import columns as c
from tessera.operators import aggregates as a
from tessera.operators import estimators as e
from tessera.operators import joins as j
from tessera.operators import portfolio as b
from tessera.operators import windows as w
from tessera.plans import catalog
from tessera.sources import readers

SF = "/root/testdata/sf0.001"


def month(n):
    return dt.date(2000 + n // 12, n % 12 + 1, 1)


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(1, month(k), float(k) if k != 3 else None) for k in range(8) if k != 5] + [(2, month(k), 1.0) for k in range(3)]
    return spark.createDataFrame(rows, "permno long, month date, x double")


def values(df, x, permno=1):
    return [r[x] for r in df.filter(F.col("permno") == permno).orderBy("month").collect()]


def test_rolling_counts_rows_or_months(panel):
    rows = panel.withColumns({"r": w.rolling(F.sum, "x", 3, 2), "m": w.rolling(F.sum, "x", 3, 2, calendar=True)})
    assert values(rows, "r") == [None, 1.0, 3.0, 3.0, 6.0, 10.0, 17.0]
    assert values(rows, "m") == [None, 1.0, 3.0, 3.0, 6.0, 10.0, 13.0]


def test_ranks_share_ties_and_keep_nulls(spark):
    df = spark.createDataFrame([(k, month(0), v) for k, v in enumerate((3.0, 1.0, 1.0, None, 9.0))] + [(9, month(1), 5.0)], "permno long, month date, v double")
    got = {(r.permno, r.month): r.v for r in w.rank_to_unit(df, ["v"]).collect()}
    assert got[3, month(0)] is None and got[9, month(1)] == 0 and got[1, month(0)] == got[2, month(0)] == pytest.approx(-0.4) and got[4, month(0)] == pytest.approx(0.6)


def test_currency_and_zero_division(spark):
    df = spark.createDataFrame([("CAD", 1.0, 0.0), (None, 1.0, 2.0), ("USD", 0.0, 0.0)], "curcd string, x double, y double")
    kept = df.filter(c.not_currency("curcd")).select(c.ratio("x", "y").alias("r")).collect()
    assert sorted((r.r for r in kept), key=str) == [0.5, None]


def test_asof_interval_edges(spark):
    left = spark.createDataFrame([(1, month(k)) for k in range(5)] + [(2, month(0))], "permno long, month date")
    right = spark.createDataFrame([(1, month(1), 1, "a"), (1, month(1), 2, "b"), (1, month(3), 1, "c")], "permno long, available date, n int, v string")
    assert values(j.asof_backward(left, right, order="n"), "v") == [None, "b", "b", "c", "c"]
    assert values(j.asof_backward(left, right, order="n", max_age=20), "v") == [None, "b", None, "c", None]


def test_link_validity(spark):
    figures = spark.createDataFrame([("g", month(6)), ("g", month(30))], "gvkey string, available date")
    links = spark.createDataFrame([("g", 1, month(0), month(12), "P"), ("g", 2, month(13), None, "C"), ("g", 3, month(0), None, "N")], "gvkey string, lpermno long, linkdt date, linkenddt date, linkprim string")
    assert sorted((r.available, r.permno) for r in j.link_join(figures, links).collect()) == [(month(6), 1), (month(30), 2)]


def test_doubled_columns_and_keys_fail(panel):
    with pytest.raises(ValueError, match="both sides"):
        j.with_series(panel, panel.select("month", "x"))
    with pytest.raises(Exception, match="occurs 2 times"):
        a.assert_unique(panel.unionByName(panel.limit(1)), ["permno", "month"]).collect()
    with pytest.raises(Exception, match="training data reach"):
        a.assert_before(panel, panel).collect()


def test_quantile_of_one_and_top_k_ties(spark):
    df = spark.createDataFrame([(1, 2000, 5.0), (3, 2001, 7.0), (2, 2001, 7.0), (4, 2001, None)], "permno long, year int, v double")
    assert {r.year: r.threshold for r in a.group_quantile(df, "v", 0.35, "year").collect()} == {2000: 5.0, 2001: 7.0}
    assert [r.permno for r in w.top_k(df, "v", 1, "year").orderBy("year").collect()] == [1, 2]


def test_spans_and_dense_columns(spark):
    df = spark.createDataFrame([(month(k), f, None) for k, f in enumerate((0, 0, 1, 1, 0))], "month date, f int, empty double")
    assert [(r.state, r.first, r.last, r.n) for r in w.spans(df, "f").orderBy("first").collect()] == [(0, month(0), month(1), 2), (1, month(2), month(3), 2), (0, month(4), month(4), 1)]
    assert a.dense_columns(df, ["f", "empty"], 0.7) == ["f"]


def test_text_sources(spark, tmp_path):
    (tmp_path / "f.csv").write_text("made up preamble\n\n,Mkt,SMB\n200001,1.0,2.0\n200002,x,-99.0\n2000,12.0,1.0\nfooter\n")
    got = readers.read_factors(spark, str(tmp_path / "f.csv"), ("mkt_rf", "smb")).orderBy("month").collect()
    assert [(r.month, r.mkt_rf, r.smb) for r in got] == [(month(0), 0.01, 0.02), (month(1), None, -0.99)]
    (tmp_path / "s.csv").write_text(" PERMNO ,Date,Ret\n1,2000-01-31,0.5\n2,bad,C\n")
    df = readers.read_csv(spark, str(tmp_path / "s.csv"), numbers=("ret", "vol"), dates=("date",))
    assert df.columns == ["permno", "date", "ret", "vol"] and [(r.ret, r.date is None) for r in df.collect()] == [(0.5, False), (None, True)]
    assert readers.date_column(df) is not None
    with pytest.raises(ValueError, match="date columns"):
        readers.date_column(df.drop("date"))
    (tmp_path / "r.csv").write_text("observation_date,USREC\n2000-01-01,1\n")
    assert readers.read_recession(spark, str(tmp_path / "r.csv")).collect() == [(month(0), 1)]
    readers.write_table(df.withColumn("year", F.lit(2000)), str(tmp_path / "t"), "year")
    readers.write_report(df, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2


def test_turnover_and_caps(spark):
    rows = [("m", month(0), 1, 1.0), ("m", month(2), 1, 0.5), ("m", month(2), 2, 0.5), ("m", month(3), 2, 1.0)]
    weights = spark.createDataFrame(rows, "model string, form_month date, permno long, weight double")
    assert [r.turnover for r in b.turnover(weights).orderBy("form_month").collect()] == [1.0, 0.5, 0.5]
    capped = b.capped_weights(weights, b.cap_table(spark, [None, 0.2]))
    got = {(r.cap_label, r.form_month, r.permno): round(r.weight, 9) for r in capped.collect()}
    assert got["none", month(3), 2] == 1.0 and got["20%", month(2), 2] == 0.2 and got["20%", month(3), 2] == 0.4
    stock = spark.createDataFrame([(1, month(1), 0.1), (2, month(3), 0.3), (1, month(3), None)], "permno long, month date, ret_adjusted double")
    log = b.backtest_log(weights, stock).orderBy("form_month").collect()
    assert [(r.form_month, round(r.gross_return, 9), round(r.cost, 9)) for r in log] == [(month(0), 0.1, 0.001), (month(2), 0.3, 0.0005)]


def test_shrinkage_products_match_the_matrix(spark):
    r = np.random.RandomState(0).normal(size=(24, 15)) * 0.05
    window = spark.createDataFrame([(month(30), month(t), int(i), float(r[t, i])) for t in range(24) for i in range(15)], "form_month date, month date, permno long, r double")
    shrunk = e.shrinkage(window)
    s = shrunk.first()
    x = r - r.mean(axis=0)
    cov, sd = np.cov(r.T), r.std(axis=0, ddof=1)
    corr = np.corrcoef(r.T)
    assert s.rho == pytest.approx((corr.sum() - 15) / (15 * 14))
    target = s.rho * np.outer(sd, sd)
    np.fill_diagonal(target, sd**2)
    sigma = (1 - s.delta) * cov + s.delta * target
    sn = x.T @ x / 24
    gap = ((sn - np.trace(sn) / 15 * np.eye(15)) ** 2).sum() / 15
    noise = sum(((np.outer(v, v) - sn) ** 2).sum() for v in x) / 24**2 / 15
    assert s.delta == pytest.approx(min(noise, gap) / gap)
    mu = np.random.RandomState(1).normal(size=15) * 0.01
    forecast = spark.createDataFrame([("m", month(30), i, float(mu[i])) for i in range(15)], "model string, form_month date, permno long, mu double")
    weights = b.mean_variance_weights(window, shrunk, forecast, cap=0.3).cache()
    got = np.array([x.weight for x in weights.orderBy("permno").collect()])
    assert got.sum() == pytest.approx(1) and got.min() >= 0 and got.max() <= 0.3 + 1e-9
    sw = [x.sw for x in e.covariance_times(window, shrunk, weights.drop("model")).orderBy("permno").collect()]
    assert np.allclose(sw, sigma @ got)
    summary = b.optimality_summary(b.optimality(window, shrunk, forecast, weights, cap=0.3)).first()
    assert summary.n_violations == 0 and summary.n_assets == 15


def test_betas_equal_least_squares(spark):
    r = np.random.RandomState(5)
    f = r.normal(size=(40, 5))
    y = 0.01 + f @ np.array([1, 0.5, -0.2, 0, 0.3]) + r.normal(size=40) * 0.1
    factors = spark.createDataFrame([(month(k), *map(float, f[k])) for k in range(40)], "month date, " + ", ".join(f"{n} double" for n in e.FACTORS))
    stock = spark.createDataFrame([(1, month(k), float(y[k])) for k in range(40) if k != 20], "permno long, month date, excess double")
    last = e.rolling_betas(stock, factors, 30, 24).orderBy(F.desc("month")).first()
    use = [k for k in range(10, 40) if k != 20]
    assert np.allclose(last.betas, np.linalg.lstsq(np.column_stack([np.ones(len(use)), f[use]]), y[use], rcond=None)[0]) and last.n_obs == 29
    assert e.rolling_betas(stock, factors, 30, 24).filter("n_obs < 24 AND betas IS NOT NULL").isEmpty()
    assert e._t_tail(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)


def test_registry(spark):
    known = __spark_entry__.queries()
    assert catalog.FLAGSHIP in known and set(__spark_entry__.oracle_sql()) <= set(known)
    assert __spark_entry__.entry(spark).columns == ["permno", "month"]
    assert catalog.queries()["r3_funnel"](spark, SF).count() > 0


def test_asof_meets_only_its_own_rows(spark):
    """Against a plain search: ties by order, rows without entity or time, an age limit, and one entity with most rows on both sides."""
    import random

    r = random.Random(6)
    day = lambda k: dt.date(2000, 1, 1) + dt.timedelta(days=k)
    who = lambda: r.choice((1, 1, 1, 1, 2, 3, None))
    left = [(who(), r.choice((None, *map(day, range(0, 3000, 7)))), k) for k in range(3000)]
    right = [(who(), r.choice((None, *map(day, range(0, 3000, 9)))), k, r.choice((None, float(k)))) for k in range(2000)]
    a = spark.createDataFrame(left, "permno long, month date, n long")
    b = spark.createDataFrame(right, "permno long, available date, fyear long, x double")
    for age in (None, 40):
        out = j.asof_backward(a, b, order="fyear", max_age=age)
        assert "CartesianProduct" not in out._jdf.queryExecution().toString() and "Join" not in out._jdf.queryExecution().executedPlan().toString()
        got = {x.n: (x.available, x.fyear, x.x) for x in out.collect()}
        assert len(got) == 3000
        for e, d, n in left:
            fit = [x for x in right if e is not None and d is not None and x[0] == e and x[1] is not None and x[1] <= d]
            best = max(fit, key=lambda x: (x[1], x[2]), default=None)
            if best is not None and age is not None and (d - best[1]).days > age:
                best = None
            assert got[n] == ((None,) * 3 if best is None else best[1:]), n


def test_quantiles_are_exact_at_any_size(spark):
    """Heavy tails, ties, NULLs and a NULL group; sketches and bands so small that ranks are bracketed, against NumPy."""
    r = np.random.RandomState(8)
    x = np.concatenate([r.standard_cauchy(20_000), np.full(9_000, 1.5), r.randint(0, 5, 3_000), [np.nan] * 50])
    g = r.choice([0, 0, 0, 1, 2], len(x))
    rows = [(None if k == 2 else int(k), None if np.isnan(v) else float(v), float(k)) for k, v in zip(g, x, strict=True)] + [(3, 7.0, None), (4, None, None)]
    df = spark.createDataFrame(rows, "g int, x double, y double").repartition(4)
    qs = (0.0, 0.01, 0.35, 0.5, 0.999, 1.0)
    for options in ({}, {"band_rows": 20, "sketch": 200}):
        got = {(k.g, k.name, k.q): (k.value, k.n) for k in a.quantiles(df, ["x", "y"], qs, "g", **options).collect()}
        for group in (0, 1, None, 3):
            for at, name in ((1, "x"), (2, "y")):
                seen = [row[at] for row in rows if row[0] == group and row[at] is not None]
                for q in qs if seen else ():
                    value, n = got[group, name, q]
                    assert n == len(seen) and value == pytest.approx(np.quantile(seen, q), rel=1e-12), (group, name, q)
        assert not any(k[0] == 4 for k in got)
        whole = {(k.name, k.q): k.value for k in a.quantiles(df, ["x"], [0.5], **options).collect()}
        assert whole["x", 0.5] == np.median(x[~np.isnan(x)].tolist() + [7.0])
    wide = {k.g: k for k in a.medians(df, ["x"], "g").collect()}
    assert wide[3].x is None and wide[4].x is None and set(wide) == {0, 1, None, 3, 4}


def test_partitioned_sink_replaces_its_own_years(spark, tmp_path):
    path = str(tmp_path / "stored")
    rows = [(k, dt.date(y, 1 + k, 1), float(y + k)) for y in (1999, 2000, 2001) for k in range(3)]
    table = spark.createDataFrame(rows, "permno long, month date, expected_ret double")
    readers.write_forecasts(table, path)
    readers.write_forecasts(table.filter("year(month) = 2000 AND permno < 2").withColumn("expected_ret", F.lit(0.5)), path)
    got = {(x.permno, x.month.year): x.mu for x in readers.read_forecasts(spark, path).collect()}
    assert got == {(k, y): float(y + k) for y in (1999, 2001) for k in range(3)} | {(0, 2000): 0.5, (1, 2000): 0.5}
    broken = table.filter("year(month) = 1999").withColumn("expected_ret", F.when(F.col("permno") == 2, F.raise_error(F.lit("broken off")).cast("double")).otherwise(F.lit(9.0)))
    with pytest.raises(Exception, match="broken off"):
        readers.write_forecasts(broken, path)
    assert {(x.permno, x.month.year): x.mu for x in readers.read_forecasts(spark, path).collect()} == got


def test_models_that_give_weights(spark):
    window = spark.createDataFrame([(dt.date(2000, 3, 1), dt.date(2000, m, 1), k, 0.01 * k * m) for m in (1, 2, 3) for k in range(12)], "form_month date, month date, permno long, r double")
    b.MODELS["direct"] = lambda _: spark.createDataFrame([(dt.date(2000, 3, 1), k, 0.25) for k in (0, 1, 2, 99)], "form_month date, permno long, weight double")
    b.MODELS["guess"] = lambda _: spark.createDataFrame([(dt.date(2000, 3, 1), k, 0.01 * k) for k in range(12)], "form_month date, permno long, mu double")
    try:
        got = b.model_weights(None, ["direct", "guess"], window, e.shrinkage(window), cap=0.2).collect()
        assert sorted((x.permno, x.weight, x.delta) for x in got if x.model == "direct") == [(k, 0.25, None) for k in (0, 1, 2)]  # 99 is in no window
        solved = [x for x in got if x.model == "guess"]
        assert sum(x.weight for x in solved) == pytest.approx(1) and all(x.delta is not None for x in solved)
        with pytest.raises(ValueError, match="direct"):
            b.forecasts(None, ["guess", "direct"])
    finally:
        del b.MODELS["direct"], b.MODELS["guess"]


def test_checks_ride_along(spark, tmp_path):
    """A table that breaks a rule fails on write and names the key; one that keeps it is written by that write alone."""
    rows = [(k % 50, month(k // 50), None if k % 4 else 1.0) for k in range(200)]
    df = spark.createDataFrame(rows, "permno long, month date, x double").repartition(4).cache()
    df.count()
    seen, nulls = a.watch_nulls(a.assert_before(df.filter(F.col("month") < month(0)), a.assert_unique(df, ["permno", "month"])), ["x"], F.col("permno") < 10)
    spark.sparkContext.setJobGroup("one", "one")
    seen.write.parquet(str(tmp_path / "kept"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    group = [x for x in rows if x[0] < 10]
    assert nulls.get["x"] == sum(x[2] is None for x in group) / len(group)
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 200
    with pytest.raises(Exception, match='"permno":7.* occurs 2 times'):
        a.assert_unique(df.unionByName(df.filter(F.col("permno") == 7)), ["permno", "month"]).write.parquet(str(tmp_path / "broken"))
    later = df.filter(F.col("month") >= month(2))
    assert a.assert_before(df.filter(F.col("month") < month(2)), later).count() == later.count()
    with pytest.raises(Exception, match="training data reach"):
        a.assert_before(df, later).write.parquet(str(tmp_path / "early"))


@pytest.mark.parametrize("band_rows", [100_000, 500])
def test_ranks_of_a_large_month_in_bands(spark, band_rows):
    rng = np.random.default_rng(5)
    n = 20_000
    x = np.where(rng.random(n) < 0.4, 0.0, np.exp(3 * rng.normal(size=n)) * rng.choice([-1, 1], n))  # one value holds 40 %
    y = np.round(rng.normal(size=n), 2)  # many ties
    frame = pd.DataFrame({"permno": np.arange(n), "month": dt.date(2000, 1, 1), "x": x, "y": y})
    frame.loc[frame.permno % 50 == 0, "x"] = None
    frame.loc[frame.permno % 100 == 1, "month"] = dt.date(2000, 2, 1)
    frame.loc[frame.permno % 1000 == 2, "month"] = None
    df = spark.createDataFrame(frame.astype({"x": object}).where(frame.notna(), None), "permno long, month date, x double, y double")
    got = w.rank_long(df, ["x", "y"], ["permno"], band_rows=band_rows).toPandas().set_index(["name", "permno"])["score"]
    by = frame.groupby("month", dropna=False)
    want = pd.concat({k: 2 * by[k].rank() / (by[k].transform("count") + 1) - 1 for k in ("x", "y")})
    want = want.dropna()
    assert len(got) == len(want) and np.abs(got.reindex(want.index) - want).max() < 1e-12

    parts = w.banded(df.unpivot(["permno", "month"], ["x", "y"], "name", "value").filter("value IS NOT NULL"), ["permno"], ["month", "name"], band_rows)
    most = parts.filter("NOT single").groupBy("month", "name", "band").count().agg(F.max("count")).first()[0]
    assert most < 3 * band_rows
    assert {r.value for r in parts.filter("single AND name = 'x'").select("value").distinct().collect()} >= ({0.0} if band_rows == 500 else set())


def test_top_k_is_limited_before_the_shuffle(spark):
    plan = w.top_k(spark.range(100).selectExpr("id AS permno", "id % 3 AS year", "id AS v"), "v", 5, "year")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_describe_keeps_rows_without_a_group(spark):
    rows = [(1, 3.0), (1, 1.0), (1, 1.0), (1, 7.0), (2, None), (None, 4.0), (None, 6.0)]
    got = {r.g: tuple(r)[1:] for r in a.describe(spark.createDataFrame(rows, "g int, x double"), "x", "g").collect()}
    assert got == {1: (3.0, 2.0, 1.0, 7.0, 1.0), 2: (None,) * 5, None: (5.0, 5.0, 4.0, 6.0, 4.0)}
