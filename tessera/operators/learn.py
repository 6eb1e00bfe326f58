"""Pooled feature matrices and learned models over expanding windows, on Spark ML."""

from __future__ import annotations

import gc
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import columns as c
from tessera.operators import aggregates as a
from tessera.operators import moments as mo
from tessera.operators import windows as w


def splits(first_test: int, last_test: int, start: int, validation_years: int = 5) -> list[dict]:
    """Per test year the bounds (years, inclusive) of tuning, validation, training and test windows."""
    return [
        {"test_year": y, "tune": (start, y - 1 - validation_years), "validation": (y - validation_years, y - 1), "train": (start, y - 1), "test": (y, y)}
        for y in range(first_test, last_test + 1)
    ]


def splits_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    flat = [(r["test_year"], role, *r[role]) for r in rows for role in ("tune", "validation", "train", "test")]
    return spark.createDataFrame(flat, "test_year int, role string, lo int, hi int")


def between(panel: DataFrame, bounds: tuple[int, int], month: str = "month") -> DataFrame:
    return panel.filter(F.year(month).between(*bounds))


def with_target(panel: DataFrame, ret: str = "ret_adjusted", rf: str = "rf", target_lead: int = 0, industry_demean: bool = False) -> DataFrame:
    """Rows with y = excess return, of the row `target_lead` rows later; optionally less the industry's mean of the month."""
    y = F.col(ret) - F.col(rf)
    if target_lead:
        y = F.lead(y, target_lead).over(w.by_entity())
    at = panel.withColumn("y", y)
    if industry_demean:
        at = at.withColumn("_ind", c.industry("siccd")).withColumn("y", w.demean("y", "_ind", "month")).drop("_ind")
    return at.filter("y IS NOT NULL")


@dataclass
class FeatureBuilder:
    """Features from characteristics, macro states and industries; everything it knows comes from the training window.

    Missing characteristics take the industry's training median (from `least` values on, else the
    overall one), are ranked within the month to (-1, 1) and multiplied by [1, standardised macros];
    industries become 0/1 columns, all 0 for an unseen one.
    """

    characteristics: Sequence[str]
    macros: Sequence[str] = ()
    industry: str = "siccd"
    most_missing: float = 0.7
    least: int = 5
    by_industry: bool = True
    kept: list[str] = field(default_factory=list)
    industries: list[str] = field(default_factory=list)

    def fit(self, train: DataFrame) -> FeatureBuilder:
        self.kept = a.dense_columns(train, list(self.characteristics), self.most_missing)
        at = train.withColumn("_ind", c.industry(self.industry))
        overall = a.medians(at, self.kept).first()
        self.overall = {n: overall[n] if overall[n] is not None else 0.0 for n in self.kept}
        # a row an industry, worked out once and not with every table that is transformed
        groups = a.medians(at, self.kept, "_ind", self.least) if self.by_industry else at.select("_ind").distinct()
        rows = sorted(groups.collect(), key=lambda r: r["_ind"])
        self.industries = [r["_ind"] for r in rows]
        kinds = ", ".join(["_ind string", *(f"`_m_{n}` double" for n in self.kept)])
        self.grouped = train.sparkSession.createDataFrame(rows, kinds) if self.by_industry else None
        state = train.select("month", *self.macros).distinct()
        self.scale = {r["name"]: (r["mean"] or 0.0, r["std"]) for r in a.scaler(state, list(self.macros)).collect()} if self.macros else {}
        return self

    @property
    def names(self) -> list[str]:
        return [f"{n}*{m}" for n in self.kept for m in ("1", *self.macros)] + [f"industry={i}" for i in self.industries]

    def transform(self, df: DataFrame) -> DataFrame:
        """df with `features`, a vector in the order of `names`."""
        at = df.withColumn("_ind", c.industry(self.industry))
        if self.grouped is not None:
            at = at.join(F.broadcast(self.grouped), "_ind", "left")
        filled = {f"_f_{n}": F.coalesce(F.col(n), *([F.col(f"_m_{n}")] if self.grouped is not None else []), F.lit(float(self.overall[n]))) for n in self.kept}
        at = w.rank_to_unit(at.withColumns(filled), list(filled), suffix="_r")
        states = [F.lit(1.0), *(F.coalesce((F.col(m) - self.scale[m][0]) / self.scale[m][1], F.lit(0.0)) for m in self.macros)]
        crossed = F.flatten(F.transform(F.array(*(F.col(f"{f}_r") for f in filled)), lambda x: F.transform(F.array(*states), lambda s: x * s)))
        dummies = F.array(*((F.col("_ind") == i).cast("double") for i in self.industries))
        out = at.withColumn("features", array_to_vector(F.concat(crossed, dummies)))
        return out.select(*df.columns, "features")


@dataclass
class Projection:
    """Standardised features projected on the training window's first principal components."""

    k: int = 50

    def fit(self, train: DataFrame) -> Projection:
        self.scaler = StandardScaler(withMean=True, inputCol="features", outputCol="scaled").fit(train)
        scaled = self.scaler.transform(train)
        size = len(scaled.select("scaled").first()[0])
        self.pca = PCA(k=min(self.k, size), inputCol="scaled", outputCol="components").fit(scaled)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self.pca.transform(self.scaler.transform(df)).drop("scaled")


@dataclass
class LinearProjection:
    """What Projection does, known from the moments of (features, target): nothing more is read from the rows.

    A linear map turns the features' moments into the components' moments, and weights of the
    components into weights of the features. Components without variation (up to rounding) are 0.
    """

    k: int = 50

    def fit(self, m: mo.Moments) -> LinearProjection:
        cov = m.products[:-1, :-1] / max(1, m.n - 1)
        sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
        factor = np.divide(1.0, sd, out=np.zeros_like(sd), where=sd > 0)
        values, vectors = np.linalg.eigh(cov * np.outer(factor, factor))
        top = np.argsort(-values, kind="stable")[: min(self.k, len(values))]
        live = values[top] > 1e-12 * max(1e-300, values.max(initial=0.0))
        self.center, self.map = m.mean[:-1], factor[:, None] * vectors[:, top] * live
        return self

    def moments(self, m: mo.Moments) -> mo.Moments:
        """Of (components, target), from those of (features, target)."""
        full = np.zeros((len(m.mean), self.map.shape[1] + 1))
        full[:-1, :-1], full[-1, -1] = self.map, 1.0
        return mo.Moments(m.n, (m.mean - np.append(self.center, 0.0)) @ full, full.T @ m.products @ full)

    def on_features(self, weights: np.ndarray, level: float) -> tuple[np.ndarray, float]:
        """Weights and intercept on the features of a linear model of the components."""
        raw = self.map @ weights
        return raw, float(level - raw @ self.center)


def elastic_net(train: DataFrame, alpha: float, l1: float, sd_y: float, features: str = "components", ridge_below: float = 0.05, rows: int | None = None):
    """Linear model that minimises 1/2n |y - Xw|^2 + alpha l1 |w|_1 + alpha (1 - l1)/2 |w|^2 on standardised X.

    Spark divides the penalty by the label's deviation, which the parameters undo. Below
    `ridge_below` the fit is ridge, where alpha counts against the sum of squares (alpha / n)
    if `rows` is given.
    """
    if l1 < ridge_below:
        a_ = alpha / rows if rows else alpha
        return LinearRegression(featuresCol=features, labelCol="y", regParam=a_ * sd_y, elasticNetParam=0.0, solver="normal").fit(train)
    lam = alpha * l1 + alpha * (1 - l1) * sd_y
    return LinearRegression(featuresCol=features, labelCol="y", regParam=lam, elasticNetParam=alpha * l1 / lam, maxIter=200, tol=1e-8).fit(train)


def r2(df: DataFrame, p: str = "prediction") -> float | None:
    return a.zero_r2(df, "y", p).first()["r2"]


#: The grids that models are tuned on.
ALPHAS = tuple(float(x) for x in np.logspace(-5, 1, 20))
RATIOS = (0.0, 0.01, 0.1, 0.3, 0.5)
EPSILONS = (0.5, 0.7, 0.9, 1.35)


def elastic_net_surface(tune: DataFrame, validation: DataFrame, alphas: Sequence[float] = ALPHAS, ratios: Sequence[float] = RATIOS, features: str = "components") -> DataFrame:
    """alpha, l1, r2, best, alpha_at_edge, l1_at_edge for every grid cell.

    One pass over each window gives its moments; all cells are fitted and scored from these, so
    the number of cells costs no further pass.
    """
    fitted, scored = (mo.moments(mo.with_target(x, features)) for x in (tune, validation))
    return surface_table(tune.sparkSession, fitted, scored, alphas, ratios)


def surface_table(spark: SparkSession, fitted: mo.Moments | None, scored: mo.Moments | None, alphas: Sequence[float], ratios: Sequence[float]) -> DataFrame:
    """The surface from the moments of both windows."""
    path = mo.elastic_net_path(fitted, alphas, ratios) if fitted is not None else {}
    rows = [(float(al), float(l1), mo.zero_r2(scored, *path[float(al), float(l1)]) if path and scored is not None else None) for al in alphas for l1 in ratios]
    top = max((r for r in rows if r[2] is not None), key=lambda r: r[2], default=None)
    table = spark.createDataFrame([(*r, r == top) for r in rows], "alpha double, l1 double, r2 double, best boolean")
    edge = lambda n, v: F.col("best") & F.col(n).isin(float(min(v)), float(max(v)))
    return table.withColumns({"alpha_at_edge": edge("alpha", alphas), "l1_at_edge": edge("l1", ratios)})


def huber_elastic_net(train: DataFrame, alpha: float, l1: float, epsilon: float, features: str = "components", l1_floor: float = 0.1, steps: int = 20, tolerance: float = 1e-8) -> tuple[np.ndarray, float]:
    """Weights and intercept of Huber loss with an elastic-net penalty, by proximal Newton: a few passes over the rows."""
    return mo.huber_paths(train, alpha, max(l1, l1_floor), (epsilon,), features, steps, tolerance)[0][float(epsilon)]


def predict_linear(df: DataFrame, weights: np.ndarray, intercept: float, features: str = "components") -> DataFrame:
    x = vector_to_array(features)
    dot = F.aggregate(F.zip_with(x, F.array(*(F.lit(float(v)) for v in weights)), lambda p, q: p * q), F.lit(float(intercept)), lambda s, v: s + v)
    return df.withColumn("prediction", dot)


def choose_epsilon(tune: DataFrame, validation: DataFrame, alpha: float, l1: float, grid: Sequence[float] = EPSILONS, features: str = "components", l1_floor: float = 0.1, **options) -> DataFrame:
    """epsilon, r2, best on the validation window; every pass serves all epsilons, one scores them."""
    fits, _ = mo.huber_paths(tune, alpha, max(l1, l1_floor), grid, features, **options)
    scored = mo.moments(mo.with_target(validation, features))
    rows = [(float(x), mo.zero_r2(scored, *fits[float(x)]) if scored is not None and len(fits[float(x)][0]) else None) for x in grid]
    top = max((r for r in rows if r[1] is not None), key=lambda r: r[1], default=None)
    return tune.sparkSession.createDataFrame([(*r, r == top) for r in rows], "epsilon double, r2 double, best boolean")


def forecast_table(predicted: DataFrame, p: float = 0.01) -> DataFrame:
    """permno, month, expected_ret and raw_ret; the first limited to the month's p and 1 - p quantiles."""
    at = predicted.select("permno", "month", F.col("prediction").alias("raw_ret"))
    return w.winsorise(at, "raw_ret", p, out="expected_ret").select("permno", "month", "expected_ret", "raw_ret")


def zero_out_importance(validation: DataFrame, weights: Sequence[float], names: Sequence[str], features: str = "features", prediction: str = "prediction", top: int = 50) -> DataFrame:
    """name, drop: loss of validation R2 when a feature of a linear model is set to 0; all features in one pass, the top by |weight|."""
    kept = sorted(range(len(names)), key=lambda i: -abs(weights[i]))[:top]
    base = r2(validation, prediction)
    x = vector_to_array(features)
    rows = validation.select("y", F.explode(F.array(*(F.struct(F.lit(names[i]).alias("name"), (F.col(prediction) - float(weights[i]) * x[i]).alias("p")) for i in kept))).alias("s"))
    fit = rows.groupBy("s.name").agg((1 - F.try_divide(F.sum((F.col("y") - F.col("s.p")) ** 2), F.sum(F.col("y") ** 2))).alias("r2_without"))
    return fit.select("name", (F.lit(base) - F.col("r2_without")).alias("drop"))


def forest(train: DataFrame, trees: int = 300, depth: int = 6, features_rule: str = "sqrt", least_leaf: int = 1000, share: float = 0.8, seed: int = 42, last_rows: int | None = None) -> RandomForestRegressionModel:
    """Random forest on `features`; `last_rows` keeps the latest months that hold that many rows."""
    if last_rows:
        months = train.groupBy("month").count().orderBy(F.desc("month")).collect()
        total, cut = 0, None
        for r in months:
            total, cut = total + r["count"], r["month"]
            if total >= last_rows:
                break
        train = train.filter(F.col("month") >= cut) if cut is not None else train
    return RandomForestRegressor(featuresCol="features", labelCol="y", numTrees=trees, maxDepth=depth, featureSubsetStrategy=features_rule, minInstancesPerNode=least_leaf, subsamplingRate=share, seed=seed).fit(train)


#: Trees of a forest that are grown in one fit; a fit keeps a number a row and tree, and the shuffles of its histograms until it is over.
TREES_AT_ONCE = 100


def forest_surface(tune: DataFrame, validation: DataFrame, trees: Sequence[int] = (100, 300, 500), depths: Sequence[int] = (3, 6, 10), rules: Sequence[str] = ("sqrt", "log2", "onethird", "all"), tuning_trees: int | None = None, seed: int = 42, **options) -> DataFrame:
    """trees, depth, rule, r2, best; every cell is scored with as many trees as it names.

    For each depth and rule one forest of the largest number is grown, `TREES_AT_ONCE` trees a fit; cells with fewer
    trees are its first ones. `tuning_trees`, if given, bounds the forest: cells with more trees then have its score.
    Every task sends the histograms of all open nodes, so the rows are dealt evenly to two tasks a core: what is sent
    then follows the cluster's size and not the number of rows.
    """
    spark = tune.sparkSession
    tasks = 2 * spark.sparkContext.defaultParallelism
    tune, validation = (x.select("y", "features").repartition(tasks).cache() for x in (tune, validation))
    size = {t: min(t, tuning_trees or t) for t in trees}
    largest = max(size.values())
    edges = sorted({0, *size.values(), *range(TREES_AT_ONCE, largest, TREES_AT_ONCE)})
    rows = []
    for depth in depths:
        for rule in rules:
            scored, total, sums = validation, F.lit(0.0), {}
            for lo, hi in pairwise(edges):
                model = forest(tune, hi - lo, depth, rule, seed=seed + 1_000_003 * lo, **options)
                scored = model.setPredictionCol(f"_p{hi}").transform(scored)
                total = total + (hi - lo) * F.col(f"_p{hi}")
                sums[hi] = total / hi
                # Spark deletes a fit's shuffles once the driver's garbage is collected
                gc.collect()
                spark.sparkContext._jvm.System.gc()
            fits = scored.agg(*((1 - F.try_divide(F.sum((F.col("y") - p) ** 2), F.sum(F.col("y") ** 2))).alias(str(n)) for n, p in sums.items())).first()
            rows += [(int(t), int(depth), rule, fits[str(size[t])]) for t in trees]
    tune.unpersist()
    validation.unpersist()
    top = max((r for r in rows if r[3] is not None), key=lambda r: (r[3], r[0]), default=None)
    return spark.createDataFrame([(*r, r == top) for r in rows], "trees int, depth int, rule string, r2 double, best boolean")


def forest_report(model: RandomForestRegressionModel, names: Sequence[str], spark: SparkSession, train_r2: float | None = None, validation_r2: float | None = None, max_depth: int = 6) -> tuple[DataFrame, DataFrame]:
    """Impurity importance by feature, and one row on the trees' depths, share at the ceiling and overfit."""
    shares = model.featureImportances.toArray()
    importance = spark.createDataFrame([(n, float(v)) for n, v in zip(names, shares, strict=True)], "name string, importance double")
    depths = np.array([t.depth for t in model.trees])
    over = None if train_r2 is None or validation_r2 is None else bool(train_r2 - validation_r2 > 0.05)
    row = (float(depths.mean()), int(depths.min()), int(depths.max()), float(depths.std()), float((depths >= max_depth).mean()), over)
    return importance, spark.createDataFrame([row], "mean_depth double, min_depth int, max_depth int, std_depth double, at_ceiling double, overfit boolean")


def expanding_forecasts(panel: DataFrame, builder, plan: list[dict], alphas: Sequence[float], ratios: Sequence[float], k: int = 50, keep=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Forecasts of every test year, the validation surfaces and the chosen parameters (reest_year first): tuned
    on the validation window, refitted on all years before the test. `builder` makes a fresh FeatureBuilder.

    Each window's features are made once, in the pass that sums their moments; projection, grid and refit follow
    from these, and the chosen model is applied as weights of the features. `keep` writes the predictions, which
    the forecast table reads more than once, to a table.
    """
    forecasts = surfaces = None
    chosen = []
    for s in plan:
        tune, validation, train, test = (between(panel, s[r]) for r in ("tune", "validation", "train", "test"))
        test = a.assert_before(train, test)
        first = builder().fit(tune)
        (known, rest), (held, _) = (mo.target_moments(first.transform(x)) for x in (tune, validation))
        projection = LinearProjection(k).fit(known + rest)
        surface = surface_table(panel.sparkSession, projection.moments(known), projection.moments(held), alphas, ratios)
        best = surface.filter("best").first()
        second = builder().fit(train)
        known, rest = mo.target_moments(second.transform(train))
        projection = LinearProjection(k).fit(known + rest)
        weights, level = mo.elastic_net_path(projection.moments(known), (best["alpha"],), (best["l1"],))[best["alpha"], best["l1"]]
        predicted = predict_linear(second.transform(test), *projection.on_features(weights, level), "features")
        part = forecast_table(predicted if keep is None else keep(predicted.select("permno", "month", "prediction")))
        surface = surface.select(F.lit(s["test_year"]).alias("reest_year"), "*")
        forecasts = part if forecasts is None else forecasts.unionByName(part)
        surfaces = surface if surfaces is None else surfaces.unionByName(surface)
        chosen.append((s["test_year"], *s["train"], *s["validation"], best["alpha"], best["l1"], best["r2"], known.n, len(second.names), min(k, len(second.names)), int(np.count_nonzero(weights))))
    names = "reest_year int, train_from int, train_to int, validation_from int, validation_to int, alpha double, l1 double, validation_r2 double, n_train long, n_features int, n_components int, n_nonzero int"
    return forecasts, surfaces, panel.sparkSession.createDataFrame(chosen, names)
