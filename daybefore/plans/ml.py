"""Training and scoring with Spark ML: catalogues, calibration, selection, persistence."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybefore.functions.scalars import neutral_fill, no_nan, position_code
from daybefore.functions.scores import EPS, score_distribution
from daybefore.operators.isotonic import Isotonic, fit_isotonic
from daybefore.operators.metrics import (absolute_error, best_threshold, macro_f1, probability_metrics)
from daybefore.plans.columns import (EVENT_FEATURES, FEATURES, LEAN, NEUTRAL_FILLS, PLAYER_FEATURES,
                                     PLAYOFF_FEATURES)
from daybefore.session import cut_lineage

SEED = 42
FOLDS = 5


@dataclass(frozen=True)
class Recipe:
    """A named estimator: how to make it for ``n`` rows, and whether inputs are standardised."""

    name: str
    make: Callable[[int], Estimator]
    scale: bool = False


# Fixed values in the recipes: trees, depths, step sizes, shares of rows, penalties.
def _logistic(n: int) -> LogisticRegression:
    # an L2 penalty of 1 on the summed loss is 1/n on Spark's mean loss
    return LogisticRegression(maxIter=1000, regParam=1.0 / max(n, 1), featuresCol="features")


def _boosting(trees: int, subsample: float = 1.0) -> Callable[[int], Estimator]:
    return lambda n: GBTClassifier(maxIter=trees, maxDepth=3, stepSize=0.05, subsamplingRate=subsample, seed=SEED,
                                   featuresCol="features")


def win_recipes(trees: int = 500) -> dict[str, Recipe]:
    return {
        "logistic": Recipe("Logistic Regression", _logistic, True),
        "random_forest": Recipe("Random Forest", lambda n: RandomForestClassifier(
            numTrees=trees, maxDepth=6, seed=SEED, featuresCol="features")),
        "gradient_boosting": Recipe("Gradient Boosting", _boosting(trees)),
    }


def pair_recipes(trees: int = 300) -> dict[str, Recipe]:
    """The logistic / boosting pair of the event and player models."""
    return {"logistic": Recipe("Logistic Regression", _logistic, True),
            "gradient_boosting": Recipe("Gradient Boosting", _boosting(trees, 0.8))}


def playoff_recipe(trees: int = 300) -> Recipe:
    return Recipe("Playoff Gradient Boosting", _boosting(trees, 0.8))


def prepare(df: DataFrame, features: Sequence[str], fills: Mapping[str, float] = NEUTRAL_FILLS,
            default: float = 0.5) -> DataFrame:
    return neutral_fill(df, features, fills, default)


def inputs(features: Sequence[str], scale: bool) -> list:
    """Assembler, and a standard scaler when asked (Spark's default does not centre)."""
    if not scale:
        return [VectorAssembler(inputCols=list(features), outputCol="features")]
    return [VectorAssembler(inputCols=list(features), outputCol="_raw_features"),
            StandardScaler(inputCol="_raw_features", outputCol="features", withMean=True, withStd=True)]


def fit_classifier(train: DataFrame, recipe: Recipe, features: Sequence[str], label: str,
                   weight: str | None = None) -> PipelineModel:
    est = recipe.make(train.count())
    est.setLabelCol(label)
    if weight:
        est.setWeightCol(weight)
    return Pipeline(stages=[*inputs(features, recipe.scale), est]).fit(train)


def with_probability(model: PipelineModel, df: DataFrame, out: str = "p") -> DataFrame:
    scored = model.transform(df)
    return scored.select(*df.columns, vector_to_array("probability")[1].alias(out))


def _margin(model: PipelineModel, df: DataFrame, out: str) -> DataFrame:
    return model.transform(df).select(*df.columns, vector_to_array("rawPrediction")[1].alias(out))


def fold_of(id: str, folds: int = FOLDS):
    return F.pmod(F.xxhash64(F.col(id)), F.lit(folds))


@dataclass
class Calibrated:
    """Base models with a calibrator fitted on each one's held-out fold; predictions are averaged."""

    method: str
    pairs: list[tuple[PipelineModel, object]] = field(default_factory=list)

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        cols = df.columns
        cur = df
        for i, (base, cal) in enumerate(self.pairs):
            if self.method == "isotonic":
                cur = with_probability(base, cur, "_s")
                cur = cur.withColumn(f"_c{i}", cal.apply(F.col("_s"))).drop("_s")
            else:
                cur = _margin(base, cur, "_s")
                nxt = cal.transform(VectorAssembler(inputCols=["_s"], outputCol="_sv").transform(cur))
                cur = nxt.select(*cur.columns[:-1], vector_to_array("probability")[1].alias(f"_c{i}"))
        mean = sum((F.col(f"_c{i}") for i in range(len(self.pairs))), F.lit(0.0)) / float(len(self.pairs))
        return cur.select(*cols, mean.alias(out))


def fit_calibrated(train: DataFrame, recipe: Recipe, features: Sequence[str], label: str, id: str,
                   method: str = "isotonic", folds: int = FOLDS) -> Calibrated:
    out = Calibrated(method)
    t = train.withColumn("_fold", fold_of(id, folds))
    for k in range(folds):
        base = fit_classifier(t.where(F.col("_fold") != k), recipe, features, label)
        held = t.where(F.col("_fold") == k)
        if method == "isotonic":
            cal = fit_isotonic(with_probability(base, held, "_s"), "_s", label)
        elif method == "sigmoid":
            scored = VectorAssembler(inputCols=["_s"], outputCol="_sv").transform(_margin(base, held, "_s"))
            cal = LogisticRegression(featuresCol="_sv", labelCol=label).fit(scored)
        else:
            raise ValueError("method is 'isotonic' or 'sigmoid'")
        out.pairs.append((base, cal))
    return out


def score(model, df: DataFrame, out: str = "p") -> DataFrame:
    return model.score(df, out) if isinstance(model, Calibrated) else with_probability(model, df, out)


def importances(model, features: Sequence[str], n: int = 15) -> DataFrame:
    """The ``n`` largest importances: tree importance, or |coefficient|, averaged over calibration folds."""
    models = [b for b, _ in model.pairs] if isinstance(model, Calibrated) else [model]
    sums = [0.0] * len(features)
    for m in models:
        last = m.stages[-1]
        vals = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
        for i, v in enumerate(vals.toArray()):
            sums[i] += abs(float(v)) / len(models)
    spark = SparkSession.getActiveSession()
    rows = spark.createDataFrame(list(zip(features, sums)), "feature string, importance double")
    return rows.orderBy(F.col("importance").desc(), "feature").limit(n)


@dataclass
class Payload:
    """A trained model with everything needed to score: columns, name, threshold, shared term."""

    model: object
    features: list[str]
    name: str
    threshold: float = 0.5
    version: str = "1"

    @property
    def lambda3(self) -> float | None:
        """The shared term of a goals model, which alone holds it."""
        return self.model.lambda3 if isinstance(self.model, GoalsModel) else None

    def save(self, spark: SparkSession, path: str) -> None:
        parts = {"kind": "plain", "method": ""}
        if isinstance(self.model, Calibrated):
            parts = {"kind": "calibrated", "method": self.model.method, "n": len(self.model.pairs)}
            for i, (base, cal) in enumerate(self.model.pairs):
                base.write().overwrite().save(f"{path}/base_{i}")
                if isinstance(cal, Isotonic):
                    spark.createDataFrame([(cal.dumps(),)], "value string").write.mode("overwrite").text(f"{path}/calibrator_{i}")
                else:
                    cal.write().overwrite().save(f"{path}/calibrator_{i}")
        elif isinstance(self.model, GoalsModel):
            parts = {"kind": "goals"}
            self.model.home.write().overwrite().save(f"{path}/home")
            self.model.away.write().overwrite().save(f"{path}/away")
        elif isinstance(self.model, ScoreModel):
            parts = {"kind": "scores"}
            self.model.home.write().overwrite().save(f"{path}/home")
            self.model.away.write().overwrite().save(f"{path}/away")
        else:
            self.model.write().overwrite().save(f"{path}/model")
        meta = dict(parts, features=self.features, name=self.name, threshold=self.threshold, lambda3=self.lambda3,
                    version=self.version)
        spark.createDataFrame([(json.dumps(meta),)], "value string").write.mode("overwrite").text(f"{path}/meta")


def load_payload(spark: SparkSession, path: str) -> Payload:
    from pyspark.ml.classification import LogisticRegressionModel
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    if meta["kind"] == "calibrated":

        def calibrator(at):
            return Isotonic.loads(spark.read.text(at).first()[0]) if meta["method"] == "isotonic" else LogisticRegressionModel.load(at)
        model = Calibrated(meta["method"], [
            (PipelineModel.load(f"{path}/base_{i}"), calibrator(f"{path}/calibrator_{i}")) for i in range(meta["n"])])
    elif meta["kind"] in ("goals", "scores"):
        h, a = PipelineModel.load(f"{path}/home"), PipelineModel.load(f"{path}/away")
        model = GoalsModel(h, a, meta["lambda3"]) if meta["kind"] == "goals" else ScoreModel(h, a)
    else:
        model = PipelineModel.load(f"{path}/model")
    return Payload(model, meta["features"], meta["name"], meta["threshold"], meta["version"])


@dataclass
class GoalsModel:
    """Two rate regressions and the shared covariance term."""

    home: PipelineModel
    away: PipelineModel
    lambda3: float

    def rates(self, df: DataFrame) -> DataFrame:
        cols = df.columns
        h = self.home.transform(df).select(*cols, F.greatest("prediction", F.lit(EPS)).alias("lambda_home"))
        a = self.away.transform(h).select(*h.columns, F.greatest("prediction", F.lit(EPS)).alias("lambda_away"))
        return a.withColumn("lambda3", F.lit(float(max(self.lambda3, 0.0))))

    def distribution(self, df: DataFrame, max_goals: int = 10) -> DataFrame:
        return score_distribution(self.rates(df), "lambda_home", "lambda_away", "lambda3", max_goals)


def fit_goals(train: DataFrame, features: Sequence[str], home: str = "home_score", away: str = "away_score",
              reg: float = 1e-4, scale: bool = True, fixed_lambda3: float | None = None,
              shared: bool = True) -> GoalsModel:
    """Poisson regressions of both scores; the shared term is the mean product of residuals, at least 0."""
    def one(label):
        glr = GeneralizedLinearRegression(family="poisson", link="log", regParam=reg, maxIter=50, labelCol=label,
                                          featuresCol="features")
        return Pipeline(stages=[*inputs(features, scale), glr]).fit(train)
    model = GoalsModel(one(home), one(away), 0.0)
    if fixed_lambda3 is not None:
        model.lambda3 = max(float(fixed_lambda3), 0.0)
    elif shared:
        r = model.rates(train)
        cov = r.agg(F.avg((F.col(home) - F.col("lambda_home")) * (F.col(away) - F.col("lambda_away")))).first()[0]
        model.lambda3 = max(float(cov or 0.0), 0.0)
    return model


def residual_covariance(df: DataFrame, home: str, away: str, rate_home: str, rate_away: str) -> DataFrame:
    cov = F.avg((F.col(home) - F.col(rate_home)) * (F.col(away) - F.col(rate_away)))
    return df.agg(F.greatest(cov, F.lit(0.0)).alias("lambda3"))


@dataclass
class ScoreModel:
    """Boosted regressors of the two scores."""

    home: PipelineModel
    away: PipelineModel

    def predict(self, df: DataFrame, home_out: str = "pred_home", away_out: str = "pred_away") -> DataFrame:
        cols = df.columns
        h = self.home.transform(df).select(*cols, F.col("prediction").alias(home_out))
        return self.away.transform(h).select(*h.columns, F.col("prediction").alias(away_out))


def fit_scores(train: DataFrame, features: Sequence[str], home: str = "home_score", away: str = "away_score",
               trees: int = 500) -> ScoreModel:
    def one(label):
        gbt = GBTRegressor(maxIter=trees, maxDepth=3, stepSize=0.05, seed=SEED, labelCol=label, featuresCol="features")
        return Pipeline(stages=[*inputs(features, False), gbt]).fit(train)
    return ScoreModel(one(home), one(away))


def score_report(model: ScoreModel, train: DataFrame, test: DataFrame, home: str = "home_score",
                 away: str = "away_score") -> DataFrame:
    """Mean absolute error per side against predicting the training mean."""
    means = train.agg(F.avg(home), F.avg(away)).first()
    p = model.predict(test)
    h = absolute_error(p, "pred_home", home, means[0]).select(F.lit("home").alias("side"), "mae", "baseline_mae")
    a = absolute_error(p, "pred_away", away, means[1]).select(F.lit("away").alias("side"), "mae", "baseline_mae")
    return h.unionByName(a)


def compare(train: DataFrame, test: DataFrame, label: str, recipes: Mapping[str, Recipe],
            feature_sets: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """One metrics row per feature set and model."""
    sets = feature_sets or {"full": FEATURES, "lean": LEAN}
    out = None
    for set_name, cols in sets.items():
        tr, te = prepare(train, cols), prepare(test, cols)
        for key, recipe in recipes.items():
            m = probability_metrics(with_probability(fit_classifier(tr, recipe, cols, label), te), "p", label)
            m = m.select(F.lit(set_name).alias("feature_set"), F.lit(key).alias("model"), *m.columns)
            out = m if out is None else out.unionByName(m)
    return out


def train_win(df: DataFrame, test_season, season: str = "season", label: str = "target", id: str = "game_id",
              features: Sequence[str] = FEATURES, recipe: Recipe | None = None, calibrate: bool = True,
              exclude: Sequence = ()) -> tuple[Payload, DataFrame]:
    """Fit on all but the test season, report on it. Returns the payload and its metrics row."""
    from daybefore.sources.scans import excluding, holdout
    recipe = recipe or win_recipes()["logistic"]
    rows = prepare(excluding(df, season, exclude), features)
    train, test = holdout(rows, season, test_season)
    train = train.persist()
    try:
        model = (fit_calibrated(train, recipe, features, label, id, "isotonic") if calibrate
                 else fit_classifier(train, recipe, features, label))
    finally:
        train.unpersist()
    payload = Payload(model, list(features), recipe.name + (" (calibrated)" if calibrate else ""))
    return payload, probability_metrics(score(model, test), "p", label)


def leave_one_season_out(df: DataFrame, recipe: Recipe, features: Sequence[str], season: str, label: str, id: str,
                         method: str | None = "sigmoid", folds: int = FOLDS) -> DataFrame:
    """Out-of-fold probability of every row from a model of the other seasons (a loop over the few seasons)."""
    out = None
    for (s,) in df.select(season).distinct().orderBy(season).collect():
        rest, held = df.where(F.col(season) != s), df.where(F.col(season) == s)
        if rest.isEmpty():
            continue
        model = (fit_calibrated(rest, recipe, features, label, id, method, folds) if method
                 else fit_classifier(rest, recipe, features, label))
        part = score(model, held, "oof")
        out = part if out is None else out.unionByName(part)
    return out


def train_playoff(df: DataFrame, test_season, season: str = "season", label: str = "target", id: str = "game_id",
                  features: Sequence[str] = PLAYOFF_FEATURES, recipe: Recipe | None = None,
                  method: str | None = "sigmoid", exclude: Sequence = (), tune: bool = True,
                  folds: int = FOLDS) -> tuple[Payload, DataFrame]:
    """Leave-one-season-out threshold, then a calibrated model of all training seasons."""
    from daybefore.sources.scans import excluding, holdout
    recipe = recipe or playoff_recipe()
    rows = prepare(excluding(df, season, exclude), features)
    train, test = holdout(rows, season, test_season)
    train = cut_lineage(train)
    threshold = 0.5
    if tune:
        oof = leave_one_season_out(train, recipe, features, season, label, id, method, folds)
        if oof is not None:
            threshold = float(best_threshold(oof, "oof", label).first()["threshold"])
    model = (fit_calibrated(train, recipe, features, label, id, method, folds) if method
             else fit_classifier(train, recipe, features, label))
    name = recipe.name + (f" ({method}-calibrated)" if method else "")
    return Payload(model, list(features), name, threshold), probability_metrics(score(model, test), "p", label)


def train_events(df: DataFrame, test_season, season: str = "season", recipes: Mapping[str, Recipe] | None = None,
                 features: Sequence[str] = EVENT_FEATURES, label: str = "is_goal") -> tuple[Payload, DataFrame]:
    """Fit the event models on rows with coordinates; keep the one with the best AUC."""
    from daybefore.sources.scans import holdout
    rows = df.dropna(subset=["x_coord", "y_coord"])
    rows = prepare(rows, features, {}, 0.0)
    train, test = holdout(rows, season, test_season)
    return _best(train, test, recipes or pair_recipes(), features, label,
                 lambda s: probability_metrics(s, "p", label), "roc_auc")


def player_rows(rolled: DataFrame) -> DataFrame:
    """Player training rows: history required, target and codes added."""
    df = rolled.where(F.col("rolling_points").isNotNull())
    return df.withColumns({
        "scored_point": (F.coalesce("points", F.lit(0.0)) > 0).cast("int"),
        "is_home": F.col("is_home").cast("int"), "position_code": position_code("position")})


def train_players(df: DataFrame, test_season, season: str = "season", recipes: Mapping[str, Recipe] | None = None,
                  features: Sequence[str] = PLAYER_FEATURES, label: str = "scored_point") -> tuple[Payload, DataFrame]:
    """Balanced logistic against boosting; keep the one with the best macro F1."""
    from daybefore.sources.scans import holdout
    rows = prepare(df, features, {}, 0.0)
    train, test = holdout(rows, season, test_season)
    n, ones = train.agg(F.count(F.lit(1)), F.sum(label)).first()
    w = F.when(F.col(label) == 1, n / (2.0 * max(ones, 1))).otherwise(n / (2.0 * max(n - ones, 1)))
    return _best(train.withColumn("_w", w), test, recipes or pair_recipes(), features, label,
                 lambda s: macro_f1(s.withColumn("_yhat", (F.col("p") > 0.5).cast("int")), "_yhat", label),
                 "macro_f1", {"logistic": "_w"})


def _best(train, test, recipes, features, label, measure, key, weights=None):
    train = train.persist()
    best, rows = None, None
    try:
        for name, recipe in recipes.items():
            model = fit_classifier(train, recipe, features, label, (weights or {}).get(name))
            got = measure(with_probability(model, test))
            value = got.first()[key]
            row = got.select(F.lit(name).alias("model"), *got.columns)
            rows = row if rows is None else rows.unionByName(row)
            if best is None or (value is not None and value > best[0]):
                best = (value if value is not None else float("-inf"), recipe.name, model)
    finally:
        train.unpersist()
    return Payload(best[2], list(features), best[1]), rows


def score_events(events: DataFrame, payload: Payload | None, game: str = "game_id", order: str = "sort_order") -> DataFrame:
    """``xg`` of on-target events with features; 0 without a model."""
    if payload is None:
        return events.select(game, order, F.lit(0.0).alias("xg"))
    rows = prepare(events, payload.features, {}, 0.0)
    return score(payload.model, rows, "xg").select(game, order, "xg")


__all__ = [n for n in dir() if not n.startswith("_")]
