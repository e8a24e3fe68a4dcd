"""Probability metrics, calibration, thresholds and classification reports as one-pass aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybefore.operators.prefix import prefix_sums

# Fixed values.
LOG_EPS = 2.220446049250313e-16
SWEEP_LO, SWEEP_HI, SWEEP_STEP = 0.30, 0.70, 0.01

#: Parts that distinct scores are cut into for ranking.
RANGES = 256


def _log_loss(p: Column, y: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1.0 - LOG_EPS)), F.lit(LOG_EPS))
    return F.when(y == 1, -F.ln(q)).otherwise(-F.ln(1.0 - q))


def auc(df: DataFrame, p: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve per group, ties counted half, for scores of any range.

    Rows are first counted per distinct score.  Approximate quantiles of the distinct scores cut them into
    ``RANGES`` parts of about equal size; negatives are counted per part, summed up over the parts, and
    the running count is taken inside each.  Where the cuts lie does not change the result.
    """
    pos, neg = (F.col(y) == 1).cast("long"), (F.col(y) == 0).cast("long")
    by_score = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(p).cast("double").alias("_p"))
    counts = by_score.agg(F.sum(pos).alias("_pos"), F.sum(neg).alias("_neg")).withColumn("_g", F.lit(0))
    steps = [i / RANGES for i in range(1, RANGES)]
    cuts = counts.groupBy(*by, "_g").agg(F.array_distinct(F.percentile_approx("_p", steps, F.lit(20 * RANGES))).alias("_cuts"))
    keyed = counts.join(cuts, [*by, "_g"]).withColumn("_range", F.size(F.filter("_cuts", lambda x: x < F.col("_p"))))
    ranked = prefix_sums(keyed, [*by, "_g"], [F.col("_range"), F.col("_p")], {"_below": F.col("_neg")})
    gain = F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2.0))
    both = F.sum("_pos").cast("double") * F.sum("_neg")
    return ranked.groupBy(*by, "_g").agg((gain / F.when(both > 0, both)).alias("roc_auc")).drop("_g")


def probability_metrics(df: DataFrame, p: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, accuracy, log loss, Brier, AUC, their constant-rate baselines and the two means, per group."""
    pc, yc = F.col(p).cast("double"), F.col(y).cast("double")
    rows = df.where(pc.isNotNull() & yc.isNotNull())
    rate = F.avg(yc)
    agg = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_games"),
        F.avg(((pc > 0.5).cast("double") == yc).cast("double")).alias("accuracy"),
        F.avg(_log_loss(pc, yc)).alias("log_loss"),
        F.avg((pc - yc) * (pc - yc)).alias("brier"),
        F.avg(pc).alias("mean_predicted_prob"), rate.alias("actual_home_rate"))
    r = F.col("actual_home_rate")
    clipped = F.greatest(F.least(r, F.lit(1.0 - LOG_EPS)), F.lit(LOG_EPS))
    agg = agg.withColumns({
        "baseline_accuracy": r,
        "baseline_log_loss": -(r * F.ln(clipped) + (1.0 - r) * F.ln(1.0 - clipped)),
        "baseline_brier": r * (1.0 - r)})
    a = auc(rows, p, y, by)
    if by:
        joined = agg.join(a, list(by), "left")
    else:  # one row each
        joined = agg.withColumn("_g", F.lit(0)).join(a.withColumn("_g", F.lit(0)), "_g", "left").drop("_g")
    return joined.select(*by, "n_games", "accuracy", "baseline_accuracy", "log_loss", "baseline_log_loss", "brier",
                         "baseline_brier", "roc_auc", "mean_predicted_prob", "actual_home_rate")


def bin_edges(bins: int) -> list[float]:
    """Equal edges of [0, 1] as the floating multiples i * (1 / bins), the last exactly 1."""
    return [i * (1.0 / bins) for i in range(bins)] + [1.0]


def bin_of(p: Column, bins: int) -> Column:
    """Bin index by comparison with the literal edges; 1.0 falls in the last bin."""
    inner = bin_edges(bins)[1:-1]
    return sum([(p >= F.lit(e)).cast("int") for e in inner], F.lit(0))


def calibration(df: DataFrame, p: str, y: str, bins: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """Per non-empty bin: edges, count, mean prediction, mean outcome."""
    edges = F.array(*[F.lit(e) for e in bin_edges(bins)])
    pc, yc = F.col(p).cast("double"), F.col(y).cast("double")
    b = df.where(pc.isNotNull() & yc.isNotNull()).groupBy(*by, bin_of(pc, bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(pc).alias("pred_mean"), F.avg(yc).alias("actual_mean"))
    return b.select(*by, "bin", F.get(edges, F.col("bin")).alias("bucket_min"),
                    F.get(edges, F.col("bin") + 1).alias("bucket_max"), "n", "pred_mean", "actual_mean")


def best_threshold(df: DataFrame, p: str, y: str, by: Sequence[str] = (), lo: float = SWEEP_LO,
                   hi: float = SWEEP_HI, step: float = SWEEP_STEP) -> DataFrame:
    """The threshold of the sweep with the best accuracy of ``p > t``; the lowest wins ties.

    One conditional count per threshold in a single aggregate, instead of a copy of the data
    per threshold.
    """
    n = int((hi + 1e-9 - lo) / step) + 1
    delta = (lo + step) - lo
    ts = [lo + i * delta for i in range(n)]
    pc, yc = F.col(p).cast("double"), F.col(y)
    hits = df.where(pc.isNotNull() & yc.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if((pc > F.lit(t)) == (yc == 1)).alias(f"_h{i}") for i, t in enumerate(ts)])
    cells = F.array(*[F.struct(F.col(f"_h{i}").alias("h"), F.lit(-t).alias("t")) for i, t in enumerate(ts)])
    best = F.array_max(cells)
    return hits.select(*by, (-best["t"]).alias("threshold"), (best["h"] / F.col("_n")).alias("accuracy"))


def absolute_error(df: DataFrame, pred: str, actual: str, train_mean: float | Column, by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute error of the prediction and of a constant predictor."""
    base = train_mean if isinstance(train_mean, Column) else F.lit(float(train_mean))
    return df.groupBy(*by).agg(F.avg(F.abs(F.col(actual) - F.col(pred))).alias("mae"),
                               F.avg(F.abs(F.col(actual) - base)).alias("baseline_mae"))


def classification_report(df: DataFrame, pred: str, actual: str, labels: Sequence[int] = (0, 1)) -> DataFrame:
    """Precision, recall, F1 and support per label; 0 where a denominator is 0."""
    pairs = F.explode(F.array(*[F.lit(v) for v in labels])).alias("label")
    small = df.groupBy(F.col(pred).alias("_p"), F.col(actual).alias("_a")).agg(F.count(F.lit(1)).alias("_n"))
    per = small.select("_p", "_a", "_n", pairs).groupBy("label").agg(
        F.sum(F.when((F.col("_p") == F.col("label")) & (F.col("_a") == F.col("label")), F.col("_n")).otherwise(0)).alias("_tp"),
        F.sum(F.when(F.col("_p") == F.col("label"), F.col("_n")).otherwise(0)).alias("_pp"),
        F.sum(F.when(F.col("_a") == F.col("label"), F.col("_n")).otherwise(0)).alias("support"))

    def ratio(a, b):
        return F.when(b > 0, a / F.when(b > 0, b)).otherwise(F.lit(0.0))

    per = per.withColumns({"precision": ratio(F.col("_tp"), F.col("_pp")),
                           "recall": ratio(F.col("_tp"), F.col("support"))})
    f1 = ratio(2.0 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return per.select("label", "precision", "recall", f1.alias("f1"), "support")


def macro_f1(df: DataFrame, pred: str, actual: str, labels: Sequence[int] = (0, 1)) -> DataFrame:
    return classification_report(df, pred, actual, labels).agg(F.avg("f1").alias("macro_f1"))


def fold_summary(folds: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean over folds of each per-fold metric."""
    return folds.agg(F.count(F.lit(1)).alias("n_folds"), *[F.avg(c).alias(f"mean_{c}") for c in cols])
