"""Linear models on features and labels.

Spark ML fits them. What is kept is the coefficients: scoring is a plain column expression over the scaled features, so it stays
inside generated code, and a fitted model is a small table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.operators.quality import duplicates


def check_inputs(df: DataFrame, features: Sequence[str], target: str) -> None:
    """Raise ``ValueError`` on missing columns, unknown targets or repeated time stamps."""
    missing = [c for c in (*features, target) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if not duplicates(df).isEmpty():
        raise ValueError("duplicate timestamps")
    if df.filter(F.col(target).isNull()).limit(1).count():
        raise ValueError("rows without a target")


@dataclass(frozen=True)
class Scaler:
    """Means and deviations of the training part; a zero deviation counts as one."""

    means: dict[str, float]
    deviations: dict[str, float]

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"_z_{c}": (F.col(c) - m) / self.deviations[c] for c, m in self.means.items()})


def fit_scaler(train: DataFrame, features: Sequence[str], population: bool = False) -> Scaler:
    """One aggregate over the training rows; ``population`` divides by n instead of n - 1."""
    dev = F.stddev_pop if population else F.stddev_samp
    row = train.agg(*[F.avg(c).alias(f"m_{c}") for c in features], *[dev(c).alias(f"s_{c}") for c in features]).first()
    spread = {c: row[f"s_{c}"] or 1.0 for c in features}
    return Scaler({c: row[f"m_{c}"] for c in features}, spread)


@dataclass(frozen=True)
class Fitted:
    features: tuple[str, ...]
    target: str
    scaler: Scaler
    weights: tuple[float, ...]
    intercept: float
    constant: float | None
    kind: str

    def score(self) -> Column:
        """Intercept plus weighted scaled features, added in the order of the features; null where a feature is null."""
        total = F.lit(self.intercept)
        for name, weight in zip(self.features, self.weights):
            total = total + (F.col(name) - self.scaler.means[name]) / self.scaler.deviations[name] * F.lit(weight)
        return total

    def predict(self, df: DataFrame) -> DataFrame:
        """``prediction``, and for classifiers ``probability`` of class one."""
        if self.constant is not None:
            out = df.withColumn("prediction", F.lit(self.constant))
            return out.withColumn("probability", F.lit(self.constant)) if self.kind == "logistic" else out
        if self.kind != "logistic":
            return df.withColumn("prediction", self.score())
        scored = df.withColumn("probability", 1.0 / (1.0 + F.exp(-self.score())))
        return scored.withColumn("prediction", (F.col("probability") > 0.5).cast("double"))


def _coefficients(stage, train: DataFrame, features: Sequence[str], scaler: Scaler) -> tuple[tuple[float, ...], float]:
    assembler = VectorAssembler(inputCols=[f"_z_{c}" for c in features], outputCol="_features")
    model = stage.fit(assembler.transform(scaler.apply(train)))
    return tuple(float(w) for w in model.coefficients), float(model.intercept)


def gradient(fitted: Fitted, train: DataFrame, c: float = 1.0) -> DataFrame:
    """Slope of the penalised logistic loss at the fitted coefficients, per feature and for the intercept; near 0 at the optimum.

    One aggregate: the mean over rows of (probability - label) times the scaled feature, plus the penalty weight / (c * rows).
    """
    off = F.col("probability") - F.col(fitted.target)
    z = {n: (F.col(n) - fitted.scaler.means[n]) / fitted.scaler.deviations[n] for n in fitted.features}
    slopes = [(F.avg(off * z[n]) + F.lit(w) / (F.lit(c) * F.count("*"))) for n, w in zip(fitted.features, fitted.weights)]
    pairs = [F.struct(F.lit(n).alias("feature"), s.alias("slope")) for n, s in zip(("intercept", *fitted.features), (F.avg(off), *slopes))]
    return fitted.predict(train).agg(F.array(*pairs).alias("all")).select(F.inline("all"))


def fit_logistic(
    train: DataFrame, features: Sequence[str], target: str, c: float = 1.0, iterations: int = 1000, population: bool = False
) -> Fitted:
    """L2 logistic regression on scaled features; one class only gives that class as a constant."""
    seen = train.agg(F.count("*").alias("n"), F.min(target).alias("low"), F.max(target).alias("high")).first()
    scaler = fit_scaler(train, features, population)
    if seen.low == seen.high:
        return Fitted(tuple(features), target, scaler, (), 0.0, float(seen.low), "logistic")
    rows = seen.n
    stage = LogisticRegression(
        featuresCol="_features", labelCol=target, regParam=1.0 / (c * rows), elasticNetParam=0.0, standardization=False,
        maxIter=iterations, tol=1e-8,
    )
    return Fitted(tuple(features), target, scaler, *_coefficients(stage, train, features, scaler), None, "logistic")


def fit_ridge(train: DataFrame, features: Sequence[str], target: str, alpha: float = 1.0, population: bool = False) -> Fitted:
    """Ridge regression: squared errors plus ``alpha`` times the squared weights of the scaled features, no penalty on the intercept.

    Spark averages the loss over the rows and divides the penalty by the label's deviation, so both are put back.
    """
    scaler = fit_scaler(train, features, population)
    seen = train.agg(F.count("*").alias("n"), F.stddev_pop(target).alias("spread")).first()
    stage = LinearRegression(
        featuresCol="_features", labelCol=target, regParam=alpha / seen.n * seen.spread, elasticNetParam=0.0, standardization=False, solver="normal"
    )
    return Fitted(tuple(features), target, scaler, *_coefficients(stage, train, features, scaler), None, "ridge")


def confusion(predictions: DataFrame, target: str, keys: Sequence[str] = ("split",)) -> DataFrame:
    """Counts of right and wrong predictions of each class."""
    said, true = F.col("prediction") == 1, F.col(target) == 1
    cells = {"hits": said & true, "false_alarms": said & ~true, "misses": ~said & true, "right_rejections": ~said & ~true}
    return predictions.groupBy(*keys).agg(*[F.count(F.when(cond, 1)).alias(name) for name, cond in cells.items()])


def accuracy(predictions: DataFrame, target: str, keys: Sequence[str] = ("split",)) -> DataFrame:
    hit = (F.col("prediction") == F.col(target)).cast("double")
    return predictions.groupBy(*keys).agg(F.count("*").alias("rows"), F.avg(hit).alias("accuracy"))


def signal_table(predictions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Probability, class and long or flat per row."""
    long = F.col("probability") >= threshold
    return predictions.select(
        "symbol", "ts", "probability", long.cast("int").alias("predicted_class"), F.when(long, "long").otherwise("flat").alias("signal")
    )


def save(fitted: Fitted, spark: SparkSession, path: str) -> None:
    """The model as a table of one row per feature: scaler, weight and settings."""
    rows = [
        (i, c, float(fitted.scaler.means[c]), float(fitted.scaler.deviations[c]), fitted.weights[i] if fitted.weights else None, fitted.intercept, fitted.target, fitted.kind, fitted.constant)
        for i, c in enumerate(fitted.features)
    ]
    shape = "position int, feature string, mean double, deviation double, weight double, intercept double, target string, kind string, constant double"
    spark.createDataFrame(rows, shape).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Fitted:
    rows = spark.read.parquet(path).orderBy("position").collect()  # one row per feature
    scaler = Scaler({r.feature: r["mean"] for r in rows}, {r.feature: r.deviation for r in rows})
    weights = () if rows[0].constant is not None else tuple(r.weight for r in rows)
    return Fitted(tuple(r.feature for r in rows), rows[0].target, scaler, weights, rows[0].intercept, rows[0].constant, rows[0].kind)
