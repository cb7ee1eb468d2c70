"""Model fit, selection and scoring with Spark ML."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil import fixed_values as fv
from vigil.functions import scalars as S
from vigil.operators import evaluate as E
from vigil.operators.contracts import require_columns, validate_features
from vigil.session import materialize


@dataclass
class Contract:
    """What a scorer needs to know about a model, stored beside it."""

    kind: str
    target: str
    features: list[str]
    medians: dict[str, float] = field(default_factory=dict)
    indicators: list[str] = field(default_factory=list)
    prior: float | None = None
    threshold: float | None = None
    version: str = "1"
    calibration: dict = field(default_factory=lambda: {"coef": 1.0, "intercept": 0.0})

    def check(self) -> Contract:
        validate_features(self.features)
        if self.target not in fv.HORIZON_HOURS:
            raise ValueError(f"unknown target: {self.target}")
        return self


@dataclass
class Fitted:
    contract: Contract
    pipeline: PipelineModel | None


def _filled(df: DataFrame, contract: Contract) -> DataFrame:
    """Finite features with the training median for gaps, and flags of the gaps."""
    value = {f: S.finite_or_null(F.col(f).cast("double")) for f in contract.features}
    cells = {
        f"x_{f}": F.coalesce(value[f], F.lit(contract.medians.get(f, 0.0)))
        for f in contract.features
    }
    for f in contract.indicators:
        cells[f"gap_{f}"] = F.when(value[f].isNull(), F.lit(1.0)).otherwise(F.lit(0.0))
    return df.withColumns(cells)


def _learn_gaps(train: DataFrame, features: Sequence[str]) -> tuple[dict[str, float], list[str]]:
    """Medians and the features with gaps: one aggregation, one row back."""
    value = {f: S.finite_or_null(F.col(f).cast("double")) for f in features}
    cells = []
    for f in features:
        cells.append(F.percentile_approx(value[f], 0.5, 10000).alias(f"m_{f}"))
        cells.append(S.count_if(value[f].isNull()).alias(f"g_{f}"))
    row = train.agg(*cells).first()
    medians = {f: float(row[f"m_{f}"]) if row[f"m_{f}"] is not None else 0.0 for f in features}
    return medians, [f for f in features if row[f"g_{f}"]]


def fit(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    kind: str,
    weight: str | None = None,
    iterations: int = 20,
    depth: int = 5,
    seed: int = 42,
) -> Fitted:
    """Fit ``prior``, ``logistic`` or ``trees`` on the training rows."""
    names = list(features)
    require_columns(train, [*names, label, *([weight] if weight else [])])
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    if weight:
        bad = train.where(~F.coalesce(S.is_finite(w) & (w > 0), F.lit(False))).limit(1).count()
        if bad:
            raise ValueError("weights have to be positive and finite")
    if kind == "prior":
        mean = train.agg((F.sum(w * F.col(label)) / F.sum(w)).alias("p")).first()["p"]
        return Fitted(Contract(kind, label, names, prior=float(mean)).check(), None)
    medians, gaps = _learn_gaps(train, names)
    contract = Contract(kind, label, names, medians, gaps).check()
    columns = [f"x_{f}" for f in names] + [f"gap_{f}" for f in gaps]
    assembler = VectorAssembler(inputCols=columns, outputCol="_raw")
    if kind == "logistic":
        stages = [
            assembler,
            StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True),
            LogisticRegression(
                featuresCol="_x",
                labelCol="_y",
                weightCol="_w",
                maxIter=iterations,
                regParam=1e-4,
                probabilityCol="_p",
                rawPredictionCol="_margin",
                predictionCol="_class",
            ),
        ]
    elif kind == "trees":
        stages = [
            assembler,
            GBTClassifier(
                featuresCol="_raw",
                labelCol="_y",
                weightCol="_w",
                maxIter=iterations,
                maxDepth=depth,
                stepSize=0.1,
                seed=seed,
                predictionCol="_class",
            ).setProbabilityCol("_p").setRawPredictionCol("_margin"),
        ]
    else:
        raise ValueError(f"unknown model kind: {kind}")
    rows = _filled(train, contract).withColumns({"_y": F.col(label).cast("double"), "_w": w})
    pipeline = Pipeline(stages=stages).fit(rows.select(*columns, "_y", "_w"))
    return Fitted(contract, pipeline)


def probability(df: DataFrame, fitted: Fitted, name: str = "probability") -> DataFrame:
    """Rows with the model's probability of the positive class."""
    contract = fitted.contract
    require_columns(df, contract.features)
    if fitted.pipeline is None:
        return df.withColumn(name, F.lit(contract.prior))
    scored = fitted.pipeline.transform(_filled(df, contract))
    raw = vector_to_array(F.col("_p"))[1]
    calibration = contract.calibration
    identity = calibration["coef"] == 1.0 and calibration["intercept"] == 0.0
    value = raw if identity else E.apply_calibration(raw, calibration)
    return scored.withColumn(name, value).select(*df.columns, name)


def score(df: DataFrame, fitted: Fitted, eligible: str = "eligible") -> DataFrame:
    """Probability, alert and status; rows that are not eligible stay unscored.

    The model is applied to the eligible rows only and the others are added
    back with NULLs, so no row is lost and none is scored in vain.
    """
    contract = fitted.contract
    if contract.threshold is None:
        raise ValueError("the model has no threshold")
    low, high = fv.HORIZON_HOURS[contract.target]
    ok = F.coalesce(F.col(eligible), F.lit(False))
    done = probability(df.where(ok), fitted, "risk_probability")
    rest = df.where(~ok).withColumn("risk_probability", F.lit(None).cast("double"))
    both = done.unionByName(rest)
    t = F.col("prediction_time")
    p = F.col("risk_probability")
    return both.withColumns(
        {
            "alert": p >= F.lit(contract.threshold),
            "status": F.when(p.isNull(), F.lit("not_eligible")).otherwise(F.lit("scored")),
            "model_version": F.lit(contract.version),
            "target_start": t + F.expr(f"interval {low} hours"),
            "target_end": t + F.expr(f"interval {high} hours"),
        }
    )


def fit_select(
    splits: dict[str, DataFrame],
    features: Sequence[str],
    label: str,
    kinds: Sequence[str] = ("logistic", "trees"),
    weight: str | None = None,
    policy: str = "joint_recall",
    **options: int,
) -> tuple[Fitted, list[dict]]:
    """Fit each kind, choose by AP on validation, look at test once."""
    results, models = [], {}
    for kind in kinds:
        fitted = fit(splits["train"], features, label, kind, weight, **options)
        scored = probability(splits["validation"], fitted)
        held = weight if weight and weight in scored.columns else None
        curve = E.pr_curve(scored, label, "probability", held).cache()
        rank = E.ranking_metrics(curve).first()
        best = E.select_threshold(curve, policy).first()
        curve.unpersist()
        fitted.contract.threshold = float(best["threshold"])
        models[kind] = fitted
        results.append({"kind": kind, **rank.asDict(), **best.asDict()})
    winner = max(results, key=lambda r: r["average_precision"])
    chosen = models[winner["kind"]]
    if "test" in splits:
        scored = probability(splits["test"], chosen)
        held = weight if weight and weight in scored.columns else None
        row = E.metrics(scored, label, "probability", chosen.contract.threshold, held).first()
        results.append({"kind": winner["kind"], "split": "test", **row.asDict()})
    return chosen, results


def evaluate_once(df: DataFrame, fitted: Fitted, label: str, allow_test: bool = False) -> DataFrame:
    """Key, label, probability and decision on the test rows, behind an explicit gate."""
    if not allow_test:
        raise PermissionError("pass allow_test=True for the one final evaluation")
    level = fitted.contract.threshold
    scored = probability(df, fitted)
    return scored.select(
        "channel_id",
        "prediction_time",
        F.col(label).alias("y_true"),
        "probability",
        (F.col("probability") >= F.lit(level)).cast("int").alias("prediction"),
        F.lit(level).alias("threshold"),
    )


def out_of_fold(
    folds: DataFrame,
    years: Sequence[int],
    features: Sequence[str],
    label: str,
    kind: str = "logistic",
    weight: str | None = None,
) -> DataFrame:
    """Out-of-fold probabilities: one fit per fold, all folds under one another.

    The folds are opened once: the inputs of the fits and the rows to score are
    written, so each pass of a fit reads its few columns and nothing is opened
    again.
    """
    inputs = dict.fromkeys(["fold", *features, label, *([weight] if weight else [])])
    train = materialize(folds.where(F.col("role") == "train").select(*inputs), "fold-training")
    held = materialize(folds.where(F.col("role") == "validation"), "fold-validation")
    parts = []
    for year in years:
        mine = F.col("fold") == year
        fitted = fit(train.where(mine), features, label, kind, weight)
        parts.append(probability(held.where(mine), fitted))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def importance(spark: SparkSession, fitted: Fitted) -> DataFrame:
    """Importance of the inputs of a tree model, gap flags included."""
    contract = fitted.contract
    names = list(contract.features) + [f"gap_{f}" for f in contract.indicators]
    values = fitted.pipeline.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(names, values)), "feature string, gain double")


def largest_difference(left: DataFrame, right: DataFrame, keys: list[str], column: str) -> Column:
    """Largest gap between two scorings of the same keys, as a one-row table."""
    a = left.select(*keys, F.col(column).alias("_a"))
    b = right.select(*keys, F.col(column).alias("_b"))
    both = a.join(b, keys, "full")
    missing = S.count_if(F.col("_a").isNull() != F.col("_b").isNull())
    return both.agg(
        F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_difference"),
        missing.alias("unmatched"),
    )


def save(spark: SparkSession, fitted: Fitted, path: str) -> None:
    if fitted.pipeline is not None:
        fitted.pipeline.write().overwrite().save(f"{path}/pipeline")
    text = json.dumps(asdict(fitted.contract), ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").write.mode("overwrite").text(f"{path}/contract")


def load(spark: SparkSession, path: str, features: Sequence[str] | None = None) -> Fitted:
    """A stored model; refuses one whose features differ in names or order."""
    contract = Contract(**json.loads(spark.read.text(f"{path}/contract").first()["value"])).check()
    if features is not None and list(features) != contract.features:
        raise ValueError("the features differ from the model's features or their order")
    pipeline = None if contract.kind == "prior" else PipelineModel.load(f"{path}/pipeline")
    return Fitted(contract, pipeline)
