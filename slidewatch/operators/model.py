"""Learned alternatives: conversion-lift regression and the note classifier, with pyspark.ml."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import HashingTF, StringIndexer, StringIndexerModel, Tokenizer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidewatch.operators.gold import action_candidates, recommend, with_net_value
from slidewatch.operators.silver import note_slide_flags
from slidewatch.settings import ACTIONS, LABEL_SCORES

FEATURES = ["action_index", "matched", "conversion_at_action", "ship_cost_usd"]


def training_rows(outcomes: DataFrame) -> DataFrame:
    """Equal outcomes become one row with their number as weight: the same least-squares fit on far fewer rows."""
    rows = outcomes.groupBy(
        "action_type", "had_matching_experiment", "conversion_at_action", "ship_cost_usd", "conversion_lift"
    ).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return rows.withColumn("matched", F.col("had_matching_experiment").cast("double"))


def _stages(regressor: GBTRegressor) -> list:
    index = StringIndexerModel.from_labels(ACTIONS, inputCol="action_type", outputCol="action_index", handleInvalid="error")
    return [index, VectorAssembler(inputCols=FEATURES, outputCol="features"), regressor]


def _regressor(seed: int) -> GBTRegressor:
    return GBTRegressor(
        labelCol="conversion_lift", weightCol="weight", predictionCol="predicted", maxIter=20, maxDepth=4, seed=seed
    )


def train_lift(outcomes: DataFrame, seed: int = 42) -> PipelineModel:
    """Lift by action, match, conversion at the time and cost."""
    rows = training_rows(outcomes).persist()
    try:
        return Pipeline(stages=_stages(_regressor(seed))).fit(rows)
    finally:
        rows.unpersist()


def score_actions(model: PipelineModel, open_rows: DataFrame, scored_at: str) -> DataFrame:
    """Recommendations with the lift of the model in place of the rule; same columns as ``gold.recommendations``."""
    candidates = (
        action_candidates(open_rows)
        .drop("conversion_lift")
        .withColumn("matched", F.col("has_matching_experiment").cast("double"))
        .withColumn("conversion_at_action", F.col("conversion_rate"))
    )
    scored = model.transform(candidates).withColumn("conversion_lift", F.col("predicted"))
    return recommend(with_net_value(scored), scored_at)


def split_outcomes(outcomes: DataFrame, parts: int = 4) -> tuple[DataFrame, DataFrame]:
    """Outcomes to learn from and outcomes, one part in ``parts`` by a hash of their values, that take no part in it.

    The hash is of the values, so equal outcomes are on one side and the error is that of unseen ones.
    """
    values = ["action_type", "had_matching_experiment", "conversion_at_action", "ship_cost_usd", "conversion_lift"]
    held = F.pmod(F.xxhash64(*values), F.lit(parts)) == 0
    return outcomes.where(~held), outcomes.where(held)


def facts(recs: DataFrame, error: DataFrame, judged: DataFrame) -> DataFrame:
    """One row of checks: segments scored, options per segment, order and choice by net value, error against the spread."""
    ranking = F.col("action_ranking")
    values = F.transform(ranking, lambda o: o["net_value_usd"])
    ordered = F.forall(F.zip_with(F.slice(values, 1, F.size(values) - 1), F.slice(values, 2, F.size(values)), lambda a, b: a >= b), lambda x: x)
    first = F.get(ranking, 0)
    rows = recs.agg(
        F.count(F.lit(1)).alias("segments"), F.count("recommended_action").alias("actions"),
        F.min(F.size(ranking)).alias("least_options"), F.max(F.size(ranking)).alias("most_options"),
        F.bool_and(ordered).alias("ordered_by_net_value"),
        F.bool_and((first["action_type"] == F.col("recommended_action")) & (first["net_value_usd"] == F.col("predicted_net_value_usd"))).alias("first_is_chosen"),
    )
    spread = judged.agg(F.struct(F.stddev_pop("conversion_lift").alias("spread")))
    rmse = error.select(F.struct("rmse"))
    out = rows.withColumn("_spread", spread.scalar()).withColumn("_rmse", rmse.scalar())
    return out.withColumn("error_below_spread", F.col("_rmse.rmse") < F.col("_spread.spread")).drop("_spread", "_rmse")


def lift_metrics(model: PipelineModel, outcomes: DataFrame) -> DataFrame:
    """Weighted root mean square error over ``outcomes``, as one row; give rows that the model has not seen."""
    scored = model.transform(training_rows(outcomes))
    error = (F.col("predicted") - F.col("conversion_lift")) ** 2
    return scored.agg(
        F.sum("weight").cast("long").alias("outcomes"),
        F.sqrt(F.sum(error * F.col("weight")) / F.sum("weight")).alias("rmse"),
    )


def tune_lift(
    outcomes: DataFrame, depths: Sequence[int] = (2, 3), trees: Sequence[int] = (5, 10), rates: Sequence[float] = (0.1, 0.3, 0.5), seed: int = 42
) -> DataFrame:
    """One row per trial with its validation error, the best first. Trials run on the weighted distinct rows."""
    regressor = _regressor(seed)
    grid = (
        ParamGridBuilder()
        .addGrid(regressor.maxDepth, list(depths))
        .addGrid(regressor.maxIter, list(trees))
        .addGrid(regressor.stepSize, list(rates))
        .build()
    )
    evaluator = RegressionEvaluator(labelCol="conversion_lift", predictionCol="predicted", metricName="rmse", weightCol="weight")
    split = TrainValidationSplit(
        estimator=Pipeline(stages=_stages(regressor)), estimatorParamMaps=grid, evaluator=evaluator,
        trainRatio=0.75, parallelism=4, seed=seed,
    )
    rows = training_rows(outcomes).persist()
    try:
        fitted = split.fit(rows)
    finally:
        rows.unpersist()
    trials = [
        (int(p[regressor.maxDepth]), int(p[regressor.maxIter]), float(p[regressor.stepSize]), float(m))
        for p, m in zip(grid, fitted.validationMetrics, strict=True)
    ]
    schema = "max_depth int, trees int, step_size double, rmse double"
    return outcomes.sparkSession.createDataFrame(trials, schema).orderBy("rmse", "max_depth", "trees", "step_size")


def train_note_classifier(snapshots: DataFrame, features: int = 4096) -> PipelineModel:
    """Learns the label of a note from the rule's labels on the distinct notes."""
    notes = note_slide_flags(snapshots)
    return Pipeline(
        stages=[
            StringIndexer(inputCol="label", outputCol="label_index", stringOrderType="alphabetAsc"),
            Tokenizer(inputCol="pm_note_text", outputCol="words"),
            HashingTF(inputCol="words", outputCol="features", numFeatures=features),
            LogisticRegression(labelCol="label_index", featuresCol="features", regParam=0.01),
        ]
    ).fit(notes)


def classify_notes(model: PipelineModel, snapshots: DataFrame) -> DataFrame:
    """Distinct notes with the learned label and its score."""
    notes = snapshots.select("pm_note_text").where(F.col("pm_note_text").isNotNull()).distinct()
    labels = model.stages[0].labels
    scored = PipelineModel(model.stages[1:]).transform(notes)
    label = F.element_at(F.array(*[F.lit(x) for x in labels]), (F.col("prediction") + 1).cast("int"))
    score = F.element_at(F.array(*[F.lit(LABEL_SCORES[x]) for x in labels]), (F.col("prediction") + 1).cast("int"))
    return scored.select("pm_note_text", label.alias("label"), score.alias("slide_signal_score"))
