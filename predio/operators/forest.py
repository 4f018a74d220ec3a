"""Random forest search over the whole table with Spark ML."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame

from predio.operators.moments import check_features, complete_rows
from predio.operators.splits import hash_folds
from predio.schema import KEY, TARGET, require_columns

SEED = 42
FOLDS = 3
PARALLELISM = 4
# A small default grid; pass larger lists to search more.
TREES = (20,)
DEPTHS = (6, 8)
LEAF_ROWS = (1,)
FEATURE_SUBSETS = ("all",)


@dataclass(frozen=True)
class ForestModel:
    features: list[str]
    pipeline: PipelineModel
    scores: list[tuple[dict, float]]

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        require_columns(df, self.features)
        return (
            self.pipeline.transform(df)
            .drop("_features")
            .withColumnRenamed("prediction", prediction)
        )

    def importances(self, spark) -> DataFrame:
        """``(feature, importance)``, least important first."""
        values = self.pipeline.stages[-1].featureImportances.toArray().tolist()
        rows = list(zip(self.features, values))
        return spark.createDataFrame(rows, "feature string, importance double").orderBy(
            "importance", "feature"
        )


def search_forest(
    train: DataFrame,
    features: list[str],
    label: str = TARGET,
    trees=TREES,
    depths=DEPTHS,
    leaf_rows=LEAF_ROWS,
    feature_subsets=FEATURE_SUBSETS,
    folds: int = FOLDS,
    key: str = KEY,
) -> ForestModel:
    """Grid search by R² on hash folds, best combination refitted on all of ``train``.

    ``feature_subsets``: ``all`` uses every feature at each split, ``log2`` a random few.
    There is no minimum number of rows to split a node; ``leaf_rows`` bounds the leaves.
    """
    features = check_features(train, features, label)
    rows = hash_folds(complete_rows(train.select(key, *features, label), features, label), folds, key)
    rows = rows.drop(key).persist()
    try:
        assembler = VectorAssembler(inputCols=features, outputCol="_features")
        forest = RandomForestRegressor(featuresCol="_features", labelCol=label, seed=SEED)
        grid = (
            ParamGridBuilder()
            .addGrid(forest.numTrees, list(trees))
            .addGrid(forest.featureSubsetStrategy, list(feature_subsets))
            .addGrid(forest.maxDepth, list(depths))
            .addGrid(forest.minInstancesPerNode, list(leaf_rows))
            .build()
        )
        pipeline = Pipeline(stages=[assembler, forest])
        if len(grid) == 1:
            return ForestModel(features, pipeline.copy(grid[0]).fit(rows), [])
        search = CrossValidator(
            estimator=pipeline,
            estimatorParamMaps=grid,
            evaluator=RegressionEvaluator(labelCol=label, metricName="r2"),
            numFolds=folds,
            foldCol="fold",
            parallelism=PARALLELISM,
        ).fit(rows)
        scores = [
            ({p.name: v for p, v in params.items()}, score)
            for params, score in zip(grid, search.avgMetrics)
        ]
        return ForestModel(features, search.bestModel, scores)
    finally:
        rows.unpersist()
