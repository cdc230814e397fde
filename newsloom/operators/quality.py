"""Quality model: a random forest on six text features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.scale import cut_lineage
from newsloom.functions.text import FEATURES, col, quality_features, words

# Fixed values of the training set: odds of the kinds of damage (0.33, then 0.66 of a second
# draw), shares and sizes.
CUT_ODDS, SHUFFLE_ODDS = 0.33, 0.66
CUT_SHARE, SHUFFLE_SHARE = 0.2, 0.5
SAMPLED_WORDS, REPEATS = 20, 3


def _draw(seed: int, *parts) -> Column:
    """Uniform number in [0, 1) that depends on the row and the seed only."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1_000_000)) / 1_000_000


def training_positives(samples: DataFrame) -> DataFrame:
    """`id, text, label`: every sample with content, label 1."""
    return samples.where("article_content <> ''").select(
        "id", F.col("article_content").alias("text"), F.lit(1.0).alias("label")
    )


def damaged_negatives(positives: DataFrame, *, limit: int = 30, seed: int = 42) -> DataFrame:
    """`id, text, label, damage`: damaged copies of the first `limit` samples, label 0."""
    w = words("text")
    row = F.col("id")
    cut = F.substring("text", F.lit(1), F.floor(F.length("text") * CUT_SHARE).cast("int"))
    shuffled = F.transform(
        F.array_sort(F.transform(w, lambda x, i: F.struct(F.xxhash64(F.lit(seed), row, i).alias("h"), x.alias("w")))),
        lambda s: s["w"],
    )
    half = F.array_join(F.slice(shuffled, F.lit(1), F.floor(F.size(w) * SHUFFLE_SHARE).cast("int")), " ")
    picks = F.sequence(F.lit(1), F.least(F.size(w), F.lit(SAMPLED_WORDS)))
    sampled = F.transform(
        picks, lambda i: F.get(w, F.pmod(F.xxhash64(F.lit(seed + 1), row, i), F.size(w)).cast("int"))
    )
    repeated = F.when(F.size(w) > 0, F.repeat(F.array_join(sampled, " "), F.lit(REPEATS))).otherwise("")
    kind = (
        F.when(_draw(seed, row, F.lit(1)) < CUT_ODDS, "cut")
        .when(_draw(seed, row, F.lit(2)) < SHUFFLE_ODDS, "shuffled")
        .otherwise("repeated")
    )
    first = positives.orderBy("id").limit(limit)
    return first.select(
        "id",
        F.when(kind == "cut", cut).when(kind == "shuffled", half).otherwise(repeated).alias("text"),
        F.lit(0.0).alias("label"),
        kind.alias("damage"),
    )


def training_set(samples: DataFrame, *, max_negatives: int = 30, seed: int = 42) -> DataFrame:
    """`id, label, is_test` and the six features of positives and negatives."""
    good = training_positives(samples)
    rows = good.unionByName(damaged_negatives(good, limit=max_negatives, seed=seed).drop("damage"))
    # one in five rows by a hash of the row: the same split on every run and cluster
    is_test = _draw(seed, F.col("id"), F.col("label")) < 0.2
    return rows.select("id", "label", is_test.alias("is_test"), *quality_features("text"))


@dataclass
class QualityModel:
    model: PipelineModel
    accuracy: float
    f1: float
    predictions: DataFrame

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)


def train_quality_model(
    samples: DataFrame, *, trees: int = 50, seed: int = 42, min_samples: int = 10, max_negatives: int = 30
) -> QualityModel | None:
    """Fit and evaluate the forest; None with fewer than `min_samples` positives."""
    if training_positives(samples).limit(min_samples).count() < min_samples:
        return None
    rows = cut_lineage(training_set(samples, max_negatives=max_negatives, seed=seed))
    pipeline = Pipeline(stages=[
        VectorAssembler(inputCols=FEATURES, outputCol="features"),
        RandomForestClassifier(numTrees=trees, seed=seed, featuresCol="features", labelCol="label"),
    ])
    model = pipeline.fit(rows.where("not is_test"))
    predictions = model.transform(rows.where("is_test"))
    accuracy = MulticlassClassificationEvaluator(metricName="accuracy").evaluate(predictions)
    f1 = MulticlassClassificationEvaluator(metricName="fMeasureByLabel", metricLabel=1.0).evaluate(predictions)
    return QualityModel(model, accuracy, f1, predictions.select("id", "label", "prediction"))


def prediction_metrics(predictions: DataFrame) -> DataFrame:
    """One row: accuracy and F1 of class 1."""
    hit = F.count_if(F.col("label") == F.col("prediction"))
    tp = F.count_if((F.col("label") == 1) & (F.col("prediction") == 1))
    wrong = F.count_if(F.col("label") != F.col("prediction"))
    return predictions.agg(
        F.try_divide(hit, F.count(F.lit(1))).alias("accuracy"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + wrong), F.lit(0.0)).alias("f1"),
    )


def load_quality_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def with_model_quality(rows: DataFrame, model: PipelineModel, *, text: Column | str, name: str) -> DataFrame:
    """`rows` with column `name`: probability of class 1 for `text`; empty text scores 0."""
    t = F.coalesce(col(text), F.lit(""))
    p = F.get(vector_to_array("probability"), F.lit(1))
    scored = model.transform(rows.select("*", (t == "").alias("_blank"), *quality_features(t)))
    return scored.select(*rows.columns, F.when(F.col("_blank"), 0.0).otherwise(p).alias(name))


def score_quality(content: DataFrame, model: PipelineModel, *, text: str = "content") -> DataFrame:
    """`id, extraction_quality`: probability of class 1; empty text scores 0."""
    rows = content.select("id", F.col(text).alias("_text"))
    return with_model_quality(rows, model, text="_text", name="extraction_quality").drop("_text")
