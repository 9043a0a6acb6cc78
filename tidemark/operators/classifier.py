"""A binary text classifier per theme with MLlib, and its thresholded predictions."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, RegexTokenizer, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a regression is fitted on at most, drawn by hash of the identifier; vocabulary and document frequencies are of all rows.
FIT_ROWS = 20_000


def features(vocabulary: int = 20_000, min_docs: int = 3) -> Pipeline:
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[a-z0-9]+(?:'[a-z]+)?", gaps=False),
            StopWordsRemover(inputCol="words", outputCol="kept"),
            CountVectorizer(inputCol="kept", outputCol="counts", vocabSize=vocabulary, minDF=min_docs),
            IDF(inputCol="counts", outputCol="features", minDocFreq=min_docs),
        ]
    )


def train(rows: DataFrame, themes: list[str]) -> tuple[PipelineModel, dict]:
    """``rows`` is (id, text, themes); text may be null.  A theme without both classes has no model."""
    every = rows.withColumn("text", F.coalesce("text", F.lit("")))
    encoder = features().fit(every)
    fit = every.orderBy(F.xxhash64("id")).limit(FIT_ROWS).checkpoint()
    coded = encoder.transform(fit).select("themes", "features").checkpoint()
    models = {}
    for t in themes:
        labelled = coded.withColumn("label", F.array_contains("themes", t).cast("double"))
        if labelled.select("label").distinct().count() == 2:
            models[t] = LogisticRegression(regParam=0.05, elasticNetParam=0.0, maxIter=30).fit(labelled)
    return encoder, models


def predict(rows: DataFrame, encoder: PipelineModel, models: dict, cuts: dict[str, float]) -> DataFrame:
    """(id, theme, score, predicted) of every row and theme."""
    coded = encoder.transform(rows.withColumn("text", F.coalesce("text", F.lit("")))).select("id", "features")
    for t, m in models.items():
        coded = m.setProbabilityCol("_p").setRawPredictionCol("_r").setPredictionCol("_l").transform(coded).withColumn(f"s_{t}", vector_to_array("_p")[1]).drop("_p", "_r", "_l")
    scores = F.explode(F.array(*(F.struct(F.lit(t).alias("theme"), F.col(f"s_{t}").alias("score"), F.lit(cuts.get(t, 0.5)).alias("cut")) for t in models))).alias("s")
    return coded.select("id", scores).select("id", "s.theme", "s.score", (F.col("s.score") >= F.col("s.cut")).alias("predicted"))
