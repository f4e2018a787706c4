"""Suggested labels, multi-hot encoding, predictions and the text classifier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadscope import presets
from threadscope.functions.matching import contains_any, count_hits


def score_labels(df: DataFrame, text: str = "cleaned_text",
                 guidelines: Sequence[presets.Guideline] = presets.GUIDELINES_4, fallback: str = "other") -> DataFrame:
    """Add ``score_<label>`` per guideline and ``score_<fallback>``.

    Points per keyword plus bonuses, divided by the number of keywords, at most 1. The fallback scores 1 where the best
    score is weak, else null (not suggested).
    """
    raw = F.col(text)
    mark = F.when(F.coalesce(raw.contains("?"), F.lit(False)), 0.5).otherwise(0.0)
    asks = F.when(contains_any("_low", presets.WH_WORDS), 0.3).otherwise(0.0)
    scores: dict[str, Column] = {}
    for g in guidelines:
        points: Column = count_hits("_low", g.keywords).cast("double")
        if g.question_bonus:
            points = points + mark + asks
        if g.fear_bonus:
            points = points + count_hits("_low", presets.FEAR_WORDS) * 0.5
        scores[f"score_{g.label}"] = F.least(points / float(max(len(g.keywords), 1)), F.lit(1.0))
    best = F.greatest(*[F.col(c) for c in scores]) if len(scores) > 1 else F.col(next(iter(scores)))
    return (
        df.withColumn("_low", F.lower(raw)).withColumns(scores)
        .withColumn(f"score_{fallback}", F.when(best < presets.WEAK_SCORE, F.lit(1.0))).drop("_low")
    )


def auto_label(df: DataFrame, labels: Sequence[str] = presets.LABELS,
               threshold: float = presets.AUTO_LABEL_THRESHOLD) -> DataFrame:
    """Take the best suggestion above the threshold, else mark for review; rows already annotated stay as they are.

    Ties go to the label that comes first.
    """
    entries = [
        F.when(F.col(f"score_{name}").isNotNull(),
               F.struct(F.col(f"score_{name}").alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("label")))
        for i, name in enumerate(labels)
    ]
    df = df.withColumn("_best", F.array_max(F.array(*entries)))
    sure = F.coalesce(F.col("_best.score") > threshold, F.lit(False))
    fresh = {
        "labels": F.when(sure, F.col("_best.label")).otherwise("needs_review"),
        "confidence": F.when(sure, F.col("_best.score")).otherwise(0.0),
        "annotated": sure,
    }
    if "annotated" in df.columns:
        done = F.coalesce(F.col("annotated"), F.lit(False))
        fresh = {c: F.when(done, F.col(c)).otherwise(v) for c, v in fresh.items()}
    return df.withColumns(fresh).drop("_best")


def encode_multihot(df: DataFrame, column: str = "labels", labels: Sequence[str] = presets.LABELS) -> DataFrame:
    """``is_<label>`` as 0/1 from a comma-separated label string."""
    parts = F.split(F.col(column), ",")
    return df.withColumns(
        {f"is_{x}": F.coalesce(F.array_contains(parts, x), F.lit(False)).cast("int") for x in labels}
    )


def annotated_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("annotated"))


def join_predictions(posts: DataFrame, predictions: DataFrame | None, key: str = "id",
                     suffix: str = "_pred") -> DataFrame:
    """Left join on the key; names both sides have get a suffix. Without predictions the posts pass through."""
    if predictions is None:
        return posts
    renamed = predictions.select(
        *[F.col(c).alias(c + suffix if c in posts.columns and c != key else c) for c in predictions.columns]
    )
    return posts.join(renamed, key, "left")


# --- classifier ----------------------------------------------------------------------------------------------------


def train_text_classifier(df: DataFrame, tokens: str = "tokens", labels: Sequence[str] = presets.LABELS,
                          features: int = 1 << 16, max_iter: int = 20, reg: float = 0.01) -> PipelineModel:
    """One logistic regression per label over TF-IDF of the token array; needs ``is_<label>`` columns."""
    stages = [
        HashingTF(inputCol=tokens, outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_features", minDocFreq=2),
    ]
    stages += [
        LogisticRegression(
            featuresCol="_features", labelCol=f"is_{x}", maxIter=max_iter, regParam=reg,
            predictionCol=f"_p_{x}", probabilityCol=f"_prob_{x}", rawPredictionCol=f"_raw_{x}",
        )
        for x in labels
    ]
    return Pipeline(stages=stages).fit(df)


def predict(model: PipelineModel, df: DataFrame, labels: Sequence[str] = presets.LABELS,
            threshold: float = 0.5) -> DataFrame:
    """Add ``<label>_score`` and ``<label>_pred``."""
    keep = [F.col(c) for c in df.columns]
    out = model.transform(df)
    for x in labels:
        out = out.withColumn(f"{x}_score", vector_to_array(f"_prob_{x}")[1])
        out = out.withColumn(f"{x}_pred", (F.col(f"{x}_score") >= threshold).cast("int"))
    return out.select(*keep, *[f"{x}_{kind}" for x in labels for kind in ("score", "pred")])
