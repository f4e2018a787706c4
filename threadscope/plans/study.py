"""The research run: sampling, cleaning, description, labelling, training, evaluation, time reports.

Each step writes its table below one folder; a step that is not selected is read back from there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadscope import presets
from threadscope.functions import timeparts
from threadscope.operators import cleaning, describe, evaluation, labelling, lookup, sampling, tagging, temporal, topics
from threadscope.operators import words as word_ops
from threadscope.sources import writers

STEPS = ("sampling", "cleaning", "descriptive", "annotation", "training", "evaluation", "temporal")


class MissingStage(RuntimeError):
    """A step needs the output of another one that was neither selected nor saved."""


@dataclass
class StageStore:
    """Stage tables below a shared folder."""

    spark: SparkSession
    root: str

    def path(self, stage: str) -> str:
        return f"{self.root.rstrip('/')}/{stage}"

    def save(self, stage: str, df: DataFrame) -> DataFrame:
        """Write a stage and continue from the written table, so a lost executor costs one stage at most."""
        writers.write_parquet(df, self.path(stage), mode="overwrite")
        return self.spark.read.parquet(self.path(stage))

    def load(self, stage: str) -> DataFrame:
        try:
            df = self.spark.read.parquet(self.path(stage))
        except AnalysisException as exc:
            raise MissingStage(f"stage {stage!r} has no saved output; run it first") from exc
        if df.limit(1).isEmpty():
            raise MissingStage(f"the saved output of stage {stage!r} is empty")
        return df

    def load_or_run(self, stage: str, build: Callable[[], DataFrame], selected: bool) -> DataFrame:
        return self.save(stage, build()) if selected else self.load(stage)


@dataclass(frozen=True)
class StudySettings:
    file_rate: float = presets.SAMPLE_RATE
    min_rows_per_file: int = presets.MIN_ROWS_PER_FILE
    stratum_rate: float = presets.SAMPLE_RATE
    oversample_rare: bool = True
    annotation_rows: int = 1000
    topics: int = 10
    topic_iterations: int = 100
    events: tuple[presets.PolicyEvent, ...] = presets.POLICY_EVENTS
    windows: Mapping[str, int] = field(default_factory=lambda: dict(presets.WINDOWS))
    polarity: Mapping[str, float] = field(default_factory=lambda: dict(presets.POLARITY_STARTER))


def draw_sample(posts: DataFrame, store: StageStore, settings: StudySettings = StudySettings()) -> DataFrame:
    """Duplicates out first, then the per-file sample, stage tags, the stratified sample and the extra rare rows.

    Each draw reads its input more than once, so what it draws from is saved before.
    """
    rows = store.save("sampling_unique", cleaning.dedupe(posts, ("text", "subreddit"), ("created_utc", "id")))
    rows = sampling.sample_per_file_rate(rows, settings.file_rate, settings.min_rows_per_file)
    rows = rows.withColumn("created_ts", timeparts.epoch_to_timestamp(F.col("created_utc")))
    rows = tagging.flag_rare(tagging.assign_stage(rows)).withColumn("month", F.month("created_ts"))
    rows = store.save("sampling_tagged", rows)
    strata = sampling.stratified_sample(rows, rate=settings.stratum_rate)
    if not settings.oversample_rare:
        return strata
    return sampling.union_samples(strata, sampling.oversample(rows, F.col("is_rare_event")))


def polarity_table(spark: SparkSession, polarity: Mapping[str, float]) -> DataFrame:
    return spark.createDataFrame(list(polarity.items()), "token string, polarity double")


def descriptive_reports(cleaned: DataFrame, store: StageStore,
                        settings: StudySettings = StudySettings()) -> dict[str, DataFrame]:
    spark = cleaned.sparkSession
    # A post drawn several times appears once per draw, so the pair is the row's name.
    draw = F.col("draw").cast("string") if "draw" in cleaned.columns else F.lit(None).cast("string")
    named = cleaned.withColumn("_row", F.concat_ws("/", F.col("id"), F.coalesce(draw, F.lit("-"))))
    scored = store.save(
        "sentiment", lookup.score_sentiment(named, polarity_table(spark, settings.polarity), "_row").drop("_row")
    )
    model = topics.fit_topics(cleaned, settings.topics, settings.topic_iterations)
    assigned = topics.assign_topics(cleaned, model).select("id", "dominant_topic", "topic_confidence")
    return {
        "top_words": word_ops.top_words(cleaned),
        "stage_words": word_ops.top_words_by(cleaned, "visa_stage", 20, min_count=3),
        "group_words": word_ops.top_words_by(
            word_ops.within_largest(cleaned, "subreddit", 10), "subreddit", 15, min_count=2, skip=()),
        "word_totals": word_ops.word_totals(cleaned),
        "time_distribution": describe.time_distribution(cleaned),
        "stage_time": describe.time_distribution_by(cleaned, "visa_stage"),
        "date_range": describe.date_range(cleaned),
        "group_counts": describe.value_counts(cleaned, "subreddit"),
        "group_profile": describe.group_profile(cleaned),
        "sentiment": describe.sentiment_summary(scored),
        "stage_sentiment": describe.sentiment_by(scored, "visa_stage"),
        "group_sentiment": describe.sentiment_by(scored, "subreddit", (), 10),
        "topic_terms": topics.topic_terms(model),
        "topic_distribution": topics.topic_distribution(assigned),
        "stage_group_edges": describe.cooccurrence_edges(cleaned, "subreddit", "visa_stage"),
        "cleaning_summary": cleaning.cleaning_summary(cleaned),
    }


def temporal_reports(cleaned: DataFrame, settings: StudySettings = StudySettings()) -> dict[str, DataFrame]:
    metrics = temporal.period_metrics(temporal.event_windows(cleaned, settings.events, settings.windows))
    changes = temporal.period_changes(metrics)
    return {
        "period_metrics": metrics, "period_changes": changes,
        "impact_matrix": temporal.impact_matrix(changes, list(settings.windows)),
        "significant_changes": temporal.significant_changes(changes),
        "seasonal": temporal.seasonal(cleaned), "daily_anomalies": temporal.daily_anomalies(cleaned),
        "weekly_anomalies": temporal.weekly_anomalies(cleaned), "peak": temporal.peak(cleaned),
        "group_time": describe.time_distribution_by(cleaned, "subreddit", skip=(), largest=10),
    }


def evaluation_reports(long: DataFrame) -> dict[str, DataFrame]:
    return {
        "label_metrics": evaluation.label_metrics(long), "macro_metrics": evaluation.macro_metrics(long),
        "confusion": evaluation.confusion(long), "roc_auc": evaluation.roc_auc(long),
        "average_precision": evaluation.average_precision(long), "class_imbalance": evaluation.class_imbalance(long),
        "error_counts": evaluation.error_counts(long), "label_ranking": evaluation.label_ranking(long),
        "roc_points": evaluation.roc_points(long), "pr_points": evaluation.pr_points(long),
    }


def run_study(posts: DataFrame, root: str, steps: Iterable[str] = STEPS,
              settings: StudySettings = StudySettings()) -> list[str]:
    """Run the selected steps over a raw post table (id, text, subreddit, author, created_utc, source_file).

    Returns the names of the tables written below ``root``.
    """
    chosen = set(steps)
    if unknown := chosen - set(STEPS):
        raise ValueError(f"unknown steps: {sorted(unknown)}")
    store = StageStore(posts.sparkSession, root)
    written: list[str] = []

    def reports(step: str, tables: Mapping[str, DataFrame]) -> None:
        for name, table in tables.items():
            writers.write_report(table, store.path(f"reports/{step}/{name}"), mode="overwrite")
            written.append(f"reports/{step}/{name}")

    sampled = cleaned = annotated = None
    if chosen & {"sampling", "cleaning"}:
        sampled = store.load_or_run("sampling", lambda: draw_sample(posts, store, settings), "sampling" in chosen)
    if chosen & {"cleaning", "descriptive", "annotation", "training", "evaluation", "temporal"}:
        cleaned = store.load_or_run(
            "cleaning",
            lambda: cleaning.drop_invalid(cleaning.preprocess(cleaning.fill_missing(sampled))), "cleaning" in chosen
        )
    if "descriptive" in chosen:
        reports("descriptive", descriptive_reports(cleaned, store, settings))
    if chosen & {"annotation", "training", "evaluation"}:
        annotated = store.load_or_run("annotation", lambda: annotate(cleaned, store, settings), "annotation" in chosen)
    if chosen & {"training", "evaluation"}:
        scored = store.load_or_run("training", lambda: train_and_score(annotated), "training" in chosen)
        if "evaluation" in chosen:
            reports("evaluation", evaluation_reports(evaluation.to_long(scored, presets.LABELS)))
    if "temporal" in chosen:
        reports("temporal", temporal_reports(cleaned, settings))
    return written


def annotate(cleaned: DataFrame, store: StageStore, settings: StudySettings = StudySettings()) -> DataFrame:
    """Draw rows to annotate (each post once, however often it was drawn) and label the clear ones."""
    once = store.save("annotation_pool", cleaning.dedupe(cleaned.drop("draw"), ("id",), ("created_utc", "text")))
    drawn = sampling.annotation_sample(once, settings.annotation_rows)
    return labelling.auto_label(labelling.score_labels(drawn))


def train_and_score(annotated: DataFrame) -> DataFrame:
    """Train on the training part of the annotated rows and score the validation part."""
    rows = labelling.encode_multihot(labelling.annotated_only(annotated))
    rows = sampling.first_positive(rows, [f"is_{x}" for x in presets.LABELS])
    rows = sampling.stratified_split(rows, "stratum")
    model = labelling.train_text_classifier(rows.filter("split = 'train'"))
    return labelling.predict(model, rows.filter("split = 'validation'"))
