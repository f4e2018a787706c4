"""Multi-label classifier evaluation over a long table (id, label, y_true, y_pred, score)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadscope import presets
from threadscope.operators.ranking import running_totals, top_k_per_group

MICRO, MACRO = "micro_average", "macro_average"


def to_long(df: DataFrame, labels: Sequence[str], id_col: str = "id", true: str = "is_{}", pred: str = "{}_pred",
            score: str = "{}_score") -> DataFrame:
    """One row per id and label from one row per id."""
    return df.select(id_col, F.inline(F.array(*[
        F.struct(F.lit(x).alias("label"), F.col(true.format(x)).cast("int").alias("y_true"),
                 F.col(pred.format(x)).cast("int").alias("y_pred"),
                 F.col(score.format(x)).cast("double").alias("score"))
        for x in labels
    ])))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(df: DataFrame) -> DataFrame:
    t, p = F.col("y_true") == 1, F.col("y_pred") == 1
    return df.groupBy("label").agg(
        F.count_if(~t & ~p).alias("true_negatives"), F.count_if(~t & p).alias("false_positives"),
        F.count_if(t & ~p).alias("false_negatives"), F.count_if(t & p).alias("true_positives"),
    )


def _label_rates(df: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")
    return confusion(df).select(
        "label", _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1_score"), (tp + fn).alias("support"),
    )


def label_metrics(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per label; 0 where a denominator is 0."""
    return _label_rates(df).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1_score")})


def macro_metrics(df: DataFrame) -> DataFrame:
    """Unweighted means over the labels; support is the sum."""
    return _label_rates(df).agg(
        *[F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1_score")], F.sum("support").alias("support")
    )


def _score_counts(df: DataFrame, micro: bool) -> DataFrame:
    """Positives and negatives per label and distinct score; with ``micro`` also over all labels together."""
    rows = df
    if micro:
        rows = df.withColumn("label", F.explode(F.array(F.col("label"), F.lit(MICRO))))
    return rows.filter("score is not null").groupBy("label", "score").agg(
        F.count_if(F.col("y_true") == 1).alias("pos"), F.count_if(F.col("y_true") != 1).alias("neg")
    )


def _curve(df: DataFrame, labels: Sequence[str] | None, micro: bool) -> DataFrame:
    """Running totals of all labels of the data, or of the listed ones."""
    if labels is not None:
        df = df.filter(F.col("label").isin(*labels))
    names = None if labels is None else [*labels, MICRO] if micro else list(labels)
    return running_totals(_score_counts(df, micro), "label", names, "score", ["pos", "neg"])


def _with_macro(per_label: DataFrame, value: str) -> DataFrame:
    """Append the mean over labels (the micro row excluded)."""
    levels = per_label.rollup("label").agg(
        F.grouping("label").alias("_all"), F.max(value).alias("_v"),
        F.avg(F.when(F.col("label") != MICRO, F.col(value))).alias("_mean"),
    )
    return levels.select(
        F.when(F.col("_all") == 1, F.lit(MACRO)).otherwise(F.col("label")).alias("label"),
        F.round(F.when(F.col("_all") == 1, F.col("_mean")).otherwise(F.col("_v")), 6).alias(value),
    )


def roc_auc(df: DataFrame, labels: Sequence[str] | None = None) -> DataFrame:
    """Area under the ROC curve per label, macro and micro; 0 where only one class occurs. Ties count half."""
    d = lambda c: F.col(c).cast("double")
    sums = _curve(df, labels, micro=True).groupBy("label").agg(
        F.sum(d("pos")).alias("p"), F.sum(d("neg")).alias("n"),
        F.sum(d("pos") * d("cum_neg")).alias("ahead"), F.sum(d("pos") * d("neg")).alias("tied"),
    )
    area = (F.col("p") * F.col("n") - F.col("ahead") + F.col("tied") / 2)
    return _with_macro(sums.select("label", _ratio(area, F.col("p") * F.col("n")).alias("roc_auc")), "roc_auc")


def average_precision(df: DataFrame, labels: Sequence[str] | None = None) -> DataFrame:
    """Sum of precision times recall step over the thresholds, per label, macro and micro."""
    hit = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    sums = _curve(df, labels, micro=True).groupBy("label").agg(
        F.sum("pos").alias("p"), F.sum(F.col("pos") * hit).alias("s")
    )
    value = _ratio(F.col("s"), F.col("p"))
    return _with_macro(sums.select("label", value.alias("average_precision")), "average_precision")


def _with_totals(curve: DataFrame, counts: DataFrame) -> DataFrame:
    """Positives and negatives per label beside each point, from the counts per score; the curve is built once."""
    totals = counts.groupBy("label").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return curve.join(totals, "label")


def roc_points(df: DataFrame, labels: Sequence[str] | None = None) -> DataFrame:
    """False and true positive rate at each distinct score used as threshold."""
    return _with_totals(_curve(df, labels, micro=False), _score_counts(df, micro=False)).select(
        "label", F.round("score", 6).alias("threshold"),
        F.round(_ratio(F.col("cum_neg"), F.col("n")), 6).alias("fpr"),
        F.round(_ratio(F.col("cum_pos"), F.col("p")), 6).alias("tpr"),
    )


def pr_points(df: DataFrame, labels: Sequence[str] | None = None) -> DataFrame:
    """Precision and recall at each distinct score used as threshold."""
    return _with_totals(_curve(df, labels, micro=False), _score_counts(df, micro=False)).select(
        "label", F.round("score", 6).alias("threshold"),
        F.round(F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")), 6).alias("precision"),
        F.round(_ratio(F.col("cum_pos"), F.col("p")), 6).alias("recall"),
    )


def class_imbalance(df: DataFrame) -> DataFrame:
    counts = df.groupBy("label").agg(
        F.count_if(F.col("y_true") == 1).alias("positive_count"), F.count(F.lit(1)).alias("total_count")
    )
    pos, total = F.col("positive_count"), F.col("total_count")
    return counts.withColumns({
        "positive_ratio": F.round(_ratio(pos, total), 6),
        "imbalance_ratio": F.round(
            F.coalesce(F.try_divide(total - pos, pos), F.lit(float("inf"))), 6),
    })


def error_cases(df: DataFrame) -> DataFrame:
    """All false positives and false negatives as (label, kind, id)."""
    return df.filter("y_true != y_pred").select(
        "label", F.when(F.col("y_pred") == 1, "false_positive").otherwise("false_negative").alias("kind"), "id"
    )


def error_counts(df: DataFrame) -> DataFrame:
    return error_cases(df).groupBy("label", "kind").agg(F.count(F.lit(1)).alias("n"))


def error_examples(df: DataFrame, texts: DataFrame, k: int = 5, text: str = "text") -> DataFrame:
    """The first k cases by id with their text. The cases are cut to k per label and kind before the join."""
    first = top_k_per_group(error_cases(df), ["label", "kind"], [F.col("id")], k)
    return first.join(texts.select("id", text), "id", "left").select("label", "kind", "rank", "id", text)


def label_ranking(df: DataFrame) -> DataFrame:
    """Labels by F1, best first; ``is_best`` and ``is_worst`` mark the ends."""
    ranked = _label_rates(df)
    every = Window.partitionBy(F.lit(1))
    order = every.orderBy(F.desc("f1_score"), "label")
    return ranked.select(
        F.row_number().over(order).alias("rank"), "label", F.round("f1_score", 6).alias("f1_score"),
        (F.row_number().over(order) == 1).alias("is_best"),
        (F.row_number().over(order) == F.count(F.lit(1)).over(every)).alias("is_worst"),
    )


def annotation_quality(df: DataFrame, labels: Sequence[str] = presets.LABELS, substring: bool = False) -> DataFrame:
    """Tidy (metric, subject, value) over annotated rows: count, coverage, confidence, rows per label.

    ``substring`` matches a label anywhere in the label string, so ``fear`` also counts ``fear_driven_question``.
    """
    done = F.col("annotated")
    conf = F.when(done, F.col("confidence"))

    def hit(label: str) -> Column:
        if substring:
            return F.col("labels").contains(label)
        return F.array_contains(F.split("labels", ","), label)

    entries: list[tuple[str, str, Column]] = [
        ("total_annotated", "", F.count_if(done)), ("coverage", "", F.avg(done.cast("int"))),
        ("confidence", "mean", F.avg(conf)), ("confidence", "std", F.stddev_samp(conf)),
        ("confidence", "min", F.min(conf)), ("confidence", "max", F.max(conf)),
    ]
    entries += [("label_rows", x, F.count_if(done & hit(x))) for x in labels]
    one = df.agg(*[v.cast("double").alias(f"_{i}") for i, (_, _, v) in enumerate(entries)])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.lit(s).alias("subject"), F.round(F.col(f"_{i}"), 6).alias("value"))
        for i, (m, s, _) in enumerate(entries)
    ])))
