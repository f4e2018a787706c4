"""H1–H11."""

from threadscope import presets
from threadscope.catalog import sql as S
from threadscope.catalog.fixtures import EVAL_LABELS, eval_long, labelled, table
from threadscope.catalog.registry import query
from threadscope.catalog.labelling import LABELLED
from threadscope.operators import evaluation
from pyspark.sql import functions as F

CONFUSION = f"""{S.EVAL}, c as (select label, count(*) filter (where y_true = 0 and y_pred = 0) as true_negatives,
  count(*) filter (where y_true = 0 and y_pred = 1) as false_positives,
  count(*) filter (where y_true = 1 and y_pred = 0) as false_negatives,
  count(*) filter (where y_true = 1 and y_pred = 1) as true_positives from eval_long group by 1)"""
RATES = f"""{CONFUSION}, r as (select label, coalesce(true_positives / nullif(true_positives + false_positives, 0), 0) as precision,
  coalesce(true_positives / nullif(true_positives + false_negatives, 0), 0) as recall,
  coalesce(2 * true_positives / nullif(2 * true_positives + false_positives + false_negatives, 0), 0) as f1_score,
  true_positives + false_negatives as support from c)"""


@query("label_metrics", f"""with {RATES} select label, round(precision, 6) as precision, round(recall, 6) as recall,
  round(f1_score, 6) as f1_score, support from r""")
def label_metrics(spark, sf):
    return evaluation.label_metrics(eval_long(spark, sf))


@query("macro_metrics", f"""with {RATES} select round(avg(precision), 6) as precision, round(avg(recall), 6) as recall,
  round(avg(f1_score), 6) as f1_score, cast(sum(support) as bigint) as support from r""")
def macro_metrics(spark, sf):
    return evaluation.macro_metrics(eval_long(spark, sf))


@query("confusion", f"with {CONFUSION} select * from c")
def confusion(spark, sf):
    return evaluation.confusion(eval_long(spark, sf))


WITH_MICRO = f"{S.EVAL}, e as (select * from eval_long union all select * replace ('micro_average' as label) from eval_long)"
SCORED = """s as (select label, score, sum(y_true) as pos, sum(1 - y_true) as neg from e group by 1, 2),
cum as (select *, sum(pos) over w as cp, sum(neg) over w as cn, sum(pos) over (partition by label) as p,
  sum(neg) over (partition by label) as n from s window w as (partition by label order by score desc
  rows between unbounded preceding and current row))"""


def _macro(name: str) -> str:
    return (f"select label, round(v, 6) as {name} from per union all "
            f"select 'macro_average', round(avg(v), 6) from per where label <> 'micro_average'")


@query("roc_auc", f"""with {WITH_MICRO}, {SCORED}, per as (select label,
  coalesce((max(p) * max(n) - sum(pos * cn) + sum(pos * neg) / 2) / nullif(max(p) * max(n), 0), 0) as v from cum group by 1)
{_macro('roc_auc')}""")
def roc_auc(spark, sf):
    return evaluation.roc_auc(eval_long(spark, sf))


@query("average_precision", f"""with {WITH_MICRO}, {SCORED}, per as (select label,
  coalesce(sum(pos * (cp / (cp + cn))) / nullif(max(p), 0), 0) as v from cum group by 1) {_macro('average_precision')}""")
def average_precision(spark, sf):
    return evaluation.average_precision(eval_long(spark, sf))


# The amount of a line as score of its return flag, per line status: many distinct scores, so many blocks of running totals.
LINES = """lines as (select l_orderkey * 10 + l_linenumber as id, l_linestatus as label, cast(l_returnflag = 'R' as int) as y_true,
  cast(l_quantity > 25 as int) as y_pred, l_extendedprice as score from lineitem), e as (select * from lines)"""


def lines(spark, sf):
    return table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_linestatus").alias("label"),
        (F.col("l_returnflag") == "R").cast("int").alias("y_true"), (F.col("l_quantity") > 25).cast("int").alias("y_pred"),
        F.col("l_extendedprice").alias("score"))


@query("roc_points_lineitem", f"""with {LINES}, {SCORED} select label, round(score, 6) as threshold,
  round(cn / n, 6) as fpr, round(cp / p, 6) as tpr from cum""")
def roc_points_lineitem(spark, sf):
    return evaluation.roc_points(lines(spark, sf))


@query("class_imbalance", f"""with {S.EVAL} select label, cast(sum(y_true) as bigint) as positive_count, count(*) as total_count,
  round(sum(y_true) / count(*), 6) as positive_ratio,
  round(coalesce((count(*) - sum(y_true)) / nullif(sum(y_true), 0), cast('inf' as double)), 6) as imbalance_ratio
from eval_long group by 1""")
def class_imbalance(spark, sf):
    return evaluation.class_imbalance(eval_long(spark, sf))


ERRORS = f"""{S.EVAL}, err as (select label, case when y_pred = 1 then 'false_positive' else 'false_negative' end as kind, id
  from eval_long where y_true <> y_pred)"""


@query("error_cases", f"with {ERRORS} select * from err")
def error_cases(spark, sf):
    return evaluation.error_cases(eval_long(spark, sf))


@query("error_counts", f"with {ERRORS} select label, kind, count(*) as n from err group by 1, 2")
def error_counts(spark, sf):
    return evaluation.error_counts(eval_long(spark, sf))


@query("error_examples", f"""with {ERRORS} select label, kind, cast(r as int) as rank, id, text from (
  select *, row_number() over (partition by label, kind order by id) as r from err) join documents on doc_id = id where r <= 5""")
def error_examples(spark, sf):
    texts = table(spark, sf, "documents").withColumnRenamed("doc_id", "id")
    return evaluation.error_examples(eval_long(spark, sf), texts)


@query("roc_points", f"""with {S.EVAL}, e as (select * from eval_long), {SCORED} select label, round(score, 6) as threshold,
  round(cn / n, 6) as fpr, round(cp / p, 6) as tpr from cum""")
def roc_points(spark, sf):
    return evaluation.roc_points(eval_long(spark, sf))


@query("pr_points", f"""with {S.EVAL}, e as (select * from eval_long), {SCORED} select label, round(score, 6) as threshold,
  round(cp / (cp + cn), 6) as precision, round(cp / p, 6) as recall from cum""")
def pr_points(spark, sf):
    return evaluation.pr_points(eval_long(spark, sf))


@query("label_ranking", f"""with {RATES}, o as (select *, row_number() over (order by f1_score desc, label) as k from r)
select cast(k as int) as rank, label, round(f1_score, 6) as f1_score, k = 1 as is_best, k = (select count(*) from r) as is_worst from o""")
def label_ranking(spark, sf):
    return evaluation.label_ranking(eval_long(spark, sf))


def _quality(hit) -> str:
    counts = ", ".join(f"count(*) filter (where annotated and {hit(x)}) as n_{x}" for x in presets.LABELS)
    entries = [("total_annotated", "", "a"), ("coverage", "", "c"), ("confidence", "mean", "m"), ("confidence", "std", "s"),
               ("confidence", "min", "lo"), ("confidence", "max", "hi")]
    entries += [("label_rows", x, f"n_{x}") for x in presets.LABELS]
    return f"""with {LABELLED}, one as (select count(*) filter (where annotated) as a, avg(cast(annotated as int)) as c,
  avg(confidence) filter (where annotated) as m, stddev_samp(confidence) filter (where annotated) as s,
  min(confidence) filter (where annotated) as lo, max(confidence) filter (where annotated) as hi, {counts} from labelled)
{S.inline_rows('one', entries)}"""


@query("annotation_quality", _quality(lambda x: f"labels = '{x}'"))
def annotation_quality(spark, sf):
    return evaluation.annotation_quality(labelled(spark, sf))


@query("annotation_quality_substring", _quality(lambda x: f"contains(labels, '{x}')"))
def annotation_quality_substring(spark, sf):
    return evaluation.annotation_quality(labelled(spark, sf), substring=True)
