"""C5, C6, C8–C10."""

from pyspark.sql import functions as F

from threadscope import presets
from threadscope.catalog import sql as S
from threadscope.catalog.fixtures import labelled, order_posts, posts, table
from threadscope.catalog.registry import query
from threadscope.operators import labelling

NAMES = [g.label for g in presets.GUIDELINES_4]


def _score(g: presets.Guideline) -> str:
    points = f"cast({S.hits_of('low', g.keywords)} as double)"
    if g.question_bonus:
        points += f" + case when contains(text, '?') then 0.5 else 0 end + case when {S.any_of('low', presets.WH_WORDS)} then 0.3 else 0 end"
    if g.fear_bonus:
        points += f" + {S.hits_of('low', presets.FEAR_WORDS)} * 0.5"
    return f"least(({points}) / {len(g.keywords)}, 1) as score_{g.label}"


BEST = f"greatest({', '.join(f'score_{n}' for n in NAMES)})"
SCORED = f"""{S.POSTS}, scored as (select *, case when round({BEST}, 9) < 0.3 then cast(1.0 as double) end as score_other from (
  select *, {', '.join(_score(g) for g in presets.GUIDELINES_4)} from (select *, lower(text) as low from posts)))"""
TOP = f"round(greatest({BEST}, coalesce(score_other, 0)), 9)"
PICK = " ".join(f"when round(score_{n}, 9) = {TOP} then '{n}'" for n in presets.LABELS)


def _labelled(threshold: float) -> str:
    return f"""{SCORED}, labelled as (select id, text,
  case when {TOP} > {threshold} then case {PICK} end else 'needs_review' end as labels,
  case when {TOP} > {threshold} then {TOP} else 0.0 end as confidence, {TOP} > {threshold} as annotated from scored)"""


LABELLED = _labelled(0.3)


def scored(spark, sf):
    return labelling.score_labels(posts(spark, sf), "text")


@query("score_labels", f"with {SCORED} select id, "
       + ", ".join(f"round(score_{n}, 6) as score_{n}" for n in presets.LABELS) + " from scored")
def score_labels(spark, sf):
    return scored(spark, sf).select(
        "id", *[F.round(f"score_{n}", 6).alias(f"score_{n}") for n in presets.LABELS])


OUT = "id, labels, round(confidence, 6) as confidence, annotated"


@query("auto_label", f"with {_labelled(0.7)} select {OUT} from labelled")
def auto_label(spark, sf):
    return labelling.auto_label(scored(spark, sf)).select(
        "id", "labels", F.round("confidence", 6).alias("confidence"), "annotated")


@query("auto_label_low", f"with {LABELLED} select {OUT} from labelled")
def auto_label_low(spark, sf):
    return labelled(spark, sf).select("id", "labels", F.round("confidence", 6).alias("confidence"), "annotated")


@query("encode_multihot", f"""with {LABELLED}, joined as (select id, case when id % 3 = 0 then concat(labels, ',other')
  else labels end as labels from labelled)
select id, """ + ", ".join(
    f"cast(list_contains(string_split(labels, ','), '{x}') as int) as is_{x}" for x in presets.LABELS) + " from joined")
def encode_multihot(spark, sf):
    rows = labelled(spark, sf).withColumn(
        "labels", F.when(F.col("id") % 3 == 0, F.concat("labels", F.lit(",other"))).otherwise(F.col("labels")))
    return labelling.encode_multihot(rows).select("id", *[f"is_{x}" for x in presets.LABELS])


@query("annotated_only", f"with {LABELLED} select id, labels from labelled where annotated")
def annotated_only(spark, sf):
    return labelling.annotated_only(labelled(spark, sf)).select("id", "labels")


@query("join_predictions", f"""with {S.ORDER_POSTS}, preds as (select l_orderkey as id, count(*) as fear_pred,
  max(l_returnflag) as visa_stage from lineitem where l_orderkey % 3 <> 0 group by 1)
select o.id, o.visa_stage, p.fear_pred, p.visa_stage as visa_stage_pred from order_posts o left join preds p using (id)""")
def join_predictions(spark, sf):
    preds = table(spark, sf, "lineitem").filter("l_orderkey % 3 <> 0").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.count(F.lit(1)).alias("fear_pred"), F.max("l_returnflag").alias("visa_stage"))
    return labelling.join_predictions(order_posts(spark, sf), preds).select(
        "id", "visa_stage", "fear_pred", "visa_stage_pred")
