"""C11, E19–E22: model output, so SQL can only check what must hold of it."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from threadscope import presets
from threadscope.catalog import sql as S
from threadscope.catalog.fixtures import cleaned, saved, saved_cleaned
from threadscope.catalog.registry import query
from threadscope.operators import evaluation, labelling, tagging, topics


def _topic_model(spark, sf):
    docs = saved_cleaned(spark, sf).select("id", "tokens")
    return docs, topics.fit_topics(docs, k=5, max_iter=10)


@query("topic_terms")
def topic_terms(spark, sf):
    return topics.topic_terms(_topic_model(spark, sf)[1], 10)


@query("assign_topics")
def assign_topics(spark, sf):
    docs, model = _topic_model(spark, sf)
    return topics.assign_topics(docs, model).select("id", "dominant_topic", "topic_confidence")


@query("topic_distribution")
def topic_distribution(spark, sf):
    docs, model = _topic_model(spark, sf)
    return topics.topic_distribution(topics.assign_topics(docs, model))


def _batch_model(spark, sf):
    docs = saved_cleaned(spark, sf).select("id", "tokens")
    return docs, topics.fit_topics_batch(docs, k=5, max_iter=10)


@query("batch_topic_terms", """select cast(t as int) as topic, cast(r as int) as rank, true as falling, true as a_share
  from range(5) a(t), range(1, 11) b(r)""")
def batch_topic_terms(spark, sf):
    """Ten terms a topic; weights are shares that fall with the rank."""
    terms = topics.topic_terms(_batch_model(spark, sf)[1], 10)
    before = F.lag("weight").over(Window.partitionBy("topic").orderBy("rank"))
    return terms.select("topic", "rank", (F.coalesce(before, F.lit(1.0)) >= F.col("weight")).alias("falling"),
                        F.col("weight").between(0, 1).alias("a_share"))


@query("batch_topic_shares", lambda: f"""with {S.POSTS}, {S.preprocessed('posts')}
select id, 5 as topics, true as sums_to_one, true as all_positive from prepared where is_valid""")
def batch_topic_shares(spark, sf):
    docs, model = _batch_model(spark, sf)
    shares = F.col("topic_shares")
    return topics.topic_shares(docs, model).select(
        "id", F.size(shares).alias("topics"),
        (F.abs(F.aggregate(shares, F.lit(0.0), lambda a, x: a + x) - 1) < 1e-9).alias("sums_to_one"),
        F.forall(shares, lambda x: x > 0).alias("all_positive"))


def _predicted(spark, sf):
    rows = tagging.four_label(tagging.flag_rare(cleaned(spark, sf))).select("id", "tokens", F.col("label").alias("labels"))
    rows = saved(spark, labelling.encode_multihot(rows))
    model = labelling.train_text_classifier(rows, features=1 << 12, max_iter=5)
    return labelling.predict(model, rows)


@query("train_and_predict")
def train_and_predict(spark, sf):
    return _predicted(spark, sf).select("id", *[f"{x}_{k}" for x in presets.LABELS for k in ("score", "pred")])


@query("evaluate_classifier")
def evaluate_classifier(spark, sf):
    return evaluation.label_metrics(evaluation.to_long(_predicted(spark, sf), presets.LABELS))
