"""C1–C4, C7, C12."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from threadscope import presets
from threadscope.catalog import sql as S
from threadscope.catalog.fixtures import posts, staged, table
from threadscope.catalog.registry import query
from threadscope.operators import cleaning, tagging

FLAGS = ("has_fear", "has_question", "is_rare_event")
WIDE = [f"stage_{s}" for s in presets.STAGES_6_WIDE]


@query("assign_stage", f"with {S.POSTS}, {S.STAGED} select id, subreddit, visa_stage from staged")
def assign_stage(spark, sf):
    return tagging.assign_stage(posts(spark, sf)).select("id", "subreddit", "visa_stage")


@query("flag_rare", f"with {S.POSTS}, {S.STAGED} select id, has_fear, has_question, is_rare_event from staged")
def flag_rare(spark, sf):
    return tagging.flag_rare(posts(spark, sf)).select("id", *FLAGS)


@query("flag_rare_documents", f"""
select doc_id, {S.word_of('lower(text)', presets.FEAR_WORDS_3GROUP)} as has_fear,
  contains(text, '?') or {S.word_of('lower(text)', presets.QUESTION_WORDS)} as has_question from documents""")
def flag_rare_documents(spark, sf):
    return tagging.flag_rare(table(spark, sf, "documents")).select("doc_id", "has_fear", "has_question")


@query("flag_lexicon", f"with {S.POSTS}, {S.tagged()} select id, has_fear, is_question from tagged")
def flag_lexicon(spark, sf):
    return tagging.flag_lexicon(posts(spark, sf)).select("id", "has_fear", "is_question")


@query("flag_lexicon_escaped",
       f"with {S.POSTS}, {S.tagged(question=presets.QA_9_ESCAPED)} select id, has_fear, is_question from tagged")
def flag_lexicon_escaped(spark, sf):
    return tagging.flag_lexicon(posts(spark, sf), question=presets.QA_9_ESCAPED).select("id", "has_fear", "is_question")


@query("flag_lexicon_conversations", f"""
select role, {S.big(f"sum(cast({S.any_of('lower(text)', presets.FEAR_9)} as int))", 'fear')},
  {S.big(f"sum(cast({S.any_of('lower(text)', presets.QA_9)} as int))", 'questions')}, count(*) as turns
from conversations group by role""")
def flag_lexicon_conversations(spark, sf):
    rows = tagging.flag_lexicon(table(spark, sf, "conversations"))
    return rows.groupBy("role").agg(
        F.count_if("has_fear").alias("fear"), F.count_if("is_question").alias("questions"),
        F.count(F.lit(1)).alias("turns"),
    )


@query("stage_hits", f"with {S.POSTS}, {S.tagged()} select id, {', '.join(WIDE)} from tagged")
def stage_hits(spark, sf):
    return tagging.stage_hits(posts(spark, sf)).select("id", *WIDE)


@query("stage_hits_narrow", f"with {S.POSTS}, {S.tagged(presets.STAGES_6_NARROW)} select id, {', '.join(WIDE)} from tagged")
def stage_hits_narrow(spark, sf):
    return tagging.stage_hits(posts(spark, sf), stages=presets.STAGES_6_NARROW).select("id", *WIDE)


@query("stage_hit_counts", f"with {S.POSTS}, {S.tagged()} select "
       + ", ".join(S.big(f"sum(cast({c} as int))", c) for c in WIDE) + " from tagged")
def stage_hit_counts(spark, sf):
    return tagging.stage_hits(posts(spark, sf)).agg(*[F.count_if(c).alias(c) for c in WIDE])


@query("four_label", f"""with {S.POSTS}, {S.STAGED}
select id, case when has_fear and has_question then 'fear_driven_question' when has_fear then 'fear'
  when has_question then 'question' else 'other' end as label from staged""")
def four_label(spark, sf):
    return tagging.four_label(staged(spark, sf)).select("id", "label")


@query("fill_missing", f"""with {S.POSTS}
select id, case when id % 5 = 0 then 'unknown' else subreddit end as subreddit,
  case when id % 7 = 0 then 'unknown' else author end as author,
  case when id % 11 = 0 then 1700000000.0 when id % 11 = 1 then 1700000000.0
    else cast(id as double) + 0.5 end as created_utc from posts""")
def fill_missing(spark, sf):
    i = F.col("id")
    rows = posts(spark, sf).select(
        "id", F.when(i % 5 != 0, F.col("subreddit")).alias("subreddit"),
        F.when(i % 7 != 0, F.col("author")).alias("author"),
        F.when(i % 11 == 0, F.lit("not a time")).when(i % 11 > 1, F.concat(i.cast("string"), F.lit(".5"))).alias(
            "created_utc"),
    )
    return cleaning.fill_missing(rows, now=datetime.fromtimestamp(1_700_000_000, timezone.utc))
