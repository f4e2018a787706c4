"""D1–D16."""

from pyspark.sql import functions as F

from threadscope import presets
from threadscope.catalog import sql as S
from threadscope.catalog.fixtures import posts, saved, table
from threadscope.catalog.registry import query
from threadscope.functions import text as T
from threadscope.operators import cleaning, lookup


def _text_query(name, expr, sql_expr):
    """One text expression over all posts."""

    @query(name, lambda: f"with {S.POSTS} select id, {sql_expr('text')} as text from posts")
    def run(spark, sf):
        return posts(spark, sf).select("id", expr(F.col("text")).alias("text"))


_text_query("strip_markup", T.strip_markup, lambda c: S.apply_rules(c, T.markup_rules()))
_text_query("strip_markup_compat", lambda c: T.strip_markup(c, compat=True),
            lambda c: S.apply_rules(c, T.markup_rules(compat=True)))
_text_query("strip_urls_mentions", T.strip_urls_mentions, lambda c: S.apply_rules(c, T.REPEAT_RULES))
_text_query("strip_urls_mentions_compat", lambda c: T.strip_urls_mentions(c, compat=True),
            lambda c: S.apply_rules(c, T.REPEAT_RULES_COMPAT))
_text_query("squash_whitespace", T.squash_whitespace, S.squash_space)
_text_query("remove_emoji", T.remove_emoji, lambda c: S.replace_all(c, f"[{T.EMOJI_NARROW}]+", ""))
_text_query("remove_emoji_wide", lambda c: T.remove_emoji(c, wide=True),
            lambda c: S.replace_all(c, f"[{T.EMOJI_WIDE}]+", ""))
_text_query("describe_emoji", T.describe_emoji, S.name_emoji)


# Sequences of each kind and their names, so that the SQL does not depend on the table of names.
SEQUENCES = {
    "🇺🇸": "flag_us", "1\ufe0f\u20e3": "keycap_1", "👋🏿": "waving_hand_sign_dark_skin_tone",
    "👨\u200d👩\u200d👧": "man_woman_girl", "❤\ufe0f": "heavy_black_heart",
}


def _sequence_sql() -> str:
    expr = "concat(" + ", ".join(["text", *[f"case when doc_id % {i + 2} = 0 then {S.lit(e)} else '' end" for i, e in enumerate(SEQUENCES)]]) + ")"
    for sequence, name in SEQUENCES.items():
        expr = f"replace({expr}, {S.lit(sequence)}, {S.lit(f' {name} ')})"
    return f"select doc_id, {expr} as text from documents"


@query("describe_emoji_sequences", _sequence_sql)
def describe_emoji_sequences(spark, sf):
    """Every text with sequences of up to five kinds behind it."""
    ends = [F.when(F.col("doc_id") % (i + 2) == 0, F.lit(e)).otherwise(F.lit("")) for i, e in enumerate(SEQUENCES)]
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", T.describe_emoji(F.concat("text", *ends)).alias("text"))

_text_query("keep_basic_chars", T.keep_basic_chars, S.basic_chars)
_text_query("squash_punctuation", T.squash_punctuation, S.squash_marks)
_text_query("to_ascii", T.to_ascii, S.ascii_only)
_text_query("tokenize", lambda c: F.array_join(T.tokenize(c), " "),
            lambda c: f"array_to_string({S.tokens_expr(c)}, ' ')")
_text_query("filter_tokens", lambda c: F.array_join(T.filter_tokens(T.tokenize(c)), " "),
            lambda c: f"array_to_string([t for t in {S.tokens_expr(c)} if length(t) >= 2 and "
                      f"not regexp_matches(t, '^[0-9]+$') and not regexp_matches(t, {S.lit(T.PUNCT_ONLY)})], ' ')")


@query("clean_text", f"with {S.POSTS} select id, {S.cleaned_expr('text')} as cleaned_text from posts")
def clean_text(spark, sf):
    return posts(spark, sf).select("id", T.clean_text(F.col("text")).alias("cleaned_text"))


@query("clean_text_compat", f"with {S.POSTS} select id, {S.cleaned_expr('text', compat=True)} as cleaned_text from posts")
def clean_text_compat(spark, sf):
    return posts(spark, sf).select("id", T.clean_text(F.col("text"), compat=True).alias("cleaned_text"))


@query("clean_pages", f"select page_id, {S.cleaned_expr('html')} as cleaned_text from pages")
def clean_pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.clean_text(F.col("html")).alias("cleaned_text"))


@query("clean_conversations", f"select conv_id, turn, {S.cleaned_expr('text')} as cleaned_text from conversations")
def clean_conversations(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", T.clean_text(F.col("text")).alias("cleaned_text"))


@query("remove_stopwords", lambda: f"""with {S.POSTS} select id, array_to_string(
  [t for t in {S.tokens_expr('text')} if t not in ({S.lits(presets.ENGLISH_STOP_WORDS)},
   {S.lits(presets.DOMAIN_STOP_WORDS)})], ' ') as text from posts""")
def remove_stopwords(spark, sf):
    stop = [*presets.ENGLISH_STOP_WORDS, *presets.DOMAIN_STOP_WORDS]
    return posts(spark, sf).select(
        "id", F.array_join(T.remove_stopwords(T.tokenize(F.col("text")), stop), " ").alias("text"))


def _lemma_sql(tokens: str) -> str:
    whens = " ".join(f"when {S.lit(k)} then {S.lit(v)}" for k, v in LEMMAS.items())
    return f"array_to_string([case t {whens} else t end for t in {tokens}], ' ')"


# Surface forms that occur in the test texts.
LEMMAS = presets.LEMMA_STARTER | {"thanks": "thank", "takes": "take", "approved": "approve", "things": "thing"}


@query("lemmatize", lambda: f"with {S.POSTS} select id, {_lemma_sql(S.tokens_expr('text'))} as text from posts")
def lemmatize(spark, sf):
    return posts(spark, sf).select(
        "id", F.array_join(T.lemmatize(T.tokenize(F.col("text")), LEMMAS), " ").alias("text"))


@query("lemmatize_by_table", lambda: f"with {S.POSTS} select id, {_lemma_sql(S.tokens_expr('text'))} as text from posts")
def lemmatize_by_table(spark, sf):
    table_ = spark.createDataFrame(list(LEMMAS.items()), "token string, lemma string")
    rows = posts(spark, sf).select("id", T.tokenize(F.col("text")).alias("tokens"))
    return lookup.lemmatize_by_table(rows, table_).select("id", F.array_join("tokens", " ").alias("text"))


def _noun_sql() -> str:
    forms = " union all ".join(
        [f"select token, 0 as o, token as form from ended"]
        + [f"select token, {i + 1}, concat(left(token, length(token) - {len(old)}), {S.lit(new)}) from ended "
           f"where token like '%{old}' and length(token) > {len(old)}" for i, (old, new) in enumerate(presets.NOUN_ENDINGS)])
    ended = " or ".join(f"token like '%{old}'" for old, _ in presets.NOUN_ENDINGS)
    fixed = ", ".join(f"({S.lit(k)}, {S.lit(v)})" for k, v in presets.LEMMA_STARTER.items())
    return f"""with {S.POSTS}, split as (select id, {S.tokens_expr('text')} as t from posts),
words as (select id, unnest(t) as token, generate_subscripts(t, 1) as pos from split),
vocabulary as (select token as form from words group by 1 having count(distinct id) >= 3),
fixed(token, lemma) as (values {fixed}),
ended as (select distinct token from words where ({ended}) and token not in (select token from fixed)),
forms as ({forms}),
best as (select token, form as lemma from forms semi join vocabulary using (form)
  qualify row_number() over (partition by token order by length(form), o) = 1),
lemmas as (select * from best union all select * from fixed)
select split.id, coalesce(string_agg(coalesce(lemma, token), ' ' order by pos), '') as text
from split left join words using (id) left join lemmas using (token) group by 1"""


@query("lemmatize_nouns", _noun_sql)
def lemmatize_nouns(spark, sf):
    """The corpus is its own vocabulary: words of at least three posts."""
    rows = saved(spark, posts(spark, sf).select("id", T.tokenize(F.col("text")).alias("tokens")))
    return lookup.lemmatize_nouns(rows, lookup.corpus_words(rows)).select("id", F.array_join("tokens", " ").alias("text"))


@query("preprocess", lambda: f"""with {S.POSTS}, {S.preprocessed('posts')}
select id, cleaned_text, processed_text, word_count, is_valid from prepared""")
def preprocess(spark, sf):
    return cleaning.preprocess(posts(spark, sf)).select("id", "cleaned_text", "processed_text", "word_count", "is_valid")


@query("drop_invalid", lambda: f"""select doc_id, word_count from (
  with docs as (select * from documents), {S.preprocessed('docs')} select * from prepared) where is_valid""")
def drop_invalid(spark, sf):
    return cleaning.drop_invalid(cleaning.preprocess(table(spark, sf, "documents"))).select("doc_id", "word_count")


@query("dedupe", """select doc_id, text, source from (
  select *, row_number() over (partition by text, source order by doc_id) as r from documents) where r = 1""")
def dedupe(spark, sf):
    return cleaning.dedupe_files(table(spark, sf, "documents"), ("text", "source"), ("doc_id",)).select(
        "doc_id", "text", "source")


@query("dedupe_text", """select doc_id, source, n_chars from (
  select *, row_number() over (partition by text order by doc_id) as r from documents) where r = 1""")
def dedupe_text(spark, sf):
    return cleaning.dedupe(table(spark, sf, "documents"), ("text",), ("doc_id",)).select("doc_id", "source", "n_chars")


SUMMARY = """select count(*) as total_entries, cast(sum(cast(is_valid as int)) as bigint) as valid_entries,
  round(avg(word_count), 6) as avg_word_count, count(distinct subreddit) as unique_subreddits,
  min(word_count) as min_words, max(word_count) as max_words, round(median(word_count), 6) as median_words,
  round(stddev_samp(word_count), 6) as std_words from prepared"""


@query("cleaning_summary", lambda: f"with {S.POSTS}, {S.preprocessed('posts')} {SUMMARY}")
def cleaning_summary(spark, sf):
    return cleaning.cleaning_summary(cleaning.preprocess(posts(spark, sf)))
