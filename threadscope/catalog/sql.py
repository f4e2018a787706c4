"""SQL building blocks for the checks: common table expressions of the same views, and lexicon conditions."""

from __future__ import annotations

from collections.abc import Iterable

from threadscope import presets
from threadscope.catalog.fixtures import GROUPS, PHRASES
from threadscope.functions import text as T


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def lits(values: Iterable[str]) -> str:
    return ", ".join(lit(v) for v in values)


def any_of(col: str, terms: Iterable[str]) -> str:
    return "coalesce(" + " or ".join(f"contains({col}, {lit(t)})" for t in terms) + ", false)"


def hits_of(col: str, terms: Iterable[str]) -> str:
    return "(" + " + ".join(f"cast(contains({col}, {lit(t)}) as int)" for t in terms) + ")"


def word_of(col: str, words: Iterable[str]) -> str:
    edge = r"[^\p{L}\p{N}_]"
    return f"regexp_matches({col}, {lit('(?:^|' + edge + ')(?:' + '|'.join(words) + ')(?:$|' + edge + ')')})"


def case_map(col: str, table: dict, default: str) -> str:
    whens = " ".join(f"when {lit(k) if isinstance(k, str) else k} then {lit(v)}" for k, v in table.items())
    return f"case {col} {whens} else {default} end"


POSTS = f"""posts as (
  select d.doc_id as id, concat(d.text, {case_map('d.doc_id % 8', PHRASES, "''")}) as text,
    {case_map('d.source', GROUPS, 'd.source')} as subreddit, concat('a', e.user_id) as author,
    e.ts + to_days(cast(30 * (d.doc_id % 24) as int)) as created_ts, e.event_type as content_type,
    concat('part-', d.doc_id % 7) as source_file, (d.doc_id % 7 + 1) * 1000 as file_size, d.lang
  from documents d
  join events e on e.event_id = d.doc_id
    * (select cast(floor(count(*) / (select count(*) from documents)) as bigint) from events))"""


def tagged(stages: dict = presets.STAGES_6_WIDE, question=presets.QA_9) -> str:
    flags = [f"{any_of('low', presets.FEAR_9)} as has_fear", f"{any_of('low', question)} as is_question"]
    flags += [f"{any_of('low', terms)} as stage_{name}" for name, terms in stages.items()]
    return f"tagged as (select *, {', '.join(flags)} from (select *, lower(text) as low from posts))"


def _stage_case() -> str:
    whens = [f"when {any_of('lower(subreddit)', s.groups)} then {lit(s.name)}" for s in presets.STAGES_5]
    whens += [f"when {any_of('lower(text)', s.keywords)} then {lit(s.name)}" for s in presets.STAGES_5]
    return "case " + " ".join(whens) + " else 'unknown' end"


STAGED = f"""staged as (
  select *, has_fear and has_question as is_rare_event from (
    select *, {_stage_case()} as visa_stage, {word_of('lower(text)', presets.FEAR_WORDS_3GROUP)} as has_fear,
      contains(text, '?') or {word_of('lower(text)', presets.QUESTION_WORDS)} as has_question
    from posts))"""


def apply_rules(expr: str, rules: Iterable[T.Rule]) -> str:
    for rule in rules:
        # No look-behind here: the character before is captured and put back.
        before = f"(^|[^{rule.behind}])" if rule.behind else ""
        pattern = ("(?m)" if rule.line_start else "") + before + rule.pattern
        expr = f"regexp_replace({expr}, {lit(pattern)}, {lit(chr(92) + '1' if rule.keep or before else '')}, 'g')"
    return expr


def replace_all(expr: str, pattern: str, by: str) -> str:
    return f"regexp_replace({expr}, {lit(pattern)}, {lit(by)}, 'g')"


def squash_space(expr: str) -> str:
    return f"trim({replace_all(expr, f'[{T.WS}]+', ' ')})"


def basic_chars(expr: str) -> str:
    return replace_all(expr, rf"[^\p{{L}}\p{{N}}_{T.WS}.!?,;:\-]", "")


def squash_marks(expr: str) -> str:
    for mark in ".!?":
        expr = replace_all(expr, f"[{mark}]{{2,}}", mark)
    return expr


def ascii_only(expr: str) -> str:
    return replace_all(f"strip_accents({expr})", r"[^\x00-\x7f]+", "")


def name_emoji(expr: str) -> str:
    return f"replace({expr}, '😀', ' grinning_face ')"


def cleaned_expr(text: str, compat: bool = False) -> str:
    """All cleaning steps over a text expression."""
    expr = apply_rules(f"coalesce({text}, '')", T.markup_rules(compat))
    expr = apply_rules(expr, T.REPEAT_RULES_COMPAT if compat else T.REPEAT_RULES)
    return f"trim({ascii_only(squash_marks(basic_chars(name_emoji(squash_space(expr)))))})"


def tokens_expr(text: str) -> str:
    return f"regexp_extract_all(lower({text}), {lit(T.TOKEN)})"


def kept_tokens_expr(tokens: str) -> str:
    stop = lits(sorted({*presets.ENGLISH_STOP_WORDS, *presets.DOMAIN_STOP_WORDS}))
    return (
        f"[t for t in {tokens} if t not in ({stop}) and length(t) >= 2 and not regexp_matches(t, '^[0-9]+$')"
        f" and not regexp_matches(t, {lit(T.PUNCT_ONLY)})]"
    )


def preprocessed(source: str = "staged") -> str:
    """All posts with the preprocessing columns, from a view that has ``text``."""
    return f"""prepared as (
  select * replace (case when length(cleaned_text) >= {presets.MIN_TEXT_LENGTH} then cleaned_text else '' end as cleaned_text),
    array_to_string(tokens, ' ') as processed_text, cast(len(tokens) as int) as word_count, len(tokens) > 0 as is_valid
  from (select *, case when length(cleaned_text) >= {presets.MIN_TEXT_LENGTH}
          then {kept_tokens_expr(tokens_expr('cleaned_text'))} else cast([] as varchar[]) end as tokens
        from (select *, {cleaned_expr('text')} as cleaned_text from {source})))"""


def cleaned_cte() -> str:
    return f"{POSTS}, {STAGED}, {preprocessed()}, cleaned as (select * from prepared where is_valid)"


def words_cte() -> str:
    return f"{cleaned_cte()}, words as (select id, subreddit, visa_stage, unnest(tokens) as word from cleaned)"


ORDER_POSTS = """order_posts as (select o_orderkey as id, o_orderdate as created_ts, o_orderpriority as subreddit,
  o_orderstatus as visa_stage, o_custkey as author, o_totalprice as word_count, o_orderstatus as processed_text
  from orders)"""

EVENT_POSTS = """event_posts as (select event_id as id, ts as created_ts, event_type as subreddit, user_id as author,
  value as sentiment, props as processed_text, length(props) as word_count, event_type as visa_stage from events)"""

EVAL = """eval_long as (
  select id, label, y_true, cast((id * 7 + k) % 5 < 2 as int) as y_pred,
    cast((id * 37 + k * 11 + y_true * 20) % 101 as double) / 101 as score
  from (select doc_id as id, 'quality' as label, quality as y_true, 0 as k from labels
        union all select doc_id, 'toxic', toxic, 1 from labels) t)"""


def rate(a: str, b: str) -> str:
    return f"round(coalesce({a} / nullif({b}, 0), 0.0), 6)"


def big(expr: str, name: str) -> str:
    return f"cast({expr} as bigint) as {name}"


def inline_rows(source: str, entries: Iterable[tuple]) -> str:
    """Tidy rows (metric, subject, value) out of a one-row select."""
    parts = [
        f"select {lit(m)} as metric, {lit(s)} as subject, round(cast({v} as double), 6) as value from {source}"
        for m, s, v in entries
    ]
    return " union all ".join(parts)
