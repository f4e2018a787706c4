"""Lexicon flags and stage tags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadscope import presets
from threadscope.functions.matching import contains_any, contains_word


def lowered(df: DataFrame, text: str, out: str = "_low") -> DataFrame:
    """Lower-case once; every flag then reads this column."""
    return df.withColumn(out, F.lower(F.col(text)))


def flag_lexicon(df: DataFrame, text: str = "text", fear: Sequence[str] = presets.FEAR_9,
                 question: Sequence[str] = presets.QA_9) -> DataFrame:
    """``has_fear`` and ``is_question`` by substring; null text gives false."""
    return (
        lowered(df, text)
        .withColumns({"has_fear": contains_any("_low", fear), "is_question": contains_any("_low", question)})
        .drop("_low")
    )


def stage_hits(df: DataFrame, text: str = "text",
               stages: Mapping[str, Sequence[str]] = presets.STAGES_6_WIDE) -> DataFrame:
    """One boolean ``stage_<name>`` per stage; a post may hit several."""
    return (
        lowered(df, text)
        .withColumns({f"stage_{name}": contains_any("_low", terms) for name, terms in stages.items()})
        .drop("_low")
    )


def tag_posts(df: DataFrame, text: str = "text", fear: Sequence[str] = presets.FEAR_9,
              question: Sequence[str] = presets.QA_9,
              stages: Mapping[str, Sequence[str]] = presets.STAGES_6_WIDE) -> DataFrame:
    """Both flags and all stage booleans from one lower-casing."""
    flags = {"has_fear": contains_any("_low", fear), "is_question": contains_any("_low", question)}
    flags |= {f"stage_{name}": contains_any("_low", terms) for name, terms in stages.items()}
    return lowered(df, text).withColumns(flags).drop("_low")


def flag_rare(df: DataFrame, text: str = "text", fear: Sequence[str] = presets.FEAR_WORDS_3GROUP,
              question: Sequence[str] = presets.QUESTION_WORDS) -> DataFrame:
    """Whole-word flags ``has_fear``, ``has_question`` (a question mark also counts) and ``is_rare_event`` = both."""
    asks = contains_any("_low", ("?",)) | contains_word("_low", question)
    return (
        lowered(df, text)
        .withColumns({"has_fear": contains_word("_low", fear), "has_question": asks})
        .withColumn("is_rare_event", F.col("has_fear") & F.col("has_question"))
        .drop("_low")
    )


def assign_stage(df: DataFrame, text: str = "text", group: str = "subreddit",
                 stages: Sequence[presets.Stage] = presets.STAGES_5, out: str = "visa_stage") -> DataFrame:
    """One stage per post: first stage whose pattern is in the group name, else first with a keyword in the text."""
    name = F.lower(F.coalesce(F.col(group), F.lit("")))
    rules: list[tuple[Column, str]] = [(contains_any("_group", s.groups), s.name) for s in stages]
    rules += [(contains_any("_low", s.keywords), s.name) for s in stages]
    value = F.when(rules[0][0], F.lit(rules[0][1]))
    for cond, label in rules[1:]:
        value = value.when(cond, F.lit(label))
    return (
        lowered(df, text).withColumn("_group", name)
        .withColumn(out, value.otherwise(F.lit(presets.UNKNOWN))).drop("_low", "_group")
    )


def four_label(df: DataFrame, fear: str = "has_fear", question: str = "has_question", out: str = "label") -> DataFrame:
    """fear_driven_question where both flags hold, else the one that holds, else other."""
    f, q = F.col(fear), F.col(question)
    return df.withColumn(
        out,
        F.when(f & q, "fear_driven_question").when(f, "fear").when(q, "question").otherwise("other"),
    )
