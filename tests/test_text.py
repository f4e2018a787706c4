"""Text operators against hand-made strings and a plain Python restatement."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from threadscope.functions import text as T
from threadscope.operators import cleaning, tagging


def apply(spark, expr, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, text string")
    return [r.x for r in rows.select("i", expr(F.col("text")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize("expr, given, wanted", [
    (T.strip_markup, "[t](https://a.com) z", "t z"),
    (lambda c: T.strip_markup(c, compat=True), "[t](https://a.com) z", "[t]( z"),
    (T.strip_urls_mentions, "menu/abc and u/bob", "menu/abc and "),
    (lambda c: T.strip_urls_mentions(c, compat=True), "menu/abc and u/bob", "men and "),
    (T.strip_urls_mentions, "see https://a.com/x~y ok", "see  ok"),
    (lambda c: T.strip_urls_mentions(c, compat=True), "see https://a.com/x~y ok", "see ~y ok"),
    (T.strip_markup, "aa **b** c", "aa b c"),
    (T.strip_markup, "a *b* ~~c~~ `d` ```e\nf``` g", "a b c   g"),
    (T.strip_markup, "# Top\n- one\n> said\nx", "Top\none\nsaid\nx"),
    (T.remove_emoji, "hi 😀x", "hi x"),
    (T.remove_emoji, "漢字 ok", "漢字 ok"),
    (lambda c: T.remove_emoji(c, wide=True), "漢字 ok", " ok"),
    (T.describe_emoji, "hi 😀x", "hi  grinning_face x"),
    (T.describe_emoji, "a🇺🇸b", "a flag_us b"),
    (T.describe_emoji, "🇺🇸🇩🇪🇫", " flag_us  flag_de  regional_indicator_symbol_letter_f "),
    (T.describe_emoji, "x\U0001F3F4\U000E0067\U000E0062\U000E0065\U000E006E\U000E0067\U000E007F \U0001F3F4",
     "x flag_gbeng   waving_black_flag "),
    (T.describe_emoji, "1\ufe0f\u20e3 of 12, #\u20e3 *\ufe0f\u20e3", " keycap_1  of 12,  keycap_number_sign   keycap_asterisk "),
    (T.describe_emoji, "👋🏿👋", " waving_hand_sign_dark_skin_tone  waving_hand_sign "),
    (T.describe_emoji, "👨\u200d👩\u200d👧 👩🏽\u200d💻", " man_woman_girl   woman_medium_skin_tone_personal_computer "),
    (T.describe_emoji, "❤\ufe0f\u200d🔥 ❤\ufe0f", " heavy_black_heart_fire   heavy_black_heart "),
    (T.describe_emoji, "a\u200db c\ufe0f 12#", "a\u200db c\ufe0f 12#"),
    (T.describe_emoji, "─\ufe0f 😀", "─\ufe0f  grinning_face "),
    (T.describe_emoji, "⭐⌚🀄", " white_medium_star  watch  mahjong_tile_red_dragon "),
    (T.squash_whitespace, "  a \t\n b c  d ", "a b c d"),
    (T.keep_basic_chars, "a@b #c 𝐀é_1!?", "ab c 𝐀é_1!?"),
    (T.squash_punctuation, "a... b!! c??! d", "a. b! c?! d"),
    (T.to_ascii, "é ß ﬁ ½ 𝐀 漢 ñ", "e  fi 12 A  n"),
    (T.clean_text, None, ""),
    (T.clean_text, "", ""),
    (T.clean_text, "Why?? See [my guide](https://x.example/a) by u/me — it's 100% good…", "Why? See my guide by its 100 good"),
])
def test_golden(spark, expr, given, wanted):
    if wanted.startswith("Why"):
        got = apply(spark, expr, [given])[0]
        assert re.sub(" +", " ", got) == wanted
    else:
        assert apply(spark, expr, [given]) == [wanted]


def test_very_long_texts_with_emoji(spark):
    long = "word 12 # " * 200_000
    got = apply(spark, T.describe_emoji, [long + "👋🏿", "👧" + "\u200d👧" * 50_000, "12\u20e3"])
    assert got[0] == long + " waving_hand_sign_dark_skin_tone "
    assert got[1].count("girl") == 50_001 and "👧" not in got[1]
    assert got[2] == "1 keycap_2 "


def plain_clean(text):
    """The cleaning steps in plain Python."""
    if not text:
        return ""
    ws = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"
    mention = lambda letter: rf"(?<![A-Za-z0-9]){letter}/[A-Za-z0-9_-]+"
    url = rf"https?://[^{ws[1:]}+"
    steps = [(r"\[([^\]]+)\]\(https?://[^\)]+\)", r"\1", 0), (mention("u"), "", 0), (mention("r"), "", 0), (url, "", 0),
             (r"```[\s\S]*?```", "", 0), (r"`[^`]+`", "", 0), (r"\*\*([^*]+)\*\*", r"\1", 0), (r"\*([^*]+)\*", r"\1", 0),
             (r"~~([^~]+)~~", r"\1", 0), (rf"^#{{1,6}}{ws}+", "", re.M), (rf"^{ws}*[-*+]{ws}+", "", re.M),
             (rf"^>{ws}*", "", re.M), (url, "", 0), (mention("u"), "", 0), (mention("r"), "", 0)]
    for pattern, by, flags in steps:
        text = re.sub(pattern, by, text, flags=flags)
    text = re.sub(f"{ws}+", " ", text).strip(" ")
    names = T.emoji_names()
    text = "".join(f" {names[c]} " if c in names else c for c in text)
    text = "".join(c for c in text if c.isalnum() or c in "_.!?,;:-" or re.match(ws, c))
    for mark in ".!?":
        text = re.sub(re.escape(mark) + "{2,}", mark, text)
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if ord(c) < 128 or c.isspace())
    return text.strip(" ")


PIECES = ["word", " ", "  ", "\n", "\t", "u/bob", "r/x_y", "menu/abc", "https://a.com/b~c#d", "[link](https://a.com/(x))",
          "**", "*", "~~", "`", "```", "# ", "\n# ", "\n- ", "\n> ", ">", "é", "ß", "ﬁ", "½", "😀", "☕", "漢", "한", "𝐀",
          " ", " ", "​", "!", "!!", "??", "...", "'", "@", "_", "-", "/", "u/", "http", "İ", "ǆ", "1", "٣"]


def test_clean_text_equals_plain_python(spark):
    draw = random.Random(7)
    texts = ["".join(draw.choice(PIECES) for _ in range(draw.randint(1, 25))) for _ in range(1500)]
    got = apply(spark, T.clean_text, texts)
    wrong = [(t, g, plain_clean(t)) for t, g in zip(texts, got) if g != plain_clean(t)]
    assert not wrong, wrong[:3]


def test_long_texts_do_not_overflow_the_stack(spark):
    texts = ['"' + "a" * 300_000 + '"', "漢" * 200_000, "[x](" + "y" * 200_000, "*" * 100_000, "- " * 100_000]
    got = apply(spark, lambda c: F.length(T.clean_text(c)), texts)
    assert got[0] == 300_000 and got[1] == 0


def test_preprocess_gate_and_tokens(spark):
    rows = spark.createDataFrame(
        [(0, "123456789"), (1, "1234567890"), (2, "My visa interview was denied, 2024 !!"), (3, None)], "id int, text string")
    got = {r.id: r for r in cleaning.preprocess(rows).collect()}
    assert (got[0].cleaned_text, got[0].tokens, got[0].is_valid) == ("", [], False)
    assert (got[1].cleaned_text, got[1].tokens, got[1].is_valid) == ("1234567890", [], False)
    assert got[2].tokens == ["interview", "denied"] and got[2].processed_text == "interview denied" and got[2].word_count == 2
    assert (got[3].cleaned_text, got[3].is_valid) == ("", False)


def test_ngrams_and_lemmas(spark):
    rows = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "tokens array<string>")
    assert [r.x for r in rows.select(T.ngrams(F.col("tokens"), 2).alias("x")).collect()] == [["a b", "b c"], [], []]
    assert [r.x for r in rows.select(T.ngrams(F.col("tokens"), 3).alias("x")).collect()] == [["a b c"], [], []]
    assert rows.select(T.lemmatize(F.col("tokens"), {"b": "bee"}).alias("x")).first().x == ["a", "bee", "c"]


def test_flags(spark):
    rows = spark.createDataFrame(
        [(0, "is it ok?", "x"), (1, "I FEAR this", "H1B"), (2, "fearless show", "myF1visa"), (3, None, None),
         (4, "denied. How so", "other")], "id int, text string, subreddit string")
    lex = {r.id: (r.has_fear, r.is_question) for r in tagging.flag_lexicon(rows).collect()}
    assert lex == {0: (False, True), 1: (True, False), 2: (True, True), 3: (False, False), 4: (False, True)}
    rare = {r.id: r.is_rare_event for r in tagging.flag_rare(rows).collect()}
    assert rare == {0: False, 1: False, 2: False, 3: False, 4: True}
    stage = {r.id: r.visa_stage for r in tagging.assign_stage(rows).collect()}
    assert stage == {0: "unknown", 1: "work_visa", 2: "student_visa", 3: "unknown", 4: "unknown"}


def test_corpus_vocabulary_counts_the_same_terms(spark):
    """Leaving out n-grams of rare words changes neither terms nor counts, whatever the size; ties and overlaps included."""
    import random

    from threadscope.operators import words

    rng = random.Random(5)
    rows = [(i, [f"w{min(rng.randrange(40), rng.randrange(40))}" for _ in range(rng.randrange(30))]) for i in range(120)] + [(900, ["a"] * 9), (901, None)]
    df = spark.createDataFrame(rows, "id int, tokens array<string>")
    for size, n in ((5, 2), (25, 3), (500, 2)):
        want = words.vocabulary(words.term_totals(df, max_n=n), df, size, 3, 0.6).collect()
        assert words.corpus_vocabulary(df, size, 3, 0.6, max_n=n).collect() == want
    found = words.term_totals(df, known=["w0", "w1"]).select("term").collect()
    assert {r.term for r in found} == {"w0", "w1", "w0 w0", "w0 w1", "w1 w0", "w1 w1"}


def test_kept_tokens_are_found_by_one_pattern(spark):
    """The pattern finds what the filter keeps, and rules read the text as it is after the rules before them."""
    import itertools

    texts = ["".join(x) for n in range(6) for x in itertools.product("a1_ ", repeat=n)] + ["x1 22 __ _a 1_ 2b 33_ Bé a.b ...", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    both = rows.select(T.tokenize_kept(F.col("t")).alias("a"), T.filter_tokens(T.tokenize_words(F.col("t"))).alias("b"))
    assert both.filter(~F.col("a").eqNullSafe(F.col("b"))).isEmpty()
    marks = ["u**x**/abc r/one xr/two", "u`` `/abc u/me-1, (u/me) au/me 9u/me _u/me", "ht~~x~~tp://a.b/c http://x.y", "[a](http://b.c) ](http", "wait.... what?! no!!"]
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, "(?<![A-Za-z0-9])u/[A-Za-z0-9_-]+", ""), "(?<![A-Za-z0-9])r/[A-Za-z0-9_-]+", "")
    rows = spark.createDataFrame([(t,) for t in marks], "t string")
    for got, want in rows.select(T._apply(F.col("t"), (T.USER_MENTION, T.GROUP_MENTION)), plain(F.col("t"))).collect():
        assert got == want
    assert [r[0] for r in rows.select(T.squash_punctuation(F.col("t"))).collect()][-1] == "wait. what?! no!"


def test_tokens_are_the_same_without_the_cleaned_text(spark):
    """Leaving out the steps that only the cleaned text needs changes no other column, short texts and lemmas included."""
    draw = random.Random(11)
    pieces = [*PIECES, "\xa0", " ", "‍", "…", "–", "’", "«", "ŉ", "²", "ª", "ø", "1️⃣", "👋🏿", "⑴", "\x00", "\x1f", "..", "the", "visa", "__"]
    texts = ["".join(draw.choice(pieces) for _ in range(draw.randint(0, 14))) for _ in range(1500)] + [None, "a b c d e f g", "visa the visa", "ab 12 34 5"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for more in ({}, {"lemmas": {"word": "a_much_longer_word", "grinning_face": "x"}}, {"emoji": "remove_wide"}, {"emoji": "keep", "min_length": 0}, {"compat": True}):
        short = cleaning.preprocess(rows, texts=False, **more)
        whole = cleaning.preprocess(rows, **more)
        assert "cleaned_text" not in short.columns and "cleaned_text" in whole.columns
        assert sorted(map(str, short.collect())) == sorted(map(str, whole.drop("cleaned_text").collect())), more


def test_common_characters_are_cleaned_as_by_single_steps(spark):
    """The one pass over common characters gives what the steps give, also where marks meet after letters have gone."""
    points = [*range(1, 0x250), *range(0x2000, 0x2070), 0x20E3, 0x231A, 0x1F600]
    texts = [f"a{chr(c)}b .{chr(c)}. {chr(c)}" for c in points] + ["!ß!", "!&!", "a & b", "x  \t é", "..é..", " é\x85\xa0ø. ", "1️⃣é", "😀é–…"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    steps = T.keep_basic_chars(T.describe_emoji(T.squash_whitespace(T._unmark(t, False))))
    steps = F.trim(T.to_ascii(T.squash_punctuation(steps)))
    wrong = [tuple(r) for r in rows.select(t, T.clean_text(t), steps).collect() if r[1] != r[2]]
    assert not wrong, wrong[:5]
