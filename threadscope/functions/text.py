"""Text cleaning and token expressions.

All of it is built-in expressions, so nothing leaves the JVM: even Unicode folding and emoji naming work from lookup
tables that are derived once on the driver from the Unicode database.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


# --- fixed values: character classes and patterns the cleaned text depends on ---------------------------------------

# Unicode white space as code points; the same class in Java and RE2.
WS_ASCII = r"\t-\r\x1c-\x20"
WS_WIDE = r"\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS = WS_ASCII + WS_WIDE

EMOJI_NARROW = (
    r"\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}"
    r"\x{2702}-\x{27B0}\x{24C2}\x{1F170}-\x{1F251}"
)
# The wide variant also deletes Chinese, Japanese and Korean text.
EMOJI_WIDE = (
    r"\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}"
    r"\x{2702}-\x{27B0}\x{24C2}-\x{1F251}"
)
# Pictograph blocks, and the single characters of other blocks that are shown as emoji.
EMOJI_NAME_BLOCKS = (
    (0x1F300, 0x1F64F), (0x1F680, 0x1F6FF), (0x1F7E0, 0x1F7EB), (0x1F900, 0x1FAFF), (0x2600, 0x27BF), (0x1F1E6, 0x1F1FF),
    (0x231A, 0x231B), (0x23E9, 0x23F3), (0x23F8, 0x23FA), (0x25FD, 0x25FE), (0x2B1B, 0x2B1C), (0x2B50, 0x2B50), (0x2B55, 0x2B55),
    (0x1F004, 0x1F004), (0x1F0CF, 0x1F0CF), (0x1F18E, 0x1F18E), (0x1F191, 0x1F19A), (0x1F201, 0x1F201), (0x1F21A, 0x1F21A),
    (0x1F22F, 0x1F22F), (0x1F232, 0x1F236), (0x1F238, 0x1F23A), (0x1F250, 0x1F251),
)

# Fixed values of emoji sequences: skin tones, marks of keycaps, letters of flags, the black flag and the tags after it, the
# joiner and the selector of the coloured form.
SKIN_TONES = {
    "\U0001F3FB": "light_skin_tone", "\U0001F3FC": "medium_light_skin_tone", "\U0001F3FD": "medium_skin_tone",
    "\U0001F3FE": "medium_dark_skin_tone", "\U0001F3FF": "dark_skin_tone",
}
KEYCAP, KEYCAP_MARKS = r"\x{20E3}", {"#": "number_sign", "*": "asterisk"}
FLAG_LETTERS, BLACK_FLAG, TAGS, LAST_TAG = (0x1F1E6, 0x1F1FF), r"\x{1F3F4}", (0xE0020, 0xE007E), r"\x{E007F}"
JOINER, COLOURED = r"\x{200D}", r"\x{FE0F}"
MOST_JOINED = 10  # longer ones are read as several; the longest in use have four parts

TOKEN = r"[a-z0-9_]+|[^a-z0-9_" + WS + "]"
PUNCT_ONLY = r"^[!-/:-@\[-`{-~]+$"


@dataclass(frozen=True)
class Rule:
    """Replace ``pattern`` by nothing, or by its first group where ``keep`` is set.

    ``behind`` names characters that must not stand before the match; engines without look-behind have to capture them.
    ``needs`` lists texts of which every match holds one; where ``behind`` is set, the one that every match begins with.
    """

    pattern: str
    keep: bool = False
    line_start: bool = False
    behind: str = ""
    needs: tuple[str, ...] = ()


USER_MENTION = Rule("u/[A-Za-z0-9_-]+", behind="A-Za-z0-9", needs=("u/",))
GROUP_MENTION = Rule("r/[A-Za-z0-9_-]+", behind="A-Za-z0-9", needs=("r/",))
URL = Rule(r"https?://[^" + WS + "]+", needs=("http",))
LINK = Rule(r"\[([^\]]+)\]\(https?://[^\)]+\)", keep=True, needs=("](http",))
CODE_BLOCK = Rule(r"```[\s\S]*?```", needs=("```",))
INLINE_CODE = Rule(r"`[^`]+`", needs=("`",))
BOLD = Rule(r"\*\*([^*]+)\*\*", keep=True, needs=("**",))
ITALIC = Rule(r"\*([^*]+)\*", keep=True, needs=("*",))
STRIKE = Rule(r"~~([^~]+)~~", keep=True, needs=("~~",))
HEADER = Rule(r"^#{1,6}[" + WS + "]+", line_start=True, needs=("#",))
LIST_ITEM = Rule(r"^[" + WS + "]*[-*+][" + WS + "]+", line_start=True, needs=("-", "*", "+"))
QUOTE = Rule(r"^>[" + WS + "]*", line_start=True, needs=(">",))

# Variants that repeat the historical results: mentions match inside words, the address class stops at ~ and #
# but runs over a closing bracket, and the address goes before the link that holds it.
USER_MENTION_COMPAT = Rule(r"u/[A-Za-z0-9_-]+", needs=("u/",))
GROUP_MENTION_COMPAT = Rule(r"r/[A-Za-z0-9_-]+", needs=("r/",))
URL_COMPAT = Rule(r"https?://[a-z$-_!]+", needs=("http",))
LINK_COMPAT = Rule(r"\[([^\]]+)\]\(https?://[^\)]+\)", needs=("](http",))

SLASH_RULES = (LINK, USER_MENTION, GROUP_MENTION, URL)
SLASH_RULES_COMPAT = (USER_MENTION_COMPAT, GROUP_MENTION_COMPAT, URL_COMPAT, LINK_COMPAT)
REPEAT_RULES = (URL, USER_MENTION, GROUP_MENTION)
REPEAT_RULES_COMPAT = (URL_COMPAT, USER_MENTION_COMPAT, GROUP_MENTION_COMPAT)
# Characters without which no rule of the family can match; no rule ever adds a character.
FORMAT_FAMILIES = (
    ("`", (CODE_BLOCK, INLINE_CODE)),
    ("*", (BOLD, ITALIC)),
    ("~", (STRIKE,)),
    ("#-*+>", (HEADER, LIST_ITEM, QUOTE)),
)

# --- end of fixed values -----------------------------------------------------------------------------------------


def _bits(*spans: str) -> str:
    """ASCII ranges spelled out as single characters.

    The JVM compiles single characters of a class to one bit set, but a union of ranges to a chain of calls per
    character, which is ten times slower on text.
    """
    return "".join(f"\\x{code:02x}" for a, b in spans for code in range(ord(a), ord(b) + 1))


# A cheap test in front of a costly class: nearly all characters fail it.
# A range, as a negated class costs two calls a character.
_NON_ASCII = r"(?=[\x{80}-\x{10FFFF}])"
_SPACE_BITS = _bits("\t\r", "\x1c\x20")
_OTHER_SPACE_BITS = _bits("\t\r", "\x1c\x1f")
_WORD_BITS = _bits("az", "09", "__")
# ASCII that cleaning deletes: everything but word characters, white space and . ! ? , ; : -
_DROPPED_BITS = _bits("\x00\x08", "\x0e\x1b", '"+', "//", "<>", "@@", "[^", "``", "{\x7f")


def _apply(col: Column, rules: Iterable[Rule]) -> Column:
    for rule in rules:
        col = _guarded(col, lambda x, r=rule: _any_of(x, r.needs), lambda x, r=rule: _replace(x, r)) if rule.needs else _replace(col, rule)
    return col


def _replace(col: Column, rule: Rule) -> Column:
    pattern = rule.pattern
    if rule.behind:  # looked at after the letters the match begins with, which most positions lack
        first = rule.needs[0]
        pattern = f"{first}(?<![{rule.behind}]{first})" + pattern.removeprefix(first)
    # (?md): line starts after a line feed only, as elsewhere; plain (?m) would also split at U+2028.
    return F.regexp_replace(col, ("(?md)" if rule.line_start else "") + pattern, "$1" if rule.keep else "")


def _families(compat: bool) -> tuple[tuple[str, tuple[Rule, ...]], ...]:
    return (("/", SLASH_RULES_COMPAT if compat else SLASH_RULES), *FORMAT_FAMILIES)


def markup_rules(compat: bool = False) -> list[Rule]:
    return [rule for _, rules in _families(compat) for rule in rules]


def strip_markup(col: Column, compat: bool = False) -> Column:
    """Delete mentions, addresses and code; unwrap links, bold, italic and strikethrough; drop line-start marks."""
    return _apply(col, markup_rules(compat))


def strip_urls_mentions(col: Column, compat: bool = False) -> Column:
    return _apply(col, REPEAT_RULES_COMPAT if compat else REPEAT_RULES)


def squash_whitespace(col: Column, ascii_text: bool = False) -> Column:
    """Runs of white space become one blank, none at the ends. Single blanks, nearly all of them, are never touched.

    ``ascii_text`` promises text without other characters; the regex engine has a faster class for that.
    """
    if not ascii_text:
        col = F.regexp_replace(col, f"{_NON_ASCII}[{WS_WIDE}]", " ")
    # A class alone, then blanks alone where two meet: half the time of one pattern with both as branches.
    col = F.regexp_replace(col, f"[{_OTHER_SPACE_BITS}]", " ")
    return F.trim(_guarded(col, lambda x: x.contains("  "), lambda x: F.regexp_replace(x, "  +", " ")))


def remove_emoji(col: Column, wide: bool = False) -> Column:
    return F.regexp_replace(col, f"[{EMOJI_WIDE if wide else EMOJI_NARROW}]+", "")


def keep_basic_chars(col: Column, ascii_text: bool = False) -> Column:
    """Keep word characters, white space and ``. ! ? , ; : -``."""
    kept = F.regexp_replace(col, f"[{_DROPPED_BITS}]", "")
    if ascii_text:
        return kept
    return F.regexp_replace(kept, rf"{_NON_ASCII}[^\p{{L}}\p{{N}}{WS_WIDE}]", "")


_DOUBLE_MARKS = ("..", "!!", "??")


def squash_punctuation(col: Column) -> Column:
    return _guarded(col, lambda x: _any_of(x, _DOUBLE_MARKS), lambda x: F.regexp_replace(x, r"([.!?])\1+", "$1"))


@cache
def emoji_names() -> dict[str, str]:
    """Emoji to Unicode name in snake case."""
    names = {}
    for first, last in EMOJI_NAME_BLOCKS:
        for code in range(first, last + 1):
            name = unicodedata.name(chr(code), "")
            if name:
                names[chr(code)] = name.lower().replace(" ", "_")
    return names


@cache
def ascii_residues() -> tuple[dict[str, str], dict[str, str]]:
    """What compatibility decomposition leaves in ASCII: (one character, several characters) per code point."""
    single: dict[str, str] = {}
    several: dict[str, str] = {}
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        left = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if ord(c) < 128 or c.isspace())
        if left and left != chr(code):
            (single if len(left) == 1 else several)[chr(code)] = left
    return single, several


@cache
def _common_table() -> tuple[str, str]:
    """Arguments for ``translate`` that delete and fold the characters of ASCII, Latin and general punctuation at once.

    Characters that become several, white space beyond ASCII and all other blocks are not in it: they stay, so a text that
    is ASCII afterwards held none of them.
    """
    single, several = ascii_residues()
    table = {chr(code): "" for code in range(0x80) if re.match(f"[{_DROPPED_BITS}]", chr(code))}
    for char in map(chr, (*range(0x80, 0x250), *range(0x2010, 0x2060))):
        if not char.isspace() and char not in several:
            # What is neither a letter nor a number is deleted before the rest is folded, whatever it would leave.
            table[char] = single.get(char, "") if unicodedata.category(char)[0] in "LN" else ""
    folded = {char: left for char, left in table.items() if left}
    return "".join([*folded, *(char for char in table if char not in folded)]), "".join(folded.values())


def _fold_common(col: Column) -> Column:
    return F.translate(col, *_common_table())


def _spans(chars: Iterable[str], gap: int) -> list[tuple[int, int]]:
    """Code point ranges that cover the characters, neighbours closer than ``gap`` joined."""
    spans: list[tuple[int, int]] = []
    for code in sorted(map(ord, chars)):
        if spans and code - spans[-1][1] <= gap:
            spans[-1] = (spans[-1][0], code)
        else:
            spans.append((code, code))
    return spans


def _wide_class(chars: Iterable[str], exact_below: int = 0x180) -> str:
    """A short character class that covers the characters: exact in the common blocks, a few spans above them.

    It only decides what is looked up, so covering more is harmless; a class of hundreds of ranges is slow.
    """
    low = [c for c in chars if ord(c) < exact_below]
    high = [c for c in chars if ord(c) >= exact_below]
    spans = _spans(low, 1) + _spans(high, 0x400)
    return "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in spans)


def literal_map(table: Mapping[str, str]) -> Column:
    """A lookup table as one constant that the optimizer folds."""
    return F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in table.items())), F.lit("\x02"), F.lit("\x01"))


def _swap_chars(col: Column, table: Mapping[str, str]) -> Column:
    """Replace single characters by strings, only in rows that hold one of them."""
    names = literal_map(table)
    listed = _wide_class(table)
    # Listed characters come out one by one, the text between them in long runs, so few pieces are looked up.
    pieces = F.lit(f"[{listed}]|[^{listed}]+")
    holds = f"{_NON_ASCII}[{listed}]"

    def swap(text: Column) -> Column:
        found = F.transform(
            F.regexp_extract_all(text, pieces, F.lit(0)),
            lambda p: F.when(F.length(p) == 1, F.coalesce(F.try_element_at(names, p), p)).otherwise(p),
        )
        return F.when(has_non_ascii(text) & text.rlike(holds), F.array_join(found, "")).otherwise(text)

    return let(col, swap)


def has_non_ascii(col: Column) -> Column:
    return F.octet_length(col) != F.length(col)


def describe_emoji(col: Column) -> Column:
    """Each emoji becomes its name between blanks; of several readings the longest sequence counts.

    Two flag letters are ``flag_us``, a flag with tags ``flag_gbeng``, a keycap ``keycap_1``; emoji that are joined or have a
    skin tone are the names of their parts, joined (``man_woman_girl``, ``waving_hand_sign_dark_skin_tone``). The selector
    of the coloured form goes. A sequence without any named part stays as it is.
    """
    names, tones, marks = literal_map(emoji_names()), literal_map(SKIN_TONES), literal_map(KEYCAP_MARKS)
    listed, flags = _wide_class(emoji_names()), f"[{_between(FLAG_LETTERS)}]"
    one = f"[{listed}][{''.join(SKIN_TONES)}]?{COLOURED}?"
    keycap = f"[0-9#*]{COLOURED}?{KEYCAP}"
    pieces = "|".join([
        keycap, f"{flags}{{2}}", f"{BLACK_FLAG}[{_between(TAGS)}]+{LAST_TAG}", f"{one}(?:{JOINER}{one}){{0,{MOST_JOINED - 1}}}",
        # Classes alone between them, which match texts of any length without recursion.
        f"[^{listed}0-9#*]+", f"[0-9#*]+(?!{COLOURED}?{KEYCAP})",
    ])
    letters, tags = ["".join(map(chr, range(first, last + 1))) for first, last in (FLAG_LETTERS, TAGS)]
    plain_tags = "".join(chr(ord(c) - 0xE0000) for c in tags)

    def part(p: Column, i: Column) -> Column:
        return F.coalesce(F.when(i > 0, F.try_element_at(tones, p)), F.try_element_at(names, p))

    def joined(p: Column) -> Column:
        parts = F.regexp_extract_all(p, F.lit(f"[^{JOINER}{COLOURED}]"), F.lit(0))
        named = F.filter(F.transform(parts, part), lambda n: n.isNotNull())
        return let(F.array_join(named, "_"), lambda n: F.when(n == "", p).otherwise(F.concat(F.lit(" "), n, F.lit(" "))))

    def name(p: Column) -> Column:
        return (
            F.when(F.length(p) == 1, F.coalesce(F.concat(F.lit(" "), F.try_element_at(names, p), F.lit(" ")), p))
            .when(p.rlike(f"^{flags}{{2}}$"), F.concat(F.lit(" flag_"), F.translate(p, letters, "abcdefghijklmnopqrstuvwxyz"), F.lit(" ")))
            .when(p.rlike(f"^{keycap}$"), let(F.substring(p, 1, 1), lambda m: F.concat(
                F.lit(" keycap_"), F.coalesce(F.try_element_at(marks, m), m), F.lit(" "))))
            .when(p.rlike(f"^{BLACK_FLAG}.*{LAST_TAG}$"), F.concat(
                F.lit(" flag_"), F.regexp_replace(F.translate(p, tags, plain_tags), f"{BLACK_FLAG}|{LAST_TAG}", ""), F.lit(" ")))
            .when(p.rlike(f"^[{listed}]"), joined(p)).otherwise(p)
        )

    def swap(text: Column) -> Column:
        found = F.transform(F.regexp_extract_all(text, F.lit(pieces), F.lit(0)), name)
        return F.when(has_non_ascii(text) & text.rlike(f"{_NON_ASCII}[{listed}{KEYCAP}]"), F.array_join(found, "")).otherwise(text)

    return let(col, swap)


def _between(span: tuple[int, int]) -> str:
    return f"\\x{{{span[0]:X}}}-\\x{{{span[1]:X}}}"


def to_ascii(col: Column) -> Column:
    """Compatibility-decompose, then drop what is neither ASCII nor white space."""
    single, several = ascii_residues()
    opened = _swap_chars(col, several)
    mapped = F.translate(opened, "".join(single), "".join(single.values()))
    return _guarded(mapped, has_non_ascii, lambda x: F.regexp_replace(x, f"{_NON_ASCII}[^{WS_WIDE}]", ""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to a value that is computed once, however often the body mentions it."""
    return F.transform(F.array(value), body)[0]


def _guarded(value: Column, condition: Column | Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    """The value, changed where the condition holds; a condition on the value itself is given as a function."""
    return let(value, lambda x: F.when(condition(x) if callable(condition) else condition, change(x)).otherwise(x))


def clean_text(col: Column, emoji: str = "describe", compat: bool = False, runs: bool = True) -> Column:
    """All cleaning steps in order; null gives an empty string.

    Each family of patterns runs only on rows that hold its trigger character, so a plain post pays for a few byte
    searches instead of fifteen regex passes. The guards read the original text, which is safe because no step adds a
    trigger character. Every intermediate value is bound once: written as plain nested ``when`` the optimizer would
    double the expression at each step.

    ``runs=False`` leaves runs of white space and of ``. ! ?`` as they are. Word characters and what lies between them are the
    same, so the tokens are too.
    """
    if emoji not in ("describe", "remove", "remove_wide", "keep"):
        raise ValueError(f"unknown emoji mode {emoji!r}")
    return let(F.coalesce(col, F.lit("")), lambda raw: _clean(raw, emoji, compat, runs))


def _clean(raw: Column, emoji: str, compat: bool, runs: bool) -> Column:
    # One search finds out whether there is any trigger character, or any that is deleted; all triggers but - are deleted.
    odd = raw.rlike(f"[{_DROPPED_BITS}\\-]")
    cleaned = let(odd, lambda found: let(
        F.when(found, _unmark(raw, compat)).otherwise(raw),
        lambda x: F.when(has_non_ascii(x), _clean_unicode(x, emoji, runs)).otherwise(_clean_ascii(x, found, runs)),
    ))
    return F.trim(cleaned) if runs else cleaned


def _unmark(raw: Column, compat: bool) -> Column:
    cur = raw
    for triggers, rules in _families(compat):
        cur = _guarded(cur, _any_of(raw, triggers), lambda x: _apply(x, rules))
    # Addresses and mentions once more: markup in between may have hidden a match.
    return _guarded(cur, raw.contains("/"), lambda x: strip_urls_mentions(x, compat))


def _clean_ascii(text: Column, odd: Column, runs: bool) -> Column:
    cur = squash_whitespace(text, ascii_text=True) if runs else text
    cur = _guarded(cur, odd, lambda x: keep_basic_chars(x, ascii_text=True))
    return squash_punctuation(cur) if runs else cur


def _clean_unicode(text: Column, emoji: str, runs: bool) -> Column:
    """One pass serves a text of common characters; others get their emoji named and another try, and only then every step."""

    def common(cur: Column, otherwise: Callable[[Column], Column]) -> Column:
        def settled(x: Column) -> Column:
            # Marks may meet only after letters between them have gone: then their order of steps counts.
            return ~has_non_ascii(x) & ~_any_of(x, _DOUBLE_MARKS) if runs else ~has_non_ascii(x)

        return let(cur, lambda c: let(_fold_common(c), lambda x: F.when(settled(x), x).otherwise(otherwise(c))))

    def every_step(cur: Column) -> Column:
        kept = keep_basic_chars(cur)
        return to_ascii(squash_punctuation(kept) if runs else kept)

    def named(cur: Column) -> Column:
        cur = squash_whitespace(cur) if runs else F.regexp_replace(cur, f"{_NON_ASCII}[{WS_WIDE}]", " ")
        if emoji == "describe":
            return describe_emoji(cur)
        return cur if emoji == "keep" else remove_emoji(cur, wide=emoji == "remove_wide")

    return common(squash_whitespace(text, ascii_text=True) if runs else text, lambda c: common(named(c), every_step))


def _any_of(col: Column, parts: Sequence[str]) -> Column:
    """Whether the text holds one of the parts (or of the characters of a string)."""
    cond = col.contains(parts[0])
    for part in parts[1:]:
        cond = cond | col.contains(part)
    return cond


# --- tokens ------------------------------------------------------------------------------------------------------


def tokenize(col: Column) -> Column:
    """Lower-cased runs of word characters and single punctuation marks."""
    mark = f"[^{_WORD_BITS}{_SPACE_BITS}](?<![{WS_WIDE}])"
    return F.regexp_extract_all(F.lower(col), F.lit(f"[{_WORD_BITS}]+|{mark}"), F.lit(0))


def tokenize_words(col: Column) -> Column:
    """The tokens that are no punctuation mark."""
    return F.regexp_extract_all(F.lower(col), F.lit(f"[{_WORD_BITS}]+"), F.lit(0))


def tokenize_kept(col: Column) -> Column:
    """The tokens that :func:`filter_tokens` keeps: of two or more word characters, not all digits, not all underscores.

    One pattern by first character finds them, so that no token has to be tested by itself.
    """
    word, letters, digits = f"[{_WORD_BITS}]", f"[{_bits('az')}]", f"[{_bits('09')}]"
    kept = f"{letters}{word}+|{digits}++{word}+|_++{word}+"
    return F.regexp_extract_all(F.lower(col), F.lit(kept), F.lit(0))


def remove_stopwords(tokens: Column, stop_words: Iterable[str]) -> Column:
    """Drop listed tokens; a long literal list becomes a hash lookup."""
    words = sorted(set(stop_words))
    return F.filter(tokens, lambda t: ~t.isin(*words))


def lemmatize(tokens: Column, lemmas: Mapping[str, str]) -> Column:
    """Replace tokens found in a small literal table; for a large one see ``operators.lookup.lemmatize_by_table``."""
    table = literal_map(lemmas)
    known = list(lemmas)
    return F.transform(
        tokens, lambda t: F.when(t.isin(*known), F.try_element_at(table, t)).otherwise(t)
    )


def filter_tokens(tokens: Column) -> Column:
    """Keep tokens of two or more characters that are neither all digits nor all punctuation."""
    return F.filter(
        tokens, lambda t: (F.length(t) >= 2) & ~t.rlike("^[0-9]+$") & ~t.rlike(PUNCT_ONLY)
    )


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of n neighbouring tokens joined by a blank."""
    grams = tokens
    for k in range(2, n + 1):
        count = F.greatest(F.size(tokens) - (k - 1), F.lit(0))
        grams = F.zip_with(
            F.slice(grams, F.lit(1), count), F.slice(tokens, F.lit(k), count), lambda a, b: F.concat(a, F.lit(" "), b)
        )
    return grams
