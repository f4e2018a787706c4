"""Parameter tables: lexicons, stages, guidelines, events and windows.

Every operator takes these as arguments, so a user can pass their own. Terms are matched on lower-cased text.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date


@dataclass(frozen=True)
class Stage:
    """One topic stage: patterns looked for in the group name, then keywords looked for in the text."""

    name: str
    groups: tuple[str, ...]
    keywords: tuple[str, ...]


@dataclass(frozen=True)
class Guideline:
    """Labelling rule: one point per keyword found, plus the bonuses that are switched on."""

    label: str
    keywords: tuple[str, ...]
    question_bonus: bool = False
    fear_bonus: bool = False


@dataclass(frozen=True)
class PolicyEvent:
    name: str
    day: date


# --- fixed values: terms, labels, dates and windows the results depend on -----------------------------------------

LABELS = ("fear", "question", "fear_driven_question", "other")

FEAR_9 = ("afraid", "scared", "worried", "anxious", "panic", "terrified", "fear", "concern", "nervous")

QA_9 = ("?", "how", "what", "when", "where", "why", "can i", "should i", "help")

# The question mark escaped twice: this variant only finds a backslash before it.
QA_9_ESCAPED = ("\\?", "how", "what", "when", "where", "why", "can i", "should i", "help")

FEAR_WORDS = ("afraid", "scared", "worried", "anxious", "panic", "fear", "terrified", "nervous")
REFUSAL_WORDS = ("denied", "rejected", "refused", "failed")
URGENCY_WORDS = ("emergency", "urgent", "help", "desperate")
FEAR_WORDS_3GROUP = FEAR_WORDS + REFUSAL_WORDS + URGENCY_WORDS
WH_WORDS = ("how", "what", "when", "where", "why")
QUESTION_WORDS = WH_WORDS + ("can", "could", "should", "would")

STAGES_6_WIDE = {
    "F1": ("f1", "student visa", "student", "f-1", "f1 visa", "student status", "f1 status"),
    "OPT": ("opt", "optional practical training", "stem opt", "cpt", "work authorization", "opt status"),
    "H1B": ("h1b", "h-1b", "work visa", "h1-b", "h1b visa", "employment visa", "h1b status"),
    "greencard": ("green card", "greencard", "permanent resident", "gc", "i-140", "i-485", "permanent residency"),
    "citizenship": ("citizenship", "naturalization", "citizen", "n-400", "naturalized", "citizen status"),
    "general_immigration": (
        "immigration", "visa", "immigrant", "uscis", "immigration law", "immigration status",
    ),
}

STAGES_6_NARROW = {
    "F1": ("f1", "student visa", "student"),
    "OPT": ("opt", "optional practical training"),
    "H1B": ("h1b", "h-1b", "work visa"),
    "greencard": ("green card", "greencard", "permanent resident"),
    "citizenship": ("citizenship", "naturalization", "citizen"),
    "general_immigration": ("immigration", "visa", "immigrant"),
}

# Order matters: the first stage that matches wins.
STAGES_5 = (
    Stage(
        "student_visa",
        ("f1visa", "opt", "stemopt", "immigration", "visa", "immigrationusa", "uscisquestions"),
        ("f1", "cpt", "opt", "stem opt", "visa interview", "visa stamping", "visa appointment",
         "work authorization", "i-765", "visa renewal", "visa status maintenance"),
    ),
    Stage(
        "work_visa",
        ("h1b", "workvisas", "immigrationlaw", "immigrationattorney", "immigrationusa", "uscisquestions"),
        ("h1b", "h-1b", "employer sponsor", "job search visa issues", "employer withdrawal", "visa denial",
         "visa delays", "immigration backlog", "immigration policy changes"),
    ),
    Stage(
        "permanent_residency",
        ("greencard", "greencardprocess", "immigration", "uscis", "immigrationlaw", "uscisquestions"),
        ("i-140", "perm", "green card", "gc", "adjustment of status", "consular processing", "priority date",
         "visa bulletin", "rfe", "uscis case status", "i-485", "denial", "delay"),
    ),
    Stage(
        "citizenship",
        ("citizenship", "immigration", "uscis", "immigrationlaw"),
        ("citizenship", "naturalization", "immigration reform", "travel ban", "deportation risk",
         "immigration policy changes"),
    ),
    Stage(
        "general_immigration",
        ("immigration", "immigrationlaw", "uscis", "immigrationusa", "immigrationquestions", "visasupport",
         "immigrationattorney", "immigrationnews"),
        ("visa denial", "visa delays", "immigration backlog", "immigration reform", "legal help",
         "work authorization", "immigration policy"),
    ),
)

UNKNOWN = "unknown"

GUIDELINES_4 = (
    Guideline("fear", FEAR_WORDS_3GROUP, fear_bonus=True),
    Guideline("question", QUESTION_WORDS + ("?",), question_bonus=True),
    Guideline("fear_driven_question", FEAR_WORDS_3GROUP + QUESTION_WORDS + ("?",),
              question_bonus=True, fear_bonus=True),
)

POLICY_EVENTS = (
    PolicyEvent("trump_travel_ban", date(2017, 1, 27)),
    PolicyEvent("h1b_suspension", date(2020, 6, 22)),
    PolicyEvent("biden_immigration_reform", date(2021, 1, 20)),
    PolicyEvent("daca_renewal", date(2021, 1, 20)),
    PolicyEvent("h1b_cap_increase", date(2021, 12, 6)),
)

WINDOWS = {"short_term": 30, "medium_term": 90, "long_term": 180}

DOMAIN_STOP_WORDS = (
    "reddit", "post", "comment", "thread", "subreddit", "user",
    "visa", "immigration", "uscis", "h1b", "f1", "green", "card",
)

TEXT_NAME_PARTS = ("text", "body", "content", "comment", "post")
DATE_NAME_PARTS = ("date", "time")
REQUIRED_COLUMNS = ("text", "subreddit", "created_utc")

MIN_TEXT_LENGTH = 10
SAMPLE_RATE = 0.01
MIN_ROWS_PER_FILE = 100
AUTO_LABEL_THRESHOLD = 0.7
WEAK_SCORE = 0.3
SENTIMENT_THRESHOLD = 0.1

# --- end of fixed values ---------------------------------------------------------------------------------------

# A small starter table for the sentiment operator; pass a full lexicon for real work.
POLARITY_STARTER = {
    "approved": 0.6, "happy": 0.8, "thanks": 0.4, "great": 0.8, "good": 0.7, "best": 1.0, "lucky": 0.4, "easy": 0.4,
    "denied": -0.6, "scared": -0.5, "worried": -0.4, "afraid": -0.6, "bad": -0.7, "worst": -1.0, "hard": -0.3,
    "terrified": -0.8,
}

# Starter words that turn or strengthen the next polar word; apostrophes are gone after cleaning.
NEGATION_STARTER = ("not", "no", "never", "none", "neither", "nor", "without", "cannot", "cant", "dont", "doesnt", "didnt",
                    "isnt", "wasnt", "arent", "werent", "wont", "wouldnt", "shouldnt", "couldnt", "hardly")
STRENGTH_STARTER = {"very": 1.3, "really": 1.3, "so": 1.2, "too": 1.2, "extremely": 1.5, "totally": 1.4, "absolutely": 1.4,
                    "quite": 1.1, "pretty": 1.1, "somewhat": 0.7, "slightly": 0.5, "barely": 0.4}

# A starter lemma table (surface form to noun lemma); pass a full one for real work.
LEMMA_STARTER = {
    "interviews": "interview", "visas": "visa", "cards": "card", "petitions": "petition", "lawyers": "lawyer",
    "children": "child", "men": "man", "women": "woman", "people": "people", "policies": "policy",
}

#: Endings of English plurals and what the singular has in their place, in the order they are tried.
NOUN_ENDINGS = (("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"),
                ("men", "man"), ("ies", "y"))

#: The English stop words of Spark's own list, here as text so that no session or jar is needed to read them.
ENGLISH_STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves",
    "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their",
    "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are",
    "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an",
    "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about",
    "against", "between", "into", "through", "during", "before", "after", "above", "below", "to", "from", "up",
    "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when",
    "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no",
    "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don",
    "should", "now", "i'll", "you'll", "he'll", "she'll", "we'll", "they'll", "i'd", "you'd", "he'd", "she'd",
    "we'd", "they'd", "i'm", "you're", "he's", "she's", "it's", "we're", "they're", "i've", "we've", "you've",
    "they've", "isn't", "aren't", "wasn't", "weren't", "haven't", "hasn't", "hadn't", "don't", "doesn't", "didn't",
    "won't", "wouldn't", "shan't", "shouldn't", "mustn't", "can't", "couldn't", "cannot", "could", "here's",
    "how's", "let's", "ought", "that's", "there's", "what's", "when's", "where's", "who's", "why's", "would",
)
