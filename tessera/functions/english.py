"""An English analyzer for keyword search: tokens of several classes, of which words and hyphenated words are stemmed (the
published Porter2 algorithm), stop words are dropped, and numbers, addresses and hosts stay as they are.

Stop words leave their place, as an empty word, so that phrases keep their distances. Tokens are found by Column expressions;
stems are taken of the distinct words of a corpus, and joined back.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that carry no meaning of their own.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
    itself they them their theirs themselves what which who whom this that these those am is are was were be been being have
    has had having do does did doing a an the and but if or because as until while of at by for with about against between
    into through during before after above below to from up down in out on off over under again further then once here there
    when where why how all any both each few more most other some such no nor not only own same so than too very s t can will
    just don should now""".split()
)
#: Words with stems of their own, and words that stay from some step on.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
SAME = frozenset("sky news howe atlas cosmos bias andes".split())
SAME_LATER = frozenset("inning outing canning herring earring proceed exceed succeed".split())
#: Endings and what they become, longest first within a step.
SECOND = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"),
    ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
THIRD = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
FOURTH = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")

_REGION = re.compile(r"[aeiouy][^aeiouy]")
_VOWEL = re.compile(r"[aeiouy]")
_SHORT = re.compile(r"(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")


def _after(word: str, start: int) -> int:
    m = _REGION.search(word, start)
    return m.end() if m else len(word)


def _first_region(word: str) -> int:
    return next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None) or _after(word, 0)


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        return w[:-1]
    return w


def _past(w: str, r1: int) -> str:
    for end in ("eedly", "eed"):
        if w.endswith(end):
            return w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
    for end in ("ingly", "edly", "ing", "ed"):
        if w.endswith(end):
            stem = w[: -len(end)]
            if not _VOWEL.search(stem):
                return w
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if stem[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
                return stem[:-1]
            return stem + "e" if r1 >= len(stem) and _SHORT.search(stem) else stem
    return w


@functools.lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word in SPECIAL or word in SAME:
        return SPECIAL.get(word, word)
    w = re.sub(r"(^|(?<=[aeiouy]))y", "Y", word)
    r1 = _first_region(w)
    r2 = _after(w, r1)
    w = _plural(w)
    if w in SAME_LATER:
        return w
    w = _past(w, r1)
    if len(w) > 2 and w[-1] in "yY" and not _VOWEL.match(w[-2]):
        w = w[:-1] + "i"
    for end, new in SECOND:
        if w.endswith(end):
            before = w[: -len(end)]
            fits = {"ogi": before.endswith("l"), "li": before[-1:] in tuple("cdeghkmnrt")}.get(end, True)
            if len(before) >= r1 and fits:
                w = before + new
            break
    for end, new in THIRD:
        if w.endswith(end):
            before = w[: -len(end)]
            if len(before) >= (r2 if end == "ative" else r1):
                w = before + new
            break
    for end in FOURTH:
        if w.endswith(end):
            before = w[: -len(end)]
            if len(before) >= r2 and (end != "ion" or before.endswith(("s", "t"))):
                w = before
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT.search(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def lexeme(word: str) -> str:
    return "" if word in STOP_WORDS else stem(word)


# -- classes of tokens ----------------------------------------------------------------------------------------------

#: What is one token, in the order in which it is looked for: addresses, hosts with what follows them, hyphenated words, words
#: that begin with digits, numbers with their sign, words.
TOKEN = (
    r"[\p{L}\p{N}][\p{L}\p{N}._+-]*@(?:[\p{L}\p{N}-]+\.)+[a-z]{2,}"
    r"|(?:[\p{L}\p{N}-]+\.)+[a-z]{2,}(?:/[^\s<>\"']*)?"
    r"|\p{L}[\p{L}\p{N}]*(?:-[\p{L}\p{N}]+)+"
    r"|\p{N}+\p{L}[\p{L}\p{N}]*"
    r"|[-+]?\p{N}+(?:\.\p{N}+)*"
    r"|[\p{L}\p{N}]+"
)
#: Classes by what a token looks like, the first that fits.
CLASSES = (
    ("email", r"^[^/]*@"),
    ("url", r"^[^/]*\.[^/]*/"),
    ("path", r"^/"),
    ("host", r"^(?:[\p{L}\p{N}-]+\.)+[a-z]{2,}$"),
    ("hyphenated", r"^\p{L}+(?:-\p{L}+)+$"),
    ("hyphenated_number", r"^\p{L}[\p{L}\p{N}]*(?:-[\p{L}\p{N}]+)+$"),
    ("word", r"^\p{L}+$"),
    ("integer", r"^[-+]?\p{N}+$"),
    ("decimal", r"^[-+]?\p{N}+\.\p{N}+$"),
    ("version", r"^[-+]?\p{N}+(?:\.\p{N}+){2,}$"),
    ("word_number", r""),
)
#: Those that stop words and stems are for; other tokens stay as they are.
STEMMED = ("word", "hyphenated")


def token_class(token: Column) -> Column:
    return F.coalesce(*[F.when(token.rlike(pattern), name) for name, pattern in CLASSES])


def class_tokens(text: Column) -> Column:
    """The tokens of a text in order. A hyphenated word is one, and then each of its parts; an address with a path is one, and
    then its host and its path."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))

    def parts(t: Column) -> Column:
        address = t.contains("@")
        path = t.contains("/")
        whole = F.array(t)
        return (
            F.when(~address & path, F.array(t, F.substring_index(t, "/", 1), F.concat(F.lit("/"), F.substring(t, F.instr(t, "/") + 1, F.length(t)))))
            .when(~address & t.rlike(r"^\p{L}[\p{L}\p{N}]*-") & ~t.contains("."), F.concat(whole, F.split(t, "-")))
            .otherwise(whole)
        )

    return F.flatten(F.transform(found, parts))


@F.pandas_udf(StringType())
def _stems(words: pd.Series) -> pd.Series:
    return words.map(lexeme, na_action="ignore")


def dictionary(words: DataFrame) -> DataFrame:
    """word and lexeme of distinct words (word): stems are taken of each once, however often a corpus has it. The lexeme of
    a stop word is empty."""
    kind = token_class(F.col("word"))
    return words.select("word", F.when(kind.isin(*STEMMED), _stems("word")).otherwise(F.col("word")).alias("lexeme"))


@dataclass(frozen=True)
class Analyzer:
    """tokens of a text, and what the distinct ones become."""

    tokens: Callable[[Column], Column]
    dictionary: Callable[[DataFrame], DataFrame]

    def __call__(self, text: Column) -> Column:
        return self.tokens(text)


#: The analyzer of documents, for postings() and matches().
english = Analyzer(class_tokens, dictionary)

_TOKEN = regex.compile(TOKEN)
_CLASSES = [(name, regex.compile(pattern)) for name, pattern in CLASSES]


def query_words(text: str) -> list[str]:
    """The analyzer of queries, for parse_query(): as documents are analyzed, a stop word being empty."""
    words: list[str] = []
    for t in _TOKEN.findall(text.lower()):
        words.append(t)
        if "@" not in t and "/" in t:
            host, _, path = t.partition("/")
            words += [host, f"/{path}"]
        elif "@" not in t and "." not in t and regex.match(r"\p{L}[\p{L}\p{N}]*-", t):
            words += t.split("-")
    kinds = [next(name for name, pattern in _CLASSES if pattern.search(w)) for w in words]
    return [lexeme(w) if kind in STEMMED else w for w, kind in zip(words, kinds, strict=True)]
