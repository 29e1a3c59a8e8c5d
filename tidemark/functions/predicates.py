"""Tests of words, sentences, scripts and addresses, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import text as T

# Words after which speech is interrupted.
INTERRUPTIONS = (
    "yes,", "yeah,", "no,", "okay,", "ok,", "right,", "well,", "actually,", "really,", "indeed,", "certainly,", "sure,",
    "exactly,", "absolutely,", "definitely,", "probably,", "maybe,",
)
# Words that stand for a verb.
VERBS = (
    "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would",
    "could", "should", "can", "may", "might", "must", "shall", "go", "goes", "went", "come", "comes", "came", "get",
    "gets", "got", "make", "makes", "made", "take", "takes", "took", "give", "gives", "gave", "see", "sees", "saw", "know",
    "knows", "knew", "think", "thinks", "thought", "say", "says", "said", "tell", "tells", "told", "want", "wants",
    "wanted", "need", "needs", "needed", "like", "likes", "liked", "work", "works", "worked",
)
# Languages that are cut by characters.
ASIAN = ("zh_cn", "zh_tw", "ja", "ko", "th")
# Ranges of scripts.
HAN = r"\x{4e00}-\x{9fff}"
CJK = r"\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{ac00}-\x{d7af}\x{ff00}-\x{ffef}"
THAI = r"\x{0e00}-\x{0e7f}"
WIDE = r"\x{0590}-\x{05ff}\x{0600}-\x{06ff}\x{0900}-\x{097f}\x{0980}-\x{09ff}\x{0b80}-\x{0bff}"
#: Letters of the Latin, Greek and Cyrillic blocks.
ALPHABETIC = (
    r"A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}\x{370}-\x{374}\x{376}\x{377}\x{37a}-\x{37d}\x{37f}\x{386}"
    r"\x{388}-\x{38a}\x{38c}\x{38e}-\x{3a1}\x{3a3}-\x{3f5}\x{3f7}-\x{3ff}\x{400}-\x{481}\x{48a}-\x{4ff}"
)


def interrupts(next_word: Column) -> Column:
    """Whether the next word breaks in; false where there is none."""
    return F.coalesce(F.lower(T.trim(next_word)).isin(*INTERRUPTIONS), F.lit(False))


VERB_PATTERN = f"(^| )({'|'.join(VERBS)}) "


def complete_phrase(words: Column) -> Column:
    """Three words or more, one of which is a verb but not the last."""
    return (F.size(words) >= 3) & F.lower(F.array_join(words, " ")).rlike(VERB_PATTERN)


def short_sentence(text: Column) -> Column:
    return F.size(T.fields(text)) < 3


def too_short(text: Column, least: int) -> Column:
    return T.effective_chars(T.trim(text)) < least


def cut_by_characters(lang: Column) -> Column:
    return lang.isin(*ASIAN)


def has_script(text: Column, ranges: str) -> Column:
    return text.rlike(f"[{ranges}]")


def quote_dropped(text: Column) -> Column:
    """A lone double quote as nothing."""
    return F.when(text == '"', "").otherwise(text)


def video_host(url: Column) -> Column:
    return F.contains(F.lower(T.trim(url)), F.lit("youtube.com"))


def video_id(url: Column) -> Column:
    """The v of a watch page, null where it has none, and else the last part of the path."""
    path = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    v = F.regexp_extract(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), r"(?:^|&)(v=[^&]*)", 1)
    return F.when(F.contains(path, F.lit("watch")), F.when(v != "", F.substring(v, 3, 1 << 30))).otherwise(F.element_at(F.split(path, "/"), -1))


def bv_id(url: Column) -> Column:
    """The number of a second host's videos; empty for other addresses."""
    return F.regexp_extract(url, r"https://(?:www\.)?bilibili\.com/(?:video/|video/av[0-9]+/)(BV[a-zA-Z0-9]+)", 1)
