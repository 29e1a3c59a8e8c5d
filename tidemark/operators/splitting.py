"""Split of whole texts into sentences in which numbers, times, host names and abbreviations stay whole."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import DOUBLE_QUOTES
from tidemark.operators.folds import effective, merge_short

#: English words of two letters that are no country's ending: a sentence that begins with one right after a dot is cut off.
#: The other pairs of letters count as endings, in place of a table of them; a caller may bring one, see kept_patterns.
TWO_LETTER_WORDS = ("ah", "eh", "go", "ha", "he", "hi", "if", "oh", "of", "ok", "on", "or", "ow", "ox", "up", "we", "ya", "yo")
# What stays whole, in this order. Digits, letters and boundaries are ASCII.
KEPT = (
    r"\b\d+\.[a-zA-Z]",
    r"\b[a-zA-Z0-9-]+\.(?:com|org|net|edu|gov|mil|int|(?!WORDS)[a-z]{2})\b",
    r"(?i:\b[ap]\.m\.)",
    r"\b\d{1,2}[:\.]\d{2}[\t\n\f\r ]*(?:[ap]\.?m\.?|AM|PM)?\b",
    r"\b\d+\.\d+\b",
    r"\b\d{1,3}(?:,\d{3})+(?:\.\d+)?\b",
    r"\b\d+(?:\.\d+)+\b",
    r"\b(?:[A-Z][a-z]*\.){2,}|(?:[A-Z]\.){2,}[A-Z]?\b",
    r"\b(?:Mr|Mrs|Ms|Dr|Prof|Sr|Jr)\.",
    r"\b\d+\.[\t\n\f\r ]",
    r"\b[a-zA-Z]\.[\t\n\f\r ]",
)
SENTENCE_MARKS, CLAUSE_MARKS = ".!?。！？；\n\r", ".!?。！？；,，;\n\r"


def kept_patterns(endings: Sequence[str] | None = None) -> list[re.Pattern]:
    """KEPT, compiled; endings: the countries' endings, else all pairs of letters but TWO_LETTER_WORDS."""
    pair = f"(?!(?:{'|'.join(TWO_LETTER_WORDS)})\\b)[a-z]{{2}}" if endings is None else "|".join(endings) or "(?!)"
    return [re.compile(p.replace("(?!WORDS)[a-z]{2}", pair), re.ASCII) for p in KEPT]


_KEPT = kept_patterns()
_CUT = {marks: re.compile(f"(?<=[{marks}])(?![{marks}])") for marks in (SENTENCE_MARKS, CLAUSE_MARKS)}
_SIGN = "\ue000"
_STAND_IN = re.compile(f"{_SIGN}([0-9]+){_SIGN}")


def protect(text: str, patterns: list[re.Pattern] = _KEPT) -> tuple[str, list[str]]:
    """The text with a numbered stand-in for each part that stays whole, and these parts; patterns: see kept_patterns.

    A text that has the stand-ins' private sign already loses the sign.
    """
    parts: list[str] = []

    def stand_in(match: re.Match) -> str:
        parts.append(match[0])
        return f"{_SIGN}{len(parts) - 1}{_SIGN}"

    text = text.replace(_SIGN, "")
    for pattern in patterns:
        text = pattern.sub(stand_in, text)
    return text, parts


def restore(text: str, parts: list[str]) -> str:
    return _STAND_IN.sub(lambda m: parts[int(m[1])], text)


def cut(text: str, marks: str) -> list[str]:
    """Parts that end with a run of marks, trimmed, empty ones left out."""
    return [p for p in (x.strip() for x in _CUT[marks].split(text)) if p]


def split_text(text: str | None, most: int = 70, patterns: list[re.Pattern] = _KEPT) -> list[str]:
    """Sentences; one of `most` letters and digits or more is cut into clauses, of which short ones are joined again.

    A stand-in counts with the digits of its number. A quotation mark alone joins the sentence before it, and goes where
    there is none. Null, empty and blank texts have no sentence.
    """
    held, parts = protect(text or "", patterns)
    out: list[str] = []
    for sentence in cut(held, SENTENCE_MARKS):
        pieces = [sentence] if effective(sentence) < most else merge_short(cut(sentence, CLAUSE_MARKS), 20, most)
        for piece in (restore(p, parts).strip() for p in pieces):
            if piece not in DOUBLE_QUOTES:
                out.append(piece)
            elif out:
                out[-1] += piece
    return out


def protected_sentences(text: Column, most: int = 70, endings: Sequence[str] | None = None) -> Column:
    """split_text as a column: an array of strings; endings: of countries' host names, see kept_patterns."""
    patterns = kept_patterns(endings)

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, most, patterns))

    return split(text)
