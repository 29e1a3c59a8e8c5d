"""Widths and cuts of subtitle lines, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import predicates as P
from tidemark.functions import text as T

BLANK = r"\s\x0b\x{85}\p{Z}"
# Share of the font size by class of character; a character counts for the first class it is in.
CLASSES = ((BLANK, 0.33), (P.CJK, 1.0), (P.THAI, 0.92), (P.WIDE, 0.95), ("A-Z", 0.66), ("a-z", 0.56), ("0-9", 0.56), (r"\p{P}", 0.38))
OTHER = 0.62


def text_width(text: Column, size: float, spacing: float = 0.0, scale: float = 1.0) -> Column:
    """Estimated width of a line of so many pixels of font size: classes of characters, spacing between them, scale."""
    rest, width = text, F.lit(0.0)
    for ranges, share in CLASSES:
        left = F.regexp_replace(rest, f"[{ranges}]", "")
        width = width + (F.char_length(rest) - F.char_length(left)) * F.lit(size * share)
        rest = left
    width = width + F.char_length(rest) * F.lit(size * OTHER)
    return (width + F.greatest(F.char_length(text) - 1, F.lit(0)) * F.lit(spacing)) * F.lit(scale)


def two_fifths(text: Column, lang: Column, most: int) -> Column:
    """The text as one line, or, with over `most` parts, as two, cut after two fifths of them.

    Parts are characters in languages that are cut by characters, else what stands between single spaces. Lines of a cut
    text lose punctuation at their ends.
    """
    by_characters = P.cut_by_characters(lang)
    parts = F.when(by_characters, F.filter(F.split(text, ""), lambda c: (c != "") & (c != "\n"))).otherwise(F.split(text, " "))
    n = F.size(parts)
    cut = F.greatest(F.floor(n * 2 / 5).cast("int"), F.lit(1))

    def line(start, length):
        some = F.slice(parts, start, length)
        return T.trim_punctuation(F.when(by_characters, F.array_join(some, "")).otherwise(F.array_join(some, " ")))

    return F.when(n <= most, F.array(text)).otherwise(F.array(line(F.lit(1), cut), line(cut + 1, n - cut)))


def ass_header(major: Column, minor: Column) -> Column:
    """Head of an ASS file with its two style lines."""
    return F.concat(F.lit(HEAD), major, F.lit("\n"), minor, F.lit(TAIL))


# The lines before and after the styles.
HEAD = """[Script Info]
Title: Example
Original Script: 
ScriptType: v4.00+
PlayDepth: 0

[V4+ Styles]
Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding
"""
TAIL = """


[Events]
Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text
"""


def bare_title(title: Column) -> Column:
    """A title without its markers, brackets and blanks at either end, curly quotes straight."""
    out = F.replace(F.replace(title, F.lit("[中文翻译]"), F.lit("")), F.lit("[英文句子]"), F.lit(""))
    return F.replace(F.rtrim(F.ltrim(out, F.lit(" [")), F.lit(" ]")), F.lit("’"), F.lit("'"))
