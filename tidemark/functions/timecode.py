"""Media time: parsing to seconds or milliseconds, and the formats, each with its own rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VTT_TIME = r"^(?:([0-9]+):)?([0-9]+):([0-9]+)\.([0-9]+)$"
STRICT_TIME = r"^\s*([0-9]+):([0-5]?[0-9]):([0-5]?[0-9]),([0-9]{1,3})\s*$"


def _group(text: Column, pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, i), F.lit("")).try_cast("bigint")


def vtt_millis(text: Column) -> Column:
    """H:M:S.ms or M:S.ms in milliseconds; the part after the dot is a whole number, so .8 is 8 ms. Null if malformed."""
    g = lambda i: _group(text, VTT_TIME, i)
    return (F.coalesce(g(1), F.lit(0)) * 3600 + g(2) * 60 + g(3)) * 1000 + g(4)


def vtt_seconds(text: Column) -> Column:
    return vtt_millis(text) / 1000.0


def srt_millis(text: Column) -> Column:
    """As vtt_millis, after the first comma has become a dot."""
    return vtt_millis(F.regexp_replace(F.regexp_replace(text, "^([^,]*),", "$1."), r"\s", ""))


def strict_millis(text: Column) -> Column:
    """H:M:S,ms with every part in its range, else null. The text is taken apart once."""
    value = lambda p: ((p[0].try_cast("bigint") * 3600 + p[1].cast("bigint") * 60 + p[2].cast("bigint")) * 1000) + p[3].cast("bigint")
    parts = F.array(F.split(F.regexp_replace(text, r"\s", ""), "[:,]"))
    return F.when(text.rlike(STRICT_TIME), F.get(F.transform(parts, value), F.lit(0)))


def _hms(millis: Column, sep: str, digits: int = 3, hours: str = "%02d") -> Column:
    whole = F.floor(millis / 1000)
    rest = millis % 1000 if digits == 3 else F.floor((millis % 1000) / 10)
    return F.format_string(f"{hours}:%02d:%02d{sep}%0{digits}d", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60, rest)


def srt_from_millis(millis: Column) -> Column:
    """HH:MM:SS,mmm of whole milliseconds; negative ones count as 0."""
    return _hms(F.greatest(millis.cast("bigint"), F.lit(0).cast("bigint")), ",")


def srt_half_up(seconds: Column) -> Column:
    """HH:MM:SS,mmm with milliseconds rounded half up; negative seconds count as 0."""
    return srt_from_millis(F.floor(F.greatest(seconds, F.lit(0.0)) * 1000 + 0.5))


def srt_truncated(seconds: Column) -> Column:
    """HH:MM:SS,mmm with the milliseconds of the fraction cut off, in double precision."""
    whole = F.floor(seconds)
    return srt_from_millis(whole * 1000 + F.floor((seconds - whole) * 1000))


def srt_float_truncated(seconds: Column) -> Column:
    """HH:MM:SS,mmm cut off after the seconds have been rounded to single precision."""
    single = seconds.cast("float")
    whole = single.cast("int")
    return srt_from_millis(whole.cast("bigint") * 1000 + ((single - whole.cast("float")) * F.lit(1000.0).cast("float")).cast("float").cast("int"))


def ass_time(millis: Column) -> Column:
    """HH:MM:SS.cc with centiseconds cut off."""
    return _hms(millis.cast("bigint"), ".", 2)


def srt_line(start: Column, end: Column) -> Column:
    return F.concat(start, F.lit(" --> "), end)


def vtt_to_srt(text: Column) -> Column:
    """The first dot as a comma."""
    return F.regexp_replace(text, r"^([^.]*)\.", "$1,")


def ass_millis(text: Column) -> Column:
    """H:M:S,ms in milliseconds with three parts and one comma or dot, the last a whole number; null if malformed."""
    g = lambda i: _group(F.regexp_replace(text, "^([^,]*),", "$1."), r"^([+-]?[0-9]+):([+-]?[0-9]+):([+-]?[0-9]+)\.([+-]?[0-9]+)$", i)
    return (g(1) * 3600 + g(2) * 60 + g(3)) * 1000 + g(4)
