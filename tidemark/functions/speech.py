"""Speech duration estimates and tempo."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import SPACE

# Characters a second, confidence, weights of pauses, digits and acronyms by language.
PROFILES = {
    "zh_cn": (4.2, 0.95, 0.30, 0.22, 0.12),
    "zh_tw": (4.1, 0.95, 0.30, 0.22, 0.12),
    "ja": (4.0, 0.94, 0.28, 0.20, 0.12),
    "ko": (4.3, 0.93, 0.28, 0.20, 0.12),
    "en": (13.5, 0.92, 0.24, 0.26, 0.32),
    "de": (11.8, 0.91, 0.24, 0.25, 0.28),
    "ru": (10.8, 0.90, 0.24, 0.24, 0.24),
    "tr": (12.0, 0.91, 0.24, 0.24, 0.26),
}
FALLBACK = (8.5, 0.5, 0.18, 0.10, 0.10)


def _count(text: Column, cls: str) -> Column:
    return F.char_length(F.regexp_replace(text, f"[^{cls}]", "")).cast("double")


def _extras(text: Column, pause: Column, digit: Column, acronym: Column) -> Column:
    pauses = _count(text, ",，、;；:：") * 0.22 + _count(text, ".。!！?？") * 0.28 + _count(text, "…—～") * 0.34
    runs = F.aggregate(F.regexp_extract_all(text, F.lit(r"\p{Lu}{2,}"), F.lit(0)), F.lit(0), lambda n, x: n + F.char_length(x))
    return pauses * pause + _count(text, r"\p{Nd}") * 0.12 * digit + runs * 0.18 * acronym


def _pick(lang: Column, i: int) -> Column:
    return reduce(lambda c, kv: c.when(lang == kv[0], F.lit(kv[1][i])), PROFILES.items(), F.when(F.lit(False), F.lit(0.0))).otherwise(F.lit(FALLBACK[i]))


def spoken_seconds(text: Column, lang: Column, factor: Column | float = 1.0) -> Column:
    """Estimated duration; languages without a profile take a general rate with a minimum of 0.2 s."""
    factor = factor if isinstance(factor, Column) else F.lit(factor)
    solid = F.char_length(F.regexp_replace(text, f"[{SPACE}]", "")).cast("double")
    extras = _extras(text, _pick(lang, 2), _pick(lang, 3), _pick(lang, 4))
    profiled = (solid / _pick(lang, 0) + extras) * factor
    words = F.size(F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")).cast("double")
    general = solid / FALLBACK[0] + words * 0.12 + _count(text, r"\p{Nd}") * 0.08 + _count(text, r"\p{L}") * 0.01 + extras
    return F.when(solid == 0, 0.0).when(lang.isin(*PROFILES), profiled).otherwise(F.greatest(general, F.lit(0.2)))


def confidence(lang: Column) -> Column:
    return _pick(lang, 1)


def tempo_chain(speed: Column) -> Column:
    """Factors between 0.5 and 2 whose product is the speed, as atempo=... steps; null unless finite and above 0."""
    ok = (speed > 0) & ~F.isnan(speed) & (speed < float("inf"))
    doubles = F.greatest(F.ceil(F.log2(speed)) - 1, F.lit(0)).cast("int")
    halves = F.greatest(F.ceil(-F.log2(speed)) - 1, F.lit(0)).cast("int")
    rest = speed / F.pow(F.lit(2.0), doubles) * F.pow(F.lit(2.0), halves)
    steps = F.concat(F.array_repeat(F.lit("atempo=2.000"), doubles), F.array_repeat(F.lit("atempo=0.500"), halves), F.array(F.format_string("atempo=%.3f", rest)))
    return F.when(ok, F.array_join(steps, ","))


def calibrated(pairs: DataFrame, by: str, order: list[str], estimated: str, actual: str, width: int = 10_000) -> DataFrame:
    """by, factor: an exponential mean (0.7 old, 0.3 new) of actual over estimated, each clamped to 0.5 to 1.5.

    The n-th of m ratios weighs 0.3 * 0.7^(m - n) and the start value 1 weighs 0.7^m. Rows are ranked within ranges of
    `width` of the first, whole-numbered column of the order, each range is summed up, and the sums are put together by
    how many rows come after a range: no task ranks a whole language. Pairs with a value of 0 or less are left out.
    """
    from pyspark.sql import Window as W

    good = pairs.where((F.col(estimated) > 0) & (F.col(actual) > 0))
    ratio = F.least(F.greatest(F.col(actual) / F.col(estimated), F.lit(0.5)), F.lit(1.5))
    part = F.floor(F.col(order[0]) / width)
    later = F.row_number().over(W.partitionBy(by, "__part").orderBy(*[F.col(c).desc() for c in order])) - 1
    rows = good.withColumn("__part", part).select(by, "__part", ratio.alias("ratio"), later.alias("later"))
    parts = rows.groupBy(by, "__part").agg(F.sum(F.col("ratio") * 0.3 * F.pow(F.lit(0.7), F.col("later"))).alias("sum"), F.count(F.lit(1)).alias("n"))
    after = F.coalesce(F.sum("n").over(W.partitionBy(by).orderBy(F.col("__part").desc()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = parts.withColumn("after", after)
    return placed.groupBy(by).agg((F.sum(F.col("sum") * F.pow(F.lit(0.7), F.col("after"))) + F.pow(F.lit(0.7), F.sum("n"))).alias("factor"))
