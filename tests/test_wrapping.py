"""Stated cases of wrapped lines."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import styles
from tidemark.functions import wrapping as R


def width(text):
    return sum(2 if "一" <= c <= "鿿" else 1 for c in text)


@pytest.fixture(scope="module")
def cut(spark):
    def run(column, **values):
        row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
        return row.select(column.alias("out")).first().out

    return run


def test_even_lines(cut):
    assert "小|时" not in "|".join(cut(R.even_lines(F.col("t"), 10), t="你花在刷屏上的每一小时"))
    tail = cut(R.even_lines(F.col("t"), 10), t="你每小时花在划屏上的时间")
    assert len(tail) == 2 and tail[1] != "时间"
    lines = cut(R.even_lines(F.col("t"), 10), t="你花在刷屏上的每一小时都会从未来的自己那里借走注意力")
    assert len(lines) >= 2 and abs(width(lines[0]) - width(lines[1])) <= 6
    assert cut(R.even_lines(F.col("t"), 10), t=" …， ") == [] and cut(R.even_lines(F.col("t"), 10), t=None) == []
    assert cut(R.even_lines(F.col("t"), 0), t="你" * 90) == ["你" * 90]


def test_wrapped_first_line_is_the_shorter(spark, cut):
    limit = spark.range(1).select(styles.line_width(F.lit(1920), F.lit(1080), F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(26))).first()[0]
    lines = cut(R.wrapped(F.col("t"), R.Line(limit, 26)), t="只是想让你知道你走在正确的道路上")
    assert len(lines) == 2 and width(lines[0]) < width(lines[1]) and "".join(lines) == "只是想让你知道你走在正确的道路上"
    words = ["很多", "克服", "糟糕", "的", "日子", "和", "重新", "开始"]
    lines = cut(R.wrapped(F.array_join("w", ""), R.Line(limit, 26), F.col("w")), w=words)
    assert len(lines) == 2 and "糟|糕" not in "|".join(lines)


def test_wrapping_of_fonts_and_scripts(cut):
    large = R.Line(348.0, 80)
    assert len(cut(R.wrapped(F.col("t"), large), t="这是一段字号很大的中文字幕如果不自动换行就会超出屏幕之外影响观看体验")) > 2
    assert cut(R.wrapped(F.col("t"), large), t="A long line of plain words that no script cuts") == ["A long line of plain words that no script cuts"]
    assert cut(R.wrapped_vertical(F.col("t"), R.Line(348.0, 14)), t="大多数人看完这个视频后什么也不会做。") == ["大多数人看完这个视频后什么也不会做"]
    assert len(cut(R.wrapped_vertical(F.col("t"), R.Line(100.0, 14)), t="plain words are cut here")) > 1
    assert cut(R.wrapped(F.col("t"), large), t="。。。") == []


def test_wide_tokens_are_cut_and_signs_stay(cut):
    line = R.Line(50.0, 10)
    assert cut(R.wrapped_tokens(F.col("w"), line), w=["一二三", "四五六七八九十百", "千"]) == ["一二三", "四五六七八", "九十百千"]
    assert cut(R.wrapped_tokens(F.col("w"), line), w=[*"一二三四五", "，", "六"]) == ["一二三四五", "六"]
    assert cut(R.wrapped_tokens(F.col("w"), line), w=[]) == []


def test_short_tails(cut):
    assert cut(R.short_tail(F.col("w")), w=["一二三四五六", "七"]) == ["一二三", "四五六七"]
    assert cut(R.short_tail(F.col("w")), w=["零", "一二的四五六", "七"]) == ["零", "一二的", "四五六七"]
    assert cut(R.short_tail(F.col("w")), w=["一二小时五", "六七"]) == ["一二", "小时五六七"]
    assert cut(R.short_tail(F.col("w")), w=["一二", "三"]) == ["一二", "三"]
