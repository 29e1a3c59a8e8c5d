"""Subtitle lines of bounded width, as column expressions: wrapping, balancing of two lines, lines of equal width.

A text comes as its tokens (characters, or words of a segmenter that the caller brings). Everything is a fold over the
tokens of one text inside the JVM, so that texts stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import layout
from tidemark.functions import predicates as P
from tidemark.functions import text as T

# Signs that stay on a line, signs and particles that a line is best cut after, pairs and a triple of
# characters that stay together.
STICKY = "，,.。！？”\"》"
CUT_SIGNS = "，。！？；：、,.!?;:"
PARTICLES = "的了着过呢吗吧啊呀和与或但而就都也"
KEPT_PAIRS = ("小时", "分钟", "秒钟", "今天", "明天", "自己", "人生", "目标", "规则", "注意", "未来", "屏幕")
KEPT_TRIPLE = "每一小"
#: A vertical line has so many full-width characters at most.
VERTICAL_MOST = 18


class Line(NamedTuple):
    """Width that a line may have, in pixels, and how wide its font is; see functions.styles.line_width."""

    limit: float
    size: float
    spacing: float = 0.0
    scale: float = 1.0

    def width(self, text: Column) -> Column:
        """As layout.text_width, for short texts: one look at each character."""
        total = F.aggregate(characters(text), F.lit(0.0), lambda s, c: s + self.share(c))
        return (total + F.greatest(F.char_length(text) - 1, F.lit(0)) * F.lit(self.spacing)) * F.lit(self.scale)

    def share(self, char: Column) -> Column:
        """Width of one character by its class; the commonest classes are asked for first, as no two overlap."""
        blank, cjk, thai, wide, upper, lower, digit, mark = (F.lit(self.size * share) for _, share in layout.CLASSES)
        is_in = lambda ranges: char.rlike(f"[{ranges}]")
        plain = F.when(char.between("a", "z"), lower).when(char.between("A", "Z"), upper).when(char.between("0", "9"), digit)
        return plain.when(is_in(P.CJK), cjk).when(is_in(layout.BLANK), blank).when(is_in(r"\p{P}"), mark).when(is_in(P.THAI), thai).when(is_in(P.WIDE), wide).otherwise(self.size * layout.OTHER)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _best_after(text: Column) -> Column:
    return text.rlike(rf"[{CUT_SIGNS}{PARTICLES}]\z")


def short_tail(lines: Column) -> Column:
    """The lines, the last two cut anew if the last has up to three characters and both at least six.

    The cut is sought from the middle of both back to three fifths of that: after a sign or particle, else where no pair
    is torn, else at the earliest place.
    """

    def anew(b: Column) -> Column:
        both, most, least = b["both"], b["most"], F.greatest(F.floor(b["most"] * 3 / 5).cast("int"), F.lit(1))
        places = F.sequence(most, least, F.lit(-1))
        good = F.filter(places, lambda i: _best_after(F.substring(both, i, F.lit(1))))
        whole = F.filter(places, lambda i: ~F.substring(both, i, F.lit(2)).isin(*KEPT_PAIRS) & ~((i >= 2) & (F.substring(both, i - 1, F.lit(3)) == KEPT_TRIPLE)))
        cut = F.coalesce(F.get(good, F.lit(0)), F.get(whole, F.lit(0)), least)
        return bind(cut, lambda c: F.concat(b["before"], F.array(F.substring(both, F.lit(1), c), F.substring(both, c + 1, F.char_length(both)))))

    def run(ls: Column) -> Column:
        n = F.size(ls)
        last, previous = F.char_length(F.get(ls, n - 1)), F.char_length(F.get(ls, n - 2))
        short = (n >= 2) & (last >= 1) & (last <= 3) & (last + previous >= 6)
        parts = F.struct(F.concat(F.get(ls, n - 2), F.get(ls, n - 1)).alias("both"), F.floor((last + previous) / 2).cast("int").alias("most"), F.slice(ls, F.lit(1), F.greatest(n - 2, F.lit(0))).alias("before"))
        return F.when(short, bind(parts, anew)).otherwise(ls)

    return bind(lines, run)


def balanced(lines: Column, tokens: Column) -> Column:
    """The lines after short_tail; two of which the first is not the narrower are cut anew near two fifths of their width.

    The place is between tokens, nearest to that width, where a token that ends in a sign or particle counts as two
    nearer; the first of equals. A cut that leaves the first line as wide as the second is not taken.
    """

    def anew(b: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("width"), F.lit(2**31 - 1).alias("least"), F.lit(0).alias("cut"))

        def step(s: Column, token: Column) -> Column:
            width = s["width"] + T.display_width(token)
            off = F.abs(width - b["target"]) - F.when(_best_after(token), 2).otherwise(0)
            return bind(F.struct(width.alias("width"), off.alias("off")), lambda x: F.struct((s["at"] + 1).alias("at"), x["width"].cast("int").alias("width"), F.least(s["least"], x["off"]).cast("int").alias("least"), F.when(x["off"] < s["least"], s["at"] + 1).otherwise(s["cut"]).cast("int").alias("cut")))

        cut = F.aggregate(F.slice(tokens, F.lit(1), F.size(tokens) - 1), start, step, lambda s: s["cut"])
        side = lambda start, n: T.trim_punctuation(F.array_join(F.slice(tokens, start, n), ""))
        return bind(cut, lambda c: F.array(side(F.lit(1), c), side(c + 1, F.size(tokens) - c)))

    def run(ls: Column) -> Column:
        wide = (F.size(ls) == 2) & (F.size(tokens) >= 2) & (T.display_width(F.get(ls, F.lit(0))) >= T.display_width(F.get(ls, F.lit(1))))
        target = F.greatest(F.floor(T.display_width(F.array_join(ls, "")) * 2 / 5).cast("int"), F.lit(1))
        taken = lambda c: F.when((F.get(c, F.lit(0)) != "") & (T.display_width(F.get(c, F.lit(0))) < T.display_width(F.get(c, F.lit(1)))), c).otherwise(ls)
        return F.when(wide, bind(bind(F.struct(target.alias("target")), anew), taken)).otherwise(ls)

    return bind(short_tail(lines), run)


def _lines(units: Column, opens: Callable[[Column, Column], Column], close: Callable[[Column], Column] | None = None) -> Column:
    """Lines of units(text, width, ...): a unit for which opens(state, unit) holds begins a new one; close gives the
    width of a line that is trimmed at a unit marked last."""
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("text"), F.lit(0.0).cast("double").alias("width"))

    def step(s: Column, u: Column) -> Column:
        new = (s["text"] != "") & opens(s, u)
        lines = F.when(new, F.concat(s["lines"], F.array(T.trim_punctuation(s["text"])))).otherwise(s["lines"])
        text = F.when(new, u["text"]).otherwise(F.concat(s["text"], u["text"]))
        width = F.when(new, u["width"]).otherwise(s["width"] + u["width"])
        if close:
            text, width = F.when(u["last"], T.trim_punctuation(text)).otherwise(text), F.when(u["last"], close(T.trim_punctuation(text))).otherwise(width)
        return F.struct(lines.alias("lines"), F.coalesce(text, F.lit("")).alias("text"), F.coalesce(width.cast("double"), F.lit(0.0)).alias("width"))

    return F.aggregate(units, start, step, lambda s: F.when(s["text"] != "", F.concat(s["lines"], F.array(T.trim_punctuation(s["text"])))).otherwise(s["lines"]))


def wrapped_tokens(tokens: Column, line: Line) -> Column:
    """Lines within the limit: signs stay with what they follow, a token wider than a line is cut into characters."""
    flags = lambda first, loose, last: (first.alias("first"), loose.alias("loose"), last.alias("last"))
    unit = lambda t, w, *f: F.struct(t.alias("text"), w.alias("width"), t.rlike(rf"\A[{STICKY}]+\z").alias("sticky"), *flags(*f))
    no, one = F.lit(False), lambda c: line.share(c) * F.lit(line.scale)

    def units(t: Column) -> Column:
        n = F.char_length(t)
        apart = F.transform(characters(t), lambda c, i: unit(c, one(c), i == 0, F.lit(True), i == n - 1))
        return bind(F.when(n == 1, one(t)).otherwise(line.width(t)), lambda w: F.when(w > line.limit, apart).otherwise(F.array(unit(t, w, no, no, no))))

    def opens(s: Column, u: Column) -> Column:
        return u["first"] | ((u["loose"] | ~u["sticky"]) & (s["width"] + u["width"] > line.limit))

    return _lines(F.flatten(F.transform(tokens, units)), opens, line.width)


def wrapped(text: Column, line: Line, tokens: Column | None = None, always: bool = False) -> Column:
    """The lines of a subtitle: none without text, one if it fits or (unless always) has no Han, kana, Hangul or Thai
    character, else wrapped and balanced. Punctuation at either end goes. tokens: of the trimmed text, else characters."""
    clean = T.trim_punctuation(T.trim(text))

    def run(c: Column) -> Column:
        whole = line.width(c) <= line.limit
        whole = whole if always else whole | ~c.rlike(f"[{P.CJK}{P.THAI}]")
        cut = bind(characters(c) if tokens is None else tokens, lambda t: balanced(wrapped_tokens(t, line), t))
        return F.when(c == "", F.array().cast("array<string>")).when(whole, F.array(c)).otherwise(cut)

    return bind(F.coalesce(clean, F.lit("")), run)


def wrapped_vertical(text: Column, line: Line) -> Column:
    """As wrapped, for vertical video: any script is wrapped, at VERTICAL_MOST full characters at the latest."""
    narrow = line.size * VERTICAL_MOST
    return wrapped(text, line._replace(limit=min(line.limit, narrow)) if narrow > 0 else line, always=True)


def even_lines(text: Column, most: int, tokens: Column | None = None) -> Column:
    """As few lines of up to `most` Han characters as hold the text, of about equal display width; then short_tail."""
    clean = T.trim_punctuation(T.trim(text))

    def cut(c: Column, size: Column) -> Column:
        units = F.transform(characters(c) if tokens is None else tokens, lambda t: F.struct(t.alias("text"), T.display_width(t).cast("double").alias("width"), t.rlike(rf"\A[{STICKY}]+\z").alias("sticky")))
        opens = lambda s, u: ~u["sticky"] & (s["width"] > 0) & (s["width"] + u["width"] > size["each"]) & (F.size(s["lines"]) < size["count"] - 1)
        return short_tail(_lines(units, opens))

    def sizes(whole: Column) -> Column:
        count = F.ceil(whole / (2 * most)).cast("int")
        return F.struct(whole.alias("whole"), count.alias("count"), F.greatest(F.floor(whole / count).cast("int"), F.lit(1)).alias("each"))

    def run(c: Column) -> Column:
        whole = F.array(c)
        some = whole if most <= 0 else bind(bind(T.display_width(c), sizes), lambda s: F.when(s["whole"] <= 2 * most, whole).otherwise(cut(c, s)))
        return F.when(c == "", F.array().cast("array<string>")).otherwise(some)

    return bind(F.coalesce(clean, F.lit("")), run)
