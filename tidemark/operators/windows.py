"""Ordered operators in closed form: every one is a window over explicit keys and order columns.

`by` names the columns that tell one medium from another and `order` those that give its rows their order. All windows
are partitioned by `by`, so a medium is the unit of work and media are spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as T

Names = list[str]


def _w(by: Names, order: Names):
    return W.partitionBy(*by).orderBy(*order)


def running_group(starts: Column, by: Names, order: Names) -> Column:
    """Number of the group that a row is in, from 1, where `starts` marks first rows."""
    return F.sum(F.when(starts, 1).otherwise(0)).over(_w(by, order).rowsBetween(W.unboundedPreceding, 0))


def cap_groups(df: DataFrame, starts: Column, cap: int, by: Names, order: Names, name: str) -> DataFrame:
    """Groups from 1 that begin where `starts` holds and anew after every `cap` rows."""
    runs = df.withColumn("__run", running_group(starts, by, order))
    place = F.row_number().over(_w([*by, "__run"], order)) - 1
    cut = runs.withColumn("__cut", place % cap == 0)
    return cut.withColumn(name, running_group(F.col("__cut"), by, order)).drop("__run", "__cut")


def dub_chunks(cues: DataFrame, by: Names, order: Names, start: str, end: str, gap: float = 1.5, short: float = 2.5, cap: int = 5) -> DataFrame:
    """chunk_id per cue: a cue joins the chunk before it if the gap is small, it or the cue before it is short, and the
    chunk holds fewer than `cap` cues."""
    w = _w(by, order)
    length = F.col(end) - F.col(start)
    near = (F.col(start) - F.lag(end).over(w)) <= gap
    brief = (F.lag(length).over(w) < short) | (length < short)
    return cap_groups(cues, ~F.coalesce(near & brief, F.lit(False)), cap, by, order, "chunk_id")


def fit_timeline(items: DataFrame, by: Names, order: Names, start: str, end: str, actual: str, low: float = 0.95, accept: float = 1.15, high: float = 1.30) -> DataFrame:
    """new_start, new_end, speed and the chunk's report for items with a chunk_id and actual durations.

    A chunk lasts from its first start to its last end. Its speed is actual over available time, at least 1, kept
    within the limits; items share the time in proportion to their durations and follow each other from the start.
    """
    if not 0 < low <= accept <= high:
        raise ValueError(f"invalid speed limits: {low}, {accept}, {high}")
    chunk = W.partitionBy(*by, "chunk_id")
    ordered = chunk.orderBy(*order)
    everything = ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = items.withColumn("__start", F.first(start).over(everything)).withColumn("__end", F.last(end).over(everything)).withColumn("__actual", F.sum(actual).over(everything))
    speed = F.greatest(F.col("__actual") / (F.col("__end") - F.col("__start")), F.lit(1.0))
    rows = rows.withColumn("report_speed", speed).withColumn("speed", F.greatest(F.least(speed, F.lit(high)), F.lit(low)))
    before = F.coalesce(F.sum(actual).over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("new_start", F.col("__start") + before / F.col("speed")).withColumn("new_end", F.col("__start") + (before + F.col(actual)) / F.col("speed"))
    overflow = F.col("__start") + F.col("__actual") / F.col("speed") - F.col("__end")
    return rows.withColumn("over_accept", F.col("report_speed") > accept).withColumn("over_max", F.col("report_speed") > high).withColumn("overflows", overflow > 0.6).drop("__start", "__end", "__actual")


def sentence_groups(blocks: DataFrame, by: Names, order: Names, text: str, cap: int = 10) -> DataFrame:
    """group_id of blocks that are translated together: closed by the end of a sentence or at `cap`; empty ones go."""
    rows = blocks.where(F.coalesce(F.col(text), F.lit("")) != "")
    starts = F.coalesce(F.lag(T.ends_sentence(F.col(text))).over(_w(by, order)), F.lit(True))
    return cap_groups(rows, starts, cap, by, order, "group_id")


def primary_sentences(words: DataFrame, by: Names, order: Names, text: str) -> DataFrame:
    """sentence_id from 0: a sentence ends after a word with a final mark, unless the word is an abbreviation or, past
    the first word, one byte long."""
    w = _w(by, order)
    first = F.row_number().over(w) == 1
    single = (F.octet_length(T.trim(F.col(text))) == 1) & ~first
    ends = T.ends_sentence_or_quote(F.col(text)) & ~F.lower(T.trim(F.col(text))).isin(*T.ABBREVIATIONS) & ~single
    rows = words.withColumn("__ends", ends)
    return rows.withColumn("sentence_id", running_group(F.coalesce(F.lag("__ends").over(w), F.lit(False)), by, order)).drop("__ends")


def context(rows: DataFrame, by: Names, order: Names, text: str, size: int = 3) -> DataFrame:
    """before (each line ended) and after (lines joined): up to `size` neighbours on either side."""
    w = _w(by, order)
    before, after = F.collect_list(text).over(w.rowsBetween(-size, -1)), F.collect_list(text).over(w.rowsBetween(1, size))
    ended = F.when(F.size(before) > 0, F.concat(F.array_join(before, "\n"), F.lit("\n"))).otherwise("")
    return rows.withColumn("before", ended).withColumn("after", F.array_join(after, "\n"))


def fix_overlaps(cues: DataFrame, by: Names, order: Names, start: str, end: str, margin: int = 50) -> DataFrame:
    """The end of a cue that runs into the next is set `margin` ms before that, if that is still after its start."""
    following = F.lead(start).over(_w(by, order))
    cut = following - margin
    return cues.withColumn(end, F.when((F.col(end) > following) & (cut > F.col(start)), cut).otherwise(F.col(end)))


def quietest_point(samples: DataFrame, by: Names, at: str, value: str, window: int = 4500) -> DataFrame:
    """by, point: middle of the window of least energy, the latest of equals; the first full window is not tried.

    Energies are differences of one running sum, so a sample costs the same whatever the window's length. Positions
    `at` count samples from 1 without gaps.
    """
    w = _w(by, [at])
    total = F.sum(F.col(value) * F.col(value)).over(w.rowsBetween(W.unboundedPreceding, 0))
    rows = samples.withColumn("__sum", total)
    rows = rows.withColumn("__energy", F.col("__sum") - F.lag("__sum", window).over(w)).where(F.col("__energy").isNotNull())
    best = F.min(F.struct(F.col("__energy"), (-F.col(at)).alias("back")))
    return rows.groupBy(*by).agg((-best["back"] - window // 2).alias("point"))


def split_points(media: DataFrame, duration: str, length: float = 300.0) -> DataFrame:
    """One row per point of a grid of `length` seconds over a medium's duration: k, point, with both ends.

    A last stretch of under 10 s is joined to the one before it. Points are those of the bare grid; quiet_split_points
    moves them to quiet places.
    """
    count = F.ceil(F.col(duration) / length).cast("int")
    inner = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda k: k * length)
    short = (F.col(duration) - F.element_at(inner, -1) < 10) & (F.size(inner) > 1)
    kept = F.when(short, F.slice(inner, 1, F.size(inner) - 1)).otherwise(inner)
    return media.select("*", F.posexplode(F.concat(kept, F.array(F.col(duration).cast("double")))).alias("k", "point"))


def quiet_split_points(media: DataFrame, samples: DataFrame, by: Names, duration: str, at: str, value: str, length: float = 300.0, rate: int = 3000, window: int = 4500, tolerance: float = 8.0) -> DataFrame:
    """As split_points, each inner point moved to the quietest place within `tolerance` seconds of the grid: by, k, point.

    samples(by, at, value) count from 1 without gaps, `rate` a second. The last stretch is measured from the moved
    point. Where no more than `window` samples lie around a point, it is the beginning of what was searched.
    """
    if not length > 2 * tolerance:
        raise ValueError("length must be over 2 * tolerance")
    seconds = (F.col(at) - 1) / rate
    k = F.floor(seconds / length + 0.5).cast("int")  # a sample is near one grid point at most
    start = F.col("k") * length - tolerance
    count = F.greatest(F.ceil(F.col(duration) / length).cast("int"), F.lit(1))
    ends = media.select(*by, F.col(duration).cast("double").alias("__end"), count.alias("__n"))
    around = samples.select(*by, at, value, k.alias("k"), seconds.alias("__s")).where((F.col("__s") >= start) & (F.col("__s") < start + 2 * tolerance))
    around = around.join(ends, by).where("k > 0 and k < __n").withColumn("__at", F.col(at) - F.ceil(start * rate))
    quiet = quietest_point(around, [*by, "k"], "__at", value, window).withColumnRenamed("point", "__moved")
    grid = ends.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).join(quiet, [*by, "k"], "left")
    point = F.when(F.col("k") == 0, 0.0).otherwise(start + F.coalesce(F.col("__moved") / rate, F.lit(0.0)))
    own, end = F.struct("k", F.col("__point").alias("point")), F.col("__end").alias("point")
    short = (F.col("k") > 0) & (F.col("__end") - F.col("__point") < 10)
    last = F.when(short, F.array(F.struct("k", end))).otherwise(F.array(own, F.struct((F.col("k") + 1).alias("k"), end)))
    rows = grid.withColumn("__point", point).withColumn("__rows", F.when(F.col("k") == F.col("__n") - 1, last).otherwise(F.array(own)))
    return rows.select(*by, F.explode("__rows").alias("__r")).select(*by, "__r.*")


def silences(chunks: DataFrame, by: Names, order: Names, start: str, end: str) -> DataFrame:
    """Chunks with silence rows before them: piece (silence or chunk) and seconds; the timeline begins at 0."""
    before = F.coalesce(F.lag(end).over(_w(by, order)), F.lit(0.0))
    gap = F.col(start) - before
    own = F.struct(F.lit("chunk").alias("piece"), (F.col(end) - F.col(start)).alias("seconds"))
    pieces = F.when(gap > 0, F.array(F.struct(F.lit("silence").alias("piece"), gap.alias("seconds")), own)).otherwise(F.array(own))
    return chunks.withColumn("__pieces", pieces).select("*", F.posexplode("__pieces").alias("part", "__p")).select("*", "__p.*").drop("__p", "__pieces")


def renumber(rows: DataFrame, by: Names, order: Names, name: str = "idx") -> DataFrame:
    """Running numbers from 1 over rows of several files, in their order."""
    return rows.withColumn(name, F.row_number().over(_w(by, order)).cast("long"))


def time_slices(blocks: DataFrame, start: str, end: str, parts: str) -> DataFrame:
    """A block cut into lines of equal time: line, slice_start, slice_end for each element of `parts`, in whole ms."""
    step = F.col(end) - F.col(start)
    n = F.size(parts)
    rows = blocks.withColumn("__n", n).select("*", F.posexplode(parts).alias("line", "line_text"))
    at = lambda i: F.col(start) + F.floor(step * i / F.col("__n"))
    return rows.withColumn("slice_start", at(F.col("line"))).withColumn("slice_end", at(F.col("line") + 1)).drop("__n")


def dedup_words(words: DataFrame, by: Names, order: Names, text: str, start: str, end: str) -> DataFrame:
    """The first of words with equal text and times."""
    w = W.partitionBy(*by, text, start, end).orderBy(*order)
    return words.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def dedup_caption_words(words: DataFrame, by: Names, order: Names, text: str, start: str, end: str, bare: str) -> DataFrame:
    """As dedup_words, for words of which some are `bare` (without own times).

    A bare word stays only if its text, in lower case, has not come before, timed or bare; a timed word stays unless
    the same text and times have come before among timed words and kept bare ones.
    """
    lower = W.partitionBy(*by, F.lower(text)).orderBy(*order)
    rows = words.withColumn("__first", F.row_number().over(lower) == 1).where(~F.col(bare) | F.col("__first"))
    return dedup_words(rows.drop("__first"), by, order, text, start, end)


def keep_longest(rows: DataFrame, by: Names, order: Names, text: str, length: Column) -> DataFrame:
    """Of rows with equal text the longest one, the earliest of equals, as one aggregation."""
    best = F.max_by(F.struct(*[c for c in rows.columns if c not in (*by, text)]), F.struct(length, *[-F.col(c) for c in order]))
    return rows.groupBy(*by, text).agg(best.alias("__b")).select(*by, text, "__b.*")


def words_to_sentences(words: DataFrame, by: Names, order: Names, text: str, start: str, end: str) -> DataFrame:
    """One row per sentence_id: its words joined, first start, last end, number of words."""
    place = F.struct(*order)
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__t"))))
    joined = F.array_join(F.transform(parts, lambda p: p["__t"]), " ")
    return words.groupBy(*by, "sentence_id").agg(joined.alias("text"), F.min_by(start, place).alias("start"), F.max_by(end, place).alias("end"), F.count(F.lit(1)).alias("n_words"))


def sentence_stats(sentences: DataFrame, by: Names, n_words: str = "n_words") -> DataFrame:
    """longest, mean (whole number) and number of sentences of under three words."""
    n = F.col(n_words)
    return sentences.groupBy(*by).agg(F.max(n).alias("longest"), F.expr(f"sum({n_words}) div count({n_words})").alias("mean"), F.count_if(n < 3).alias("n_short"))


def longest_run(rows: DataFrame, by: Names, order: Names, num: str) -> DataFrame:
    """First and last number and length of the longest run of consecutive numbers, the first of equals."""
    w = _w(by, order)
    runs = rows.withColumn("__run", running_group(F.coalesce(F.col(num) != F.lag(num).over(w) + 1, F.lit(True)), by, order))
    found = runs.groupBy(*by, "__run").agg(F.min(num).alias("first_num"), F.max(num).alias("last_num"), F.count(F.lit(1)).alias("run_length"))
    best = F.max_by(F.struct("first_num", "last_num", "run_length"), F.struct("run_length", -F.col("__run")))
    return found.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


def merge_lone_quotes(sentences: DataFrame, by: Names, order: Names, text: str, start: str, end: str) -> DataFrame:
    """Sentences that are one double quote, or empty, joined to the sentence before; the last end holds."""
    t = T.trim(F.col(text))
    alone = (t == "") | T.lone_quote(F.col(text))
    first = F.row_number().over(_w(by, order)) == 1
    rows = sentences.withColumn("__alone", alone & ~first).withColumn("sentence_no", running_group(~(alone & ~first), by, order))
    piece = F.when(F.col("__alone"), t).otherwise(F.col(text))
    parts = F.array_sort(F.collect_list(F.struct(*order, piece.alias("__t"))))
    place = F.struct(*order)
    last_end = F.max_by(F.nullif(F.col(end).cast("string"), F.lit("")), place)
    return rows.groupBy(*by, "sentence_no").agg(F.array_join(F.transform(parts, lambda p: p["__t"]), " ").alias("text"), F.min_by(start, place).alias("start"), last_end.alias("end"))


def chunk_report(fitted: DataFrame, by: Names) -> DataFrame:
    """Per medium: largest speed wanted, number of chunks beyond each limit."""
    per_chunk = fitted.groupBy(*by, "chunk_id").agg(F.max("report_speed").alias("s"), F.bool_or("over_accept").alias("a"), F.bool_or("over_max").alias("m"), F.bool_or("overflows").alias("o"))
    return per_chunk.groupBy(*by).agg(F.max("s").alias("max_speed"), F.count_if("a").alias("n_over_accept"), F.count_if("m").alias("n_over_max"), F.count_if("o").alias("n_overflows"))


def invalid_plan(chunks: DataFrame, by: Names, order: Names, start: str, end: str, speed: str) -> DataFrame:
    """Chunks that cannot be assembled, with the reason: no length, a start before the end before, a bad speed."""
    before = F.coalesce(F.lag(end).over(_w(by, order)), F.lit(0.0))
    reason = F.when(F.col(start) < before, "starts before previous end").when(F.col(end) <= F.col(start), "end not after start").when(~(F.col(speed) > 0) | F.isnan(speed) | (F.col(speed) == float("inf")), "speed not positive and finite")
    return chunks.withColumn("reason", reason).where("reason is not null")


# How much of a segment's share each of its steps is, and the range that all segments share.
STEP_WEIGHTS = {"split": 0.1, "transcribe": 0.4, "translate": 0.5}
FROM_PERCENT, TO_PERCENT = 15.0, 90.0


def progress(steps: DataFrame, by: Names, order: Names, step: str, segments: str) -> DataFrame:
    """steps with percent: the whole percentage reached once a step is done, of so many segments with three steps each.

    A step that is none of STEP_WEIGHTS moves nothing. Shares are added up as thousandths, so that no sum is rounded.
    """
    weight = F.coalesce(*[F.when(F.col(step) == name, round(w * 1000)) for name, w in STEP_WEIGHTS.items()], F.lit(0))
    done = F.sum(weight).over(_w(by, order).rowsBetween(W.unboundedPreceding, 0))
    return steps.withColumn("percent", F.floor(FROM_PERCENT + done * (TO_PERCENT - FROM_PERCENT) / (F.col(segments) * 1000)).cast("int"))
