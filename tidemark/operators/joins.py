"""Joins over ordered text: interval, nearest, sequence and position joins, dimension lookups."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Names = list[str]


def interval_join(left: DataFrame, right: DataFrame, by: Names, at: str, other: str, before: float, after: float, width: float | None = None) -> DataFrame:
    """Pairs with `other` in [at - before, at + after].

    Both sides are bucketed by floor(time / width), so that it is an equi-join: a left row looks into the one to three
    buckets that its interval touches, and no pair outside them is formed.
    """
    width = width or (before + after)
    low, high = F.floor((F.col(at) - before) / width), F.floor((F.col(at) + after) / width)
    looks = left.withColumn("__bucket", F.explode(F.sequence(low, high)))
    held = right.withColumn("__bucket", F.floor(F.col(other) / width))
    met = looks.join(held, [*by, "__bucket"]).drop("__bucket")
    return met.where((F.col(other) >= F.col(at) - before) & (F.col(other) <= F.col(at) + after))


def nearest_before(rows: DataFrame, lookups: DataFrame, by: Names, at: str, value: str, name: str) -> DataFrame:
    """rows with the value of the last lookup at or before their time, as one ordered pass over both (no pair is formed).

    A null key or time meets nothing, on either side; a null value of the last lookup is taken as it is.
    """
    a, b = _both_kinds(rows, lookups, by, at, value)
    both = a.withColumn("__kind", F.lit(1)).unionByName(b.withColumn("__kind", F.lit(0)), allowMissingColumns=True)
    w = W.partitionBy(*by).orderBy(at, "__kind").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(name, F.last("__value", ignorenulls=True).over(w)["value"]).where("__kind = 1").drop("__kind", "__value")


def nearest_after(rows: DataFrame, lookups: DataFrame, by: Names, at: str, value: str, name: str) -> DataFrame:
    """As nearest_before, with the first lookup after the row's time."""
    a, b = _both_kinds(rows, lookups, by, at, value)
    both = a.withColumn("__kind", F.lit(0)).unionByName(b.withColumn("__kind", F.lit(1)), allowMissingColumns=True)
    later = W.partitionBy(*by).orderBy(F.col(at).desc_nulls_first(), F.col("__kind").desc()).rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(name, F.last("__value", ignorenulls=True).over(later)["value"]).where("__kind = 0").drop("__kind", "__value")


def _both_kinds(rows: DataFrame, lookups: DataFrame, by: Names, at: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Rows and lookups with __value: null in rows, a struct in lookups; lookups without a key or time go."""
    held = F.struct(F.col(value).alias("value"))
    b = lookups.dropna(subset=[*by, at]).select(*by, at, held.alias("__value"))
    return rows.withColumn("__value", F.lit(None).cast(b.schema["__value"].dataType)), b


def next_equal(rows: DataFrame, by: Names, order: Names, text: str, value: str, name: str) -> DataFrame:
    """The value of the next row with the same text."""
    return rows.withColumn(name, F.lead(value).over(W.partitionBy(*by, text).orderBy(*order)))


#: Signs that words lose at either end before they are compared.
WORD_SIGNS = "\".,!?;:'"
#: Words by which a sequence is looked up.
ANCHOR = 3


def word_key(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, f"^[{WORD_SIGNS}]+|[{WORD_SIGNS}]+$", ""))


def sequence_matches(blocks: DataFrame, words: DataFrame, by: Names, block: str, wanted: str, sentence: str, pos: str, word: str, times: tuple[str, str] = ("start", "end"), early: float = 0.5, late: float = 1.0, slack: float = 0.5, said_as: str | None = None) -> DataFrame:
    """blocks with found_in, first, last, first_time, last_time: where a block's words are said in a row, null if nowhere.

    blocks(by, block: its key, wanted: array of words, start, end), words(by, sentence, pos from 0, word, start, end); both sides compare
    by word_key. Of the sentences that begin between `early` before and `late` after a block's start, the first is taken
    in which the block's words stand in a row and overlap the block's time, `slack` aside, at the first such place. A
    block without times takes the first sentence that says it. A block without words has no match.

    said_as: a further column with the words that say the block, as structs of their pos, word, a and b (start and end).

    A timed block meets the sentences that begin in the buckets of its time; one without times those in which its first
    words (ANCHOR at most) stand in a row. Both meet in groups within `by`: rows that are dealt out by `by`, or part of
    it, are not shuffled again.
    """
    start, end = times
    keyed = words.select(*by, F.col(sentence).alias("__s"), F.struct(F.col(pos).alias("pos"), word_key(F.col(word)).alias("key"), F.col(start).cast("double").alias("a"), F.col(end).cast("double").alias("b"), *([F.col(word).alias("word")] if said_as else [])).alias("w"))
    said = keyed.groupBy(*by, "__s").agg(F.array_sort(F.collect_list("w")).alias("__w")).withColumn("__begin", F.get("__w", F.lit(0))["a"])
    # the keys as an array of their own: taken from the words inside a lambda, they would be gathered again at each place
    said = said.withColumn("__keys", F.transform("__w", lambda x: x["key"])).withColumn("__said", F.struct("__s", "__begin", "__w", "__keys"))
    nothing = lambda rows, c: F.lit(None).cast(rows.schema[c].dataType).alias(c)
    rest = [c for c in blocks.columns if c not in (*by, block)]
    asks = blocks.select(*by, F.col(block).alias("__id"), F.transform(wanted, word_key).alias("__want"), F.col(start).cast("double").alias("__a"), F.col(end).cast("double").alias("__b"), F.struct(*rest).alias("__row"))
    asks = asks.withColumn("__timed", F.col("__a").isNotNull() & F.col("__b").isNotNull())
    free = asks.where("not __timed and size(__want) > 0").select(*by, "__want")
    width = early + late
    key = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("bigint").alias("key"))
    buckets = F.sequence(F.floor((F.col("__a") - early) / width), F.floor((F.col("__a") + late) / width))
    keyed_by = reduce(and_, (F.col(c).isNotNull() for c in by))  # a null key meets nothing
    sought = F.when((F.size("__want") > 0) & keyed_by, F.when(F.col("__timed"), F.transform(buckets, lambda b: key(TIMED, b))).otherwise(F.array(key(FREE, _run(F.slice("__want", 1, ANCHOR))))))
    # a block stands in a group of its own as well, so that it stays where nothing is found, without a join
    own = key(OWN, F.xxhash64("__id"))
    asks = asks.withColumn("__k", F.explode(F.concat(F.array(own), F.coalesce(sought, F.array().cast("array<struct<kind:int,key:bigint>>")))))
    asks = asks.select(*by, "__k.*", F.struct("__id", "__want", "__a", "__b", F.when(F.col("__k.kind") == OWN, F.col("__row")).alias("__row")).alias("__ask"))
    said = _asked_runs(said, free, by).withColumn("__k", F.explode(F.concat(F.array(key(TIMED, F.floor(F.col("__begin") / width))), F.transform("__runs", lambda h: key(FREE, h)))))
    said = said.select(*by, "__k.*", "__said")
    both = asks.select("*", nothing(said, "__said")).unionByName(said.select("*", nothing(asks, "__ask")))
    met = both.groupBy(*by, "kind", "key").agg(F.collect_list("__said").alias("__said"), F.collect_list("__ask").alias("__ask")).where((F.size("__ask") > 0) & ((F.col("kind") == OWN) | (F.size("__said") > 0)))
    met = met.select(*by, "kind", "__said", F.explode("__ask").alias("__ask")).select(*by, "kind", "__ask", F.explode_outer("__said").alias("__said")).select(*by, "kind", "__ask.*", "__said.*")
    met = met.where((F.col("kind") != TIMED) | F.col("__begin").between(F.col("__a") - early, F.col("__a") + late))
    m = F.size("__want")
    overlaps = lambda i: (F.get("__w", i)["a"] <= F.col("__b") + slack) & (F.get("__w", i + m - 1)["b"] >= F.col("__a") - slack)
    fits = lambda i: (F.slice("__keys", i + 1, m) == F.col("__want")) & ((F.col("kind") == FREE) | overlaps(i))
    places = F.when((F.col("kind") != OWN) & (F.size("__keys") >= m), F.filter(F.sequence(F.lit(0), F.size("__keys") - m), fits))
    met = met.withColumn("__at", F.get(places, F.lit(0))).where((F.col("kind") == OWN) | F.col("__at").isNotNull())
    first, last = F.get("__w", F.col("__at")), F.get("__w", F.col("__at") + m - 1)
    found = F.struct("__s", "__at", first["pos"].alias("first"), last["pos"].alias("last"), first["a"].alias("first_time"), last["b"].alias("last_time"), *([F.slice("__w", F.col("__at") + 1, m).alias("said")] if said_as else []))
    met = met.select(*by, F.col("__id").alias(block), F.when(F.col("kind") == OWN, F.col("__row")).alias("__row"), F.when(F.col("kind") != OWN, found).alias("__best"))
    best = met.groupBy(*by, block).agg(F.collect_list("__row").alias("__rows"), F.min("__best").alias("__best")).withColumn("__row", F.explode("__rows"))
    best = best.select(*by, block, "__row.*", "__best")
    return best.select(*blocks.columns, F.col("__best.__s").alias("found_in"), *[F.col(f"__best.{c}").alias(c) for c in ("first", "last", "first_time", "last_time")], *([F.col("__best.said").alias(said_as)] if said_as else []))


#: What blocks and sentences meet by: a block alone, buckets of time, first words.
OWN, TIMED, FREE = 0, 1, 2
#: Parts into which the runs asked for within a medium are dealt, so that one is looked up among few.
RUN_PARTS = 64


def _run(keys: Column) -> Column:
    return F.xxhash64(keys)


def _asked_runs(said: DataFrame, free: DataFrame, by: Names) -> DataFrame:
    """said with __runs: those of its runs of words that blocks without times of the same medium begin with."""
    part = lambda h: F.pmod(h, F.lit(RUN_PARTS)).cast("int")
    size = F.least(F.size("__want"), F.lit(ANCHOR))
    asked = free.groupBy(*by).agg(F.collect_set(_run(F.slice("__want", 1, ANCHOR))).alias("__set"), F.collect_set(size).alias("__sizes"))
    asked = asked.select(*by, "__sizes", F.transform(F.sequence(F.lit(0), F.lit(RUN_PARTS - 1)), lambda p: F.filter("__set", lambda h: part(h) == p)).alias("__asked"))
    n, none = F.size("__keys"), F.array().cast("array<bigint>")
    runs = lambda k: F.when((n >= k) & F.array_contains("__sizes", k), F.transform(F.sequence(F.lit(0), n - k), lambda i: _run(F.slice("__keys", i + 1, k)))).otherwise(none)
    known = F.filter(F.concat(*map(runs, range(1, ANCHOR + 1))), lambda h: F.array_contains(F.get("__asked", part(h)), h))
    return said.join(asked, by, "left").select(*said.columns, F.when(F.col("__asked").isNotNull(), F.array_distinct(known)).otherwise(none).alias("__runs"))


def shares_character(a: Column, b: Column) -> Column:
    return F.arrays_overlap(F.filter(F.split(a, ""), lambda c: c != ""), F.filter(F.split(b, ""), lambda c: c != ""))


def text_spans(words: DataFrame, by: Names, order: Names, text: str) -> DataFrame:
    """start_char and end_char of each word in its medium's concatenated text."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.char_length(text)).over(w)
    return words.withColumn("end_char", end).withColumn("start_char", F.col("end_char") - F.char_length(text))


def first_at_or_after(tokens: DataFrame, words: DataFrame, by: Names, text: str, at: str, num: str) -> DataFrame:
    """For each token the number of the first word of the same lower-case text at or after its time, null without."""
    t = tokens.withColumn("__key", F.lower(text))
    w = words.select(*by, F.lower(text).alias("__key"), F.col(at), F.col(num))
    return nearest_after_or_at(t, w, [*by, "__key"], at, num, "word_num").drop("__key")


def nearest_after_or_at(rows: DataFrame, lookups: DataFrame, by: Names, at: str, value: str, name: str) -> DataFrame:
    a = rows.withColumn("__kind", F.lit(1)).withColumn("__value", F.lit(None).cast(lookups.schema[value].dataType))
    b = lookups.select(*by, at, F.col(value).alias("__value")).withColumn("__kind", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True)
    w = W.partitionBy(*by).orderBy(at, "__kind", "__value")
    # lookups at the same time stand before the row: take the least among them, else the next one
    same = F.min("__value").over(W.partitionBy(*by, at))
    following = F.first("__value", ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
    return both.withColumn(name, F.coalesce(same, following)).where("__kind = 1").drop("__kind", "__value")


def by_position(left: DataFrame, right: DataFrame, keys: Names, columns: Names, keep: bool = True) -> DataFrame:
    """Results put beside their rows by batch and index; rows without result stay (keep) or go."""
    return left.join(right.select(*keys, *columns), keys, "left" if keep else "inner")


def replace_or_keep(rows: DataFrame, pieces: DataFrame, keys: Names, text: str, parts: str) -> DataFrame:
    """Each row as its pieces where it has some, else as it is: piece_no, piece."""
    met = rows.join(pieces.select(*keys, parts), keys, "left")
    return met.select(*rows.columns, F.posexplode(F.coalesce(F.col(parts), F.array(text))).alias("piece_no", "piece"))


def lookup(rows: DataFrame, dimension: dict[str, str], key: str, name: str, default: str) -> DataFrame:
    """A fixed dimension of at most a few hundred entries as a broadcast join, with a default."""
    if len(dimension) > 1_000:
        raise ValueError("a dimension of over 1000 entries should be a table")
    table = rows.sparkSession.createDataFrame(sorted(dimension.items()) or [("", "")], f"{key} string, {name} string")
    return rows.join(F.broadcast(table), key, "left").withColumn(name, F.coalesce(name, F.lit(default)))


def prefixed_at_or_after(tokens: DataFrame, words: DataFrame, by: Names, text: str, word: str, at: str, time: str, length: int) -> DataFrame:
    """n, first, last: how many words at or after a token's time begin with its text, and the first and last time.

    Tokens have `length` characters, so the join is on equal heads. Matches are counted as running totals along the
    words of one head, never expanded into pairs.
    """
    head = F.substring(word, 1, length)
    w = words.select(*by, head.alias(text), F.col(time).cast("long").alias("__at"), F.lit(1).alias("__word"))
    t = tokens.withColumn("__at", F.col(at).cast("long")).withColumn("__word", F.lit(0))
    both = t.unionByName(w, allowMissingColumns=True)
    ahead = W.partitionBy(*by, text).orderBy("__at").rangeBetween(0, W.unboundedFollowing)
    when = F.when(F.col("__word") == 1, F.col("__at"))
    found = both.withColumn("n", F.sum("__word").over(ahead)).withColumn("first", F.min(when).over(ahead)).withColumn("last", F.max(when).over(ahead))
    return found.where("__word = 0 and n > 0").drop("__at", "__word")


def shared_character_spans(sentences: DataFrame, words: DataFrame, by: Names, key: str, text: str, at: str, word: str, time: str) -> DataFrame:
    """by, key, first, last: from the first to the last word that shares a character with a sentence, at or after its time.

    Where no such word comes that late, all words of the medium count. Sentences that share nothing are left out. Words
    are first put together by the sentence's time they follow, so that a character stands once between two such times;
    these and the sentences then meet by character along one ordered pass. No pairs of words and sentences are made, and
    rows that are dealt out by `by` are not shuffled again.
    """
    characters = lambda c: F.explode(F.filter(F.split(c, ""), lambda x: x != "")).alias("__ch")
    sentences, words = sentences.dropna(subset=by), words.dropna(subset=by)
    asked = sentences.select(*by, F.col(at).cast("long").alias("__at")).distinct().withColumn("__text", F.lit(None).cast("string"))
    said = words.select(*by, F.col(time).cast("long").alias("__at"), F.col(word).alias("__text")).where("__at is not null and __text is not null")
    since = F.max(F.when(F.col("__text").isNull(), F.col("__at"))).over(W.partitionBy(*by).orderBy("__at").rangeBetween(W.unboundedPreceding, 0))
    said = asked.unionByName(said).withColumn("__since", since).where("__text is not null")
    w = said.select(*by, F.col("__since").alias("__at"), F.col("__at").alias("__time"), characters("__text"))
    w = w.groupBy(*by, "__at", "__ch").agg(F.min("__time").alias("__first"), F.max("__time").alias("__last"))
    s = sentences.select(*by, key, F.col(at).cast("long").alias("__at"), F.explode(F.array_distinct(F.filter(F.split(text, ""), lambda x: x != ""))).alias("__ch"))
    met = s.withColumn("__ask", F.lit(True)).unionByName(w, allowMissingColumns=True)
    one = W.partitionBy(*by, "__ch")
    # descending, as a frame that ends with the current row is read once, one that begins with it again for each row
    ahead = one.orderBy(F.col("__at").desc()).rangeBetween(W.unboundedPreceding, 0)
    met = met.withColumn("__next", F.min("__first").over(ahead)).withColumn("__low", F.min("__first").over(one)).withColumn("__high", F.max("__last").over(one))
    met = met.where(F.col("__ask") & F.col("__low").isNotNull())
    late = F.max(F.when(F.col("__next").isNotNull(), F.col("__high")))
    return met.groupBy(*by, key).agg(F.coalesce(F.min("__next"), F.min("__low")).alias("first"), F.coalesce(late, F.max("__high")).alias("last"))
