"""Importance resampling towards a target distribution, in Spark SQL alone.

Features of a text are its runs of consecutive words, hashed into buckets by crc32. How much commoner a bucket is in the
target's texts than in all documents is its gain; a document's weight is the mean gain of its features. Gumbel noise
that is fixed by seed and doc_id turns the weights into a draw without replacement: the highest scores are drawn.

Every text is taken apart once, into an array of bucket numbers that is written to shared storage. Exploded, the arrays
are counted by bucket (partial counts first, so a frequent word is no hot key) and joined with the table of gains, which
has a row for each bucket and is broadcast. A document's rows lie in one task, so that its sum is shuffled as one row.
Ranks come from one distributed sort: a row's place in its partition plus the rows of all partitions before it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.crc import CRC_SQL
from tidemark.session import discard, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word: digits, lower-case letters and whatever is not ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Draw(NamedTuple):
    """Runs of up to `run` words in `buckets` buckets; `percent` of the documents with `least_words` words are drawn."""

    run: int = 2
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 25
    seed: int = 7


def bucket_arrays(texts: DataFrame, rule: Draw = Draw()) -> DataFrame:
    """The columns of texts without its text, n_words, and buckets: the bucket of every feature, repeats included."""
    lowered = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    kept = [c for c in texts.columns if c != "text"]
    words = texts.select(*kept, F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)).alias("words"))
    grams = [_runs(k, rule) for k in range(1, rule.run + 1)]
    return words.select(*kept, F.size("words").cast("long").alias("n_words"), F.concat(*grams).alias("buckets"))


def _runs(k: int, rule: Draw) -> Column:
    """Buckets of all runs of k words."""
    if k == 1:
        return F.transform("words", lambda w: _bucket(w, rule))
    starts = F.sequence(F.lit(1), F.size("words") - k + 1)
    joined = F.transform(starts, lambda i: _bucket(F.concat_ws(" ", *[F.get("words", i + (j - 1)) for j in range(k)]), rule))
    return F.when(F.size("words") >= k, joined).otherwise(F.array().cast("array<int>"))


def _bucket(feature: Column, rule: Draw) -> Column:
    return (F.crc32(feature) % rule.buckets).cast("int")


def bucket_counts(arrays: DataFrame, name: str) -> DataFrame:
    """bucket and how many features fall into it."""
    return arrays.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias(name))


def gains(corpus: DataFrame, target: DataFrame, rule: Draw = Draw()) -> DataFrame:
    """bucket, gain for every bucket, from counts s of the corpus and t of the target by bucket."""
    spark = corpus.sparkSession
    every = spark.range(rule.buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(corpus, "bucket", "left").join(target, "bucket", "left").na.fill(0, ["s", "t"])
    whole = Window.partitionBy(F.lit(1))  # as many rows as buckets
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = (t + 1) * (F.sum(s).over(whole) + rule.buckets) / ((s + 1) * (F.sum(t).over(whole) + rule.buckets))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def noise(rule: Draw = Draw()) -> Column:
    """Standard Gumbel noise times 1000, floored, from the first 32 bits of sha256 of seed and doc_id."""
    key = F.concat(F.lit(f"{rule.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(scored: DataFrame, rule: Draw = Draw()) -> DataFrame:
    """scored(doc_id, n_features, weight, score, fit) with rank: 1, 2, 3... over the drawn, null elsewhere.

    The rows are sorted once over all partitions, fit ones first. Only the number of rows of each partition is summed up
    apart, a table as long as there are partitions.
    """
    order = scored.orderBy(F.desc("fit"), F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "weight")
    placed = order.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"))
    placed = materialize(placed, "resampling-order")
    parts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("fit").cast("long")).alias("fits"), F.min("place").alias("first"))
    every = Window.partitionBy(F.lit(1))  # as many rows as partitions
    before = F.sum("rows").over(every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    most = F.floor(F.sum("fits").over(every) * rule.percent / 100)
    parts = parts.select("part", "first", F.coalesce(before, F.lit(0)).alias("before"), most.cast("long").alias("most"))
    at = F.col("before") + F.col("place") - F.col("first") + 1
    rank = F.when(F.col("fit") & (at <= F.col("most")), at).cast("long")
    return placed.join(F.broadcast(parts), "part").select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


def resample(docs: DataFrame, target: DataFrame, rule: Draw = Draw()) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs(doc_id, text), drawn towards target(text).

    A null, empty or blank text has no features: weight 0, never drawn while least_words is above 0. A null doc_id counts
    as an empty string in the noise and comes last among ties; rows that repeat a doc_id are rows of their own. An empty
    docs gives no rows; an empty target gives every bucket its smoothed gain. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.monotonically_increasing_id().alias("row"))
    arrays = materialize(bucket_arrays(rows, rule), "resampling-buckets")
    table = gains(bucket_counts(arrays, "s"), bucket_counts(bucket_arrays(target.select("text"), rule), "t"), rule)
    table = materialize(table, "resampling-gains")
    each = arrays.select("row", "doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), F.explode_outer("buckets").alias("bucket"))
    sums = each.join(F.broadcast(table), "bucket", "left").groupBy("row", "doc_id", "n_words", "n_features").agg(F.coalesce(F.sum("gain"), F.lit(0)).alias("total"))
    n = F.greatest("n_features", F.lit(1))
    weight = F.expr("(total - pmod(total, greatest(n_features, 1L))) div greatest(n_features, 1L)")
    scored = sums.select("doc_id", "n_features", weight.cast("long").alias("weight"), (F.col("n_words") >= rule.least_words).alias("fit"))
    scored = scored.withColumn("score", (F.col("weight") + noise(rule)).cast("long"))
    scored = materialize(scored, "resampling-scores")
    discard(arrays, table)
    return ranked(scored, rule)


def drawn(docs: DataFrame, target: DataFrame, rule: Draw = Draw()) -> DataFrame:
    """The drawn rows of docs with all their columns, by doc_id; rows that repeat a drawn doc_id come along."""
    ids = resample(docs, target, rule).where("rank is not null").select("doc_id").distinct()
    return docs.join(ids, "doc_id", "left_semi")


_ARRAYS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""
ORACLE_SQL = f"""
WITH words AS (SELECT doc_id, {_ARRAYS} AS w FROM documents),
targets AS (SELECT {_ARRAYS} AS w FROM benchmark),
doc_features AS (
  SELECT doc_id, unnest(w) AS f FROM words
  UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words),
target_features AS (
  SELECT unnest(w) AS f FROM targets
  UNION ALL SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM targets),
hashed AS (
  SELECT f, {CRC_SQL.format(text="f")} % 10000 AS bucket
  FROM (SELECT f FROM doc_features UNION SELECT f FROM target_features)),
s AS (SELECT bucket, count(*) AS s FROM doc_features JOIN hashed USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM target_features JOIN hashed USING (f) GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (sum(coalesce(s, 0)) OVER () + 10000)::DOUBLE
                                 / ((coalesce(s, 0) + 1)::DOUBLE * (sum(coalesce(t, 0)) OVER () + 10000)::DOUBLE)))::BIGINT AS gain
  FROM (SELECT range AS bucket FROM range(10000)) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
sums AS (
  SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS total
  FROM doc_features JOIN hashed USING (f) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, len(w) >= 20 AS fit,
         CASE WHEN n_features > 0 THEN (total - ((total % n_features) + n_features) % n_features) // n_features ELSE 0 END::BIGINT AS weight,
         floor(-1000 * ln(-ln((('0x' || sha256('7:' || doc_id)[1:8])::BIGINT + 0.5) / 4294967296::DOUBLE)))::BIGINT AS noise
  FROM words LEFT JOIN sums USING (doc_id)),
placed AS (
  SELECT *, weight + noise AS score, row_number() OVER (ORDER BY fit DESC, weight + noise DESC, doc_id) AS place,
         count(*) FILTER (fit) OVER () AS fits FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= 25 * fits // 100 THEN place END AS rank FROM placed
"""
