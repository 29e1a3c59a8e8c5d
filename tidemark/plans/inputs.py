"""The driver's tables as timed text: events as cues, documents as sentences and words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as cues: a second of theirs is 0.1 ms of ours, lengths from 0.3 to 6.2 s."""
    events = table(spark, sf_dir, "events")
    start = F.expr("unix_micros(cast(ts as timestamp)) div 10000000")
    length = (F.col("event_id") % 60) * 100 + 300
    return events.select("user_id", "event_id", start.alias("start_ms"), (start + length).cast("long").alias("end_ms"), F.col("value"), F.concat(F.lit("cue "), F.col("event_type")).alias("text"))


#: The same in SQL.
CUES = """cues AS (
  SELECT user_id, event_id, epoch_us(ts) // 10000000 AS start_ms,
         epoch_us(ts) // 10000000 + (event_id % 60) * 100 + 300 AS end_ms, value, 'cue ' || event_type AS text
  FROM events)"""


def dealt_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dealt out by doc_id while they are whole texts, so that windows and groups over their words, which take
    several times the space, need no shuffle."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "text").repartition(n, "doc_id")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each document with their place from 0, dealt out by document."""
    docs = dealt_documents(spark, sf_dir)
    parts = F.filter(F.split("text", "[ \n]+"), lambda w: w != "")
    return docs.select("doc_id", F.posexplode(parts).alias("pos", "word"))


WORDS = """words AS (
  SELECT doc_id, unnest(generate_series(0, len(w) - 1))::INT AS pos, unnest(w) AS word
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda x: x <> '') AS w FROM documents))"""


def lines(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """The lines of each document with their place from 0; dealt: by document, as words are."""
    docs = dealt_documents(spark, sf_dir) if dealt else table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


LINES = """lines AS (
  SELECT doc_id, lang, unnest(generate_series(0, len(w) - 1))::INT AS pos, unnest(w) AS line
  FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS w FROM documents))"""
