"""Exact deduplication as a stateful stream.

The stream groups arriving rows by the SHA-256 digest of their text. Its state, kept in RocksDB on disk and in the
checkpoint folder, never expires and holds per digest the stable identifier of the copy that stays (the largest
doc_id so far), the number of copies and a locator of the content: the doc_id and byte length under which the full
text is found in the documents. Digests met more than once are hits; for these the full bytes of every copy are
compared with the text at the locator, and copies that differ in spite of an equal digest are grouped by their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import materialize, scratch_path

#: State in RocksDB; a store is closed when its task ends, so that open stores take no disk beside their data.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "96",
}
#: Copies of one group that go to one task at most; larger groups are salted.
GROUP_SHARE = 5_000
#: Digests of hits are broadcast up to this many rows (about 64 bytes each), else joined by shuffle.
BROADCAST_ROWS = 500_000


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest, n_bytes of each row; a null text counts as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))


def keyed_state(stream: DataFrame) -> DataFrame:
    """The state per digest over a stream of (doc_id, digest, n_bytes)."""
    return stream.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "n_bytes")).alias("locator"))


def run_stream(stream: DataFrame, checkpoint: str | None = None) -> DataFrame:
    """Feed all that the stream has to the state and return the state's rows, one per digest.

    Started again with the same checkpoint, only new files are read and the state goes on from where it was. Each
    micro-batch writes the digests it has changed; the last change of a digest holds.
    """
    spark = stream.sparkSession
    where = checkpoint or scratch_path(spark, "dedup")
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        state = keyed_state(stream)
        schema = "digest binary, keep_id long, group_size long, locator struct<doc_id: long, n_bytes: long>, batch long"

        def put(changed: DataFrame, batch: int) -> None:  # a repeated batch overwrites its own folder
            changed.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{where}/changes/batch={batch}/rows")

        query = state.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        batches = len(query.recentProgress)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    if not batches:
        return spark.createDataFrame([], schema).drop("batch")
    changes = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{where}/changes")
    latest = changes.groupBy("digest").agg(F.max_by(F.struct("keep_id", "group_size", "locator"), "batch").alias("s"))
    return latest.select("digest", "s.*")


def differing(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """Digests under which two different texts were met: every copy's bytes are held against the text at the locator.

    Copies meet the located text by (digest, share), so that a group of over GROUP_SHARE copies is spread over many.
    """
    share = F.pmod(F.xxhash64("doc_id"), F.col("shares")).cast("int")
    copies = _with_text(docs).join(hits.withColumn("shares", F.ceil(F.col("group_size") / GROUP_SHARE).cast("int")), "digest")
    shares = F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")
    located = copies.where(F.col("doc_id").eqNullSafe(F.col("locator.doc_id"))).select("digest", F.col("text").alias("located"), shares)
    met = copies.select("digest", share.alias("share"), "text").join(located, ["digest", "share"])
    return met.where("text <> located").select("digest").distinct()


def _with_text(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))


def _one_stays(rows: DataFrame, key: str) -> DataFrame:
    """Mark one row of each group as kept; rows that repeat the largest doc_id are told apart by their number."""
    last = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("group_size") > 1)
    number = F.row_number().over(W.partitionBy(key).orderBy("doc_id"))
    largest = rows.where(last).withColumn("kept", number == 1)
    return largest.unionByName(rows.where(~last).withColumn("kept", F.col("group_size") == 1))


def _hits(docs: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Digests met more than once, broadcast if few, and those that stand for different texts, if any."""
    hits = materialize(state.where("group_size > 1"), "dedup-hits")
    hits = F.broadcast(hits) if hits.count() <= BROADCAST_ROWS else hits
    clashes = materialize(differing(docs, hits), "dedup-clashes")
    return hits, clashes if clashes.count() else None


def resolve(docs: DataFrame, state: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    hits, clashes = _hits(docs, state)
    found = hits.select("digest", F.col("keep_id").alias("group_id"), F.col("group_size").alias("copies"))
    rows = digests(docs).join(found, "digest", "left").select(
        "doc_id",
        F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("group_id")).alias("keep_id"),
        F.coalesce("copies", F.lit(1).cast("long")).alias("group_size"),
        "digest",
    )
    if clashes is not None:  # equal digests, different texts: these few are grouped by the text itself
        texts = _with_text(docs).join(clashes, "digest", "left_semi")
        groups = texts.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        apart = texts.join(groups, ["digest", "text"]).select("doc_id", "keep_id", "group_size", "digest", "text")
        kept = _one_stays(rows.join(clashes, "digest", "left_anti"), "digest").unionByName(_one_stays(apart, "text").drop("text"))
    else:
        kept = _one_stays(rows, "digest")
    return kept.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def _log_stream(docs: DataFrame) -> DataFrame:
    """The digests of a table, written to the shared folder, as a stream."""
    log = scratch_path(docs.sparkSession, "dedup-digests")
    materialize(digests(docs), "dedup-digests", keep=log)
    return docs.sparkSession.readStream.schema("doc_id long, digest binary, n_bytes long").parquet(log)


def keep_last(docs: DataFrame) -> DataFrame:
    """The documents without exact copies, all columns as they are: of equal texts one row of the largest doc_id stays."""
    hits, clashes = _hits(docs, run_stream(_log_stream(docs)))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumn("__digest", F.unhex(F.sha2(text.cast("binary"), 256)))
    rows = rows.join(hits.select(F.col("digest").alias("__digest"), F.col("keep_id").alias("__keep"), F.lit(True).alias("__hit")), "__digest", "left")
    alone, copies = rows.where("__hit is null"), rows.where("__hit")
    key = "__digest"
    if clashes is not None:  # grouped by the text itself
        key = "__text"
        copies = copies.withColumn(key, text)
        largest = copies.groupBy(F.col(key)).agg(F.max(F.col("doc_id").cast("long")).alias("__largest"))
        copies = copies.join(largest, key).withColumn("__keep", F.col("__largest"))
    kept = copies.where(F.col("doc_id").cast("long").eqNullSafe(F.col("__keep"))).dropDuplicates([key])
    return alone.select(*docs.columns).unionByName(kept.select(*docs.columns))


def dedup_files(spark: SparkSession, path: str, checkpoint: str | None = None) -> DataFrame:
    """Stream the document files at a path through the state and resolve every document.

    A null text counts as empty; of equal texts the largest doc_id stays, a null doc_id being smaller than any; of
    rows that repeat the largest one stays. An empty table gives no rows. Only doc_id and text are read.
    """
    docs = spark.read.parquet(path)
    pattern = f"{path[:-1]}[{path[-1]}]"  # a stream reads a folder or a pattern; as a pattern, one file will do as well
    stream = digests(spark.readStream.schema(docs.schema).parquet(pattern))
    return resolve(docs, run_stream(stream, checkpoint))


def dedup(docs: DataFrame, checkpoint: str | None = None) -> DataFrame:
    """As dedup_files for any table: its digests are written to the shared folder and streamed from there."""
    return resolve(docs, run_stream(_log_stream(docs), checkpoint))
