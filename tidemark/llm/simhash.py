"""SimHash fingerprints with permuted block tables.

The terms of a text are its overlapping runs of five words (with fewer words, all of them), each weighted by how often
it occurs. Every occurrence of a term votes with the 64 bits of its hash; a fingerprint bit is set where the votes for
it outweigh those against. Votes are summed as 32 longs, each of which counts two bits in its halves.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import materialize

WORDS_A_TERM = 5
#: Hamming radius of the search, and how many of how many blocks a table's key holds: C(5, 2) = 10 tables of 26 bits.
RADIUS, BLOCKS, KEY_BLOCKS = 3, 5, 2
#: Fingerprints whose counts are broadcast at most (16 bytes each), beyond that they are joined by shuffle.
BROADCAST_ROWS = 1_000_000
SPACE = "\\x20\\x09-\\x0D"


def term_hashes(text: Column) -> Column:
    """Hashes of the five-word terms of a text, one for each occurrence."""
    words = F.filter(F.split(F.lower(text), f"[{SPACE}]+"), lambda w: w != "")

    def terms(ws):
        places = F.sequence(F.lit(0), F.greatest(F.size(ws) - WORDS_A_TERM, F.lit(0)))
        return F.transform(places, lambda i: F.xxhash64(*(F.get(ws, i + k) for k in range(WORDS_A_TERM))))

    held = F.transform(F.array(words), lambda ws: F.when(F.size(ws) > 0, terms(ws)).otherwise(F.array().cast("array<bigint>")))
    return F.get(held, F.lit(0))


def _votes() -> list[Column]:
    both = F.lit(4294967297)  # bits 0 and 32
    return [F.sum(F.shiftrightunsigned("term", b).bitwiseAND(both)).alias(f"v{b}") for b in range(32)]


def _fingerprint(n: Column) -> Column:
    bits = []
    for b in range(32):
        low, high = F.col(f"v{b}").bitwiseAND(F.lit(4294967295)), F.shiftrightunsigned(F.col(f"v{b}"), 32)
        bits += [F.when(low * 2 > n, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))]
        bits += [F.when(high * 2 > n, F.shiftleft(F.lit(1).cast("long"), b + 32)).otherwise(F.lit(0).cast("long"))]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def fingerprints(rows: DataFrame, keys: list[str], text: str = "body") -> DataFrame:
    """keys and fp (a long) for every row; keys name a row. Rows without terms have fingerprint 0."""
    terms = rows.select(*keys, F.explode_outer(term_hashes(F.col(text))).alias("term"))
    votes = terms.groupBy(*keys).agg(F.count("term").alias("n"), *_votes())
    return votes.select(*keys, F.coalesce(_fingerprint(F.col("n")), F.lit(0).cast("long")).alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def near(queries: DataFrame, all_fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, key_blocks: int = KEY_BLOCKS) -> DataFrame:
    """Pairs (fp, other, distance) of a query's and any fingerprint at most `radius` bits apart, itself left out.

    The 64 bits are cut into blocks. Within the radius at least blocks - radius of them agree; there is a table for
    each choice of key_blocks of them, keyed by these, so every such pair meets in some table. Both inputs are made
    distinct first; a heavy key on the side of all fingerprints is split by adaptive execution.
    """
    if key_blocks > blocks - radius:
        raise ValueError("key_blocks may be at most blocks - radius")
    width = -(-64 // blocks)
    masks = [sum(((1 << width) - 1) << (width * b) & ((1 << 64) - 1) for b in chosen) for chosen in combinations(range(blocks), key_blocks)]
    keys = [F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("k")) for t, m in enumerate(masks)]
    tables = lambda df: df.select("fp").distinct().select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", "key.t", "key.k")
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("other")))
    met = tables(all_fps).withColumnRenamed("fp", "other").join(tables(queries), ["t", "k"])
    return met.select("fp", "other", apart.alias("distance")).where((F.col("distance") <= radius) & (F.col("fp") != F.col("other"))).distinct()


def followers(ids: DataFrame, ranges: int) -> DataFrame:
    """k, next_k for distinct k: the next in ascending order, after the last the first.

    Order is found within `ranges` ranges of k between approximate quantiles; the first k of each range then tells
    where the last of the range before goes on. The only unpartitioned window is over these, one row per range.
    """
    cuts = ids.agg(F.percentile_approx("k", [i / ranges for i in range(1, ranges)] or [0.5], 10_000).alias("q")).first().q or []
    cuts = sorted(set(cuts))
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("k"))) if cuts else F.lit(0)
    rows = ids.withColumn("bucket", bucket)
    firsts = rows.groupBy("bucket").agg(F.min("k").alias("first"))
    order = W.orderBy("bucket")
    start = F.min("first").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    firsts = firsts.select("bucket", F.coalesce(F.lead("first").over(order), start).alias("first_after"))
    rows = rows.withColumn("next_k", F.lead("k").over(W.partitionBy("bucket").orderBy("k")))
    return rows.join(F.broadcast(firsts), "bucket").select("k", "n", F.coalesce("next_k", "first_after").alias("next_k"))


def fingerprint_documents(docs: DataFrame, every: int = 20) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near, near for every row.

    The edited text gives up its last quarter for the beginning of the next document's text. A null text counts as
    empty, and a null doc_id as the smallest identifier. Rows that share a doc_id have the same next document, of the
    next other doc_id; if that has several rows, the smallest beginning and the smallest fingerprint count. A single
    document follows itself. An empty table gives no rows; other columns are ignored. Rows are numbered where docs is
    read: docs must give the same rows in the same order when a task runs again, as a table of files does.

    Rows whose doc_id is divisible by `every` are searched for. n_near counts the other rows whose fingerprint is within
    RADIUS of a searched row's, those of the same fingerprint included, and is null for others. near lists the other
    fingerprints found, with their distances, nearest first; it stands once for each searched fingerprint, at its row of
    least doc_id, and is null elsewhere. Which rows are meant is told by the fingerprint column, so that copies are
    never expanded into all pairs.
    """
    spark = docs.sparkSession
    ranges = min(1024, int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    least = F.lit(-(1 << 63))
    # numbered as they are read, before any shuffle; both joins read the one exchange that follows
    base = docs.select(F.coalesce(doc_id, least).alias("k"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    ids = materialize(base.groupBy("k").agg(F.max(F.char_length("text")).cast("long").alias("n")), "simhash-ids")
    links = materialize(followers(ids, ranges), "simhash-next")
    takes = links.select(F.col("next_k").alias("k"), F.col("k").alias("before"), F.floor(F.col("n") / 4).cast("int").alias("take"))
    heads = base.join(takes, "k").select(F.col("before").alias("k"), F.struct(F.expr("substring(text, 1, take)").alias("head"), "row").alias("head"))
    heads = heads.groupBy("k").agg(F.min("head")["head"].alias("head"))
    n = F.char_length("text")
    edited = F.expr("concat(substring(text, 1, char_length(text) - char_length(text) div 4), substring(head, 1, cast(char_length(text) div 4 as int)))")
    rows = base.join(heads, "k").select("k", n.cast("long").alias("n_chars"), "text", edited.alias("edited"), "row")
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("body")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("body"))))
    both = rows.select("k", "n_chars", "row", F.sha2(F.col("edited").cast("binary"), 256).alias("sha"), sides.alias("s")).select("k", "n_chars", "row", "sha", "s.*")
    fps = fingerprints(both, ["k", "n_chars", "row", "sha", "side"])
    pick = lambda side: F.max(F.when(F.col("side") == side, F.col("fp")))
    own = materialize(fps.groupBy("k", "n_chars", "row", "sha").agg(pick(0).alias("fp"), pick(1).alias("edited_fp")), "simhash-own")
    after = links.join(own.groupBy(F.col("k").alias("next_k")).agg(F.min("fp").alias("next_fp")), "next_k").select("k", "next_fp")
    doc_id = F.when(F.col("k") != least, F.col("k"))
    searched = own.where(doc_id % every == 0)
    as_hex = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    pairs = materialize(near(searched, own), "simhash-near")
    copies = own.groupBy("fp").agg(F.count(F.lit(1)).alias("copies"))
    found = pairs.join(copies.withColumnRenamed("fp", "other"), "other").groupBy("fp").agg(F.sum("copies").alias("found"))
    firsts = searched.groupBy("fp").agg(F.min(F.struct("k", "row")).alias("first"))
    n_near = F.col("copies") - 1 + F.coalesce("found", F.lit(0).cast("long"))
    counts = firsts.join(copies, "fp").join(found, "fp", "left").select("fp", n_near.alias("n_near"))
    counts = materialize(counts.where("n_near > 0"), "simhash-counts")
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts
    lists = pairs.groupBy("fp").agg(F.sort_array(F.collect_list(F.struct("distance", as_hex("other").alias("fingerprint")))).alias("near"))
    lists = firsts.join(lists, "fp", "left").select("first.*", F.coalesce("near", F.array().cast("array<struct<distance: int, fingerprint: string>>")).alias("near"))
    out = own.join(after, "k").join(lists, ["k", "row"], "left").join(counts, "fp", "left")
    return out.select(
        doc_id.alias("doc_id"),
        "n_chars",
        F.col("sha").alias("edited_sha256"),
        as_hex("fp").alias("fingerprint"),
        as_hex("edited_fp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.when(doc_id % every == 0, F.coalesce("n_near", F.lit(0).cast("long"))).alias("n_near"),
        "near",
    )
