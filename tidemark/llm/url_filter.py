"""URL filters: stated host and path rules, then association rules mined from labelled URLs.

A URL is taken apart into tokens: the labels of its host, the segments of its path with their depth, and its query
names. A page is labelled by the stated rule that fits its URL and otherwise by the table of labels, so that the rules
carry the stated verdicts on to other pages of the same hosts and paths. Over labelled URLs, Spark's FP-growth mines token combinations; those that imply the label "bad" with enough confidence and support
are pruned of rules that a shorter rule of no less confidence covers. The rest is kept as an inverted index from token
to rules: a URL meets the rules of its own tokens alone, and a rule matches where all of its tokens have met it.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

#: Stated rules: verdict, host and path prefix.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: A rule holds in at least this share and number of the labelled pages, and this share of the pages it matches is bad.
MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE = 0.001, 20, 0.8
BAD = "=bad"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of the inverted index that are broadcast; a longer index is joined by shuffle.
BROADCAST_ROWS = 100_000


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def stated(host: Column, path: Column, rules=RULES) -> Column:
    """The longest stated rule that fits, as struct(size, rule, verdict), or null."""
    fits = []
    for verdict, rule in rules:
        at, _, rest = rule.partition("/")
        fit = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        fits.append(F.when(fit, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array_compact(F.array(*fits)))


def tokens_of(url: Column) -> Column:
    """Sorted distinct tokens: h:<label of the host>, p<depth>:<path segment>, q:<query name>; digits of a path count as 0."""
    named = lambda kind, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    segment = lambda x, i: F.when(x != "", F.concat(F.lit("p"), i.cast("string"), F.lit(":"), F.regexp_replace(x, "[0-9]+", "0")))
    query = F.coalesce(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit(""))
    names = F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^([^=]*)", 1))
    found = F.concat(named("h:", F.split(host_of(url), r"\.")), F.array_compact(F.transform(F.split(path_of(url), "/"), segment)), named("q:", names))
    return F.array_sort(F.array_distinct(found))


def interchangeable(labelled: DataFrame) -> DataFrame:
    """token, item: the least of the tokens that stand on the same rows of labelled(tokens).

    Rows are told apart by their token sets, of which two hashes are summed up for each token.
    """
    mark = lambda seed: F.sum(F.xxhash64(F.lit(seed), F.col("tokens")).cast("decimal(20,0)"))
    found = labelled.select("tokens", F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"), mark(1).alias("x"), mark(2).alias("y"))
    return found.join(found.groupBy("n", "x", "y").agg(F.min("token").alias("item")), ["n", "x", "y"]).select("token", "item")


def folded(token_sets: DataFrame, items: DataFrame) -> DataFrame:
    """tokens, folded: the distinct sets of token_sets(tokens), and their items; tokens that no item stands for go."""
    sets = token_sets.select("tokens").distinct()
    found = sets.select("tokens", F.explode("tokens").alias("token")).join(items, "token").groupBy("tokens").agg(F.array_sort(F.collect_set("item")).alias("folded"))
    return sets.join(found, "tokens", "left").select("tokens", F.coalesce("folded", F.array().cast("array<string>")).alias("folded"))


def mine(labelled: DataFrame, min_support=MIN_SUPPORT, min_count=MIN_COUNT, min_confidence=MIN_CONFIDENCE) -> DataFrame:
    """Rules (tokens, confidence, count) that imply "bad", from labelled(tokens, bad).

    Support is at least min_support of the rows and min_count rows. A rule is dropped if a part of its tokens is a
    rule of no less confidence. The number of rules is bounded by support, not by the number of URLs.
    """
    rows = labelled.select(F.when(F.col("bad"), F.array_append("tokens", F.lit(BAD))).otherwise(F.col("tokens")).alias("items"))
    n = rows.count()
    least = max(min_support, min_count / n if n else 1.0)
    if least > 1 or not n:
        return labelled.sparkSession.createDataFrame([], "tokens array<string>, confidence double, count long")
    sets = materialize(FPGrowth(itemsCol="items", minSupport=least, minConfidence=min_confidence).fit(rows).freqItemsets, "url-itemsets")
    with_bad = sets.where(F.array_contains("items", BAD) & (F.size("items") > 1)).select(F.array_sort(F.array_remove("items", BAD)).alias("tokens"), F.col("freq").alias("bad"))
    alone = sets.where(~F.array_contains("items", BAD)).select(F.array_sort("items").alias("tokens"), F.col("freq").alias("all"))
    rules = with_bad.join(alone, "tokens").select("tokens", (F.col("bad") / F.col("all")).alias("confidence"), F.col("bad").alias("count")).where(F.col("confidence") >= min_confidence)
    parts = rules.select(F.col("tokens").alias("part"), F.col("confidence").alias("part_confidence"), F.element_at("tokens", 1).alias("first"))
    whole = rules.select("tokens", "confidence", F.explode("tokens").alias("first"))
    covered = whole.join(parts, "first").where((F.size("part") < F.size("tokens")) & (F.size(F.array_except("part", "tokens")) == 0) & (F.col("part_confidence") >= F.col("confidence")))
    return rules.join(covered.select("tokens").distinct(), "tokens", "left_anti")


def matches(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct token sets that some rule matches, through the inverted index."""
    index = materialize(rules.select(F.size("tokens").alias("need"), F.concat_ws("\t", "tokens").alias("rule"), F.explode("tokens").alias("token")), "url-rules")
    index = F.broadcast(index) if index.count() <= BROADCAST_ROWS else index
    met = token_sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token").groupBy("tokens", "rule").agg(F.count(F.lit(1)).alias("met"), F.first("need").alias("need"))
    return met.where("met = need").select("tokens").distinct()


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, **mining) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages(page_id, url).

    labels(page_id, bad) marks some pages; where a stated rule fits, its verdict is the label instead. Where none fits, a
    page is blocked if a mined rule matches and allowed otherwise. A null url has empty host and path and is allowed;
    repeated rows and null page_ids stay as they are; an empty table gives no rows, and without labelled pages nothing is
    mined. Other columns are ignored.
    """
    base = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"))
    marked = labels.where("bad is not null and page_id is not null").groupBy(F.col("page_id").cast("long").alias("page_id")).agg(F.bool_or("bad").alias("bad"))
    rows = base.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), tokens_of(F.col("url")).alias("tokens"))
    rows = rows.withColumn("stated", stated(F.col("host"), F.col("path"), rules))
    told = rows.join(marked, "page_id", "left").select("tokens", F.coalesce(F.col("stated.verdict") == "block", "bad").alias("bad"))
    told = materialize(told.where("bad is not null"), "url-told")
    items = materialize(interchangeable(told), "url-items")
    mined = mine(told.join(folded(told, items), "tokens").select(F.col("folded").alias("tokens"), "bad"), **mining)
    open_sets = materialize(folded(rows.where("stated is null"), items), "url-open")
    hits = matches(open_sets.select(F.col("folded").alias("tokens")).distinct(), mined).withColumnRenamed("tokens", "folded")
    blocked = materialize(open_sets.join(hits, "folded").select("tokens"), "url-blocked")
    few = blocked.count() <= BROADCAST_ROWS
    blocked = blocked.withColumn("hit", F.lit(True))
    rows = rows.join(F.broadcast(blocked) if few else blocked, "tokens", "left")
    verdict = F.coalesce("stated.verdict", F.when(F.col("hit"), "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", F.col("stated.rule").alias("rule"), verdict.alias("verdict"))


ORACLE_SQL = f"""
WITH RECURSIVE parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
         coalesce(regexp_extract(url, '(?s)^[^?#]*\\?([^#]*)', 1), '') AS query, row_number() OVER () AS n
  FROM pages),
rules(rule, verdict) AS (VALUES {", ".join(f"('{r}', '{v}')" for v, r in RULES)}),
fits AS (
  SELECT n, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM parts, rules
  WHERE (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
    AND starts_with(path, substr(rule, strpos(rule, '/')))
  GROUP BY n),
toks AS (
  SELECT DISTINCT n, kind || part AS token FROM (
    SELECT n, 'h:' AS kind, unnest(string_split(host, '.')) AS part FROM parts
    UNION ALL SELECT n, 'p' || unnest(range(len(string_split(path, '/')))) || ':', regexp_replace(unnest(string_split(path, '/')), '[0-9]+', '0', 'g') FROM parts
    UNION ALL SELECT n, 'q:', split_part(unnest(string_split(query, '&')), '=', 1) FROM parts)
  WHERE part <> ''),
marks AS (SELECT doc_id, bool_or(quality = 0 OR toxic = 1) AS bad FROM labels WHERE doc_id IS NOT NULL AND (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY doc_id),
marked AS (
  SELECT n, coalesce(fits.verdict = 'block', marks.bad) AS bad FROM parts LEFT JOIN fits USING (n) LEFT JOIN marks ON page_id = doc_id
  WHERE coalesce(fits.verdict = 'block', marks.bad) IS NOT NULL),
combos AS (
  SELECT n, [token] AS s FROM toks
  UNION ALL SELECT c.n, list_append(c.s, t.token) FROM combos c JOIN toks t ON c.n = t.n AND t.token > c.s[-1]),
mined AS (
  SELECT s FROM combos JOIN marked USING (n) GROUP BY s
  HAVING count(*) FILTER (WHERE bad) >= greatest({MIN_COUNT}, {MIN_SUPPORT} * (SELECT count(*) FROM marked))
     AND count(*) FILTER (WHERE bad) >= {MIN_CONFIDENCE} * count(*)),
hit AS (SELECT DISTINCT n FROM combos JOIN mined USING (s))
SELECT page_id, host, path, f.rule AS rule, coalesce(f.verdict, CASE WHEN hit.n IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN fits f USING (n) LEFT JOIN hit USING (n)
"""
