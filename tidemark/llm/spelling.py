"""Spelling variants by a trie self-join with active-node sets.

Words at distance one (one code point inserted, deleted or replaced) are near. The vocabulary is seen as a trie. The
active nodes of a node u are the nodes within distance one of it; apart from u itself they follow from the active nodes
of u's parent p: p, the other children of p, the children of u, and the node y + c of every active y of p, where c leads
from p to u. Terminal active nodes of a terminal node are its near words.

The upper part of the trie, of DEPTH levels, is a table of nodes; active nodes are propagated level by level by joins on
the node, so the work is dealt out by prefix, and a node has at most about 2 * alphabet * level of them. Below an active
node at distance one no further edit is allowed: there the rest of a word must follow unchanged, and its end is looked
up in the vocabulary. Edits below the upper part stay in the subtrie of one prefix, which is joined with itself in a
task, as long as it holds at most LEAF words; larger subtries go through the same levels again from their own root. So
no task holds more than LEAF words at a time, and no pair is lost.
"""

from __future__ import annotations

from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.crc import CRC_SQL
from tidemark.session import discard, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Levels of the upper part of a trie.
DEPTH = 6
#: Words of a subtrie that one task joins with itself.
LEAF = 4_096


class Variants(NamedTuple):
    """Words of `least_chars` code points that occur `least_count` times; of runs whose crc32 `every` divides, a code
    point is deleted; the form of a word is `ratio` times as common as the word, more than once, or chains could close."""

    least_chars: int = 6
    least_count: int = 5
    every: int = 199
    ratio: int = 5


def vocabulary(docs: DataFrame, rule: Variants = Variants()) -> DataFrame:
    """word, n of docs(doc_id, text). Occurrences are counted in each task before they are shuffled."""
    lowered = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    run = F.explode(F.regexp_extract_all(lowered, F.lit(f"[a-z\\u00C0-\\u00FF]{{{rule.least_chars},}}"), F.lit(0)))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = docs.select(key.alias("key"), run.alias("run")).withColumn("h", F.crc32(F.concat_ws(":", "key", "run")))
    size = F.char_length("run")
    at = (F.col("h") % size).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, size))
    words = runs.select(F.when(F.col("h") % rule.every == 0, cut).otherwise(F.col("run")).alias("word"))
    counted = words.where(F.char_length("word") >= rule.least_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= rule.least_count)


def trie_nodes(words: DataFrame, depth: int) -> DataFrame:
    """root, level, node, parent, c of the nodes of levels 1 to depth + 1 of words(root, rest)."""
    level = F.explode(F.sequence(F.lit(1), F.least(F.char_length("rest"), F.lit(depth + 1)))).alias("level")
    rows = words.where("rest <> ''").select("root", "rest", level).select("root", "level", F.substring("rest", F.lit(1), F.col("level")).alias("node")).distinct()
    return rows.select("root", "level", "node", F.substring("node", F.lit(1), F.col("level") - 1).alias("parent"), F.substring("node", F.col("level"), F.lit(1)).alias("c"))


def active_nodes(nodes: DataFrame, depth: int):
    """For each level 0 to depth, a table root, u, v: the nodes v at distance one of each node u of that level.

    Of the last level's nodes the own children are left out: they lie in its subtrie.
    """
    at = lambda level: nodes.where(F.col("level") == level)
    active = materialize(at(1).select("root", F.col("parent").alias("u"), F.col("node").alias("v")), "spelling-active")
    yield active
    for level in range(1, depth + 1):
        here = at(level).select("root", "parent", "c", F.col("node").alias("u"))
        above = here.select("root", "u", F.col("parent").alias("v"))
        others = here.join(here.select("root", "parent", F.col("u").alias("v")), ["root", "parent"]).where("u <> v").select("root", "u", "v")
        down = active.withColumnRenamed("u", "parent").join(here, ["root", "parent"]).select("root", "u", F.concat("v", "c").alias("v"))
        down = down.join(nodes.select("root", F.col("node").alias("v")), ["root", "v"], "left_semi").select("root", "u", "v")
        found = above.unionByName(others).unionByName(down)
        if level < depth:
            found = found.unionByName(at(level + 1).select("root", F.col("parent").alias("u"), F.col("node").alias("v")))
        active = materialize(found.distinct(), "spelling-active")
        yield active


def subtrie_pairs(words: list[str], skip: int = 0) -> list[tuple[int, int]]:
    """Indices of every two of the sorted distinct words at distance one, both ways, by active nodes; the words share
    their first `skip` code points."""
    children: list[dict[str, int]] = [{}]
    ends = [-1]
    for i, word in enumerate(words):
        at = 0
        for c in word[skip:]:
            down = children[at].get(c)
            if down is None:
                down = children[at][c] = len(children)
                children.append({})
                ends.append(-1)
            at = down
        ends[at] = i
    out, todo = [], [(0, set(children[0].values()))]
    while todo:
        node, active = todo.pop()
        if ends[node] >= 0:
            out += [(ends[node], ends[y]) for y in active if ends[y] >= 0]
        for c, kid in children[node].items():
            near = {node, *children[node].values(), *children[kid].values()}
            near.update(children[y][c] for y in active if c in children[y])
            near.discard(kid)
            todo.append((kid, near))
    return out


def within_subtries(groups: DataFrame) -> DataFrame:
    """word, near of the words in each subtrie of groups(root, word), both ways. A task holds one subtrie at a time."""
    schema = pa.schema([("word", pa.string()), ("near", pa.string())])

    def run(batches):
        root, held = None, []
        for batch in batches:
            out = []
            for own, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != root:
                    out += [(held[i], held[j]) for i, j in subtrie_pairs(held, len(root))] if len(held) > 1 else []
                    root, held = own, []
                held.append(word)
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.string()), pa.array([b for _, b in out], pa.string())], schema=schema)
        if len(held) > 1:
            out = subtrie_pairs(held, len(root))
            yield pa.RecordBatch.from_arrays([pa.array([held[i] for i, _ in out], pa.string()), pa.array([held[j] for _, j in out], pa.string())], schema=schema)

    count = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = groups.select("root", "word").repartition(count, "root").sortWithinPartitions("root", "word")
    return dealt.mapInArrow(run, "word string, near string")


def near_words(words: DataFrame, depth: int = DEPTH, leaf: int = LEAF) -> DataFrame:
    """word, near: every two words of words(word) at distance one, both ways. The words are distinct and not empty."""
    todo = words.select(F.lit("").alias("root"), F.col("word").alias("rest"), "word")
    found, done = [], []
    while True:
        nodes = materialize(trie_nodes(todo, depth), "spelling-nodes")
        levels = list(active_nodes(nodes, depth))
        active = levels[0]
        for level in levels[1:]:
            active = active.unionByName(level)
        stop = F.least(F.char_length("rest"), F.lit(depth))
        tails = todo.select("root", F.substring("rest", F.lit(1), stop).alias("u"), F.substring("rest", stop + 1, F.char_length("rest")).alias("tail"), "word")
        ends = tails.join(active, ["root", "u"]).select("word", F.concat("root", "v", "tail").alias("near"))
        found.append(materialize(ends.join(words.select(F.col("word").alias("near")), "near", "left_semi").select("word", "near"), "spelling-ends"))
        discard(nodes, *levels)
        deep = todo.where(F.char_length("rest") >= depth).withColumn("root", F.concat("root", F.substring("rest", F.lit(1), F.lit(depth))))
        deep = deep.select("root", F.substring("rest", F.lit(depth + 1), F.char_length("rest")).alias("rest"), "word")
        sizes = deep.groupBy("root").agg(F.count(F.lit(1)).alias("k"))
        deep = materialize(deep.join(sizes.where("k > 1"), "root"), "spelling-subtries")
        found.append(materialize(within_subtries(deep.where(F.col("k") <= leaf)), "spelling-within"))
        done.append(deep)
        todo = deep.where(F.col("k") > leaf).select("root", "rest", "word")
        if todo.isEmpty():
            break
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near")))
    out = materialize(both.distinct(), "spelling-near")
    discard(*found, *done)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """word, root of forms(word, form): the end of the chain of forms of each word.

    Each round doubles the stretch of a chain that is followed; a form is `ratio` times as common as its word, so that
    rounds grow with the logarithm of a chain whose length grows with the logarithm of the counts.
    """
    now = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = materialize(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        discard(now)
        now = after.select("word", "root")
        if after.where("moved").isEmpty():
            return now


def groups(docs: DataFrame, rule: Variants = Variants()) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of docs(doc_id, text).

    A null, empty or letterless text has no words; a null doc_id counts as an empty string in the hash of a run. Rows
    that repeat a doc_id count each. Ties between near words fall to the first in code-point order. An empty table gives
    no rows; other columns are ignored.
    """
    words = materialize(vocabulary(docs, rule), "spelling-words")
    near = near_words(words, min(DEPTH, rule.least_chars))
    met = near.join(words.select(F.col("word").alias("near"), F.col("n").alias("m")), "near")
    best = met.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    known = words.join(best, "word", "left")
    common = -F.col("best.m") >= rule.ratio * F.col("n")
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(common, F.col("best.near")).alias("form"), F.when(common, -F.col("best.m")).alias("form_n"))
    known = materialize(known, "spelling-forms")
    ends = roots(known.where("form is not null"))
    discard(words, near)
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{{6,}}')) AS run FROM documents)
  GROUP BY ALL),
hashed AS (SELECT run, k, {CRC_SQL.format(text="(doc_id || ':' || run)")} AS h FROM runs),
vocab AS (
  SELECT word, sum(k)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
cuts AS (SELECT word, i, left(word, i) || substr(word, i + 2) AS cut FROM (SELECT word, unnest(range(length(word))) AS i FROM vocab)),
pairs AS (
  SELECT a.word, b.word AS near FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word FROM cuts a JOIN vocab b ON a.cut = b.word
  UNION SELECT b.word, a.word FROM cuts a JOIN vocab b ON a.cut = b.word),
best AS (
  SELECT p.word, count(*) AS n_near, arg_min(p.near, (-o.n, p.near)) AS near, max(o.n) AS near_n
  FROM pairs p JOIN vocab o ON p.near = o.word GROUP BY p.word),
known AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * v.n THEN near END AS form,
         CASE WHEN near_n >= 5 * v.n THEN near_n END AS form_n
  FROM vocab v LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS root FROM known
  UNION ALL SELECT c.word, k.form FROM chain c JOIN known k ON c.root = k.word WHERE k.form IS NOT NULL)
SELECT k.word, k.form, c.root, k.n, k.n_near, k.form_n
FROM known k JOIN (SELECT c.word, c.root FROM chain c JOIN known e ON c.root = e.word WHERE e.form IS NULL) c USING (word)
"""
