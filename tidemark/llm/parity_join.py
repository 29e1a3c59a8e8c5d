"""N-gram Jaccard join by parity sketches.

A text's set holds its distinct word shingles. Texts of equal sets are one class; classes of sizes a and b link when
their sets' Jaccard similarity reaches the threshold, that is when the symmetric difference has at most
`most_apart(a + b)` shingles. A parity sketch XORs hashed shingles into bits, so two sketches differ in no more places
than the sets have shingles in which they differ.

Candidates. Sizes are cut into bands such that linked sizes lie in one band or in two neighbouring ones. For each pair
of neighbouring bands the sketch is cut into more blocks than the largest difference allowed (D): linked sets agree on
at least blocks - D of them. A block is so wide that it is kept as the XOR of the 64-bit hashes of its shingles. Each
class is indexed under its D + 1 strongest blocks, by number of shingles and then key, and classes that share one are
candidates: of the blocks on which linked sets agree, the strongest has blocks - D - 1 weaker ones in either set.

Links. Of the classes that share a block, the one of least hash leads; each is paired with its leaders alone, the pairs
are verified on the full sets, and connected components are found over the links. This leaves open blocks in which
components meet. There, all members of different components are compared by size and sketch. A cell of such a block
gives a forest of near pairs, which are verified, and names the members with near pairs beyond it. Where those are
still of different components after that, they meet again with their full sets, and a task gives the links that join
components alone. So no link between components is lost, and no step gives more rows than it has members.

All links. Linked classes are in one component, so that every two classes of a component whose size bands allow a link
meet in exactly one cell, bounded by classes and shingles, where sketches and then the full sets are compared. A cell gives either the links themselves (linked_pairs) or how
many rows each of its classes links to (count_links), which is added up without a row for each link.

Skew. Exact copies are one class, indexed once per task. A block that a batch of rows meets HOT times has a leader in
the batch; only that goes on under the block's key, and the other rows, paired already, are dealt out at random.
"""

from __future__ import annotations

import functools
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import shingles, vocab
from tidemark.llm.components import components
from tidemark.session import discard, materialize

#: Rows of one block in one batch from which on they get a leader of their own.
HOT = 32
#: Index rows in a batch.
BATCH_ROWS = 200_000
#: Bits of the sketch that pairs are compared by, for each shingle of the larger set.
BITS_A_SHINGLE = 4
#: Ids that are broadcast at most (16 bytes each), beyond that they are joined by shuffle.
BROADCAST_ROWS = 1_000_000

SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.int64())])
INDEX = pa.schema([("route", pa.int64()), ("cls", pa.int64()), ("hot", pa.struct([("key", pa.int64()), ("leader", pa.int64())]))])
MULTI = pa.schema([("key", pa.int64()), ("cls", pa.int64()), ("leader", pa.int64())])
PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
DEGREES = pa.schema([("cls", pa.int64()), ("links", pa.int64())])


class Rule(NamedTuple):
    """Sets of runs of `words` words link if den * |intersection| >= num * |union|."""

    words: int = 4
    num: int = 85
    den: int = 100

    def least_common(self, total: int) -> int:
        """Shingles that linked sets of so many shingles together have in common at least."""
        return -(-self.num * total // (self.num + self.den))

    def most_apart(self, total: int) -> int:
        return total - 2 * self.least_common(total)


@functools.cache
def band_starts(rule: Rule, upto: int = 1 << 31) -> np.ndarray:
    """Least size of each band: a size links to none beyond the next band."""
    starts = [1]
    while starts[-1] < upto:
        starts.append(max(starts[-1] + 1, (starts[-1] - 1) * rule.den // rule.num + 1))
    return np.array(starts)


@functools.cache
def blocks_of(rule: Rule, band: int) -> tuple[int, int]:
    """Number of blocks for a band with the next one, and the largest difference D among them."""
    starts = band_starts(rule)
    low = int(starts[band + 1]) - 1
    high = min(int(starts[band + 2]) - 1, low * rule.den // rule.num)
    apart = max(0, *(rule.most_apart(t) for t in range(max(2, low + high - 40), low + high + 1)))
    return (apart + 1 + max(2, math.ceil(apart / 8)), apart) if apart else (0, 0)


def class_of(items: np.ndarray) -> int:
    """64-bit identity of a set, without regard to order."""
    return int(shingles.mix(np.array([np.add.reduce(shingles.mix(items ^ np.uint64(0x5851F42D4C957F2D))) + np.uint64(len(items))], np.uint64)).view(np.int64)[0])


def block_keys(items: np.ndarray, rule: Rule) -> np.ndarray:
    """Keys of the blocks under which a set is indexed."""
    band = int(np.searchsorted(band_starts(rule), len(items), side="right")) - 1
    folded = shingles.mix(items ^ np.uint64(0x9FB21C651E98DF25))
    out = []
    for low in (band - 1, band):
        count, apart = blocks_of(rule, low) if low >= 0 else (0, 0)
        if not count:
            continue
        block = ((items >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)  # ascends, as the items do
        first = np.flatnonzero(np.diff(block, prepend=np.uint64(count)))
        values, places, weights = np.bitwise_xor.reduceat(folded, first), block[first], np.diff(np.append(first, len(items)))
        spare = count - apart - 1
        if count - len(first) > spare:
            empty = np.setdiff1d(np.arange(count, dtype=np.uint64), places)
            values, places, weights = np.concatenate([values, np.zeros(len(empty), np.uint64)]), np.concatenate([places, empty]), np.append(weights, np.zeros(len(empty), np.int64))
        keys = shingles.mix(values + shingles.mix(places + np.uint64((low + 1) << 32)))
        out.append(keys[np.lexsort((keys, weights))[len(keys) - apart - 1 :]])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _text_batches(batch: pa.RecordBatch, *names: str):
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def set_table(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n, cls of every row: size of its set and its class, null for an empty set."""

    def run(batches):
        vocab.forget()
        for batch in batches:
            ids, texts = batch.column(batch.schema.get_field_index("doc_id")), batch.column(batch.schema.get_field_index("text")).to_pylist()
            found = [(len(s), class_of(s) if len(s) else None) for s in shingles.text_sets(texts, rule.words)]
            yield pa.RecordBatch.from_arrays([ids, pa.array([n for n, _ in found], pa.int64()), pa.array([c for _, c in found], pa.int64())], schema=SETS)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, cls long")


def _with_leaders(keys: np.ndarray, classes: np.ndarray):
    """Index rows of a batch; blocks met HOT times get their leader here."""
    order = np.lexsort((classes, keys))
    keys, classes = keys[order], classes[order]
    first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    count = np.diff(np.append(first, len(keys)))
    size, leader = np.repeat(count, count), np.repeat(classes[first], count)
    hot = size >= HOT
    leads = np.zeros(len(keys), bool)
    leads[first] = True
    plain = ~hot | leads
    pairs = pa.StructArray.from_arrays([pa.array(keys[hot].view(np.int64)), pa.array(leader[hot])], fields=list(INDEX.field("hot").type))
    route = shingles.mix(keys[hot] ^ shingles.mix(classes[hot].view(np.uint64)))
    yield pa.RecordBatch.from_arrays([pa.array(keys[plain].view(np.int64)), pa.array(classes[plain]), pa.nulls(int(plain.sum()), INDEX.field("hot").type)], schema=INDEX)
    if hot.any():
        yield pa.RecordBatch.from_arrays([pa.array(route.view(np.int64)), pa.array(classes[hot]), pairs], schema=INDEX)


def index(docs: DataFrame, rule: Rule = Rule(), keys_of=block_keys) -> DataFrame:
    """Rows (route, cls, hot): a class under the key of a block, or with the key and leader it has been given.

    keys_of(items, rule) gives the keys of a set; those of another scheme than parity blocks may stand in.
    """

    def run(batches):
        vocab.forget()
        seen: set[int] = set()
        keys, classes, held = [], [], 0
        for batch in batches:
            for items in shingles.text_sets(batch.column(0).to_pylist(), rule.words):
                if not len(items) or (cls := class_of(items)) in seen:
                    continue
                seen.add(cls)
                own = keys_of(items, rule)
                keys.append(own)
                classes.append(np.full(len(own), cls, np.int64))
                held += len(own)
                if held >= BATCH_ROWS:
                    yield from _with_leaders(np.concatenate(keys), np.concatenate(classes))
                    keys, classes, held = [], [], 0
        if held:
            yield from _with_leaders(np.concatenate(keys), np.concatenate(classes))

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "route long, cls long, hot struct<key: long, leader: long>")


def shared_blocks(rows: DataFrame) -> DataFrame:
    """key, cls, leader of the classes in each block that at least two share, from index rows.

    Rows come sorted, so a task holds one batch and the block at hand's leader alone.
    """

    def run(batches):
        last, leader, alone, previous = None, None, False, None
        for batch in batches:
            route, cls, hot = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            given = np.asarray(hot.is_valid())
            if given.any():
                key = pa.compute.struct_field(hot, 0).filter(pa.array(given))
                yield pa.RecordBatch.from_arrays([key, pa.array(cls[given]), pa.compute.struct_field(hot, 1).filter(pa.array(given))], schema=MULTI)
            route, cls = route[~given], cls[~given]
            if not len(route):
                continue
            keep = np.ones(len(route), bool)
            keep[1:] = (route[1:] != route[:-1]) | (cls[1:] != cls[:-1])
            keep[0] = not (route[0] == last and cls[0] == previous)
            last_route, last_cls = route[-1], cls[-1]
            route, cls = route[keep], cls[keep]
            if not len(route):
                continue
            first = np.flatnonzero(np.concatenate([[True], route[1:] != route[:-1]]))
            count = np.diff(np.append(first, len(route)))
            leads = np.repeat(cls[first], count)
            many = np.repeat(count > 1, count)
            if route[0] == last:  # goes on from the batch before
                many[: count[0]] = True
                leads[: count[0]] = leader
                if alone:
                    yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([leader]), pa.array([leader])], schema=MULTI)
            alone = bool(count[-1] == 1 and not (len(first) == 1 and route[0] == last))
            if not (len(first) == 1 and route[0] == last):
                leader = cls[first[-1]]
            last, previous = last_route, last_cls
            if many.any():
                yield pa.RecordBatch.from_arrays([pa.array(route[many]), pa.array(cls[many]), pa.array(leads[many])], schema=MULTI)

    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(count, "route").sortWithinPartitions("route", "cls")
    return dealt.mapInArrow(run, "key long, cls long, leader long")


def sketch(items: np.ndarray) -> np.ndarray:
    """Parity bits of a set as 64-bit words: at least BITS_A_SHINGLE bits a shingle, a power of two in number."""
    bits = max(64, 1 << (BITS_A_SHINGLE * len(items) - 1).bit_length())
    odd = np.bincount((items & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def fold(words: np.ndarray, width: int) -> np.ndarray:
    """A sketch of so many words from a wider one: halves are XORed, which keeps parities."""
    while len(words) > width:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def class_table(docs: DataFrame, chosen: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """cls, n, sketch and items (sorted hashes) for one document of each class in chosen(cls, chosen_id).

    Only the chosen documents are taken apart again, and those without a doc_id, whose class is then looked up.
    """
    schema = pa.schema([("cls", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()), ("items", pa.binary())])

    def run(batches):
        for batch in batches:
            texts, want = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for items, cls in zip(shingles.text_sets(texts, rule.words), want, strict=True):
                own = class_of(items) if len(items) else None
                if own is not None and cls in (None, own):  # of rows that share a doc_id, the one of this class
                    rows.append((own, len(items), sketch(items).tobytes(), items.tobytes()))
            yield vocab.batch_of(schema, rows)

    few = chosen.count() <= BROADCAST_ROWS
    named = chosen.where("chosen_id is not null").select("cls", F.col("chosen_id").alias("doc_id"))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    kind = "cls long, n long, sketch binary, items binary"
    found = rows.join(F.broadcast(named) if few else named, "doc_id").select("text", "cls").mapInArrow(run, kind)
    nameless = rows.where("doc_id is null").select("text", F.lit(None).cast("long").alias("cls")).mapInArrow(run, kind)
    nameless = nameless.join(chosen.where("chosen_id is null").select("cls"), "cls", "left_semi")
    return found.unionByName(nameless).dropDuplicates(["cls"])


def sided(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """a, b with the column of either class as x and y."""
    side = lambda c, name: table.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}"), F.col(column).alias(name))
    return pairs.select("a", "b").join(side("b", "y"), "b").join(side("a", "x"), "a")


def verify(pairs: DataFrame, table: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The pairs (a, b) of classes whose full sets link: those whose sizes and sketches allow it are compared."""

    def sketched(batches):
        for batch in batches:
            near = []
            for a, b, m, n, x, y in _text_batches(batch, "a", "b", "na", "nb", "x", "y"):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                width = min(len(x), len(y))
                if np.bitwise_count(fold(x, width) ^ fold(y, width)).sum() <= rule.most_apart(m + n):
                    near.append((a, b))
            yield vocab.batch_of(PAIRS, near)

    def full(batches):
        for batch in batches:
            out = []
            for a, b, x, y in _text_batches(batch, "a", "b", "x", "y"):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                if common >= rule.least_common(len(x) + len(y)):
                    out.append((a, b))
            yield vocab.batch_of(PAIRS, out)

    sizes = (F.col("na") * rule.den >= F.col("nb") * rule.num) & (F.col("nb") * rule.den >= F.col("na") * rule.num)
    near = materialize(sided(pairs, table, "sketch").where(sizes).mapInArrow(sketched, "a long, b long"), "parity-near")
    met = near.select(F.col("a").alias("cls")).unionByName(near.select(F.col("b").alias("cls"))).distinct()
    met = F.broadcast(met) if near.count() <= BROADCAST_ROWS else met
    return sided(near, table.join(met, "cls", "left_semi"), "items").mapInArrow(full, "a long, b long")


#: Members of a block that are compared with each other at a time; a larger block is split into pairs of such parts.
PART = 1_024
CELL = "key long, i long, j long"


def open_members(multi: DataFrame, comps: DataFrame) -> DataFrame:
    """key, k, cls, comp, top (its commonest component and how many members that has) of blocks with three members or
    more in which components meet; of blocks with the same members one stays."""
    rows = multi.select("key", "cls").distinct().join(comps.select(F.col("node").alias("cls"), "comp"), "cls", "left")
    rows = rows.withColumn("comp", F.coalesce("comp", "cls"))
    parts = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("k"), F.sum(F.xxhash64("cls").cast("decimal(20,0)")).alias("members"))
    blocks = parts.groupBy("key").agg(F.sum("k").alias("k"), F.max(F.struct("k", "comp")).alias("top"), F.sum("members").alias("members"))
    blocks = blocks.where("k > 2 and top.k < k").groupBy("k", "members", "top").agg(F.min("key").alias("key"))
    return rows.join(blocks.select("key", "k", "top"), "key").select("key", "k", "cls", "comp", "top")


def in_cells(members: DataFrame, parts: int = PART) -> DataFrame:
    """The members, each in the cells (key, i, j) in which it meets those of other components.

    A block of up to `parts` members is one cell. In a larger one, the commonest component and the rest are each cut
    into parts; each two parts meet in one cell, but for two parts of the commonest component, which is done with.
    """
    some = F.ceil(F.col("top.k") / parts).cast("int")
    count = some + F.ceil((F.col("k") - F.col("top.k")) / parts).cast("int")
    of_top, h = F.col("comp") == F.col("top.comp"), F.xxhash64("cls")
    part = F.when(F.col("k") <= parts, 0).when(of_top, F.pmod(h, F.col("some"))).otherwise(F.col("some") + F.pmod(h, F.col("count") - F.col("some"))).cast("int")
    to = lambda low, high: F.sequence(low, high - 1)
    cell = lambda i, j: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"))
    own = F.col("part")
    with_top = F.transform(to(F.lit(0), F.col("some")), lambda i: cell(i, own))
    below = F.transform(F.sequence(F.col("some"), own), lambda i: cell(i, own))
    above = F.transform(to(own, F.col("count")), lambda j: cell(own, j))
    cells = F.when(F.col("k") <= parts, F.array(cell(own, own))).when(of_top, F.transform(to(F.col("some"), F.col("count")), lambda j: cell(own, j))).otherwise(F.array_distinct(F.concat(with_top, below, above)))
    rows = members.withColumn("some", some).withColumn("count", count).withColumn("part", part).withColumn("cell", F.explode(cells))
    return rows.select("key", "cell.i", "cell.j", "cls", "comp", F.col("part").cast("long"))


def by_cell(rows: DataFrame, meet, out: pa.Schema, kind: str) -> DataFrame:
    """meet(i, j, columns) of every cell of rows(key, i, j, ...): numbers come as arrays, the last column as a list.

    Rows come sorted by cell, and the last cell of a batch may go on in the next one: a task holds one batch and the
    pieces of one cell.
    """

    def done(pieces):
        whole = pa.Table.from_batches(pieces)
        at = [whole.column(k).to_numpy() for k in range(whole.num_columns - 1)]
        new = np.concatenate([[True], (at[0][1:] != at[0][:-1]) | (at[1][1:] != at[1][:-1]) | (at[2][1:] != at[2][:-1])])
        bounds = np.append(np.flatnonzero(new), len(new))
        found = [[] for _ in out]
        for low, high in zip(bounds, bounds[1:], strict=False):
            last = whole.column(whole.num_columns - 1).slice(low, high - low).to_pylist()
            for values, column in zip(meet(int(at[0][low]), int(at[1][low]), int(at[2][low]), *(c[low:high] for c in at[3:]), last), found, strict=True):
                column.append(np.asarray(values, np.int64))
        arrays = [pa.array(np.concatenate(c)) if c else pa.array([], pa.int64()) for c in found]
        return pa.RecordBatch.from_arrays(arrays, schema=out)

    def run(batches):
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = [batch.column(k).to_numpy() for k in range(3)]
            end = tuple(int(c[-1]) for c in cell)
            goes_on = int(np.argmax((cell[0] == end[0]) & (cell[1] == end[1]) & (cell[2] == end[2])))  # where its last cell begins
            if goes_on or end != last:
                if held or goes_on:
                    yield done([*held, batch.slice(0, goes_on)] if goes_on else held)
                held, last = [], end
            held.append(batch.slice(goes_on))
        if held:
            yield done(held)

    shuffles = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(shuffles, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, kind)


def candidates(rule: Rule, i, j, own, comp, n, bits):
    """For each member r of part i, those of part j in other components whose sizes and sketches allow a link, with the
    sketches' distances and the shingles that a link needs."""
    for r in np.flatnonzero(own == i):
        others = (own == j) & (comp != comp[r])
        if i == j:
            others[: r + 1] = False
        others = np.flatnonzero(others)
        total = n[others] + n[r]
        common = -(-rule.num * total // (rule.num + rule.den))  # Rule.least_common
        apart = np.bitwise_count(bits[others] ^ bits[r]).sum(1).astype(np.int64)
        near = (np.minimum(n[others], n[r]) >= common) & (apart <= total - 2 * common)
        if near.any():
            yield r, others[near], apart[near], common[near]


def across(members: DataFrame, sketches: DataFrame, rule: Rule = Rule(), parts: int = PART) -> DataFrame:
    """Of every cell, pairs that would join its components, and the members of candidate pairs that are left out.

    Rows (key, i, j, a, b, left): a pair (a, b) of different components whose sizes and sketches allow a link, or, where
    left is 1, a class a with other such pairs in this cell. Pairs of a cell form a forest over its components, nearest
    sketches first for each class, so a cell gives fewer rows than twice its members.
    """
    schema = pa.schema([("key", pa.int64()), ("i", pa.int64()), ("j", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("left", pa.int64())])

    def meet(key, i, j, cls, comp, own, n, raw):
        words = [np.frombuffer(x, np.uint64) for x in raw]
        width = min(map(len, words))
        bits = np.stack([fold(x, width) for x in words])
        root, pairs, more = np.unique(comp, return_inverse=True)[1], [], np.zeros(len(cls), bool)
        for r, others, apart, _ in candidates(rule, i, j, own, comp, n, bits):
            order = np.lexsort((cls[others], apart))
            new, first = np.unique(root[others[order]], return_index=True)
            chosen = others[order[first[new != root[r]]]]
            pairs += [(cls[r], cls[o]) for o in chosen]
            root[np.isin(root, new)] = root[r]
            rest = np.setdiff1d(others, chosen)
            more[rest] = True
            more[r] |= len(rest) > 0
        a, b = np.array(pairs, np.int64).reshape(-1, 2).T
        rest = cls[more]
        where = [np.full(len(a) + len(rest), x, np.int64) for x in (key, i, j)]
        yield from (*where, np.append(a, rest), np.append(b, np.zeros_like(rest)), np.append(np.zeros_like(a), np.ones_like(rest)))

    rows = in_cells(members, parts).join(sketches.select("cls", "n", "sketch"), "cls").select("key", "i", "j", "cls", "comp", "part", "n", "sketch")
    return by_cell(rows, meet, schema, f"{CELL}, a long, b long, left long")


def settle(cells: DataFrame, comps: DataFrame, table: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """Links (a, b) that join components within cells(key, i, j, cls, part), decided on the full sets.

    Cells whose members are of one component by now are left out, and of cells with the same members one stays. A task joins components as it finds links and skips
    pairs that are joined already: a cell gives fewer links than it has members.
    """
    rows = cells.join(comps.select(F.col("node").alias("cls"), "comp"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    member = F.xxhash64("cls", F.col("part") == F.col("i"), F.col("i") == F.col("j")).cast("decimal(20,0)")
    mixed = rows.groupBy("key", "i", "j").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.sum(member).alias("members")).where("low <> high")
    mixed = mixed.groupBy("members", "low", "high").agg(F.min(F.struct("key", "i", "j")).alias("cell")).select("cell.*")
    rows = rows.join(mixed, ["key", "i", "j"]).join(table.select("cls", "items"), "cls").select("key", "i", "j", "cls", "comp", "part", "items")

    def meet(key, i, j, cls, comp, own, raw):
        items = [np.frombuffer(x, np.uint64) for x in raw]
        n, words = np.array([len(x) for x in items]), [sketch(x) for x in items]
        width = min(map(len, words))
        bits = np.stack([fold(x, width) for x in words])
        root, pairs = np.unique(comp, return_inverse=True)[1], []
        for r, others, apart, common in candidates(rule, i, j, own, comp, n, bits):
            for o in np.argsort(apart, kind="stable"):
                if root[others[o]] != root[r] and len(np.intersect1d(items[r], items[others[o]], assume_unique=True)) >= common[o]:
                    pairs.append((cls[r], cls[others[o]]))
                    root[root == root[others[o]]] = root[r]
        yield from np.array(pairs, np.int64).reshape(-1, 2).T

    return by_cell(rows, meet, PAIRS, "a long, b long")


#: Parts that a component is cut into at least, once it has that many times LEAST_PART classes.
PARTS, LEAST_PART = 16, 64
#: Shingles in a part (8 bytes each), but that a set is never cut: long sets make more parts than their number asks for.
PART_ITEMS = 2_000_000


def inside(members: DataFrame, rule: Rule = Rule(), pairs: bool = False, least: int = LEAST_PART, most: int = PART, most_items: int = PART_ITEMS) -> DataFrame:
    """All links inside components: (a, b) of each, or cls and the number of rows it links to, summed over a cell.

    members(comp, cls, copies, n, items). A component of more than `least` classes is taken apart by size bands, as sets
    link within a band and the next alone. What is left is cut into parts of `least` to `most` classes and about
    `most_items` shingles, and each two parts that may link meet in one cell, so that two classes are compared once.
    """
    starts = F.array(*(F.lit(int(s)) for s in band_starts(rule)))
    rows = members.withColumn("band", F.size(F.filter(starts, lambda s: s <= F.col("n"))))
    sums = rows.groupBy("comp", "band").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    sums = sums.groupBy("comp").agg(F.sum("k").alias("k"), F.sum("n").alias("n"), F.collect_list(F.struct("band", "k", "n")).alias("bands"))
    size = F.least(F.greatest(F.ceil(F.col("k") / PARTS), F.lit(least)), F.lit(most))
    few = F.col("k") <= least
    parts_of = lambda k, n: F.greatest(F.ceil(k / size), F.ceil(n / most_items)).cast("int")
    by_band = F.transform("bands", lambda b: F.struct(b["band"].alias("band"), parts_of(b["k"], b["n"]).alias("parts")))
    whole = F.array(F.struct(F.lit(0).alias("band"), parts_of(F.col("k"), F.col("n")).alias("parts")))
    layout = sums.select("comp", few.alias("few"), F.map_from_entries(F.when(few, whole).otherwise(by_band)).alias("parts"))

    rows = rows.join(layout, "comp").withColumn("band", F.when(F.col("few"), 0).otherwise(F.col("band")))
    band = F.col("band")
    count = lambda b: F.coalesce(F.try_element_at("parts", b), F.lit(0))
    code = lambda b, s: F.shiftleft(b.cast("long"), 32) + s
    rows = rows.withColumn("sub", F.pmod(F.xxhash64("cls"), count(band)).cast("int")).withColumn("part", code(band, F.col("sub")))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    cell = lambda x, y: F.struct(F.least(x, y).alias("i"), F.greatest(x, y).alias("j"))
    meets = lambda b: F.transform(upto(count(b)), lambda s: cell(code(b, s), F.col("part")))
    rows = rows.withColumn("cell", F.explode(F.concat(meets(band - 1), meets(band), meets(band + 1))))

    def meet(key, i, j, cls, copies, own, raw):
        items = [np.frombuffer(x, np.uint64) for x in raw]
        n, words = np.array([len(x) for x in items]), [sketch(x) for x in items]
        width = min(map(len, words))
        bits = np.stack([fold(x, width) for x in words])
        universe, codes = np.unique(np.concatenate(items), return_inverse=True)
        codes, seen = np.split(codes, np.cumsum(n)[:-1]), np.zeros(len(universe), bool)
        found, links = [], np.zeros(len(cls), np.int64)
        for r, others, _, common in candidates(rule, i, j, own, np.arange(len(cls)), n, bits):
            seen[codes[r]] = True
            starts = np.cumsum(n[others]) - n[others]
            shared = np.add.reduceat(seen[np.concatenate([codes[o] for o in others])], starts, dtype=np.int64)
            seen[codes[r]] = False
            linked = others[shared >= common]
            links[r] += copies[linked].sum()
            links[linked] += copies[r]
            if pairs:
                found.append(np.stack([np.minimum(cls[r], cls[linked]), np.maximum(cls[r], cls[linked])]))
        yield from np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1) if pairs else (cls[links > 0], links[links > 0])

    rows = rows.select(F.col("comp").alias("key"), "cell.i", "cell.j", "cls", "copies", "part", "items")
    return by_cell(rows, meet, PAIRS, "a long, b long") if pairs else by_cell(rows, meet, DEGREES, "cls long, links long")


def linked_classes(docs: DataFrame, sets: DataFrame, rule: Rule = Rule(), keys_of=block_keys) -> tuple[DataFrame, DataFrame]:
    """node, comp of the classes that link to another class; the class table."""
    multi = materialize(shared_blocks(index(docs, rule, keys_of)), "parity-blocks")
    wanted = multi.select("cls").distinct()
    chosen = materialize(sets.join(wanted, "cls").groupBy("cls").agg(F.min("doc_id").alias("chosen_id")), "parity-chosen")
    table = materialize(class_table(docs, chosen, rule), "parity-classes")
    pairs = materialize(multi.where("cls <> leader").select(F.col("leader").alias("a"), F.col("cls").alias("b")).distinct(), "parity-pairs")
    links = materialize(verify(pairs, table, rule), "parity-links")
    comps = materialize(components(links), "parity-components")
    open_rows = materialize(open_members(multi, comps), "parity-open")
    discard(multi, chosen, pairs)
    found = materialize(across(open_rows, table, rule), "parity-across")
    joining = materialize(verify(found.where("left = 0").select("a", "b").distinct(), table, rule), "parity-joining")
    links = links.unionByName(joining)
    comps = materialize(components(links), "parity-components")
    rest = found.where("left = 1").select("key", "i", "j", F.col("a").alias("cls"))
    rest = rest.join(in_cells(open_rows).select("key", "i", "j", "cls", "part"), ["key", "i", "j", "cls"])
    more = materialize(settle(rest, comps, table, rule), "parity-more")
    if not more.isEmpty():
        comps = materialize(components(links.unionByName(more)), "parity-components")
    discard(open_rows, found)
    return comps, table


def grouped(docs: DataFrame, rule: Rule = Rule(), keys_of=block_keys) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The set table; per class of more than one document or with links, cls, comp, copies (its rows), low (its least
    doc_id) and the least doc_id of comp; the classes with links as members of their components, see inside."""
    sets = materialize(set_table(docs, rule), "parity-sets")
    comps, table = linked_classes(docs, sets, rule, keys_of)
    classes = sets.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies"))
    classes = classes.join(comps.withColumnRenamed("node", "cls"), "cls", "left").where("comp is not null or copies > 1")
    classes = classes.withColumn("comp", F.coalesce("comp", "cls"))
    lowest = classes.groupBy("comp").agg(F.min("low").alias("component_id"))
    groups = materialize(classes.select("cls", "comp", "copies", "low").join(lowest, "comp"), "parity-groups")
    members = groups.select("cls", "comp", "copies").join(comps.select(F.col("node").alias("cls")), "cls", "left_semi").join(table.select("cls", "n", "items"), "cls")
    return sets, groups, members


def join_documents(docs: DataFrame, rule: Rule = Rule(), keys_of=block_keys) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text).

    A null, empty or blank text has an empty set, links with nothing and is its own component. Rows that repeat a
    doc_id are rows of their own; a null doc_id takes part, and gives the component's id only where it has no other.
    Ties fall to the least doc_id. An empty table gives no rows; other columns are ignored.
    """
    sets, groups, _ = grouped(docs, rule, keys_of)
    groups = F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups
    found = sets.join(groups.select("cls", "component_id", F.lit(True).alias("known")), "cls", "left")
    return found.select(*_joined())


def _joined():
    return "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")


def count_links(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """As join_documents, with n_links: how many other rows a row links to.

    These are the other rows of its own class and all rows of each class that its class links to.
    """
    sets, groups, members = grouped(docs, rule)
    links = inside(members, rule).groupBy("cls").agg(F.sum("links").alias("links"))
    n_links = F.col("copies") - 1 + F.coalesce("links", F.lit(0).cast("long"))
    counted = materialize(groups.join(links, "cls", "left").select("cls", "component_id", n_links.alias("n_links"), F.lit(True).alias("known")), "parity-counted")
    counted = F.broadcast(counted) if groups.count() <= BROADCAST_ROWS else counted
    return sets.join(counted, "cls", "left").select(*_joined(), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def linked_pairs(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """a, b, doc_a, doc_b: every two classes that link, once (a < b), and the least doc_id of each.

    The rows of one class, whose sets are equal, link among each other as well and have no row here.
    """
    _, groups, members = grouped(docs, rule)
    side = lambda c: groups.select(F.col("cls").alias(c), F.col("low").alias(f"doc_{c}"))
    return inside(members, rule, pairs=True).join(side("a"), "a").join(side("b"), "b").select("a", "b", "doc_a", "doc_b")


def keep_one(docs: DataFrame, rule: Rule = Rule(), keys_of=block_keys) -> DataFrame:
    """The documents without near copies: of each component the row of least doc_id stays, with all its columns.

    Rows with an empty set all stay. Of rows that repeat the doc_id which stays, one stays.
    """
    sets, groups, _ = grouped(docs, rule, keys_of)
    best = sets.join(groups.select("cls", "comp"), "cls").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "cls")).alias("best"))
    few = groups.count() <= BROADCAST_ROWS
    taken = groups.select("cls", "comp").join(best, "comp").select(F.col("cls").alias("__cls"), F.col("best.cls").alias("__best_cls"), F.col("best.doc_id").alias("__best_id"))
    taken = materialize(taken, "parity-kept")

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            own = [class_of(s) if len(s) else None for s in shingles.text_sets(batch.column(at).to_pylist(), rule.words)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64())], names=[*batch.schema.names, "__own"])

    from pyspark.sql import types as T

    rows = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__own", T.LongType())]))
    rows = rows.join(F.broadcast(taken) if few else taken, F.col("__own") == F.col("__cls"), "left")
    alone = rows.where("__cls is null").select(*docs.columns)
    kept = rows.where("__cls is not null").where((F.col("__own") == F.col("__best_cls")) & F.col("doc_id").eqNullSafe(F.col("__best_id")))
    return alone.unionByName(kept.dropDuplicates(["__own"]).select(*docs.columns))
