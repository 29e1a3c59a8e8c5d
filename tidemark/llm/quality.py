"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. Its features are shares of character classes, word lengths, repetition and line length, each
cut into bins, together with the bins of the line before and after. The chain is trained in numpy on a bounded sample
of labelled documents, whose label all of their lines take. A document's quality is the mean of its lines'
forward-backward marginals for good, weighted by line length, mapped to a probability by a logistic curve that is
fitted on the same sample.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import vocab

#: Training sample: labelled documents at most, and characters of the longest among them.
SAMPLE_DOCS, SAMPLE_CHARS = 4_000, 20_000
THRESHOLD = 0.7
OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])
CLASS_NAMES = ("upper", "lower", "digit", "wide", "end", "comma", "bang", "pipe", "junk", "other")
BINS = 6
N_FEATURES = len(CLASS_NAMES) + 6


def _byte_classes() -> np.ndarray:
    table = np.full(256, CLASS_NAMES.index("other"), np.uint8)
    groups = {"end": b".?;:", "comma": b",'\"()-", "bang": b"!", "pipe": b"|", "junk": b"$%&#*@~^=+<>\\/_{}[]"}
    for b in range(256):
        if 65 <= b <= 90:
            table[b] = 0
        elif 97 <= b <= 122:
            table[b] = 1
        elif 48 <= b <= 57:
            table[b] = 2
        elif b >= 128:
            table[b] = 3
        elif b in (9, 11, 12, 13, 32):
            table[b] = 255  # white space, counted apart
    for name, members in groups.items():
        table[list(members)] = CLASS_NAMES.index(name)
    return table


CLASSES = _byte_classes()
BYTE_HASH = np.random.default_rng(5).integers(1, 1 << 62, 256, dtype=np.uint64)
#: Edges of the bins of each feature: shares, then mean word length, log line length, words, three repetition shares.
SHARE_EDGES = np.array([0.001, 0.02, 0.08, 0.2, 0.5])
EDGES = np.stack([SHARE_EDGES] * len(CLASS_NAMES) + [np.array([2.0, 3.5, 4.5, 5.5, 8.0]), np.array([1.5, 3.0, 4.0, 5.0, 6.0]), np.array([1.5, 3.5, 8.5, 20.5, 60.5])] + [np.array([0.01, 0.05, 0.15, 0.4, 0.8])] * 3)
SLOTS = N_FEATURES * BINS + 1  # the last: no such line


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[ends] - total[starts]


def line_bins(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bins (lines, features) as slot numbers, and length in bytes, of the non-blank lines of a text."""
    data = np.frombuffer(text.encode(), np.uint8)
    breaks = np.flatnonzero(data == 10)
    starts, ends = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(data)]])
    classes = CLASSES[data]
    classes[breaks] = 255
    solid = classes != 255
    filled = _sums(solid, starts, ends)
    some = filled > 0
    starts, ends, filled = starts[some], ends[some], filled[some]
    if not len(starts):
        return np.zeros((0, N_FEATURES), np.int32), np.zeros(0)
    columns = [_sums(classes == c, starts, ends) / filled for c in range(len(CLASS_NAMES))]
    begins = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
    stops = np.flatnonzero(solid & ~np.concatenate([solid[1:], [False]])) + 1
    place = np.cumsum(solid & ~np.concatenate([[False], solid[:-1]]), dtype=np.int64) - 1
    spread = BYTE_HASH[data] * (np.arange(len(data)) - begins[np.maximum(place, 0)] + 1).astype(np.uint64)
    running = np.concatenate([[np.uint64(0)], np.cumsum(np.where(solid, spread, np.uint64(0)), dtype=np.uint64)])
    words = running[stops] - running[begins]
    line_of = np.searchsorted(ends, begins, side="left")  # word -> line, blank lines have no words
    first, last = np.searchsorted(line_of, np.arange(len(starts))), np.searchsorted(line_of, np.arange(len(starts)), side="right")
    count = last - first
    columns += [filled / count, np.log(filled + 1), count.astype(float)]
    for gap in (1, 2):
        same = np.zeros(len(words))
        same[gap:] = (words[gap:] == words[:-gap]) & (line_of[gap:] == line_of[:-gap])
        columns.append(_sums(same, first, last) / count)
    _, first_seen, inverse = np.unique(words, return_index=True, return_inverse=True)
    repeated = first_seen[inverse] != np.arange(len(words))
    columns.append(_sums(repeated, first, last) / count)
    bins = np.stack([np.searchsorted(EDGES[k], c, side="right") + k * BINS for k, c in enumerate(columns)], axis=1)
    return bins.astype(np.int32), filled


def emissions(weights: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Score of good over bad for each line, from its own bins and those of its neighbours."""
    own, before, after = weights[:SLOTS], weights[SLOTS : 2 * SLOTS], weights[2 * SLOTS : 3 * SLOTS]
    score = own[bins].sum(1) + weights[3 * SLOTS]
    left = np.concatenate([[before[-1]], before[bins[:-1]].sum(1)]) if len(bins) else np.zeros(0)
    right = np.concatenate([after[bins[1:]].sum(1), [after[-1]]]) if len(bins) else np.zeros(0)
    return score + left + right


def chain(scores: np.ndarray, mask: np.ndarray, trans: np.ndarray):
    """Marginals of good (rows, steps), log partition and summed pair marginals for padded score sequences."""
    rows, steps = scores.shape
    e = np.stack([np.zeros_like(scores), scores], axis=2) * mask[:, :, None]
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[:, 0] = e[:, 0]
    for t in range(1, steps):
        a = np.logaddexp(alpha[:, t - 1, 0, None] + trans[0], alpha[:, t - 1, 1, None] + trans[1]) + e[:, t]
        alpha[:, t] = np.where(mask[:, t, None], a, alpha[:, t - 1])
    for t in range(steps - 2, -1, -1):
        later = e[:, t + 1] + beta[:, t + 1]
        b = np.logaddexp(later[:, 0, None] + trans[:, 0], later[:, 1, None] + trans[:, 1])
        beta[:, t] = np.where(mask[:, t + 1, None], b, 0)
    z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    good = 1 / (1 + np.exp(np.clip(alpha[..., 0] + beta[..., 0] - alpha[..., 1] - beta[..., 1], -500, 500)))
    pairs = np.zeros((2, 2))
    if steps > 1:
        p = alpha[:, :-1, :, None] + trans + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]
        pairs = (np.exp(np.minimum(p, 0)) * mask[:, 1:, None, None]).sum((0, 1))
    return good, z, pairs


def one_chain(scores: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Marginals of good for one document."""
    return chain(scores[None], np.ones((1, len(scores)), bool), trans)[0][0]


def _padded(groups: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, groups))
    out, mask = np.zeros((len(groups), steps)), np.zeros((len(groups), steps), bool)
    for r, g in enumerate(groups):
        out[r, : len(g)], mask[r, : len(g)] = g, True
    return out, mask


def fit(docs: list[tuple[np.ndarray, np.ndarray, int]], passes: int = 12, batch: int = 128, rate: float = 0.05, l2: float = 1e-4, seed: int = 3) -> dict:
    """Model from documents given as (bins, line lengths, label): weights, transitions and the final curve."""
    docs = sorted((d for d in docs if len(d[0])), key=lambda d: len(d[0]))
    w, trans = np.zeros(3 * SLOTS + 1), np.zeros((2, 2))
    if not docs:
        return {"w": w, "trans": trans, "curve": (0.0, 0.0)}
    labels = np.array([d[2] for d in docs])
    share = np.clip(labels.mean(), 0.02, 0.98)
    importance = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    rng, m, v, steps = np.random.default_rng(seed), np.zeros(len(w) + 4), np.zeros(len(w) + 4), 0
    batches = [range(i, min(len(docs), i + batch)) for i in range(0, len(docs), batch)]
    for _ in range(passes):
        for k in rng.permutation(len(batches)):
            rows = batches[k]
            scores, mask = _padded([emissions(w, docs[i][0]) for i in rows])
            good, _, pairs = chain(scores, mask, trans)
            weight = importance[rows.start : rows.stop]
            delta = (good - labels[rows.start : rows.stop, None]) * mask * weight[:, None]
            delta /= mask.sum(1, keepdims=True)  # a document counts the same whatever its lines
            grad = np.zeros(len(w))
            for r, i in enumerate(rows):
                bins, d = docs[i][0], delta[r, : len(docs[i][0])]
                np.add.at(grad, bins.ravel(), np.repeat(d, N_FEATURES))
                np.add.at(grad, SLOTS + bins[:-1].ravel(), np.repeat(d[1:], N_FEATURES))
                np.add.at(grad, 2 * SLOTS + bins[1:].ravel(), np.repeat(d[:-1], N_FEATURES))
                grad[2 * SLOTS - 1] += d[0]
                grad[3 * SLOTS - 1] += d[-1]
                grad[3 * SLOTS] += d.sum()
            gold = np.zeros((2, 2))
            for y in (0, 1):
                gold[y, y] = (mask.sum(1) - 1)[labels[rows.start : rows.stop] == y].sum()
            total = max(1.0, mask.sum() - len(rows))
            g = np.concatenate([grad / len(rows) + l2 * w, ((pairs - gold) / total + 0.05 * trans).ravel()])
            steps += 1
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g**2
            step = rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.99**steps)) + 1e-8)
            w, trans = w - step[:-4], np.clip(trans - step[-4:].reshape(2, 2), -3, 3)
    model = {"w": w, "trans": trans, "curve": (1.0, 0.0)}
    x = np.array([_logit(mean_marginal(model, b, n)) for b, n, _ in docs])
    a, c = 1.0, 0.0
    for _ in range(200):  # logistic curve over the mean marginals, by damped gradient steps
        p = 1 / (1 + np.exp(-np.clip(a * x + c, -50, 50)))
        ga, gc = ((p - labels) * x).mean() + 1e-3 * a, (p - labels).mean()
        h = np.maximum(p * (1 - p), 1e-4)
        a, c = a - 0.5 * ga / (h * x**2).mean(), c - 0.5 * gc / h.mean()
    model["curve"] = (max(float(a), 0.05), float(c))
    return model


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return float(np.log(p / (1 - p)))


def mean_marginal(model: dict, bins: np.ndarray, lengths: np.ndarray) -> float:
    if not len(bins):
        return 0.5
    return float(np.average(one_chain(emissions(model["w"], bins), model["trans"]), weights=lengths))


def score_text(model: dict, text: str) -> float:
    """Quality from 0 to 1; a text without any non-blank line has the score 0."""
    bins, lengths = line_bins(text)
    if not len(bins):
        return 0.0
    a, c = model["curve"]
    return float(1 / (1 + np.exp(-np.clip(a * _logit(mean_marginal(model, bins, lengths)) + c, -50, 50))))


def held_out():
    """Whether crc32 of doc_id as text leaves 2 when divided by 4; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> dict:
    """Fit on up to `sample` labelled documents that are not held out, of up to SAMPLE_CHARS characters each.

    The sample takes the smallest hashes of doc_id. A document labelled both ways takes the lower label. Only the
    sample's ids are broadcast and only its line bins reach the driver; both are bounded by the parameters.
    """
    marked = labels.where("doc_id is not null and quality is not null").where(~held_out())
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).where(F.char_length("text") <= SAMPLE_CHARS)
    rows = rows.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])

    def measure(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("bins", pa.binary()), ("lengths", pa.binary()), ("quality", pa.int32())])
        for batch in batches:
            out = []
            for doc, text, quality in vocab.rows_of(batch, "doc_id", "text", "quality"):
                bins, lengths = line_bins(text)
                out.append((doc, bins.astype("<i2").tobytes(), lengths.astype("<f4").tobytes(), quality))
            yield vocab.batch_of(schema, out)

    found = rows.select("doc_id", "text", "quality").mapInArrow(measure, "doc_id long, bins binary, lengths binary, quality int").orderBy("doc_id").collect()
    return fit([(np.frombuffer(r.bins, "<i2").astype(np.int32).reshape(-1, N_FEATURES), np.frombuffer(r.lengths, "<f4").astype(float), r.quality) for r in found])


def score(docs: DataFrame, labels: DataFrame | None = None, model: dict | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs(doc_id, text).

    A null, empty or blank text has the score 0. Null doc_ids and repeated rows stay as they are, equal texts get
    equal scores, and an empty table gives no rows. Only the text enters a score; other columns are ignored.
    """
    model = model or train(docs, labels)

    def run(batches):
        for batch in batches:
            scores = [score_text(model, t or "") for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            docs_ids = batch.column(batch.schema.get_field_index("doc_id"))
            yield pa.RecordBatch.from_arrays([docs_ids, pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], schema=OUT)

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame | None = None, model: dict | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns as they are, whose score reaches the threshold."""
    model = model or train(docs, labels)

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([score_text(model, t or "") >= threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
