"""Personal data by a character-level bidirectional LSTM with a CRF, beside stated patterns.

Patterns give the base spans. The tagger is trained in numpy from labelled spans: windows of a bounded sample of the
documents, labelled by their base spans, and windows of the same documents with invented personal data put in at known
places: also where a pattern fails because two kinds run into each other, and a fifth kind that has no pattern,
secrets (the value of a key, token or password).

Over a whole text, overlapping windows are scored and their scores blended, weighing each character by its distance from
the window's edge; the CRF then decides over the blended scores. A span found so is added where it touches no base span
and each of its characters has a marginal probability of CONFIDENCE or more. An exact check follows: the tagger learns
the shape of a card and of an address of four parts, but no check digit and no limit of 255, so that of these two kinds
only spans are added that hold by the rule.

Every character of every text is scored. A bound computed from all scores shows where no span can be likely; there the
best sequence is outside, and Viterbi and marginals are worked out only around the other places. With everywhere=False,
windows are laid only over stretches of CONTEXT characters on either side of a digit, an @, a = or a :, which is cheaper
and misses secrets of letters alone that no such sign announces. The queries read whole texts.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import vocab

KINDS = ("email", "ip", "card", "phone")
#: Kinds of the tagger, in the order of spans.
TAG_KINDS = (*KINDS, "secret")
TAGS = 1 + 2 * len(TAG_KINDS)  # outside; begin and inside of each kind
WINDOW, STRIDE, CONTEXT = 96, 48, 48
#: Least marginal probability of each character of an added span.
CONFIDENCE = 0.5
#: Where every span's odds are below this, the CRF need not be asked; it is from MARGIN characters before other places on.
UNLIKELY, MARGIN = 1e-2, 12
#: Characters that the CRF decides at a time, unless one piece is longer.
TOGETHER = 1 << 15
#: Training alone: documents in the sample and their longest text, windows of either sort, passes.
SAMPLE_DOCS, SAMPLE_CHARS, WINDOWS, PASSES = 400, 20_000, 1_800, 8
#: Windows of one sampled text that are labelled by patterns, so that a long text does not fill the sample.
TEXT_WINDOWS = 20
HIDDEN, EMBED = 16, 12
#: Rows before those of the gates in a step's product: the tags, and up to a multiple of four, which BLAS is made for.
LEAD = -(-TAGS // 4) * 4
OUT = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_secret", pa.int64()), ("n_spans", pa.int64())])
Span = tuple[str, int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Signs near which most spans are; and what is taken out of a text before invented data are put in.
HOT = re.compile(r"[0-9@=:]+")
SIGNS = re.compile(r"[0-9@=]+")
#: Runs that may be a secret: windows of the sample that hold one beside base spans are not used as labels.
OPAQUE = re.compile(r"[A-Za-z0-9+/_-]{12,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) << (i & 1)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def raw_matches(text: str):
    """(kind, start, end, whether it passes) of every match, in linear time.

    The same as leftmost non-overlapping matches of the four patterns: a match of the e-mail pattern begins where the
    run of its first class before an @ does, and each four parts of a dotted chain of numbers match the ip pattern.
    """
    at, low = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > low and text[begin - 1] in LOCAL:
            begin -= 1
        rest = DOMAIN.match(text, at + 1) if begin < at else None
        if rest:
            yield "email", begin, rest.end(), True
            low = rest.end()
        at = text.find("@", max(at + 1, low))
    for chain in CHAIN.finditer(text):
        if chain[0].count(".") >= 3:
            parts, start = chain[0].split("."), chain.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                end = start + sum(map(len, four)) + 3
                yield "ip", start, end, all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four)
                start = end + 1
    for m in CARD.finditer(text):
        d = _digits(m[0]) if m.end() - m.start() < 64 else ""
        yield "card", m.start(), m.end(), 16 <= len(d) <= 19 and luhn(d)
    for m in PHONE.finditer(text):
        yield "phone", m.start(), m.end(), 8 <= len(_digits(m[0])) <= 15


def base_spans(text: str) -> list[Span]:
    """Spans of the stated patterns by kind as listed, then start."""
    if not HOT.search(text):
        return []
    return [(k, a, b) for k, a, b, ok in raw_matches(text) if ok]


def holds(kind: str, part: str) -> bool:
    """Whether a span that the tagger found can be of its kind: of cards and addresses, by their rule."""
    if kind == "card":
        d = _digits(part)
        return 16 <= len(d) <= 19 and luhn(d)
    if kind == "ip":
        numbers = part.split(".")
        return len(numbers) == 4 and all(n.isascii() and n.isdigit() and int(n) <= 255 for n in numbers)
    return True


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _classes() -> np.ndarray:
    table = np.zeros(0x250, np.int64)  # 0: any other character
    for c in range(0x250):
        s = chr(c)
        table[c] = 1 if s in "0123456789" else 2 if s in "abcdef" else 3 if "g" <= s <= "z" else 4 if "A" <= s <= "Z" else 5 if s in "\n\r" else 6 if s.isspace() else 7 if s.isalpha() else 8 + PUNCTUATION.index(s) if s in PUNCTUATION else 0
    return table


CLASSES = _classes()
N_CLASSES = 8 + len(PUNCTUATION)


def char_ids(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return np.where(points < len(CLASSES), CLASSES[np.minimum(points, len(CLASSES) - 1)], 0)


def tags_of(spans: list[Span], length: int) -> np.ndarray:
    tags = np.zeros(length, np.int64)
    for kind, a, b in spans:
        k = 2 * TAG_KINDS.index(kind) + 1
        tags[a:b] = k + 1
        tags[a] = k
    return tags


def spans_of(tags: np.ndarray) -> list[Span]:
    found, start, kind = [], None, 0
    for i, t in enumerate([*tags.tolist(), 0]):
        if start is not None and t != kind + 1:
            found.append((TAG_KINDS[kind // 2], start, i))
            start = None
        if t % 2:
            start, kind = i, t
    return found


def forbidden() -> np.ndarray:
    """Where the inside of a kind cannot follow a tag; the last row is for the start of a stretch."""
    out = np.zeros((TAGS + 1, TAGS))
    for k in range(1, TAGS, 2):
        out[:, k + 1] = -1e4
        out[k, k + 1] = out[k + 1, k + 1] = 0
    return out


def initial(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = {"E": rng.normal(0, 0.3, (N_CLASSES, EMBED)), "W": rng.normal(0, 0.2, (2 * HIDDEN, TAGS)), "c": np.zeros(TAGS), "T": np.zeros((TAGS + 1, TAGS))}
    for d in "fb":
        w[f"X{d}"] = rng.normal(0, EMBED**-0.5, (EMBED, 4 * HIDDEN))
        w[f"H{d}"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
        w[f"g{d}"] = np.zeros(4 * HIDDEN)
        w[f"g{d}"][HIDDEN : 2 * HIDDEN] = 1
    return w


#: Slope of the gates' hard sigmoid, min(1, max(0, SLOPE * x + 0.5)); the hyperbolic tangent is cut at -1 and 1 likewise.
#: Both cost a fifth of the smooth functions, which is what lets whole texts be read.
SLOPE = 0.2


def _lstm(x: np.ndarray, wx, wh, bias, keep: bool):
    """Hidden states over (steps, rows, features); with `keep`, what the way back needs as well."""
    steps, rows, _ = x.shape
    h, c = np.zeros((rows, HIDDEN), x.dtype), np.zeros((rows, HIDDEN), x.dtype)
    out, held = np.empty((steps, rows, HIDDEN), x.dtype), []
    inputs = x @ wx + bias
    for t in range(steps):
        z = inputs[t] + h @ wh
        gates = np.clip(SLOPE * z[:, : 3 * HIDDEN] + 0.5, 0, 1)
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.clip(z[:, 3 * HIDDEN :], -1, 1)
        before, c = c, f * c + i * g
        tc = np.clip(c, -1, 1)
        if keep:
            held.append((h, before, i, f, o, g, tc))
        h = o * tc
        out[t] = h
    return out, held


def _lstm_back(x, wx, wh, held, dout):
    dwx, dwh, db = np.zeros_like(wx), np.zeros_like(wh), np.zeros(4 * HIDDEN)
    dx = np.empty_like(x)
    dh = dc = np.zeros(dout.shape[1:], x.dtype)
    for t in range(len(held) - 1, -1, -1):
        h, before, i, f, o, g, tc = held[t]
        dh = dh + dout[t]
        dc = dc + dh * o * (np.abs(tc) < 1)
        open_ = lambda gate: SLOPE * ((gate > 0) & (gate < 1))
        dz = np.concatenate([dc * g * open_(i), dc * before * open_(f), dh * tc * open_(o), dc * i * (np.abs(g) < 1)], axis=1).astype(x.dtype)
        dwx += x[t].T @ dz
        dwh += h.T @ dz
        db += dz.sum(0)
        dx[t] = dz @ wx.T
        dh, dc = dz @ wh.T, dc * f
    return dx, dwx, dwh, db


def emissions(w: dict, ids: np.ndarray, keep: bool = False):
    """Scores (steps, rows, tags) of windows given as class ids (rows, steps)."""
    x = w["E"][ids.T]
    forward, held_f = _lstm(x, w["Xf"], w["Hf"], w["gf"], keep)
    backward, held_b = _lstm(x[::-1], w["Xb"], w["Hb"], w["gb"], keep)
    both = np.concatenate([forward, backward[::-1]], axis=2)
    scores = both @ w["W"] + w["c"]
    return (scores, (x, both, held_f, held_b)) if keep else scores


class WindowScores:
    """Scores of up to `rows` windows at a time: those of emissions, with rows last, in arrays that are used again.

    A step is one product: of the state (hidden, embedding and 1) with the rows of the gates and, before them, those of
    the tags, which so come for the step before. All else runs over whole rows in place, and one direction at a time,
    so that what a step touches stays in the cache.
    """

    def __init__(self, w: dict, rows: int):
        scale = np.repeat(np.array([SLOPE, 1]), (3 * HIDDEN, HIDDEN))[:, None]
        shift = np.repeat(np.array([0.5, 0]), (3 * HIDDEN, HIDDEN))[:, None]
        order = np.r_[2 * HIDDEN : 3 * HIDDEN, : 2 * HIDDEN, 3 * HIDDEN : 4 * HIDDEN]  # output, input, forget, new

        def product(d, last, added):
            tags = np.zeros((LEAD, HIDDEN + EMBED + 1))
            tags[:TAGS, :HIDDEN], tags[:TAGS, -1] = last.T, added
            gates = np.concatenate([scale * w[f"H{d}"].T, scale * w[f"X{d}"].T, scale * w[f"g{d}"][:, None] + shift], axis=1)
            return np.concatenate([tags, gates[order]]).astype(np.float32)

        self.mix = product("f", w["W"][:HIDDEN], w["c"]), product("b", w["W"][HIDDEN:], 0)
        self.embedding, self.rows = np.ascontiguousarray(w["E"].T, np.float32), rows
        self.room = [np.empty(k * rows, np.float32) for k in (HIDDEN + EMBED + 1, LEAD + 5 * HIDDEN)]

    def add(self, inputs: list, out: list):
        """To each (scores, weights) of `out`, in turn, the weighed scores of the step whose embeddings `inputs` holds."""
        for mix, way in zip(self.mix, (1, -1), strict=True):
            self._add(mix, inputs[::way], out[::way])

    def _add(self, mix, inputs, out):
        n, none, one = inputs[0].shape[1], np.float32(0), np.float32(1)
        state, held = (a[: len(a) // self.rows * n].reshape(-1, n) for a in self.room)
        h, x, z, tags, gates = state[:HIDDEN], state[HIDDEN:-1], held[:-HIDDEN], held[:TAGS], held[LEAD : LEAD + 3 * HIDDEN]
        o, i, f, g, c = held[LEAD:].reshape(5, HIDDEN, n)
        both, others = held[LEAD + HIDDEN : LEAD + 3 * HIDDEN], held[LEAD + 3 * HIDDEN :]  # input and forget, new and cell
        h[:], c[:], state[-1] = 0, 0, 1
        for t, step in enumerate(inputs):
            x[:] = step
            np.matmul(mix, state, out=z)
            if t:
                scores, weights = out[t - 1]
                np.multiply(tags, weights, out=tags)
                np.add(scores, tags, out=scores)
            gates.clip(none, one, gates)
            g.clip(-one, one, g)
            np.multiply(both, others, out=both)
            np.add(i, f, out=c)
            c.clip(-one, one, g)
            np.multiply(o, g, out=h)
        scores, weights = out[-1]
        scores += (mix[:LEAD] @ state)[:TAGS] * weights

    def of(self, *parts: np.ndarray) -> np.ndarray:
        """(WINDOW, tags, rows) for windows given by the embeddings (EMBED, steps, rows) of their parts."""
        out = np.zeros((WINDOW, TAGS, parts[0].shape[2]), np.float32)
        self.add([step for part in parts for step in part.transpose(1, 0, 2)], [(scores, np.float32(1)) for scores in out])
        return out


def _logsumexp(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis))


def loss_and_gradient(w: dict, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
    """Mean negative log-likelihood of whole tag sequences and its gradient, by forward-backward over the chain."""
    rows, steps = ids.shape
    e, (x, both, held_f, held_b) = emissions(w, ids, True)
    trans = w["T"] + forbidden().astype(w["T"].dtype)
    inner = trans[:TAGS]
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = trans[TAGS] + e[0]
    for t in range(1, steps):
        alpha[t] = _logsumexp(alpha[t - 1][:, :, None] + inner, 1) + e[t]
    for t in range(steps - 2, -1, -1):
        beta[t] = _logsumexp(inner + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    z = _logsumexp(alpha[-1], 1)
    r = np.arange(rows)
    gold = trans[TAGS, tags[:, 0]] + sum(e[t, r, tags[:, t]] for t in range(steps)) + sum(inner[tags[:, t - 1], tags[:, t]] for t in range(1, steps))
    de = np.exp(alpha + beta - z[:, None])
    dt = np.zeros_like(trans)
    dt[TAGS] = de[0].sum(0)
    np.subtract.at(dt, (np.full(rows, TAGS), tags[:, 0]), 1)
    for t in range(1, steps):
        pair = alpha[t - 1][:, :, None] + inner + (e[t] + beta[t])[:, None, :] - z[:, None, None]
        dt[:TAGS] += np.exp(pair).sum(0)
        np.subtract.at(dt, (tags[:, t - 1], tags[:, t]), 1)
    for t in range(steps):
        de[t, r, tags[:, t]] -= 1
    de /= rows
    flat = both.reshape(-1, 2 * HIDDEN)
    grad = {"W": flat.T @ de.reshape(-1, TAGS), "c": de.sum((0, 1)), "T": np.where(forbidden() < 0, 0, dt / rows)}
    dboth = de @ w["W"].T
    dx, grad["Xf"], grad["Hf"], grad["gf"] = _lstm_back(x, w["Xf"], w["Hf"], held_f, dboth[:, :, :HIDDEN])
    dxb, grad["Xb"], grad["Hb"], grad["gb"] = _lstm_back(x[::-1], w["Xb"], w["Hb"], held_b, dboth[::-1, :, HIDDEN:])
    grad["E"] = np.zeros_like(w["E"])
    np.add.at(grad["E"], ids.T, dx + dxb[::-1])
    return float((z - gold).mean()), grad


def invented(rng: random.Random) -> list[tuple[str | None, str]]:
    """Pieces of made-up text, each with its kind or None: personal data, alone or in a row, and digits that are none."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))

    def one(kind):
        if kind == "email":
            return rng.choice([f"{name()}.{d(2)}@mail{d(1)}.example.com", f"{name()}@{name()}.org", f"{name()}_{name()}@{name()}.co.uk"])
        if kind == "ip":
            return ".".join(str(rng.randint(0, 255)) for _ in range(4))
        if kind == "card":
            gap = rng.choice(["", "", "", " ", "-"])
            digits = d(15 if rng.random() < 0.8 else rng.randint(16, 18))
            digits += next(c for c in "0123456789" if luhn(digits + c))
            return gap.join(digits[i : i + 4] for i in range(0, 16, 4)) if len(digits) == 16 else digits
        if kind == "secret":
            letters = rng.choice(["0123456789abcdef", "0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"])
            return "".join(rng.choice(letters) for _ in range(rng.choice([40, 40, rng.randint(12, 64)])))
        return rng.choice([f"+1 ({d(3)}) 555-{d(4)}", f"+{d(2)} {d(3)} {d(7)}", f"+{d(1)}-{d(3)}-{d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}"])

    def told(kind):
        """The piece; a secret with the name of what it opens before it."""
        if kind != "secret":
            return [(kind, one(kind))]
        key = rng.choice(["token", "token", "key", "api_key", "secret", "password", "access_token", "auth"])
        quote, given = rng.choice(['"', '"', "'", ""]), rng.choice([" = ", " = ", "=", ": ", ":", " ", " is "])
        return [(None, (key.upper() if rng.random() < 0.2 else key) + given + quote), (kind, one(kind)), (None, quote)]

    other = rng.choice([d(rng.randint(1, 6)), f"{d(1)}.{d(1)}", f"version {d(1)}.{d(1)}.{d(2)}", f"{d(4)}-{d(2)}-{d(2)}", "".join(rng.choice("0123456789abcdef") for _ in range(20)), d(rng.randint(8, 12)), d(rng.randint(21, 30)), f"{d(2)}:{d(2)}", f"{name()} = {d(2)}", f'{name()}="{name()}"', f"{name()} @{name()}"])
    shape = rng.random()
    if shape < 0.25:
        return [(None, other)]
    pieces = [told(k) for k in rng.sample(TAG_KINDS, 1 if shape < 0.6 else 2)]
    if shape > 0.85:
        pieces.insert(rng.randint(0, 1), [(None, d(rng.randint(1, 4)))])
    return [x for p in pieces for x in ((None, " "), *p)][1:]


def training_windows(texts: list[str], seed: int = 7, limit: int = WINDOWS) -> tuple[np.ndarray, np.ndarray]:
    """Class ids and tags of up to `limit` windows labelled by patterns, near signs and elsewhere by turns, and as many with invented data."""
    rng, ids, tags = random.Random(seed), [], []

    def put(text, spans):
        ids.append(char_ids(text))
        tags.append(tags_of(spans, WINDOW))

    for text in texts:
        if len(ids) >= limit:
            break
        if len(text) < WINDOW:
            continue
        found = list(raw_matches(text))
        near = [m.start() for m in HOT.finditer(text)][:TEXT_WINDOWS]
        for hot in [p for h in near for p in (h, rng.randrange(len(text)))]:
            a = max(0, min(len(text) - WINDOW, hot - rng.randint(10, WINDOW - 10)))
            touched = [(k, s, e, ok) for k, s, e, ok in found if s < a + WINDOW and e > a]
            doubtful = any(not ok and k in ("card", "phone") and len(_digits(text[s:e])) > 12 for k, s, e, ok in touched)
            covered = [(s, e) for _, s, e, ok in touched if ok]
            doubtful |= any(re.search("[0-9]", m[0]) and not any(s < m.end() and m.start() < e for s, e in covered) for m in OPAQUE.finditer(text, max(0, a - 64), a + WINDOW))
            if not doubtful and all(s >= a and e <= a + WINDOW for _, s, e, ok in touched if ok):
                put(text[a : a + WINDOW], [(k, s - a, e - a) for k, s, e, ok in touched if ok])
    texts = [t for t in texts if len(t) >= WINDOW] or ["lorem ipsum dolor sit amet " * 8]
    for _ in range(limit):
        text = rng.choice(texts)
        a = rng.randint(0, len(text) - WINDOW)
        plain = SIGNS.sub("", text[a : a + WINDOW])
        cut = rng.randint(0, len(plain))
        gap, out, spans = rng.choice([" ", " ", " ", "\n", ""]), plain[:cut], []
        out += gap
        for kind, piece in invented(rng):
            if kind:
                spans.append((kind, len(out), len(out) + len(piece)))
            out += piece
        out += rng.choice([" ", " ", "\n", ". ", "%%%"]) + plain[cut:]
        a = max(0, min(len(out) - WINDOW, cut - rng.randint(0, 40)))
        spans = [(k, s - a, e - a) for k, s, e in spans]
        if len(out) - a >= WINDOW and all(s >= 0 and e <= WINDOW for _, s, e in spans):
            put(out[a : a + WINDOW], spans)
    return np.stack(ids), np.stack(tags)


def train(texts: list[str], passes: int = PASSES, batch: int = 64, rate: float = 0.015, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights after Adam over the windows of a bounded sample of texts."""
    ids, tags = training_windows(texts, seed)
    w, rng = {k: x.astype(np.float32) for k, x in initial(seed).items()}, np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in w.items()}
    v = {k: np.zeros_like(x) for k, x in w.items()}
    steps, total = 0, passes * -(-len(ids) // batch)
    for _ in range(passes):
        order = rng.permutation(len(ids))
        for i in range(0, len(ids), batch):
            pick = order[i : i + batch]
            _, grad = loss_and_gradient(w, ids[pick], tags[pick])
            norm = np.sqrt(sum((g**2).sum() for g in grad.values()))
            steps += 1
            lr = rate * (1 - 0.9 * steps / total)
            for k, g in grad.items():
                g = g * min(1, 5 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g**2
                w[k] = (w[k] - lr * (m[k] / (1 - 0.9**steps)) / (np.sqrt(v[k] / (1 - 0.999**steps)) + 1e-8)).astype(np.float32)
    return w


def viterbi(w: dict, scores: np.ndarray) -> np.ndarray:
    """Best tags (rows, steps) for scores (steps, rows, tags)."""
    trans = (w["T"] + forbidden()).astype(np.float32)
    best, back = trans[TAGS] + scores[0], np.empty(scores.shape, np.int8)
    for t in range(1, len(scores)):
        paths = best[:, :, None] + trans[:TAGS]
        back[t] = paths.argmax(1)
        best = paths.max(1) + scores[t]
    tags = np.empty(scores.shape[1::-1], np.int64)
    tags[:, -1] = best.argmax(1)
    rows = np.arange(len(tags))
    for t in range(len(scores) - 1, 0, -1):
        tags[:, t - 1] = back[t, rows, tags[:, t]]
    return tags


def marginals(w: dict, scores: np.ndarray) -> np.ndarray:
    """Probability of every tag (steps, rows, tags) over all sequences, forward and backward, scaled at each step."""
    trans = np.exp(w["T"] + forbidden())
    local = np.exp(scores - scores.max(2, keepdims=True)).astype(np.float64)
    ahead, back = np.empty_like(local), np.empty_like(local)
    ahead[0] = trans[TAGS] * local[0]
    ahead[0] /= ahead[0].sum(1, keepdims=True)
    for t in range(1, len(local)):
        ahead[t] = (ahead[t - 1] @ trans[:TAGS]) * local[t]
        ahead[t] /= ahead[t].sum(1, keepdims=True)
    back[-1] = 1
    for t in range(len(local) - 2, -1, -1):
        back[t] = (back[t + 1] * local[t + 1]) @ trans[:TAGS].T
        back[t] /= back[t].sum(1, keepdims=True)
    both = ahead * back
    return both / both.sum(2, keepdims=True)


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of a text within CONTEXT characters of a digit, an @, a = or a :, each widened to a window at least."""
    out: list[list[int]] = []
    for m in HOT.finditer(text):
        a, b = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
        b = min(len(text), max(b, a + WINDOW))
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def blended(scorer: WindowScores, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Blended scores (STRIDE, tags, blocks) of texts laid out in blocks of STRIDE characters, and each text's first block.

    A window covers two blocks in a row. A character's scores are the mean of those of its one or two windows, weighed
    by its distance from their edges; windows over blocks of two texts weigh nothing.
    """
    blocks = [1 + max(1, -(-(len(p) - STRIDE) // STRIDE)) for p in parts]
    first = np.cumsum([0, *blocks])
    ids = np.full(first[-1] * STRIDE, 5)
    for at, part in zip(first * STRIDE, parts):  # noqa: B905
        ids[at : at + len(part)] = char_ids(part)
    ids = np.ascontiguousarray(ids.reshape(-1, STRIDE).T)
    opening = np.repeat(np.arange(1, STRIDE + 1, dtype=np.float32)[:, None], first[-1], axis=1)
    closing = STRIDE + 1 - opening
    opening[:, first[1:] - 1] = closing[:, first[:-1]] = 0
    total = opening + closing
    opening, closing = opening / total, closing / total
    x = np.take(scorer.embedding, ids, axis=1).transpose(1, 0, 2)
    scores = np.zeros((STRIDE, TAGS, first[-1]), np.float32)
    for i in range(0, first[-1] - 1, scorer.rows):
        j = min(first[-1] - 1, i + scorer.rows)
        opened, closed = (zip(scores[:, :, a:b], w[:, a:b], strict=True) for a, b, w in ((i, j, opening), (i + 1, j + 1, closing)))
        scorer.add([*x[:, :, i:j], *x[:, :, i + 1 : j + 1]], [*opened, *closed])
    return scores, first


def likeliest_spans(w: dict, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each character in the layout of `blended`, a bound on the log odds of any one span that holds it.

    Whatever tags stand around a span, putting outside in its place changes the likelihood by its scores and transitions
    alone. So the odds of a span from a to b are at most a term of a, a sum over a to b and a constant of its kind, and
    the largest over all a and b around a place comes from running sums and their running extremes.
    """
    trans, begins = w["T"].astype(np.float64) + forbidden(), range(1, TAGS, 2)
    edges = [(trans[:, k] - trans[:, 0]).max() + max(0, *((trans[k : k + 2, m] - trans[0, m]).max() for m in (0, *begins))) for k in begins]
    inner = [trans[k : k + 2, k + 1].max() - trans[0, 0] for k in begins]
    edges, inner = (np.array(a, scores.dtype)[:, None] for a in (edges, inner))
    # Of spans within a block: the most up to and with a place, and the most that goes on after it.
    most, run = scores[:, begins] - scores[:, :1], scores[:, 2::2] - scores[:, :1]
    run += inner
    total, after = run.copy(), np.zeros_like(run)
    for t in range(1, STRIDE):
        total[t] += total[t - 1]
        np.maximum(most[t], most[t - 1] + run[t], out=most[t])
    for t in range(STRIDE - 2, -1, -1):
        np.maximum(after[t + 1] + run[t + 1], 0, out=after[t])
    # Of those that come from earlier blocks or reach later ones, by running sums of whole blocks.
    whole = total[-1].astype(np.float64)
    whole[:, first[:-1]] -= 1e4  # no span goes on into the next text
    ends = np.cumsum(whole, axis=1)
    starts = ends - total[-1]
    come = np.maximum.accumulate(most[-1] - ends, axis=1)[:, :-1] + starts[:, 1:]
    reach = np.maximum.accumulate((starts + total.max(0))[:, :0:-1], axis=1)[:, ::-1] - ends[:, :-1]
    np.maximum(most[:, :, 1:], total[:, :, 1:] + come.astype(scores.dtype), out=most[:, :, 1:])
    np.maximum(after[:, :, :-1], total[-1, :, :-1] + reach.astype(scores.dtype) - total[:, :, :-1], out=after[:, :, :-1])
    most += after
    most += edges
    return most.max(1).T.ravel()


def joined_places(places: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Parts of a text within MARGIN characters of a place; those that touch are one."""
    if not len(places):
        return []
    cuts = np.flatnonzero(np.diff(places) > 2 * MARGIN + 1)
    starts, ends = places[[0, *(cuts + 1)]], places[[*cuts, -1]]
    return [(max(0, a - MARGIN), min(length, b + 1 + MARGIN)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def tag_texts(w: dict, texts: list[str], rows: int = 768, everywhere: bool = True) -> list[list[Span]]:
    """Spans that the tagger is sure of and that hold, for each text: everywhere in it, or in its stretches alone.

    All characters are scored. The CRF then decides around the places where some span's odds may reach UNLIKELY. Between
    them the best sequence is outside, by a bound that holds for every span, so that it is the same as over the whole. About 4 * `rows` windows are in memory at a time, besides
    one text.
    """
    found: list[list[Span]] = [[] for _ in texts]
    scorer = WindowScores(w, rows)
    pending: list[tuple[int, int, str]] = []
    pieces: list[tuple[bool, int, int, str, np.ndarray]] = []

    def flush():
        scores, first = blended(scorer, [part for _, _, part in pending])
        unsure = np.flatnonzero(likeliest_spans(w, scores, first) >= np.log(UNLIKELY))
        bounds = np.searchsorted(unsure, [first[:-1] * STRIDE, first[:-1] * STRIDE + [len(part) for _, _, part in pending]])
        for (doc, offset, part), at, end, low, high in zip(pending, first[:-1], first[1:], *bounds, strict=True):
            near = joined_places(unsure[low:high] - at * STRIDE, len(part))
            own = scores[:, :, at:end].transpose(2, 0, 1).reshape(-1, TAGS) if near else None
            for a, b in near:
                inside = own[a:b].copy()
                if a > 0:
                    inside[0, 1:] = -1e4
                if b < len(part):
                    inside[-1, 1:] = -1e4
                pieces.append((b == len(part), doc, offset + a, part[a:b], inside))
        pending.clear()

    def decide():
        """The best tags of all pieces, of like length together.

        Those that end within their text may be filled up with outside; those at its end go with others as long.
        """
        pieces.sort(key=lambda p: (p[0], len(p[3])))
        i = 0
        while i < len(pieces):
            n, longest = 1, len(pieces[i][3])
            while i + n < len(pieces):
                at_end, _, _, part, _ = pieces[i + n]
                if (n + 1) * len(part) > TOGETHER or at_end and (not pieces[i][0] or len(part) != longest):
                    break
                n, longest = n + 1, len(part)
            some, i = pieces[i : i + n], i + n
            scores = np.full((longest, len(some), TAGS), 0, np.float32)
            for r, (_, _, _, part, inside) in enumerate(some):
                scores[: len(part), r] = inside
                scores[len(part) :, r, 1:] = -1e4  # nothing after the end
            best = viterbi(w, scores)
            sure = np.take_along_axis(marginals(w, scores), best.T[:, :, None], 2)[:, :, 0] >= CONFIDENCE
            for r in np.flatnonzero(best.any(1)):
                _, doc, offset, part, _ = some[r]
                found[doc] += [(k, offset + a, offset + b) for k, a, b in spans_of(best[r, : len(part)]) if sure[a:b, r].all() and holds(k, part[a:b])]
        pieces.clear()

    held = 0
    for doc, text in enumerate(texts):
        for a, b in [(0, len(text))] * bool(text) if everywhere else stretches(text):
            pending.append((doc, a, text[a:b]))
            held += 2 + (b - a) // STRIDE
            if held >= rows * 4:
                flush()
                held = 0
                if sum(len(p[3]) for p in pieces) >= 2 * TOGETHER:
                    decide()
    if pending:
        flush()
    decide()
    return [sorted(spans, key=lambda s: s[1]) for spans in found]


def tag_equal_once(w: dict, texts: list[str], everywhere: bool = True) -> list[list[Span]]:
    """What tag_texts finds, each of equal texts tagged once."""
    different = list(dict.fromkeys(texts))
    found = dict(zip(different, tag_texts(w, different, everywhere=everywhere), strict=True))
    return [found[t] for t in texts]


def all_spans(base: list[Span], tagged: list[Span]) -> list[Span]:
    """Base spans, and tagged ones that touch none of them, by kind as listed, then start."""
    taken = sorted((a, b) for _, a, b in base)
    starts = np.array([a for a, _ in taken])
    ends = np.maximum.accumulate([b for _, b in taken]) if taken else np.array([])
    added = []
    for kind, a, b in tagged:
        i = int(np.searchsorted(starts, b))  # base spans that begin before b
        if i == 0 or ends[i - 1] <= a:
            added.append((kind, a, b))
    return sorted([*base, *added], key=lambda s: (TAG_KINDS.index(s[0]), s[1]))


def sample_texts(docs: DataFrame, n: int = SAMPLE_DOCS) -> list[str]:
    """Up to n different texts of at most SAMPLE_CHARS characters that hold a digit or an @: those of least hash, for training.

    Hashes alone are compared over all documents; only the chosen texts reach the driver.
    """
    text = F.col("text").cast("string")
    rows = docs.select(text.alias("text"), F.xxhash64(text).alias("h"))
    fits = (F.char_length("text") <= SAMPLE_CHARS) & F.col("text").rlike("[0-9@]")
    least = [r.h for r in rows.where(fits).select("h").distinct().orderBy("h").limit(n).collect()]
    chosen = rows.where(F.col("h").isin(least)).where(fits).groupBy("h").agg(F.min("text").alias("text"))
    return [r.text for r in chosen.orderBy("h").collect()]


def detect(docs: DataFrame, weights: dict | None = None, everywhere: bool = True) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_spans for every row of docs(doc_id, text).

    The first counts and the digest are of the base spans; spans lists all, n_spans counts them, and n_secret those of
    the kind that has no pattern. A null text counts as empty: no spans, the digest of no
    bytes. Null doc_ids and repeated rows stay as they are; an empty table gives no rows. Other columns are ignored.
    Without weights, the tagger is trained on a bounded sample of the documents. everywhere=False: tag only the
    stretches near a digit, an @, a = or a :.
    """
    w = weights or train(sample_texts(docs))

    def run(batches):
        for batch in batches:
            rows = [(d, t or "") for d, t in vocab.rows_of(batch, "doc_id", "text")]
            out = []
            for (doc, text), tagged in zip(rows, tag_equal_once(w, [t for _, t in rows], everywhere), strict=True):
                base = base_spans(text)
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                spans = all_spans(base, tagged)
                out.append((doc, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), sum(k == "secret" for k, _, _ in spans), len(spans)))
            yield vocab.batch_of(OUT, out)

    kind = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, n_spans long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, kind)


def redact_text(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by <KIND>; of overlapping spans the first, longest one names the kind."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, weights: dict | None = None) -> DataFrame:
    """The documents with personal data replaced in text, and n_chars counted anew where there is such a column.

    A null text stays null. All other columns stay as they are, in their order.
    """
    w = weights or train(sample_texts(docs))
    names = docs.columns

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            tagged = tag_equal_once(w, [t or "" for t in texts])
            clean = [None if t is None else redact_text(t, all_spans(base_spans(t), s)) for t, s in zip(texts, tagged, strict=True)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out
