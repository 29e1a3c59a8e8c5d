"""Ordered folds: operators whose next step depends on decisions taken before.

Each rule is a small function from the ordered values of one group (a medium, a sentence) to group numbers or rows;
`fold` runs it over groups that Spark has dealt out and sorted, so a group is what has to fit into a task. Groups are
media or sentences of at most some ten thousand words.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.functions.predicates import VERBS

Names = list[str]

# Words that sentences are cut before, words that none should end with, phrases that stay whole.
BREAK_WORDS = (
    "and", "but", "or", "so", "that", "which", "what", "who", "when", "where", "why", "how", "whose", "whom",
    "because", "since", "if", "unless", "although", "though", "while", "whereas", "before", "after", "until",
    "whenever", "however", "therefore", "moreover", "furthermore", "meanwhile", "besides", "nonetheless",
)
BAD_ENDS = (
    "a", "an", "the", "of", "in", "on", "at", "to", "for", "with", "by", "from", "about", "and", "but", "or", "is",
    "am", "are", "was", "were", "have", "has", "had", "will", "would", "could", "should", "my", "your", "his",
    "her", "its", "our", "their", "this", "that", "these", "those", "up", "down", "out", "off", "away", "back",
    "into", "onto", "upon", "within", "without", "through", "across", "under", "over", "before", "after", "during",
    "since", "until", "can", "may", "might", "must", "shall", "not", "never", "always", "often", "sometimes",
    "very", "quite", "really", "just", "only", "more", "most", "less", "least", "much", "too", "so", "such", "even",
    "still",
)
LOOSE_ENDS = frozenset(BAD_ENDS)
PHRASES = (
    "fall apart", "break down", "give up", "take off", "put on", "turn off", "turn on", "look up", "look down",
    "come back", "go away", "walk away", "run away", "get up", "sit down", "stand up", "wake up", "grow up",
    "pick up", "drop off", "find out", "figure out", "work out", "sort out", "carry on", "move on", "hold on",
    "hang on", "right now", "right away", "right here", "right there", "all over", "all around", "all along",
    "all together", "once again", "over again", "time after time", "day after day", "year after year", "for good",
    "for sure", "for real", "for now", "at all", "at once", "at last", "at first", "in fact", "in general",
    "in particular", "in short", "on purpose", "on time", "by chance", "by accident", "lose touch", "get lost",
    "make sense", "take care",
)
#: The phrases as lists of words, by their first one.
SPLIT_PHRASES: dict[str, list[list[str]]] = {}
for _p in map(str.split, PHRASES):
    SPLIT_PHRASES.setdefault(_p[0], []).append(_p)
LONGEST_PHRASE = max(len(p.split()) for p in PHRASES)
PAUSES = (",", ";", "，", "；")


def fold(df: DataFrame, by: Names, order: Names, columns: Names, rule: Callable[..., list[tuple]], out: str, dealt: Names | None = None) -> DataFrame:
    """by and the columns of `out` (a DDL string): for each group the rows that rule(list of each column) gives.

    Groups are dealt out by their key and sorted by Spark; a task then reads them one after the other and holds a
    batch and the group at hand. Null keys are a group. dealt: the part of `by` that the rows come dealt out by, as after
    a window over it, for groups that follow one another in its order (sentences of a medium): they are not dealt anew.
    """
    keys = T.StructType([df.schema[c] for c in by])
    schema = T.StructType([*keys.fields, *T.StructType.fromDDL(out).fields])
    rows = df.select(*dict.fromkeys([*by, *order, *columns]))
    rows = rows.sortWithinPartitions(*dealt, *order) if dealt else rows.repartition(*by).sortWithinPartitions(*by, *order)

    def closed(frame: pd.DataFrame) -> pd.DataFrame:
        starts = _starts(frame[by])
        lists = [frame[c].tolist() for c in columns]
        rows, count = [], []
        for a, b in zip(starts, [*starts[1:], len(frame)], strict=True):
            own = rule(*(x[a:b] for x in lists))
            rows += own
            count.append(len(own))
        made = frame[by].iloc[np.repeat(starts, count)].reset_index(drop=True)
        for k, name in enumerate(schema.names[len(by) :]):
            made[name] = [r[k] for r in rows]
        return made

    def run(batches):
        held = []  # batches of the group at hand, put together once it ends
        for frame in batches:
            if not len(frame):
                continue
            cuts = _starts(frame[by] if not held else pd.concat([held[-1][by].iloc[-1:], frame[by]], ignore_index=True))[1:] - bool(held)
            if len(cuts):
                last = cuts[-1]
                pieces = [*held, frame.iloc[:last]] if last else held
                yield closed(pd.concat(pieces, ignore_index=True))
                held = [frame.iloc[last:]]
            else:
                held.append(frame)
        if held:
            yield closed(pd.concat(held, ignore_index=True))

    return rows.mapInPandas(run, schema)


def _starts(keys: pd.DataFrame) -> np.ndarray:
    before = keys.shift()
    changed = (keys.ne(before) & ~(keys.isna() & before.isna())).any(axis=1).to_numpy()
    changed[:1] = True
    return np.flatnonzero(changed)


def number(df: DataFrame, by: Names, order: Names, text: str, rule: Callable[[list[str]], list[int]], name: str) -> DataFrame:
    """by, order and the number that a rule over a group's ordered texts gives each row."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in order)
    return fold(df, by, order, [*order, text], lambda *lists: list(zip(*lists[:-1], rule(lists[-1]), strict=True)), f"{kinds}, {name} int")


def _numbers(sizes: list[int]) -> list[int]:
    return [k for k, n in enumerate(sizes) for _ in range(n)]


def effective(text: str) -> int:
    if text.isalpha():
        return len(text)
    return sum(map(str.isalnum, text)) if text.isascii() else sum(c.isalpha() or c.isnumeric() for c in text)


def pack_by_bytes(words: list[str], limit: int) -> list[int]:
    """Groups of at most `limit` bytes with spaces; a last group of one word of up to 12 characters joins the one before."""
    sizes, used = [], 0
    for w in words:
        n = len(w.encode())
        if sizes and used + 1 + n <= limit:
            sizes[-1] += 1
            used += 1 + n
        else:
            sizes.append(1)
            used = n
    if len(sizes) > 1 and sizes[-1] == 1 and len(words[-1]) <= 12:
        sizes[-2:] = [sizes[-2] + 1]
    return _numbers(sizes)


def fixed_length(words: list[str], target: int = 12, least: int = 8, most: int = 18) -> list[int]:
    """Groups of 12 to 18 words that end neither with a bad word nor inside a phrase; those of up to 3 join the one before."""
    if len(words) < target:
        return [0] * len(words)
    low = [w.strip().lower() for w in words]

    def splits_phrase(i: int, held: int) -> bool:
        a = max(i + 1 - min(3, held), 0)
        near = low[a : i + 4]
        cut = i + 1 - a
        return any(s + len(p) > cut and near[s : s + len(p)] == p for s in range(max(0, cut - LONGEST_PHRASE + 1), cut) for p in SPLIT_PHRASES.get(near[s], ()))

    sizes, held = [], 0
    for i in range(len(words)):
        held += 1
        last = i == len(words) - 1
        if held >= most or (held >= target and low[i] not in LOOSE_ENDS and (last or not splits_phrase(i, held))) or (last and held < target):
            sizes.append(held)
            held = 0
    if held:
        sizes = [*sizes[:-1], sizes[-1] + held] if sizes else [held]
    merged: list[int] = []
    for n in sizes:
        if n <= 3 and merged:
            merged[-1] += n
        else:
            merged.append(n)
    return _numbers(merged)


def semantic_breaks(words: list[str], limit: int = 70) -> list[int]:
    """Cuts before a break word from `limit` - 10 bytes on, or after `limit` + 15; without a cut, by fixed length."""
    if len(words) <= 5:
        return [0] * len(words)
    sizes, held, used = [], 0, 0
    for i, w in enumerate(words):
        n, key = len(w.encode()) + 1, w.strip().lower() in BREAK_WORDS
        held, used = held + 1, used + n
        if held >= 3 and i < len(words) - 1 and ((key and used >= limit - 10) or used >= limit + 15):
            if key:
                sizes.append(held - 1)
                held, used = 1, n
            else:
                sizes.append(held)
                held, used = 0, 0
    if held:
        if sizes and held < 3:
            sizes[-1] += held
        else:
            sizes.append(held)
    return _numbers(sizes) if len(sizes) > 1 else fixed_length(words)


# Words that open a new sentence, that may open one where both sides are short enough, that seldom do.
OPENERS = (
    "however", "therefore", "moreover", "furthermore", "nonetheless", "meanwhile", "afterwards", "consequently",
    "additionally", "besides", "similarly", "likewise", "nevertheless", "subsequently", "alternatively", "first", "second",
    "third", "finally", "lastly", "next", "then", "now", "later", "previously", "although", "though", "whereas", "despite",
)
JOINERS = ("and", "but", "or", "so", "because", "since", "when", "while", "if", "unless", "until", "before", "after", "during")
RELATIVES = ("who", "whom", "whose", "which", "that")
CONTEXT = frozenset((*OPENERS, *JOINERS, *RELATIVES))


def contextual_breaks(words: list[str], limit: int = 70, least: int = 5) -> list[int]:
    """Cuts before words that open a sentence, in view of what is held and what remains; one group if any has under three.

    An opener cuts once `least` words are there, itself included. A joiner does if the held words have a verb that is not
    their last and both they and all that remains have at most `limit` letters and digits. A relative pronoun does from
    twice as many words on, if the held words have a verb and more than `limit`. Counts come from running sums, so that a
    word costs the same whatever remains.
    """
    n = len(words)
    if n <= 5:
        return [0] * n
    low = [w.strip().lower() for w in words]
    places = [i for i, w in enumerate(low[:-1]) if w in CONTEXT]
    if not places:
        return [0] * n
    length, verbs = [0, *accumulate(map(effective, words))], [0, *accumulate(w in VERBS for w in low)]
    cuts, a = [], 0
    for i in places:
        w, held = low[i], i - a + 1
        if held < least or held < 2:
            continue
        whole = i - a >= 3 and verbs[i - 1] > verbs[a]
        before, after = length[i] - length[a], length[n] - length[i]
        joins = w in JOINERS and whole and max(before, after) <= limit
        relates = w in RELATIVES and whole and held >= 2 * least and before > limit
        if w in OPENERS or joins or relates:
            cuts.append(i)
            a = i
    sizes = [b - a for a, b in zip([0, *cuts], [*cuts, n], strict=True)]
    return _numbers(sizes) if min(sizes) >= 3 else [0] * n


def comma_breaks(words: list[str], limit: int = 70, least: int = 3) -> list[int]:
    """Cuts after a comma or semicolon once three words are held; without a cut, semantic breaks if the text is too long."""
    sizes, held = [], 0
    for w in words:
        held += 1
        if w.endswith(PAUSES) and held >= least:
            sizes.append(held)
            held = 0
    if held:
        sizes.append(held)
    if len(sizes) > 1:
        return _numbers(sizes)
    return semantic_breaks(words, limit) if effective(" ".join(words)) > limit else [0] * len(words)


def comma_parts(words: list[str]) -> list[int]:
    """Cuts after every comma; parts of one word are held for the next part, at the end for the last."""
    sizes, held = [], 0
    for w in words:
        held += 1
        if w.endswith(PAUSES):
            sizes.append(held)
            held = 0
    if held:
        sizes.append(held)
    out, waiting = [], 0
    for n in sizes:
        if n == 1:
            waiting += 1
        else:
            out.append(waiting + n)
            waiting = 0
    if waiting:
        out = [*out[:-1], out[-1] + waiting] if out else [waiting]
    return _numbers(out)


def gap_breaks(starts: list[float], ends: list[float], gap: float = 0.8, least: int = 3) -> list[int]:
    """Cuts before a word that begins `gap` after the one before ends, once three words are held."""
    sizes: list[int] = []
    for i in range(len(starts)):
        if not sizes or (starts[i] - ends[i - 1] >= gap and sizes[-1] >= least):
            sizes.append(1)
        else:
            sizes[-1] += 1
    return _numbers(sizes)


def _groups(numbers: list[int]) -> list[tuple[int, int]]:
    """First place and place beyond of each group of equal numbers in a row."""
    cuts = [i for i in range(1, len(numbers)) if numbers[i] != numbers[i - 1]]
    return list(zip([0, *cuts], [*cuts, len(numbers)], strict=True)) if numbers else []


def smart_breaks(words: list[str], starts: list[float], ends: list[float], gap: float = 0.8, rough: float = 0.5, large: int = 200, chunk: int = 50) -> list[int]:
    """Contextual breaks, without any those at gaps in time, without these by fixed length.

    More than `large` words are first cut at gaps of `rough`, without any into chunks of `chunk` words, and each part is
    broken by itself; there, gaps that would leave under three words are not used.
    """

    def strategies(a: int, b: int, layered: bool) -> list[int]:
        ws = words[a:b]
        found = contextual_breaks(ws)
        if found[-1:] > [0]:
            return found
        found = gap_breaks(starts[a:b], ends[a:b], gap)
        if found[-1:] > [0] and not (layered and min(y - x for x, y in _groups(found)) < 3):
            return found
        return fixed_length(ws)

    n = len(words)
    if n <= large:
        return strategies(0, n, False) if n else []
    parts = gap_breaks(starts, ends, rough)
    parts = parts if parts[-1] else [i // chunk for i in range(n)]
    out: list[int] = []
    for a, b in _groups(parts):
        base = out[-1] + 1 if out else 0
        out += [base + k for k in strategies(a, b, True)]
    return out


def merge_short(parts: list[str], least: int, most: int) -> list[str]:
    """Parts joined with the next while of under `least` letters and digits, if both together have at most `most`."""
    out, held = [], ""
    parts = [p.strip() for p in parts]
    for i, p in enumerate(parts):
        if not p:
            continue
        held = f"{held} {p}" if held else p
        following = parts[i + 1] if i + 1 < len(parts) else ""
        if not (following and effective(held) < least and effective(f"{held} {following}") <= most):
            out.append(held)
            held = ""
    return [*out, held] if held else out


def pack_batches(sizes: list[int], most: int = 10) -> list[int]:
    """Batch number per sentence of so many blocks: three in a batch if they fit, else two, else one."""
    out, k, i = [], 0, 0
    while i < len(sizes):
        take = next((n for n in (3, 2) if i + n <= len(sizes) and sum(sizes[i : i + n]) <= most), 1)
        out += [k] * take
        k, i = k + 1, i + take
    return out


def pack_blocks(sizes: list[int], most: int = 10) -> list[tuple[int, int, int, int]]:
    """Sentence, batch, first block and number of blocks: as pack_batches, with one of over `most` blocks cut into batches
    of its own."""
    out, shift = [], 0
    for i, (k, n) in enumerate(zip(pack_batches(sizes, most), sizes, strict=True)):
        for j in range(0, n, most):
            out.append((i, k + shift, j, min(most, n - j)))
            shift += j + most < n
    return out


END_MARKS = "。！？.!?…"
MARK = re.compile(r"[!-/:-@\[-`{-~\u2000-\u206f\u3000-\u303f\uff00-\uffef]$")


def reflow(lines: list[str], cjk: bool, target: int = 15, most: int = 22) -> list[str]:
    """Translated lines joined to lines of about 15 characters, 22 at most, with regard to their punctuation."""
    comma, out, held = ("，" if cjk else ","), [], ""
    ended = lambda s: s != "" and s[-1] in END_MARKS
    marked = lambda s: ended(s) or MARK.search(s) is not None
    for line in lines:
        line = line.replace(" ", comma) if cjk else line
        if held:
            joint = "" if marked(held) else comma
            if ended(held) and (not ended(line) or len(held) >= target):
                out.append(held)
                held = line
            elif len(held) + len(joint) + len(line) > most:
                out.append(held + joint)
                held = line
            else:
                held += joint + line
        else:
            held = line
        if len(held) >= most or (ended(held) and len(held) >= target):
            out.append(held)
            held = ""
    return [*out, held] if held else out


def short_lines(words: list[tuple[str, float, float]], start: float, end: float, last: float, most: int) -> list[tuple[str, float, float]]:
    """Lines (text, start, end) of a sentence of over `most` words, of equal numbers of words, with times that ascend.

    A word that ends after its sentence begins no line, though its text stays.
    """
    n = len(words)
    k = next((k for k in range(2, 6) if n <= k * most), 0)
    size = n // k + 1 if k else most
    out, text, count, fresh = [], "", 1, True
    line_start = line_end = 0.0
    for word, s, e in words:
        text += word + " "
        if fresh:
            line_start = max(s, last, line_end, start)
            if e > end:
                continue
            line_end, fresh = e, False
        else:
            line_end = min(max(line_end, e), end)
            if count % size == 0 and count > 1:
                out.append((text, line_start, line_end))
                text, fresh = "", True
        count += 1
    return [*out, (text, line_start, line_end)] if text else out


def longest_chain(nums: list[int]) -> list[int]:
    """Places of the longest chain in which each number is one above the one before, gaps between places allowed."""
    if not nums:
        return []
    length, before, best = [1] * len(nums), [-1] * len(nums), 0
    at: dict[int, int] = {}  # number -> place of the longest chain that ends with it, the earliest of equals
    for i, x in enumerate(nums):
        j = at.get(x - 1)
        if j is not None:
            length[i], before[i] = length[j] + 1, j
        if x not in at or length[i] > length[at[x]]:
            at[x] = i
        if i and (length[i] > length[best] or best == 0):
            best = i
    chain = []
    i = best
    while i >= 0:
        chain.append(i)
        i = before[i]
    return chain[::-1]


def solid(text: str) -> str:
    """Letters, marks and digits only."""
    import unicodedata

    return "".join(c for c in text if unicodedata.category(c)[0] not in "PSZ" and not c.isspace())


def align(sentences: list[str], words: list[tuple[str, float, float]]) -> list[tuple[float, float]]:
    """Times of sentences one after the other among timed words."""
    return align_from(sentences, words, 0.0)[0]


def align_from(sentences: list[str], words: list[tuple[str, float, float]], last: float) -> tuple[list[tuple[float, float]], float]:
    """Times of sentences one after the other among timed words, from a time reached before on, and the time then reached.

    A sentence is sought in the words' joined text. The first place whose words lie at or after the time reached gives
    its times; without any place, the words that share a character with it do; without these it has no length. Times
    ascend, a sentence lasts a second at least if found, and one of 5 s or more does not move the time reached.
    """
    pieces = [solid(w) for w, _, _ in words]
    joined, begins = "".join(pieces), [0, *accumulate(map(len, pieces))]

    def place(a: int, b: int, last: float):
        first, beyond = bisect_right(begins, a) - 1, bisect_left(begins, b, hi=len(words))
        start = next((s for _, s, _ in words[first:beyond] if s >= last), None)
        end = next((e for _, _, e in reversed(words[:beyond]) if e >= last), None) if beyond else None
        return (start, end) if start is not None and end is not None and start < end else None

    out = []
    for sentence in sentences:
        wanted, found = solid(sentence), None
        if wanted:
            a = joined.find(wanted)
            if a < 0:
                common = lambda p: bool(set(p) & set(wanted))
                hits = [w for p, w in zip(pieces, words, strict=True) if w[1] >= last and common(p)] or [w for p, w in zip(pieces, words, strict=True) if common(p)]
                found = (max(hits[0][1], last), hits[-1][2]) if hits else None
            while a >= 0 and found is None:
                found = place(a, a + len(wanted), last)
                a = joined.find(wanted, a + 1)
        if found is None:
            start = end = last
        else:
            start = max(found[0], last)
            end = found[1] if found[1] > start else start + 1.0
        out.append((start, end))
        if end - start < 5:
            last = end
    return out, last


def match_pieces(piece: str, words: list[str], start: int) -> list[int]:
    """Places of the words that a piece's words match in order, equal or contained; none if under half of them match."""
    strip = lambda w: w.strip().lower().strip(".,;:!?\"'()[]{}")
    wanted, out = [strip(w) for w in piece.split()], []
    for i in range(start, len(words)):
        if len(out) == len(wanted) or len(out) > 2 * len(wanted):
            break
        if wanted[len(out)] in strip(words[i]):
            out.append(i)
    return out if len(out) >= len(wanted) // 2 else []
