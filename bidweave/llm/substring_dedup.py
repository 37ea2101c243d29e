"""Repeated passages across documents, exact or fuzzy, by seeds, collinear chains and alignment.

Seeds are minimizers of word k-mers: of any ``window`` k-mers in a row one is chosen by
hash, the same in every document. Each seed knows the first document that has it (least
id), and every other occurrence is matched with that one, so a passage that a thousand
documents share gives a thousand matches, not a million. Short k-mers survive changed words; long ones
have the first document of a longer stretch, so that documents meet whose short seeds came earlier here and there. Matches of a document with a first
document are chained: the best increasing sequence with gap costs, found through a
Fenwick tree that holds the best chain ending at each place. Chains are aligned word by
word, extended at both ends for as long as words match, however far, and
cut into the parts whose identity is high enough, which gives the passages' limits.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidweave.llm.common import cut_lineage, prepare, sliced
from bidweave.llm.components import loose
from bidweave.llm.ngram_join import BROADCAST_ROWS, mix, together, words_of

#: Words of a short k-mer, and k-mers of which one is a seed.
KMER, WINDOW = 5, 10
#: The same of long ones; an unchanged run of LONG + LONG_WINDOW - 1 words always shares a long seed.
LONG, LONG_WINDOW = 25, 26
#: Words that one step of an extension looks at; a step in which less than GOOD of them match is the last.
MARGIN, GOOD = 64, 0.5
#: A chain of few words is aligned if near its first seed LIKELY of ``min_words`` words in a row match one that lies up to SHIFT words off,
#: or, with a neighbour, up to DRIFT: words that one text lacks move what follows, and two in a row are rarely equal by chance.
LIKELY, SHIFT, DRIFT = 0.6, 3, 14
#: Cost of each word that a chain skips, in words.
GAP_COST = 0.2
#: Beyond a chain's ends, what a matching word gains and a skipped one costs; changed words cost nothing there.
GAIN, SKIP = 10, 3
#: Cells of a gap's alignment that are kept at once (4 bytes each).
CELLS = 1 << 22


def _grams(own: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-mers, put together from those of their halves, quarters and so on."""
    grams, size = own, 1
    for bit in bin(k)[3:]:
        grams, size = _joined(grams, grams[size:], size), 2 * size
        if bit == "1":
            grams, size = _joined(own, grams[1:], size), size + 1
    return mix(grams + np.uint64(k))


def seeds(own: np.ndarray, k: int = KMER, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of a text's minimizers, by place."""
    if len(own) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams = _grams(own, k)
    if len(grams) <= window:
        at = np.array([int(grams.argmin())])
    else:
        least = _slid(np.minimum, grams, window)
        at = _chosen(grams, least, window)
        if ((np.diff(at) < window) & (grams[at[1:]] == grams[at[:-1]])).any():
            # Repetitive words: among equal hashes the place decides, so one of ``window`` is taken there too.
            view = np.lib.stride_tricks.sliding_window_view(grams, window)
            phase = np.lib.stride_tricks.sliding_window_view(np.arange(len(grams)) % window, window)
            at = np.unique(np.where(view == least[:, None], phase, window).argmin(axis=1) + np.arange(len(view)))
    return grams[at], at


def _chosen(grams: np.ndarray, least: np.ndarray, window: int) -> np.ndarray:
    """Places of the k-mers that are the least of some window: the largest of its windows' least is its own hash."""
    ends = np.zeros(window - 1, np.uint64)
    return np.flatnonzero(grams == _slid(np.maximum, np.concatenate([ends, least, ends]), window))


def seeds_of(own: np.ndarray, counts: np.ndarray, k: int = KMER, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, places and texts of the minimizers of some texts whose words follow each other, as ``seeds`` gives them.

    The seeds of a text are together, by place."""
    begin = np.cumsum(counts) - counts
    alone = counts < k + window - 1
    h = at = text = np.zeros(0, np.int64)
    if not alone.all():
        grams = _grams(own, k)
        owner = np.repeat(np.arange(len(counts)), counts)
        # Windows that lie in two texts choose nothing.
        least = np.where(owner[: len(owner) - (k + window - 2)] == owner[k + window - 2 :], _slid(np.minimum, grams, window), np.uint64(0))
        at = _chosen(grams, least, window)
        h, text = grams[at], owner[at]
        again = (np.diff(at) < window) & (h[1:] == h[:-1]) & (text[1:] == text[:-1])
        alone[text[1:][again]] = True
        kept = ~alone[text]
        h, at, text = h[kept], at[kept] - begin[text[kept]], text[kept]
    single = [(*seeds(own[begin[i] : begin[i] + counts[i]], k, window), i) for i in np.flatnonzero(alone)]
    return (
        np.concatenate([h.astype(np.uint64), *[x for x, _, _ in single]]),
        np.concatenate([at, *[x for _, x, _ in single]]),
        np.concatenate([text, *[np.full(len(x), i) for x, _, i in single]]),
    )


def _joined(left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    """Hashes of neighbours taken together, the right one of ``size`` words."""
    factor = np.uint64(pow(0x9E3779B97F4A7C15, size, 1 << 64))
    return left[: len(right)] * factor + right


def _slid(best: np.ufunc, values: np.ndarray, window: int) -> np.ndarray:
    """The best of each ``window`` values in a row, by doubling."""
    size = 1
    while 2 * size <= window:
        values, size = best(values[:-size], values[size:]), 2 * size
    return best(values[: len(values) - (window - size)], values[window - size :]) if size < window else values


def all_seeds(own: np.ndarray, counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Short and long seeds of some texts for passages of ``least`` words: hashes, places and texts."""
    k = LONG if least >= LONG + LONG_WINDOW - 1 else max(KMER + 1, least // 2)
    kinds = seeds_of(own, counts), seeds_of(own, counts, k, LONG_WINDOW if k == LONG else max(1, least - k + 1))
    return tuple(np.concatenate(x) for x in zip(*kinds))


def _numbered(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """How many times each hash came before in its text, in order. Equal hashes of one text have no other text's between them."""
    order = np.argsort(h, kind="stable")
    own, of = h[order], text[order]
    start = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (of[1:] != of[:-1])))
    out = np.empty(len(h), np.int64)
    out[order] = np.arange(len(h)) - np.repeat(start, np.diff(np.append(start, len(h))))
    return out


def _seed_rows(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            docs, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for start, stop in together(texts):
                own, counts = words_of(texts[start:stop])
                wanted = (counts >= least) & np.array([d is not None for d in docs[start:stop]])
                own, counts = own[np.repeat(wanted, counts)], counts[wanted]
                if not len(own):
                    continue
                ids = np.array([d or 0 for d in docs[start:stop]], np.int64)[wanted]
                h, at, text = all_seeds(own, counts, least)
                # A hash's j-th occurrence in a document is matched with the j-th elsewhere, and also with the first.
                turn = _numbered(h, text)
                again = turn > 0
                keys = np.concatenate([np.where(again, mix(h + turn.astype(np.uint64)), h), h[again]])
                places = np.concatenate([at, ~at[again]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ids[np.append(text, text[again])]), pa.array(places)], ["h", "doc", "pos"])

    return run


class _BestBefore:
    """Fenwick tree over places: the largest value put at or before a place, and who put it."""

    def __init__(self, size: int):
        self.value = [float("-inf")] * (size + 1)
        self.owner = [-1] * (size + 1)

    def put(self, place: int, value: float, owner: int) -> None:
        i = place + 1
        while i < len(self.value):
            if value > self.value[i]:
                self.value[i], self.owner[i] = value, owner
            i += i & -i

    def best(self, place: int) -> tuple[float, int]:
        i, value, owner = place + 1, float("-inf"), -1
        while i:
            if self.value[i] > value:
                value, owner = self.value[i], self.owner[i]
            i -= i & -i
        return value, owner


def chains(xs: np.ndarray, ys: np.ndarray, reach: int, k: int = KMER) -> list[list[tuple[int, int, int]]]:
    """Chains of segments (x, y, words), best first; no segment is in two chains.

    Matches on one diagonal that lie within ``reach`` of each other are one segment. A chain's
    score is the words of its segments less GAP_COST for each word skipped on either side."""
    order = np.lexsort((xs, ys - xs))
    x, y = xs[order], ys[order]
    new = np.ones(len(x), bool)
    new[1:] = (np.diff(y - x) != 0) | (np.diff(x) > reach)
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(x)) - 1
    by_x = np.lexsort((y[begin], x[begin]))
    begin, last = begin[by_x], last[by_x]
    sx, sy = x[begin].tolist(), y[begin].tolist()
    size = (x[last] - x[begin] + k).tolist()
    n = len(sx)
    if n == 1:
        return [[(sx[0], sy[0], size[0])]]
    ends = sorted({b + s for b, s in zip(sy, size)})
    tree = _BestBefore(len(ends))
    by_end = sorted(range(n), key=lambda i: sx[i] + size[i])
    score, before = [0.0] * n, [-1] * n
    done = 0
    for i in range(n):  # by x; those that end at or before x are in the tree
        # neighbours on different diagonals may overlap by less than a k-mer
        while done < n and sx[by_end[done]] + size[by_end[done]] <= sx[i] + k - 1 and by_end[done] < i:
            j = by_end[done]
            tree.put(bisect_left(ends, sy[j] + size[j]), score[j] + GAP_COST * (sx[j] + size[j] + sy[j] + size[j]), j)
            done += 1
        score[i] = float(size[i])
        at = bisect_left(ends, sy[i] + k) - 1
        if at >= 0:
            value, j = tree.best(at)
            if j >= 0 and (gained := value - GAP_COST * (sx[i] + sy[i])) > 0:
                score[i], before[i] = size[i] + min(gained, score[j]), j
    used = [False] * n
    out = []
    for i in sorted(range(n), key=lambda i: (-score[i], i)):
        found = []
        while i >= 0 and not used[i]:
            used[i] = True
            found.append((sx[i], sy[i], size[i]))
            i = before[i]
        if found:
            out.append(found[::-1])
    return out


def _chain_rows():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows: list[tuple] = []
            xs, ys = batch.column(2), batch.column(3)
            for i, (doc, source) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                taken = np.zeros(0, bool)
                for chain in chains(xs[i].values.to_numpy().astype(np.int64), ys[i].values.to_numpy().astype(np.int64), WINDOW + KMER):
                    x0, x1 = chain[0][0], chain[-1][0] + chain[-1][2]
                    if len(taken) < x1:
                        taken = np.append(taken, np.zeros(x1 - len(taken), bool))
                    # However short: other seeds of the passage may have another first document; alignment extends it.
                    if not taken[x0:x1].all():
                        taken[x0:x1] = True
                        y0, y1 = chain[0][1], chain[-1][1] + chain[-1][2]
                        rows.append((doc, source, x0, x1, y0, y1, [v for s in chain for v in s]))
            columns = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc", "source", "x0", "x1", "y0", "y1", "chain"])

    return run


def _rows_of(a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
    """Row by row, the words that a's first i and b's first j have in order."""
    row = np.zeros(len(b) + 1, np.int32)
    yield row
    for w in a:
        longer = np.maximum(row[1:], np.where(b == w, row[:-1] + 1, 0))
        row = np.append(np.int32(0), np.maximum.accumulate(longer))
        yield row


def _common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in two gaps of a longest common subsequence."""
    none = np.zeros(0, np.int64)
    if not len(a) or not len(b):
        return none, none
    if len(a) == len(b):
        same = np.flatnonzero(a == b)
        if len(same) >= len(a) - 1:
            return same, same
    if len(a) * len(b) > CELLS and len(a) > 1:
        # The table is too large to keep: a is halved, and b where both halves together have most (Hirschberg).
        half = len(a) // 2
        for upper in _rows_of(a[:half], b):
            pass
        for lower in _rows_of(a[half:][::-1], b[::-1]):
            pass
        cut = int((upper + lower[::-1]).argmax())
        (xa, ya), (xb, yb) = _common(a[:half], b[:cut]), _common(a[half:], b[cut:])
        return np.append(xa, xb + half), np.append(ya, yb + cut)
    table = list(_rows_of(a, b))
    xs, ys, i, j = [], [], len(a), len(b)
    while table[i][j]:
        if table[i - 1][j] == table[i][j]:
            i -= 1
        elif table[i][j - 1] == table[i][j]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            xs.append(i)
            ys.append(j)
    return np.array(xs[::-1], np.int64), np.array(ys[::-1], np.int64)


def align(x: np.ndarray, y: np.ndarray, chain: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Places in x and in y of the words that match along a chain. The chain's places are relative to x and y."""
    x0, y0, _ = chain[0]
    px, py = x0, y0
    xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if x0 > len(x) or y0 > len(y):
        return xs[0], ys[0]
    for sx, sy, size in chain:
        cut = max(0, px - sx, py - sy)
        sx, sy = sx + cut, sy + cut
        size = min(size - cut, len(x) - sx, len(y) - sy)  # a repeated id may bring another text
        if size <= 0:
            continue
        gx, gy = _common(x[px:sx], y[py:sy])
        same = np.flatnonzero(x[sx : sx + size] == y[sy : sy + size])
        xs += [gx + px, same + sx]
        ys += [gy + py, same + sy]
        px, py = sx + size, sy + size
    before = _equal(x[:x0][::-1], y[:y0][::-1])
    after = _equal(x[px:], y[py:])
    head, tail = np.arange(-before, 0), np.arange(after)
    return np.concatenate([head + x0, *xs, tail + px]), np.concatenate([head + y0, *ys, tail + py])


def _equal(a: np.ndarray, b: np.ndarray) -> int:
    """How many words at the start of both are equal."""
    n, step, at = min(len(a), len(b)), MARGIN, 0
    while at < n:
        other = np.flatnonzero(a[at : at + step][: n - at] != b[at : at + step][: n - at])
        if len(other):
            return at + int(other[0])
        at, step = at + step, 2 * step
    return n


def extended(aligned: list[tuple[np.ndarray, np.ndarray]], texts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, bool, bool]]:
    """The alignments with what matches beyond their ends, through changed, skipped and added words, and whether
    they were still going on where the words given end, at the head and at the tail."""
    none = np.zeros(0, np.uint32)
    tails = [(x[xs[-1] + 1 :], y[ys[-1] + 1 :]) if len(xs) else (none, none) for (xs, ys), (x, y) in zip(aligned, texts)]
    heads = [(x[: xs[0]][::-1], y[: ys[0]][::-1]) if len(xs) else (none, none) for (xs, ys), (x, y) in zip(aligned, texts)]
    out = []
    for (xs, ys), (hx, hy, head), (tx, ty, tail) in zip(aligned, _grown(heads), _grown(tails)):
        if len(xs):
            xs, ys = np.concatenate([(xs[0] - 1 - hx)[::-1], xs, xs[-1] + 1 + tx]), np.concatenate([(ys[0] - 1 - hy)[::-1], ys, ys[-1] + 1 + ty])
        out.append((xs, ys, head, tail))
    return out


def _grown(sides: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, bool]]:
    """Places of the matching words from the start of both words of a pair, in steps of MARGIN words for as long as a
    step is good; and whether the last step was, so that only the end of the words stopped it."""
    none = np.zeros(0, np.int64)
    out = [([none], [none], True) for _ in sides]
    at = [(0, 0)] * len(sides)
    todo = list(range(len(sides)))
    while todo:
        left = []
        for i in todo:
            at[i] = _run(*sides[i], *at[i], *out[i][:2])
        for i, (fx, fy) in zip(todo, _ends([(sides[i][0][at[i][0] :][:MARGIN], sides[i][1][at[i][1] :][:MARGIN]) for i in todo])):
            a, b = at[i]
            xs, ys, _ = out[i]
            xs.append(fx + a)
            ys.append(fy + b)
            rest = min(len(sides[i][0]) - a, len(sides[i][1]) - b, MARGIN)
            good = rest == 0 or len(fx) >= GOOD * rest
            out[i] = (xs, ys, good)
            if good and rest:
                at[i] = (a + int(fx[-1]) + 1, b + int(fy[-1]) + 1)
                left.append(i)
        todo = left
    return [(np.concatenate(xs), np.concatenate(ys), good) for xs, ys, good in out]


#: What may lie between two runs of equal words for the second to need no alignment: words skipped in either; and its least words.
STEPS, SURE = ((1, 1), (1, 0), (0, 1), (2, 2)), 8


def _run(x: np.ndarray, y: np.ndarray, a: int, b: int, xs: list[np.ndarray], ys: list[np.ndarray]) -> tuple[int, int]:
    """Adds the places of equal words from a and b on, over single changed, skipped and added words, and says where they end."""
    while True:
        if n := _equal(x[a:], y[b:]):
            xs.append(np.arange(a, a + n))
            ys.append(np.arange(b, b + n))
            a, b = a + n, b + n
        for da, db in STEPS:
            nx, ny = x[a + da : a + da + SURE], y[b + db : b + db + SURE]
            if len(nx) == len(ny) == SURE and (nx == ny).all():
                a, b = a + da, b + db
                break
        else:
            return a, b


def _ends(sides: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places of the matching words of the best alignment that begins at the start of both words of a pair; all pairs at once."""
    none = np.zeros(0, np.int64)
    out = [(none, none)] * len(sides)
    todo = [i for i, (a, b) in enumerate(sides) if len(a) and len(b)]
    if not todo:
        return out
    n, m = max(len(sides[i][0]) for i in todo), max(len(sides[i][1]) for i in todo)
    a, b = np.full((len(todo), n), -1, np.int64), np.full((len(todo), m), -2, np.int64)
    for row, i in enumerate(todo):
        a[row, : len(sides[i][0])], b[row, : len(sides[i][1])] = sides[i]
    steps = SKIP * np.arange(m + 1, dtype=np.int32)
    score = np.empty((n + 1, len(todo), m + 1), np.int32)
    score[0] = -steps
    for i in range(n):
        score[i + 1, :, 0] = -SKIP * (i + 1)
        score[i + 1, :, 1:] = np.maximum(score[i, :, :-1] + GAIN * (a[:, i, None] == b), score[i, :, 1:] - SKIP)
        score[i + 1] = np.maximum.accumulate(score[i + 1] + steps, axis=1) - steps
    at = np.arange(len(todo))
    i, j = np.divmod(score.transpose(1, 0, 2).reshape(len(todo), -1).argmax(axis=1), m + 1)
    rows, xs, ys = [], [], []
    while len(at):
        here = score[i, at, j]
        equal = a[at, i - 1] == b[at, j - 1]
        both = (i > 0) & (j > 0)
        straight = both & (here == score[i - 1, at, j - 1] + GAIN * equal)
        found = straight & equal
        rows.append(at[found])
        xs.append(i[found] - 1)
        ys.append(j[found] - 1)
        up = ~straight & (i > 0) & (here == score[i - 1, at, j] - SKIP)
        i, j = i - (straight | up), j - (straight | ~up)
        more = (i > 0) & (j > 0)
        at, i, j = at[more], i[more], j[more]
    rows, xs, ys = np.concatenate(rows)[::-1], np.concatenate(xs)[::-1], np.concatenate(ys)[::-1]
    order = np.argsort(rows, kind="stable")
    cuts = np.searchsorted(rows[order], np.arange(len(todo) + 1))
    for row, i in enumerate(todo):
        own = order[cuts[row] : cuts[row + 1]]
        out[i] = (xs[own], ys[own])
    return out


def parts(xs: np.ndarray, ys: np.ndarray, least: int, identity: float) -> list[tuple[int, int, int, int, float]]:
    """Limits in x and in y, and identity, of the disjoint stretches of an alignment that have ``least``
    words and ``identity`` or more: the one with most matches over ``identity`` of its words, then
    those of what is left on either side. A run of ``least`` equal words is always in one."""
    if not len(xs):
        return []
    cuts = np.flatnonzero((np.diff(xs) != 1) | (np.diff(ys) != 1)) + 1
    begin, end = np.append(0, cuts), np.append(cuts, len(xs))
    x0, y0, x1, y1 = xs[begin], ys[begin], xs[end - 1] + 1, ys[end - 1] + 1
    out, todo = [], [(0, len(begin))]
    while todo:
        lo, hi = todo.pop()
        best, at = -1e-9, None
        for i in range(lo, hi):
            j = lo + int(np.searchsorted(x1[lo:hi], x0[i] + least))
            if j >= hi:
                break
            over = end[j:hi] - begin[i] - identity * np.maximum(x1[j:hi] - x0[i], y1[j:hi] - y0[i])
            if over[m := int(over.argmax())] > best:
                best, at = float(over[m]), (i, j + m)
        if at:
            i, j = at
            share = (end[j] - begin[i]) / max(x1[j] - x0[i], y1[j] - y0[i])
            out.append((int(x0[i]), int(x1[j]), int(y0[i]), int(y1[j]), float(share)))
            todo += [(lo, i), (j + 1, hi)]
    return sorted(out)


def likely(seeds_at: list[tuple[int, int]], texts: list[tuple[np.ndarray, np.ndarray]], least: int) -> np.ndarray:
    """Which pairs have many matching words near their seeds, at the same distance from them but for SHIFT words,
    or for DRIFT words where a neighbour matches at the same distance too. All pairs at once."""
    width = 2 * least + KMER
    a, b = np.full((len(texts), width), -1, np.int64), np.full((len(texts), width + 2 * DRIFT), -2, np.int64)
    for row, ((sx, sy), (x, y)) in enumerate(zip(seeds_at, texts)):
        for out, words, lo in ((a, x, sx - least), (b, y, sy - least - DRIFT)):
            own = words[max(lo, 0) : max(lo + out.shape[1], 0)]
            out[row, max(-lo, 0) : max(-lo, 0) + len(own)] = own
    same = np.zeros(a.shape, bool)
    for shift in range(2 * DRIFT + 1):
        equal = a == b[:, shift : shift + width]
        if abs(shift - DRIFT) <= SHIFT:
            same |= equal
        else:
            two = equal[:, 1:] & equal[:, :-1]
            same[:, 1:] |= two
            same[:, :-1] |= two
    total = np.cumsum(np.pad(same, ((0, 0), (1, 0))), axis=1)
    return (total[:, least:] - total[:, :-least]).max(axis=1, initial=0) >= LIKELY * least


def _aligned_rows(least: int, identity: float):
    """Passages, with no chain; and where an alignment went on to the end of the words given, its limits, the ends that are open and its chain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out: list[tuple] = []
            data = batch.to_pydict()
            texts = [(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")) for x, y in zip(data["xw"], data["yw"])]
            found = [[(flat[i] - fx, flat[i + 1] - fy, flat[i + 2]) for i in range(0, len(flat), 3)] for fx, fy, flat in zip(data["fx"], data["fy"], data["chain"])]
            weak = [i for i, chain in enumerate(found) if sum(n for _, _, n in chain) < LIKELY * least]
            ok = np.ones(len(found), bool)
            if weak:
                ok[weak] = likely([found[i][0][:2] for i in weak], [texts[i] for i in weak], least)
            kept = np.flatnonzero(ok).tolist()
            texts = [texts[i] for i in kept]
            grown = extended([align(*texts[row], found[i]) for row, i in enumerate(kept)], texts)
            for i, (x, y), (xs, ys, head, tail) in zip(kept, texts, grown):
                doc, source, fx, fy, xn, yn, chain = (data[c][i] for c in ("doc", "source", "fx", "fy", "xn", "yn", "chain"))
                out += [(doc, source, x0 + fx, x1 + fx, y0 + fy, y1 + fy, share, None, None, None, None) for x0, x1, y0, y1, share in parts(xs, ys, least, identity)]
                head, tail = head and fx > 0 and fy > 0, tail and fx + len(x) < xn and fy + len(y) < yn
                if len(xs) and (head or tail):
                    out.append((doc, source, int(xs[0]) + fx, int(xs[-1]) + 1 + fx, None, None, None, head, tail, xn, chain))
            columns = list(zip(*out)) if out else [[]] * len(ALIGNED)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ALIGNED.values())], list(ALIGNED))

    return run


ALIGNED = dict.fromkeys(("doc", "source", "x0", "x1", "y0", "y1"), pa.int64()) | {"share": pa.float64(), "head": pa.bool_(), "tail": pa.bool_(), "xn": pa.int32(), "chain": pa.list_(pa.int32())}
ALIGNED_SCHEMA = "doc bigint, source bigint, x0 bigint, x1 bigint, y0 bigint, y1 bigint, share double, head boolean, tail boolean, xn int, chain array<int>"


def _open_rows(least: int):
    """Of one document's open alignments, the chains of those that may reach windows of ``least`` words that no passage holds yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out: list[tuple] = []
            for doc, passages, rest in zip(*(batch.column(i).to_pylist() for i in range(3))):
                held: list[list[int]] = []  # first words of windows that lie in a passage, as disjoint ranges
                for lo, hi in sorted((p["x0"], p["x1"] - least + 1) for p in passages):
                    if held and lo <= held[-1][1]:
                        held[-1][1] = max(held[-1][1], hi)
                    else:
                        held.append([lo, hi])
                known = lambda lo, hi: lo >= hi or any(a <= lo and hi <= b for a, b in held)  # noqa: B023, E731
                for r in rest:
                    last = r["xn"] - least + 1
                    if r["head"] and not known(0, min(r["x0"], last)) or r["tail"] and not known(max(0, r["x1"] - least + 1), last):
                        out.append((doc, r["source"], r["chain"]))
            columns = list(zip(*out)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.list_(pa.int32())])], ["doc", "source", "chain"])

    return run


def _merged_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages of one document and source that overlap in the document, as one."""
    names = ["doc", "source", "start_word", "end_word", "source_start", "source_end", "n_words", "identity"]
    for batch in sliced(batches):
        out: list[list] = []
        for doc, source, found in zip(*(batch.column(i).to_pylist() for i in range(3))):
            last = None
            for p in sorted(found, key=lambda p: (p["x0"], -p["x1"])):
                if last is not None and p["x0"] < last[3]:
                    last[3], last[4], last[5] = max(last[3], p["x1"]), min(last[4], p["y0"]), max(last[5], p["y1"])
                    last[7] = min(last[7], p["share"])
                else:
                    last = [doc, source, p["x0"], p["x1"], p["y0"], p["y1"], 0, p["share"]]
                    out.append(last)
        for row in out:
            row[6] = row[3] - row[2]
        columns = list(zip(*out)) if out else [[]] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 7 + [pa.float64()])], names)


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for start, stop in together(texts):
            own, counts = words_of(texts[start:stop])
            words = np.split((own >> np.uint64(32)).astype("<u4"), np.cumsum(counts)[:-1])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), pa.array([w.tobytes() for w in words], pa.binary())], ["id", "words"])


def _chained(taken: DataFrame, min_words: int) -> DataFrame:
    """Chains of seeds that documents have in common with the first documents to have them, written out."""
    # A place below zero is the complement of one that is matched with the first of its hash, but isn't it.
    rows = taken.mapInArrow(_seed_rows(min_words), "h bigint, doc bigint, pos int")
    of_first = lambda c: F.when(F.col("pos") >= 0, F.col(c))
    firsts = rows.groupBy("h").agg(F.min(of_first("doc")).alias("source"), F.min_by(of_first("pos"), of_first("doc")).alias("at"), F.max("doc").alias("last")).where("last > source")
    firsts = firsts.select(loose("h").alias("h"), "source", "at")
    matches = rows.select(loose("h").alias("h"), "doc", F.when(F.col("pos") >= 0, F.col("pos")).otherwise(F.bitwise_not("pos")).alias("pos")).join(firsts, "h").where("doc <> source")
    # One seed in common is aligned too: others of the passage may have earlier documents, or changed words.
    pairs = matches.groupBy("doc", "source").agg(F.collect_list("pos").alias("xs"), F.collect_list("at").alias("ys"))
    return cut_lineage(pairs.mapInArrow(_chain_rows(), "doc bigint, source bigint, x0 int, x1 int, y0 int, y1 int, chain array<int>"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, identity: float = 0.8) -> DataFrame:
    """Passages of ``min_words`` words or more that an earlier document (one of less or other id, the first
    to have their seeds) also holds, with ``identity`` or more of their words in order.

    One row per passage and source: the id column, source_id, start_word, end_word, source_start,
    source_end (ends exclusive), n_words, identity. Words are runs of letters and digits in lower case.
    Documents without such a passage give no row, nor do null ids, null texts and shorter
    texts. Rows that repeat an id are one document and have no passage in common with each other.
    An empty table gives none; other columns are left out. Whole texts are read, however long.

    Passages that overlap in the document are one row, with the least identity among them; n_words is
    the length in the document.

    A passage is found if one of its seeds has a first document that holds ``min_words`` of it. An unchanged
    passage always has a long seed, so it can only be missed where each of its long seeds came
    earlier in a document that holds LONG of its words and less than ``min_words``; a changed one where all of its short seeds did.
    Words are compared by 32 bits of their hashes in alignments.
    """
    prepare(docs.sparkSession)
    taken = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"))
    found = _chained(taken, min_words)
    margin = {"fx": F.greatest(F.col("x0") - MARGIN, F.lit(0)), "fy": F.greatest(F.col("y0") - MARGIN, F.lit(0)), "tx": F.col("x1") + MARGIN, "ty": F.col("y1") + MARGIN}
    first = cut_lineage(_aligned(found.withColumns(margin), taken, min_words, identity))
    # Where words still match at the end of the margin, and no passage holds what follows, the whole texts are aligned.
    known = F.when(F.col("chain").isNull(), F.struct("x0", "x1"))
    open_ = F.when(F.col("chain").isNotNull(), F.struct("source", "x0", "x1", "head", "tail", "xn", "chain"))
    by_doc = first.groupBy("doc").agg(F.collect_list(known).alias("known"), F.collect_list(open_).alias("open")).where(F.size("open") > 0)
    again = cut_lineage(by_doc.mapInArrow(_open_rows(min_words), "doc bigint, source bigint, chain array<int>"))
    whole = again.withColumns({"fx": F.lit(0), "fy": F.lit(0), "tx": F.lit(1 << 28), "ty": F.lit(1 << 28)})
    aligned = first.where("chain is null").unionByName(_aligned(whole, taken, min_words, identity, spread=True).where("chain is null"))
    per_pair = aligned.groupBy("doc", "source").agg(F.collect_list(F.struct("x0", "x1", "y0", "y1", "share")).alias("found"))
    out = per_pair.mapInArrow(_merged_rows, "doc bigint, source bigint, start_word bigint, end_word bigint, source_start bigint, source_end bigint, n_words bigint, identity double")
    return out.withColumnsRenamed({"doc": id_col, "source": "source_id"})


def _aligned(chains_of: DataFrame, taken: DataFrame, min_words: int, identity: float, spread: bool = False) -> DataFrame:
    """Alignments of chains, each on the words from fx to tx of the document and from fy to ty of the source.

    ``spread`` deals the pairs out anew, for a few long alignments that may have one source."""
    ids = cut_lineage(chains_of.select(F.explode(F.array("doc", "source")).alias("_need")).distinct())
    wanted = taken.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, F.col("_id") == F.col("_need"), "left_semi")
    # Both joins below move the words by the same key, so Spark makes and moves them once; either can split the
    # rows of a document that is the source of very many. What repeated ids double is merged with their passages.
    words = wanted.mapInArrow(_word_rows, "id bigint, words binary")
    piece = lambda lo, hi: F.substring("words", F.col(lo) * 4 + 1, (F.col(hi) - F.col(lo)) * 4)
    size = F.octet_length("words") / 4
    left = chains_of.join(words, chains_of["doc"] == words["id"]).select("doc", "source", "fx", "fy", "ty", "chain", piece("fx", "tx").alias("xw"), size.cast("int").alias("xn"))
    both = left.join(words, F.col("source") == F.col("id")).select("doc", "source", "fx", "fy", "xn", size.cast("int").alias("yn"), "chain", "xw", piece("fy", "ty").alias("yw"))
    if spread:
        both = both.repartition(int(taken.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return both.mapInArrow(_aligned_rows(min_words, identity), ALIGNED_SCHEMA)
