"""Toxicity scores of texts after noisy-channel deobfuscation.

Strings that look disguised (signs or digits for letters, single letters set apart, letters repeated) become lattices: each run of one
character offers what it may stand for, at a cost. Viterbi decoding under a character trigram model of all texts restores
the likeliest string, and the restored text is scored: by words and beginnings of words that are significantly
more frequent in toxic documents, calibrated by logistic regression against the text's length.

Counts of trigrams are over all texts, those of words over all labelled rows. Tables have fixed sizes, however large
their counts are: words meet in two hashed tables, and weigh only as much as the lighter of both entries says.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidweave.llm.byte_bpe import LETTER, classes
from bidweave.llm.common import BROADCAST_IDS, prepare, sliced, steps, text_or_empty
from bidweave.llm.language_id import held_out
from bidweave.llm.ngram_join import BASE, INVERSE, _powers, mix

#: Symbols of the character model: 0 is a gap, 1-26 are a-z, other letters share the rest.
SYMBOLS = 64
#: Letters that a sign or digit may stand for (fixed values).
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "¡": "i", "£": "l"}
#: Costs of the channel, in nats.
AS_LETTER, SIGN_AS_GAP, DOUBLE, SINGLE, TRIPLED = 1.0, 8.0, 0.7, 6.0, 0.3
#: Costs of dropping a separator, and of taking it for a gap: between single letters, and elsewhere.
BETWEEN_LETTERS, ELSEWHERE = (0.3, 2.5), (1.0, 0.5)

_SIGNS = re.escape("".join(LEET))
#: Spots that make a string suspicious: single letters set apart by one and the same sign, signs inside or before letters, letters three times in a row.
SPACED = re.compile(rf"(?<![^\W_])(?:[^\W_]|[{_SIGNS}])([ .\-_*~·/\\,'])(?:(?:[^\W_]|[{_SIGNS}])\1){{2,}}(?:[^\W_]|[{_SIGNS}])(?![^\W_])")
SUSPICIOUS = re.compile(rf"[^\W\d_][{_SIGNS}]+[^\W\d_]|(?<![^\s\"'(])[{_SIGNS}][^\W\d_][^\W\d_]|[^\W\d_][.\-_*~·][^\W\d_][.\-_*~·]|([^\W\d_])\1\1")
#: Least log probability of a gap after a first letter that may be a word by itself.
WORD_OF_ONE_LETTER = -4.0
#: Longest stretch of a decoding that is kept in the cache.
CACHED = 40

TABLE_BITS = 18
#: Beginnings of words that are features beside the words.
PREFIXES = (4, 5, 6, 7)
#: Least log-likelihood ratio of a feature; chance reaches it once in some ten million features.
SIGNIFICANT = 28.0
#: Cells of the table that the calibration is fitted to: evidence, then length.
CELLS = (64, 32)


@lru_cache(1)
def _symbols() -> np.ndarray:
    """Symbol of each code point of a lower-case text."""
    points = np.arange(0x110000, dtype=np.uint64)
    other = 27 + (mix(points) % np.uint64(SYMBOLS - 27)).astype(np.uint8)
    out = np.where(classes() == LETTER, other, 0).astype(np.uint8)
    out[97:123] = np.arange(1, 27)
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def trigrams(text: str) -> np.ndarray:
    """Codes of the symbol trigrams of a text; a word's first letter follows two gaps, however many there are."""
    s = np.concatenate([[0, 0], _symbols()[_points(text.lower())], [0]]).astype(np.int64)
    before = np.where(s[1:-1] == 0, 0, s[:-2])
    return (before * SYMBOLS**2 + s[1:-1] * SYMBOLS + s[2:])[(s[1:-1] > 0) | (s[2:] > 0)]


def character_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b) from trigram counts, mixed with those of shorter contexts."""
    tri = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
    bi, uni = tri.sum(0), tri.sum((0, 1))
    share = lambda x: x / np.maximum(x.sum(-1, keepdims=True), 1.0)
    mixed = 0.85 * share(tri) + 0.1 * share(bi)[None] + 0.04 * share(uni)[None, None] + 0.01 / SYMBOLS
    return np.log(mixed).astype(np.float32)


def _lattice(span: str) -> list[list[tuple[str, float]]]:
    """For each run of one character, the strings that it may stand for and their costs; a blank is a gap."""
    nodes = []
    dropped, gap = BETWEEN_LETTERS if SPACED.fullmatch(span) else ELSEWHERE
    for m in re.finditer(r"(.)\1*", span.lower(), re.S):
        c, n = m[1], m.end() - m.start()
        if c.isalpha():
            nodes.append([(c, 0.0)] if n == 1 else [(c * 2, 0.0), (c, SINGLE)] if n == 2 else [(c, TRIPLED), (c * 2, TRIPLED + DOUBLE)])
        elif c in LEET:
            options = [(letter, AS_LETTER) for letter in LEET[c]]
            if n > 1:
                options += [(letter * 2, AS_LETTER + (DOUBLE if n > 2 else 0.0)) for letter in LEET[c]]
            nodes.append([*options, (" ", SIGN_AS_GAP)])
        else:
            nodes.append([("", dropped), (" ", gap)] if n == 1 and not c.isdigit() else [(" ", gap)])
    return nodes


def decode(span: str, model: np.ndarray) -> str:
    """The likeliest string behind a disguised one: Viterbi over the lattice, a state being the last two symbols."""
    symbol = _symbols()
    states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    out: list[str] = []
    for options in [*_lattice(span), [(" ", 0.0)]]:
        steps_ = [(text, cost, [int(symbol[ord(c)]) for c in text]) for text, cost in options]
        reached: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (score, path) in states.items():
            for text, cost, emitted in steps_:
                x, y, s = a, b, score - cost
                for c in emitted:
                    if c == 0:
                        if y:
                            s += float(model[x, y, 0])
                        x = y = 0
                    else:
                        s += float(model[x, y, c])
                        x, y = y, c
                if (x, y) not in reached or s > reached[x, y][0]:
                    reached[x, y] = (s, (path, text))
        states = reached
        if len(states) == 1:
            # All paths meet here, so what lies before is settled.
            (key, (score, path)) = next(iter(states.items()))
            settled = []
            while path:
                path, text = path
                settled.append(text)
            out += reversed(settled)
            states = {key: (score, ())}
    best = max(states.values(), key=lambda v: v[0])
    path, rest = best[1], []
    while path:
        path, text = path
        rest.append(text)
    return "".join(out + rest[::-1]).strip()


class Restorer:
    """Texts with their suspicious strings decoded. Short strings are decoded once for each task."""

    def __init__(self, model: np.ndarray):
        self._decode = lru_cache(1 << 15)(lambda span: decode(span, model))
        self._model = model

    def _restored(self, span: str) -> str:
        return self._decode(span) if len(span) <= CACHED else decode(span, self._model)

    def _joined(self, span: str) -> str:
        """Single letters put together. Where the first one may be a word of its own, the reading without it follows: words are counted once."""
        whole = self._restored(span)
        first = int(_symbols()[ord(span[0].lower()[0])])
        alone = first and self._model[0, first, 0] > WORD_OF_ONE_LETTER and len(span) > 8
        return f"{whole} {span[0]} {self._restored(span[2:])}" if alone else whole

    def text(self, text: str) -> str:
        """The text with each suspicious string replaced, the rest as it is."""
        text = _replaced(text, [m.span() for m in SPACED.finditer(text)], self._joined)
        spans: list[tuple[int, int]] = []
        for m in SUSPICIOUS.finditer(text):
            a, b = m.span()
            if spans and a < spans[-1][1]:
                continue
            start = _start_of_string(text, a, spans[-1][1] if spans else 0)
            end = _GAP.search(text, b)
            spans.append((start, end.start() if end else len(text)))
        return _replaced(text, spans, self._restored)


_GAP = re.compile(r"\s")


def _start_of_string(text: str, at: int, least: int) -> int:
    """Start of the string around a place: looked for in windows that double, so that the cost is its length."""
    width = 64
    while at - width > least:
        found = [m.end() for m in _GAP.finditer(text, at - width, at)]
        if found:
            return found[-1]
        width *= 2
    found = [m.end() for m in _GAP.finditer(text, least, at)]
    return found[-1] if found else least


#: Signs at a string's edges that belong to the sentence, not to the word.
_EDGES = ".,;:!?\"'()[]{}<>*#%&=-_/\\~`^|+$@"


def _replaced(text: str, spans: list[tuple[int, int]], by) -> str:
    if not spans:
        return text
    out, at = [], 0
    for a, b in spans:
        word = text[a:b]
        core = word.rstrip(_EDGES)
        lead = len(core) - len(core.lstrip(".,;:?\"'[]{}<>*#%&=-_/\\~`^"))
        out += [text[at : a + lead], " ", by(core[lead:]), " ", word[len(core) :]]
        at = b
    return "".join([*out, text[at:]])


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words and of their beginnings, the text that each belongs to, and the number of words of each text."""
    lowered = [t.lower() for t in texts]
    points = _points("\n".join([*lowered, ""]))
    inside = np.zeros(len(points) + 2, bool)
    inside[1:-1] = _symbols()[points] > 0
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in lowered]), starts, "right")
    if not len(starts):
        return np.zeros(0, np.uint64), owner, np.zeros(len(texts), np.int64)
    size = 1 << len(points).bit_length()
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * _powers(BASE, size)[: len(points)], out=sums[1:])
    back = _powers(INVERSE, size)[starts]
    lengths = ends - starts
    hashes, owners = [mix((sums[ends] - sums[starts]) * back + lengths.astype(np.uint64))], [owner]
    for n in PREFIXES:
        long = np.flatnonzero(lengths > n)
        hashes.append(mix((sums[starts[long] + n] - sums[starts[long]]) * back[long] + np.uint64(1000 + n)))
        owners.append(owner[long])
    return np.concatenate(hashes), np.concatenate(owners), np.bincount(owner, minlength=len(texts))


def _slots(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A feature's places in the two tables, which lie behind one another."""
    mask = np.uint64((1 << TABLE_BITS) - 1)
    return (hashes & mask).astype(np.int64), (hashes >> np.uint64(32) & mask).astype(np.int64) + (1 << TABLE_BITS)


@dataclass
class Model:
    """characters: log probabilities of trigrams; weights: of both tables; curve: of the logistic regression."""

    characters: np.ndarray = field(default_factory=lambda: character_model(np.zeros(SYMBOLS**3)))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(2 << TABLE_BITS, np.float32))
    curve: np.ndarray = field(default_factory=lambda: np.array([-30.0, 0, 0, 0]))

    def evidence(self, restored: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the weights of each text's distinct features, and its number of words."""
        hashes, owner, words = features(restored)
        first, second = _slots(hashes)
        weight = np.minimum(self.weights[first], self.weights[second])
        heavy = np.flatnonzero(weight > 0)
        order = heavy[np.lexsort((hashes[heavy], owner[heavy]))]
        new = np.ones(len(order), bool)
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        order = order[new]
        return np.bincount(owner[order], weight[order].astype(np.float64), minlength=len(restored)), words

    def scores(self, restored: list[str]) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(_design(*self.evidence(restored)) @ self.curve, -30, 30)))


def _design(evidence: np.ndarray, words: np.ndarray) -> np.ndarray:
    """What the regression sees: evidence, whether there is any, evidence for the length."""
    found = np.log1p(np.maximum(evidence, 0.0))
    return np.stack([np.ones(len(found)), found, evidence > 0, found * np.log1p(words) / 8], axis=1)


def _logistic(x: np.ndarray, toxic: np.ndarray, clean: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    """Weights of a logistic regression on cells with counts of both classes, by Newton's method with halved steps."""
    w = np.zeros(x.shape[1])
    n = toxic + clean
    penalty = np.array([1e-6, *[ridge] * (x.shape[1] - 1)])
    loss = lambda w: -(toxic * -np.logaddexp(0, -(x @ w)) + clean * -np.logaddexp(0, x @ w)).sum() + 0.5 * (penalty * w * w).sum()
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * p - toxic) + penalty * w
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), slope)
        scale = 1.0
        while scale > 1e-4 and loss(w - scale * step) > loss(w):
            scale /= 2
        w = w - scale * step
        if np.abs(scale * step).max() < 1e-8:
            break
    return w


def _weights(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Log odds of the entries that are significantly more frequent in toxic texts, by the log-likelihood ratio; zero for the rest."""
    if not n_toxic or not n_clean:
        return np.zeros(len(toxic), np.float32)
    t, c = np.minimum(toxic, n_toxic).astype(float), np.minimum(clean, n_clean).astype(float)
    part = lambda k, n, p: np.where(k > 0, k * np.log(np.maximum(k, 1e-12) / n / np.maximum(p, 1e-300)), 0.0)
    p = (t + c) / (n_toxic + n_clean)
    ratio = 2 * (part(t, n_toxic, p) + part(n_toxic - t, n_toxic, 1 - p) + part(c, n_clean, p) + part(n_clean - c, n_clean, 1 - p))
    odds = np.log((t + 0.5) / (n_toxic + 1)) - np.log((c + 0.5) / (n_clean + 1))
    return np.where((ratio >= SIGNIFICANT) & (odds > 0), odds, 0.0).astype(np.float32)


def _sums(rows: DataFrame, size: int, columns: int) -> np.ndarray:
    """Added-up counts by place; ``size`` bounds what reaches the driver."""
    found = rows.groupBy("at").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(columns)]).toArrow()
    out = np.zeros((columns, size), np.int64)
    for i in range(columns):
        out[i, found.column("at").to_numpy()] = found.column(f"n{i}").to_numpy()
    return out


def _sparse(*counts: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(sum(counts))
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *[pa.array(c[at], pa.int64()) for c in counts]], ["at", *[f"n{i}" for i in range(len(counts))]])


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SYMBOLS**3, np.int64)
    for batch in sliced(batches):
        texts = batch.column(0).to_pylist()
        for a, b in steps(texts):
            counts += np.bincount(trigrams("\n".join(texts[a:b])), minlength=SYMBOLS**3)
    yield _sparse(counts)


def count_characters(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of the symbol trigrams of all texts."""
    prepare(docs.sparkSession)
    return _sums(docs.select(text_or_empty(text_col).alias("t")).mapInArrow(_count_trigrams, "at int, n0 bigint"), SYMBOLS**3, 1)[0]


def _restoring(batches: Iterator[pa.RecordBatch], characters: np.ndarray) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Batches with the restored texts of their last column, of bounded size."""
    restorer = Restorer(characters)
    for batch in sliced(batches):
        texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
        for a, b in steps(texts):
            yield batch.slice(a, b - a), [restorer.text(t) for t in texts[a:b]]


def _count_features(characters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, (2 << TABLE_BITS) + 1), np.int64)
        for batch, restored in _restoring(batches, characters.value):
            hashes, owner, _ = features(restored)
            order = np.argsort(owner, kind="stable")
            edges = np.searchsorted(owner[order], np.arange(len(restored) + 1))
            for i, label in enumerate(batch.column(0).to_pylist()):
                for slots in _slots(np.unique(hashes[order[edges[i] : edges[i + 1]]])):
                    counts[label, np.unique(slots)] += 1
                counts[label, -1] += 1
        yield _sparse(*counts)

    return run


def _count_cells(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, CELLS[0] * CELLS[1]), np.int64)
        for batch, restored in _restoring(batches, model.value.characters):
            evidence, words = model.value.evidence(restored)
            cell = _cells(evidence, words)
            label = np.array(batch.column(0).to_pylist())
            for i in (0, 1):
                counts[i] += np.bincount(cell[label == i], minlength=counts.shape[1])
        yield _sparse(*counts)

    return run


def _cells(evidence: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Cell of each text: twelve to one step of log evidence, two to a doubling of the length."""
    row = np.where(evidence > 0, np.minimum(CELLS[0] - 1, 1 + np.floor(np.log1p(evidence) * 12)), 0)
    return (row * CELLS[1] + np.minimum(CELLS[1] - 1, np.floor(np.log2(1.0 + words) * 2))).astype(np.int64)


def _cell_centres() -> tuple[np.ndarray, np.ndarray]:
    row, column = np.divmod(np.arange(CELLS[0] * CELLS[1]), CELLS[1])
    return np.where(row > 0, np.expm1((row - 0.5) / 12), 0.0), 2.0 ** ((column + 0.5) / 2) - 1


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns characters from all texts, and words from all labelled documents that aren't held out: three of the four fifths give
    the weights, the last one the calibration.

    Labels are 0 or 1; null ones are no labels, and of several the largest counts. Without labels of both kinds no text has evidence."""
    spark = docs.sparkSession
    model = Model(characters=character_model(count_characters(docs, text_col)))
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_doc")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("_label"))
    if labels.count() <= BROADCAST_IDS:
        marks = F.broadcast(marks)
    fold = F.pmod(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")), F.lit(5))
    rows = docs.where(~held_out(id_col)).select(F.col(id_col).alias("_doc"), fold.alias("_fold"), F.col(text_col).alias("_text")).join(marks, "_doc")
    part = lambda last: rows.where((F.col("_fold") == 4) if last else (F.col("_fold") < 4)).select("_label", "_text")

    characters = spark.sparkContext.broadcast(model.characters)
    counts = _sums(part(False).mapInArrow(_count_features(characters), "at int, n0 bigint, n1 bigint"), (2 << TABLE_BITS) + 1, 2)
    model.weights = _weights(counts[1, :-1], counts[0, :-1], int(counts[1, -1]), int(counts[0, -1]))
    shared = spark.sparkContext.broadcast(model)
    clean, toxic = _sums(part(True).mapInArrow(_count_cells(shared), "at int, n0 bigint, n1 bigint"), CELLS[0] * CELLS[1], 2)
    if toxic.sum() and clean.sum():
        used = np.flatnonzero(toxic + clean)
        model.curve = _logistic(_design(*_cell_centres())[used], toxic[used], clean[used])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id column, held_out, score (0 to 1) and predicted (1 from 0.5 on). Only the text decides.

    Null texts count as empty; these and texts without letters have the score of no evidence. Repeated rows each give a row, an empty table gives none, other
    columns are left out. Texts of any length are restored and scored whole."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    picked = docs.select(F.col(id_col).alias("_key"), held_out(id_col).alias("held_out"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, restored in _restoring(batches, shared.value.characters):
            found = shared.value.scores(restored)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64()), pa.array((found >= 0.5).astype(np.int32))], ["_key", "held_out", "score", "predicted"])

    schema = T.StructType([T.StructField("_key", docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return picked.mapInArrow(run, schema).withColumnRenamed("_key", id_col)
