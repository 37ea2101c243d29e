"""Language identification in two levels.

The family of a text's language is predicted first, by one linear support vector machine for each family; inside
a family, one-versus-one machines tell the related languages apart. Languages of no known family are put
into families of their likes, and no family has more than LARGEST_FAMILY members, so the weights grow with the languages, not with
their pairs. Features are hashed letter
trigrams as shares of a text's trigrams, so the score of a text is a mean of weights, and
one pass of array operations scores a whole batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidweave.llm.byte_bpe import LETTER, classes
from bidweave.llm.common import prepare, sliced, steps

#: Language codes by family. Codes that are missing here are grouped by their trigrams.
FAMILIES = {
    "germanic": "en de nl af da sv no nb nn is fo fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "indic": "hi ur bn pa gu mr ne",
    "semitic": "ar he mt am",
    "celtic": "ga gd cy br",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

BUCKETS = 1 << 16
#: Documents of each language that are learned from, at most; the bound of the driver's work.
PER_LANGUAGE = 400
#: Documents learned from over all languages: where there are more than SAMPLE_ROWS / PER_LANGUAGE of these, each gives less, but LEAST_ROWS.
SAMPLE_ROWS, LEAST_ROWS = 40_000, 20
#: Languages of one family, at most, and documents of other families that one is told from.
LARGEST_FAMILY, RIVALS = 14, 3200
#: Trigram shares are small; this factor brings margins to the order of one.
SCALE = 30.0
UNKNOWN = "und"


def family_of(lang: str) -> str:
    return FAMILY_OF.get(lang.lower().split("-")[0], "")


def alike(names: list[str], profiles: np.ndarray, largest: int) -> list[list[str]]:
    """Groups of ``largest`` names at most: halves along the direction in which the profiles differ most, again and again."""
    if len(names) <= largest:
        return [names]
    centred = profiles - profiles.mean(axis=0)
    order = np.argsort(centred @ np.linalg.svd(centred, full_matrices=False)[2][0], kind="stable")
    half = len(names) // 2
    return [g for part in (np.sort(order[:half]), np.sort(order[half:])) for g in alike([names[i] for i in part], profiles[part], largest)]


def families_of(names: list[str], profiles: np.ndarray, largest: int) -> dict[str, list[str]]:
    """Members of each family. Known families that are too large, and languages of none, are divided by their profiles."""
    out: dict[str, list[str]] = {}
    place = {n: i for i, n in enumerate(names)}
    for family, own in groupby(sorted(names, key=family_of), key=family_of):
        members = sorted(own)
        groups = alike(members, profiles[[place[n] for n in members]], largest)
        for group in groups:
            out[family if family and len(groups) == 1 else f"{family}={group[0]}"] = group
    return dict(sorted(out.items()))


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams of the texts one after another, the first index of each text, its number of letters.

    Whatever is no letter counts as a gap; trigrams of which two places are gaps are left out."""
    joined = "\n".join([*(t.lower() for t in texts), ""])
    lengths = np.fromiter((len(t.lower()) + 1 for t in texts), np.int64, len(texts))
    points = np.frombuffer(("\n" + joined + "\n").encode("utf-32-le"), np.uint32)
    letter = classes()[points] == LETTER
    points = np.where(letter, points, np.uint32(32))
    mixed = points[:-2] * np.uint32(0x9E3779B1) ^ points[1:-1] * np.uint32(0x85EBCA77) ^ points[2:] * np.uint32(0xC2B2AE3D)
    hashed = (mixed ^ mixed >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(16)
    near = letter.view(np.uint8)
    useful = near[:-2] + near[1:-1] + near[2:] >= 2
    firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    kept = np.concatenate([[0], np.cumsum(useful)])
    letters = np.add.reduceat(letter[1:-1].astype(np.int64), firsts) if len(texts) else np.zeros(0, np.int64)
    return hashed[useful], np.append(kept[firsts], kept[len(useful)]), letters


def _means(weights: np.ndarray, hashed: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Mean of each machine's weights over each text's trigrams; zero without any."""
    sums = np.zeros((len(edges) - 1, len(weights)))
    counts = np.diff(edges)
    some = np.flatnonzero(counts)
    if len(some):
        for j, own in enumerate(weights):
            sums[some, j] = np.add.reduceat(own[hashed].astype(np.float64), edges[:-1][some])
    return sums / np.maximum(counts, 1)[:, None]


def fit_svm(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, cost: float = 10.0, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM with hinge loss, by coordinate ascent on the dual. target: 1 or -1."""
    weights, bias = np.zeros(BUCKETS), 0.0
    alpha = np.zeros(len(rows))
    norms = np.array([v @ v + 1.0 for _, v in rows])
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            at, value = rows[i]
            slope = target[i] * (weights[at] @ value + bias) - 1.0
            new = min(max(alpha[i] - slope / norms[i], 0.0), cost)
            if (move := (new - alpha[i]) * target[i]) != 0.0:
                weights[at] += move * value
                bias += move
                alpha[i] = new
    return weights, bias


def _none() -> np.ndarray:
    return np.zeros((0, BUCKETS), np.float32)


def _chance(margins: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(2.0 * margins, -30, 30)))


@dataclass
class Model:
    """families: names in order, with a machine each; duels: (left, right) of each machine inside a family; rows of weights are machines."""

    families: list[str] = field(default_factory=list)
    members: dict[str, list[str]] = field(default_factory=dict)
    family_weights: np.ndarray = field(default_factory=_none)
    family_bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    duels: dict[str, list[tuple[str, str]]] = field(default_factory=dict)
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    bias: dict[str, np.ndarray] = field(default_factory=dict)

    def _winner(self, family: str, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the member that wins most duels (ties: larger margins, then first), and its weakest chance."""
        names, n = self.members[family], len(margins)
        wins, total = np.zeros((n, len(names))), np.zeros((n, len(names)))
        chance = np.ones((n, len(names)))
        for j, (a, b) in enumerate(self.duels[family]):
            ia, ib = names.index(a), names.index(b)
            m = margins[:, j]
            p = _chance(m)
            wins[:, ia] += m >= 0
            wins[:, ib] += m < 0
            total[:, ia] += m
            total[:, ib] -= m
            chance[:, ia] = np.minimum(chance[:, ia], p)
            chance[:, ib] = np.minimum(chance[:, ib], 1 - p)
        best = np.argmax(wins * 1e6 + np.clip(total, -1e5, 1e5), axis=1)
        return best, chance[np.arange(n), best]

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not texts or not self.families:
            return langs, scores
        hashed, edges, letters = _trigrams(texts)
        if len(self.families) == 1:
            top, sure = np.zeros(len(texts), np.int64), np.ones(len(texts))
        else:
            margins = _means(self.family_weights, hashed, edges) * SCALE + self.family_bias
            top, sure = margins.argmax(axis=1), _chance(margins.max(axis=1))
        counts = np.diff(edges)
        for f, family in enumerate(self.families):
            own = (top == f) & (letters > 0)
            rows = np.flatnonzero(own)
            if not len(rows):
                continue
            won, p = np.zeros(len(rows), np.int64), np.ones(len(rows))
            if len(self.members[family]) > 1:
                # Only the duels of the family are fought, over the trigrams of its texts.
                inside = _means(self.weights[family], hashed[np.repeat(own, counts)], np.append(0, np.cumsum(counts[rows])))
                won, p = self._winner(family, inside * SCALE + self.bias[family])
            for r, w, x in zip(rows.tolist(), won.tolist(), (p * sure[rows]).tolist()):
                langs[r], scores[r] = self.members[family][w], x
        return langs, scores


def held_out(id_col: str | Column) -> Column:
    """True for the fifth of the documents that nothing is learned from."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.pmod(F.crc32(F.encode(col.cast("string"), "UTF-8")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Learns from a sample of ``per_language`` rows of each language at most that aren't held out; less
    where many languages share SAMPLE_ROWS.

    Rows with a null language or text are not learned from. Every language that has a row with a letter trigram is learned, however many there are. The sample is by hash of the id, so it is the same in
    every run; one pass counts the languages, another takes the rows that a hash threshold
    picks, so no language's rows are sorted or gathered. An empty sample gives a model
    that knows no language. Long texts are read whole. The driver holds the sample and the model, both in proportion to the number of languages."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Model()
    per_language = min(per_language, max(LEAST_ROWS, SAMPLE_ROWS // len(counts)))
    # Small shares are taken a little larger, so that a language rarely gets less than its rows by chance.
    wanted = spark.createDataFrame([(lang, min(1.0, (1.3 * per_language + 12) / n)) for lang, n in counts.items()], "lang string, share double")
    draw = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1_000_003)) / 1_000_003
    sample = rows.join(F.broadcast(wanted), "lang").where(draw < F.col("share")).select("lang", draw.alias("draw"), "text")

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            at, values = [], []
            for text in batch.column(2).to_pylist():
                hashed, _, _ = _trigrams([text])
                found, n = np.unique(hashed, return_counts=True)
                at.append(found.astype(np.int32))
                values.append((n * (SCALE / max(1, len(hashed)))).astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], ["lang", "draw", "at", "value"])

    drawn = sample.mapInArrow(shares, "lang string, draw double, at array<int>, value array<float>").toArrow()
    langs, draws = drawn.column("lang").to_pylist(), drawn.column("draw").to_pylist()
    order = sorted(range(len(langs)), key=lambda i: (langs[i], draws[i]))
    taken: dict[str, int] = {}
    rows_of: list[tuple[str, tuple[np.ndarray, np.ndarray]]] = []
    at, value = drawn.column("at").combine_chunks(), drawn.column("value").combine_chunks()
    for i in order:
        if taken.get(langs[i], 0) < per_language and len(at[i]):
            taken[langs[i]] = taken.get(langs[i], 0) + 1
            rows_of.append((langs[i], (at[i].values.to_numpy(), value[i].values.to_numpy().astype(np.float64))))
    model = Model()
    if not taken:
        return model
    names = sorted(taken)
    own = {lang: list(found) for lang, found in groupby(rows_of, key=lambda r: r[0])}
    profiles = np.zeros((len(names), 512))
    for p, lang in zip(profiles, names):
        for _, (places, values) in own[lang]:
            np.add.at(p, places % 512, values / len(own[lang]))
    model.members = families_of(names, profiles, LARGEST_FAMILY)
    model.families = list(model.members)

    def machine(left: list, right: list) -> tuple[np.ndarray, float]:
        # In order of languages on both sides, so that the machine of the other side is the mirror of this one.
        both = sorted([(lang, i, x, 1.0) for i, (lang, x) in enumerate(left)] + [(lang, i, x, -1.0) for i, (lang, x) in enumerate(right)], key=lambda r: r[:2])
        w, c = fit_svm([x for _, _, x, _ in both], np.array([t for *_, t in both]))
        return w.astype(np.float32), c

    def machines(sides: list[tuple[list, list]]) -> tuple[np.ndarray, np.ndarray]:
        weights, bias = np.zeros((len(sides), BUCKETS), np.float32), np.zeros(len(sides))
        for j, (left, right) in enumerate(sides):
            weights[j], bias[j] = machine(left, right)
        return weights, bias

    if len(model.families) > 1:
        sides = []
        for members in model.members.values():
            held = set(members)
            rest = [r for r in rows_of if r[0] not in held]
            sides.append(([r for lang in members for r in own[lang]], rest[:: -(-len(rest) // RIVALS)]))
        model.family_weights, model.family_bias = machines(sides)
    for family, members in model.members.items():
        if len(members) > 1:
            model.duels[family] = list(combinations(members, 2))
            model.weights[family], model.bias[family] = machines([(own[a], own[b]) for a, b in model.duels[family]])
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred and score to the id column, held_out and the columns named by ``keep``.

    Only the text decides. Null and letterless texts, and any text if the model knows no
    language, are ``und`` with score 0. Whole texts are read, however long. Repeated rows each give a row; an empty table gives none."""
    prepare(docs.sparkSession)
    kept = keep or []
    # One copy for each executor: the weights of all machines may be large.
    shared = docs.sparkSession.sparkContext.broadcast(model)
    picked = docs.select(F.col(id_col).alias("_key"), held_out(id_col).alias("held_out"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(kept)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in sliced(batches):
            texts = [t or "" for t in batch.column(2).to_pylist()]
            langs, scores = [], []
            for a, b in steps(texts):
                found = known.predict(texts[a:b])
                langs += found[0]
                scores += found[1]
            columns = [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *[batch.column(3 + i) for i in range(len(kept))]]
            yield pa.RecordBatch.from_arrays(columns, ["_key", "held_out", "lang_pred", "score", *[f"_k{i}" for i in range(len(kept))]])

    kinds = {"_key": docs.schema[id_col].dataType, "held_out": T.BooleanType(), "lang_pred": T.StringType(), "score": T.DoubleType()}
    schema = T.StructType([T.StructField(n, k) for n, k in (kinds | {f"_k{i}": docs.schema[c].dataType for i, c in enumerate(kept)}).items()])
    out = picked.mapInArrow(run, schema).withColumnRenamed("_key", id_col)
    return out.withColumnsRenamed({f"_k{i}": c for i, c in enumerate(kept)})
