"""Near-duplicate join on word n-grams: MinHash banding, then exact Jaccard on the full sets.

Copies (equal n-gram sets) are one node from the start. Nodes that share a band hash are
candidates; nothing is left out of a bucket. Candidates are verified in blocks: a block
holds a bounded number of sets, compares all its candidate pairs inside one task and
returns one row per node, never a row per pair. A large bucket or candidate component is split into
chunks, bounded in sets and in n-grams, and every pair of chunks is a block, so hot groups spread over the cluster and
no link is lost. Links are counted, so every candidate pair of different sets is compared; copies are not.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidweave.llm.byte_bpe import LETTER, NUMBER, classes
from bidweave.llm.common import cut_lineage, prepare, sliced
from bidweave.llm.components import connected, loose

#: Nodes of a chunk; a block compares one chunk with itself or with another.
CHUNK = 256
#: N-grams of a chunk (8 bytes each); a text of more has a chunk of its own, or shares one by chance.
CHUNK_GRAMS = 1 << 21
#: A component is compared as a whole if its square is at most so many times the squares of its buckets.
DENSE = 4
#: A table of ids is broadcast only if it was counted to have no more rows than this (8 bytes each).
BROADCAST_ROWS = 200_000


def choose_bands(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """Bands and rows a band: as many rows as possible (fewer false candidates) such that a pair at
    the threshold meets in some band with probability ``recall``, with ``most`` hashes at most."""
    best = (most, 1)
    for rows in range(1, most + 1):
        meet = threshold**rows
        bands = 1 if meet >= recall else math.ceil(math.log(1 - recall) / math.log(1 - meet))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


@lru_cache(1)
def _of_words() -> np.ndarray:
    """For every code point, whether words consist of it: letters and digits."""
    kinds = classes()
    return (kinds == LETTER) | (kinds == NUMBER)


@lru_cache(1)
def _of_bytes() -> bytes:
    return _of_words()[:256].tobytes()


#: Base of the words' polynomials, and its inverse among 64-bit numbers.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


@lru_cache(64)
def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, np.uint64(base))
    out[0] = 1
    return np.cumprod(out)


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the lower-case words of a text: runs of letters and digits, in order."""
    return words_of([text])[0]


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of some texts, one text after the other, and how many words each has.

    Polynomials in the code points, as differences of one running sum over all texts."""
    lowers = [t.lower() for t in texts]
    lower = "\n".join(lowers)
    try:  # one byte a character does for most texts
        raw = lower.encode("latin-1")
        points, kinds = np.frombuffer(raw, np.uint8), np.frombuffer(raw.translate(_of_bytes()), bool)
    except UnicodeEncodeError:
        points = np.frombuffer(lower.encode("utf-32-le"), np.uint32)
        kinds = _of_words()[points]
    inside = np.zeros(len(points) + 2, bool)
    inside[1:-1] = kinds
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    if not len(edges):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    starts, ends = edges[::2], edges[1::2]
    size = 1 << len(points).bit_length()
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * _powers(BASE, size)[: len(points)], out=sums[1:])
    own = (sums[ends] - sums[starts]) * _powers(INVERSE, size)[starts]
    own = mix(own + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    if len(texts) == 1:
        return own, np.array([len(own)])
    after = np.cumsum([len(t) + 1 for t in lowers])
    return own, np.diff(np.searchsorted(starts, after), prepend=0)


def together(texts: list[str], most: int = 500_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters, or of one longer text."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > most:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of words; shorter texts are one gram; none without words."""
    own = word_hashes(text)
    if not len(own):
        return own
    k = min(n, len(own))
    grams = np.full(len(own) - k + 1, k, np.uint64)
    for i in range(k):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + own[i : len(own) - k + 1 + i]
    return np.unique(mix(grams))


@lru_cache(8)
def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240229)
    top = (1 << 63) - 1
    return draw.integers(1, top, count, np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, top, count, np.uint64)


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """One row of band hashes for each non-empty set."""
    lengths = np.fromiter(map(len, sets), np.int64, len(sets))
    firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    joined = np.concatenate(sets)
    times, plus = _permutations(bands * rows)
    out = np.empty((len(sets), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(sets), band + 1, np.uint64)
        for j in range(band * rows, (band + 1) * rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(joined * times[j] + plus[j], firsts))
        out[:, band] = key
    return out.view(np.int64)


def _signatures(n: int, bands: int, rows: int, with_set: bool):
    names = ["_id", "set_key", "bands", "q"] + ["grams"] * with_set

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = batch.column(0)
            start = 0
            while start < len(texts):
                stop = start
                size = 0
                while stop < len(texts) and (size == 0 or size + len(texts[stop]) < 1_000_000):
                    size += len(texts[stop]) + 1
                    stop += 1
                sets = [shingles(t, n) for t in texts[start:stop]]
                full = [i for i, s in enumerate(sets) if len(s)]
                keys: list[str | None] = [None] * len(sets)
                own: list[np.ndarray | None] = [None] * len(sets)
                if full:
                    found = band_hashes([sets[i] for i in full], bands, rows)
                    for i, row in zip(full, found):
                        keys[i], own[i] = hashlib.md5(sets[i].tobytes()).hexdigest(), row
                columns = [ids.slice(start, stop - start), pa.array(keys, pa.string()), pa.array(own, pa.list_(pa.int64())), pa.array([len(s) for s in sets], pa.int64())]
                if with_set:
                    columns.append(pa.array([s.tobytes() for s in sets], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names)
                start = stop

    return run


def _linked_pairs(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the candidate pairs have a Jaccard likeness of the threshold or more."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    small, large = np.minimum(size[rows], size[cols]), np.maximum(size[rows], size[cols])
    possible = small >= threshold * large - 1e-9
    out = np.zeros(len(rows), bool)
    pairs = np.flatnonzero(possible)
    if not len(pairs):
        return out
    used = np.unique(np.concatenate([rows[pairs], cols[pairs]]))
    grams, place, counts = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True, return_counts=True)
    shared = counts > 1
    width = int(shared.sum())
    number = np.cumsum(shared) - 1
    owner = np.repeat(np.arange(len(used)), size[used])
    in_shared = shared[place]
    owner, place = owner[in_shared], number[place[in_shared]]
    at = np.full(len(sets), -1)
    at[used] = np.arange(len(used))
    a, b = at[rows[pairs]], at[cols[pairs]]
    if len(pairs) * 4e-5 < len(used) ** 2 * width * 3e-10:
        edges = np.searchsorted(owner, np.arange(len(used) + 1))
        inter = np.fromiter((len(np.intersect1d(place[edges[i] : edges[i + 1]], place[edges[j] : edges[j + 1]], assume_unique=True)) for i, j in zip(a, b)), np.int64, len(a))
    else:
        common = np.zeros((len(used), len(used)), np.float64)
        step = max(64, 4_000_000 // len(used))
        for lo in range(0, width, step):
            block = np.zeros((len(used), min(step, width - lo)), np.float32)
            inside = (place >= lo) & (place < lo + step)
            block[owner[inside], place[inside] - lo] = 1.0
            common += block @ block.T
        inter = common[a, b].astype(np.int64)
    union = size[rows[pairs]] + size[cols[pairs]] - inter
    out[pairs] = inter >= threshold * union - 1e-9
    return out


def _verify(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = len(pdf)
        lo, hi, band = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0]), int(pdf["g2"].iloc[0])
        nodes, chunk = pdf["node"].to_numpy(), pdf["chunk"].to_numpy()
        bands = np.stack(pdf["bands"].to_list())
        first = np.full((n, n), -1, np.int16)
        for j in range(bands.shape[1] - 1, -1, -1):
            first[bands[:, j][:, None] == bands[:, j][None, :]] = j
        wanted = np.triu(first >= 0 if band < 0 else first == band, 1) & (nodes[:, None] != nodes[None, :])
        if lo != hi:
            wanted &= chunk[:, None] != chunk[None, :]
        rows, cols = np.nonzero(wanted)
        none = pd.DataFrame({"node": np.zeros(0, np.int64), "root": np.zeros(0, np.int64), "links": np.zeros(0, np.int64)})
        if not len(rows):
            return none
        ok = _linked_pairs([np.frombuffer(g, np.uint64) for g in pdf["grams"]], rows, cols, threshold)
        rows, cols = rows[ok], cols[ok]
        if not len(rows):
            return none
        links = np.bincount(rows, minlength=n) + np.bincount(cols, minlength=n)
        root = nodes.copy()
        while True:  # least node along the links
            before = root.copy()
            np.minimum.at(root, rows, root[cols])
            np.minimum.at(root, cols, root[rows])
            if (before == root).all():
                break
        some = links > 0
        return pd.DataFrame({"node": nodes[some], "root": root[some], "links": links[some]})

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.9995) -> DataFrame:
    """Classes of documents that verified links of Jaccard >= ``threshold`` on word n-grams connect.

    Returns one row per input row: the id column, class_id (least id of the class), n_links
    (other distinct n-gram sets linked to this one), n_copies (rows with the same set).
    Words are runs of letters and digits in lower case; a text of fewer than n words is one
    gram. Null and wordless texts are classes of their own, with no links. Rows
    that repeat an id are one document. Ids are integers; a null id joins the class of
    its text's copies. An empty table gives none; other columns are left out.

    A pair right at the threshold is found with probability ``recall``, others above it with more.
    """
    prepare(docs.sparkSession)
    bands, rows = choose_bands(threshold, recall)
    taken = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"))
    signed = cut_lineage(taken.mapInArrow(_signatures(n, bands, rows, False), "_id bigint, set_key string, bands array<bigint>, q bigint"))
    sets = cut_lineage(signed.where("set_key is not null").groupBy("set_key").agg(F.min("_id").alias("node"), F.count("*").alias("n_copies"), F.first("bands").alias("bands"), F.first("q").alias("q")))

    banded = sets.where("node is not null").select("node", "q", F.posexplode("bands").alias("band", "key"))
    buckets = banded.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("node").alias("head"), F.sum("q").alias("grams")).where("n > 1")
    members = cut_lineage(banded.select("node", "q", "band", loose("key").alias("key")).join(buckets.select("band", loose("key").alias("key"), "n", "head", "grams"), ["band", "key"]))
    # Every node goes to the least of its buckets' heads (one a band at most), so only heads are left to connect.
    least = cut_lineage(members.groupBy("node").agg(F.min("head").alias("m"), F.collect_set("head").alias("heads"), F.first("q").alias("q")))
    among = connected(least.select(F.col("m").alias("a"), F.explode("heads").alias("b")))
    moved = among.where("label <> node").select(F.col("node").alias("_from"), F.col("label").alias("_to"))
    labels = least.select("node", "q", loose("m").alias("m")).join(moved.withColumn("_from", loose("_from")), F.col("m") == F.col("_from"), "left")
    labels = cut_lineage(labels.select("node", "q", F.coalesce("_to", "m").alias("comp")))

    # Blocks: of a candidate component where it is small or dense, else of its buckets.
    work = members.where("node = head").select("head", "n").join(labels.drop("q"), F.col("head") == F.col("node")).groupBy("comp").agg(F.sum(F.col("n") * F.col("n")).alias("work"))
    sizes = labels.groupBy("comp").agg(F.count("*").alias("size"), F.sum("q").alias("grams")).join(work, "comp")
    whole = (F.col("size") <= CHUNK) | (F.col("size") * F.col("size") <= DENSE * F.col("work"))
    sizes = sizes.select(loose("comp").alias("comp"), "size", "grams", whole.alias("whole"))
    placed = labels.select("node", loose("comp").alias("comp")).join(sizes, "comp")
    by_component = placed.where("whole").select("node", F.col("comp").alias("g1"), F.lit(-1).alias("g2"), F.col("size").alias("n"), "grams")
    scattered = placed.where("not whole").select(loose("node").alias("node"))
    by_bucket = members.select(loose("node").alias("node"), F.col("key").alias("g1"), F.col("band").alias("g2"), "n", "grams").join(scattered, "node", "left_semi")
    grouped = by_component.unionByName(by_bucket.select("node", "g1", "g2", "n", "grams"))
    chunks = F.ceil(F.greatest(F.col("n") / CHUNK, F.least(F.col("grams") / CHUNK_GRAMS, F.col("n").cast("double")))).cast("int")
    chunk = F.pmod(F.xxhash64("node"), chunks).cast("int")
    blocks = grouped.select("node", "g1", "g2", chunk.alias("chunk"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other")).select(
        "node", "g1", "g2", "chunk", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi")
    )

    needed = labels.select(F.col("node").alias("_need"))
    text_rows = taken.join(F.broadcast(needed) if needed.count() <= BROADCAST_ROWS else needed, F.col("_id") == F.col("_need"), "left_semi")
    full = text_rows.mapInArrow(_signatures(n, bands, rows, True), "_id bigint, set_key string, bands array<bigint>, q bigint, grams binary").where("set_key is not null")
    content = full.withColumnRenamed("_id", "node").dropDuplicates(["node", "set_key"]).drop("set_key", "q")
    checked = cut_lineage(blocks.join(content, "node").groupBy("g1", "g2", "lo", "hi").applyInPandas(_verify(threshold), "node bigint, root bigint, links bigint"))

    classes = connected(checked.select(F.col("node").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("_n1"), F.col("label").alias("class_id"))
    links = checked.groupBy("node").agg(F.sum("links").alias("n_links")).withColumnRenamed("node", "_n2")
    known = sets.join(classes, F.col("node") == F.col("_n1"), "left").join(links, F.col("node") == F.col("_n2"), "left")
    known = known.select("set_key", F.coalesce("class_id", "node").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "n_copies")
    out = signed.select("_id", "set_key").join(known, "set_key", "left")
    return out.select(F.col("_id").alias(id_col), F.coalesce("class_id", "_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("bigint").alias("n_copies"))
