"""Phrase collocation mining: Apriori passes, level by level, then the weakest cut of each phrase.

Pass k counts the k-grams of whole texts of which both overlapping (k-1)-grams are frequent. What is frequent goes to the
tasks as a filter of bits of bounded size: a (k-1)-gram that it lets through by mistake only costs a count, because no
k-gram can be more frequent than its parts. A task counts the words of several texts at a time under small numbers, so
that few rows leave it; Spark adds them up, partially before the shuffle. Scores follow from joins of the level tables.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidweave.llm.common import cut_lineage, prepare, sliced, text_or_empty

UNKNOWN = "und"
#: What ends a piece, and what separates words.
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
GAPS = b"\x20\x09"
#: Lower-cases A-Z, makes every end of a piece a line feed and every gap a blank.
TABLE = bytes(10 if b in PIECE_ENDS else 32 if b in GAPS else b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Bytes of text whose words are counted together, and that are split at once.
TOGETHER, AT_ONCE = 8 << 20, 1 << 20
#: Bits of a filter: at least 16 for each frequent gram, up to this many (32 MB).
FEWEST_BITS, MOST_BITS = 1 << 20, 1 << 28
#: Parts of a language that choose their best phrases by themselves, before these meet.
PARTS = 64


class Filter:
    """Two bits for each frequent gram of a language; knows no false negatives."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def has(self, lang: bytes, grams: list[bytes]) -> np.ndarray:
        hashes = np.fromiter((xxhash.xxh64_intdigest(lang + b"\0" + g, 42) for g in grams), np.uint64, len(grams))
        most = np.uint64(64 * len(self.words) - 1)
        bit = lambda at: self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1) > 0
        return bit(hashes & most) & bit(hashes >> np.uint64(32) & most)


def frequent_filter(level: DataFrame) -> Filter:
    """The filter of a level's (lang, phrase). Bits are gathered by Spark; the driver takes MOST_BITS / 64 rows at most."""
    bits = min(MOST_BITS, max(FEWEST_BITS, 1 << (16 * level.count()).bit_length()))
    hashed = F.xxhash64(F.concat("lang", F.lit("\0"), "phrase"))
    spots = F.array(hashed.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(hashed, 32).bitwiseAND(F.lit(bits - 1)))
    rows = level.select(F.explode(spots).alias("at")).select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, CAST(at & 63 AS INT))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return Filter(words)


def _numbered(texts: list[str], numbers: defaultdict) -> np.ndarray:
    """The words of the texts as numbers, in order; -1 ends a piece. Long texts are split in parts that end at a gap or a piece's end."""
    found = []
    for text in texts:
        raw = text.encode().translate(TABLE)
        start = 0
        while start < len(raw):
            end = start + AT_ONCE
            if end < len(raw):
                ends = [e for e in (raw.find(b" ", end), raw.find(b"\n", end)) if e >= 0]
                end = min(ends) if ends else len(raw)
            tokens = filter(None, raw[start:end].replace(b"\n", b" \n ").split(b" "))
            found.append(np.fromiter(map(numbers.__getitem__, tokens), np.int64))
            start = end
        found.append(np.array([-1]))
    return np.concatenate(found)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place and count of each distinct key, and each key's number among them."""
    _, first, back, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    return first, counts, back


def counted(texts: list[str], lang: str, k: int, filters: list[Filter]) -> tuple[list[bytes], np.ndarray, int]:
    """The k-grams of the texts whose parts pass the filters of the levels below, with their counts; the number of words."""
    numbers: defaultdict = defaultdict(count().__next__)
    numbers[b"\n"]  # becomes 0, so that it can be told from words
    ids = _numbered(texts, numbers)
    ids[ids == 0] = -1
    names = list(numbers)
    total = int(np.count_nonzero(ids > 0))
    if k == 1:
        counts = np.bincount(ids[ids > 0], minlength=len(names))
        return names[1:], counts[1:], total
    tag = lang.encode()
    known = np.concatenate([[False], filters[0].has(tag, names[1:]), [False]])  # the last one stands for -1
    starts = np.flatnonzero(known[ids[:-1]] & known[ids[1:]])
    pairs = ids[starts] * len(names) + ids[starts + 1]
    firsts, counts, back = _distinct(pairs)
    grams = [names[a] + b" " + names[b] for a, b in zip(ids[starts[firsts]].tolist(), ids[starts[firsts] + 1].tolist())]
    for level in range(3, k + 1):
        # A gram of this level starts where two of the level below overlap, both let through.
        fine = filters[level - 2].has(tag, grams)[back] if len(grams) else np.zeros(0, bool)
        both = np.flatnonzero(fine[:-1] & fine[1:] & (starts[1:] == starts[:-1] + 1))
        last = ids[starts[both] + level - 1]
        head = back[both]
        firsts, counts, back = _distinct(head * len(names) + last)
        grams = [grams[h] + b" " + names[w] for h, w in zip(head[firsts].tolist(), last[firsts].tolist())]
        starts = starts[both]
    return grams, counts, total


def _counting(k: int, filters):
    """Rows (lang, phrase, n) for each few texts; of the first pass also the number of words, with a null phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [f.value for f in filters]
        waiting: dict[str, list[str]] = defaultdict(list)
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, texts in waiting.items():
                grams, counts, total = counted(texts, lang, k, known)
                if k == 1:
                    grams, counts = [*grams, None], np.append(counts, total)
                for at in range(0, len(grams), 1 << 17):
                    part = grams[at : at + (1 << 17)]
                    columns = [pa.array([lang] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string()), pa.array(counts[at : at + len(part)], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "n"])
            waiting.clear()

        for batch in sliced(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                waiting[lang].append(text)
                size += len(text)
                if size >= TOGETHER:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


def levels(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 3, least: int = 10) -> tuple[DataFrame, list[DataFrame]]:
    """The words of each language (lang, n), and for each k up to ``longest`` the k-grams (lang, phrase, f) with f >= ``least``."""
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), text_or_empty(text_col).alias("text"))
    totals, found, filters = None, [], []
    for k in range(1, longest + 1):
        rows = texts.mapInArrow(_counting(k, filters), "lang string, phrase string, n bigint")
        # Summed partially in each task, so that the commonest word sends one row from each.
        sums = cut_lineage(rows.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where((F.col("f") >= least) | F.col("phrase").isNull()))
        if k == 1:
            totals = sums.where("phrase IS NULL").select("lang", F.col("f").alias("n"))
        found.append(sums.where("phrase IS NOT NULL"))
        if k < longest:
            filters.append(spark.sparkContext.broadcast(frequent_filter(found[-1])))
    return totals, found


def _part(words: Column, start: int, size: int) -> Column:
    return F.array_join(F.slice(words, start + 1, size), " ")


def scored(found: list[DataFrame], k: int) -> DataFrame:
    """The k-grams (lang, phrase, a, l, r, score) of a level: of their cuts the one with the least score counts, of equal ones the first."""
    rows = found[k - 1].select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    for cut in range(1, k):
        for side, start, size in (("l", 0, cut), ("r", cut, k - cut)):
            parts = found[size - 1].select("lang", F.col("phrase").alias("_part"), F.col("f").alias(f"{side}{cut}"))
            rows = rows.withColumn("_part", _part(F.col("w"), start, size)).join(parts, ["lang", "_part"]).drop("_part")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    rows = rows.withColumns({f"top{cut}": (wide("a") * wide("a") * F.lit(1_000_000)).cast("decimal(38,0)") for cut in range(1, k)})
    cuts = [F.struct(F.expr(f"top{c} div (CAST(l{c} AS DECIMAL(19,0)) * CAST(r{c} AS DECIMAL(19,0)))").alias("score"), F.lit(c).alias("cut"), F.col(f"l{c}").alias("l"), F.col(f"r{c}").alias("r")) for c in range(1, k)]
    return rows.withColumn("best", F.array_min(F.array(*cuts))).select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def covered(found: list[DataFrame], k: int, percent: int = 50) -> DataFrame:
    """The k-grams (lang, phrase) that lie inside a longer one with ``percent`` of their count or more."""
    inside = None
    for longer in range(k + 1, len(found) + 1):
        w = F.split("phrase", " ")
        parts = found[longer - 1].select("lang", F.explode(F.array(*[_part(w, i, k) for i in range(longer - k + 1)])).alias("phrase"), "f")
        inside = parts if inside is None else inside.unionByName(parts)
    most = inside.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    return found[k - 1].join(most, ["lang", "phrase"]).where(F.col("longer") * 100 >= F.col("f") * percent).select("lang", "phrase")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 3, least: int = 10, percent: int = 50, first: int = 2000) -> DataFrame:
    """The ``first`` phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    A phrase is a run of 2 to ``longest`` words inside a piece, a its occurrences, ``least`` or more; overlaps count. Cut after some
    word, its parts occur l and r times and score floor(1000000 a a / (l r)); the least score counts, of equal ones that of the first cut. A phrase inside a longer one with ``percent`` of its count is left out.
    Ranks go by score and a, both falling, then by the bytes of the phrase. n is the number of words of the language.

    Null texts count as empty and a null language as ``und``; texts without words add nothing. Repeated rows count each time. Texts
    of any length are taken whole, and so are very long words. An empty table gives no rows. Other columns are left out, so their names can't clash.
    Numbers are exact: decimals of 38 digits, enough for counts up to 10 to the 16."""
    totals, found = levels(docs, text_col, lang_col, longest, least)
    kept = None
    for k in range(2, longest + 1):
        rows = scored(found, k)
        if k < longest:
            rows = rows.join(covered(found, k, percent), ["lang", "phrase"], "left_anti")
        kept = rows if kept is None else kept.unionByName(rows)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First inside parts of a language, so that no task orders all phrases of a language.
    near = Window.partitionBy("lang", "_p").orderBy(*order)
    some = kept.withColumn("_p", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= first)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= first)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
