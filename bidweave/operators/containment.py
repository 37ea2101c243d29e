"""Which texts contain which needles, through an index of words and character grams.

No text meets a needle that it can't contain. A needle is looked for by its longest word, and that by the one of its grams that
the fewest words of all texts have. So grams are made of the vocabulary only, words of texts are joined by equality
with the words that hold a needle's word, and whole texts are compared for needles of several words alone.

Up to ``FEW`` needles need no index: each text looks for them in order where it lies, and stops early; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidweave.functions.text import bound

#: Characters of a gram; shorter words are grams of their own length.
GRAM = 3
#: Needles up to which texts look for each of them; more go through the index. Both find the same.
FEW = 1_000
#: Needles that are looked for at a time, until one is found.
AT_ONCE = 16


def fingerprint(text: str | Column) -> Column:
    """Tells texts apart; null for null."""
    return F.sha2(text, 256)


def _words(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(text, r"\s+")), "")


def _grams(chars: Column, q: int | Column) -> Column:
    q = F.lit(q) if isinstance(q, int) else q
    runs = F.transform(F.sequence(F.lit(1), F.size(chars) - q + 1), lambda i: F.array_join(F.slice(chars, i, q), ""))
    return F.when(F.size(chars) >= q, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def _words_with(words: DataFrame, parts: DataFrame) -> DataFrame:
    """(word, part) for the words that contain a part."""
    own = parts.select("part", F.filter(F.split("part", ""), lambda c: c != "").alias("chars"))
    keys = own.select("part", F.explode(_grams(F.col("chars"), F.least(F.size("chars"), F.lit(GRAM)))).alias("gram"))
    chars = words.select("word", F.filter(F.split("word", ""), lambda c: c != "").alias("chars"))
    grams = chars.select("word", F.explode(F.flatten(F.array(*[_grams(F.col("chars"), q) for q in range(1, GRAM + 1)]))).alias("gram"))
    known = grams.join(keys.select("gram").distinct(), "gram", "left_semi")
    count = known.groupBy("gram").agg(F.count("*").alias("n"))
    # A gram that no word has rules its part out; it counts as the rarest.
    rarest = keys.join(count, "gram", "left").groupBy("part").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best"))
    return known.join(rarest.where("best.n > 0").select("part", F.col("best.gram").alias("gram")), "gram").where(F.contains("word", F.col("part"))).select("word", "part")


def containing(texts: DataFrame, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """(fingerprint, columns of ``needles``): each needle with each distinct text that contains it.

    Comparison is exact and by characters: a needle may begin and end inside words. Null and blank needles are in no text, and null texts contain none."""
    rows = texts.where(F.col(text).isNotNull()).select(fingerprint(text).alias("fingerprint"), F.col(text).alias("_text"))
    parted = needles.withColumn("_part", F.array_max(F.transform(_words(F.col(needle)), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]).where("_part IS NOT NULL")
    tokens = rows.select("fingerprint", F.explode(_words(F.col("_text"))).alias("word"))
    held = _words_with(tokens.select("word").distinct(), parted.select(F.col("_part").alias("part")).distinct())
    found = tokens.join(held, "word").select("fingerprint", F.col("part").alias("_part")).distinct().join(parted, "_part")
    whole = found.where(F.col(needle) == F.col("_part")).drop("_part")
    several = found.where(F.col(needle) != F.col("_part")).drop("_part")
    # Only here do texts move: those that hold the longest word of some needle.
    distinct = rows.groupBy("fingerprint").agg(F.first("_text").alias("_text"))
    return whole.unionByName(several.join(distinct, "fingerprint").where(F.contains("_text", F.col(needle))).drop("_text"))


def few(needles: DataFrame, needle: str, value: str) -> list[tuple] | None:
    """(needle, inner word, value) of the needles in order of their values if there are ``FEW`` at most, else None. The inner word, if there is one, is a whole word of each text that contains the needle."""
    words = F.split(F.col(needle), r"\s+")
    inner = F.when(F.size(words) > 2, F.array_max(F.transform(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"])
    # Spark orders them, as it does for the index: null first, NaN last.
    found = needles.where(F.size(_words(F.col(needle))) > 0).select(F.col(needle).alias("needle"), inner.alias("inner"), F.col(value).alias("value")).limit(FEW + 1).sort("value").collect()
    return [tuple(r) for r in found] if len(found) <= FEW else None


def first_held(text: str | Column, needles: list[tuple], kind: str) -> Column:
    """The value, of SQL type ``kind``, of the first (needle, inner word, value) that the text contains; null without one, or if that value is null."""
    one = lambda n, inner, v: F.struct(F.lit(n).alias("needle"), F.lit(inner).cast("string").alias("inner"), F.lit(v).cast(kind).alias("value"))
    chunks = [F.array(*[one(*n) for n in needles[i : i + AT_ONCE]]) for i in range(0, len(needles), AT_ONCE)]
    text = F.col(text) if isinstance(text, str) else text

    def first(t: Column) -> Column:
        holds = lambda n: (n["inner"].isNull() | F.array_contains(t["words"], n["inner"])) & F.contains(t["text"], n["needle"])
        return F.coalesce(*[F.get(F.filter(c, holds), F.lit(0)) for c in chunks])["value"]

    # Of the words of a text only those that some needle asks for are kept, by one look at each.
    asked = sorted({inner for _, inner, _ in needles if inner})
    words = F.array_intersect(F.split(text, r"\s+"), F.array(*map(F.lit, asked))) if asked else F.array().cast("array<string>")
    return bound(F.struct(text.alias("text"), words.alias("words")), first) if chunks else F.lit(None).cast(kind)
