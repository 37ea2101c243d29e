"""Secret scan: fixed patterns, and sliding-window Shannon entropy over candidate strings.

Everything is JVM expressions within one row; there is no shuffle. Offsets come from
splitting a text at a pattern's matches: a match starts after all pieces and matches before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pattern, index of the group that is measured, its least length; in the order of kinds.
BASE_KINDS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 20),
    # A run of hex digits is taken whole, so asking for 24 at once gives the same matches as dropping short runs.
    "hex": (r"([0-9a-f]{24,})", 1, 24),
}
#: Candidates of the entropy scan: unbroken strings, with digits or without.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])([A-Za-z0-9+/_=-]{20,})"
#: Character classes of candidates, first match counts: pattern, window, least entropy in bits of some window.
CLASSES = [(r"^[0-9a-fA-F]+$", 20, 3.0), (r"^[A-Za-z0-9]+$", 20, 3.6), (r"^[A-Za-z0-9+/_=-]+$", 20, 3.8)]
#: Strings that have one of these shapes as a whole are no secrets: UUIDs, plain numbers and dates, names of lower-case words with a number or without, placeholders.
#: Repetitions are possessive, so that Java neither calls itself once for each nor goes back: patterns here take linear time and no stack.
ALLOW = [
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^[0-9=_+/-]+$",
    r"^[a-z]++(?:[-_/][a-z]++)*+[-_/]?[0-9]{0,6}$",
    r"(?i)^(?=.*(?:example|placeholder|changeme|xxxx)[a-z_=/-]{0,12}[0-9]{0,4}$)[a-z_=/-]++[0-9]{0,4}$",
    r"(?i)^[a-z_=/-]*+(?:0{4,}+|1234567)[a-z_=/-]{0,12}[0-9]{0,4}$",
]

SPAN = "struct<start:int,ord:int,end:int>"


def running(values: Column, join=lambda x, y: x + y) -> Column:
    """Sums (or what ``join`` makes) of the values up to each place, by doubling distances; no list is grown element by element."""
    last = F.size(values)
    distances = F.when(last > 1, F.transform(F.sequence(F.lit(0), F.floor(F.log2(last - F.lit(0.5))).cast("int")), lambda k: F.pow(F.lit(2.0), k).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(distances, values, lambda acc, d: F.transform(acc, lambda x, i: F.when(i >= d, join(x, F.get(acc, i - d))).otherwise(x)))


def outside(spans: Column, others: Column) -> Column:
    """The spans that lie inside none of the others, which are sorted by start. By halving, not by pairs."""
    reach = lambda o: F.struct(F.transform(o, lambda x: x["start"]).alias("start"), running(F.transform(o, lambda x: x["end"]), F.greatest).alias("end"))
    steps = [1 << k for k in range(30, -1, -1)]

    def kept(r: Column) -> Column:
        # how many of the others begin at or before a span
        before = lambda a: F.aggregate(F.array(*[F.lit(d) for d in steps]), F.lit(0), lambda n, d: F.when((d <= F.size(r["start"]) - n) & (F.get(r["start"], n + d - 1) <= a["start"]), n + d).otherwise(n))
        return F.filter(spans, lambda a: ~F.coalesce(F.get(r["end"], before(a) - 1) >= a["end"], F.lit(False)))

    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).otherwise(bound(reach(others), kept))


def _placed(text: Column, pattern: str, group: int) -> Column:
    """Matches in order: start, end, and the group. A match starts after all pieces and matches before it."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = F.arrays_zip(whole.alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("g"), F.slice(F.split(text, pattern, -1), 1, F.size(whole)).alias("p"))
    # Bound once, as a one-element array, so that neither the matches nor their ends are made again.
    bound = F.transform(F.array(found), lambda f: F.struct(f.alias("f"), running(F.transform(f, lambda x: F.length(x["p"]) + F.length(x["m"]))).alias("e")))
    return F.flatten(F.transform(bound, lambda b: F.zip_with(b["f"], b["e"], lambda x, e: F.struct((e - F.length(x["m"])).alias("at"), e.alias("end"), x["g"].alias("g")))))


def _matches(text: Column, pattern: str, group: int, least: int, order: int) -> Column:
    """Spans of a pattern's matches whose group is long enough."""
    spans = F.transform(F.filter(_placed(text, pattern, group), lambda x: F.length(x["g"]) >= least), lambda x: F.struct(x["at"].alias("start"), F.lit(order).alias("ord"), x["end"].alias("end")))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def _weight(n: Column) -> Column:
    """n log2 n, 0 for 0: entropy of a window of w is log2 w minus the sum of these over w."""
    return F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


def window_span(s: Column, window: int, bits: float) -> Column:
    """First start and last end of the windows of ``s`` with at least ``bits`` of entropy; null if none.

    The sum that gives a window's entropy is kept up to date as the window moves by one: only the counts of the character
    that leaves and of the one that enters change."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    first = F.substring(s, 1, window)
    count = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    total = F.aggregate(F.array_distinct(F.slice(chars, 1, window)), F.lit(0.0), lambda a, c: a + _weight(count(first, c)))
    enough = lambda t: F.lit(1e-9) + F.log2(F.lit(float(window))) - t / window >= bits
    none = F.lit(None).cast("int")
    begin = F.struct(first.alias("text"), F.lit(0).alias("at"), total.alias("t"), F.when(enough(total), 0).otherwise(none).alias("lo"), F.when(enough(total), window).otherwise(none).alias("hi"))

    def step(acc: Column, new: Column) -> Column:
        old = F.left(acc["text"], F.lit(1))
        n_old, n_new = count(acc["text"], old), count(acc["text"], new)
        t = F.when(old == new, acc["t"]).otherwise(acc["t"] - _weight(n_old) + _weight(n_old - 1) - _weight(n_new) + _weight(n_new + 1))
        at = acc["at"] + 1
        moved = F.struct(F.concat(F.substring(acc["text"], 2, window), new).alias("text"), at.alias("at"), t.alias("t"), acc["lo"].alias("lo"), acc["hi"].alias("hi"))
        # The sum is made once, though three fields follow from it.
        return bound(moved, lambda m: F.struct(m["text"].alias("text"), m["at"].alias("at"), m["t"].alias("t"), F.coalesce(m["lo"], F.when(enough(m["t"]), m["at"])).alias("lo"), F.when(enough(m["t"]), m["at"] + window).otherwise(m["hi"]).alias("hi")))

    rest = F.slice(chars, F.lit(window + 1), F.greatest(F.size(chars) - window, F.lit(0)))
    return F.aggregate(rest, begin, step, lambda acc: F.when(acc["lo"].isNotNull(), F.struct(acc["lo"].alias("lo"), acc["hi"].alias("hi"))))


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _entropy_spans(text: Column, allow: list[str], order: int) -> Column:
    """Spans of the parts of candidates whose windows are random enough for their class."""
    suspicious = F.filter(_placed(text, CANDIDATE, 1), lambda c: ~_any(c["g"], allow))

    def span(c: Column) -> Column:
        best = None
        for pattern, window, bits in CLASSES:
            one = (c["g"].rlike(pattern), window_span(c["g"], window, bits))
            best = F.when(*one) if best is None else best.when(*one)
        return F.struct(c["at"].alias("at"), best.alias("w"))

    hot = F.filter(F.transform(suspicious, span), lambda x: x["w"].isNotNull())
    spans = F.transform(hot, lambda x: F.struct((x["at"] + x["w"]["lo"]).alias("start"), F.lit(order).alias("ord"), (x["at"] + x["w"]["hi"]).alias("end")))
    return F.when(text.rlike(CANDIDATE), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def _any(text: Column, patterns: list[str]) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | text.rlike(p)
    return found


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: list[str] | None = None) -> DataFrame:
    """One row per input row: the id column, base (spans of the fixed kinds) and entropy (added spans).

    Both are arrays of (start, ord, end) in code points, end exclusive, sorted; ord numbers
    the kinds of KINDS. ``allow`` replaces the allow-list of ALLOW, which only suppresses
    added spans. A span that lies inside a base span isn't added. Null counts as the empty
    text and has none; repeated rows each give a row; an empty table gives none; other columns
    are left out. Long texts are scanned whole.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    arrays = [_matches(F.col("_text"), *spec, i) for i, spec in enumerate(BASE_KINDS.values())]
    added = _entropy_spans(F.col("_text"), ALLOW if allow is None else allow, len(BASE_KINDS))
    return (
        docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
        .select("_id", F.array_sort(F.concat(*arrays)).alias("base"), added.alias("_added"))
        .select(F.col("_id").alias(id_col), "base", outside(F.col("_added"), F.col("base")).alias("entropy"))
    )


KINDS = [*BASE_KINDS, "entropy"]


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["ord"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
