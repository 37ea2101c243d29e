"""Column functions over text: cleaning, extraction, ids and display. JVM expressions only."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


#: What counts as white space at the ends of a text.
SPACES = " \t\n\r\f\v\u00a0\ufeff"


def trimmed(value: Column | str) -> Column:
    """Without white space at either end, line feeds and no-break spaces included."""
    return F.btrim(as_col(value), F.lit(SPACES))


def blank_to_null(value: Column | str) -> Column:
    """Trimmed text; blank becomes null."""
    return F.nullif(trimmed(as_col(value)), F.lit(""))


def first_filled(*values: Column | str) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(as_col(v), F.lit("")) for v in values])


def joined(*values: Column | str, sep: str = " ") -> Column:
    """Lower-case text of several columns, nulls as empty, one separator between any two."""
    return F.lower(F.concat_ws(sep, *[F.coalesce(as_col(v), F.lit("")) for v in values]))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used, also inside other lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def has_any(text: Column, needles: Iterable[str]) -> Column:
    """Whether the text contains one of the needles. One pass over an array, not a chain of ORs."""
    listed = F.array(*[F.lit(n) for n in needles])
    return bound(text, lambda t: F.exists(listed, lambda n: F.contains(t, n)))


def found_in(text: Column, needles: Iterable[str]) -> Column:
    """The needles that the text contains, in list order."""
    listed = F.array(*[F.lit(n) for n in needles])
    return bound(text, lambda t: F.filter(listed, lambda n: F.contains(t, n)))


def first_found(text: Column, needles: Iterable[str]) -> Column:
    """The first needle of the list that the text contains; null without one."""
    return F.try_element_at(found_in(text, needles), F.lit(1))


def group(text: Column, pattern: str, index: int = 1) -> Column:
    """A group of the first match; null where nothing matches or the group is empty."""
    return F.nullif(F.regexp_extract(text, pattern, index), F.lit(""))


# --- URLs and ids ---------------------------------------------------------------------------------


def url_host(url: Column | str) -> Column:
    """Lower-case host without the first ``www.`` in it, wherever it stands; null for what is no URL."""
    host = F.lower(F.try_parse_url(as_col(url), F.lit("HOST")))
    return F.regexp_replace(host, r"^(.*?)www\.", "$1")


def url_domain(url: Column | str) -> Column:
    """Lower-case host without a leading ``www.``; null for what is no URL."""
    return F.regexp_replace(F.lower(F.try_parse_url(as_col(url), F.lit("HOST"))), r"^www\.", "")


def url_id(url: Column | str, prefix: str = "web") -> Column:
    """Prefix and the first 20 hex digits of the URL's SHA-256."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(as_col(url), 256), 1, 20))


def item_id(bucket: Column | str, *keys: Column | str) -> Column:
    """A UUID-shaped id from SHA-256 of ``bucket::key``; the key is the first that isn't null."""
    h = F.sha2(F.concat(as_col(bucket), F.lit("::"), F.coalesce(*[as_col(k) for k in keys])), 256)
    part = lambda start, n: F.substring(h, start + 1, n)
    return F.concat_ws("-", part(0, 8), part(8, 4), F.concat(F.lit("5"), part(13, 3)), part(16, 4), part(20, 12))


def short_base64(url: Column | str) -> Column:
    """First 16 characters of the URL in base64. Only 12 bytes count: never a key."""
    return F.substring(F.base64(F.encode(as_col(url), "UTF-8")), 1, 16)


def masked(secret: Column | str, shown: int = 4) -> Column:
    """All but the last characters as stars."""
    c = as_col(secret)
    return F.concat(F.repeat(F.lit("*"), F.greatest(F.lit(0), F.length(c) - shown)), F.right(c, F.lit(shown)))


# --- cleaning -------------------------------------------------------------------------------------


def strip_markdown(text: Column | str) -> Column:
    out = as_col(text)
    for pattern, by in ((r"#+\s*", ""), (r"\*+", ""), (r"\n+", " "), (r"\s{2,}", " ")):
        out = F.regexp_replace(out, pattern, by)
    return trimmed(out)


def strip_fences(text: Column | str) -> Column:
    """Model output without the Markdown fence around it."""
    return trimmed(F.regexp_replace(as_col(text), r"```(?:json)?\s*|```", ""))


def job_title(title: Column | str) -> Column:
    """A posting's title, cut at the first dash or bar, 150 characters at most."""
    return F.substring(trimmed(F.regexp_replace(as_col(title), r"(?s)\s*[-|–].*$", "")), 1, 150)


#: Legal forms, and the article, that are no part of a company's name.
LEGAL_FORMS = ["inc", "corp", "llc", "ltd", "co", "lp", "llp", "incorporated", "limited", "company", "the"]


def company_core(name: Column | str) -> Column:
    """A company's name without brackets, what follows a comma or period, and legal forms."""
    bare = F.regexp_replace(F.regexp_replace(as_col(name), r"\s*\(.*?\)\s*", " "), r"[,.].*$", "")
    return trimmed(F.regexp_replace(F.regexp_replace(bare, rf"(?i)\b({'|'.join(LEGAL_FORMS)})\b", ""), r"\s+", " "))


def html_text(html: Column | str) -> Column:
    """Text of a page: without scripts, styles, comments and tags; a few entities decoded; white space collapsed."""
    out = as_col(html)
    for tag in ("script", "style"):
        out = F.regexp_replace(out, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return trimmed(F.regexp_replace(out, r"\s+", " "))


def csv_list(text: Column | str) -> Column:
    """Upper-case elements of a comma-separated list, without blank ones."""
    return F.filter(F.transform(F.split(as_col(text), ","), lambda x: F.upper(trimmed(x))), lambda x: x != "")


# --- display --------------------------------------------------------------------------------------


def initials(name: Column | str) -> Column:
    """Upper-case first letters of the first two words."""
    parts = F.filter(F.split(trimmed(as_col(name)), r"\s+"), lambda w: w != "")
    return F.upper(F.array_join(F.transform(F.slice(parts, 1, 2), lambda w: F.substring(w, 1, 1)), ""))


def color_index(name: Column | str, colors: int = 6) -> Column:
    """Polynomial hash (31) of the characters, modulo 2^32, then modulo the number of colours."""
    chars = F.filter(F.split(as_col(name), ""), lambda c: c != "")
    h = F.aggregate(chars, F.lit(0).cast("bigint"), lambda a, c: F.pmod(a * 31 + F.ascii(c), F.lit(4294967296)))
    return F.pmod(h, F.lit(colors)).cast("int")


def display_label(code: Column | str, labels: dict[str, str]) -> Column:
    """The label of a code; without one, the code with a capital first letter."""
    c = as_col(code)
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(table, c), F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2))))


def money_short(amount: Column | str) -> Column:
    """$1.2M, $3.4K or $5; a dash for null. Half cents round up, as everywhere here."""
    c = as_col(amount).cast("double")
    tenth = lambda x: F.format_string("%.1f", F.floor(x * 10 + 0.5) / 10)
    return (
        F.when(c.isNull(), "—")
        .when(c >= 1_000_000, F.concat(F.lit("$"), tenth(c / 1_000_000), F.lit("M")))
        .when(c >= 1_000, F.concat(F.lit("$"), tenth(c / 1_000), F.lit("K")))
        .otherwise(F.concat(F.lit("$"), c.cast("bigint").cast("string")))
    )


def money_grouped(amount: Column | str) -> Column:
    """$ and thousands separators, two decimals."""
    return F.concat(F.lit("$"), F.format_number(as_col(amount).cast("double"), 2))


# --- extraction -----------------------------------------------------------------------------------

#: Names of months, and words beside which a date is a deadline.
MONTHS = "(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
LABELS = r"(?:due|deadline|closes?|closing|submit(?:tal)?(?:\s+date)?|proposals?\s+due|responses?\s+due|receipt\s+of\s+proposals?|bid\s+opening|due\s+date)"
#: Where a deadline stands, in the order in which it is looked for. The date is group 1; what may follow
#: it is consumed, not looked at, so that any engine can run these.
DEADLINE_PATTERNS = [
    rf"(?i){LABELS}[:\s]+({MONTHS}\s+\d{{1,2}},?\s*\d{{4}})",
    rf"(?i)({MONTHS}\s+\d{{1,2}},?\s*\d{{4}})\s*[–-]?\s*{LABELS}",
    rf"(?i){LABELS}[:\s]+(\d{{4}}-\d{{2}}-\d{{2}})",
    rf"(?i){LABELS}[:\s]+(\d{{1,2}}/\d{{1,2}}/\d{{4}})",
    rf"(?i)({MONTHS}\s+\d{{1,2}},?\s*20\d{{2}})",
]
#: Patterns of an agency's name, in order.
AGENCY_PATTERNS = [
    r"\bCity of ([A-Z][a-zA-Z\s]{2,30}?)(?:\s*[-–,.|]|\s+is\s|\s+RFP|\s+Request|\s+Bid|\z)",
    r"\bCounty of ([A-Z][a-zA-Z\s]{2,25}?)(?:\s*[-–,.|]|\s+is\s|\s+RFP|\s+Request|\z)",
    r"\b([A-Z][a-zA-Z]{2,25} County)\b",
    r"\b([A-Z][a-zA-Z]{2,25} City)\b",
    r"\bState of ([A-Z][a-zA-Z]{3,20})\b",
    r"\bDepartment of ([A-Z][a-zA-Z\s]{3,35}?)(?:\s*[-–,]|\z)",
    r"\bOffice of ([A-Z][a-zA-Z\s]{3,35}?)(?:\s*[-–,]|\z)",
    r"\b([A-Z][a-zA-Z\s]{3,30}?) (?:Authority|Commission|District|Agency|Administration|Board)\b",
]
AGENCY_STOP = r"(?i)^(Request|Bid|Contract|For|The|And|Or|Of|This|That|Any|All|Such)$"
#: Patterns for titles alone.
TITLE_AGENCY_PATTERNS = [
    r"\bCity of ([A-Z][a-zA-Z\s]{2,30}?)(?:\s+(?:RFP|Request|Bid|Contract|for|–|-)|\z)",
    r"\bCounty of ([A-Z][a-zA-Z\s]{2,20}?)(?:\s+(?:RFP|Request|Bid|Contract|for|–|-)|\z)",
    r"\b([A-Z][a-zA-Z]{2,20} County)\b",
    r"\b([A-Z][a-zA-Z]{2,20} City)\b",
    r"\bState of ([A-Z][a-zA-Z]{3,20})\b",
    r"^([A-Z][a-zA-Z]{3,30}(?:\s+[A-Z][a-zA-Z]{2,20})?)(?:\s+[-–]|\s+RFP|\s+Request)",
]
TITLE_STOP = r"(?i)^(Request|Bid|Contract|For|The|And|Or|Of)$"
RELATIVE_DATE = r"(?i)\b(\d{1,2}\s+(?:hour|day|week|month)s?\s+ago|\d{4}-\d{2}-\d{2}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2},?\s+\d{4})\b"
WIN_DATE = r"(?i)\b((?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4})\b|\b(\d{4})\b"


def date_of(text: Column) -> Column:
    """A date written as ISO, MM/DD/YYYY or month name, day, year; null for what is no date."""
    month = F.array_position(F.array(*[F.lit(m) for m in "jan feb mar apr may jun jul aug sep oct nov dec".split()]), F.lower(F.substring(F.regexp_extract(text, r"([A-Za-z]+)", 1), 1, 3)))
    named = F.concat_ws("-", group(text, r"(\d{4})$"), F.lpad(F.nullif(month, F.lit(0)).cast("string"), 2, "0"), F.lpad(group(text, r"[A-Za-z]\s*(\d{1,2})"), 2, "0"))
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text)
    slashed = F.when(
        text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"),
        F.concat_ws("-", group(text, r"(\d{4})$"), F.lpad(group(text, r"^(\d{1,2})"), 2, "0"), F.lpad(group(text, r"/(\d{1,2})/"), 2, "0")),
    )
    return F.try_to_timestamp(F.coalesce(iso, slashed, F.when(text.rlike("^[A-Za-z]"), named)), F.lit("yyyy-MM-dd")).cast("date")


def deadline(text: Column) -> Column:
    """The first pattern's date that parses and lies in 2024 to 2030."""
    found = F.array_compact(F.array(*[group(text, p) for p in DEADLINE_PATTERNS]))
    return F.try_element_at(F.filter(F.transform(found, date_of), lambda d: F.year(d).between(2024, 2030)), F.lit(1))


MONEY = r"(?i)\$\s*(\d{1,3}(?:,\d{3})*(?:\.\d+)?)\s*(million|M\b|billion|B\b|thousand|K\b)?"
DOLLARS = r"(?i)(\d{1,3}(?:,\d{3})+)\s+dollars?"


def estimated_value(text: Column) -> Column:
    """Money in a text: $1.5 million, $500K, 250,000 dollars; kept from a thousand to ten billion."""
    unit = F.lower(F.regexp_extract(text, MONEY, 2))
    number = lambda c: F.regexp_replace(c, ",", "").try_cast("double")
    times = F.when(unit.startswith("b"), 1e9).when(unit.startswith("m"), 1e6).when(unit.startswith("k") | (unit == "thousand"), 1e3).otherwise(1.0)
    valid = lambda v: F.when(v.between(1e3, 1e10), v)
    return F.coalesce(valid(number(F.regexp_extract(text, MONEY, 1)) * times), valid(number(F.regexp_extract(text, DOLLARS, 1))))


def _agency(text: Column, patterns: list[str], stop: str, longest: int) -> Column:
    names = F.array(*[trimmed(F.regexp_extract(text, p, 1)) for p in patterns])
    return F.try_element_at(F.filter(names, lambda n: F.length(n).between(3, longest) & ~n.rlike(stop)), F.lit(1))


def agency(text: Column) -> Column:
    return _agency(text, AGENCY_PATTERNS, AGENCY_STOP, 45)


def title_agency(title: Column) -> Column:
    return _agency(trimmed(F.regexp_replace(title, r"(?i)^\[(?:PDF|DOC)\]\s*", "")), TITLE_AGENCY_PATTERNS, TITLE_STOP, 40)


def millions(text: Column) -> Column:
    """A contract's value in millions; 0 without one. A bare number counts as dollars."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), ",", "")
    pattern = r"(?i)\$?([\d.]+)\s*(million|billion|M|B)?"
    number = F.regexp_extract(plain, pattern, 1).try_cast("double")
    unit = F.lower(F.regexp_extract(plain, pattern, 2))
    return F.coalesce(F.when(unit.startswith("b"), number * 1000).when(unit.startswith("m"), number).otherwise(number / 1_000_000), F.lit(0.0))


def period(text: Column) -> Column:
    """Qn YYYY, YYYY or Unknown, from a date in words."""
    plain = F.coalesce(text, F.lit(""))
    year = group(plain, r"\b(20\d{2})\b")
    month = F.lower(F.regexp_extract(plain, r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)", 1))
    at = F.array_position(F.array(*[F.lit(m) for m in "jan feb mar apr may jun jul aug sep oct nov dec".split()]), month)
    quarter = F.floor((at - 1) / 3) + 1
    return F.when(year.isNotNull() & (at > 0), F.concat(F.lit("Q"), quarter.cast("string"), F.lit(" "), year)).when(year.isNotNull(), year).otherwise("Unknown")
