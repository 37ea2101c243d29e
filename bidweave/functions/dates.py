"""Date functions. The present is always the parameter ``as_of``, so results can be repeated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bidweave.functions.text import bound

DAY_MICROS = 86_400_000_000


def stamp(value: Column | str) -> Column:
    """A timestamp with zone from one without, at the session's zone (UTC)."""
    return (F.col(value) if isinstance(value, str) else value).cast("timestamp")


def moment(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Whole days between two moments, rounded down also below zero. Not calendar days."""
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / DAY_MICROS)


#: Shapes of written dates and the formats they are read by, the first shape that fits; without commas, weekday and "GMT".
SHAPES = [
    (r"^\d{1,2}/\d{1,2}/\d{4}( \d{1,2}:\d{2}(:\d{2})?)?$", "M/d/yyyy[ H:mm[:ss]]"),
    (r"(?i)^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}(:\d{2})? [ap]m$", "M/d/yyyy h:mm[:ss] a"),
    (r"^\p{Alpha}{3} \d{1,2} \d{4}( \d{1,2}:\d{2}(:\d{2})?)?$", "MMM d yyyy[ H:mm[:ss]]"),
    (r"^\p{Alpha}{4,9} \d{1,2} \d{4}( \d{1,2}:\d{2}(:\d{2})?)?$", "MMMM d yyyy[ H:mm[:ss]]"),
    (r"^\d{1,2} \p{Alpha}{3} \d{4}( \d{1,2}:\d{2}(:\d{2})?)?$", "d MMM yyyy[ H:mm[:ss]]"),
    (r"^\d{1,2} \p{Alpha}{4,9} \d{4}( \d{1,2}:\d{2}(:\d{2})?)?$", "d MMMM yyyy[ H:mm[:ss]]"),
    (r"^\d{1,2} \p{Alpha}{3} \d{4} \d{1,2}:\d{2}:\d{2} [+-]\d{4}$", "d MMM yyyy H:mm:ss Z"),
]
ISO_SHAPE = r"^\d{4}(-\d{1,2}(-\d{1,2}([T ]\d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?( ?(Z|UTC|GMT|[+-]\d{2}:?\d{2}))?)?)?)?$"


def permissive(text: Column) -> Column:
    """The moment that a text names: ISO dates and date-times with fraction, offset or Z, month/day/year and dates with
    the month's name, with or without weekday and time. Null for blank or odd text. Without an offset the session's zone counts.

    The shape is told first, so each text is read by one format only."""

    def read(t: Column) -> Column:
        # Offsets may lack their colon, times their seconds.
        full = F.regexp_replace(F.regexp_replace(t, r"([+-]\d{2})(\d{2})$", "$1:$2"), r"([T ]\d{1,2}:\d{2})(?!:?\d)", "$1:00")
        plain = F.regexp_replace(F.regexp_replace(t, r"^\p{Alpha}{3,9}, *(?=\p{Alnum})|,| (?:GMT|UTC|Z)$", ""), " +", " ")
        return F.when(t.rlike(ISO_SHAPE), F.coalesce(t.try_cast("timestamp"), full.try_cast("timestamp"))).when(t != "", bound(plain, _shaped))

    return bound(F.btrim(text, F.lit(" \t\r\n")), read)


def _shaped(plain: Column) -> Column:
    out = None
    for shape, form in SHAPES:
        case = (plain.rlike(shape), F.try_to_timestamp(plain, F.lit(form)))
        out = F.when(*case) if out is None else out.when(*case)
    return out


def not_expired(deadline: Column, as_of: Column, grace_days: int = 1) -> Column:
    """No deadline, or one that passed less than the grace ago."""
    return deadline.isNull() | (deadline >= as_of - F.expr(f"INTERVAL {grace_days} DAY"))


def age_label(at: Column, as_of: Column) -> Column:
    days = elapsed_days(as_of, at)
    return F.when(at.isNull(), "Never").when(days == 0, "Today").when(days == 1, "Yesterday").when(days < 30, F.concat(days.cast("string"), F.lit("d ago"))).otherwise(F.date_format(at, "MMM d"))
