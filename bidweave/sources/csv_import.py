"""CSV import of opportunities: header aliases, rejected rows with reasons, defaults, known notices skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidweave.functions.dates import permissive
from bidweave.functions.text import first_filled

#: Largest upload in bytes.
UPLOAD_LIMIT = 10 * 1024 * 1024

#: Accepted headers of each field, the first that is filled counts.
ALIASES = {
    "title": ["title", "opportunity title", "name"],
    "agency": ["agency", "department/ind. agency", "organization"],
    "notice_id": ["notice id", "noticeid"],
    "sub_agency": ["sub-agency", "subagency"],
    "type": ["type", "opportunity type", "notice type"],
    "naics_code": ["naics code", "naics"],
    "posted_date": ["posted date", "posteddate"],
    "response_deadline": ["response deadline", "response date", "deadline"],
    "set_aside": ["set aside", "setaside"],
    "place_of_performance": ["place of performance", "location"],
    "description": ["description"],
    "solicitation_number": ["solicitation number", "sol number"],
    "sam_url": ["url", "link", "sam url"],
}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a CSV file as text, headers trimmed and in lower case. Quotes double inside quotes; records don't span lines."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', mode="PERMISSIVE", multiLine=False)
    return raw.toDF(*[c.strip().lower() for c in raw.columns])


def parse_lines(lines: DataFrame, column: str, headers: list[str], keep: list[str] | None = None) -> DataFrame:
    """Lines of CSV text in a column, parsed as by read_csv; other columns named by ``keep`` stay."""
    names = [h.strip().lower() for h in headers]
    schema = ", ".join(f"`{n}` string" for n in names)
    parsed = F.from_csv(F.col(column), F.lit(schema), {"quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    return lines.select(*(keep or []), parsed.alias("_r")).select(*(keep or []), *[F.col("_r").getField(n).alias(n) for n in names])


def _field(df: DataFrame, field: str) -> Column:
    names = [n for n in ALIASES[field] if n in df.columns]
    return first_filled(*[F.trim(F.coalesce(F.col(f"`{n}`"), F.lit(""))) for n in names]) if names else F.lit(None).cast("string")


def to_records(rows: DataFrame, line: str, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Accepted records and rejected rows (line, message). ``line`` names the column of line numbers."""
    fields = {f: _field(rows, f) for f in ALIASES}
    shaped = rows.select(F.col(line).alias("line"), *[c.alias(f) for f, c in fields.items()])
    good = shaped.where(F.col("title").isNotNull()).withColumns(
        {
            "agency": F.coalesce("agency", F.lit("Unknown Agency")),
            "type": F.coalesce("type", F.lit("Solicitation")),
            "posted_date": F.coalesce(permissive(F.col("posted_date")), as_of),
            "response_deadline": permissive(F.col("response_deadline")),
            "status": F.lit("active"),
            "source": F.lit("csv_import"),
        }
    )
    bad = shaped.where(F.col("title").isNull()).select("line", F.concat(F.lit("Row "), F.col("line").cast("string"), F.lit(": missing title")).alias("message"))
    return good, bad


def new_notices(records: DataFrame, existing: DataFrame) -> DataFrame:
    """Records whose notice isn't stored yet; of records that repeat a notice the first line stays."""
    from bidweave.operators.dedupe import best_by

    named = best_by(records.where("notice_id is not null"), ["notice_id"], ["line"])
    fresh = named.join(existing.select("notice_id"), "notice_id", "left_anti")
    return fresh.select(*records.columns).unionByName(records.where("notice_id is null"))


def within_limit(spark: SparkSession, path: str) -> bool:
    """Whether the upload is small enough: file sizes from the listing, no data is read."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength() <= UPLOAD_LIMIT
