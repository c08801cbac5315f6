"""Column contracts for uploaded tables (IO1-IO5, P7).

All checks look at ``df.columns`` / the schema only (no job), except the
minimum-row guard, which reads at most ``n`` rows (``limit(n).count()``).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The upload contracts of the two applications.
SALES_REQUIRED = ("date", "product", "sales_qty")
SALES_DEFAULTS = {"store": "Store_Default", "promotion": 0, "price": 100.0}
REVIEW_TEXT_ALIASES = ("review", "text", "comment", "body")
REVIEW_REQUIRED = ("review_text",)
REVIEW_DEFAULTS = {"category": "General", "rating": 3, "helpful_votes": 0}


#: How CSV is read and written: fields in double quotes may hold commas, line ends
#: and doubled quotes; an empty field is null, an empty text is ``""``.
CSV = {"header": True, "quote": '"', "escape": '"', "emptyValue": '""', "nullValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
#: What the reader puts for an empty field, to tell it from an empty text.
_EMPTY_FIELD = "\x00"
_READ = {**CSV, "emptyValue": "", "nullValue": _EMPTY_FIELD, "multiLine": True, "enforceSchema": False}


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """IO1: CSV with a header, quoted fields over several lines included.

    Columns of a declared schema are found by header name, in any order and
    case, and cast; a cell that cannot be cast is null, and a column that the
    header lacks is null throughout (``require`` tells).  Without a schema the
    types are inferred.  Texts are read as text first, so no inference pass is
    made for a declared schema.
    """
    reader = spark.read.options(**_READ)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    texts = reader.csv(path)
    place = {normalise_header(c, spaces=False): c for c in reversed(texts.columns)}
    fields = (StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    return texts.select(*[_cell(place.get(normalise_header(f.name, spaces=False)), f) for f in fields])


def _cell(column: str | None, field) -> Column:
    if column is None:
        return F.lit(None).cast(field.dataType).alias(field.name)
    text = F.col(f"`{column}`")
    return (text if field.dataType.typeName() == "string" else F.trim(text).try_cast(field.dataType)).alias(field.name)


def read_csv_rejects(spark: SparkSession, path: str, schema: StructType | str, required=()) -> tuple[DataFrame, DataFrame]:
    """IO1 + IO4: the rows that fit a declared schema, and those set aside as
    (file, row_text, reason).

    A row is set aside if a ``required`` cell is null or empty, or if a cell
    has text that its type cannot hold; the reason names the columns in the
    order of the schema.  Header names are matched as in ``read_csv``; a file
    whose header lacks a required column has all of its rows set aside.
    """
    fields = (StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    texts = spark.read.options(**_READ).csv(path)
    place = {normalise_header(c, spaces=False): c for c in reversed(texts.columns)}
    cells = {f.name: _cell(place.get(normalise_header(f.name, spaces=False)), f) for f in fields}
    wrong = []
    for f in fields:
        own = place.get(normalise_header(f.name, spaces=False))
        given = F.trim(F.coalesce(F.col(f"`{own}`"), F.lit(""))) if own else F.lit("")
        if f.name in required:
            wrong.append(F.when(given == "", F.lit(f"{f.name} missing")))
        if own and f.dataType.typeName() != "string":
            wrong.append(F.when((given != "") & cells[f.name].isNull(), F.lit(f"{f.name} is no {f.dataType.simpleString()}")))
    reason = F.concat_ws(", ", *wrong) if wrong else F.lit("")
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in texts.columns]))
    rows = texts.select(*cells.values(), reason.alias("_reason"), F.input_file_name().alias("_file"), whole.alias("_row"))
    good = rows.where(F.col("_reason") == "").select(*[f.name for f in fields])
    return good, rows.where(F.col("_reason") != "").select(F.col("_file").alias("file"), F.col("_row").alias("row_text"), F.col("_reason").alias("reason"))


def normalise_header(name: str, spaces: bool = True) -> str:
    n = name.strip().lower()
    return re.sub(" ", "_", n) if spaces else n


def normalise_headers(df: DataFrame, spaces: bool = True) -> DataFrame:
    """IO2: lower-case, strip, spaces -> underscores (a rename, no job)."""
    return df.toDF(*[normalise_header(c, spaces) for c in df.columns])


def alias_first(df: DataFrame, target: str, candidates=REVIEW_TEXT_ALIASES) -> DataFrame:
    """IO3: rename the first present candidate to ``target``, only when the
    target itself is absent (never creates duplicate names)."""
    if target in df.columns:
        return df
    for c in candidates:
        if c in df.columns:
            return df.withColumnRenamed(c, target)
    return df


def require(df: DataFrame, required) -> DataFrame:
    """IO4: raise before any job when a required column is missing."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required column(s): {', '.join(missing)}")
    return df


def with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """IO5: add each missing column as a constant (present ones untouched)."""
    add = {c: F.lit(v) for c, v in defaults.items() if c not in df.columns}
    return df.withColumns(add) if add else df


def min_rows(df: DataFrame, n: int) -> DataFrame:
    """Refuse inputs with fewer than ``n`` rows (reads at most n rows)."""
    have = df.limit(n).count()
    if have < n:
        raise ValueError(f"need at least {n} rows, got {have}")
    return df


def sales_contract(df: DataFrame) -> DataFrame:
    """Sales upload: normalise -> require date/product/sales_qty -> defaults."""
    out = normalise_headers(df, spaces=False)
    out = require(out, SALES_REQUIRED)
    return with_defaults(out, SALES_DEFAULTS)


def review_contract(df: DataFrame) -> DataFrame:
    """Review upload: normalise -> alias text column -> require -> defaults.

    The sentiment label is derived afterwards (F13) from the defaulted
    rating, as in the reference, so a file with neither column is all
    Neutral.
    """
    out = normalise_headers(df, spaces=False)
    out = alias_first(out, "review_text")
    out = require(out, REVIEW_REQUIRED)
    return with_defaults(out, REVIEW_DEFAULTS)
