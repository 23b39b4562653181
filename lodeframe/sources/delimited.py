"""Delimited text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.functions.types import PADDING, Schema

#: letters of a format string: whole number, number, string, date (as yyyymmdd)
FORMATS = "idst"


def read(spark: SparkSession, path: str, schema: Schema, formats: str | None = None, separator: str = "|") -> DataFrame:
    """A file of separated fields without header or quotes, in the schema's types.

    Ends of strings lose NULs, spaces and line ends; their starts keep spaces. A date field holds yyyy-mm-dd and
    becomes a whole number. A field that isn't of its type is an error.
    """
    formats = formats or "".join("s" if t.is_text else "d" if t.kind in ("float", "double") else "i" for _, t in schema.fields)
    wrong = set(formats) - set(FORMATS)
    if wrong or len(formats) != len(schema.fields):
        raise ValueError(f"{formats!r} is not a format of {len(schema.fields)} fields")
    raw = spark.read.csv(path, sep=separator, schema=T.StructType([T.StructField(f, T.StringType()) for f in schema.names]), quote="", escape="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="")
    out = []
    for (name, kind), f in zip(schema.fields, formats, strict=True):
        c = F.coalesce(F.col(f"`{name}`"), F.lit("")) if f == "s" else F.trim(F.col(f"`{name}`"))
        if f == "s":
            c = F.rtrim(c, F.lit(PADDING + "\r"))
        elif f == "t":
            c = F.date_format(F.to_date(c, "yyyy-MM-dd"), "yyyyMMdd").cast("int")
        out.append(kind.column(c.cast("double") if f == "d" else c).alias(name))
    return raw.select(*out)


def sampled(df: DataFrame, share: float, seed: int = 12345) -> DataFrame:
    """About `share` of the rows."""
    return df if share >= 1 else df.sample(fraction=share, seed=seed)
