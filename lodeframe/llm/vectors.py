"""Vectors as fixed-width bytes, shared by the two operators on embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id long, vec array<double>, dim int) of rows whose id and vector are not null and whose components are all finite numbers; vectors without components are left out."""
    v = F.col("vec")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    out = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return out.filter(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad).withColumn("dim", F.size(v))
