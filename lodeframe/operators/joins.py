"""Inner joins, and what a named join method means for Spark."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.functions import expr

#: method -> name in explain()
METHODS = {"nested-loops": "NLJoin", "block-nested-loops": "BNLJoin", "indexed": "IndexJoin", "hash": "HashJoin"}


def size_of(df: DataFrame) -> int:
    """Spark's own estimate of a result in bytes; very large where nothing is known."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits_broadcast(df: DataFrame) -> bool:
    """Whether the estimate is within the session's bound for broadcasts."""
    conf = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
    bound = int(df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf)) if not conf.startswith("-") else -1
    return size_of(df) <= bound


def joined(left: DataFrame, right: DataFrame, method: str, keys: list[tuple[str, str]], condition: str | None, in_buckets: bool = False) -> DataFrame:
    """Rows of both sides with equal keys for which the condition is true.

    The condition's equalities of a left and a right field become join keys in Spark's planner, so that a loop join with
    such a condition is dealt out by key. Where the smaller side's size is within the session's bound for broadcasts, it
    is sent whole and the larger side stays where it is. Beyond that the method decides: hash joins build hash tables of
    shuffled partitions, index joins merge inputs in key order or, where the right one lies in buckets of its key, build a hash
    table of each bucket, so that only the left one moves; loop joins are left to the planner.
    """
    struct = type(left.schema)([*left.schema, *right.schema])
    tests: list[Column] = [F.col(f"`{a}`") == F.col(f"`{b}`") for a, b in keys]
    if condition is not None:
        tests += [expr.predicate(c, struct) for c in expr.conjuncts(condition)]
    small = min((left, right), key=size_of)
    if method != "nested-loops" and fits_broadcast(small):
        left, right = (F.broadcast(left), right) if small is left else (left, F.broadcast(right))
    elif method == "hash":
        left, right = (left.hint("shuffle_hash"), right) if small is left else (left, right.hint("shuffle_hash"))
    elif method == "indexed":
        right = right.hint("shuffle_hash" if in_buckets else "merge")
    return left.join(right, reduce(lambda a, b: a & b, tests), "inner")
