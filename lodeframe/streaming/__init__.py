"""Plans over streams.

A plan becomes a DataFrame, so its scans may read a stream: select, project, union and joins with stored
relations run on each micro-batch as they do on a table. The engine's model is bounded, so there are
no windows or watermarks of its own; add Spark's to the DataFrame this returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodeframe.plans import Plan


def over_stream(plan: Plan, **streams: DataFrame) -> DataFrame:
    """The plan's result with these relations read from streams."""
    unknown = set(streams) - set(plan.relations())
    if unknown:
        raise ValueError(f"the plan doesn't read {', '.join(sorted(unknown))}")
    return plan.dataframe(**streams)


def run(plan: Plan, path: str, checkpoint: str, **streams: DataFrame) -> StreamingQuery:
    """Append the plan's rows to Parquet files at `path` until the streams have no more for now."""
    return over_stream(plan, **streams).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
