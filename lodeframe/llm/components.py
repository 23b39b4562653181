"""Connected components by alternating large-star and small-star, as DataFrame rounds.

Edges are rows (a, b) of longs, any direction. Each round groups by a node for the
least neighbour (summed map-side, so a hub's edges meet no single task before that)
and joins the minima back (an equi-join that adaptive execution may split). Rounds
are written to the shared folder, in as many files as their edges need; only two numbers a round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.tables import scratch, written


#: edges in a file, and files of few edges; on a local folder, Hadoop starts processes from the executor for each file
FILE_EDGES, FILES = 1 << 18, 8


def _large_star(e: DataFrame) -> DataFrame:
    """Each node's larger neighbours hang on the least of its neighbourhood."""
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours hang on the least of them. Rows come with a > b."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    joined = e.join(least, "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge to another: component is the smallest node reachable.

    Nulls and loops are left out; an empty input gives no row. Rounds go on until none changes an edge.
    """
    spark = edges.sparkSession
    start = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    with scratch(spark):
        rows, before = written(start, "edges"), None
        files = FILES
        while True:
            state = tuple(rows.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
            if state == before or not state[0]:
                break
            before, files = state, max(FILES, -(-state[0] // FILE_EDGES))  # a round keeps about as many edges
            rows = written(_small_star(_large_star(rows)).coalesce(files), "edges")
        labels = rows.select(F.col("a").alias("node"), F.col("b").alias("component")).union(rows.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        return written(labels.coalesce(files), "components", keep=True)
