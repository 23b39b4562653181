"""Exact top-k by inner product: three phases with a uniform threshold.

A vector's components are cut into `lists` runs; a run's part of the inner product is
one local score list. A score is the sum of its local scores, so a row whose score is
at least tau has some local score of at least tau / lists.

1. Each block of queries gathers the heads of the local lists over one block of rows, scores these rows
   exactly, and takes the k-th best as a safe cutoff tau: k rows reach it.
2. The cutoffs go with the queries to all blocks of rows. A cell (a block of queries and a block of rows) collects the
   rows with a local score of at least tau / lists; for the others no sum can reach tau.
3. Of these, those whose upper bound (known local scores, and tau / lists for each
   list below the threshold) reaches tau have their remaining local scores added, exactly; the cell's k best
   raise its tau as it goes on, and go to the last merge.

So each cell is sent once and multiplied once. Blocks are single rows of bytes, of the narrowest number type that holds
their integers, and grow with the table up to `BLOCK_BYTES` and `QUERY_BYTES`; nothing grows with the whole table
in one task, on the driver or in a broadcast. Merges keep k rows a query and cell.

Components are floor(scale * x) as exact integers. Inner products are exact in single precision while dim * max|a| * max|b| < 2**24, in
double while it is below 2**53, else in Python integers, cut to the range of a long; a step of a cell decides for itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.llm.tables import partitions, scratch, written
from lodeframe.llm.vectors import finite

K, SCALE, LISTS = 5, 256, 4
#: least rows and queries of a block, and its most bytes in double precision
BLOCK, QUERY_BLOCK, BLOCK_BYTES, QUERY_BYTES = 4096, 1024, 1 << 27, 1 << 24
#: queries and rows that one step of a cell multiplies, and fewer in Python integers
STEP, LARGE_STEP = (256, 8192), (16, 512)


def _blocks(rows: DataFrame, least: int, most_bytes: int) -> DataFrame:
    """(dim, block, blocks, ids, places, kind, vecs): rows of one dimension in each block, as bytes.

    As many blocks as there are shuffle partitions, unless that makes them smaller than `least` or larger than `most_bytes`.
    """
    size = F.least(F.greatest(F.ceil(F.col("n") / partitions(rows.sparkSession)), F.lit(least)), F.greatest(F.lit(1), F.floor(F.lit(most_bytes) / (8 * F.col("dim")))))
    counts = rows.groupBy("dim").agg(F.count("*").alias("n")).select("dim", F.ceil(F.col("n") / size).cast("long").alias("blocks"))
    keyed = rows.join(counts, "dim").withColumn("block", F.pmod(F.xxhash64("place"), F.col("blocks")))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        vecs = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        most = np.abs(vecs).max()
        kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
        raw = [table.column(c).to_numpy().astype("<i8").tobytes() for c in ("id", "place")] + [vecs.astype(kind).tobytes()]
        out = {"dim": pa.array([key[0].as_py()], pa.int32()), "block": [key[1].as_py()], "blocks": [table.column("blocks")[0].as_py()], "kind": [kind]}
        return pa.table(out | {c: pa.array([x], pa.binary()) for c, x in zip(("ids", "places", "vecs"), raw, strict=True)})

    return keyed.groupBy("dim", "block").applyInArrow(run, "dim int, block long, blocks long, kind string, ids binary, places binary, vecs binary")


class Block:
    def __init__(self, dim: int, kind: str, ids: bytes, places: bytes, vecs: bytes):
        self.id, self.place = np.frombuffer(ids, "<i8"), np.frombuffer(places, "<i8")
        self.vec = np.frombuffer(vecs, kind).reshape(-1, dim)


def local_scores(q: np.ndarray, v: np.ndarray, lists: int) -> list[np.ndarray]:
    """The local score lists of queries q over rows v: exact numbers of the fastest kind that holds all sums."""
    dim = q.shape[1]
    most = dim * float(np.abs(q.astype(np.float64)).max()) * float(np.abs(v.astype(np.float64)).max())
    if most < 2.0**53:
        kind = np.float32 if most < 2.0**24 else np.float64
        q, v = q.astype(kind), v.astype(kind)
    else:
        q, v = (np.array([[int(x) for x in r] for r in m.tolist()], dtype=object).reshape(len(m), dim) for m in (q, v))
    return [q[:, c] @ v[:, c].T for c in np.array_split(np.arange(dim), min(lists, dim))]


class Best:
    """The k best (score, id, place) of each query so far: falling score, then rising id."""

    def __init__(self, n: int, k: int):
        self.k, self.query, self.rows = k, np.zeros(0, dtype=np.int64), []
        self.score, self.id = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.tau = np.full(n, np.nan)  # nan: not yet k rows

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if score.dtype == object:
            score = np.array([max(-(2**63), min(2**63 - 1, x)) for x in score.tolist()], dtype=np.int64)
        query, score, ids = (np.concatenate(x) for x in ((self.query, query), (self.score, score.astype(np.int64)), (self.id, ids)))
        order = np.lexsort((ids, ~score, query))  # ~ reverses the order of longs, without overflow
        query, score, ids = query[order], score[order], ids[order]
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        keep = nth < self.k
        last = nth == self.k - 1
        self.tau[query[last]] = np.fmax(self.tau[query[last]], _below(score[last]))
        self.query, self.score, self.id = query[keep], score[keep], ids[keep]


def _below(score: np.ndarray) -> np.ndarray:
    """Scores as doubles that are not above them."""
    out = score.astype(np.float64)
    return np.where(np.abs(out) < 2.0**52, out, np.nextafter(out, -np.inf))


def heads(parts: list[np.ndarray], own: np.ndarray, k: int) -> np.ndarray:
    """Which rows are among the k best of some local list."""
    seen, n = np.zeros(own.shape, dtype=bool), own.shape[1]
    for part in parts:
        low = np.iinfo(np.int64).min if part.dtype != object else -(10**400)
        part = np.where(own, low, part)
        top = np.argpartition(-part, k - 1, axis=1)[:, :k] if n > k and part.dtype != object else np.argsort(-part, axis=1)[:, :k]
        np.put_along_axis(seen, top, True, axis=1)
    return seen


def reaching(parts: list[np.ndarray], tau: np.ndarray) -> np.ndarray:
    """Rows that may reach a query's cutoff: a local score at the uniform threshold, and an upper bound at the cutoff."""
    limit = (tau / len(parts))[:, None]
    limit = limit - 1e-6 * np.abs(limit) - 1e-6  # tau / lists is rounded
    seen, bound = np.zeros(parts[0].shape, dtype=bool), np.zeros(parts[0].shape)
    for part in parts:
        part = part.astype(np.float64) if part.dtype == object else part
        above = part >= limit
        seen |= above
        bound += np.where(above, part, limit)
    reach = tau[:, None]
    return np.isnan(reach) | seen & (bound + 1e-6 * np.abs(reach) + 1e-3 >= reach)


def resolve(q: Block, v: Block, tau: np.ndarray | None, k: int, lists: int) -> Best:
    """The k best rows of v for each query of q: of the heads of local lists (tau None), or of all rows that reach tau."""
    best = Best(len(q.id), k)
    if tau is not None:
        best.tau[:] = tau
    huge = q.vec.dtype.kind == "f" or v.vec.dtype.kind == "f"
    a, b = LARGE_STEP if huge else STEP
    for i in range(0, len(q.id), a):
        for j in range(0, len(v.id), b):
            parts = local_scores(q.vec[i : i + a], v.vec[j : j + b], lists)
            own = q.place[i : i + a, None] == v.place[None, j : j + b]
            take = heads(parts, own, k) if tau is None else reaching(parts, best.tau[i : i + a])
            x, y = np.nonzero(take & ~own)
            best.add(x + i, sum(p[x, y] for p in parts), v.id[y + j])
    return best


def search(rows: DataFrame, is_query: str | Column, k: int = K, scale: float = SCALE, lists: int = LISTS, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row its k best other rows, ties to the smaller id.

    is_query is a condition over `id`. Defined cases: a null id, a null or empty vector or one
    with a null or non-finite component takes no part, as query or row; vectors meet
    those of their own dimension only; rows are told apart as rows: those that repeat an id, or repeat as a whole, are each a
    query and a candidate for all others; fewer than k other rows give fewer results; an empty table gives no row; further columns,
    whatever their names, are left out.
    """
    spark = rows.sparkSession
    with scratch(spark):
        usable = finite(rows, id_col, vec_col)
        usable = usable.select(F.monotonically_increasing_id().alias("place"), "id", "dim", F.transform("vec", lambda x: _floor(x * scale)).alias("vec"))
        usable = written(usable, "ints")  # fixes the rows' places
        data = written(_blocks(usable, block, BLOCK_BYTES), "blocks")
        asked = written(_blocks(usable.filter(is_query), query_block, QUERY_BYTES), "queries")
        asked = asked.select("dim", F.col("block").alias("qb"), F.col("blocks").alias("qbs"), *(F.col(c).alias(f"q{c}") for c in ("kind", "ids", "places", "vecs")))
        here = data.groupBy("dim").agg(F.max("blocks").alias("blocks"))
        there = asked.groupBy("dim").agg(F.max("qbs").alias("qbs"))

        def both(r: dict) -> tuple[Block, Block]:
            return Block(r["dim"], r["qkind"], r["qids"], r["qplaces"], r["qvecs"]), Block(r["dim"], r["kind"], r["ids"], r["places"], r["vecs"])

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    q, v = both(r)
                    tau = resolve(q, v, None, k, lists).tau
                    yield pa.RecordBatch.from_arrays([pa.array([r["dim"]], pa.int32()), pa.array([r["qb"]], pa.int64()), pa.array([tau.tobytes()], pa.binary())], ["dim", "qb", "tau"])

        def two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    q, v = both(r)
                    best = resolve(q, v, np.frombuffer(r["tau"], "<f8"), k, lists)
                    cols = (q.place[best.query], q.id[best.query], best.id, best.score)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], ["place", "query_id", "vec_id", "score"])

        blobs = ["dim", "qb", "block", "qkind", "qids", "qplaces", "qvecs", "kind", "ids", "places", "vecs"]
        pilot = asked.join(here, "dim").withColumn("block", F.pmod("qb", "blocks")).drop("blocks").join(data, ["dim", "block"]).select(*blobs)
        cutoffs = written(pilot.mapInArrow(one, "dim int, qb long, tau binary"), "cutoffs")
        # every block of rows meets every block of queries of its dimension: both are spread over the numbers of the other
        left = asked.join(cutoffs, ["dim", "qb"]).join(here, "dim").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
        right = data.join(there, "dim").withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("qbs") - 1))).drop("qbs")
        cells = left.join(right, ["dim", "block", "qb"]).select(*blobs, "tau")
        found = cells.mapInArrow(two, "place long, query_id long, vec_id long, score long")
        order = Window.partitionBy("place").orderBy(F.desc("score"), "vec_id")  # k rows a cell
        result = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        return written(result.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "topk", keep=True)


def _floor(x):
    """floor as a double, for numbers beyond the range of a long too."""
    whole = F.rint(x)
    return F.when(F.abs(x) < 2.0**52, F.when(whole > x, whole - 1).otherwise(whole)).otherwise(x) + 0.0


ORACLE = """
WITH usable AS (
  SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.place, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND q.place <> c.place),
ranked AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
