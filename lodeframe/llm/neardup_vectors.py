"""Near-duplicate vectors through a pivot-permutation index.

Reference points (pivots) are a bounded sample of the vectors, of which no two are close:
else a dense group would fill its members' prefixes with pivots of its own, chosen by
small residuals, and linked members would share none. Each vector is described by its `prefix` nearest pivots in
order, and stands in the inverted lists of the first `lists` of them. Two vectors are retrieved when they meet in a list, and are
candidates when their whole prefixes share at least `shared` pivots, counted over inverted lists of the blocks that meet; only
candidates are verified, by cosine in double precision. Every vector is indexed; only the pivots come from a sample. Where few
vectors are apart there are few pivots, and prefixes are shorter (`SETTINGS`).

There are 2 * sqrt(rows) pivots, up to `MOST_PIVOTS` and `MOST_BYTES`, so that lists grow with the square root of the table
up to 2.7 * 10**8 rows of 64 components. Lists are split in blocks, and pairs of blocks are the units of work (cells), so a list
of any length is shared out. A pair that meets in several lists counts in that of its
least shared pivot only. Cells return numbers of links and a star of edges for each group of
linked vectors they see, not pairs. Equal vectors are one head with a multiplicity.

Defined cases: rows with null ids and vectors that are null, empty, zero or hold null or
non-finite components link with nothing (they are returned with 0 links, and kept);
vectors of different dimension don't link; rows that repeat an id are rows of their own, each with its own vector, so they may
have different components, and link with one another if their vectors do; ties at the threshold link; an
empty table gives no row; further columns, whatever their names, are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.components import components
from lodeframe.llm.tables import scratch, written
from lodeframe.llm.vectors import finite

COSINE, BLOCK = 0.9, 2048
#: from so many pivots on: length of a prefix, how many of its pivots have the vector in their lists, and how many two prefixes share at
#: least. Of pairs with a cosine of 0.905 in 12 and 64 dimensions these find 95 % with 8 pivots, and 98.6 % or more with 16 to 4,096
SETTINGS = ((256, 16, 8, 5), (128, 16, 8, 6), (64, 12, 8, 6), (32, 10, 6, 5), (16, 8, 6, 5), (8, 6, 4, 4), (0, 4, 4, 1))
#: pivots have a cosine below this to each other; they are chosen from up to SPARE times as many vectors
APART, SPARE = 0.7, 4
#: bounds of the pivots, and of the bytes of their sample as doubles
MOST_PIVOTS, MOST_BYTES = 32768, 64 << 20
#: pairs that one step verifies
STEP = 1 << 16
#: a pivot's lists are long if they hold one in LONG of the pairs; so many of these pivots are counted in one product
LONG, TOGETHER = 32, 256


def pivot_count(n: int, dim: int, most_bytes: int = MOST_BYTES) -> int:
    """Grows with the square root of the table, so that lists and pivots grow alike, up to the bounds."""
    return max(1, min(MOST_PIVOTS, most_bytes // (8 * dim), max(256, 2 * math.isqrt(n)), n))


def apart(x: np.ndarray, most: int, cosine: float = APART) -> np.ndarray:
    """The first `most` unit vectors whose cosine to each one kept before is below that."""
    kept: list[int] = []
    free = np.ones(len(x), dtype=bool)
    for i in range(len(x)):
        if free[i]:
            kept.append(i)
            if len(kept) == most:
                break
            free[i:] &= x[i:] @ x[i] < cosine
    return x[kept]


def prefixes(x: np.ndarray, pivots: np.ndarray, m: int) -> np.ndarray:
    """The m nearest pivots of each unit vector, nearest first."""
    near = x @ pivots.T
    m = min(m, pivots.shape[0])
    top = np.argpartition(-near, m - 1, axis=1)[:, :m]
    order = np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable")
    return np.take_along_axis(top, order, 1).astype(np.int32)


def setting(pivots: int) -> tuple[int, int, int]:
    """(prefix, lists, shared) for so many pivots."""
    return next(s[1:] for s in SETTINGS if pivots >= s[0])


def shared_counts(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How many pivots each prefix of p shares with each of q: each pivot's two inverted lists raise the count of their pairs.

    Pivots whose lists hold much of both sides, as those of a dense group do, are counted together by a product of incidence matrices.
    """
    out = np.zeros((len(p), len(q)), dtype=np.uint8)
    long = []
    for i, j in _meeting(p, q):
        if len(i) * len(j) * LONG > out.size:
            long.append((i, j))
        else:
            out[np.ix_(i, j)] += 1
    for s in range(0, len(long), TOGETHER):
        part = long[s : s + TOGETHER]
        a, b = (np.zeros((n, len(part)), dtype=np.float32) for n in out.shape)
        for k, (i, j) in enumerate(part):
            a[i, k] = b[j, k] = 1
        out += (a @ b.T).astype(np.uint8)
    return out


def _meeting(p: np.ndarray, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By pivot that occurs on both sides: its rows in p and in q."""
    sides = []
    for x in (p, q):
        flat = x.ravel()
        order = np.argsort(flat, kind="stable")
        names, first = np.unique(flat[order], return_index=True)
        sides.append((names, np.split(order // x.shape[1], first[1:])))
    (a, rows_a), (b, rows_b) = sides
    _, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    for i, j in zip(at_a, at_b, strict=True):
        yield rows_a[i], rows_b[j]


def retrieved(pivot: int, p: np.ndarray, q: np.ndarray, lists: int) -> np.ndarray:
    """Pairs that this pivot's list answers for: they share no lower one among the first `lists`."""
    low, high = (np.where(x[:, :lists] < pivot, x[:, :lists], -1 - k) for k, x in enumerate((p, q)))
    return shared_counts(low, high) == 0


def near(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, cosine: float) -> np.ndarray:
    """Which pairs (x[i], y[j]) of unit vectors reach the cosine."""
    out = [np.einsum("ij,ij->i", x[i[s : s + STEP]], y[j[s : s + STEP]]) >= cosine for s in range(0, len(i), STEP)]
    return np.concatenate(out) if out else np.zeros(0, dtype=bool)


def cell_links(pivot: int, a: tuple, b: tuple | None, cosine: float, lists: int, shared: int, tally: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) between two blocks (b None: inside one) that this pivot's list answers for.

    A block is (unit vectors, prefixes). Pairs are retrieved, counted by shared pivots, and verified if these are enough.
    `tally` gets the numbers of pairs that meet here and of candidates.
    """
    x, p = a
    y, q = b if b is not None else a
    candidate = retrieved(pivot, p, q, lists)
    if b is None:
        candidate &= np.tri(len(x), k=-1, dtype=bool).T
    if tally is not None:
        tally.append(int(candidate.sum()))
    r, c = np.flatnonzero(candidate.any(1)), np.flatnonzero(candidate.any(0))
    i, j = np.nonzero(candidate[np.ix_(r, c)] & (shared_counts(p[r], q[c]) >= shared))
    i, j = r[i], c[j]
    if tally is not None:
        tally.append(len(i))
    ok = near(x, y, i, j, cosine)
    return i[ok], j[ok]


def stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least reachable index of each of n nodes over edges (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # squares of large components stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def choose_pivots(heads: DataFrame, seed: int) -> dict[int, np.ndarray]:
    """Pivots of each dimension, from a sample by hash; together bounded by MOST_BYTES."""
    spark = heads.sparkSession
    counts = {r["dim"]: r["n"] for r in heads.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # one row a dimension
    bounds = {dim: MOST_BYTES // len(counts) for dim in counts}
    want = {dim: pivot_count(n, dim, bounds[dim]) for dim, n in counts.items()}
    sample = {dim: max(1, min(SPARE * want[dim], bounds[dim] // (8 * dim))) for dim in counts}
    if not counts:
        return {}
    top = 1 << 40
    quota = spark.createDataFrame([(dim, min(top, top * sample[dim] // n + 1)) for dim, n in counts.items()], "dim int, quota long")
    place = F.pmod(F.xxhash64(F.lit(seed), "vec"), F.lit(top))
    picked = heads.join(F.broadcast(quota), "dim").withColumn("place", place).filter("place < quota").select("dim", "place", "vec")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = pa.array([np.array(v, dtype="<f8").tobytes() for v in b.column("vec").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("dim"), b.column("place"), raw], ["dim", "place", "x"])

    found: dict[int, list] = {}
    for r in picked.mapInArrow(packed, "dim int, place long, x binary").collect():  # about `sample` rows a dimension
        found.setdefault(r["dim"], []).append((r["place"], bytes(r["x"])))
    out = {}
    for dim, rows in found.items():
        x = unit(np.stack([np.frombuffer(v, "<f8") for _, v in sorted(rows)]))
        out[dim] = apart(x, want[dim])
    for dim in counts.keys() - out.keys():  # a small dimension whose sample is empty: one list for all
        out[dim] = np.ones((1, dim)) / math.sqrt(dim)
    return out


def link(rows: DataFrame, cosine: float = COSINE, block: int = BLOCK, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 9) -> DataFrame:
    """Of rows (id, vector): vec_id, n_links, component_id, kept; one row a row of the input."""
    spark = rows.sparkSession
    with scratch(spark):
        usable = finite(rows, id_col, vec_col).filter(F.exists("vec", lambda x: x != 0.0)).withColumn("vec", F.transform("vec", lambda x: x + 0.0))  # negative zero equals zero
        same = ["h1", "h2", "dim"]
        usable = usable.select("id", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2"), "dim", "vec")
        heads = usable.groupBy(*same).agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
        heads = written(heads.select(F.monotonically_increasing_id().alias("node"), *same, "least", "copies", "vec"), "heads")
        tallies = written(_tallies(heads.select("node", "copies", "dim", "vec"), cosine, block, seed), "tallies")
        n_links = tallies.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
        comp = components(tallies.filter("a <> b").select("a", "b").distinct())
        named = heads.select("node", *same, "least", "copies").join(comp, "node", "left").withColumn("root", F.coalesce("component", "node")).join(n_links, "node", "left")
        named = written(named.select(*same, "root", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links")), "named")
        least = written(named.groupBy("root").agg(F.min("least").alias("component_id")), "least")
        named = named.join(least, "root").select(*same, "links", "component_id")
        id_ = F.col("vec_id").cast("long")
        linked = _keyed(rows, id_col, vec_col).join(named, same, "left")
        component = F.coalesce("component_id", id_)
        out = linked.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == id_, F.lit(True)).alias("kept"))
        return written(out, "linked", keep=True)


def _keyed(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and its vector's key (h1, h2, dim), null for rows that link with nothing."""
    v = F.col("vec")
    ok = F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    out = rows.select(F.col(id_col).alias("vec_id"), F.transform(F.col(vec_col).cast("array<double>"), lambda x: x + 0.0).alias("vec"))
    keys = {"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), "vec"), "dim": F.size("vec")}
    return out.select("vec_id", *(F.when(ok, x).alias(c) for c, x in keys.items()))


def _tallies(heads: DataFrame, cosine: float, block: int, seed: int) -> DataFrame:
    """(a, n, b): a head's links, weighted by copies, and a head it is connected with; by cells."""
    spark = heads.sparkSession
    chosen = choose_pivots(heads, seed)
    settings = {dim: setting(len(x)) for dim, x in chosen.items()}
    pivots = spark.sparkContext.broadcast(chosen)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors in single precision where that loses nothing, and their prefixes."""
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == dim))
                x = part.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                with np.errstate(over="ignore"):
                    short = (x.astype("<f4").astype(np.float64) == x).all(1)
                raw = [(v.astype("<f4") if s else v).tobytes() for v, s in zip(x, short, strict=True)]
                p = prefixes(unit(x), pivots.value[dim], settings[dim][0])
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("copies"), part.column("dim"), pa.array(raw, pa.binary()), pa.array([settings[dim][1]] * len(x), pa.int32()), pa.array(p.tolist(), pa.list_(pa.int32()))], ["node", "copies", "dim", "x", "lists", "p"])

    indexed = written(heads.mapInArrow(index, "node long, copies long, dim int, x binary, lists int, p array<int>"), "index")
    posted = indexed.select("*", F.explode(F.slice("p", F.lit(1), F.col("lists"))).alias("pivot"))
    sizes = posted.groupBy("dim", "pivot").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    posted = posted.join(sizes, ["dim", "pivot"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # a block goes to the cell of each pair of blocks that it is in
    cells = posted.select("dim", "pivot", "block", "node", "copies", "x", "p", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = cells.select("dim", "pivot", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "copies", "x", "p")

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        dim, pivot, lo, hi = (k.as_py() for k in key)
        side = table.column("block").to_numpy()
        x = unit(np.stack([np.frombuffer(v, "<f4" if len(v) == 4 * dim else "<f8").astype(np.float64) for v in table.column("x").to_pylist()]))
        p = np.array(table.column("p").to_pylist(), dtype=np.int32)
        weight, node = table.column("copies").to_numpy(), table.column("node").to_numpy()
        at = [np.flatnonzero(side == s) for s in ((lo,) if lo == hi else (lo, hi))]
        blocks = [(x[a], p[a]) for a in at]
        i, j = cell_links(pivot, blocks[0], blocks[1] if len(at) > 1 else None, cosine, *settings[dim][1:])
        i, j = at[0][i], at[-1][j]
        n_links = np.zeros(len(x), dtype=np.int64)
        np.add.at(n_links, i, weight[j])
        np.add.at(n_links, j, weight[i])
        label = stars(len(x), i, j)
        some = np.flatnonzero(n_links)
        return pa.table({"a": node[some], "n": n_links[some], "b": node[label[some]]})

    return cells.groupBy("dim", "pivot", "lo", "hi").applyInArrow(run, "a long, n long, b long")


ORACLE = """
WITH RECURSIVE usable AS (
  SELECT row_number() OVER () AS place, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
whole AS MATERIALIZED (
  SELECT * FROM usable WHERE vec_id IS NOT NULL AND v IS NOT NULL AND len(v) > 0
    AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.place AS a, b.place AS b FROM whole a JOIN whole b
    ON a.place <> b.place AND CASE WHEN len(a.v) = len(b.v) THEN list_cosine_similarity(a.v, b.v) >= 0.9 ELSE false END),
reached AS (
  SELECT place, place AS other FROM usable UNION
  SELECT r.place, l.b FROM reached r JOIN links l ON l.a = r.other),
least AS (SELECT r.place, min(u.vec_id) AS component_id FROM reached r JOIN usable u ON u.place = r.other GROUP BY r.place),
counted AS (SELECT a AS place, count(*) AS n FROM links GROUP BY a)
SELECT u.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, l.component_id, coalesce(u.vec_id = l.component_id, true) AS kept
FROM usable u JOIN least l USING (place) LEFT JOIN counted c USING (place)
"""
