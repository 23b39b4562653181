from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodeframe.llm import neardup_vectors, topk

KIND = "vec_id long, embedding array<float>, label int"


def vectors(n=230, dim=12, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in range(0, 120):  # a group around one vector, of any closeness
        x[i] = x[0] + rng.normal(size=dim) * rng.uniform(0.02, 0.5)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, [float(v) for v in r.astype(np.float32)], 0) for i, r in enumerate(x)]
    rows += [(1000 + i, rows[200][1], 1) for i in range(9)]  # copies
    odd = [None, [], [0.0] * dim, [1.0] * (dim - 1) + [None], [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1), [0.5] * 3]
    rows += [(2000 + i, v, None) for i, v in enumerate(odd)]
    return [*rows, (None, rows[5][1], 0), rows[7], (2100, [0.5] * 3, None), (2200, [-0.0, 1.0] + [0.0] * (dim - 2), 0), (2250, [0.0, 1.0] + [0.0] * (dim - 2), 0)]


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


def brute_links(rows):
    """By rows: (links, component)."""
    known = [np.array(r[1], dtype=float) if r[0] is not None and usable(r[1]) and np.any(np.array(r[1]) != 0) else None for r in rows]
    links, label = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(known):
        for j, b in enumerate(known[:i]):
            if a is not None and b is not None and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9:
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                label[max(p, q)] = min(p, q)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(n, least.get(find(i))) for i, n in enumerate(links)]


def check_links(got, rows, recall=1.0):
    want = brute_links(rows)
    assert len(got) == len(rows)
    if recall == 1.0:
        assert Counter(map(tuple, got)) == Counter((r[0], n, c, c is None or c == r[0]) for r, (n, c) in zip(rows, want, strict=True))
    assert sum(r.n_links for r in got) >= recall * sum(n for n, _ in want)


@pytest.mark.parametrize("block", [neardup_vectors.BLOCK, 16])
def test_links(spark, block):
    rows = vectors()
    rows += [(3, rows[150][1], 0), (3, rows[2][1], 0), (200, rows[200][1], 0)]  # other vectors, and the same one, under one id
    docs = spark.createDataFrame(rows, KIND).selectExpr("*", "1 as id", "2 as dim", "3 as node", "4 as copies", "5 as kept")
    got = neardup_vectors.link(docs, block=block).collect()
    assert max(r.n_links for r in got) > 40
    check_links(got, rows)


def test_links_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    rows = [r for r in vectors() if r[0] is None or r[0] < 3000]
    embeddings = pa.table({"vec_id": [r[0] for r in rows], "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32()))})  # noqa: F841  read by name
    got = Counter(duckdb.sql(neardup_vectors.ORACLE).fetchall())
    assert got == Counter((r[0], n, c, c is None or c == r[0]) for r, (n, c) in zip(rows, brute_links(rows), strict=True))


@pytest.mark.parametrize("kind", ["alone", "pairs", "groups"])
def test_the_count_of_shared_pivots_prunes(kind):
    """Of the pairs that meet in a list, few are left to verify beyond the true links, which are all found."""
    rng = np.random.default_rng(5)
    n, dim = 6000, 64
    x = rng.normal(size=(n, dim))
    if kind == "pairs":
        x[n // 2 :] = x[: n // 2] + 0.45 * rng.normal(size=(n // 2, dim))  # cosines around 0.9
    if kind == "groups":
        x = x[rng.integers(0, 60, n)] + 0.3 * rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    count = neardup_vectors.pivot_count(n, dim)
    pivots = neardup_vectors.apart(x[rng.permutation(n)[: 4 * count]], count)
    prefix, lists, shared = neardup_vectors.setting(len(pivots))
    p = neardup_vectors.prefixes(x, pivots, prefix)
    tally, links = [], 0
    for pivot in range(p.max() + 1):
        at = np.flatnonzero((p[:, :lists] == pivot).any(1))
        i, _ = neardup_vectors.cell_links(pivot, (x[at], p[at]), None, 0.9, lists, shared, tally)
        links += len(i)
    want = (np.concatenate([(x[s : s + 1000] @ x.T >= 0.9).sum(1) for s in range(0, n, 1000)]).sum() - n) // 2
    met, candidates = sum(tally[::2]), sum(tally[1::2])
    assert links <= want and links >= 0.99 * want
    assert candidates - links < 0.1 * (met - links)


def test_recall_in_many_dimensions(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 48))
    x[750:] = x[:750] / np.linalg.norm(x[:750], axis=1, keepdims=True) + rng.normal(size=(750, 48)) * rng.uniform(0, 0.085, size=(750, 1))
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    got = {r.vec_id: r.n_links for r in neardup_vectors.link(spark.createDataFrame(rows, "vec_id int, embedding array<double>, label int")).collect()}
    want = brute_links(rows)
    assert all(got[i] <= n for i, (n, _) in enumerate(want))
    assert sum(got.values()) >= 0.99 * sum(n for n, _ in want) > 500


@pytest.mark.parametrize("spread", [0.1, 0.295])  # cosines of the group's pairs around 0.99 and 0.92
def test_recall_in_a_large_group_of_near_copies(spark, spread):
    rng = np.random.default_rng(11)
    n, dim = 30_000, 64
    x = rng.normal(size=(n, dim))
    x[::3] = x[0] / np.linalg.norm(x[0]) + rng.normal(size=(n // 3, dim)) * spread / np.sqrt(dim)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = np.concatenate([(x[s : s + 1000] @ x.T >= 0.9).sum(1) - 1 for s in range(0, n, 1000)])
    rows = spark.createDataFrame(pa.table({"vec_id": pa.array(range(n), pa.int64()), "embedding": pa.array(list(x), pa.list_(pa.float64()))}))
    got = {r.vec_id: r for r in neardup_vectors.link(rows).collect()}
    links = np.array([got[i].n_links for i in range(n)])
    assert len(got) == n and abs(want[::3].mean() - n / 3) < 0.2 * n / 3
    assert (links <= want).all() and links.sum() >= 0.999 * want.sum()
    linked = np.flatnonzero(want[::3]) * 3
    assert {got[i].component_id for i in linked} == {linked.min()}


def test_no_rows(spark):
    assert neardup_vectors.link(spark.createDataFrame([], KIND)).collect() == []
    assert topk.search(spark.createDataFrame([], KIND), "id % 50 = 0").collect() == []
    none = spark.createDataFrame([(1, None, 0), (2, [0.0], 0)], KIND)
    assert sorted(map(tuple, neardup_vectors.link(none).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def brute_top(rows, every, k, scale=256):
    """By rows: each query row against every other row."""
    known = [(r[0], tuple(int(np.floor(scale * float(x))) for x in r[1])) for r in rows if r[0] is not None and usable(r[1])]
    out = []
    for i, (q, a) in enumerate(known):
        if q % every == 0:
            scored = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=True)))), c) for j, (c, b) in enumerate(known) if i != j and len(a) == len(b))
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("block, lists", [(topk.BLOCK, 4), (32, 4), (7, 5), (50, 1)])
def test_top_k(spark, block, lists, monkeypatch):
    if block < 100:
        monkeypatch.setattr(topk, "STEP", (3, 10))
        monkeypatch.setattr(topk, "BLOCK_BYTES", block * 8 * 12)
    rows = vectors()
    rows += [(7, rows[30][1], 0), (20, rows[31][1], 0), (20, rows[31][1], 0)]  # other vectors, and the same one, under one id
    docs = spark.createDataFrame(rows, KIND).selectExpr("*", "1 as id", "2 as dim", "3 as place", "4 as block", "5 as rank")
    got = topk.search(docs, "id % 10 = 0", block=block, query_block=8, lists=lists)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 10, 5)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]


def test_top_k_of_huge_and_tied_numbers(spark):
    rows = [(i, [1e14 * (i % 3), -3e13, 0.25 * i], 0) for i in range(40)]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), "id % 4 = 0", block=9, query_block=3)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 4, 5)
    few = [(i, [1.0, float(i)], 0) for i in range(3)]
    assert sorted(map(tuple, topk.search(spark.createDataFrame(few, KIND), "id = 0").collect())) == brute_top(few, 3, 5)


def test_top_k_sql_counts_rows(spark):
    duckdb = pytest.importorskip("duckdb")
    rows = [(50, [0.5, 0.5]), (7, [0.5, 0.25]), (7, [0.25, 0.5]), (50, [1.0, 0.0]), (8, None), (9, [])]
    embeddings = pa.table({"vec_id": [r[0] for r in rows], "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32()))})  # noqa: F841  read by name
    want = sorted(duckdb.sql(topk.ORACLE).fetchall())
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "id % 50 = 0")
    assert sorted(map(tuple, got.collect())) == want == brute_top(rows, 50, 5)
    assert len(want) == 6
