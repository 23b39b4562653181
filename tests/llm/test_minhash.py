import random
from collections import Counter

import numpy as np
import pyarrow as pa

import pytest

from lodeframe.llm import minhash
from lodeframe.llm.components import components

from .test_substrings import thue_morse


def shingles(text, k=5):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = lowered.encode().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows):
    """For each row (id, text): (n_shingles, component), by pairs of rows; null ids link with nothing."""
    sets = [shingles(r[1]) for r in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None:
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = find(i), find(j)
                    label[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0]) if r[0] is not None else None
    return [(len(s), least[find(i)]) for i, s in enumerate(sets)]


def check(got, rows):
    want = Counter((r[0], n, c, c is None or c == r[0]) for r, (n, c) in zip(rows, brute(rows), strict=True))
    assert Counter(map(tuple, got)) == want


def test_equals_brute_force(docs, clashing, corpus):
    check(minhash.link(docs).collect(), corpus)
    check(minhash.link(clashing).collect(), corpus)


def test_verification_carries_the_result(docs, corpus):
    """A hash of few bits finds pairs that aren't near, and none of them becomes a link."""
    check(minhash.link(docs, bits=16).collect(), corpus)


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_whose_polynomial_hashes_are_equal(spark, n):
    word = thue_morse(n)
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(i, " ".join([w, "x", w + "c", "y"] * 2 + [f"z{j}" for j in range(2)])) for i, w in enumerate([word, other])]
    got = minhash.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check(got, rows)
    assert all(r.kept for r in got)


def test_very_long_texts(spark):
    long = [f"w{i}" for i in range(60_000)]
    rows = [(3, " ".join(long)), (1, " ".join(long[:50_000])), (2, " ".join(long[:20_000])), (4, "x" * 2_000_000), (5, "X" * 2_000_000)]
    check(minhash.link(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_empty(empty):
    assert minhash.link(empty).collect() == []


def small_cells(monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "CELL", 8)


def test_a_large_group_of_near_copies(spark, monkeypatch):
    """Copies at any distance from one text, some alone: in blocks and cells smaller than the group."""
    small_cells(monkeypatch)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(140):
        w = list(base)
        for _ in range(rng.randrange(12)):
            w[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(w)))
    rows += [(i, rows[3][1]) for i in range(2000, 2040)]
    got = minhash.link(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    check(got, rows)
    assert 2 < len({r.component_id for r in got}) < 100


def test_a_bucket_of_many_distant_documents(spark):
    """3,000 documents that share much and are near to none: what a cell sends on grows with its members, not with pairs."""
    rng = random.Random(2)
    common = [f"c{i}" for i in range(60)]
    rows = [(i, " ".join([*common, *(f"x{rng.randrange(10**9)}" for _ in range(16))])) for i in range(3000)]
    got = minhash.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.component_id == r.doc_id for r in got) and len(got) == 3000


def test_an_id_with_several_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (2, b + " more"), (3, a), (4, c), (4, c), (5, b + " less"), (5, c), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(minhash.link(docs).collect(), rows)
    got = Counter(map(tuple, minhash.firsts(docs).collect()))
    assert got == Counter([(1, a), (1, b), (4, c), (5, None), (6, "")])


def test_one_row_of_each_class(docs, clashing, empty, corpus):
    groups = brute(corpus)
    for d in (docs, clashing):
        got = minhash.firsts(d)
        assert got.columns == d.columns
        got = [tuple(r)[:2] for r in got.collect()]
        want = Counter(r[:2] for r, (n, c) in zip(corpus, groups, strict=True) if c is None or not n)
        rest = Counter(got)
        rest.subtract(want)
        assert all(n in (0, 1) for n in rest.values())
        kept = Counter(dict(zip([r[:2] for r in corpus], groups, strict=True))[r][1] for r, n in rest.items() if n)
        assert kept == Counter({c: 1 for n, c in groups if n and c is not None})
    assert minhash.firsts(empty).collect() == []


def test_minima():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    first = np.array([0, 0, 7, 3000, 3000, 5000])
    a, b = minhash.universal(12)
    got = minhash.minima(h, first, a, b, step=64)
    x = (h >> np.uint64(32)).astype(np.uint32)
    for d in range(5):
        part = x[first[d] : first[d + 1]]
        want = (part[None, :] * a[:, None] + b[:, None]).min(1) if len(part) else np.full(12, 0xFFFFFFFF, dtype=np.uint32)
        assert (got[:, d] == want).all()


def test_sets_are_the_same_in_any_batch():
    texts = ["A b c d e f", None, "", "x", "a B c d e f", "a b c d e"]
    _, _, h, g, first = next(minhash.distinct_sets(pa.array(texts), 5))
    assert np.diff(first).tolist() == [2, 0, 0, 1, 2, 1]
    assert h[first[0] : first[1]].tolist() == h[first[4] : first[5]].tolist()
    assert (minhash.prints(h, g, first)[:, 0] == minhash.prints(h, g, first)[:, 4]).all()
    assert [len(minhash.shingle_set(t or "")) for t in texts] == [2, 0, 0, 1, 2, 1]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(500, 560)] + [(700, x) for x in range(701, 790)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    assert got == {x: c for x, c in label.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_of_few_edges_are_few_files(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(2_000)], "a long, b long")
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = components(chain)
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert {(r.node, r.component) for r in got.collect()} == {(i, 0) for i in range(2_001)}
    assert 0 < len(got.inputFiles()) <= 8
