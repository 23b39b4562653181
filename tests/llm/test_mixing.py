import math
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from lodeframe.llm import mixing

SPACES = set(" \t\n\x0b\x0c\r")


def n_words(text):
    return len("".join(" " if c in SPACES else c for c in text or "").split(" ")) - "".join(" " if c in SPACES else c for c in text or "").split(" ").count("")


def shared(sizes, weights=(3.0, 1.0, 2.0), share=1.5, most=2.0):
    """Shares by reweighing the excess until none is left."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, open_ = dict.fromkeys(order, 0.0), set(order)
    left = share * sum(sizes.values())
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        step = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] += step[s]
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
    return target


def check(rows, corpus):
    sizes = defaultdict(int)
    for r in corpus:
        sizes[r[3]] += n_words(r[1])
    want = shared(sizes)
    assert len(rows) == len(corpus)
    assert Counter((r.doc_id, r.source, r.size) for r in rows) == Counter((r[0], r[3], n_words(r[1])) for r in corpus)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size <= 2 * r.size
        rate = r.target / r.source_size if r.source_size else 0
        assert r.copies in (math.floor(rate), math.ceil(rate))
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]


def test_shares_and_copies(docs, corpus):
    rows = mixing.plan(docs).collect()
    check(rows, corpus)
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.plan(docs.repartition(3)).collect()))  # again, and dealt otherwise


def test_empty_and_clashing(empty, clashing, corpus):
    assert mixing.plan(empty).collect() == [] and mixing.mix(empty).collect() == []
    check(mixing.plan(clashing).collect(), corpus)


def test_documents_come_as_often_as_planned(docs, clashing):
    plan = mixing.plan(docs).collect()
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    got = Counter(map(tuple, out.collect()))
    assert sum(got.values()) == sum(r.copies for r in plan)
    by_id = Counter()
    for r, n in got.items():
        by_id[r[0], n_words(r[1])] += n
    want = Counter()
    for r in plan:
        if r.copies:
            want[r.doc_id, r.size] += r.copies
    assert by_id == want
    assert mixing.mix(clashing).columns == clashing.columns


def test_one_source_without_words(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "x y", "b")], "doc_id int, text string, source string")
    got = {r.doc_id: (r.target, r.taken) for r in mixing.plan(rows).collect()}
    assert got[1] == got[2] == (0.0, 0) and got[3][0] == 3.0 and got[3][1] in (2, 4)


def test_many_of_one_size(spark):
    rows = spark.range(2000).selectExpr("id as doc_id", "'a b c' as text", "if(id % 3 = 0, 'x', 'y') as source")
    got = mixing.plan(rows).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 3 for r in got)


def test_equals_sql(docs, corpus):
    duckdb = pytest.importorskip("duckdb")
    documents = pa.table({"doc_id": [r[0] for r in corpus], "text": [r[1] for r in corpus], "source": [r[3] for r in corpus]})  # noqa: F841  read by name
    want = sorted(duckdb.sql(mixing.ORACLE).fetchall(), key=repr)
    assert sorted(map(tuple, mixing.plan(docs).select("doc_id", "size", "source_size", "target", "taken").collect()), key=repr) == want


def test_many_rows_that_are_alike(spark):
    rows = [(1, "a b", "s", 5)] * 9000 + [(1, "a c", "s", 5)] * 3 + [(1, "a b", "s", 6)] + [(i, "d e f", "t", 0) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
    plan, got = mixing.plan(docs).collect(), Counter(map(tuple, mixing.mix(docs).collect()))
    assert sum(got.values()) == sum(r.copies for r in plan) > 9100
    assert set(got) <= set(rows)
