import random
import sys

import pytest

from lodeframe.functions.types import Schema
from lodeframe.operators import folds
from lodeframe.plans import PlanBuilder
from lodeframe.sources.catalog import Database

KEY = Schema("employeeKey", [("id", "int")])
KEY2 = Schema("employeeKey2", [("id2", "int")])


def rows(plan, *fields):
    return [tuple(r[f] for f in fields) if len(fields) > 1 else r[fields[0]] for r in plan]


def employee(db):
    return db.query().fromTable("employee")


def test_select(db):
    q = employee(db).where("age < 30").finalize()
    assert q.relations() == ["employee"]
    assert sorted(rows(db.processQuery(q), "age")) == [20, 22, 24, 26, 28]
    lines = q.explain().split("\n")
    assert lines[0].startswith("Select[") and lines[0].endswith("](predicate='age < 30')") and ",cost=" in lines[0]
    assert lines[1].startswith("  TableScan[") and lines[1].endswith("](employee)")


def test_project(db):
    q = employee(db).where("age < 30").select({"id": ("id", "int")}).finalize()
    assert sorted(rows(db.processQuery(q), "id")) == [0, 1, 2, 3, 4]
    assert q.schema().names == ["id"]
    assert [n.operatorType() for _, n in q.flatten()] == ["Project", "Select", "TableScan"]
    many = employee(db).select({"b": ("age * 2", "double"), "a": ("id // 2", "int")}).finalize()
    assert many.dataframe().dtypes == [("b", "double"), ("a", "int")]
    assert sorted(rows(many, "a")) == [i // 2 for i in range(20)]  # repeats stay


def test_union(db):
    q = employee(db).union(employee(db)).finalize()
    assert sorted(rows(q, "id")) == sorted([*range(20), *range(20)])
    with pytest.raises(ValueError):
        employee(db).union(employee(db).select({"id": ("id", "int"), "age": ("age", "double")}))
    with pytest.raises(ValueError):
        employee(db).union(employee(db).select({"age": ("age", "int"), "id": ("id", "int")}))


def joins(db, **more):
    other = db.relationSchema("employee").rename("employee2", {"id": "id2", "age": "age2"})
    index = db.matchIndex("employee", KEY) or db.createIndex("employee", KEY, primary=True)
    for options in (
        {"method": "nested-loops", "expr": "id == id2"},
        {"method": "block-nested-loops", "expr": "id == id2"},
        {"method": "hash", "lhsHashFn": "hash(id) % 4", "lhsKeySchema": KEY, "rhsHashFn": "hash(id2) % 4", "rhsKeySchema": KEY2},
        {"method": "indexed", "lhsKeySchema": KEY, "indexId": index},
    ):
        yield options["method"], employee(db).join(employee(db), rhsSchema=other, **options, **more).finalize()


def test_joins(db):
    for method, q in joins(db):
        assert sorted(rows(q, "id", "id2", "age", "age2")) == [(i, i, 2 * i + 20, 2 * i + 20) for i in range(20)], method
        assert q.schema().names == ["id", "age", "id2", "age2"]
        assert q.relations() == ["employee", "employee"]
        assert q.explain().split("Join[")[0] in ("NL", "BNL", "Hash", "Index")


def test_keys_and_a_further_condition(db):
    other = db.relationSchema("employee").rename("employee2", {"id": "id2", "age": "age2"})
    q = employee(db).join(employee(db), rhsSchema=other, method="hash", lhsHashFn="id", lhsKeySchema=KEY, rhsHashFn="id2", rhsKeySchema=KEY2, expr="age2 > 40").finalize()
    assert sorted(rows(q, "id")) == list(range(11, 20))
    q = employee(db).join(employee(db), rhsSchema=other, method="nested-loops", expr="age < age2 and id2 < 3").finalize()
    assert sorted(rows(q, "id", "id2")) == [(0, 1), (0, 2), (1, 2)]


def test_join_checks(db):
    other = db.relationSchema("employee").rename("employee2", {"id": "id2", "age": "age2"})
    for options in (
        {"expr": "id == id2"},  # fields on both sides
        {"rhsSchema": other},
        {"rhsSchema": other, "method": "hash", "lhsHashFn": "id"},
        {"rhsSchema": other, "method": "indexed", "lhsKeySchema": KEY},
        {"rhsSchema": other, "method": "merge", "expr": "True"},
        {"rhsSchema": other, "expr": "id == id2", "pipeline": True},
    ):
        with pytest.raises(ValueError):
            employee(db).join(employee(db), **options)
    with pytest.raises(ValueError):
        employee(db).join(None)
    with pytest.raises(ValueError):
        PlanBuilder(db).where("True")
    with pytest.raises(ValueError):
        PlanBuilder()
    with pytest.raises(ValueError):
        db.query().finalize()


def grouped(q, folds, fields, by=lambda e: e.id, group=KEY):
    return q.groupBy(groupSchema=group, aggSchema=Schema("agg", fields), groupExpr=by, aggExprs=folds, groupHashFn=lambda k: hash(k) % 2).finalize()


MINMAX = [(sys.maxsize, lambda acc, e: min(acc, e.age), lambda x: x), (0, lambda acc, e: max(acc, e.age), lambda x: x)]


def test_group_by(db):
    q = grouped(employee(db), MINMAX, [("low", "int"), ("high", "int")])
    assert sorted(rows(q, "id", "low", "high")) == [(i, 2 * i + 20, 2 * i + 20) for i in range(20)]
    assert q.schema().names == ["id", "low", "high"]
    assert "GroupBy[" in q.explain() and "aggSchema=agg[(low,int),(high,int)]" in q.explain()


def test_start_is_part_of_an_aggregate(db):
    db.createRelation("debt", [("id", "int"), ("age", "int")])
    for i, v in ((1, -5), (1, -3), (2, 4)):
        db.insertTuple("debt", (i, v))
    q = grouped(db.query().fromTable("debt"), MINMAX, [("low", "int"), ("high", "int")])
    assert sorted(rows(q, "id", "low", "high")) == [(1, -5, 0), (2, 4, 4)]


def test_folds(db):
    parity, by = Schema("parity", [("odd", "int")]), lambda e: e.id % 2
    sums = [
        (0, lambda acc, e: acc + e.age, lambda x: x),
        (0, lambda acc, e: acc + 1, lambda x: x),
        ((0, 0), lambda acc, e: (acc[0] + e.age, acc[1] + 1), lambda a: a[0] / a[1]),
        (10, lambda acc, e: 1 + acc, lambda x: x * 2),
    ]
    q = grouped(employee(db), sums, [("s", "int"), ("n", "int"), ("mean", "double"), ("t", "int")], by, parity)
    assert sorted(rows(q, "odd", "s", "n", "mean", "t")) == [(0, 380, 10, 38.0, 40), (1, 400, 10, 40.0, 40)]
    text = q.dataframe()._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "partial_sum" in text
    python = [(1, lambda acc, e: acc * e.age % 1009, lambda x: x), ("", lambda acc, e: max(acc, str(e.id)), lambda x: x + "!")]
    q = grouped(employee(db), python, [("p", "int"), ("s", "char(4)")], by, parity)
    want = {0: 1, 1: 1}
    for i in range(20):
        want[i % 2] = want[i % 2] * (2 * i + 20) % 1009
    assert sorted(rows(q, "odd", "p", "s")) == [(0, want[0], "8!"), (1, want[1], "9!")]


def test_group_by_tuple_and_constant(db):
    two = Schema("two", [("a", "int"), ("b", "int")])
    q = grouped(employee(db), [(0, lambda acc, e: acc + 1, lambda x: x)], [("n", "int")], lambda e: (e.id % 2, e.id % 3), two)
    assert sorted(rows(q, "a", "b", "n")) == sorted((a, b, sum(i % 2 == a and i % 3 == b for i in range(20))) for a in range(2) for b in range(3))
    one = grouped(employee(db), [(0, lambda acc, e: acc + 1, lambda x: x)], [("n", "int")], lambda e: 0, Schema("one", [("k", "int")]))
    assert rows(one, "k", "n") == [(0, 20)]
    none = grouped(employee(db).where("age > 1000"), [(0, lambda acc, e: acc + 1, lambda x: x)], [("n", "int")], lambda e: 0, Schema("one", [("k", "int")]))
    assert rows(none, "n") == []


def test_group_by_checks(db):
    ok = {"groupSchema": KEY, "aggSchema": Schema("agg", [("n", "int")]), "groupExpr": lambda e: e.id, "aggExprs": [(0, lambda a, e: a, lambda x: x)], "groupHashFn": lambda k: 0}
    for missing in ok:
        with pytest.raises(ValueError):
            employee(db).groupBy(**{k: v for k, v in ok.items() if k != missing})
    with pytest.raises(ValueError):
        employee(db).groupBy(**ok | {"aggExprs": []})


def test_order(db):
    q = employee(db).order(sortKeyFn=lambda t: -t.age, sortKeyDesc="age").select({"id": ("id", "int")}).finalize()
    assert rows(q, "id") == list(range(19, -1, -1))
    q = employee(db).order(sortKeyFn=lambda t: (t.id % 3, t.age), sortKeyDesc="x").finalize()
    assert rows(q, "id") == sorted(range(20), key=lambda i: (i % 3, i))
    assert "Sort[" in q.explain() and "(sortKeyDesc='x')" in q.explain()
    assert rows(employee(db).where("id > 99").order(sortKeyFn=lambda t: t.age, sortKeyDesc="x").finalize(), "id") == []
    with pytest.warns(UserWarning):
        odd = employee(db).order(sortKeyFn=lambda t: "".join(reversed(str(t.id))), sortKeyDesc="digits").finalize()
        assert rows(odd, "id") == sorted(range(20), key=lambda i: str(i)[::-1])
    with pytest.raises(ValueError):
        employee(db).order(sortKeyFn=lambda t: t.age)


def test_a_plan_runs_again_with_new_rows(db):
    q = employee(db).where("age < 24").finalize()
    assert sorted(rows(q, "id")) == [0, 1]
    db.insertTuple("employee", (20, 21))
    assert sorted(rows(q, "id")) == [0, 1, 20]


def test_empty_sides(db):
    db.createRelation("none", [("a", "int"), ("b", "int")])
    none = db.query().fromTable("none")
    assert rows(none.finalize(), "a") == []
    assert rows(employee(db).join(none, expr="id == a").finalize(), "id") == []
    assert rows(none.join(employee(db), method="block-nested-loops", expr="a < id").finalize(), "id") == []


def test_samples(db, spark):
    random.seed(1)
    db.insert("employee", spark.createDataFrame([(i, int(random.gauss(45, 25))) for i in range(10_000)], "id int, age int"))
    q = employee(db).where("age < 30").finalize()
    exact = q.dataframe().count()
    assert q.sample(1) == exact
    assert abs(q.sample(10) - exact) < 0.25 * exact
    assert q.cost(estimated=True) > 0 and q.cost() > 0


# join orders


def chain(db: Database, names):
    """Relations joined a-b, c-d, ... and these with each other, along x1 of neighbours."""
    parts = [db.query().fromTable(n) for n in names]
    spans = [(n, n) for n in names]
    while len(parts) > 1:
        new, new_spans = [], []
        for i in range(0, len(parts) - 1, 2):
            test = f"{spans[i][1]}1 == {spans[i + 1][0]}1"
            new.append(parts[i].join(parts[i + 1], method="block-nested-loops", expr=test))
            new_spans.append((spans[i][0], spans[i + 1][1]))
        if len(parts) % 2:
            new.append(parts[-1])
            new_spans.append(spans[-1])
        parts, spans = new, new_spans
    return parts[0].finalize()


def chain_db(spark, names, filled=False):
    db, rng = Database(spark), random.Random(3)
    for n in names:
        db.createRelation(n, [(f"{n}{i}", "int") for i in (1, 2, 3)])
        for _ in range(rng.randrange(4, 9) if filled else 0):
            db.insertTuple(n, (rng.randrange(4), rng.randrange(9), rng.randrange(9)))
    return db


@pytest.mark.parametrize("n", [2, 4, 6, 8, 10, 12])
def test_left_deep_counters(spark, n):
    names = "abcdefghijkl"[:n]
    db = chain_db(spark, names)
    db.setQueryOptimizer("LeftDeepOptimizer")
    db.optimizeQuery(chain(db, names))
    assert db.queryOptimizer().getLatestOptimizationStats() == ((n - 1) * n * (n + 1) // 3, n * (n - 1))


def test_orders_keep_the_result(spark):
    names = "abcde"
    db = chain_db(spark, names, filled=True)
    plan = chain(db, names)
    want = sorted(map(tuple, plan))
    assert want
    for o in ("LeftDeepOptimizer", "BushyOptimizer", "GreedyOptimizer"):
        db.setQueryOptimizer(o)
        new = db.optimizeQuery(plan)
        assert new.schema().names == plan.schema().names
        assert sorted(map(tuple, new)) == want, o
        assert db.queryOptimizer().getPlanCost(range(5)) > 0
    with pytest.raises(ValueError):
        db.setQueryOptimizer("other")


def test_orders_with_all_else(db, spark):
    db.createRelation("department", [("did", "int"), ("eid", "int")])
    for i in range(10):
        db.insertTuple("department", (i, i % 7))
    q = employee(db).union(employee(db)).join(db.query().fromTable("department"), method="block-nested-loops", expr="id == eid")
    q = q.where("eid > 0 and id > 0 and (eid == 5 or id == 6)").select({"id": ("id", "int"), "eid": ("eid", "int")}).finalize()
    want = sorted(map(tuple, q))
    assert want == [(5, 5)] * 2 + [(6, 6)] * 2
    pushed = q.pushdownOperators()
    assert sorted(map(tuple, pushed)) == want
    kinds = [(d, n.operatorType()) for d, n in pushed.flatten()]
    assert sum(k == "Select" for _, k in kinds) >= 3 and kinds[-1][1] == "TableScan"
    for o in ("LeftDeepOptimizer", "BushyOptimizer", "GreedyOptimizer"):
        db.setQueryOptimizer(o)
        assert sorted(map(tuple, db.optimizeQuery(q))) == want


def test_orders_without_a_condition_and_with_one_over_three(db):
    one = {n: db.relationSchema("employee").rename(n, {"id": f"id{n}", "age": f"age{n}"}) for n in "xyz"}
    q = employee(db).where("id < 4").join(employee(db), rhsSchema=one["x"], expr="True").join(employee(db), rhsSchema=one["y"], expr="id + idx == idy").where("idx < 3").finalize()
    want = sorted(map(tuple, q))
    assert len(want) == 12
    for o in ("LeftDeepOptimizer", "BushyOptimizer", "GreedyOptimizer"):
        db.setQueryOptimizer(o)
        assert sorted(map(tuple, db.optimizeQuery(q))) == want, o


def test_pushed_filters_reach_the_files(db):
    other = db.relationSchema("employee").rename("e2", {"id": "id2", "age": "age2"})
    q = employee(db).join(employee(db), rhsSchema=other, method="block-nested-loops", expr="id == id2").where("age < 30 and age2 > 22").select({"id": ("id", "int")}).finalize()
    text = q.dataframe()._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(age,30)" in text and "GreaterThan(age,22)" in text


def test_columns_are_pruned_in_the_tree(db):
    from lodeframe.plans import Plan
    from lodeframe.plans.pushdown import pruned

    q = employee(db).where("age < 30").select({"x": ("age + 1", "int")}).finalize()
    cut = Plan(pruned(q.root), db)
    assert sorted(map(tuple, cut)) == sorted(map(tuple, q))
    assert [n.schema.names for _, n in cut.flatten()][-2:] == [["age"], ["id", "age"]]


def test_streams(db, spark, tmp_path):
    from lodeframe.streaming import over_stream, run

    spark.createDataFrame([(i, 25 + i) for i in range(8)], "id int, age int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, age int").parquet(str(tmp_path / "in"))
    plan = employee(db).where("age < 30").select({"id": ("id", "int")}).finalize()
    run(plan, str(tmp_path / "out"), str(tmp_path / "state"), employee=stream).awaitTermination(60)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        over_stream(plan, other=stream)


def _all_of(row):
    return row.id


def test_fields_that_steps_read():
    names = ["id", "age", "salary"]
    read = folds.fields_read
    assert read(lambda acc, e: acc + e.age if e.id > 3 else acc, names) == ["id", "age"]
    assert read(lambda acc, e: acc + 1, names) == []
    assert read(lambda acc, e: (acc[0] + e.salary, max(acc[1], e.salary)), names) == ["salary"]
    assert read(lambda acc, e: acc + _all_of(e), names) == names
    assert read(lambda acc, e: acc + sum(x for x in e), names) == names
    assert read(max, names) == names

    def step(acc, e):
        f = lambda: e.id
        return acc + f()

    assert read(step, names) == names


def test_python_folds_read_few_columns(db):
    q = grouped(employee(db), [(0, lambda acc, e: acc + 1 if e.age > 30 else acc, lambda x: x)], [("n", "int")], by=lambda e: e.age % 3, group=Schema("g", [("rest", "int")]))
    df = q.dataframe()
    assert "ReadSchema: struct<age:int>" in df._jdf.queryExecution().executedPlan().toString()
    assert sum(r.n for r in df.collect()) == sum(2 * i + 20 > 30 for i in range(20))


def test_a_join_without_a_condition_is_told(db):
    other = db.relationSchema("employee").rename("employee2", {"id": "id2", "age": "age2"})
    q = employee(db).join(employee(db), rhsSchema=other, method="nested-loops", expr="True").finalize()
    with pytest.warns(UserWarning, match="no condition"):
        got = db.optimizeQuery(q)
    assert got.dataframe().count() == 400
