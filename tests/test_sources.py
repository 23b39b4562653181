import pytest

from lodeframe.functions.types import Schema
from lodeframe.sources import delimited
from lodeframe.sources.catalog import Database
from lodeframe.sources.workload import Workload, scanned

ID, AGE = Schema("k", [("id", "int")]), Schema("k", [("age", "int")])


def ids(df):
    return sorted(r.id for r in df.collect())


def test_definition(db, spark):
    assert db.relations() == ["employee"] and db.hasRelation("employee") and not db.hasRelation("x")
    assert db.relationSchema("x") is None
    with pytest.raises(ValueError):
        db.createRelation("employee", [("a", "int")])
    with pytest.raises(ValueError):
        db.removeRelation("x")
    with pytest.raises(ValueError):
        db.insertTuple("x", (1,))
    with pytest.raises(ValueError):
        db.insertTuple("employee", (1 << 31, 0))
    db.removeRelation("employee")
    assert db.relations() == []


def test_catalog_is_restored(db, spark):
    db.createIndex("employee", ID, primary=True)
    assert db.known_count("employee") == 20
    db.close()
    again = Database(spark, db.dataDir, restore=True)
    assert again.relations() == ["employee"] and again.relationSchema("employee").match(db.relationSchema("employee"))
    assert again.lookupByKey("employee", 3).age == 26
    assert again.hasIndex("employee", ID) and again.createIndex("employee", AGE).id == 1


def test_detach_and_attach(db, spark):
    db.table("employee")
    path = db.removeRelation("employee", detach=True)
    db.attach("staff", path, Schema("staff", [("id", "int"), ("age", "int")]))
    assert db.known_count("staff") == 20
    for change in (lambda: db.insertTuple("staff", (1, 1)), lambda: db.deleteTuple("staff", "id == 1")):
        with pytest.raises(ValueError):
            change()
    db.removeRelation("staff")
    assert spark.read.parquet(path).count() == 20


def test_changes(db):
    db.deleteTuple("employee", "age >= 30")
    assert ids(db.table("employee")) == [0, 1, 2, 3, 4]
    db.updateTuple("employee", {"id": 2}, (22, 99))
    assert sorted(map(tuple, db.tuples("employee"))) == [(0, 20), (1, 22), (3, 26), (4, 28), (22, 99)]
    db.updateTuple("employee", "id == 22", {"age": 1})
    db.clearTuple("employee", {"id": 4})
    assert sorted(map(tuple, db.tuples("employee"))) == [(0, 0), (0, 20), (1, 22), (3, 26), (22, 1)]
    with pytest.raises(ValueError):
        db.updateTuple("employee", "id == 1", {"none": 1})
    with pytest.raises(ValueError):
        db.deleteTuple("employee", {"none": 1})
    assert db.relationStats("employee")["rows"] == 5
    assert [len(p) for p in db.pages("employee", 2)] == [2, 2, 1]
    assert sum(r.rows for r in db.headers("employee").collect()) == 5


def test_indexes(db, spark):
    primary = db.createIndex("employee", ID, primary=True)
    second = db.createIndex("employee", AGE)
    with pytest.raises(ValueError):
        db.createIndex("employee", Schema("k", [("id", "int"), ("age", "int")]), primary=True)
    with pytest.raises(ValueError):
        db.createIndex("employee", Schema("other", [("age", "int")]))
    with pytest.raises(ValueError):
        db.createIndex("employee", Schema("k", [("age", "double")]))
    assert db.matchIndex("employee", AGE) == second and db.getIndex(primary.id) == primary and len(db.indexes("employee")) == 2
    db.insertTuple("employee", (50, 22))
    assert ids(db.lookupByIndex(second, 22)) == [1, 50]  # equal keys are all there
    assert tuple(db.lookupByKey("employee", 7)) == (7, 34) and db.lookupByKey("employee", 77) is None
    db.deleteByIndex(second, 22)
    db.updateByKey("employee", 7, (70, 34))
    db.deleteByKey("employee", 0)
    assert ids(db.table("employee")) == sorted(set(range(2, 20)) - {7} | {70})
    db.insertTuple("employee", (-4, 0))
    assert [r.id for r in db.scanByKey("employee").collect()][:2] == [-4, 2]
    db.writeSorted(primary, 2)
    assert ids(db.lookupByIndex(primary, 70)) == [70]
    db.deleteKeys("employee", spark.createDataFrame([(2,), (3,), (2,)], "id int"))
    assert 2 not in ids(db.table("employee"))
    db.removeIndex("employee", primary)
    assert not db.hasIndex("employee", ID) and db.lookupByKey("employee", 7) is None
    with pytest.raises(ValueError):
        db.deleteByKey("employee", 4)
    db.insertTuple("employee", (70, 1))
    with pytest.raises(ValueError):
        db.createIndex("employee", ID, primary=True)  # it repeats


def test_column_statistics(db):
    s = db.columnStats("employee", "age")
    assert (s.n, s.low, s.high, s.distinct) == (20, 20, 58, 20)


NATION = Schema("nation", [("N_NATIONKEY", "int"), ("N_NAME", "char(5)"), ("N_DAY", "int"), ("N_X", "double")])


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_separated_text(spark, tmp_path, end):
    path = tmp_path / "nation.csv"
    path.write_bytes(end.join(["0| lead|1996-01-01|1.5", '1|"q"  |1998-12-31|2', "2|toolong|1996-01-02|-3", "3||1996-01-02|0"]).encode())
    got = sorted(map(tuple, delimited.read(spark, str(path), NATION, "istd").collect()))
    assert got == [(0, " lead", 19960101, 1.5), (1, '"q"', 19981231, 2.0), (2, "toolo", 19960102, -3.0), (3, "", 19960102, 0.0)]
    with pytest.raises(ValueError):
        delimited.read(spark, str(path), NATION, "isx?")


def test_workload(spark, tmp_path):
    (tmp_path / "nation.csv").write_text("\n".join(f"{i}|N{i}|{i % 5}|c " for i in range(25)))
    (tmp_path / "region.csv").write_text("\n".join(f"{i}|R{i}|c" for i in range(5)))
    (tmp_path / "orders.csv").write_text("\n".join(f"{i}|{i % 15}|O|{i}.5|1996-01-{i % 28 + 1:02d}|1-URGENT|Clerk|0| lead " for i in range(150)))
    w = Workload(only=("nation", "region", "orders"))
    db = Database(spark, str(tmp_path / "db"))
    with pytest.raises(ValueError):
        w.loadDataset(db, str(tmp_path))
    w.createRelations(db)
    with pytest.raises(ValueError):
        w.runOperations(db, 1)
    w.loadDataset(db, str(tmp_path))
    assert {n: db.known_count(n) for n in ("nation", "region", "orders")} == {"nation": 25, "region": 5, "orders": 150}
    first = db.table("orders").orderBy("O_ORDERKEY").first()
    assert (first.O_ORDERDATE, first.O_COMMENT) == (19960101, " lead")
    plain = Workload(only=("orders",), plain=True)
    other = Database(spark, str(tmp_path / "plain"))
    plain.createRelations(other)
    plain.loadDataset(other, str(tmp_path))
    first = other.table("orders").orderBy("o_orderkey").first()
    assert (first.o_orderdate, first.o_totalprice) == ("1996-01-01", 0.5) and dict(other.table("orders").dtypes)["o_totalprice"] == "float"
    for mode in (1, 2, 3, 4):
        got = w.runOperations(db, mode)
        assert got.tuples == 150 and got.throughput > 0
    with pytest.raises(ValueError):
        w.runOperations(db, 5)
    with pytest.raises(ValueError):
        Workload(only=("part",)).runWorkload(spark, str(tmp_path), 1.0, 1)
    w.createRelations(db)
    w.loadDataset(db, str(tmp_path), 0.5)
    assert 30 < db.known_count("orders") < 120


def test_random_reads_fetch_whole_rows(spark, tmp_path):
    (tmp_path / "orders.csv").write_text("\n".join(f"{i // 2}|{i % 15}|O|{i}.5|1996-01-{i % 28 + 1:02d}|1-URGENT|Clerk|0| lead " for i in range(150)))
    w = Workload(only=("orders",))
    db = Database(spark, str(tmp_path / "db"))
    w.createRelations(db)
    w.loadDataset(db, str(tmp_path))
    every = sum(r[0] for r in db.table("orders").selectExpr("xxhash64(struct(*))").collect())
    got = {share: w.randomizedOperations(db, ["orders"], share) for share in (0.0, 0.2, 0.5, 1.0)}
    assert {r.tuples for r in got.values()} == {150}
    assert got[0].checksum == got[1].checksum == every  # each row once, in turn and out of turn
    assert len({got[0.2].checksum, got[0.5].checksum, w.randomizedOperations(db, ["orders"], 0.5, seed=1).checksum, every}) == 4


def test_a_scan_reads_every_column(db):
    plan = scanned(db.table("employee"))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:int,age:int>" in plan


def test_readers_outlive_changes(db):
    old = db.table("employee")
    db.deleteTuple("employee", "age >= 30")
    db.updateTuple("employee", {"id": 1}, {"age": 0})
    assert old.count() == 20 and len(ids(db.table("employee"))) == 5
    db.vacuum("employee")
    assert len(ids(db.table("employee"))) == 5


def test_primary_keys_stay_unique(db, spark):
    db.createIndex("employee", ID, primary=True)
    db.insertTuple("employee", (100, 1))
    more = spark.createDataFrame([(200, 1), (200, 2)], "id int, age int")
    for change in (
        lambda: db.insertTuple("employee", (3, 1)),
        lambda: db.insertTuple("employee", (100, 2)),
        lambda: db.insert("employee", more),
        lambda: db.insert("employee", spark.createDataFrame([(5, 1)], "id int, age int")),
        lambda: db.updateByKey("employee", 3, {"id": 4}),
        lambda: db.updateTuple("employee", "id < 2", {"id": 300}),
    ):
        with pytest.raises(ValueError):
            change()
    assert ids(db.table("employee")) == [*range(20), 100]
    db.updateByKey("employee", 3, {"id": 300})
    db.updateTuple("employee", "id < 2", {"age": 0})
    db.insert("employee", more.limit(1))
    assert ids(db.table("employee")) == sorted({*range(20), 100, 200, 300} - {3})


def test_an_index_in_buckets(db, spark):
    index = db.createIndex("employee", ID)
    db.buildIndex(index, 4)
    other = db.relationSchema("employee").rename("employee2", {"id": "id2", "age": "age2"})
    q = db.query().fromTable("employee").join(db.query().fromTable("employee"), rhsSchema=other, method="indexed", lhsKeySchema=ID, indexId=index).finalize()
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        df = q.dataframe()
        assert sorted((r.id, r.id2) for r in df.collect()) == [(i, i) for i in range(20)]
        plan = df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "Bucketed: true" in plan
        executed = df._jdf.queryExecution().executedPlan().toString()
        final = executed[: executed.index("== Initial Plan")] if "== Initial Plan" in executed else executed
        assert final.count("Exchange hashpartitioning") <= 1 and "Sort [" not in final
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    assert ids(db.lookupByIndex(index, 7)) == [7]
    db.insertTuple("employee", (7, 1))
    assert db.indexed(index) is None and ids(db.lookupByIndex(index, 7)) == [7, 7]
    db.buildIndex(index, 2)
    assert ids(db.lookupByIndex(index, 7)) == [7, 7]
    db.removeIndex("employee", index)


def test_pages_where_the_rows_are(db):
    import pyarrow as pa

    sizes = db.mapPages("employee", lambda page: pa.RecordBatch.from_arrays([pa.array([page.num_rows])], ["n"]), "n long", rows=8)
    got = [r.n for r in sizes.collect()]
    assert sum(got) == 20 and max(got) <= 8
