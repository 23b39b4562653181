"""The registered queries of the relational engine, each with its DuckDB SQL."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeframe.functions.types import Schema
from lodeframe.plans import PlanBuilder
from lodeframe.sources import delimited
from lodeframe.sources.catalog import Database

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def database(spark: SparkSession, sf_dir: str) -> Database:
    """The tables of a folder as external relations."""
    db = Database(spark)
    for t in TABLES:
        db.attach(t, f"{sf_dir}/{t}.parquet")
    return db


def registered(sql: str) -> Callable:
    """Register f(db), which gives a builder, a plan or a DataFrame, under its name with its SQL."""

    def wrap(f: Callable[[Database], PlanBuilder | DataFrame]) -> Callable:
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            got = f(database(spark, sf_dir))
            return got if isinstance(got, DataFrame) else (got.finalize() if isinstance(got, PlanBuilder) else got).dataframe()

        _QUERIES[f.__name__], _SQL[f.__name__] = query, sql
        return f

    return wrap


def same(*names: str, kind: str = "bigint") -> dict[str, tuple[str, str]]:
    return {n: (n, kind) for n in names}


def key(*fields: tuple[str, str]) -> Schema:
    from lodeframe.functions.types import declared

    return Schema.from_types("key", [(n, declared(t)) for n, t in fields])


@registered("SELECT * FROM nation")
def scan_nation(db: Database) -> PlanBuilder:
    return db.query().fromTable("nation")


@registered("SELECT * FROM orders WHERE o_totalprice > 1000 AND o_orderstatus = 'O'")
def select_pred(db: Database) -> PlanBuilder:
    return db.query().fromTable("orders").where("o_totalprice > 1000 and o_orderstatus == 'O'")


@registered("SELECT l_orderkey AS k, (l_linenumber * 2 + 1)::BIGINT AS x FROM lineitem")
def project_expr(db: Database) -> PlanBuilder:
    return db.query().fromTable("lineitem").select({"k": ("l_orderkey", "bigint"), "x": ("l_linenumber * 2 + 1", "bigint")})


@registered("SELECT p_partkey, round(sqrt(p_retailprice), 4) AS root FROM part")
def project_fn_sqrt(db: Database) -> DataFrame:
    got = db.query().fromTable("part").select({"p_partkey": ("p_partkey", "bigint"), "root": ("math.sqrt(p_retailprice)", "double")}).finalize()
    return got.dataframe().withColumn("root", F.round("root", 4))


@registered("SELECT * FROM customer UNION ALL SELECT * FROM customer")
def union_all_self(db: Database) -> PlanBuilder:
    return db.query().fromTable("customer").union(db.query().fromTable("customer"))


@registered("SELECT * FROM nation JOIN region ON n_regionkey < r_regionkey")
def join_theta_nl(db: Database) -> PlanBuilder:
    return db.query().fromTable("nation").join(db.query().fromTable("region"), method="nested-loops", expr="n_regionkey < r_regionkey")


@registered("SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_bnl_eq(db: Database) -> PlanBuilder:
    return db.query().fromTable("nation").join(db.query().fromTable("region"), method="block-nested-loops", expr="n_regionkey == r_regionkey")


@registered("SELECT * FROM orders JOIN customer ON o_custkey = c_custkey AND o_totalprice > c_acctbal")
def join_hash_residual(db: Database) -> PlanBuilder:
    return db.query().fromTable("orders").join(db.query().fromTable("customer"), method="hash", lhsHashFn="hash(o_custkey) % 4", lhsKeySchema=key(("o_custkey", "bigint")), rhsHashFn="hash(c_custkey) % 4", rhsKeySchema=key(("c_custkey", "bigint")), expr="o_totalprice > c_acctbal")


@registered("SELECT l.l_orderkey, l.l_linenumber, m.l_quantity AS other FROM lineitem l JOIN lineitem m ON l.l_orderkey = m.l_orderkey AND l.l_linenumber = m.l_linenumber")
def join_hash_two_keys(db: Database) -> PlanBuilder:
    left = db.query().fromTable("lineitem").select({"l_orderkey": ("l_orderkey", "bigint"), "l_linenumber": ("l_linenumber", "int")})
    right = db.query().fromTable("lineitem").select({"a": ("l_orderkey", "bigint"), "b": ("l_linenumber", "int"), "other": ("l_quantity", "double")})
    joined = left.join(right, method="hash", lhsHashFn="hash(l_orderkey) % 8", lhsKeySchema=key(("l_orderkey", "bigint"), ("l_linenumber", "int")), rhsHashFn="hash(a) % 8", rhsKeySchema=key(("a", "bigint"), ("b", "int")))
    return joined.select({"l_orderkey": ("l_orderkey", "bigint"), "l_linenumber": ("l_linenumber", "int"), "other": ("other", "double")})


@registered("SELECT a.n_nationkey AS n_nationkey, b.n_nationkey AS key2, b.n_name AS name2 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self_rename(db: Database) -> PlanBuilder:
    other = db.relationSchema("nation").rename("nation2", {"n_nationkey": "key2", "n_name": "name2", "n_regionkey": "region2"})
    joined = db.query().fromTable("nation").join(db.query().fromTable("nation"), rhsSchema=other, method="block-nested-loops", expr="n_regionkey == region2 and n_nationkey < key2")
    return joined.select({"n_nationkey": ("n_nationkey", "int"), "key2": ("key2", "int"), "name2": ("name2", "string")})


@registered("SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def join_index(db: Database) -> PlanBuilder:
    index = db.createIndex("orders", key(("o_orderkey", "bigint")), primary=False)
    joined = db.query().fromTable("lineitem").join(db.query().fromTable("orders"), method="indexed", lhsKeySchema=key(("l_orderkey", "bigint")), indexId=index)
    return joined.select({"l_orderkey": ("l_orderkey", "bigint"), "l_linenumber": ("l_linenumber", "int"), "o_custkey": ("o_custkey", "bigint")})


@registered("SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey < 300")
def join_index_built(db: Database) -> PlanBuilder:
    """Over a copy in buckets of the key: the right side stays where it is."""
    _own(db, "orders", "o_custkey < 300", ("o_orderkey", "o_custkey"))
    index = db.createIndex("own", key(("o_orderkey", "double")))
    db.buildIndex(index, 8)
    left = db.query().fromTable("lineitem").select({"k": ("l_orderkey", "double"), "l_orderkey": ("l_orderkey", "bigint"), "l_linenumber": ("l_linenumber", "int")})
    joined = left.join(db.query().fromTable("own"), method="indexed", lhsKeySchema=key(("k", "double")), indexId=index)
    return joined.select({"l_orderkey": ("l_orderkey", "bigint"), "l_linenumber": ("l_linenumber", "int"), "o_custkey": ("o_custkey", "bigint")})


@registered("SELECT o_custkey, least(9223372036854775807, min(o_orderkey))::BIGINT AS low, greatest(0, max(-o_orderkey))::BIGINT AS high FROM orders GROUP BY o_custkey")
def groupby_minmax_sentinel(db: Database) -> PlanBuilder:
    return db.query().fromTable("orders").groupBy(groupSchema=key(("o_custkey", "bigint")), aggSchema=key(("low", "bigint"), ("high", "bigint")), groupExpr=lambda e: e.o_custkey, aggExprs=[(sys.maxsize, lambda acc, e: min(acc, e.o_orderkey), lambda x: x), (0, lambda acc, e: max(acc, -e.o_orderkey), lambda x: x)], groupHashFn=lambda k: hash(k) % 2)


@registered("SELECT l_orderkey, (sum(l_linenumber) * 2)::BIGINT AS twice FROM lineitem GROUP BY l_orderkey")
def groupby_fold_generic(db: Database) -> PlanBuilder:
    return db.query().fromTable("lineitem").groupBy(groupSchema=key(("l_orderkey", "bigint")), aggSchema=key(("twice", "bigint")), groupExpr=lambda e: e.l_orderkey, aggExprs=[(0, lambda acc, e: acc + e.l_linenumber, lambda x: x * 2)], groupHashFn=lambda k: hash(k) % 2)


@registered("SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') AS n FROM orders GROUP BY o_custkey")
def groupby_fold_python(db: Database) -> PlanBuilder:
    """A step with a choice, which runs in Python over the two columns it reads."""
    return db.query().fromTable("orders").groupBy(groupSchema=key(("o_custkey", "bigint")), aggSchema=key(("n", "bigint")), groupExpr=lambda e: e.o_custkey, aggExprs=[(0, lambda acc, e: acc + 1 if e.o_orderstatus == "O" else acc, lambda x: x)], groupHashFn=lambda k: hash(k) % 2)


@registered("SELECT o_custkey, xor(bit_xor(o_orderkey), 5) AS odd, bit_or(o_orderkey) | 1 AS some, bit_and(o_orderkey) & 255 AS every FROM orders GROUP BY o_custkey")
def groupby_fold_bits(db: Database) -> PlanBuilder:
    folds = [(5, lambda acc, e: acc ^ e.o_orderkey, lambda x: x), (1, lambda acc, e: acc | e.o_orderkey, lambda x: x), (255, lambda acc, e: acc & e.o_orderkey, lambda x: x)]
    return db.query().fromTable("orders").groupBy(groupSchema=key(("o_custkey", "bigint")), aggSchema=key(("odd", "bigint"), ("some", "bigint"), ("every", "bigint")), groupExpr=lambda e: e.o_custkey, aggExprs=folds, groupHashFn=lambda k: hash(k) % 2)


@registered("SELECT o_custkey, bit_xor(o_orderkey) AS bits FROM orders GROUP BY o_custkey")
def groupby_fold_xor(db: Database) -> PlanBuilder:
    return db.query().fromTable("orders").select(same("o_custkey", "o_orderkey")).groupBy(groupSchema=key(("o_custkey", "bigint")), aggSchema=key(("bits", "bigint")), groupExpr=lambda e: e.o_custkey, aggExprs=[(0, lambda acc, e: acc ^ e.o_orderkey, lambda x: x)], groupHashFn=lambda k: hash(k) % 2)


@registered("SELECT l_returnflag, round(avg(l_linenumber), 6) AS mean, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def groupby_avg_tuple(db: Database) -> DataFrame:
    got = db.query().fromTable("lineitem").groupBy(groupSchema=key(("l_returnflag", "string")), aggSchema=key(("mean", "double"), ("n", "bigint")), groupExpr=lambda e: e.l_returnflag, aggExprs=[((0, 0), lambda acc, e: (acc[0] + e.l_linenumber, acc[1] + 1), lambda a: a[0] / a[1]), (0, lambda acc, e: acc + 1, lambda x: x)], groupHashFn=lambda k: hash(k) % 2)
    return got.finalize().dataframe().withColumn("mean", F.round("mean", 6))


@registered("SELECT (o_orderkey % 7)::BIGINT AS day, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL")
def groupby_computed_key(db: Database) -> PlanBuilder:
    return db.query().fromTable("orders").groupBy(groupSchema=key(("day", "bigint"), ("status", "string")), aggSchema=key(("n", "bigint")), groupExpr=lambda e: (e.o_orderkey % 7, e.o_orderstatus), aggExprs=[(0, lambda acc, e: acc + 1, lambda x: x)], groupHashFn=lambda k: hash(k[0]) % 2)


@registered("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10")
def where_after_groupby(db: Database) -> PlanBuilder:
    return db.query().fromTable("orders").groupBy(groupSchema=key(("o_custkey", "bigint")), aggSchema=key(("n", "bigint")), groupExpr=lambda e: e.o_custkey, aggExprs=[(0, lambda acc, e: acc + 1, lambda x: x)], groupHashFn=lambda k: hash(k) % 2).where("n > 10")


def _placed(df: DataFrame) -> DataFrame:
    """Each row with its place in the order in which it comes."""
    return df.withColumn("place", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())))


@registered("SELECT p_size, p_partkey FROM part ORDER BY p_size, p_partkey")
def sort_asc(db: Database) -> PlanBuilder:
    return db.query().fromTable("part").order(sortKeyFn=lambda t: (t.p_size, t.p_partkey), sortKeyDesc="size and key").select({"p_size": ("p_size", "int"), "p_partkey": ("p_partkey", "bigint")})


@registered("SELECT p_size, p_partkey, row_number() OVER (ORDER BY p_size, p_partkey)::INTEGER AS place FROM part")
def sort_order(db: Database) -> DataFrame:
    """The order itself: each row's place in the sorted result."""
    return _placed(sort_asc(db).finalize().dataframe())


_FOUR = "SELECT c_custkey, o_orderkey, n_name, r_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_totalprice > 50000 AND r_name <> 'ASIA'"


def _four(db: Database) -> PlanBuilder:
    q = db.query().fromTable("orders").join(db.query().fromTable("customer"), method="block-nested-loops", expr="o_custkey == c_custkey")
    q = q.join(db.query().fromTable("nation"), method="block-nested-loops", expr="c_nationkey == n_nationkey")
    q = q.join(db.query().fromTable("region"), method="block-nested-loops", expr="n_regionkey == r_regionkey")
    return q.where("o_totalprice > 50000 and r_name != 'ASIA'").select({"c_custkey": ("c_custkey", "bigint"), "o_orderkey": ("o_orderkey", "bigint"), "n_name": ("n_name", "string"), "r_name": ("r_name", "string")})


@registered("SELECT n_name, count(*) AS n FROM (" + _FOUR + ") GROUP BY n_name")
def multiway_join(db: Database) -> PlanBuilder:
    return _four(db).groupBy(groupSchema=key(("n_name", "string")), aggSchema=key(("n", "bigint")), groupExpr=lambda e: e.n_name, aggExprs=[(0, lambda acc, e: acc + 1, lambda x: x)], groupHashFn=lambda k: hash(k) % 2)


def _optimized(db: Database, name: str):
    db.setQueryOptimizer(name)
    return db.optimizeQuery(_four(db).finalize())


@registered(_FOUR)
def order_leftdeep(db: Database):
    return _optimized(db, "LeftDeepOptimizer")


@registered(_FOUR)
def order_bushy(db: Database):
    return _optimized(db, "BushyOptimizer")


@registered(_FOUR)
def order_greedy(db: Database):
    return _optimized(db, "GreedyOptimizer")


@registered(_FOUR)
def pushdown(db: Database):
    return _four(db).finalize().pushdownOperators()


@registered("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d')::INTEGER AS day FROM orders")
def date_int(db: Database) -> DataFrame:
    return db.table("orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").cast("int").alias("day"))


@registered("SELECT p_partkey, ((((p_size - 25) % 7) + 7) % 7)::BIGINT AS rest FROM part")
def floor_mod(db: Database) -> PlanBuilder:
    return db.query().fromTable("part").select({"p_partkey": ("p_partkey", "bigint"), "rest": ("(p_size - 25) % 7", "bigint")})


@registered("SELECT p_partkey, floor((p_size - 25) / 7)::BIGINT AS whole FROM part")
def floor_div(db: Database) -> PlanBuilder:
    return db.query().fromTable("part").select({"p_partkey": ("p_partkey", "bigint"), "whole": ("(p_size - 25) // 7", "bigint")})


@registered("SELECT p_partkey, (p_size - 25) / 7::DOUBLE AS ratio, (p_size * p_size)::BIGINT AS square, 1 / (p_size::DOUBLE * p_size) AS inverse FROM part")
def true_division_and_power(db: Database) -> PlanBuilder:
    return db.query().fromTable("part").select({"p_partkey": ("p_partkey", "bigint"), "ratio": ("(p_size - 25) / 7", "double"), "square": ("p_size ** 2", "bigint"), "inverse": ("1 / p_size ** 2", "double")})


@registered("SELECT p_partkey, (p_size & 12 | xor(p_size, 3))::BIGINT AS bits, (p_size << 3)::BIGINT AS up, (p_size >> 2)::BIGINT AS down, (~p_size)::BIGINT AS turned FROM part WHERE p_size & 1 = 1")
def bit_operators(db: Database) -> PlanBuilder:
    return db.query().fromTable("part").where("p_size & 1 == 1").select({"p_partkey": ("p_partkey", "bigint"), "bits": ("p_size & 12 | p_size ^ 3", "bigint"), "up": ("p_size << 3", "bigint"), "down": ("p_size >> 2", "bigint"), "turned": ("~p_size", "bigint")})


@registered("SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9) AND p_brand NOT IN ('Brand#11')")
def in_list(db: Database) -> PlanBuilder:
    return db.query().fromTable("part").where("p_size in [1, 5, 9] and p_brand not in ('Brand#11',)").select(same("p_partkey"))


@registered("SELECT p_partkey FROM part WHERE 3 < p_size AND p_size <= 9")
def chained_compare(db: Database) -> PlanBuilder:
    return db.query().fromTable("part").where("3 < p_size <= 9").select(same("p_partkey"))


@registered("SELECT p_partkey, upper(substr(p_name, 1, 5)) AS head, length(p_name)::BIGINT AS n, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS size FROM part WHERE starts_with(p_brand, 'Brand#1') OR p_type = ''")
def string_functions(db: Database) -> PlanBuilder:
    return db.query().fromTable("part").where("p_brand.startswith('Brand#1') or not p_type").select({"p_partkey": ("p_partkey", "bigint"), "head": ("p_name[:5].upper()", "string"), "n": ("len(p_name)", "bigint"), "size": ("'large' if p_size > 25 else 'small'", "string")})


@registered("SELECT p_partkey, reverse(p_name) AS back FROM part")
def project_python(db: Database) -> PlanBuilder:
    return db.query().fromTable("part").select({"p_partkey": ("p_partkey", "bigint"), "back": ("p_name[::-1]", "string")})


@registered("SELECT * FROM (SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey AS k FROM customer) WHERE k > 12")
def filter_over_union(db: Database):
    left = db.query().fromTable("supplier").select({"k": ("s_nationkey", "int")})
    right = db.query().fromTable("customer").select({"k": ("c_nationkey", "int")})
    return left.union(right).where("k > 12").finalize().pushdownOperators()


@registered("SELECT count(p_size) AS n, min(p_size) AS low, max(p_size) AS high, count(DISTINCT p_size) AS \"distinct\" FROM part")
def stats_card(db: Database) -> DataFrame:
    return db.spark.createDataFrame([db.columnStats("part", "p_size")], "n long, low int, high int, distinct long")


@registered("SELECT count(*)::DOUBLE AS estimate FROM orders WHERE o_totalprice > 1000")
def sample_whole(db: Database) -> DataFrame:
    plan = db.query().fromTable("orders").where("o_totalprice > 1000").finalize()
    return db.spark.createDataFrame([(float(plan.sample(1)),)], "estimate double")


@registered("SELECT true AS near, true AS whole FROM (SELECT count(*) FROM orders)")
def sample_bounds(db: Database) -> DataFrame:
    """The estimate from about a fourth of the rows is within a tenth of the number; reads at factor 1 give the number itself."""
    plan = db.query().fromTable("orders").where("o_totalprice > 1000").finalize()
    n = plan.dataframe().count()
    return db.spark.createDataFrame([(abs(plan.sample(4) - n) <= max(0.1 * n, 60), plan.sample(1) == n)], "near boolean, whole boolean")


@registered("SELECT * FROM orders WHERE o_orderkey = 7")
def index_lookup(db: Database) -> DataFrame:
    return db.lookupByIndex(db.createIndex("orders", key(("o_orderkey", "bigint"))), 7)


def _own(db: Database, table: str, condition: str = "true", columns: tuple[str, ...] = ()) -> Database:
    """The relation with rows of its own, so that it can change."""
    source = db.table(table).filter(condition).select(*(columns or ["*"]))
    fields = [(f.name, {"bigint": "double", "string": "text(200)"}.get(f.dataType.simpleString(), f.dataType.simpleString())) for f in source.schema]
    db.createRelation("own", fields)
    db.insert("own", source)
    return db


@registered("SELECT * FROM nation WHERE n_regionkey <> 2")
def delete_result(db: Database) -> DataFrame:
    _own(db, "nation").deleteTuple("own", "n_regionkey == 2")
    return db.table("own")


@registered("SELECT CASE WHEN n_nationkey = 3 THEN 103 ELSE n_nationkey END AS n_nationkey, CASE WHEN n_nationkey = 3 THEN 'none' ELSE n_name END AS n_name, n_regionkey FROM nation")
def update_by_key(db: Database) -> DataFrame:
    _own(db, "nation").createIndex("own", Schema("key", [("n_nationkey", "int")]), primary=True)
    db.updateByKey("own", 3, {"n_nationkey": 103, "n_name": "none"})
    return db.table("own")


@registered("SELECT CASE WHEN n_regionkey = 1 THEN 0 ELSE n_nationkey END AS n_nationkey, CASE WHEN n_regionkey = 1 THEN '' ELSE n_name END AS n_name, CASE WHEN n_regionkey = 1 THEN 0 ELSE n_regionkey END AS n_regionkey FROM nation")
def clear_result(db: Database) -> DataFrame:
    _own(db, "nation").clearTuple("own", {"n_regionkey": 1})
    return db.table("own")


@registered("SELECT * FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey < 2)")
def delete_by_keys(db: Database) -> DataFrame:
    _own(db, "nation").deleteKeys("own", db.table("region").filter("r_regionkey < 2").select(F.col("r_regionkey").alias("n_regionkey")))
    return db.table("own")


@registered("SELECT * FROM nation")
def delimited_files(db: Database) -> DataFrame:
    """Written as separated text and read again."""
    import uuid

    path = f"{db.spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/lodeframe/text-{uuid.uuid4().hex}"
    db.table("nation").write.csv(path, sep="|", quote="", escape="")
    return delimited.read(db.spark, path, Schema("nation", [("n_nationkey", "int"), ("n_name", "char(25)"), ("n_regionkey", "int")]))


@registered("SELECT n_nationkey AS N_NATIONKEY, n_name AS N_NAME, n_regionkey AS N_REGIONKEY, 'a comment' AS N_COMMENT FROM nation")
def dataset_load(db: Database) -> DataFrame:
    """The workload's relations, from files in its format."""
    return _loaded(db, plain=False)


@registered("SELECT n_nationkey, n_name, n_regionkey, 'a comment' AS n_comment FROM nation")
def dataset_load_imported(db: Database) -> DataFrame:
    """In the variant of plain imports."""
    return _loaded(db, plain=True)


def _loaded(db: Database, plain: bool) -> DataFrame:
    import uuid

    from lodeframe.sources.workload import Workload

    folder = f"{db.spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/lodeframe/load-{uuid.uuid4().hex}"
    db.table("nation").select("n_nationkey", "n_name", "n_regionkey", F.lit("a comment")).write.csv(f"{folder}/nation.csv", sep="|", quote="", escape="")
    own, work = Database(db.spark), Workload(only=("nation",), plain=plain)
    work.createRelations(own)
    work.loadDataset(own, folder)
    return own.table("nation")


@registered("SELECT (SELECT count(*) FROM part) AS rows, true AS whole, (SELECT count(*) FROM part) AS stated")
def page_headers(db: Database) -> DataFrame:
    """Rows by the files' headers, and by the relation's statistics."""
    stats = _own(db, "part").relationStats("own")
    got = db.headers("own").agg(F.sum("rows").alias("rows"), F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    return got.select("rows", ((F.col("n") == stats["files"]) & (F.col("bytes") <= stats["bytes"])).alias("whole"), F.lit(stats["rows"]).cast("long").alias("stated"))


@registered("SELECT n_nationkey, CASE WHEN n_regionkey = 2 AND n_nationkey > 8 THEN 'far' ELSE n_name END AS n_name, n_regionkey FROM nation")
def update_by_condition(db: Database) -> DataFrame:
    _own(db, "nation").updateTuple("own", "n_regionkey == 2 and n_nationkey > 8", {"n_name": "far"})
    return db.table("own")


@registered("SELECT n_nationkey, n_name, n_regionkey, 3::BIGINT AS refused FROM nation")
def primary_key_conflict(db: Database) -> DataFrame:
    """A row, rows and a change that would repeat a primary key are refused, and nothing of them stays."""
    _own(db, "nation").createIndex("own", Schema("key", [("n_nationkey", "int")]), primary=True)
    refused = 0
    for change in (lambda: db.insertTuple("own", (3, "again", 0)), lambda: db.insert("own", db.table("nation").limit(2)), lambda: db.updateByKey("own", 3, {"n_nationkey": 4})):
        try:
            change()
        except ValueError:
            refused += 1
    return db.table("own").withColumn("refused", F.lit(refused).cast("long"))


@registered("SELECT * FROM nation")
def reader_outlives_change(db: Database) -> DataFrame:
    """A result over rows that have changed since."""
    before = _own(db, "nation").table("own")
    db.deleteTuple("own", "n_regionkey == 2")
    db.clearTuple("own", "n_regionkey == 1")
    return before


@registered("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey)::INTEGER AS place FROM orders WHERE o_custkey < 200")
def index_scan_order(db: Database) -> DataFrame:
    """The order of an index scan."""
    _own(db, "orders", "o_custkey < 200", ("o_orderkey", "o_custkey"))
    return _placed(db.scanByIndex(db.createIndex("own", key(("o_orderkey", "double")))).select(F.col("o_orderkey").cast("long").alias("o_orderkey")))


@registered("SELECT o_orderkey FROM orders ORDER BY o_orderkey")
def index_scan(db: Database) -> DataFrame:
    return db.scanByIndex(db.createIndex("orders", key(("o_orderkey", "bigint")))).select("o_orderkey")


@registered("SELECT (SELECT count(*) FROM lineitem) + (SELECT count(*) FROM orders) AS tuples")
def workload_scan(db: Database) -> DataFrame:
    from lodeframe.sources.workload import Workload

    return db.spark.createDataFrame([(Workload().scanRelations(db, ["lineitem", "orders"]).tuples,)], "tuples long")


@registered("SELECT (SELECT count(*) FROM lineitem) + (SELECT count(*) FROM orders) AS tuples")
def workload_random(db: Database) -> DataFrame:
    from lodeframe.sources.workload import SHARES, Workload

    return db.spark.createDataFrame([(Workload().randomizedOperations(db, ["lineitem", "orders"], SHARES[3]).tuples,)], "tuples long")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
