"""Named relations: definition, rows, changes, indexes, and their catalog on disk.

A relation is a chain of Parquet snapshots in a folder of the data directory. Appends add files to the current
snapshot; a change writes a new one and then moves the catalog's pointer. Snapshots that are out of date stay until vacuum() or
close(), so that readers go on with the rows they began with. Rows have no ids of their own: changes name them by key or by
condition. An index is the record of a key; a primary one is kept unique by every insert and update. Lookups by an index are filters
that reach Parquet's statistics; writeSorted() stores a relation in key order so that these skip files, and
buildIndex() a copy in buckets of the key, which joins and lookups use for as long as the relation doesn't change.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lodeframe.functions import expr
from lodeframe.functions.types import Schema, unpack
from lodeframe.plans import Plan, PlanBuilder
from lodeframe.plans.search import OPTIMIZERS, Search
from lodeframe.sources import files


@dataclass(frozen=True)
class Index:
    """A key of a relation; a primary one is unique, and a relation has one at most."""

    id: int
    relation: str
    key: Schema
    primary: bool


@dataclass
class Relation:
    schema: Schema | None
    path: str | None
    external: bool = False
    indexes: dict[int, Index] = field(default_factory=dict)
    count: int | None = None
    #: snapshots that are out of date, and how often rows changed
    old: list[str] = field(default_factory=list)
    version: int = 0
    #: by index: the table of its copy in buckets, and the version it is of
    copies: dict[int, tuple[str, int]] = field(default_factory=dict)


def _repeats(df: DataFrame, names: list[str]) -> bool:
    return bool(df.groupBy(*names).count().filter("count > 1").limit(1).count())


class Database:
    """The session's relations. `pool` and `page` only matter to the cost model of other engines, and are kept for scripts that pass them."""

    def __init__(self, spark: SparkSession, dataDir: str | None = None, restore: bool = False, pageSize: int | None = None, poolSize: int | None = None):
        self.spark = spark
        #: without a folder of its own, a database keeps its catalog in memory, and snapshots in the warehouse
        self.dataDir = dataDir.rstrip("/") if dataDir else None
        self.pageSize, self.poolSize = pageSize, poolSize
        self._relations: dict[str, Relation] = {}
        self._pending: dict[str, list[tuple]] = {}
        self._next_index = 0
        self.optimizer: Search = OPTIMIZERS["GreedyOptimizer"](self)
        if restore:
            self.restore()

    # catalog

    def relations(self) -> list[str]:
        return list(self._relations)

    def hasRelation(self, name: str) -> bool:
        return name in self._relations

    def relationSchema(self, name: str) -> Schema | None:
        return self._known(name).schema if name in self._relations else None

    def _known(self, name: str) -> Relation:
        if name not in self._relations:
            raise ValueError(f"no relation {name!r}")
        r = self._relations[name]
        if r.schema is None:
            r.schema = Schema.of(name, self.spark.read.parquet(r.path))
        return r

    def createRelation(self, name: str, fields: list[tuple[str, str]]) -> None:
        if name in self._relations:
            raise ValueError(f"relation {name!r} is there already")
        self._relations[name] = Relation(Schema(name, fields), None)
        self.checkpoint()

    def attach(self, name: str, path: str, schema: Schema | None = None) -> None:
        """A relation over Parquet files that stay where they are; removing it leaves them.

        Without a schema, that of the files holds; it is read when the relation is used first.
        """
        if name in self._relations:
            raise ValueError(f"relation {name!r} is there already")
        self._relations[name] = Relation(schema, path, external=True)
        self.checkpoint()

    def removeRelation(self, name: str, detach: bool = False) -> str | None:
        """Drop a relation and, unless it is detached or external, its files. A detached one's path can be attached again."""
        r = self._known(name)
        self._flush(name)
        self.vacuum(name)
        for number in list(r.copies):
            self._drop_copy(r, number)
        del self._relations[name]
        self.checkpoint()
        if r.path and not (detach or r.external):
            files.delete(self.spark, r.path)
        return r.path if detach else None

    def checkpoint(self) -> None:
        if self.dataDir:
            files.write_text(self.spark, f"{self.dataDir}/catalog.json", self.pack())

    def pack(self) -> str:
        return json.dumps(
            {
                "relations": {n: {"schema": r.schema and r.schema.pack(), "path": r.path, "external": r.external, "count": r.count, "old": r.old, "indexes": [{"id": i.id, "key": i.key.pack(), "primary": i.primary} for i in r.indexes.values()]} for n, r in self._relations.items()},
                "next_index": self._next_index,
            }
        )

    def restore(self) -> None:
        got = json.loads(files.read_text(self.spark, f"{self.dataDir}/catalog.json"))
        self._next_index = got["next_index"]
        self._relations = {n: Relation(r["schema"] and unpack(r["schema"]), r["path"], r["external"], {i["id"]: Index(i["id"], n, unpack(i["key"]), i["primary"]) for i in r["indexes"]}, r["count"], r.get("old", [])) for n, r in got["relations"].items()}

    def close(self) -> None:
        for name in list(self._pending):
            self._flush(name)
        self.vacuum()
        self.checkpoint()

    def vacuum(self, name: str | None = None) -> None:
        """Remove snapshots that are out of date; DataFrames over them can't be read any more."""
        for r in [self._known(name)] if name else self._relations.values():
            for path in r.old:
                files.delete(self.spark, path)
            r.old = []

    # rows

    def table(self, name: str) -> DataFrame:
        """All rows of a relation."""
        r = self._known(name)
        self._flush(name)
        if r.path is None:
            return self.spark.createDataFrame([], r.schema.struct)
        return self.spark.read.schema(r.schema.struct).parquet(r.path)

    def _flush(self, name: str) -> None:
        rows = self._pending.pop(name, [])
        if rows:
            self._append(name, self.spark.createDataFrame(rows, self._known(name).schema.struct), unique=True)

    def _stored(self, name: str) -> DataFrame | None:
        r = self._known(name)
        return self.spark.read.schema(r.schema.struct).parquet(r.path) if r.path else None

    def _append(self, name: str, df: DataFrame, unique: bool = False) -> None:
        r = self._known(name)
        if r.external:
            raise ValueError(f"relation {name!r} is external; its files don't change")
        primary = self.primaryIndex(name)
        if primary is not None and not unique:
            names, stored = primary.key.names, self._stored(name)
            if _repeats(df, names) or stored is not None and df.select(*names).join(stored.select(*names), names, "left_semi").limit(1).count():
                raise ValueError(f"a primary key of {name!r} can't repeat")
        path, new = r.path or self._snapshot(name), r.path is None
        df.write.mode("append").parquet(path)
        r.count, r.version = None, r.version + 1
        if new:
            r.path = path
        self.checkpoint()

    def _snapshot(self, name: str) -> str:
        home = self.dataDir or f"{self.spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/lodeframe"
        return f"{home}/{name}/{uuid.uuid4().hex}"

    def insertTuple(self, name: str, row: Iterable) -> None:
        """One row; rows are written together before the relation is read next. ValueError for a primary key that is there already."""
        r = self._known(name)
        if r.external:
            raise ValueError(f"relation {name!r} is external; its files don't change")
        row = tuple(r.schema.stored(tuple(row)))
        primary = self.primaryIndex(name)
        if primary is not None:
            at = [r.schema.names.index(k) for k in primary.key.names]
            own, stored = tuple(row[i] for i in at), self._stored(name)
            waiting = any(tuple(other[i] for i in at) == own for other in self._pending.get(name, ()))
            if waiting or stored is not None and stored.filter(self._matching(name, self._key(primary, own))).limit(1).count():
                raise ValueError(f"a primary key of {name!r} can't repeat: {own}")
        self._pending.setdefault(name, []).append(row)
        if len(self._pending[name]) >= 10_000:
            self._flush(name)

    def insert(self, name: str, df: DataFrame) -> None:
        """All rows of a DataFrame, columns by place, in the relation's types; none if a primary key would repeat (ValueError)."""
        self._flush(name)
        self._append(name, self._known(name).schema.cast(df))

    def _replace(self, name: str, df: DataFrame) -> None:
        r = self._known(name)
        if r.external:
            raise ValueError(f"relation {name!r} is external; its files don't change")
        old, path = r.path, self._snapshot(name)
        df.write.parquet(path)
        r.path, r.count, r.version = path, None, r.version + 1
        if old:
            r.old.append(old)
        self.checkpoint()

    def _matching(self, name: str, condition: str | dict[str, object]) -> Column:
        schema = self._known(name).schema
        if isinstance(condition, str):
            return expr.predicate(condition, schema.struct)
        out = F.lit(True)
        for k, v in condition.items():
            if k not in schema.names:
                raise ValueError(f"no field {k!r} in {name!r}")
            out = out & (F.col(f"`{k}`") == F.lit(v))
        return out

    def deleteTuple(self, name: str, condition: str | dict[str, object]) -> None:
        """The rows that a condition holds for go."""
        where = self._matching(name, condition)
        self._replace(name, self.table(name).filter(~F.coalesce(where, F.lit(False))))

    def updateTuple(self, name: str, condition: str | dict[str, object], row: Iterable | dict[str, object]) -> None:
        """The rows that a condition holds for become `row`, or get its fields if it is a dictionary; none if a primary key would repeat (ValueError)."""
        schema, where = self._known(name).schema, self._matching(name, condition)
        new = row if isinstance(row, dict) else dict(zip(schema.names, row, strict=True))
        unknown = set(new) - set(schema.names)
        if unknown:
            raise ValueError(f"no field {', '.join(unknown)} in {name!r}")
        df = self.table(name)
        changed = df.select(*(F.when(where, t.column(F.lit(new[f]))).otherwise(F.col(f"`{f}`")).alias(f) if f in new else F.col(f"`{f}`") for f, t in schema.fields))
        primary = self.primaryIndex(name)
        if primary is not None and set(primary.key.names) & set(new) and _repeats(changed, primary.key.names):
            raise ValueError(f"a primary key of {name!r} can't repeat")
        self._replace(name, changed)

    def clearTuple(self, name: str, condition: str | dict[str, object]) -> None:
        """The rows that a condition holds for stay as rows of default values."""
        self.updateTuple(name, condition, tuple(self._known(name).schema.default()))

    def deleteKeys(self, name: str, keys: DataFrame) -> None:
        """The rows whose key is among many: an anti join, so that neither side needs to fit anywhere."""
        self._replace(name, self.table(name).join(keys.distinct(), keys.columns, "left_anti"))

    def tuples(self, name: str) -> Iterator[Row]:
        return self.table(name).toLocalIterator()

    def pages(self, name: str, rows: int = 1024) -> Iterator[list[Row]]:
        page: list[Row] = []
        for row in self.tuples(name):
            page.append(row)
            if len(page) == rows:
                yield page
                page = []
        if page:
            yield page

    def mapPages(self, name: str, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = 1024) -> DataFrame:
        """f of each page of up to `rows` rows, as an Arrow batch: pages() where the rows are, without the driver."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(0, b.num_rows, rows):
                    yield f(b.slice(i, rows))

        return self.table(name).mapInArrow(run, schema)

    # statistics

    def known_count(self, name: str) -> int:
        """Number of rows of the current snapshot; counted once, from Parquet's footers."""
        r = self._known(name)
        self._flush(name)
        if r.count is None:
            r.count = self.table(name).count()
        return r.count

    def relationStats(self, name: str) -> dict[str, int]:
        """Rows, files and bytes."""
        r = self._known(name)
        n = self.known_count(name)
        if r.path is None:
            return {"rows": 0, "files": 0, "bytes": 0}
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(r.path)
        summary = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where)
        return {"rows": n, "files": len(self.spark.read.parquet(r.path).inputFiles()), "bytes": summary.getLength()}

    def headers(self, name: str) -> DataFrame:
        """file, bytes and rows of each file of the current snapshot; rows come from footers and no column is read."""
        meta = F.col("_metadata")
        r = self._known(name)
        self._flush(name)
        if r.path is None:
            return self.spark.createDataFrame([], "file string, bytes long, rows long")
        df = self.spark.read.schema(r.schema.struct).parquet(r.path)
        return df.groupBy(meta["file_name"].alias("file"), meta["file_size"].alias("bytes")).agg(F.count("*").alias("rows"))

    def columnStats(self, name: str, column: str) -> Row:
        """count, minimum, maximum and distinct values of a column, in one pass."""
        c = F.col(f"`{column}`")
        return self.table(name).agg(F.count(c).alias("n"), F.min(c).alias("low"), F.max(c).alias("high"), F.count_distinct(c).alias("distinct")).first()

    # indexes

    def createIndex(self, name: str, key: Schema, primary: bool = False) -> Index:
        """Record an index. ValueError for a second primary one, a second one of that key, an unknown field, or a primary key that repeats."""
        r = self._known(name)
        if primary and any(i.primary for i in r.indexes.values()):
            raise ValueError(f"relation {name!r} has a primary index")
        if self.matchIndex(name, key) is not None:
            raise ValueError(f"relation {name!r} has an index of that key")
        absent = [(f, str(t)) for f, t in key.fields if (f, t) not in r.schema.fields]
        if absent:
            raise ValueError(f"not fields of {name!r}: {absent}")
        if primary and _repeats(self.table(name), key.names):
            raise ValueError("a primary key can't repeat")
        return self.addIndex(name, key, primary)

    def addIndex(self, name: str, key: Schema, primary: bool, index: int | None = None) -> Index:
        """Take an index back under its number, or a new one."""
        made = Index(self._next_index if index is None else index, name, key, primary)
        self._next_index = max(self._next_index, made.id + 1)
        self._known(name).indexes[made.id] = made
        self.checkpoint()
        return made

    def removeIndex(self, name: str, index: Index) -> None:
        r = self._known(name)
        r.indexes.pop(index.id)
        self._drop_copy(r, index.id)
        self.checkpoint()

    def buildIndex(self, index: Index, buckets: int | None = None) -> None:
        """Store a copy of the relation in buckets of the key, sorted by it.

        Joins by the index read the copy where it lies, dealt out by key, and lookups one bucket of it, until rows change; then it is
        out of use until it is built again. It lasts as long as the session.
        """
        r, df = self._known(index.relation), self.table(index.relation)
        n = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self._drop_copy(r, index.id)
        name, names = f"lodeframe_index_{uuid.uuid4().hex}", index.key.names
        writer = df.repartition(n, *names).write.format("parquet").bucketBy(n, *names).sortBy(*names)
        writer.option("path", f"{self._snapshot(index.relation)}-index").saveAsTable(name)
        r.copies[index.id] = (name, r.version)

    def _drop_copy(self, r: Relation, number: int) -> None:
        got = r.copies.pop(number, None)
        if got:
            path = self.spark.sql(f"DESCRIBE FORMATTED {got[0]}").filter("col_name = 'Location'").first()
            self.spark.sql(f"DROP TABLE IF EXISTS {got[0]}")
            if path:
                files.delete(self.spark, path["data_type"])

    def indexed(self, index: Index) -> DataFrame | None:
        """The copy in buckets of an index, if there is one of the current rows."""
        r = self._known(index.relation)
        self._flush(index.relation)
        name, version = r.copies.get(index.id, (None, -1))
        return self.spark.table(name) if name and version == r.version else None

    detachIndex = removeIndex

    def getIndex(self, number: int) -> Index | None:
        return next((r.indexes[number] for r in self._relations.values() if number in r.indexes), None)

    def indexes(self, name: str) -> list[Index]:
        return list(self._known(name).indexes.values())

    def hasIndex(self, name: str, key: Schema) -> bool:
        return self.matchIndex(name, key) is not None

    def matchIndex(self, name: str, key: Schema) -> Index | None:
        """The index with exactly these fields and types."""
        return next((i for i in self._known(name).indexes.values() if i.key.match(key)), None)

    def primaryIndex(self, name: str) -> Index | None:
        return next((i for i in self._known(name).indexes.values() if i.primary), None)

    @staticmethod
    def _key(index: Index, key: object) -> dict[str, object]:
        values = key if isinstance(key, (tuple, list)) else (key,)
        return dict(zip(index.key.names, values, strict=True))

    def lookupByIndex(self, index: Index, key: object) -> DataFrame:
        """All rows of a key."""
        built = self.indexed(index)
        return (self.table(index.relation) if built is None else built).filter(self._matching(index.relation, self._key(index, key)))

    def _primary(self, name: str) -> Index:
        index = self.primaryIndex(name)
        if index is None:
            raise ValueError(f"relation {name!r} has no primary index")
        return index

    def lookupByKey(self, name: str, key: object) -> Row | None:
        """The row of a primary key; None without one, or without a primary index."""
        index = self.primaryIndex(name)
        return self.lookupByIndex(index, key).first() if index is not None else None

    def deleteByIndex(self, index: Index, key: object) -> None:
        self.deleteTuple(index.relation, self._key(index, key))

    def updateByIndex(self, index: Index, key: object, row: Iterable | dict[str, object]) -> None:
        self.updateTuple(index.relation, self._key(index, key), row)

    def deleteByKey(self, name: str, key: object) -> None:
        self.deleteByIndex(self._primary(name), key)

    def updateByKey(self, name: str, key: object, row: Iterable | dict[str, object]) -> None:
        self.updateByIndex(self._primary(name), key, row)

    def scanByIndex(self, index: Index) -> DataFrame:
        """The rows in order of the key."""
        return self.table(index.relation).orderBy(*index.key.names)

    def scanByKey(self, name: str) -> DataFrame:
        return self.scanByIndex(self._primary(name))

    def writeSorted(self, index: Index, partitions: int | None = None) -> None:
        """Store the relation in key order, so that lookups skip files and row groups by their statistics."""
        df, names = self.table(index.relation), index.key.names
        df = df.repartitionByRange(partitions, *names) if partitions else df.repartitionByRange(*names)
        self._replace(index.relation, df.sortWithinPartitions(*names))

    # queries

    def query(self) -> PlanBuilder:
        return PlanBuilder(self)

    def processQuery(self, plan: Plan) -> Plan:
        """The plan, ready to be read: its iterator gives rows, dataframe() the result."""
        return plan.prepare(self)

    def setQueryOptimizer(self, name: str) -> None:
        if name not in OPTIMIZERS:
            raise ValueError(f"no optimizer {name!r}; there are {', '.join(OPTIMIZERS)}")
        self.optimizer = OPTIMIZERS[name](self)

    def queryOptimizer(self) -> Search:
        return self.optimizer

    def optimizeQuery(self, plan: Plan) -> Plan:
        return self.optimizer.optimizeQuery(plan)


__all__ = ["Database", "Index", "Relation"]
