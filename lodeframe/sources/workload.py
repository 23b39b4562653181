"""A load-and-read workload over order-processing relations."""

from __future__ import annotations

import math
import random
import time
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.functions.types import Schema
from lodeframe.sources import delimited, files
from lodeframe.sources.catalog import Database

# Relations, their fields, types and formats, as their files have them.
RELATIONS = {
    "part": [
        ("P_PARTKEY", "int", "i"),
        ("P_NAME", "char(55)", "s"),
        ("P_MFGR", "char(25)", "s"),
        ("P_BRAND", "char(10)", "s"),
        ("P_TYPE", "char(25)", "s"),
        ("P_SIZE", "int", "i"),
        ("P_CONTAINER", "char(10)", "s"),
        ("P_RETAILPRICE", "double", "d"),
        ("P_COMMENT", "char(23)", "s"),
    ],
    "supplier": [
        ("S_SUPPKEY", "int", "i"),
        ("S_NAME", "char(25)", "s"),
        ("S_ADDRESS", "char(40)", "s"),
        ("S_NATIONKEY", "int", "i"),
        ("S_PHONE", "char(15)", "s"),
        ("S_ACCTBAL", "double", "d"),
        ("S_COMMENT", "char(101)", "s"),
    ],
    "partsupp": [
        ("PS_PARTKEY", "int", "i"),
        ("PS_SUPPKEY", "int", "i"),
        ("PS_AVAILQTY", "int", "i"),
        ("PS_SUPPLYCOST", "double", "d"),
        ("PS_COMMENT", "char(199)", "s"),
    ],
    "customer": [
        ("C_CUSTKEY", "int", "i"),
        ("C_NAME", "char(25)", "s"),
        ("C_ADDRESS", "char(40)", "s"),
        ("C_NATIONKEY", "int", "i"),
        ("C_PHONE", "char(15)", "s"),
        ("C_ACCTBAL", "double", "d"),
        ("C_MKTSEGMENT", "char(10)", "s"),
        ("C_COMMENT", "char(117)", "s"),
    ],
    "orders": [
        ("O_ORDERKEY", "int", "i"),
        ("O_CUSTKEY", "int", "i"),
        ("O_ORDERSTATUS", "char(1)", "s"),
        ("O_TOTALPRICE", "double", "d"),
        ("O_ORDERDATE", "int", "t"),
        ("O_ORDERPRIORITY", "char(15)", "s"),
        ("O_CLERK", "char(15)", "s"),
        ("O_SHIPPRIORITY", "int", "i"),
        ("O_COMMENT", "char(79)", "s"),
    ],
    "lineitem": [
        ("L_ORDERKEY", "int", "i"),
        ("L_PARTKEY", "int", "i"),
        ("L_SUPPKEY", "int", "i"),
        ("L_LINENUMBER", "int", "i"),
        ("L_QUANTITY", "double", "d"),
        ("L_EXTENDEDPRICE", "double", "d"),
        ("L_DISCOUNT", "double", "d"),
        ("L_TAX", "double", "d"),
        ("L_RETURNFLAG", "char(1)", "s"),
        ("L_LINESTATUS", "char(1)", "s"),
        ("L_SHIPDATE", "int", "t"),
        ("L_COMMITDATE", "int", "t"),
        ("L_RECEIPTDATE", "int", "t"),
        ("L_SHIPINSTRUCT", "char(25)", "s"),
        ("L_SHIPMODE", "char(10)", "s"),
        ("L_COMMENT", "char(44)", "s"),
    ],
    "nation": [
        ("N_NATIONKEY", "int", "i"),
        ("N_NAME", "char(25)", "s"),
        ("N_REGIONKEY", "int", "i"),
        ("N_COMMENT", "char(152)", "s"),
    ],
    "region": [
        ("R_REGIONKEY", "int", "i"),
        ("R_NAME", "char(25)", "s"),
        ("R_COMMENT", "char(152)", "s"),
    ],
}
#: mode -> share of rows read out of turn; mode 1 scans
SHARES = {2: 0.2, 3: 0.5, 4: 0.8}


def declared() -> dict[str, tuple[Schema, str]]:
    """Each relation's schema, and its file's formats, a letter a field."""
    return {name: (Schema(name, [(n, t) for n, t, _ in fields]), "".join(f for _, _, f in fields)) for name, fields in RELATIONS.items()}


def imported(relations: dict[str, tuple[Schema, str]] | None = None) -> dict[str, tuple[Schema, str]]:
    """The variant of plain imports: lower-case names, money as float, dates as text of ten characters."""
    out = {}
    for name, (schema, formats) in (relations or declared()).items():
        kinds = [("char(10)" if f == "t" else "float" if f == "d" else str(t)) for (_, t), f in zip(schema.fields, formats, strict=True)]
        out[name] = Schema(name, list(zip([n.lower() for n in schema.names], kinds, strict=True))), formats.replace("t", "s")
    return out


@dataclass
class Result:
    tuples: int
    seconds: float
    #: sum of the hashes of the rows read
    checksum: int = 0

    @property
    def throughput(self) -> float:
        return self.tuples / self.seconds if self.seconds else float("inf")


def _numbered(df: DataFrame) -> tuple[DataFrame, int]:
    """(at, row) of each row, numbered from 0 in the order of the scan, and their number."""
    rows = df.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("i"), F.struct("*").alias("row"))
    counts = sorted(map(tuple, rows.groupBy("part").count().collect()))  # one row a partition of the scan
    before = accumulate((n for _, n in counts), initial=0)
    offsets = df.sparkSession.createDataFrame([(part, x) for (part, _), x in zip(counts, before, strict=False)], "part int, offset long")
    return rows.join(F.broadcast(offsets), "part").select((F.col("offset") + F.col("i")).alias("at"), "row"), sum(n for _, n in counts)


def _shuffled(rng: random.Random, size: int) -> Column:
    """A drawn permutation of the numbers `at` below size."""
    most = max(1, min(size, (1 << 62) // size))  # products fit 64 bits
    by = next(x for x in iter(lambda: rng.randint(1, most), None) if math.gcd(x, size) == 1)
    return (F.col("at") * by + rng.randrange(size)) % size


def scanned(df: DataFrame) -> DataFrame:
    """Number of rows, and the sum of their hashes."""
    return df.agg(F.count("*"), F.sum(F.xxhash64("*").cast("decimal(38,0)")))


class Workload:
    def __init__(self, only: tuple[str, ...] | None = None, plain: bool = False):
        """plain: in the variant of imported()."""
        self.relations = {n: r for n, r in (imported() if plain else declared()).items() if only is None or n in only}
        self.loaded = False

    def createRelations(self, db: Database) -> None:
        for name, (schema, _) in self.relations.items():
            if db.hasRelation(name):
                db.removeRelation(name)
            db.createRelation(name, schema.schema())

    def loadDataset(self, db: Database, folder: str, scaleFactor: float = 1.0) -> None:
        """Each relation's file `folder`/name.csv, or about a share of its rows."""
        for name, (schema, formats) in self.relations.items():
            if not db.hasRelation(name):
                raise ValueError(f"no relation {name!r}")
            path = f"{folder}/{name}.csv"
            if not files.exists(db.spark, path):
                raise ValueError(f"no file {path}")
            db.insert(name, delimited.sampled(delimited.read(db.spark, path, schema, formats), scaleFactor))
        self.loaded = True

    def scanRelations(self, db: Database, names: list[str]) -> Result:
        """Read every field of every row: the sum of the rows' hashes needs them all."""
        start, n, total = time.time(), 0, 0
        for r in names:
            got = scanned(db.table(r)).first()
            n, total = n + got[0], total + int(got[1] or 0)
        return Result(n, time.time() - start, total)

    def randomizedOperations(self, db: Database, names: list[str], share: float, seed: int = 12345) -> Result:
        """As many reads as rows, a share of them at other, random places; every row read is fetched whole and hashed.

        Rows are numbered as the scan deals them out. No two reads out of turn are at the same place.
        """
        start, n, total = time.time(), 0, 0
        for r in names:
            rows, size = _numbered(db.table(r))
            if not size:
                continue
            rng = random.Random(f"{seed} {r}")
            turn, place = _shuffled(rng, size), _shuffled(rng, size)
            reads = rows.select(F.when(turn < math.floor(size * share), place).otherwise(F.col("at")).alias("at"))
            got = reads.join(rows, "at").agg(F.count("*"), F.sum(F.xxhash64("row").cast("decimal(38,0)"))).first()
            n, total = n + got[0], total + int(got[1] or 0)
        return Result(n, time.time() - start, total)

    def runOperations(self, db: Database, mode: int) -> Result:
        if not self.loaded:
            raise ValueError("nothing is loaded")
        names = [r for r in ("lineitem", "orders") if r in self.relations]
        if mode == 1:
            return self.scanRelations(db, names)
        if mode not in SHARES:
            raise ValueError(f"no workload mode {mode!r}; there are 1 to 4")
        return self.randomizedOperations(db, names, SHARES[mode])

    def runWorkload(self, spark, folder: str, scaleFactor: float, mode: int, pageSize: int | None = None) -> Result:
        db = Database(spark, pageSize=pageSize)
        self.createRelations(db)
        self.loadDataset(db, folder, scaleFactor)
        out = self.runOperations(db, mode)
        for name in self.relations:
            db.removeRelation(name)
        return out
