"""Plans: a finished operator tree, its builder, costs and optimizers."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Row

from lodeframe.functions.types import Schema
from lodeframe.operators import GroupBy, Join, Operator, Project, Select, Sort, TableScan, Union, sampled
from lodeframe.plans.costs import Costs

if TYPE_CHECKING:
    from lodeframe.sources.catalog import Database


class Reader:
    """Reads relations for operators: those given by name, or the stored ones; by an index its copy in buckets, if it has one."""

    def __init__(self, db: Database | None, replaced: dict[str, DataFrame]):
        self.db, self.replaced = db, replaced

    def __call__(self, name: str) -> DataFrame:
        return self.replaced[name] if name in self.replaced else self.db.table(name)

    def by_index(self, index: object) -> DataFrame | None:
        return None if index.relation in self.replaced else self.db.indexed(index)


class Plan:
    """A query. It is run by what reads its rows, anew each time; dataframe() gives the lazy Spark result."""

    def __init__(self, root: Operator, db: Database | None = None):
        self.root, self.db = root, db
        self._estimates: dict[int, float] = {}

    def schema(self) -> Schema:
        return self.root.schema

    def flatten(self) -> list[tuple[int, Operator]]:
        """(depth, operator), a node before its inputs and the right input first."""
        return list(self.root.walk())

    def relations(self) -> list[str]:
        return [n.relation for _, n in self.root.walk() if isinstance(n, TableScan)]

    def prepare(self, db: Database) -> Plan:
        self.db = db
        return self

    def dataframe(self, **replaced: DataFrame) -> DataFrame:
        """The result. A relation given by name takes the place of the stored one; it may be a stream."""
        return self.root.dataframe(Reader(self.db, replaced))

    def __iter__(self) -> Iterator[Row]:
        return self.dataframe().toLocalIterator()

    def explain(self) -> str:
        costs = Costs(self.db)
        return "\n".join(f"{'  ' * d}{n.operatorType()}[{n.id},cost={costs.cost(n):.2f}]{n.arguments()}" for d, n in self.root.walk())

    def cost(self, estimated: bool = False) -> float:
        """Cost of the whole plan by the cost model; over sampled cardinalities if sample() came before and these are asked for."""
        return Costs(self.db, self._estimates if estimated else None).cost(self.root)

    def sample(self, factor: float, seed: int = 0) -> float:
        """Estimated number of rows: of a run over about one row in `factor` of each relation, times `factor`."""
        read = sampled(self.db.table, factor, seed)
        for _, n in self.root.walk():
            if n is self.root or isinstance(n, TableScan):
                self._estimates[n.id] = n.dataframe(read).count() * factor
        return self._estimates[self.root.id]

    def pushdownOperators(self) -> Plan:
        from lodeframe.plans.pushdown import pushed

        return Plan(pushed(self.root), self.db)


class PlanBuilder:
    """Each method gives a new builder around one more operator; finalize() gives the plan."""

    def __init__(self, db: Database | None = None, operator: Operator | None = None):
        if db is None and operator is None:
            raise ValueError("a builder needs a database or an operator")
        self.db, self.operator = db, operator

    def _next(self, operator: Operator) -> PlanBuilder:
        return PlanBuilder(self.db, operator)

    def _some(self) -> Operator:
        if self.operator is None:
            raise ValueError("a query starts with fromTable")
        return self.operator

    def fromTable(self, relation: str) -> PlanBuilder:
        return self._next(TableScan(relation, self.db.relationSchema(relation)))

    def where(self, condition: str) -> PlanBuilder:
        return self._next(Select(self._some(), condition))

    def select(self, projections: dict[str, tuple[str, str]]) -> PlanBuilder:
        return self._next(Project(self._some(), projections))

    def join(self, other: PlanBuilder, **options: object) -> PlanBuilder:
        if other is None or other.operator is None:
            raise ValueError("a join needs a right side")
        return self._next(Join(self._some(), other.operator, **options))

    def union(self, other: PlanBuilder) -> PlanBuilder:
        return self._next(Union(self._some(), other._some()))

    def groupBy(self, **options: object) -> PlanBuilder:
        return self._next(GroupBy(self._some(), **options))

    def order(self, **options: object) -> PlanBuilder:
        return self._next(Sort(self._some(), **options))

    def finalize(self) -> Plan:
        return Plan(self._some(), self.db)


__all__ = ["GroupBy", "Join", "Plan", "PlanBuilder", "Project", "Select", "Sort", "TableScan", "Union"]
