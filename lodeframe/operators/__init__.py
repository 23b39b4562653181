"""Logical operators: a small tree that describes a query and becomes one DataFrame."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from lodeframe.functions import expr
from lodeframe.functions.types import Schema, declared
from lodeframe.operators import folds
from lodeframe.operators.joins import METHODS, joined

_numbers = itertools.count()


class Operator:
    """A node. Its schema and its inputs are known, and checked, when it is made; rows only when a plan runs."""

    label = ""

    @property
    def inputs(self) -> tuple[Operator, ...]:
        return ()

    @property
    def inputSchemas(self) -> tuple[Schema, ...]:
        return tuple(i.schema for i in self.inputs)

    def operatorType(self) -> str:
        return self.label

    def with_inputs(self, *inputs: Operator) -> Operator:
        raise NotImplementedError

    def arguments(self) -> str:
        return ""

    def dataframe(self, read: Callable[[str], DataFrame]) -> DataFrame:
        raise NotImplementedError

    def walk(self) -> Iterator[tuple[int, Operator]]:
        """(depth, node): a node, then its inputs, the right one first."""
        stack = [(0, self)]
        while stack:
            depth, node = stack.pop()
            yield depth, node
            stack += [(depth + 1, i) for i in node.inputs]

    def _numbered(self) -> None:
        object.__setattr__(self, "id", next(_numbers))


@dataclass(frozen=True, eq=False)
class TableScan(Operator):
    """All rows of a relation."""

    relation: str
    schema: Schema
    label = "TableScan"

    def __post_init__(self) -> None:
        if not self.relation or not self.schema:
            raise ValueError("a scan needs a relation and its schema")
        self._numbered()

    def with_inputs(self) -> Operator:
        return TableScan(self.relation, self.schema)

    def arguments(self) -> str:
        return f"({self.relation})"

    def dataframe(self, read: Callable[[str], DataFrame]) -> DataFrame:
        return read(self.relation)


@dataclass(frozen=True, eq=False)
class Select(Operator):
    """The rows for which a Python expression is true."""

    child: Operator
    predicate: str
    label = "Select"

    def __post_init__(self) -> None:
        expr.parsed(self.predicate)
        self._numbered()

    @property
    def schema(self) -> Schema:
        return self.child.schema

    @property
    def inputs(self) -> tuple[Operator, ...]:
        return (self.child,)

    def with_inputs(self, child: Operator) -> Operator:
        return Select(child, self.predicate)

    def arguments(self) -> str:
        return f"(predicate={self.predicate!r})"

    def dataframe(self, read: Callable[[str], DataFrame]) -> DataFrame:
        df = self.child.dataframe(read)
        return df.filter(expr.predicate(self.predicate, df.schema))


@dataclass(frozen=True, eq=False)
class Project(Operator):
    """Computed columns: name -> (Python expression, type), in their order; values are cast to the type."""

    child: Operator
    projections: dict[str, tuple[str, str]]
    schema: Schema = field(init=False)
    label = "Project"

    def __post_init__(self) -> None:
        if not self.projections:
            raise ValueError("a projection needs a column")
        for e, _ in self.projections.values():
            expr.parsed(e)
        object.__setattr__(self, "schema", Schema.from_types(self.child.schema.name, [(n, declared(t)) for n, (_, t) in self.projections.items()]))
        self._numbered()

    @property
    def inputs(self) -> tuple[Operator, ...]:
        return (self.child,)

    def with_inputs(self, child: Operator) -> Operator:
        return Project(child, self.projections)

    def arguments(self) -> str:
        return f"(projections={self.projections})"

    def dataframe(self, read: Callable[[str], DataFrame]) -> DataFrame:
        df = self.child.dataframe(read)
        kinds = dict(self.schema.fields)
        return df.select(*(kinds[n].column(expr.projection(e, df.schema, kinds[n].spark)).alias(n) for n, (e, _) in self.projections.items()))


@dataclass(frozen=True, eq=False)
class Union(Operator):
    """All rows of both inputs, repeats kept; their fields must be equal in name, type and order."""

    left: Operator
    right: Operator
    label = "UnionAll"

    def __post_init__(self) -> None:
        if not self.left.schema.match(self.right.schema):
            raise ValueError(f"a union of different fields: {self.left.schema} and {self.right.schema}")
        self._numbered()

    @property
    def schema(self) -> Schema:
        return self.left.schema

    @property
    def inputs(self) -> tuple[Operator, ...]:
        return self.left, self.right

    def with_inputs(self, left: Operator, right: Operator) -> Operator:
        return Union(left, right)

    def dataframe(self, read: Callable[[str], DataFrame]) -> DataFrame:
        return self.left.dataframe(read).union(self.right.dataframe(read))


@dataclass(frozen=True, eq=False)
class Join(Operator):
    """Inner join; the output is all left fields, then all right ones.

    method: nested-loops and block-nested-loops (expr), indexed (lhsKeySchema, indexId), hash (key schemas and
    hash functions of both sides); the last two take expr as a further condition. Keys pair by place. rhsSchema
    renames the right fields by place. The hash functions only say how another engine would deal rows out: Spark
    deals by the keys.
    """

    left: Operator
    right: Operator
    method: str = "nested-loops"
    expr: str | None = None
    lhsSchema: Schema | None = None
    rhsSchema: Schema | None = None
    lhsKeySchema: Schema | None = None
    rhsKeySchema: Schema | None = None
    lhsHashFn: str | None = None
    rhsHashFn: str | None = None
    indexId: object = None
    pipeline: bool = False
    schema: Schema = field(init=False)

    def __post_init__(self) -> None:
        if self.pipeline:
            raise ValueError("a join can't be pipelined")
        if self.method not in METHODS:
            raise ValueError(f"no join method {self.method!r}; there are {', '.join(METHODS)}")
        needs = {"nested-loops": ("expr",), "block-nested-loops": ("expr",), "indexed": ("lhsKeySchema", "indexId"), "hash": ("lhsHashFn", "lhsKeySchema", "rhsHashFn", "rhsKeySchema")}[self.method]
        missing = [n for n in needs if getattr(self, n) is None]
        if missing:
            raise ValueError(f"a join by {self.method} needs {', '.join(missing)}")
        left, right = (own or side.schema for own, side in ((self.lhsSchema, self.left), (self.rhsSchema, self.right)))
        if len(left.fields) != len(self.left.schema.fields) or len(right.fields) != len(self.right.schema.fields):
            raise ValueError("a schema given to a join must have as many fields as its input")
        twice = set(left.names) & set(right.names)
        if twice:
            raise ValueError(f"fields on both sides of a join: {', '.join(sorted(twice))}")
        if self.expr is not None:
            expr.parsed(self.expr)
        object.__setattr__(self, "schema", Schema.combined(left, right))
        for side, keys in ((left, self.lhsKeySchema), (right, self.rhsKeySchema if self.method == "hash" else None)):
            absent = [k for k in keys.names if k not in side.names] if keys else []
            if absent:
                raise ValueError(f"a key that isn't a field: {', '.join(absent)}")
        self._numbered()

    @property
    def label(self) -> str:
        return METHODS[self.method]

    @property
    def inputs(self) -> tuple[Operator, ...]:
        return self.left, self.right

    def with_inputs(self, left: Operator, right: Operator) -> Operator:
        return Join(left, right, **self.options())

    def options(self) -> dict[str, object]:
        return {n: getattr(self, n) for n in ("method", "expr", "lhsSchema", "rhsSchema", "lhsKeySchema", "rhsKeySchema", "lhsHashFn", "rhsHashFn", "indexId")}

    def key_pairs(self) -> list[tuple[str, str]]:
        """Left and right key fields, by place; an index is one of the right input's fields by name."""
        if self.method == "hash":
            return list(zip(self.lhsKeySchema.names, self.rhsKeySchema.names, strict=True))
        if self.method == "indexed":
            right = getattr(self.indexId, "key", None) or self.rhsKeySchema
            if right is None:
                raise ValueError("an indexed join needs the index itself, or its key as rhsKeySchema")
            names = right.names
            if self.rhsSchema is not None:  # the index has the relation's own names
                own = dict(zip(self.right.schema.names, self.rhsSchema.names, strict=True))
                names = [own.get(n, n) for n in names]
            return list(zip(self.lhsKeySchema.names, names, strict=True))
        return []

    def conjuncts(self) -> list[str]:
        return [f"{a} == {b}" for a, b in self.key_pairs()] + (expr.conjuncts(self.expr) if self.expr is not None else [])

    def arguments(self) -> str:
        named = {"nested-loops": ("expr",), "block-nested-loops": ("expr",), "indexed": ("lhsKeySchema", "indexId", "expr"), "hash": ("lhsKeySchema", "rhsKeySchema", "lhsHashFn", "rhsHashFn", "expr")}[self.method]
        shown = [(n, getattr(self, n)) for n in named]
        return "(" + ",".join(f"{n}={v.toString() if isinstance(v, Schema) else repr(v)}" for n, v in shown if v is not None) + ")"

    def dataframe(self, read: Callable[[str], DataFrame]) -> DataFrame:
        left, right = self.left.dataframe(read), self._by_index(read)
        in_buckets = right is not None
        right = right if in_buckets else self.right.dataframe(read)
        if self.lhsSchema is not None:
            left = left.toDF(*self.lhsSchema.names)
        if self.rhsSchema is not None:
            right = right.toDF(*self.rhsSchema.names)
        return joined(left, right, self.method, self.key_pairs(), self.expr, in_buckets)

    def _by_index(self, read: Callable[[str], DataFrame]) -> DataFrame | None:
        """The index's copy of the right relation, if the join is by an index that has one."""
        own = self.method == "indexed" and isinstance(self.right, TableScan) and getattr(self.indexId, "relation", None) == self.right.relation
        return read.by_index(self.indexId) if own and hasattr(read, "by_index") else None


@dataclass(frozen=True, eq=False)
class GroupBy(Operator):
    """Groups by a function of a row; aggregates are triples (start, step, finish), see folds.

    Output: the fields of groupSchema, then those of aggSchema. An empty input has no group.
    """

    child: Operator
    groupSchema: Schema | None = None
    aggSchema: Schema | None = None
    groupExpr: Callable | None = None
    aggExprs: list[tuple] | None = None
    groupHashFn: Callable | None = None
    schema: Schema = field(init=False)
    label = "GroupBy"

    def __post_init__(self) -> None:
        missing = [n for n in ("groupSchema", "aggSchema", "groupExpr", "aggExprs", "groupHashFn") if getattr(self, n) is None]
        if missing:
            raise ValueError(f"a group-by needs {', '.join(missing)}")
        if not self.aggExprs or len(self.aggExprs) != len(self.aggSchema.fields):
            raise ValueError("a group-by needs an aggregate for each field of aggSchema, and one at least")
        object.__setattr__(self, "schema", Schema.combined(self.groupSchema, self.aggSchema))
        self._numbered()

    @property
    def inputs(self) -> tuple[Operator, ...]:
        return (self.child,)

    def with_inputs(self, child: Operator) -> Operator:
        return GroupBy(child, self.groupSchema, self.aggSchema, self.groupExpr, self.aggExprs, self.groupHashFn)

    def arguments(self) -> str:
        return f"(groupSchema={self.groupSchema.toString()}, aggSchema={self.aggSchema.toString()})"

    def dataframe(self, read: Callable[[str], DataFrame]) -> DataFrame:
        df = self.child.dataframe(read)
        keys = expr.keys(self.groupExpr, df.schema, self.child.schema.default())
        if len(keys) != len(self.groupSchema.fields):
            raise ValueError(f"groupExpr gives {len(keys)} keys; groupSchema has {len(self.groupSchema.fields)} fields")
        return folds.grouped(df, keys, self.groupSchema, self.aggSchema, self.aggExprs, self.child.schema)


@dataclass(frozen=True, eq=False)
class Sort(Operator):
    """Rows in rising order of a key function of a row; sortKeyDesc is what explain() shows."""

    child: Operator
    sortKeyFn: Callable | None = None
    sortKeyDesc: str | None = None
    label = "Sort"

    def __post_init__(self) -> None:
        if self.sortKeyFn is None or self.sortKeyDesc is None:
            raise ValueError("a sort needs sortKeyFn and sortKeyDesc")
        self._numbered()

    @property
    def schema(self) -> Schema:
        return self.child.schema

    @property
    def inputs(self) -> tuple[Operator, ...]:
        return (self.child,)

    def with_inputs(self, child: Operator) -> Operator:
        return Sort(child, self.sortKeyFn, self.sortKeyDesc)

    def arguments(self) -> str:
        return f"(sortKeyDesc={self.sortKeyDesc!r})"

    def dataframe(self, read: Callable[[str], DataFrame]) -> DataFrame:
        df = self.child.dataframe(read)
        return df.orderBy(*(k.asc() for k in expr.keys(self.sortKeyFn, df.schema, self.child.schema.default())))


def sampled(read: Callable[[str], DataFrame], factor: float, seed: int) -> Callable[[str], DataFrame]:
    """Reads of about one row in `factor`."""
    return lambda name: read(name).sample(fraction=min(1.0, 1.0 / factor), seed=seed)


__all__ = ["GroupBy", "Join", "Operator", "Project", "Select", "Sort", "TableScan", "Union", "sampled"]
