"""User-defined aggregates (start, step, finish) as Spark aggregates.

step(acc, row) is called once with placeholders. If it comes to a minimum, a maximum, a sum or a bitwise and, or, xor of something of the
row - or a tuple of such - it becomes Spark's own aggregate, which sums map-side; start is part of the result, as in
least(start, min(x)). finish is called with the results' columns. Any other step runs in
Python over each group's rows as a stream of batches: one accumulator a group, whatever its size, in no set order. Only the fields that
its code reads are sent there; all of them if the row goes anywhere else.
"""

from __future__ import annotations

import dis
import itertools
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.functions import expr
from lodeframe.functions import values as V
from lodeframe.functions.types import Schema
from lodeframe.functions.values import NotTranslatable, Value, value


class Accumulator:
    """Placeholder of one accumulator; records what is done to it."""

    __hash__ = None

    def __add__(self, x: object) -> Step:
        return Step("sum", value(x))

    __radd__ = __add__

    def __sub__(self, x: object) -> Step:
        return Step("sum", -value(x))

    def __xor__(self, x: object) -> Step:
        return Step("xor", value(x))

    def __and__(self, x: object) -> Step:
        return Step("and", value(x))

    def __or__(self, x: object) -> Step:
        return Step("or", value(x))

    __rxor__, __rand__, __ror__ = __xor__, __and__, __or__

    def __bool__(self) -> bool:
        raise NotTranslatable("a choice by the accumulator")


class Step:
    __hash__ = None

    def __init__(self, kind: str, x: Value):
        self.kind, self.x = kind, x

    def __bool__(self) -> bool:
        raise NotTranslatable("a choice by the accumulator")


def _extreme(kind: str) -> Callable:
    plain = V.FUNCTIONS[kind]

    def f(*args: object) -> object:
        args = tuple(args[0]) if len(args) == 1 else args
        accs = [a for a in args if isinstance(a, (Accumulator, Step))]
        rest = [a for a in args if not isinstance(a, (Accumulator, Step))]
        if not accs:
            return plain(*args)
        if len(accs) > 1 or isinstance(accs[0], Step) or not rest:
            raise NotTranslatable("more than one step")
        return Step(kind, value(rest[0]) if len(rest) == 1 else plain(*rest))

    return f


def _recorded(step: Callable, start: object, row: V.RowProxy) -> Step | tuple[Step | Accumulator, ...]:
    parts = tuple(Accumulator() for _ in start) if isinstance(start, tuple) else Accumulator()
    got = V.traced(step, parts, row, extra={"min": _extreme("min"), "max": _extreme("max")})
    out = got if isinstance(got, tuple) else (got,)
    own = parts if isinstance(parts, tuple) else (parts,)
    if len(out) != len(own) or not all(isinstance(o, Step) or o is a for o, a in zip(out, own, strict=True)):
        raise NotTranslatable("not a step of the known kinds")
    return got


#: kind of step -> aggregate of the rows, and how start joins it
BITWISE = {
    "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b)),
    "and": (F.bit_and, lambda a, b: a.bitwiseAND(b)),
    "or": (F.bit_or, lambda a, b: a.bitwiseOR(b)),
}


def _column(s: Step | Accumulator, start: object) -> Value:
    first = value(start)
    if isinstance(s, Accumulator):
        return first
    kind = "float" if "float" in (first.kind, s.x.kind) else s.x.kind
    wide = {"float": "double", "int": "bigint", "bool": "bigint"}.get(kind)
    x, init = (c.cast(wide) if wide else c for c in (s.x.column, first.column))
    if s.kind == "sum":
        if kind == "str":
            raise NotTranslatable("a sum of strings has an order")
        return Value(init + F.sum(x), "int" if kind == "bool" else kind)
    if s.kind in BITWISE:
        if kind != "int":
            raise NotTranslatable("bits of what isn't an integer")
        gathered, together = BITWISE[s.kind]
        return Value(together(init, gathered(x)), kind)
    return Value(F.least(init, F.min(x)) if s.kind == "min" else F.greatest(init, F.max(x)), kind)


def as_column(fold: tuple, row: V.RowProxy) -> Column:
    start, step, finish = fold
    got = _recorded(step, start, row)
    result = tuple(_column(s, x) for s, x in zip(got, start, strict=True)) if isinstance(got, tuple) else _column(got, start)
    out = V.traced(finish, result)
    return value(out).column


def grouped(df: DataFrame, keys: list[Column], group: Schema, agg: Schema, folds: list[tuple], source: Schema) -> DataFrame:
    """df's groups with their aggregates, in the types of the two schemas."""
    kinds = [*group.fields, *agg.fields]
    try:
        row = V.RowProxy(expr.fields_of(df.schema))
        aggregates = [as_column(f, row).alias(n) for f, n in zip(folds, agg.names, strict=True)]
    except NotTranslatable:
        return _streamed(df, keys, group, agg, folds, source)
    # keys under names of their own: an aggregate may read a field that a key is named like
    plain = [f"_key{i}" for i in range(len(keys))]
    out = df.groupBy(*(k.alias(p) for k, p in zip(keys, plain, strict=True))).agg(*aggregates) if plain else df.agg(*aggregates)
    by_name = dict(zip(group.names, plain, strict=True))
    return out.select(*(t.column(F.col(f"`{by_name.get(n, n)}`")).alias(n) for n, t in kinds))


def fields_read(step: Callable, names: list[str]) -> list[str]:
    """Those fields that a step's code takes from its row; all if it isn't plain code that only takes fields by name."""
    code = getattr(step, "__code__", None)
    if code is None or code.co_argcount != 2 or code.co_varnames[1] in code.co_cellvars:
        return names
    row, found = code.co_varnames[1], set()
    steps = list(dis.get_instructions(code))
    for at, after in zip(steps, [*steps[1:], None], strict=True):
        if not at.opname.startswith(("LOAD_FAST", "STORE_FAST", "DELETE_FAST")):
            continue
        variables = at.argval if isinstance(at.argval, tuple) else (at.argval,)
        if row not in variables:
            continue
        if not at.opname.startswith("LOAD_FAST") or variables.index(row) < len(variables) - 1 or after is None or after.opname not in ("LOAD_ATTR", "LOAD_METHOD"):
            return names
        found.add(after.argval)
    return [n for n in names if n in found]


def _streamed(df: DataFrame, keys: list[Column], group: Schema, agg: Schema, folds: list[tuple], source: Schema) -> DataFrame:
    plain = [f"_key{i}" for i in range(len(keys))]
    read = {n for f in folds for n in fields_read(f[1], df.columns)}
    names, row_type = [n for n in df.columns if n in read], source.row_type
    keyed = df.select(*(k.alias(p) for k, p in zip(keys, plain, strict=True)), *(F.col(f"`{n}`") for n in names))
    places = [df.columns.index(n) for n in names]
    width = len(df.columns)
    struct = keyed.select(*plain).schema
    kinds = [f.dataType.simpleString() for f in struct]
    results = [t.spark.simpleString() for _, t in agg.fields]
    fit = [t.fit for _, t in agg.fields]

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = [f[0] for f in folds]
        for b in batches:
            columns: list[Iterable] = [itertools.repeat(None, b.num_rows) for _ in range(width)]  # a field that isn't read
            for i, n in zip(places, names, strict=True):
                columns[i] = b.column(b.schema.get_field_index(n)).to_pylist()
            for values in zip(*columns, strict=True):
                row = row_type(*values)
                state = [f[1](s, row) for f, s in zip(folds, state, strict=True)]
        done = [g(f[2](s)) for f, s, g in zip(folds, state, fit, strict=True)]
        arrays = [pa.array([k.as_py()], k.type) for k in key]
        yield pa.RecordBatch.from_arrays([*arrays, *(pa.array([v]).cast(t) for v, t in zip(done, wanted, strict=True))], [*plain, *agg.names])

    from pyspark.sql.pandas.types import to_arrow_type

    wanted = [to_arrow_type(t.spark) for _, t in agg.fields]
    out = keyed.groupBy(*plain).applyInArrow(run, ", ".join(f"`{n}` {t}" for n, t in zip([*plain, *agg.names], [*kinds, *results], strict=True)))
    return out.select(*(t.column(F.col(p)).alias(n) for p, (n, t) in zip(plain, group.fields, strict=True)), *(F.col(f"`{n}`") for n in agg.names))
