"""Python expression strings as Spark columns.

The syntax tree is walked once, when a plan is lowered; rows are never seen by Python. Where
an expression goes beyond the translated part, an Arrow-batched Python function evaluates
it row by row, with a warning, since that keeps Spark from pushing it down.
"""

from __future__ import annotations

import ast
import math
import operator
import warnings
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.functions import values as V
from lodeframe.functions.values import FUNCTIONS, Math, NotTranslatable, Value, value

_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.Pow: operator.pow, ast.BitAnd: operator.and_, ast.BitOr: operator.or_, ast.BitXor: operator.xor, ast.LShift: operator.lshift, ast.RShift: operator.rshift}
_COMPARE = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge}
_METHODS = {"upper", "lower", "strip", "lstrip", "rstrip", "startswith", "endswith", "replace", "find", "isdigit"}


def parsed(text: str) -> ast.expr:
    try:
        return ast.parse(text.strip(), mode="eval").body
    except SyntaxError as e:
        raise ValueError(f"not an expression: {text!r}") from e


def attributes(text: str) -> set[str]:
    """Names an expression reads, without those of functions it calls and of modules."""
    tree = parsed(text)
    called = {n.func.id for n in ast.walk(tree) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name)}
    modules = {n.value.id for n in ast.walk(tree) if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.value.id == "math"}
    return {n.id for n in ast.walk(tree) if isinstance(n, ast.Name)} - called - modules


def conjuncts(text: str) -> list[str]:
    """The parts of a top-level `and`."""
    tree = parsed(text)
    if isinstance(tree, ast.BoolOp) and isinstance(tree.op, ast.And):
        return [c for v in tree.values for c in conjuncts(ast.unparse(v))]
    return [ast.unparse(tree)]


def conjunction(parts: list[str]) -> str:
    return " and ".join(f"({p})" for p in parts) if len(parts) > 1 else parts[0]


def is_attribute(text: str) -> bool:
    return isinstance(parsed(text), ast.Name)


def equality(text: str) -> tuple[str, str] | None:
    """(a, b) if the expression is a == b of two attributes."""
    tree = parsed(text)
    if isinstance(tree, ast.Compare) and len(tree.ops) == 1 and isinstance(tree.ops[0], ast.Eq) and isinstance(tree.left, ast.Name) and isinstance(tree.comparators[0], ast.Name):
        return tree.left.id, tree.comparators[0].id
    return None


def substituted(text: str, new: dict[str, str]) -> str:
    """The expression with attributes replaced by expressions."""

    class Swap(ast.NodeTransformer):
        def visit_Name(self, node: ast.Name) -> ast.AST:
            return parsed(new[node.id]) if node.id in new else node

    return ast.unparse(Swap().visit(parsed(text)))


class Translator:
    def __init__(self, fields: dict[str, Value]):
        self.fields = fields

    def of(self, text: str) -> Value:
        return value(self.walk(parsed(text)))

    def walk(self, n: ast.AST) -> object:
        match n:
            case ast.Constant(value=v) if isinstance(v, (bool, int, float, str)):
                return value(v)
            case ast.Name(id=name):
                if name in self.fields:
                    return self.fields[name]
                raise ValueError(f"no field {name!r}; there are {', '.join(self.fields)}")
            case ast.BoolOp(op=op, values=vs):
                return V.both([value(self.walk(v)) for v in vs], isinstance(op, ast.And))
            case ast.UnaryOp(op=ast.Not(), operand=x):
                return V.negated(value(self.walk(x)))
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -value(self.walk(x))
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return value(self.walk(x))
            case ast.UnaryOp(op=ast.Invert(), operand=x):
                return ~value(self.walk(x))
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
                return _BINARY[type(op)](value(self.walk(a)), value(self.walk(b)))
            case ast.Compare(left=a, ops=ops, comparators=bs):
                tests, left = [], self.walk(a)
                for op, b in zip(ops, bs, strict=True):
                    right = self.walk(b)
                    if isinstance(op, (ast.In, ast.NotIn)):
                        t = V.contained(value(left), right)
                        tests.append(V.negated(t) if isinstance(op, ast.NotIn) else t)
                    elif type(op) in _COMPARE:
                        tests.append(_COMPARE[type(op)](value(left), value(right)))
                    else:
                        raise ValueError("identity has no meaning on columns; use == or !=")
                    left = right
                return V.both(tests, True)
            case ast.IfExp(test=t, body=a, orelse=b):
                return V.if_else(value(self.walk(t)), value(self.walk(a)), value(self.walk(b)))
            case ast.List(elts=xs) | ast.Tuple(elts=xs) | ast.Set(elts=xs):
                return [self.walk(x) for x in xs]
            case ast.Attribute(value=ast.Name(id="math"), attr=name) if "math" not in self.fields:
                return getattr(Math(), name)
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in FUNCTIONS:
                return FUNCTIONS[name](*(self.walk(a) for a in args))
            case ast.Call(func=ast.Attribute(value=ast.Name(id="math")) as f, args=args, keywords=[]) if "math" not in self.fields:
                return self.walk(f)(*(self.walk(a) for a in args))
            case ast.Call(func=ast.Attribute(value=x, attr=name), args=args, keywords=[]) if name in _METHODS:
                return getattr(value(self.walk(x)), name)(*(self.walk(a) for a in args))
            case ast.Subscript(value=x, slice=ast.Slice(lower=a, upper=b, step=c)):
                return value(self.walk(x))[slice(*(None if i is None else self.walk(i) for i in (a, b, c)))]
            case ast.Subscript(value=x, slice=i):
                return value(self.walk(x))[self.walk(i)]
        raise NotTranslatable(ast.unparse(n))


def fields_of(struct: T.StructType, prefix: str = "") -> dict[str, Value]:
    return {f.name: Value(F.col(f"{prefix}`{f.name}`"), V.kind_of(f.dataType)) for f in struct}


def _by_python(text: str, struct: T.StructType, result: T.DataType, finish: Callable) -> Column:
    names = sorted(attributes(text))
    missing = [n for n in names if n not in struct.names]
    if missing:
        raise ValueError(f"no field {', '.join(missing)}")
    warnings.warn(f"{text!r} is evaluated by Python, row by row", stacklevel=3)

    def run(*args: object) -> object:
        return finish(eval(text, {"math": math}, dict(zip(names, args, strict=True))))

    f = F.udf(run, result, useArrow=True)
    return f(*(F.col(f"`{n}`") for n in names)) if names else f()


def predicate(text: str, struct: T.StructType) -> Column:
    """The expression as a condition."""
    try:
        return Translator(fields_of(struct)).of(text).truth
    except NotTranslatable:
        return _by_python(text, struct, T.BooleanType(), bool)


def projection(text: str, struct: T.StructType, result: T.DataType) -> Column:
    """The expression as a column; the caller casts it to `result`."""
    try:
        return Translator(fields_of(struct)).of(text).column
    except NotTranslatable:
        return _by_python(text, struct, result, lambda x: x)


def keys(f: Callable, struct: T.StructType, default: tuple) -> list[Column]:
    """The columns that a function of a row stands for: one, or those of a tuple."""
    try:
        got = V.traced(f, V.RowProxy(fields_of(struct)))
        return [value(x).column for x in (got if isinstance(got, (tuple, list)) else (got,))]
    except NotTranslatable:
        warnings.warn("a key function is evaluated by Python, row by row", stacklevel=3)
        probe = f(default)
        parts = probe if isinstance(probe, tuple) else (probe,)
        kinds = [T.BooleanType() if isinstance(p, bool) else T.LongType() if isinstance(p, int) else T.DoubleType() if isinstance(p, float) else T.StringType() for p in parts]
        row_type = type(default)

        def run(i: int) -> Callable:
            def one(*args: object) -> object:
                k = f(row_type(*args))
                return k[i] if isinstance(k, tuple) else k

            return one

        cols = [F.col(f"`{n}`") for n in struct.names]
        return [F.udf(run(i), k)(*cols) for i, k in enumerate(kinds)]
