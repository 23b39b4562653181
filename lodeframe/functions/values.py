"""Columns with Python's operators and functions.

A Value is a Column and what Python would hold in its place: 'bool', 'int', 'float',
'str' or '' (unknown). Operators keep Python's results: integers are 64 bits wide,
`/` is true division, `//` and `%` floor, comparisons of a string and a number are
unequal, `and` and `or` follow truth values.
"""

from __future__ import annotations

import builtins
import math
import types
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class NotTranslatable(Exception):
    """No column expression for this; a Python function may still do it."""


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.IntegralType):
        return "int"
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    return "str" if isinstance(t, T.StringType) else ""


def value(x: object) -> Value:
    if isinstance(x, Value):
        return x
    if isinstance(x, bool):
        return Value(F.lit(x), "bool", x)
    if isinstance(x, int):
        return Value(F.lit(x).cast("bigint"), "int", x)
    if isinstance(x, float):
        return Value(F.lit(x), "float", x)
    if isinstance(x, str):
        return Value(F.lit(x), "str", x)
    raise NotTranslatable(f"{x!r} is not a number, a string or a truth value")


def _numbers(a: Value, b: Value) -> tuple[Column, Column, str]:
    if "str" in (a.kind, b.kind):
        raise NotTranslatable("arithmetic on strings")
    if {a.kind, b.kind} <= {"int", "bool"}:
        return a.column.cast("bigint"), b.column.cast("bigint"), "int"
    if "float" in (a.kind, b.kind):
        return a.column.cast("double"), b.column.cast("double"), "float"
    return a.column, b.column, ""


class Value:
    """See above. const is the Python value where it is known."""

    __hash__ = None

    def __init__(self, column: Column, kind: str, const: object = None):
        self.column, self.kind, self.const = column, kind, const

    def __bool__(self) -> bool:
        raise NotTranslatable("a truth value is needed before the rows are known")

    def __iter__(self):
        raise NotTranslatable("a column has no parts")

    @property
    def truth(self) -> Column:
        if self.kind == "bool":
            return self.column
        return self.column != "" if self.kind == "str" else self.column != 0

    def __add__(self, other: object) -> Value:
        b = value(other)
        if self.kind == b.kind == "str":
            return Value(F.concat(self.column, b.column), "str")
        x, y, k = _numbers(self, b)
        return Value(x + y, k)

    def __radd__(self, other: object) -> Value:
        return value(other) + self

    def __sub__(self, other: object) -> Value:
        x, y, k = _numbers(self, value(other))
        return Value(x - y, k)

    def __rsub__(self, other: object) -> Value:
        return value(other) - self

    def __mul__(self, other: object) -> Value:
        b = value(other)
        for s, n in ((self, b), (b, self)):
            if s.kind == "str" and n.kind in ("int", "bool"):
                return Value(F.repeat(s.column, F.greatest(n.column, F.lit(0)).cast("int")), "str")
        x, y, k = _numbers(self, b)
        return Value(x * y, k)

    __rmul__ = __mul__

    def __truediv__(self, other: object) -> Value:
        x, y, _ = _numbers(self, value(other))
        return Value(x.cast("double") / y.cast("double"), "float")

    def __rtruediv__(self, other: object) -> Value:
        return value(other) / self

    def __floordiv__(self, other: object) -> Value:
        x, y, k = _numbers(self, value(other))
        if k == "int":  # truncated, less one where that rounded up
            whole = F.call_function("div", x, y)
            return Value(whole - ((x % y != 0) & ((x < 0) != (y < 0))).cast("bigint"), "int")
        return Value(F.floor(x / y).cast("double"), "float")

    def __rfloordiv__(self, other: object) -> Value:
        return value(other) // self

    def __mod__(self, other: object) -> Value:
        x, y, k = _numbers(self, value(other))
        if k == "int":
            return Value((x % y + y) % y, "int")
        return Value(x - y * F.floor(x / y), "float")

    def __rmod__(self, other: object) -> Value:
        return value(other) % self

    def __pow__(self, other: object) -> Value:
        b = value(other)
        x, y, k = _numbers(self, b)
        whole = k == "int" and isinstance(b.const, int) and b.const >= 0
        p = F.pow(x.cast("double"), y.cast("double"))
        return Value(p.cast("bigint"), "int") if whole else Value(p, "float")

    def __rpow__(self, other: object) -> Value:
        return value(other) ** self

    def _bits(self, other: object, f: Callable[[Column, Column], Column]) -> Value:
        b = value(other)
        if self.kind == b.kind == "bool":
            return Value(f(self.column.cast("int"), b.column.cast("int")) != 0, "bool")
        x, y, k = _numbers(self, b)
        if k != "int":
            raise NotTranslatable("bits of a number that isn't whole")
        return Value(f(x, y), "int")

    def __and__(self, other: object) -> Value:
        return self._bits(other, lambda x, y: x.bitwiseAND(y))

    def __or__(self, other: object) -> Value:
        return self._bits(other, lambda x, y: x.bitwiseOR(y))

    def __xor__(self, other: object) -> Value:
        return self._bits(other, lambda x, y: x.bitwiseXOR(y))

    __rand__, __ror__, __rxor__ = __and__, __or__, __xor__

    def __lshift__(self, other: object) -> Value:
        b = value(other)
        if not isinstance(b.const, int):
            raise NotTranslatable("a shift by a column")
        return Value(F.shiftleft(self.column.cast("bigint"), b.const), "int")

    def __rshift__(self, other: object) -> Value:
        b = value(other)
        if not isinstance(b.const, int):
            raise NotTranslatable("a shift by a column")
        return Value(F.shiftright(self.column.cast("bigint"), b.const), "int")

    def __neg__(self) -> Value:
        x, _, k = _numbers(self, self)
        return Value(-x, k, -self.const if isinstance(self.const, (int, float)) else None)

    def __pos__(self) -> Value:
        return self

    def __invert__(self) -> Value:
        return Value(F.bitwise_not(self.column.cast("bigint")), "int")

    def __abs__(self) -> Value:
        x, _, k = _numbers(self, self)
        return Value(F.abs(x), k)

    def __round__(self, digits: int | None = None) -> Value:
        if digits is None:
            return Value(F.bround(self.column.cast("double"), 0).cast("bigint"), "int")
        return Value(F.bround(self.column, digits), self.kind)

    def _compared(self, other: object, f: Callable[[Column, Column], Column], unlike: bool | None) -> Value:
        try:
            b = value(other)
        except NotTranslatable:
            if unlike is None:
                raise
            return Value(F.lit(unlike), "bool")
        numbers = {"int", "float", "bool"}
        if {self.kind, b.kind} == {"str"} or {self.kind, b.kind} <= numbers or "" in (self.kind, b.kind):
            x, y = self.column, b.column
            if "bool" in (self.kind, b.kind) and self.kind != b.kind:
                x, y = x.cast("double"), y.cast("double")
            return Value(f(x, y), "bool")
        if unlike is None:
            raise ValueError("a string and a number have no order")
        return Value(F.lit(unlike), "bool")

    def __eq__(self, other: object) -> Value:
        return self._compared(other, lambda x, y: x == y, False)

    def __ne__(self, other: object) -> Value:
        return self._compared(other, lambda x, y: x != y, True)

    def __lt__(self, other: object) -> Value:
        return self._compared(other, lambda x, y: x < y, None)

    def __le__(self, other: object) -> Value:
        return self._compared(other, lambda x, y: x <= y, None)

    def __gt__(self, other: object) -> Value:
        return self._compared(other, lambda x, y: x > y, None)

    def __ge__(self, other: object) -> Value:
        return self._compared(other, lambda x, y: x >= y, None)

    def __contains__(self, other: object) -> bool:
        raise NotTranslatable("`in` of a column has to be written in an expression string")

    def __getitem__(self, at: object) -> Value:
        if self.kind != "str":
            raise NotTranslatable("a part of a number")
        n = F.char_length(self.column)

        def place(x: object, missing: Column) -> Column:
            if x is None:
                return missing
            x = value(x)
            return F.greatest(F.lit(0), F.least(n, F.when(x.column < 0, n + x.column).otherwise(x.column))).cast("int")

        if isinstance(at, slice):
            if at.step not in (None, 1):
                raise NotTranslatable("a slice with a step")
            a, b = place(at.start, F.lit(0)), place(at.stop, n)
            return Value(F.substring(self.column, a + 1, F.greatest(b - a, F.lit(0))), "str")
        i = value(at).column
        return Value(F.substring(self.column, F.when(i < 0, n + i + 1).otherwise(i + 1).cast("int"), F.lit(1)), "str")

    # methods of strings
    def upper(self) -> Value:
        return Value(F.upper(self.column), "str")

    def lower(self) -> Value:
        return Value(F.lower(self.column), "str")

    def _strip(self, f: Callable, chars: object) -> Value:
        return Value(f(self.column, F.lit(" \t\n\r\x0b\x0c") if chars is None else value(chars).column), "str")

    def strip(self, chars: object = None) -> Value:
        return self._strip(F.btrim, chars)

    def lstrip(self, chars: object = None) -> Value:
        return self._strip(F.ltrim, chars)

    def rstrip(self, chars: object = None) -> Value:
        return self._strip(F.rtrim, chars)

    def startswith(self, other: object) -> Value:
        return Value(F.startswith(self.column, value(other).column), "bool")

    def endswith(self, other: object) -> Value:
        return Value(F.endswith(self.column, value(other).column), "bool")

    def replace(self, old: object, new: object) -> Value:
        return Value(F.replace(self.column, value(old).column, value(new).column), "str")

    def find(self, other: object) -> Value:
        return Value(F.position(value(other).column, self.column).cast("bigint") - 1, "int")

    def isdigit(self) -> Value:
        return Value(F.regexp_like(self.column, F.lit("^[0-9]+$")), "bool")


def if_else(test: Value, yes: Value, no: Value) -> Value:
    kind = yes.kind if yes.kind == no.kind else "float" if {yes.kind, no.kind} <= {"int", "float", "bool"} else ""
    if "str" in (yes.kind, no.kind) and yes.kind != no.kind:
        raise NotTranslatable("a string or a number")
    return Value(F.when(test.truth, yes.column).otherwise(no.column), kind)


def both(values: list[Value], conj: bool) -> Value:
    """`and` or `or`."""
    out = values[-1]
    for v in reversed(values[:-1]):
        if v.kind == out.kind == "bool":
            out = Value(v.column & out.column if conj else v.column | out.column, "bool")
        elif v.kind == out.kind:
            out = if_else(v, out, v) if conj else if_else(v, v, out)
        else:
            out = Value(v.truth & out.truth if conj else v.truth | out.truth, "bool")
    return out


def negated(v: Value) -> Value:
    return Value(~v.truth, "bool")


def contained(v: Value, items: object) -> Value:
    """`in` of a list of constants or of a string."""
    if isinstance(items, Value):
        if items.kind != "str" or v.kind != "str":
            raise NotTranslatable("`in` of something that isn't a string or a list")
        return Value(F.contains(items.column, v.column), "bool")
    out = Value(F.lit(False), "bool")
    alike = [x for x in map(value, items) if x.const is not None and ((x.kind == "str") == (v.kind == "str"))]
    if alike:
        out = Value(v.column.isin([x.const for x in alike]), "bool")
    for x in map(value, items):
        if x.const is None:
            out = both([out, v == x], False)
    return out


def _extreme(f: Callable) -> Callable:
    def g(*args: object) -> Value:
        if len(args) == 1:
            args = tuple(args[0])
        vs = [value(a) for a in args]
        kinds = {v.kind for v in vs}
        if "str" in kinds and len(kinds) > 1:
            raise ValueError("a string and a number have no order")
        kind = "float" if "float" in kinds else vs[0].kind
        return Value(f(*(v.column.cast("double") if kind == "float" else v.column.cast("bigint") if kind == "int" else v.column for v in vs)), kind)

    return g


def _to_int(v: object) -> Value:
    v = value(v)
    return Value(v.column.cast("bigint"), "int")


def _to_str(v: object) -> Value:
    v = value(v)
    if v.kind == "bool":
        return Value(F.when(v.column, "True").otherwise("False"), "str")
    if v.kind == "float":
        raise NotTranslatable("digits of a float")
    return Value(v.column.cast("string"), "str")


FUNCTIONS: dict[str, Callable] = {
    "abs": lambda v: abs(value(v)),
    "min": _extreme(F.least),
    "max": _extreme(F.greatest),
    "len": lambda v: Value(F.char_length(value(v).column).cast("bigint"), "int"),
    "round": lambda v, n=None: round(value(v), None if n is None else value(n).const),
    "int": _to_int,
    "float": lambda v: Value(value(v).column.cast("double"), "float"),
    "str": _to_str,
    "bool": lambda v: Value(value(v).truth, "bool"),
    "hash": lambda v: Value(F.xxhash64(value(v).column), "int"),
    "pow": lambda a, b: value(a) ** value(b),
}

_MATH_FLOAT = {"sqrt": F.sqrt, "exp": F.exp, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "log10": F.log10, "log2": F.log2, "log1p": F.log1p, "expm1": F.expm1, "degrees": F.degrees, "radians": F.radians, "fabs": F.abs, "cbrt": F.cbrt}


class Math:
    """The module math over columns."""

    pi, e, tau, inf = math.pi, math.e, math.tau, math.inf

    def __getattr__(self, name: str) -> Callable:
        if name in _MATH_FLOAT:
            return lambda v: Value(_MATH_FLOAT[name](value(v).column.cast("double")), "float")
        if name in ("floor", "ceil", "trunc"):
            f = {"floor": F.floor, "ceil": F.ceil}.get(name, lambda c: c)
            return lambda v: Value(f(value(v).column).cast("bigint"), "int")
        if name == "log":
            return lambda v, base=None: Value(F.ln(value(v).column.cast("double")) / (F.lit(1.0) if base is None else F.ln(value(base).column.cast("double"))), "float")
        if name == "pow":
            return lambda a, b: Value(F.pow(value(a).column.cast("double"), value(b).column.cast("double")), "float")
        if name == "hypot":
            return lambda a, b: Value(F.hypot(value(a).column.cast("double"), value(b).column.cast("double")), "float")
        if name == "atan2":
            return lambda a, b: Value(F.atan2(value(a).column.cast("double"), value(b).column.cast("double")), "float")
        if name == "fmod":
            return lambda a, b: Value(value(a).column.cast("double") % value(b).column.cast("double"), "float")
        raise NotTranslatable(f"math.{name}")


class RowProxy:
    """A row whose fields are Values: what traced functions get."""

    def __init__(self, fields: dict[str, Value]):
        self.__dict__["fields"] = fields

    def __getattr__(self, name: str) -> Value:
        try:
            return self.fields[name]
        except KeyError:
            raise AttributeError(f"no field {name!r}") from None

    def __getitem__(self, i: int) -> Value:
        return list(self.fields.values())[i]


def traced(f: Callable, *args: object, extra: dict[str, Callable] | None = None) -> object:
    """f(*args) with Python's own functions replaced by those on columns; NotTranslatable if f does more than that."""

    def either(name: str, on_columns: Callable) -> Callable:
        plain = getattr(builtins, name)
        return lambda *a: plain(*a) if all(isinstance(x, (int, float, str)) for x in a) else on_columns(*a)

    swapped = {k: either(k, v) for k, v in (FUNCTIONS | (extra or {})).items()}
    if isinstance(f, types.FunctionType):
        module = {k: Math() for k, v in f.__globals__.items() if v is math}
        f = types.FunctionType(f.__code__, {**f.__globals__, **module, **swapped}, f.__name__, f.__defaults__, f.__closure__)
    try:
        return f(*args)
    except (NotTranslatable, ValueError):
        raise
    except Exception as e:
        raise NotTranslatable(str(e)) from e
