"""Field types, relation schemas, and their Spark counterparts."""

from __future__ import annotations

import json
import keyword
import re
from collections import namedtuple
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DECLARED = re.compile(r"\s*([a-z]+)\s*(?:\(\s*(\d+)\s*\))?\s*")
_SPARK = {"byte": T.ShortType(), "short": T.ShortType(), "int": T.IntegerType(), "float": T.FloatType(), "double": T.DoubleType(), "char": T.StringType(), "text": T.StringType()}
_SIZED = ("char", "text")
_BOUNDS = {"byte": (0, 255), "short": (-(1 << 15), (1 << 15) - 1), "int": (-(1 << 31), (1 << 31) - 1)}
#: what is cut from the end of strings that come from files
PADDING = "\x00 \n"


@dataclass(frozen=True)
class FieldType:
    """One of byte, short, int, float, double, char(n), text(n); n counts UTF-8 bytes."""

    kind: str
    size: int | None = None

    @classmethod
    def parse(cls, declared: str) -> FieldType | None:
        """None where the declaration isn't a type: unknown names, sized numbers, strings without a size, anything after it."""
        m = _DECLARED.fullmatch(declared)
        if not m or m[1] not in _SPARK or (m[1] in _SIZED) != (m[2] is not None):
            return None
        return cls(m[1], int(m[2]) if m[2] else None)

    def __str__(self) -> str:
        return f"{self.kind}({self.size})" if self.size is not None else self.kind

    @property
    def spark(self) -> T.DataType:
        return _SPARK[self.kind]

    @property
    def is_text(self) -> bool:
        return self.kind in _SIZED

    @property
    def default(self) -> object:
        return "" if self.is_text else 0.0 if self.kind in ("float", "double") else 0

    def from_string(self, value: str) -> object:
        if self.is_text:
            return self.fit(value.rstrip(PADDING))
        return float(value) if self.kind in ("float", "double") else self.fit(int(value))

    def fit(self, value: object) -> object:
        """The value as stored: strings cut to size, numbers checked against their range."""
        if self.is_text:
            return str(value).encode()[: self.size].decode(errors="ignore")
        if self.kind in _BOUNDS:
            lo, hi = _BOUNDS[self.kind]
            if int(value) != value or not lo <= value <= hi:
                raise ValueError(f"{value!r} is not a {self}")
            return int(value)
        return float(value)

    def column(self, c: Column) -> Column:
        """c as this type: numbers cast, with an error outside the range; strings cut to size in bytes."""
        if self.is_text:
            s = c.cast("string")
            raw = F.hex(F.substring(F.encode(s, "UTF-8"), 1, self.size))
            # a first byte of a character at the end, with fewer bytes after it than it announces, goes with them
            whole = F.regexp_replace(raw, "^((?:..)*?)(?:[CD].|E.(?:[89AB].)?|F.(?:[89AB].){0,2})$", "$1")
            cut = F.decode(F.unhex(whole), "UTF-8")
            return F.when(F.octet_length(s) <= self.size, s).otherwise(cut)
        if self.kind == "byte":
            return F.when(c.between(0, 255) | c.isNull(), c.cast("short")).otherwise(F.raise_error(F.concat(F.lit("not a byte: "), c.cast("string"))).cast("short"))
        return c.cast(self.spark)


class Schema:
    """A relation's name and its ordered fields."""

    def __init__(self, name: str, fields: list[tuple[str, str]]):
        self.name = name
        self.fields: list[tuple[str, FieldType]] = []
        for field, declared in fields:
            kind = declared if isinstance(declared, FieldType) else FieldType.parse(declared)
            if kind is None:
                raise ValueError(f"{declared!r} is not a type")
            if not field.isidentifier() or keyword.iskeyword(field) or field.startswith("_"):
                raise ValueError(f"{field!r} is not a field name")
            self.fields.append((field, kind))
        if not self.fields:
            raise ValueError("a schema needs a field")
        if len(set(self.names)) < len(self.names):
            raise ValueError("field names must differ")
        self.row_type = namedtuple("Row", self.names)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Schema) and self.name == other.name and self.fields == other.fields

    def __hash__(self) -> int:
        return hash((self.name, tuple(self.fields)))

    def __repr__(self) -> str:
        return self.toString()

    @property
    def names(self) -> list[str]:
        return [f for f, _ in self.fields]

    def type_of(self, field: str) -> FieldType:
        return dict(self.fields)[field]

    def schema(self) -> list[tuple[str, str]]:
        return [(f, str(t)) for f, t in self.fields]

    def toString(self) -> str:
        return f"{self.name}[{','.join(f'({f},{t})' for f, t in self.fields)}]"

    @property
    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f, t.spark) for f, t in self.fields])

    def rename(self, name: str, names: dict[str, str]) -> Schema:
        """All fields under new names, in their places; KeyError for a field without one."""
        return Schema(name, [(names[f], t) for f, t in self.fields])

    def match(self, other: Schema) -> bool:
        """The same fields and types in the same order; the relation's name doesn't count."""
        return self.fields == other.fields

    def project(self, row: tuple, schema: Schema) -> tuple:
        """The part of a row that another schema names."""
        missing = [f for f in schema.names if f not in self.names]
        if missing:
            raise ValueError(f"no such field: {', '.join(missing)}")
        return schema.row_type(*(row[self.names.index(f)] for f in schema.names))

    def instantiate(self, *values: object) -> tuple:
        if len(values) != len(self.fields):
            raise ValueError(f"{len(self.fields)} values are needed")
        return self.row_type(*values)

    def default(self) -> tuple:
        return self.row_type(*(t.default for _, t in self.fields))

    def stored(self, row: tuple) -> tuple:
        """A row as it is stored."""
        return self.row_type(*(t.fit(v) for (_, t), v in zip(self.fields, row, strict=True)))

    def valuesFromStrings(self, *values: str) -> tuple:
        return self.row_type(*(t.from_string(v) for (_, t), v in zip(self.fields, values, strict=True)))

    def cast(self, df: DataFrame) -> DataFrame:
        """df's columns, by position, under this schema's names and types."""
        return df.select(*(t.column(df[c]).alias(f) for c, (f, t) in zip(df.columns, self.fields, strict=True)))

    def pack(self) -> str:
        return json.dumps({"name": self.name, "fields": self.schema()})

    @classmethod
    def unpack(cls, packed: str) -> Schema:
        got = json.loads(packed)
        return cls(got["name"], [tuple(f) for f in got["fields"]])

    @classmethod
    def from_types(cls, name: str, fields: list[tuple]) -> Schema:
        """Of fields whose types are parsed already; any of them may be Spark's own."""
        out = cls.__new__(cls)
        out.name, out.fields = name, list(fields)
        out.row_type = namedtuple("Row", out.names)
        return out

    @classmethod
    def combined(cls, left: Schema, right: Schema) -> Schema:
        """The fields of one, then those of the other."""
        return cls.from_types(f"{left.name}_{right.name}", [*left.fields, *right.fields])

    @classmethod
    def of(cls, name: str, df: DataFrame) -> OpenSchema:
        """Of any DataFrame: its own Spark types, for relations that come as files."""
        return OpenSchema(name, df.schema)


class OpenType:
    """A Spark type that has no declaration of its own, such as bigint or timestamp."""

    def __init__(self, spark: T.DataType):
        self.spark, self.size, self.kind = spark, None, spark.simpleString()

    def __str__(self) -> str:
        return self.kind

    def __eq__(self, other: object) -> bool:
        return isinstance(other, OpenType) and self.spark == other.spark

    def __hash__(self) -> int:
        return hash(self.kind)

    @property
    def is_text(self) -> bool:
        return self.kind == "string"

    @property
    def default(self) -> object:
        return "" if self.is_text else 0

    def fit(self, value: object) -> object:
        return value

    def column(self, c: Column) -> Column:
        return c.cast(self.spark)


class OpenSchema(Schema):
    def __init__(self, name: str, struct: T.StructType):
        self.name = name
        self.fields = [(f.name, OpenType(f.dataType)) for f in struct]
        self.row_type = namedtuple("Row", self.names)

    def rename(self, name: str, names: dict[str, str]) -> OpenSchema:
        return OpenSchema(name, T.StructType([T.StructField(names[f], t.spark) for f, t in self.fields]))

    def pack(self) -> str:
        return json.dumps({"name": self.name, "struct": self.struct.json()})


def unpack(packed: str) -> Schema:
    got = json.loads(packed)
    if "struct" in got:
        return OpenSchema(got["name"], T.StructType.fromJson(json.loads(got["struct"])))
    return Schema.unpack(packed)


def declared(text: str) -> FieldType | OpenType:
    """A field type, or any Spark type by its SQL name."""
    own = FieldType.parse(text)
    if own is not None:
        return own
    try:
        return OpenType(T._parse_datatype_string(text))
    except Exception as e:
        raise ValueError(f"{text!r} is not a type") from e
