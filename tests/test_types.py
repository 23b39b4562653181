import pytest
from pyspark.sql import functions as F

from lodeframe.functions.types import FieldType, Schema, unpack


@pytest.mark.parametrize("text, kind", [("int", "int"), ("char(10)", "char(10)"), ("text(5)", "text(5)"), ("double", "double"), ("byte", "byte"), ("short", "short"), ("float", "float")])
def test_types_are_parsed(text, kind):
    assert str(FieldType.parse(text)) == kind


@pytest.mark.parametrize("text", ["int(4)", "char", "text", "char(3)x", "bool", "", "int x"])
def test_other_declarations_are_none(text):
    assert FieldType.parse(text) is None


def test_schema_checks():
    for fields in ([], [("a", "int"), ("a", "int")], [("1a", "int")], [("a", "nothing")], [("class", "int")]):
        with pytest.raises(ValueError):
            Schema("x", fields)


def test_schema_operations():
    s = Schema("employee", [("id", "int"), ("dob", "char(10)"), ("salary", "int")])
    assert s.toString() == "employee[(id,int),(dob,char(10)),(salary,int)]"
    r = s.rename("other", {"id": "a", "dob": "b", "salary": "c"})
    assert r.names == ["a", "b", "c"] and not s.match(r) and r.match(r.rename("third", {"a": "a", "b": "b", "c": "c"}))
    with pytest.raises(KeyError):
        s.rename("other", {"id": "a"})
    row = s.instantiate(1, "1990-01-01", 100000)
    assert s.project(row, Schema("k", [("salary", "int"), ("id", "int")])) == (100000, 1)
    with pytest.raises(ValueError):
        s.project(row, Schema("k", [("none", "int")]))
    assert s.default() == (0, "", 0)
    assert s.valuesFromStrings("1", " x \x00\n", "3") == (1, " x", 3)
    assert unpack(s.pack()) == s


def test_values_are_stored_in_range():
    assert FieldType.parse("char(3)").fit("äbcd") == "äb"
    assert FieldType.parse("byte").fit(255) == 255
    for kind, v in (("byte", 256), ("byte", -1), ("short", 1 << 15), ("int", 1 << 31)):
        with pytest.raises(ValueError):
            FieldType.parse(kind).fit(v)


def test_casts(spark):
    df = spark.createDataFrame([("äbcd", 3.9, 255), ("äöüx", -3.9, 0)], "s string, d double, n int")
    out = Schema("t", [("s", "char(3)"), ("d", "int"), ("n", "byte")]).cast(df).collect()
    assert [tuple(r) for r in out] == [("äb", 3, 255), ("ä", -3, 0)]
    with pytest.raises(Exception, match="not a byte"):
        Schema("t", [("n", "byte")]).cast(df.select((F.col("n") + 1).alias("n"))).collect()
    assert Schema("t", [("x", "float")]).cast(spark.createDataFrame([(0.1,)], "x double")).first().x == pytest.approx(0.10000000149011612, abs=0)
