import math
import warnings

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeframe.functions import expr

ROWS = [(7, -3, 2.5, "abc", ""), (-7, 3, -0.5, "Hello World", "x"), (0, 5, 4.0, "  pad ", "12"), (12, -12, 0.25, "", "abc")]
NAMES = ["a", "b", "f", "s", "t"]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "a int, b int, f double, s string, t string").cache()


@pytest.mark.parametrize(
    "text",
    [
        "a + b * 2", "a - b", "a / b", "a // b", "a % b", "-a // 4", "-7 % b", "a ** 2", "f ** 2", "a // 2.0", "f % 2", "abs(a) + abs(f)", "~a", "a & 3", "a | 8", "a ^ b", "a << 2", "a >> 1", "+a",
        "a < b < 100", "a == b or a > 0", "not a", "a and b", "a or b", "s and t", "s or t", "a in [7, 12, 99]", "a not in (7,)", "s in ('abc', '')", "'b' in s", "a == s", "a != s",
        "'yes' if a > 0 else 'no'", "1 if s else 0", "min(a, b)", "max(a, b, 1)", "min(a, f)", "len(s) + 1", "round(f)", "round(f, 1)", "int(f)", "float(a)", "str(a) + s", "bool(a)",
        "s + t", "s * 2", "s[1:3]", "s[:2]", "s[-2:]", "s[1:]", "s.upper()", "s.lower() == 'abc'", "s.strip()", "s.startswith('a')", "s.endswith('c')", "s.replace('l', 'L')", "s.find('b')", "t.isdigit()",
        "math.sqrt(f * f + 1)", "math.floor(f)", "math.ceil(f)", "math.pi * a", "math.exp(f)", "math.hypot(f, a)", "math.log(f * f, 2)", "True", "a > 0 and s != '' and f < 3", "a == 7.0",
    ],
)
def test_like_python(rows, text):
    with warnings.catch_warnings():
        warnings.simplefilter("error")  # nothing here needs Python
        got = [r[0] for r in rows.select(expr.projection(text, rows.schema, None)).collect()]
    want = [eval(text, {"math": math}, dict(zip(NAMES, r, strict=True))) for r in ROWS]
    for g, w in zip(got, want, strict=True):
        assert g == pytest.approx(w, rel=1e-12) if isinstance(w, float) else g == w, text


def test_predicates_by_truth(rows):
    for text in ("a", "s", "not s", "f", "a and s", "a or t"):
        got = [r.a for r in rows.filter(expr.predicate(text, rows.schema)).collect()]
        assert got == [r[0] for r in ROWS if eval(text, {}, dict(zip(NAMES, r, strict=True)))], text


def test_python_takes_over_with_a_warning(rows):
    from pyspark.sql import types as T

    with pytest.warns(UserWarning):
        got = rows.select(expr.projection("s[::-1].title()", rows.schema, T.StringType())).collect()
    assert [r[0] for r in got] == [r[3][::-1].title() for r in ROWS]


@pytest.mark.parametrize("text", ["a is b", "nothing + 1", "a +", "a < s"])
def test_errors(rows, text):
    with pytest.raises(ValueError):
        expr.predicate(text, rows.schema)


def test_division_by_zero_is_an_error(rows):
    with pytest.raises(Exception, match="ZERO"):
        rows.select(expr.projection("1 / a", rows.schema, None)).collect()


def test_parts_of_expressions():
    assert expr.attributes("a + max(b, math.pi) and c.upper() == 'd'") == {"a", "b", "c"}
    assert expr.conjuncts("a and (b or c) and (d and e)") == ["a", "b or c", "d", "e"]
    assert expr.equality("a == b") == ("a", "b") and expr.equality("a == 1") is None
    assert expr.is_attribute("a") and not expr.is_attribute("a + 1")
    assert expr.substituted("a + b", {"a": "x * 2"}) == "x * 2 + b"


@settings(max_examples=25, deadline=None)
@given(st.integers(-(2**40), 2**40), st.integers(-(2**20), 2**20).filter(bool))
def test_floor_division_and_remainder(spark, x, y):
    df = spark.createDataFrame([(x, y)], "x long, y long")
    got = df.select(expr.projection("x // y", df.schema, None).alias("q"), expr.projection("x % y", df.schema, None).alias("r")).first()
    assert (got.q, got.r) == (x // y, x % y)
