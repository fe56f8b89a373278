"""Replacement rules, transforms and attributes."""

from __future__ import annotations

import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.functions import attributes, rules, transforms


def apply(spark, values, conditions, results, kind=None, known=None):
    kind = kind or T.DoubleType()
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], T.StructType([T.StructField("i", T.IntegerType()), T.StructField("v", kind)]))
    parsed = rules.parse_rules(conditions, results)
    if known is None and rules.needs_statistics(parsed):
        known = rules.statistics(frame, "v")
    out = frame.select("i", rules.apply_rules(F.col("v"), kind, parsed, known).alias("v"))
    return [r.v for r in out.orderBy("i").collect()], out.schema["v"].dataType


def test_first_match_wins_and_missing_stays(spark):
    got, kind = apply(spark, [-3.0, 5.0, 100.0, 120.0, math.nan, math.inf, None], "<0, >=100", "0, 100", T.FloatType())
    assert got[:4] == [0, 5, 100, 100] and math.isnan(got[4]) and got[5] == math.inf and got[6] is None
    assert kind == T.FloatType()


def test_statistics_come_from_finite_values(spark):
    assert apply(spark, [1.0, 2.0, 3.0, math.nan], "<=median", "mean + 1")[0][:3] == [3, 3, 3]
    got, kind = apply(spark, [-1, 2], "<0", "0", T.IntegerType())
    assert got == [0, 2] and kind == T.DoubleType()


def test_float_columns_compare_as_floats(spark):
    assert apply(spark, [0.1], "==0.1", "7", T.FloatType())[0] == [7]


@pytest.mark.parametrize("text,value", [("2**3**2", 512), ("-2**2", -4), ("7 % -3", -2), ("abs(-3) + ceil(1.2) * floor(2.9)", 7), ("(1 + 2) * 3 / 4", 2.25), ("pi - pi", 0), (".5e1", 5)])
def test_expressions(text, value):
    assert rules.parse_expression(text).value() == value


@pytest.mark.parametrize("text", ["", "1 +", "(1", "1)", "a.b", "abs 1", "abs()", "1 if 2 else 3", "2**99", "1/0", "max(1)", "x", "10**400", "+".join("1" * 70)])
def test_bad_expressions(text):
    with pytest.raises(rules.RuleError):
        rules.parse_expression(text).value()


@pytest.mark.parametrize("conditions,results", [("<0", ""), ("0", "1"), ("<0,", "1,2"), ("<(0", "1"), ("<0,>1", "1")])
def test_bad_rules(conditions, results):
    with pytest.raises(rules.RuleError):
        rules.parse_rules(conditions, results)


@given(st.integers(-50, 50), st.integers(-50, 50), st.integers(1, 9))
def test_arithmetic_is_that_of_python(a, b, c):
    assert rules.parse_expression(f"{a} + {b} * ({a} - {b}) % {c}").value() == a + b * (a - b) % c


def test_fill_scale_and_markers(spark):
    frame = spark.createDataFrame([(-99,), (3,), (None,)], "v short")
    rule = transforms.Transform((-99.0,), 0.01)
    out = frame.select(transforms.decode(F.col("v"), rule, "int16").alias("v"))
    assert out.schema["v"].dataType == T.FloatType()
    assert [r.v and round(r.v, 6) for r in out.collect()] == [None, 0.03, None]
    floats = spark.createDataFrame([(math.nan,), (1.0,)], "v double").select(transforms.decode(F.col("v"), transforms.Transform((math.nan,)), "float64").alias("v"))
    assert [r.v for r in floats.collect()] == [None, 1.0]
    assert transforms.output_marker("int16", rule, {}) == -99
    assert math.isnan(transforms.output_marker("float32", rule, {}))
    assert transforms.output_marker("int16", transforms.Transform(), {"missing_value": -5}) == -5
    assert transforms.output_marker("int16", transforms.Transform(), {}, needed=False) is None
    for dtype, marker in (("int8", 300.0), ("int16", 1.5), ("uint8", -1.0)):
        with pytest.raises(transforms.TransformError):
            transforms.output_marker(dtype, transforms.Transform(output_fill=marker), {})
    assert (transforms.scaled_type("int16"), transforms.scaled_type("int64"), transforms.resampled_type("int16"), transforms.resampled_type("float64", "float32")) == ("float32", "float64", "float64", "float32")
    assert transforms.parse_numbers("[-1, nan]")[0] == -1
    attrs = transforms.rewritten_attrs({"scale_factor": 0.1, "add_offset": 2, "units": "K"}, rule, -99)
    assert attrs == {"units": "K", "_FillValue": -99, "missing_value": -99, "source_scale_factor": 0.01}


def test_references(spark):
    frame = spark.createDataFrame([({"grid_mapping": "crs", "coordinates": "lat lon gone lat", "cell_measures": "area: a volume: b", "formula_terms": "a b", "bounds": "x y", "units": "K"},)], "a map<string,string>")
    out = frame.select(attributes.sanitised(F.col("a"), ["crs", "lat", "longitude", "a"], {"lon": "longitude"})).first()[0]
    assert out == {"grid_mapping": "crs", "coordinates": "lat longitude", "cell_measures": "area: a", "units": "K"}
