"""What an expression uses several times stands in it once, so that a row takes its time once."""

from pyspark.sql import functions as F

from wardlight.functions import forms, shapes
from wardlight.operators import reports


def times(spark, schema, column, name):
    return spark.createDataFrame([], schema).select(column.alias("v"))._jdf.queryExecution().analyzed().toString().count(name + "(")


def test_heights_of_a_polygon(spark):
    assert times(spark, "rings array<array<struct<x:double,y:double>>>", shapes.inside_point(F.col("rings")), "array_distinct") == 1
    none = spark.createDataFrame([(None,), ([],), ([[(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)]],)], "rings array<array<struct<x:double,y:double>>>")
    assert [r.p for r in none.select(shapes.inside_point(F.col("rings")).alias("p")).collect()] == [None, None, None]


def test_numbers_of_a_text(spark):
    assert times(spark, "t string", forms.earliest_year(F.col("t")), "regexp_extract_all") == 1


def test_sections_of_a_report(spark):
    assert times(spark, "t string", reports.members_of_table(F.col("t")), "lower") == 1
