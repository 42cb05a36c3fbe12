"""Civic views over the driver's star schema: points, wards, a transit feed, budget lines, sensors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.functions import coerce, geo


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @staticmethod
    def _at(key: str) -> tuple:
        return (72 + F.pmod(F.col(key) * 7919, F.lit(1000)) / 1000.0).alias("x"), (23 + F.pmod(F.col(key) * 104729, F.lit(1000)) / 1000.0).alias("y")

    def people(self) -> DataFrame:
        """(point_id, x, y, weight, segment): customers as points."""
        return self.table("customer").select(F.col("c_custkey").alias("point_id"), *self._at("c_custkey"), F.greatest(F.col("c_acctbal").cast("double"), F.lit(0.0)).alias("weight"), F.col("c_mktsegment").alias("segment"))

    def libraries(self) -> DataFrame:
        """(target_id, x, y, value): suppliers as points."""
        return self.table("supplier").select(F.col("s_suppkey").alias("target_id"), *self._at("s_suppkey"), F.col("s_acctbal").cast("double").alias("value"))

    def wards(self) -> DataFrame:
        """(poly_id, ordinal, name, region, ring): a 5 by 5 grid, a nation each."""
        k = F.col("n_nationkey")
        edge = lambda o, i: F.lit(o) + F.lit(0.2) * i
        col, row = F.pmod(k, F.lit(5)), F.floor(k / 5)
        ring = geo.rectangle(edge(72.0, col), edge(23.0, row), edge(72.0, col + 1), edge(23.0, row + 1))
        return self.table("nation").select(k.alias("poly_id"), k.alias("ordinal"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"), ring.alias("ring"))

    def routes(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("route_id"), F.col("c_mktsegment").alias("agency_id"), F.pmod(F.col("c_custkey"), F.lit(4)).cast("int").alias("route_type"), F.col("c_name").alias("route_name"))

    def trips(self) -> DataFrame:
        return self.table("orders").select(F.col("o_orderkey").alias("trip_id"), F.col("o_custkey").alias("route_id"))

    def stop_times(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_orderkey").alias("trip_id"), F.col("l_linenumber").alias("stop_sequence"), F.col("l_suppkey").alias("stop_id"))

    def stops(self) -> DataFrame:
        return self.table("supplier").select(F.col("s_suppkey").alias("stop_id"), F.col("s_name").alias("stop_name"), *self._at("s_suppkey"))

    def budget(self) -> DataFrame:
        """(line_id, doc, section, head, contractor, ward, amount, fy_start, basis, confidence): a line of an order each."""
        li, pa, su, na = self.table("lineitem"), self.table("part"), self.table("supplier"), self.table("nation")
        joined = li.join(pa, li["l_partkey"] == pa["p_partkey"]).join(su, li["l_suppkey"] == su["s_suppkey"]).join(na, su["s_nationkey"] == na["n_nationkey"])
        return joined.select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_id"), F.pmod(F.col("l_orderkey"), F.lit(50)).alias("doc"), F.col("p_brand").alias("section"), F.col("p_type").alias("head"),
            F.col("s_name").alias("contractor"), F.col("n_name").alias("ward"), F.col("l_extendedprice").cast("double").alias("amount"), coerce.fiscal_start(F.to_date("l_shipdate")).alias("fy_start"),
            F.col("l_returnflag").alias("basis"), F.when(F.col("l_linestatus") == "F", "high").otherwise("low").alias("confidence"),
        )

    def readings(self) -> DataFrame:
        """(station, ts, value)."""
        return self.table("events").select(F.col("user_id").alias("station"), F.col("ts").alias("ts"), F.col("value").cast("double").alias("value"))
