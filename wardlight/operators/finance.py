"""Budget lines, work orders and their reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight.functions.stats import last_wins, top_per_group

CRORE = 1e7


def totals(orders: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, amount_cr): number and sum of work orders, in crore."""
    return orders.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (F.sum("amount") / CRORE).alias("amount_cr"))


def top_labels(orders: DataFrame, by: list[str], label: str, k: int = 3) -> DataFrame:
    """(by, label, amount, place): each group's k labels with the greatest sums, in order; equal sums by label."""
    sums = orders.groupBy(*by, label).agg(F.sum("amount").alias("amount"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("amount"), label))
    return sums.withColumn("place", place).where(F.col("place") <= k)


def top_rows(orders: DataFrame, by: list[str], order: list[Column], k: int = 8) -> DataFrame:
    return top_per_group(orders, by, order, k)


def head_totals_of_top(lines: DataFrame, doc: str, head: str, per_doc: int = 5, k: int = 8) -> DataFrame:
    """(head, amount): the k heads with the greatest sums over each document's per_doc greatest heads."""
    top = top_labels(lines, [doc], head, per_doc)
    return top.groupBy(head).agg(F.sum("amount").alias("amount")).orderBy(F.desc("amount"), head).limit(k)


def flow_links(lines: DataFrame, k: int | None = 8) -> DataFrame:
    """(source, target, amount): from 'total' to each section, and from the sections to the k greatest heads, or to all."""
    sections = lines.groupBy("section").agg(F.sum("amount").alias("amount")).select(F.lit("total").alias("source"), F.col("section").alias("target"), "amount")
    if k is not None:
        heads = lines.groupBy("head").agg(F.sum("amount").alias("t")).orderBy(F.desc("t"), "head").limit(k)
        lines = lines.join(F.broadcast(heads.select("head")), "head", "left_semi")
    inner = lines.groupBy("section", "head").agg(F.sum("amount").alias("amount"))
    return sections.unionByName(inner.select(F.col("section").alias("source"), F.col("head").alias("target"), "amount"))


def node_values(links: DataFrame) -> DataFrame:
    """(node, value): the greater of what flows in and out."""
    into = links.groupBy(F.col("target").alias("node")).agg(F.sum("amount").alias("i"))
    out = links.groupBy(F.col("source").alias("node")).agg(F.sum("amount").alias("o"))
    return into.join(out, "node", "full").select("node", F.greatest(F.coalesce("i", F.lit(0.0)), F.coalesce("o", F.lit(0.0))).alias("value"))


def best_line(lines: DataFrame, key: list[str], rank: list[Column], tie: str) -> DataFrame:
    """One line a key: the greatest rank, of several the one with the smallest number `tie`."""
    return last_wins(lines, key, [*rank, -F.col(tie)])


def complete_years(lines: DataFrame, key: list[str], least: int = 4) -> DataFrame:
    """(fy_start, n, complete): distinct lines of a year, complete from `least` on."""
    n = lines.select("fy_start", *key).distinct().groupBy("fy_start").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("complete", F.col("n") >= least)


def deflate(amounts: DataFrame, index: DataFrame, to_year: int) -> DataFrame:
    """amounts with real: amount * index(to) / index(own year); a year without an index raises."""
    to = index.where(F.col("fy_start") == to_year).select(F.col("index_value").alias("_to"))
    joined = amounts.join(index.withColumnRenamed("index_value", "_own"), "fy_start", "left").join(F.broadcast(to))
    own = F.when(F.col("_own").isNull(), F.raise_error(F.concat(F.lit("no index for "), F.col("fy_start").cast("string"))).cast("double")).otherwise(F.col("_own"))
    return joined.withColumn("real", F.col("amount") * F.col("_to") / own).drop("_own", "_to")


def densify(keys: DataFrame, years: DataFrame, facts: DataFrame, on: list[str]) -> DataFrame:
    """Every key in every year (a short list), with its facts or nulls."""
    return keys.crossJoin(F.broadcast(years)).join(facts, on, "left")


def coverage(lines: DataFrame) -> DataFrame:
    """(fy_start, lines, high_confidence, with_amount)."""
    return lines.groupBy("fy_start").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("confidence") == "high").alias("high_confidence"), F.count("amount").alias("with_amount"))
