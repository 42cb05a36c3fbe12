"""Order-keeping set operations, integrity checks, text tables, links and time series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rounds of reachable() after which the tables of its rounds are written as one.
COMPACT = 16


def upsert(old: DataFrame, new: DataFrame, key: str, pos: str) -> DataFrame:
    """old with rows of the same key replaced in place and the other new rows after them; (key, value, pos), pos gapless from 0 on both sides and in the result."""
    from wardlight.functions.stats import running_total

    n_old = old.agg(F.coalesce(F.max(pos) + 1, F.lit(0)).alias("_n"))
    o = old.select(F.col(key), F.col("value").alias("_ov"), F.col(pos).alias("_op"))
    n = new.select(F.col(key), F.col("value").alias("_nv"), F.col(pos).alias("_np"))
    both = o.join(n, key, "full")
    stay = both.where(F.col("_op").isNotNull()).select(key, F.coalesce("_nv", "_ov").alias("value"), F.col("_op").cast("long").alias(pos))
    added = running_total(both.where(F.col("_op").isNull()), "_np", F.lit(1), "_place").join(F.broadcast(n_old))
    return stay.unionByName(added.select(key, F.col("_nv").alias("value"), (F.col("_n") + F.col("_place") - 1).cast("long").alias(pos)))


def missing(expected: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return expected.join(present, key, "left_anti")


def violations(df: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """(key, rule): a row for each rule that a row breaks; a null verdict breaks it too."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(key, F.explode(broken).alias("rule"))


def labels_of(df: DataFrame, text: Column, terms: dict[str, str]) -> DataFrame:
    """df with labels: the sorted names of the patterns that the text matches."""
    found = F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(name)) for name, p in terms.items()]))
    return df.withColumn("labels", F.array_sort(found))


def carry_forward(lines: DataFrame, by: str, order: str, header: Column, out: str) -> DataFrame:
    """Each line with the last header value at or before it in its document; null before the first."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn(out, F.last(header, ignorenulls=True).over(w))


def blocks(lines: DataFrame, by: str, order: str, starts: Column, text: str) -> DataFrame:
    """(by, block, text): lines joined from one start to before the next; lines before the first start are left out."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("block", F.sum(starts.cast("int")).over(w)).where("block > 0")
    grouped = numbered.groupBy(by, "block").agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("l"))
    return grouped.select(by, "block", F.array_join(F.transform("l", lambda p: p[text]), " ").alias("text"))


def html_links(pages: DataFrame) -> DataFrame:
    """(page_id, href, label) of the anchors of a page, in text order kept by ordinal."""
    href = r"""href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
    found = F.regexp_extract_all("html", F.lit(rf"(?is)<a\s(?:[^>]*?\s)?{href}[^>]*>.*?</a>"), F.lit(0))
    one = pages.select("page_id", F.posexplode(found).alias("ordinal", "a"))
    return one.select("page_id", "ordinal", F.regexp_replace(F.regexp_extract("a", rf"(?is){href}", 1), "^[\"']|[\"']$", "").alias("href"), F.trim(F.regexp_replace(F.regexp_replace("a", r"(?s)<[^>]*>", ""), r"\s+", " ")).alias("label"))


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node, depth): nodes that can be reached from the start nodes and their least number of steps, by frontiers until none is left; edges: (src, dst).

    A round writes its own nodes only; every COMPACT rounds these tables are put together.
    """
    from wardlight.plans.session import cut_lineage

    frontier = cut_lineage(start.select("node", F.lit(0).alias("depth")).distinct())
    e = cut_lineage(edges.select("src", "dst").where("src <> dst").distinct())
    seen, depth = frontier, 0
    while True:
        depth += 1
        fresh = frontier.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        frontier = cut_lineage(fresh.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
        if depth % COMPACT == 0:
            seen = cut_lineage(seen)


def terminal(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes without an edge to another."""
    return nodes.join(edges.where("src <> dst").select(F.col("src").alias("node")), "node", "left_anti")


def daily_mean(readings: DataFrame, low: float, high: float) -> DataFrame:
    """(station, day, mean, n): means of readings in (low, high] by UTC day."""
    ok = readings.where((F.col("value") > low) & (F.col("value") <= high))
    return ok.groupBy("station", F.to_date("ts").alias("day")).agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))


def seasonal_summary(readings: DataFrame, in_season: Column) -> DataFrame:
    """(station, annual, seasonal, n) with means of all and of the season's readings."""
    return readings.groupBy("station").agg(F.avg("value").alias("annual"), F.avg(F.when(in_season, F.col("value"))).alias("seasonal"), F.count(F.lit(1)).alias("n"))


def segments(df: DataFrame, by: str, x: str, gap: int = 1) -> DataFrame:
    """df with segment: runs of x without a gap greater than `gap`, numbered from 0."""
    w = Window.partitionBy(by).orderBy(x)
    jump = F.coalesce((F.col(x) - F.lag(x).over(w) > gap).cast("int"), F.lit(0))
    return df.withColumn("_j", jump).withColumn("segment", F.sum("_j").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_j")


def value_counts(df: DataFrame, col: str | Column) -> DataFrame:
    """(value, n), the most frequent first."""
    return df.groupBy((F.col(col) if isinstance(col, str) else col).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")


def name_suffixes(df: DataFrame, name: str, order: str, out: str) -> DataFrame:
    """Repeated names with _2, _3 ... in their order."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return df.withColumn(out, F.when(k == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_"), k.cast("string"))))
