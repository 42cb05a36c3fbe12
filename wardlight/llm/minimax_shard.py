"""Sharding by minimax contiguous partition.

Documents with equal texts form one atomic group. Groups are ordered by the MD5 of their text; the smallest
capacity at which a greedy pass cuts that order into n_shards runs is found by binary search, and the runs of the
greedy pass at that capacity are the shards.

The prefix sums stay distributed. A feasibility check of many capacities at once is n_shards small aggregations
("the last group that ends at or before this shard's limit"); capacities that bracket the answer leave a narrow window of
possible cut positions, and once that window is within WINDOW groups the binary search ends on the driver.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlight.llm.common import gapless_rank, materialize, utf8_size

#: Capacities checked together in one distributed round.
PROBES = 24
#: Group ends that may be read to the driver for the last part of the search (8 bytes each).
WINDOW = 200_000


def group_table(rows: DataFrame) -> DataFrame:
    """(_h, end): groups in the order of _h with the bytes up to and including each; from (_h, size) rows."""
    groups = rows.groupBy("_h").agg(F.sum("size").alias("_bytes"))
    byte = lambda i: F.conv(F.hex(F.substring("_h", i, 1)), 16, 10).cast("int")
    groups = materialize(groups.select("_h", "_bytes", byte(1).alias("_hi"), byte(2).alias("_lo")))
    # 256 x 256 buckets by the first two bytes of the hash, so no window spans the table
    sums = groups.groupBy("_hi", "_lo").agg(F.sum("_bytes").alias("_b"))
    earlier = (Window.unboundedPreceding, -1)
    low = Window.partitionBy("_hi").orderBy("_lo").rowsBetween(*earlier)
    inner = sums.select("_hi", "_lo", F.coalesce(F.sum("_b").over(low), F.lit(0)).alias("_in"))
    tops = groups.groupBy("_hi").agg(F.sum("_bytes").alias("_b"))
    top = Window.orderBy("_hi").rowsBetween(*earlier)  # at most 256 rows
    outer = tops.select("_hi", F.coalesce(F.sum("_b").over(top), F.lit(0)).alias("_out"))
    offsets = inner.join(F.broadcast(outer), "_hi").select("_hi", "_lo", (F.col("_in") + F.col("_out")).alias("_off"))
    running = Window.partitionBy("_hi", "_lo").orderBy("_h").rowsBetween(Window.unboundedPreceding, 0)
    return groups.join(F.broadcast(offsets), ["_hi", "_lo"]).select(  # at most 65,536 offsets
        "_h", "_bytes", (F.col("_off") + F.sum("_bytes").over(running)).alias("end")
    )


def greedy_cuts(groups: DataFrame, capacities: list[int], n_shards: int) -> list[list[int]]:
    """For each capacity, the ends of the n_shards runs of the greedy pass (the last one may fall short of the total)."""
    at = [0] * len(capacities)
    cuts: list[list[int]] = [[] for _ in capacities]
    for _ in range(n_shards):
        found = groups.agg(*[
            F.max(F.when(F.col("end") <= F.lit(a + c), F.col("end"))).alias(f"c{i}") for i, (a, c) in enumerate(zip(at, capacities, strict=True))
        ]).first()
        at = [max(a, x or 0) for a, x in zip(at, found, strict=True)]
        for own, a in zip(cuts, at, strict=True):
            own.append(a)
    return cuts


def smallest_capacity(groups: DataFrame, n_shards: int) -> tuple[int, list[int]]:
    """The smallest capacity that n_shards contiguous runs need, and the ends of those runs."""
    total, largest = groups.agg(F.max("end"), F.max("_bytes")).first()
    if not total:
        return 0, [0] * n_shards
    even = -(-total // n_shards)
    low, high = max(even, largest) - 1, even + largest  # low never suffices, high always does
    low_cuts, high_cuts = [0] * n_shards, [total] * n_shards
    while high - low > 1:
        step = -(-(high - low) // (PROBES + 1))
        tried = list(range(low + step, high, step)) or [low + 1]
        if tried[0] != low + 1:
            tried.insert(0, low + 1)  # the lower bound itself is often the answer
        for capacity, cuts in zip(tried, greedy_cuts(groups, tried, n_shards), strict=True):
            if cuts[-1] >= total:
                high, high_cuts = capacity, cuts
                break
            low, low_cuts = capacity, cuts
        near = F.lit(False)
        for a, b in zip(low_cuts, high_cuts, strict=True):
            near = near | F.col("end").between(a, b)
        window = groups.where(near)
        if window.count() <= WINDOW:
            ends = sorted(r[0] for r in window.select("end").collect())
            while high - low > 1:
                mid, at, cuts = (low + high) // 2, 0, []
                for _ in range(n_shards):
                    k = bisect_right(ends, at + mid)
                    at = max(at, ends[k - 1]) if k else at
                    cuts.append(at)
                if at >= total:
                    high, high_cuts = mid, cuts
                else:
                    low = mid
    if high_cuts[0] == total and high != total:
        high_cuts = greedy_cuts(groups, [high], n_shards)[0]
    return high, high_cuts


def shard(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for every row of docs.

    size is the UTF-8 bytes of the text plus 1; a null text counts as an empty one and joins its group. Equal texts
    share a shard. Slots number a shard's rows from 0 without gaps, in no particular text order; repeated rows and
    null ids are rows of their own (which of two identical rows has which slot is open). An empty table gives no rows.
    If one group holds more than 1/n_shards of all bytes, that group sets the capacity and late shards may stay empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(docs.select(
        F.col(id_col).alias("doc_id"), (utf8_size(text_col) + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("_h"),
    ))
    groups = materialize(group_table(rows))
    _, cuts = smallest_capacity(groups, n_shards)
    lasts = {r["end"]: bytes(r["_h"]) for r in groups.where(F.col("end").isin(sorted(set(cuts)))).select("end", "_h").collect()}
    number = F.lit(0)
    for cut in cuts[:-1]:
        if cut in lasts:  # a cut at 0 closes an empty run
            number = number + (F.col("_h") > F.lit(lasts[cut])).cast("int")
    placed = materialize(rows.withColumn("shard", number.cast("int")))
    return gapless_rank(placed, "shard", ["_h", "doc_id"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
