"""Shared by the similarity operators: from buckets of an index to verified links, without emitting all pairs of a bucket.

A bucket becomes a star: edges from its members to its smallest and its largest member. Edges that an operator finds plausible make candidate components; a bucket whose members these leave
apart is compared in full. A component is cut by a hash into blocks; every pair of blocks is one unit of work in which an operator counts its links. A unit returns, for each member that has links
there, their number and one edge to the smallest member it reaches in the unit, so what is returned grows with the members and not with the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlight.llm.common import BROADCAST_BYTES, hot_join, materialize, scratch, width

#: Members of a block; a unit holds two blocks at most.
BLOCK = 256


def bucket_ends(buckets: DataFrame) -> DataFrame:
    """(bucket, low, high, n, nodes): the smallest and the largest node, the number and a hash of the nodes of each bucket of two nodes or more, from (bucket, node) rows."""
    aggs = F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("nodes")
    return buckets.groupBy("bucket").agg(*aggs).where("low < high")


def star_edges(shared: DataFrame, both_ends: bool) -> DataFrame:
    """(a, b), a > b, distinct: every node of a bucket with the bucket's smallest node, and its largest if both_ends, from (bucket, node, low, high) rows.

    The second star serves an index whose buckets hold unrelated nodes, one of which may be the smallest.
    """
    pairs = shared.select("node", F.explode(F.array("low", "high")).alias("other")) if both_ends else shared.select("node", F.col("low").alias("other"))
    pairs = pairs.where("node <> other")
    return pairs.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct()


def _lowest(low: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Labels lowered along the edges until each is the smallest of its component; nodes are places in low."""
    while True:
        before = low.copy()
        np.minimum.at(low, left, low[right])
        np.minimum.at(low, right, low[left])
        if (before == low).all():
            return low


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of each batch as stars."""
    for batch in batches:
        if not batch.num_rows:
            continue
        u, v = (batch.column(i).to_numpy() for i in (0, 1))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        low = _lowest(nodes.copy(), at[: len(u)], at[len(u) :])
        far = low != nodes
        yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(low[far])], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge, from (a, b) edges; by large and small stars.

    Edges (u, v) have u > v. Every round each task replaces its own edges by stars to their smallest nodes; then each edge's lower end moves to that end's smallest neighbour, and each node's lower
    neighbours are tied to the smallest of them. Joins on a node that a great part of the edges meet at are split.
    """
    contract = lambda e: e.select("u", "v").mapInArrow(_contracted, "u long, v long").distinct()
    with scratch():
        e = materialize(contract(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")))
        while True:
            low = materialize(e.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("out")))
            moved = hot_join(e, low.select(F.col("u").alias("v"), "m"), "v", "left")
            large = materialize(moved.select("u", F.coalesce("m", "v").alias("v"), F.col("m").isNotNull().alias("moved")))
            # done when every node either is a centre or has one edge, to a centre
            if not large.where("moved").limit(1).count() and not low.where("out > 1").limit(1).count():
                break
            large = large.select("u", "v").distinct()
            low = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
            down = hot_join(large, low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            e = materialize(contract(down.unionAll(low.select("u", F.col("m").alias("v")))))
        return materialize(e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select("v", "v").distinct()), outer=True)


def blocked(members: DataFrame, block: int) -> DataFrame:
    """(component, node, n, block): a block number below n, the component's number of blocks, for each member, from (node, component)."""
    sizes = materialize(members.groupBy("component").agg(F.count(F.lit(1)).alias("_n")))
    dealt = hot_join(members, sizes.select("component", F.ceil(F.col("_n") / block).cast("int").alias("n")), "component", counts=sizes, total=members.count())
    return dealt.select("component", "node", "n", F.pmod(F.xxhash64("node"), F.col("n")).cast("int").alias("block"))


def units(members: DataFrame, block: int | None = None) -> DataFrame:
    """(component, lo, hi, side, node): the blocks of each component in all pairs, from (node, component)."""
    dealt = blocked(members, block or BLOCK).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return dealt.select("component", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), (F.col("block") > F.col("other")).alias("side"), "node")


Links = Callable[[list, list | None], np.ndarray]


def _unit_rows(nodes: list[int], copies: np.ndarray, linked: np.ndarray, cut: int) -> tuple[list[int], list[int], list[int]]:
    """(node, smallest node it reaches in the unit, linked rows) of the nodes with links; linked: a boolean matrix, of nodes[:cut] by nodes[cut:] if cut."""
    if cut:
        counts = np.concatenate([linked @ copies[cut:], linked.T @ copies[:cut]])
        left, right = np.nonzero(linked)
        right = right + cut
    else:
        counts = linked @ copies
        left, right = np.nonzero(linked)
    low = _lowest(np.array(nodes, np.int64), left, right)
    has = np.flatnonzero(counts)
    return [nodes[k] for k in has], low[has].tolist(), counts[has].astype(np.int64).tolist()


def count_links(work: DataFrame, payload: str, prepare: Callable, links: Links) -> DataFrame:
    """(node, low, n_links) from units with copies and a payload column: links() of prepared payloads, summed over a node's partners with their copies.

    work is dealt by unit and sorted; a unit's rows stand together, and only one unit is held at a time.
    """
    unit = ["component", "lo", "hi"]
    dealt = work.select(*unit, "side", "node", "copies", payload).repartition(*unit).sortWithinPartitions(*unit, "side", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def close() -> pa.RecordBatch | None:
            if len(rows) < 2:
                return None
            cross = key[1] != key[2]
            cut = sum(not r[0] for r in rows) if cross else 0
            if cross and cut in (0, len(rows)):
                return None
            ready = [r[3] for r in rows]
            linked = links(ready[:cut], ready[cut:]) if cross else links(ready, None)
            found = _unit_rows([r[1] for r in rows], np.array([r[2] for r in rows], np.int64), linked, cut)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["node", "low", "n_links"]) if found[0] else None

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for k, data in enumerate(batch.column(6).to_pylist()):
                at = (columns[0][k], columns[1][k], columns[2][k])
                if at != key:
                    if (done := close()) is not None:
                        yield done
                    key, rows = at, []
                rows.append((columns[3][k], columns[4][k], columns[5][k], prepare(data)))
        if (done := close()) is not None:
            yield done

    return dealt.mapInArrow(run, "node long, low long, n_links long")


def linked_components(found: DataFrame) -> DataFrame:
    """(node, n_links, component) of the nodes with links, from count_links()."""
    with scratch():
        found = materialize(found)
        groups = components(found.select(F.col("node").alias("a"), F.col("low").alias("b")))
        totals = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
        return materialize(totals.join(groups, "node", "left").select("node", "n_links", F.coalesce("component", "node").alias("component")), outer=True)


def plausible(edges: DataFrame, sketches: DataFrame, near: Callable[[list, list], np.ndarray]) -> DataFrame:
    """The (a, b) edges whose sketches near() finds close, from materialized edges and (node, sketch)."""
    first = hot_join(edges, sketches.select(F.col("node").alias("a"), F.col("sketch").alias("x")), "a")
    both = hot_join(first, sketches.select(F.col("node").alias("b"), F.col("sketch").alias("y")), "b", counts=edges.groupBy("b").agg(F.count(F.lit(1)).alias("_n")), total=edges.count())

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = near(batch.column(2).to_pylist(), batch.column(3).to_pylist())
                yield batch.select([0, 1]).filter(pa.array(keep))

    return both.select("a", "b", "x", "y").mapInArrow(test, "a long, b long")


def _apart(placed: DataFrame, block: int | None = None) -> DataFrame:
    """(component, lo, hi, side, node): the blocks of each bucket in all pairs, from (bucket, node, own); own components of a block's nodes or more have blocks of their own, which aren't paired with each other."""
    size = block or BLOCK
    groups = placed.groupBy("bucket", "own").agg(F.count(F.lit(1)).alias("n")).withColumn("large", F.col("n") >= size)
    groups = groups.withColumn("part", F.when(F.col("large"), F.col("own")).otherwise(F.lit(0)))
    parts = groups.groupBy("bucket", "large", "part").agg(F.ceil(F.sum("n") / size).cast("int").alias("blocks"))
    of_bucket = Window.partitionBy("bucket")
    parts = parts.withColumn("first", F.sum("blocks").over(of_bucket.orderBy("large", "part")) - F.col("blocks")).withColumn("total", F.sum("blocks").over(of_bucket))
    dealt = placed.join(groups.drop("n"), ["bucket", "own"]).join(parts, ["bucket", "large", "part"])
    dealt = dealt.withColumn("block", F.col("first") + F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1)))
    dealt = dealt.where(~F.col("large") | (F.col("other") < F.col("first")) | (F.col("other") >= F.col("first") + F.col("blocks")))
    return dealt.select(F.col("bucket").alias("component"), F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), (F.col("block") > F.col("other")).alias("side"), "node")


def candidates(
    buckets: DataFrame, sketches: DataFrame, both_ends: bool, near: Callable[[list, list], np.ndarray], prepare: Callable, links: Links, payloads: DataFrame | None = None, block: int | None = None,
) -> DataFrame:
    """(node, component) of the candidate components: any two nodes of a bucket whose prepared payloads links() finds linked share one. From (bucket, node), (node, sketch) and (node, payload), by default the sketches.

    Stars whose edges are near() come first. They say nothing of two nodes that are strangers to the ends of their bucket, or of which one is: a bucket that is left in several components
    is compared in pairs of blocks, save the pairs that share a component already. Buckets of the same nodes are compared once, those so small that the star holds all their pairs not at all.
    """
    payloads = sketches.withColumnRenamed("sketch", "payload") if payloads is None else payloads
    with scratch():
        ends = materialize(bucket_ends(buckets))
        n_ends, total = ends.agg(F.count(F.lit(1)), F.sum("n")).first()
        if n_ends * width(ends) <= BROADCAST_BYTES:
            shared = buckets.join(F.broadcast(ends), "bucket")
        else:
            shared = hot_join(buckets, ends, "bucket", counts=ends.select("bucket", F.col("n").alias("_n")), total=total)
        shared = materialize(shared.select("bucket", "node", "low", "high", "n", "nodes"))
        stars = materialize(plausible(materialize(star_edges(shared, both_ends)), sketches, near))
        found = components(stars)
        sets = ends.where(F.col("n") > (3 if both_ends else 2)).groupBy("n", "nodes").agg(F.min("bucket").alias("_first"))
        crowded = materialize(shared.join(F.broadcast(sets.select("_first")) if n_ends * 32 <= BROADCAST_BYTES else sets.select("_first"), F.col("bucket") == F.col("_first"), "left_semi").select("bucket", "node"))
        placed = crowded.join(found, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("own"))
        several = placed.groupBy("bucket").agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low < high").select("bucket")
        placed = materialize(placed.join(several, "bucket"))
        if placed.limit(1).count():
            work = _apart(placed, block).withColumn("copies", F.lit(1).cast("long")).join(payloads, "node")
            more = count_links(work, "payload", prepare, links).select(F.col("node").alias("a"), F.col("low").alias("b"))
            found = components(stars.unionAll(more))
        return materialize(found, outer=True)


def row_labels(rows: DataFrame, classes: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """rows with class_id, n_links and kept; rows: (id, key), key null for what links with nothing; classes: (key, node, first, copies), found: linked_components() of the nodes.

    class_id is the smallest id of the linked classes, n_links counts the other members of the class and of those linked with it, kept marks the row whose id and class name the group.
    """
    linked = materialize(classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")))
    leads = linked.where("n_links is not null").groupBy("component").agg(F.min(F.struct("first", "node")).alias("lead"))
    labels = linked.join(leads, "component", "left").select(
        key, "copies", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("lead.first", "first").alias("class_id"),
        F.coalesce("lead.node", "node").eqNullSafe(F.col("node")).alias("_leads"),
    )
    labels = materialize(labels, outer=True)
    placed = hot_join(rows, labels.drop("copies"), key, "left", counts=labels.select(key, F.col("copies").alias("_n")), total=rows.count())
    return placed.withColumn("kept", F.coalesce(F.col("_leads") & (F.col("class_id") == F.col("id")), F.lit(True))).withColumn(
        "class_id", F.coalesce("class_id", "id")
    ).withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long")).drop("_leads")
