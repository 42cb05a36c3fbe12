"""Near-duplicate embeddings by lattice hashing.

A table projects the vectors at random to one or more blocks of eight dimensions and decodes each block to its nearest point of the E8 lattice; the points of the blocks are a cell. A vector is entered in its own cell of every table and in
the neighbouring cells (one block moved by one of the 240 shortest lattice vectors) that it lies nearest to. Vectors that meet in a cell become candidate components (see clusters), and
in those the cosines of all pairs are verified in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.clusters import candidates, count_links, linked_components, row_labels, units
from wardlight.llm.common import materialize, scratch, slices, small

#: Star edges of a lower cosine than the wanted one less this are no candidates; vectors that the stars leave apart are compared at the wanted one.
SLACK = 0.12
#: Vectors of a block of the comparison of pairs.
BLOCK = 1024


def short_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    found = []
    for i, j in combinations(range(8), 2):
        for s, t in product((1.0, -1.0), repeat=2):
            found.append([s if k == i else t if k == j else 0.0 for k in range(8)])
    found += [list(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(found)


def decode_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates of even sum: round, and where the sum is odd round the worst coordinate the other way."""
    near = np.rint(x)
    rest = x - near
    odd = np.flatnonzero(near.sum(1) % 2)
    worst = np.abs(rest[odd]).argmax(1)
    near[odd, worst] += np.where(rest[odd, worst] >= 0, 1.0, -1.0)
    return near


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8: of D8 or of D8 moved by a half, whichever is nearer."""
    whole, half = decode_d8(x), decode_d8(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1)
    return np.where(nearer[:, None], whole, half)


class Tables:
    """Projections of vectors of one dimension, the same on every machine."""

    def __init__(self, dim: int, tables: int, blocks: int, scale: float, probes: int, seed: int):
        rng = np.random.default_rng([seed, dim])
        projections = rng.normal(size=(tables, blocks, dim, 8)) * scale * np.sqrt(dim / 64)
        self.projection = projections.transpose(2, 0, 1, 3).reshape(dim, -1)
        self.shape, self.probes, self.short = (tables, blocks), probes, short_vectors()
        # a cell's hash is a sum over its doubled coordinates, so moving one block changes the hash by the move's own sum
        self.weights = rng.integers(-(1 << 62), 1 << 62, (tables, blocks, 8))
        self.seeds = rng.integers(-(1 << 62), 1 << 62, tables)
        self.moves = (self.weights @ np.rint(2 * self.short).astype(np.int64).T).reshape(tables, -1)

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        """Hashes of each vector's cells: its own and the nearest `probes` others in every table."""
        n, (tables, blocks) = len(vectors), self.shape
        y = (vectors @ self.projection).reshape(-1, 8)
        cell = decode_e8(y)
        own = self.seeds + (np.rint(2 * cell).astype(np.int64).reshape(n, tables, blocks, 8) * self.weights).sum((2, 3))
        if not self.probes:
            return own
        gain = ((y - cell) @ self.short.T).reshape(n, tables, -1)  # the nearer a neighbour, the greater
        best = np.argpartition(-gain, self.probes - 1, axis=2)[:, :, : self.probes]
        near = own[:, :, None] + np.take_along_axis(self.moves[None], best, 2)
        return np.concatenate([own, near.reshape(n, -1)], 1)


def unit(vector: list | None) -> np.ndarray | None:
    """The vector at length 1, or None if it is null, empty, zero, or holds a null or a number that isn't finite."""
    if not vector or any(v is None for v in vector):
        return None
    x = np.array(vector, np.float64)
    most = np.abs(x).max()
    if not np.isfinite(most) or most == 0:
        return None
    x /= most
    return x / np.sqrt(x @ x)


def cosine_links(least: float):
    def links(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
        linked = np.zeros((len(left), len(left if right is None else right)), bool)
        others = left if right is None else right
        for dim in {len(x) for x in left}:
            a = [k for k, x in enumerate(left) if len(x) == dim]
            b = [k for k, x in enumerate(others) if len(x) == dim]
            if a and b:
                linked[np.ix_(a, b)] = np.array([left[k] for k in a]) @ np.array([others[k] for k in b]).T >= least
        if right is None:
            np.fill_diagonal(linked, False)
        return linked

    return links


def near_duplicates(
    vectors: DataFrame, cosine: float = 0.9, tables: int = 24, blocks: int = 2, scale: float = 0.7, probes: int = 4, seed: int = 8, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of vectors.

    n_links counts the other vectors linked directly, component_id is the smallest vec_id reachable by links, kept says that the vector is it. Vectors that are null, empty or zero or hold
    null or non-finite numbers, rows with a null id, and vectors of another dimension link with nothing. Rows repeated with their id and vector count as one vector; an id with two vectors is two. Ids are integers.
    With the default tables two vectors of cosine 0.9 meet in a cell with a probability of 0.99 (0.95: 0.9999); each further block in a cell lets a hundred to a thousand times as many
    unrelated vectors be told apart, at four to eight times the tables: two blocks serve up to about 10 million vectors of 64 dimensions, three beyond. An empty table gives no rows.
    """
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Tables] = {}
        for batch in slices(batches, 500):
            ids = batch.column(0).to_pylist()
            units_ = [unit(v) if i is not None else None for i, v in zip(ids, batch.column(1).to_pylist(), strict=True)]
            n = len(units_)
            cells: list[np.ndarray | None] = [None] * n
            coarse: list[bytes | None] = [None] * n
            for dim in sorted({len(u) for u in units_ if u is not None}):
                at = [k for k, u in enumerate(units_) if u is not None and len(u) == dim]
                if dim not in known:
                    known[dim] = Tables(dim, tables, blocks, scale, probes, seed)
                x = np.array([units_[k] for k in at])
                eighths = np.rint(x * (127 / np.abs(x).max(1, keepdims=True))).astype(np.int8)
                for k, c, e in zip(at, known[dim].cells(x), eighths, strict=True):
                    cells[k], coarse[k] = c, e.tobytes()
            payloads = [None if u is None else u.tobytes() for u in units_]
            keys = [None if p is None else xxhash.xxh3_128_digest(p) for p in payloads]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(cells, pa.list_(pa.int64())), pa.array(payloads, pa.binary()), pa.array(coarse, pa.binary())], ["id", "key", "cells", "payload", "sketch"])

    least = cosine - SLACK

    def near(xs: list[bytes], ys: list[bytes]) -> np.ndarray:
        """Of vectors rounded to bytes."""
        out = np.zeros(len(xs), bool)
        for dim in {len(x) for x in xs}:
            at = [k for k, (x, y) in enumerate(zip(xs, ys, strict=True)) if len(x) == dim == len(y)]
            a, b = (np.frombuffer(b"".join([v[k] for k in at]), np.int8).reshape(-1, dim).astype(np.float32) for v in (xs, ys))
            out[at] = (a * b).sum(1) >= least * np.sqrt((a * a).sum(1) * (b * b).sum(1))
        return out

    with scratch():
        entered = materialize(given.mapInArrow(enter, "id long, key binary, cells array<long>, payload binary, sketch binary"), outer=True)
        classes = entered.where("key is not null").groupBy("key").agg(F.min("id").alias("first"), F.count_distinct("id").alias("copies"))
        classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()))
        n_classes = classes.count()
        named = classes.select("key", F.col("first").alias("id"), "node")
        firsts = materialize(entered.join(small(named, n_classes), ["key", "id"]).dropDuplicates(["key", "id"]).select("node", "cells", "payload", "sketch"))
        payloads = firsts.select("node", "payload")
        links = cosine_links(cosine)
        members = candidates(firsts.select("node", F.explode("cells").alias("bucket")), firsts.select("node", "sketch"), True, near, np.frombuffer, links, payloads, BLOCK)
        work = units(members, BLOCK).join(small(classes.select("node", "copies"), n_classes), "node").join(payloads, "node")
        found = linked_components(count_links(work, "payload", np.frombuffer, links))
        labelled = row_labels(entered.select("id", "key"), classes, found, "key")
    return labelled.select(F.col("id").alias("vec_id"), "n_links", F.col("class_id").alias("component_id"), "kept")
