"""N-gram Jaccard self-join by MinHash banding.

Equal texts are one class, a node of its own. A class has the set of its five-word shingles; MinHash values in bands and rows, chosen for a target recall at the similarity asked for, give one bucket a band.
Buckets are shuffled, their members compared by sketches and turned into candidate components (see clusters), and within those the full shingle sets of all pairs are compared. For that each text is read once:
it is set against one text of its component, and only the shingles in which the two differ go to the pairs of blocks; intersections follow from them exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.llm.clusters import blocked, candidates, count_links, linked_components, row_labels, units
from wardlight.llm.common import batch_rows, materialize, scratch, slices, small
from wardlight.llm.fertility import words_of

#: Words whose hashes a Python worker keeps.
CACHE_WORDS = 500_000
#: Members of a component that are set against one copy of its first text.
MEASURED_TOGETHER = 1024
#: MinHash values kept as a sketch, 16 bits each; texts whose sketches agree less than this often are no candidates.
SKETCH, SKETCH_SHARE = 64, 0.5
MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def choose_bands(similarity: float, recall: float, max_hashes: int = 512) -> tuple[int, int]:
    """(bands, rows): the most rows, and so the fewest false candidates, whose bands reach the recall at the similarity within max_hashes values."""
    best = (1, 1)
    for rows in range(1, 33):
        missed = 1 - similarity**rows
        bands = max(1, int(np.ceil(np.log(1 - recall) / np.log(missed)))) if missed > 0 else 1
        if bands * rows <= max_hashes:
            best = (bands, rows)
    return best


class Shingles:
    """Shingle sets of texts as sorted 64-bit hashes, by way of a bounded cache of word hashes."""

    def __init__(self, width: int):
        self.width = width
        self.words: dict[str, int] = {}

    def of(self, text: str | None) -> np.ndarray:
        words = words_of(text) if text else []
        if not words:
            return np.zeros(0, np.uint64)
        known = self.words
        if len(known) > CACHE_WORDS:
            known.clear()
        try:
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self.width, len(words))  # a shorter text is one shingle
        s = h[: len(h) - k + 1].copy()
        for i in range(1, k):
            s = (s ^ (s >> np.uint64(31))) * MIX_A + h[i : len(h) - k + 1 + i]
        s = (s ^ (s >> np.uint64(29))) * MIX_B
        return np.unique(s ^ (s >> np.uint64(32)))


def text_hash(text: str | Column) -> Column:
    """128 bits that name a text; null for null."""
    return F.unhex(F.md5(F.encode(text, "UTF-8")))


def signatures(docs: DataFrame, width: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(id, h, bands, sketch): the id, text_hash() of the text, a bucket hash for each band and a sketch; null bands for a text without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        rng = np.random.default_rng(2024)
        values = max(bands * rows, SKETCH)
        flip = rng.integers(0, 1 << 32, values, np.uint32)
        times = rng.integers(0, 1 << 32, values, np.uint32) | np.uint32(1)
        number = (np.arange(1, bands + 1, dtype=np.uint64) * MIX_B)[None, :]
        for batch in slices(batches, 300):
            texts = batch.column(1).to_pylist()
            least = np.full((len(texts), values), np.uint32(0xFFFFFFFF))
            empty = np.zeros(len(texts), bool)
            for k, text in enumerate(texts):
                x = (shingles.of(text) >> np.uint64(32)).astype(np.uint32)
                empty[k] = not len(x)
                for i in range(0, len(x), 512):
                    part = x[i : i + 512, None] ^ flip
                    part *= times
                    np.minimum(least[k], part.min(0), out=least[k])
            folded = np.broadcast_to(number, (len(texts), bands)).copy()
            by_band = least[:, : bands * rows].reshape(len(texts), bands, rows).astype(np.uint64)
            for r in range(rows):
                folded = (folded ^ (folded >> np.uint64(31))) * MIX_A + by_band[:, :, r]
            folded = ((folded ^ (folded >> np.uint64(29))) * MIX_B).view(np.int64)
            sketch = (least[:, :SKETCH] >> np.uint32(16)).astype("<u2")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array([None if e else f for e, f in zip(empty, folded, strict=True)], pa.list_(pa.int64())),
                    pa.array([None if e else s.tobytes() for e, s in zip(empty, sketch, strict=True)], pa.binary()),
                ],
                ["id", "h", "bands", "sketch"],
            )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), text_hash(text_col).alias("h")).mapInArrow(sign, "id long, h binary, bands array<long>, sketch binary")


def sketches_near(xs: list[bytes], ys: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(xs), "<u2").reshape(-1, SKETCH)
    y = np.frombuffer(b"".join(ys), "<u2").reshape(-1, SKETCH)
    return (x == y).mean(1) >= SKETCH_SHARE


def sketch_of(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2")


def sketch_links(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Which pairs of sketches agree often enough."""
    x = np.array(left)
    y = x if right is None else np.array(right)
    agree = np.zeros((len(x), len(y)), np.int16)
    for i in range(SKETCH):
        agree += x[:, i, None] == y[None, :, i]
    linked = agree >= SKETCH_SHARE * SKETCH
    if right is None:
        np.fill_diagonal(linked, False)
    return linked


def differences(texts: DataFrame, width: int) -> DataFrame:
    """(node, payload): how each text's shingles differ from those of its component's first text; from (component, part, is_first, node, text), a first text in every part.

    payload: the text's shingles, those it shares with the first text, the first text's, as 64-bit numbers, then the shingles that only one of the two has.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, first = Shingles(width), np.zeros(0, np.uint64)
        for batch in slices(batches, 300):
            nodes, payloads = [], []
            for is_first, node, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = shingles.of(text)
                if is_first:
                    first = own
                    continue
                unlike = np.setxor1d(own, first, assume_unique=True)
                shared = (len(own) + len(first) - len(unlike)) // 2
                nodes.append(node)
                payloads.append(np.array([len(own), shared, len(first)], np.uint64).tobytes() + unlike.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(payloads, pa.binary())], ["node", "payload"])

    dealt = texts.repartition("component", "part").sortWithinPartitions("component", "part", F.desc("is_first"))
    return dealt.select("is_first", "node", "text").mapInArrow(measure, "node long, payload binary")


def difference_of(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, np.uint64)


def jaccard_links(similarity: float):
    """links(left, right or None): which pairs of texts of one component have the similarity, from their differences to its first text.

    With d the shingles in which a text differs from the first text, and s those it shares with it: |a and b| = s(a) + s(b) - |first| + |d(a) and d(b)|.
    """

    def links(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
        all_ = left + (right or [])
        sizes, shared, firsts = np.array([x[:3] for x in all_], np.int64).T
        sets = [x[3:] for x in all_]
        n, cut = len(sets), len(left)
        values = np.concatenate(sets)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], np.repeat(np.arange(n), [len(s) for s in sets])[order]
        new = np.concatenate([[True], values[1:] != values[:-1]])[: len(values)]
        column = np.cumsum(new) - 1
        often = np.bincount(column)[column] > 1 if len(column) else new  # a shingle of one set is in no intersection
        owner, column = owner[often], column[often]
        column = np.unique(column, return_inverse=True)[1] if len(column) else column
        common = np.zeros((cut, n - cut) if right is not None else (n, n), np.float32)
        width = 4096
        for at in range(0, int(column.max()) + 1 if len(column) else 0, width):
            a, b = np.searchsorted(column, [at, at + width])
            part = np.zeros((n, width), np.float32)
            part[owner[a:b], column[a:b] - at] = 1
            common += part[:cut] @ part[cut:].T if right is not None else part @ part.T
        others = slice(cut, None) if right is not None else slice(None)
        common = np.rint(common).astype(np.int64) + shared[:cut, None] + shared[None, others] - firsts[0]
        both = sizes[:cut, None] + sizes[None, others] - common
        linked = common >= similarity * both - 1e-6
        if right is None:
            np.fill_diagonal(linked, False)
        return linked

    return links


def join(docs: DataFrame, similarity: float = 0.8, width: int = 5, recall: float = 0.9999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, class_id, n_links, kept), one row for each row of docs.

    n_links counts the other documents at the similarity or more, copies of the text included. class_id is the smallest doc_id reachable by links (the own one without links), kept says that
    the document is it. Words are case-sensitive; a text of fewer words than width is one shingle. A text that is null or has no word has no links. Ids are integers; a row with a null
    id has a null class_id, no links, and is kept. Rows repeated with their id and text count as one document; an id with two texts is two documents, of which one is kept if they have the same class. An
    empty table gives no rows.
    """
    bands, rows = choose_bands(similarity, recall)
    with scratch():
        with batch_rows(docs.sparkSession):
            signed = materialize(signatures(docs, width, bands, rows, id_col, text_col), outer=True)
        texts = signed.where("bands is not null and id is not null")
        classes = texts.groupBy("h").agg(F.min("id").alias("first"), F.count_distinct("id").alias("copies"))
        classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()))
        n_classes = classes.count()
        named = classes.select("h", F.col("first").alias("id"), "node")
        firsts = materialize(texts.join(small(named, n_classes), ["h", "id"]).dropDuplicates(["h", "id"]).select("node", "bands", "sketch"))
        buckets = firsts.select("node", F.explode("bands").alias("bucket"))
        members = candidates(buckets, firsts.select("node", "sketch"), False, sketches_near, sketch_of, sketch_links)
        wanted = materialize(blocked(members, MEASURED_TOGETHER).join(named, "node").select("h", "id", "node", "component", "n", "block"))
        own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), text_hash(text_col).alias("h"))
        own = materialize(own.join(small(wanted, wanted.count()), ["h", "id"]).dropDuplicates(["h", "id"]).select("node", "component", "n", "block", "text"))
        parts = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part")
        first = own.where("node = component").select("component", parts, F.lit(True).alias("is_first"), F.lit(None).cast("long").alias("node"), "text")
        all_ = own.select("component", F.col("block").alias("part"), F.lit(False).alias("is_first"), "node", "text").unionByName(first)
        with batch_rows(docs.sparkSession):
            payloads = materialize(differences(all_, width))
        work = units(members).join(small(classes.select("node", "copies"), n_classes), "node").join(payloads, "node")
        found = linked_components(count_links(work, "payload", difference_of, jaccard_links(similarity)))
        usable = F.col("bands").isNotNull() & F.col("id").isNotNull()
        labelled = row_labels(signed.select("id", F.col("h").alias("text_hash"), F.when(usable, F.col("h")).alias("h")), classes, found, "h")
    return labelled.select(F.col("id").alias("doc_id"), "text_hash", "class_id", "n_links", "kept")
