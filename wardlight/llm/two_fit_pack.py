"""Best-two-fit packing of tokenised documents into sequences of bounded length.

Only lengths matter to the packing, and there are at most `capacity` of them: the plan is made on the histogram of piece lengths, whose size is
bounded whatever the number of documents. A bin is filled greedily, longest piece first; then its smallest piece is replaced by the two unpacked pieces
that fit its expanded gap most tightly, if they fit it more tightly than it does. The same choice is made again as long as the histogram
still holds its lengths, so one step plans that bin as often as it can be repeated. Spark then numbers the pieces of each length and joins them to the plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import batch_rows, gapless_rank, materialize, slices
from wardlight.llm.vocab import BytePairs

END_ID = 0

_IDS: dict[str | None, BytePairs] = {}


def piece_table(docs: DataFrame, vocabulary: str | None, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents with their end id, cut where longer than capacity."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _IDS:
            _IDS[vocabulary] = BytePairs(vocabulary)
        pairs, end = _IDS[vocabulary], np.asarray([END_ID], "<u4").tobytes()
        for batch in slices(batches, 500):
            rows: list[tuple[int, int, int, int, int]] = []
            for k, text in enumerate(batch.column(1).to_pylist()):
                ids = pairs.ids(text or "").tobytes() + end
                n = len(ids) // 4
                start, stop, piece = 0, n % capacity or capacity, 0
                while start < n:
                    rows.append((k, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                    start, stop, piece = stop, stop + capacity, piece + 1
            k, piece, start, length, crc = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [], [], [])
            own = batch.column(0).take(pa.array(k, pa.int64()))
            yield pa.RecordBatch.from_arrays([own, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(id_col, text_col).mapInArrow(pieces, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """[(lengths with their number in the bin, longest first), how many such bins] by best-two-fit on a histogram of lengths."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    sizes = np.arange(capacity + 1)
    plan = []
    while left.any():
        fits = np.maximum.accumulate(np.where(left > 0, sizes, 0))  # the longest length that is left, up to each
        bin_: dict[int, int] = {}
        gap, size = capacity, int(fits[capacity])
        while size:
            bin_[size] = n = min(int(left[size]), gap // size)
            gap -= n * size
            size = int(fits[min(gap, size - 1)])
        smallest = min(bin_)
        if gap:
            room = gap + smallest
            free = left.copy()
            for size, n in bin_.items():
                free[size] -= n
            free[smallest] += 1
            best = np.maximum.accumulate(np.where(free > 0, sizes, 0))
            a = sizes[1:room][free[1:room] > 0]
            b = np.minimum(best[room - a], a)
            same = (b == a) & (free[a] < 2)
            b = np.where(same, best[a - 1], b)
            ok = b > 0
            if ok.any():
                sums = np.where(ok, a + b, 0)
                k = int(sums.argmax())
                if sums[k] > smallest:
                    bin_[smallest] -= 1
                    for size in (int(a[k]), int(b[k])):
                        bin_[size] = bin_.get(size, 0) + 1
                    bin_ = {size: n for size, n in bin_.items() if n}
        times = min(int(left[size]) // n for size, n in bin_.items())
        for size, n in bin_.items():
            left[size] -= n * times
        plan.append((sorted(bin_.items(), reverse=True), times))
    return plan


def pack(docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row for each piece.

    A document is its token ids and one end id. A longer one than capacity is cut into pieces of capacity, its first piece may be shorter. A null
    or empty text is one end id. Repeated rows and null ids are documents of their own (which of two pieces of one length takes which place is decided by their ids);
    an empty table gives no rows. vocabulary: a byte-level vocabulary file of the tokenizers library, at the same path on every machine; None: the public one. A text's added tokens are one id each.
    """
    with batch_rows(docs.sparkSession):
        pieces = materialize(piece_table(docs, vocabulary, capacity, id_col, text_col))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    slots, sequence, used = [], 0, dict.fromkeys(counts, 0)
    for bin_, times in plan_bins(counts, capacity):
        offset = 0
        for length, n in bin_:
            # the n pieces of this length in each of `times` bins: ranks used .. used + n * times, n to a bin
            slots.append((length, used[length], used[length] + n * times, n, sequence, offset))
            used[length] += n * times
            offset += n * length
        sequence += times
    plan = docs.sparkSession.createDataFrame(slots, "length long, first long, past long, n long, sequence long, base long")
    ranked = gapless_rank(pieces, "length", ["doc_id", "piece", "ids_crc32"], "rank")
    at = F.col("rank") - F.col("first")
    return ranked.join(F.broadcast(plan), [ranked["length"] == plan["length"], ranked["rank"] >= plan["first"], ranked["rank"] < plan["past"]]).select(
        "doc_id", "piece", "start", ranked["length"], "ids_crc32", (F.col("sequence") + F.floor(at / F.col("n"))).alias("sequence_id"), (F.col("base") + F.pmod(at, F.col("n")) * ranked["length"]).alias("offset"),
    )
