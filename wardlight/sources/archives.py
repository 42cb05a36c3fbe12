"""Archives and single files: zipped feeds, xz streams, one-file exports.

All bytes go through Spark's own file systems, so any store that Spark reaches will do. A compressed file can't be split: an archive is one task's, which streams it member by member; many archives are many tasks.
"""

from __future__ import annotations

import csv
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.plans.session import cut_lineage

#: Rows handed on together, bytes of text that are compressed together.
ROWS, CHUNK = 5000, 1 << 20


def _member_names(names: list[str]) -> dict[str, str]:
    """Members by their last path step; the later of two with one name counts, folders don't."""
    return {n.rsplit("/", 1)[-1]: n for n in names if not n.endswith("/")}


def zip_rows(spark: SparkSession, path: str, member: str, encoding: str = "utf-8-sig") -> DataFrame:
    """(archive, line, cells): the rows of one CSV member of every zip archive at a path, wherever it lies inside; cells maps header names to text, '' where a row is short, and has nothing of what a row has too many.

    A byte-order mark is taken off, bytes that are no text become U+FFFD. Archives without the member give no rows.
    """
    import zipfile

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.string(), pa.string())
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as z:
                    own = _member_names(z.namelist()).get(member)
                    if own is None:
                        continue
                    with z.open(own) as raw:
                        lines = csv.reader(io.TextIOWrapper(raw, encoding=encoding, errors="replace", newline=""))
                        header = [h.strip() for h in next(lines, [])]
                        held: list[list[tuple[str, str]]] = []
                        done = 0
                        for cells in lines:
                            if not cells:
                                continue
                            held.append(list({h: c for h, c in zip(header, [*cells, *[""] * len(header)], strict=False) if h}.items()))
                            if len(held) == ROWS:
                                yield pa.RecordBatch.from_arrays([pa.array([archive] * ROWS), pa.array(range(done, done + ROWS), pa.int64()), pa.array(held, kind)], ["archive", "line", "cells"])
                                done, held = done + ROWS, []
                        if held:
                            yield pa.RecordBatch.from_arrays([pa.array([archive] * len(held)), pa.array(range(done, done + len(held)), pa.int64()), pa.array(held, kind)], ["archive", "line", "cells"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(rows, "archive string, line long, cells map<string,string>")


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, name, header): the members of zip archives, their last path step and, of text tables, the header's names."""
    import zipfile

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as z:
                    for name, own in _member_names(z.namelist()).items():
                        header = None
                        if name.endswith((".txt", ".csv")):
                            with z.open(own) as raw:
                                header = [h.strip() for h in next(csv.reader(io.TextIOWrapper(raw, encoding="utf-8-sig", errors="replace", newline="")), [])]
                        out.append((archive, own, name, header))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in columns[:3]], pa.array(columns[3], pa.list_(pa.string()))], ["archive", "member", "name", "header"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(listed, "archive string, member string, name string, header array<string>")


def zip_table(spark: SparkSession, path: str, name: str, required: bool = False) -> DataFrame | None:
    """The table <name>.txt of zipped feeds with a column for each header name, all text; None, or an error if it is required, where no archive has it."""
    heads = zip_members(spark, path).where(F.col("name") == f"{name}.txt").select(F.posexplode("header").alias("at", "h")).where("h <> ''")
    columns = [r["h"] for r in heads.groupBy("h").agg(F.min("at").alias("at")).orderBy("at", "h").collect()]  # names of columns
    if not columns:
        if required:
            raise FileNotFoundError(f"{name}.txt")
        return None
    return zip_rows(spark, path, f"{name}.txt").select(*[F.col("cells")[c].alias(c) for c in columns])


def xz_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): the lines of xz files, decompressed as a stream."""
    import lzma

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held: list[str] = []
                with lzma.open(pa.BufferReader(content.as_buffer()), "rt", encoding="utf-8", errors="replace") as text:
                    for line in text:
                        held.append(line.rstrip("\r\n"))
                        if len(held) == ROWS:
                            yield pa.RecordBatch.from_arrays([pa.array([file] * ROWS), pa.array(held)], ["file", "value"])
                            held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(held)), pa.array(held)], ["file", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(lines, "file string, value string")


# --- one file ---------------------------------------------------------------------------------------------------------------------------------

def _shifted(crc: int, zeros: int) -> int:
    """The CRC of a text after so many zero bytes, by squaring the matrix that one zero bit applies."""
    def times(matrix: list[int], v: int) -> int:
        out, k = 0, 0
        while v:
            if v & 1:
                out ^= matrix[k]
            v >>= 1
            k += 1
        return out

    matrix = [0xEDB88320, *[1 << k for k in range(31)]]
    bits = 8 * zeros
    while bits:
        if bits & 1:
            crc = times(matrix, crc)
        matrix = [times(matrix, m) for m in matrix]
        bits >>= 1
    return crc


def joined_crc(first: int, second: int, second_size: int) -> int:
    """The CRC-32 of two texts, one after the other, from those of each."""
    return _shifted(first, second_size) ^ second


def compressed(lines: DataFrame) -> DataFrame:
    """(part, at, packed, size, crc) of a text column `value` in the order of its partitions: lines with an end each, deflated in chunks that may stand one after another."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, held, size = TaskContext.get().partitionId(), 0, [], 0

        def chunk() -> pa.RecordBatch:
            text = "".join(held).encode()
            deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
            packed = deflate.compress(text) + deflate.flush(zlib.Z_FULL_FLUSH)  # ends at a byte, with no end of the stream
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((part, pa.int32()), (at, pa.int32()), (packed, pa.binary()), (len(text), pa.int64()), (zlib.crc32(text), pa.int64()))], ["part", "at", "packed", "size", "crc"])

        for batch in batches:
            for value in batch.column(0).to_pylist():
                held.append(f"{value}\n")
                size += len(held[-1])
                if size >= CHUNK:
                    yield chunk()
                    at, held, size = at + 1, [], 0
        if held:
            yield chunk()

    return lines.select("value").mapInArrow(pack, "part int, at int, packed binary, size long, crc long")


class OneFile:
    """A file of Spark's file systems that appears under its name when all is written, and not at all after an error."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark._jvm
        self.target, self.hidden = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}._{uuid.uuid4().hex}")
        self.fs, self.at = self.target.getFileSystem(spark._jsc.hadoopConfiguration()), 0

    def __enter__(self) -> OneFile:
        self.out = self.fs.create(self.hidden, True)
        return self

    def write(self, data: bytes) -> int:
        self.out.write(bytearray(data))
        self.at += len(data)
        return len(data)

    def __exit__(self, kind, error, trace) -> None:
        self.out.close()
        if kind is None:
            self.fs.delete(self.target, False)
            self.fs.rename(self.hidden, self.target)
        else:
            self.fs.delete(self.hidden, False)


def _le(*numbers: tuple[int, int]) -> bytes:
    return b"".join(n.to_bytes(size, "little") for n, size in numbers)


def write_zip(spark: SparkSession, members: dict[str, DataFrame], path: str) -> dict[str, int]:
    """A zip archive of text members, each a DataFrame with a text column `value` in the order of its partitions; returns their bytes before compression.

    Tasks write and deflate the text and its checksums; the driver passes the deflated chunks on, one at a time, since one file has one writer. Members and archive may pass 4 GB.
    """
    sizes, entries = {}, []
    packed = {name: cut_lineage(compressed(df)) for name, df in members.items()}
    with OneFile(spark, path) as out:
        for name, chunks in packed.items():
            start, crc, size, own = out.at, 0, 0, name.encode()
            # sizes and checksum follow the data (flag 8), in eight bytes each because of the extra field
            out.write(b"PK\x03\x04" + _le((45, 2), (0x808, 2), (8, 2), (0, 2), (0x21, 2), (0, 4), (0xFFFFFFFF, 4), (0xFFFFFFFF, 4), (len(own), 2), (20, 2)) + own + _le((1, 2), (16, 2), (0, 8), (0, 8)))
            begin = out.at
            for r in chunks.orderBy("part", "at").toLocalIterator():
                out.write(bytes(r["packed"]))
                crc, size = joined_crc(crc, r["crc"], r["size"]), size + r["size"]
            out.write(b"\x03\x00")  # an empty last block ends the stream
            inside = out.at - begin
            out.write(b"PK\x07\x08" + _le((crc, 4), (inside, 8), (size, 8)))
            entries.append((own, start, crc, inside, size))
            sizes[name] = size
        directory = out.at
        for own, start, crc, inside, size in entries:
            extra = _le((1, 2), (24, 2), (size, 8), (inside, 8), (start, 8))
            out.write(b"PK\x01\x02" + _le((45, 2), (45, 2), (0x808, 2), (8, 2), (0, 2), (0x21, 2), (crc, 4), (0xFFFFFFFF, 4), (0xFFFFFFFF, 4), (len(own), 2), (len(extra), 2), (0, 2), (0, 2), (0, 2), (0, 4), (0xFFFFFFFF, 4)) + own + extra)
        length, end = out.at - directory, out.at
        out.write(b"PK\x06\x06" + _le((44, 8), (45, 2), (45, 2), (0, 4), (0, 4), (len(entries), 8), (len(entries), 8), (length, 8), (directory, 8)))
        out.write(b"PK\x06\x07" + _le((0, 4), (end, 8), (1, 4)))
        out.write(b"PK\x05\x06" + _le((0, 2), (0, 2), (0xFFFF, 2), (0xFFFF, 2), (0xFFFFFFFF, 4), (0xFFFFFFFF, 4), (0, 2)))
    return sizes


def write_text(spark: SparkSession, values: DataFrame, path: str, head: str = "", between: str = "\n", tail: str = "\n") -> None:
    """One text file of a text column `value` in the order of its partitions; the driver passes the rows on as a stream, so this is for documents that are one file by their nature."""
    with OneFile(spark, path) as out:
        out.write(head.encode())
        held, first = [], True
        for r in values.select("value").toLocalIterator():
            held.append(("" if first else between) + r["value"])
            first = False
            if len(held) == ROWS:
                out.write("".join(held).encode())
                held = []
        out.write(("".join(held) + tail).encode())


def csv_lines(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """(value): a CSV table as lines, the header first, in the order of columns; nulls are empty cells, a cell with a comma, quote or line end is quoted."""
    quote = lambda c: F.when(c.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    line = F.concat_ws(",", *[quote(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]).alias("value")
    header = df.sparkSession.range(1, numPartitions=1).select(F.lit(",".join(columns)).alias("value"))
    return header.unionByName(df.orderBy(*order).select(line))
