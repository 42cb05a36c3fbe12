"""Fill-in-middle transformation with a sparse checkpoint index.

A text's units are runs of ASCII letters and single other characters. While they are counted, the byte and code-point offset of every STEP-th unit is recorded. A cut after some number of units is found by a
binary search of these checkpoints and a short scan from the one before it, so that no table of all units is held.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units between two checkpoints, bytes that are counted at once.
STEP, BLOCK = 64, 1 << 18
#: The marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A unit in UTF-8: a run of letters or the bytes of one other character.
UNIT = re.compile(rb"[A-Za-z]+|[^A-Za-z\x80-\xff]|[\xc0-\xff][\x80-\xbf]*")
IS_LETTER = np.array([chr(b).isascii() and chr(b).isalpha() for b in range(256)])


@dataclass
class Checkpoints:
    """Offsets of every STEP-th unit of a text, and its totals."""

    units: list[int] = field(default_factory=list)
    bytes_: list[int] = field(default_factory=list)
    points: list[int] = field(default_factory=list)
    n_units: int = 0
    n_points: int = 0

    @classmethod
    def of(cls, text: bytes) -> Checkpoints:
        out, letter_before = cls(), False
        for start in range(0, len(text), BLOCK):
            block = np.frombuffer(text, np.uint8, min(BLOCK, len(text) - start), start)
            point = (block & 0xC0) != 0x80
            letter = IS_LETTER[block]
            inside = letter & np.concatenate(([letter_before], letter[:-1]))
            begins = np.flatnonzero(point & ~inside)
            marks = begins[-out.n_units % STEP :: STEP]
            out.units += range(out.n_units + -out.n_units % STEP, out.n_units + len(begins), STEP)
            out.bytes_ += (start + marks).tolist()
            out.points += (out.n_points + np.searchsorted(np.flatnonzero(point), marks)).tolist()
            out.n_units += len(begins)
            out.n_points += int(point.sum())
            letter_before = bool(letter[-1])
        return out

    def cut(self, text: bytes, units: int) -> tuple[int, int]:
        """(byte, code point) offset after so many units."""
        if units >= self.n_units:
            return len(text), self.n_points
        k = bisect_right(self.units, units) - 1
        at, points = self.bytes_[k], self.points[k]
        for _ in range(units - self.units[k]):
            found = UNIT.match(text, at)
            points += found.end() - at if text[at] < 0x80 else 1
            at = found.end()
        return at, points


def draws(seed: int, id_col: str) -> list[Column]:
    """Four numbers of 32 bits of each row, from the digest of the seed and its id (a null id: no digits)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def transform(docs: DataFrame, seed: int = 1, plain_from: int = 90, suffix_first_below: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output), one row for each row of docs.

    Plain (the text itself) are empty and null texts, those that hold a mark already, and those drawn with h3 % 100 >= plain_from; of the others, those drawn with h4 % 100 < suffix_first_below put the suffix
    first (spm), the rest the prefix (psm). Cuts are counted in units. Whole texts of any length are read. Repeated rows are alike; a null id draws as if it had no digits; other columns are not read;
    an empty table gives no rows.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def rearranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, s, m = marks
        for batch in batches:
            rows = []
            for text, h1, h2, h3, h4 in zip(*(batch.column(i).to_pylist() for i in range(1, 6)), strict=True):
                text = text or b""
                index = Checkpoints.of(text)
                n = index.n_units
                if not text or any(x in text for x in marks) or h3 % 100 >= plain_from:
                    rows.append((n, "plain", None, None, text))
                    continue
                (a, before), (b, upto) = (index.cut(text, u) for u in sorted((h1 % (n + 1), h2 % (n + 1))))
                if h4 % 100 < suffix_first_below:
                    rows.append((n, "spm", before, upto - before, b"".join((s, text[b:], p, text[:a], m, text[a:b]))))
                else:
                    rows.append((n, "psm", before, upto - before, b"".join((p, text[:a], s, text[b:], m, text[a:b]))))
            n, form, before, middle, output = (list(c) for c in zip(*rows, strict=True)) if rows else ([],) * 5
            arrays = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    given = docs.select(id_col, F.col(text_col).cast("binary").alias("_text"), *draws(seed, id_col))
    return given.mapInArrow(rearranged, f"doc_id {id_type}, n long, form string, prefix_chars long, middle_chars long, output binary").withColumn("output", F.col("output").cast("string"))


def restored(output: str | Column = "output", form: str | Column = "form") -> Column:
    """The text that an output of this form was made from: it held no mark, and marks can't overlap, so each mark's first place is its own."""
    output = F.col(output) if isinstance(output, str) else output
    form = F.col(form) if isinstance(form, str) else form

    def between(after: str, upto: str) -> Column:
        return F.split_part(F.split_part(output, F.lit(after), F.lit(2)), F.lit(upto), F.lit(1))

    middle = F.split_part(output, F.lit(MIDDLE), F.lit(2))
    return (
        F.when(form == "psm", F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE)))
        .when(form == "spm", F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX)))
        .otherwise(output)
    )


def digests(made: DataFrame) -> DataFrame:
    """transform's rows with the SHA-256 of the output and of the text rebuilt from it."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored()).alias("restored_sha256"))
