"""Conversation structure repair: the cheapest edits after which a conversation's role initials fit `(s?(ua)+)?`.

The edits form a lattice of nodes (rows done, grammar state): keep a row (K, 0), give it the role that the grammar wants (R, 2), delete it (D, 3; blank and repeated rows must be), insert an empty turn (I, 2); a
truncated row that stays costs 1 more. Dijkstra walks it by the key (cost, audit), the audit being the edits' initials, and stops at the first accepting end node that it takes.

Rows are dealt and sorted by ranges of (conversation, turn), so one conversation may lie in several partitions. Those that begin and end inside one are repaired there, in one pass. The first and the last of a
partition are written and repaired in segments: a segment's best edits from each state to each state (in blocks, so that an audit is copied once a block), their composition in order, then each
segment's text. Inserts belong to the row after them, so two audits of one segment never are prefixes of each other and the least of the parts is the least of the whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import hot_join, materialize

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
#: The costs of the edits and of a truncated row that stays; the pairs of neighbours that are legal.
COSTS, TRUNCATED_COST, LEGAL = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}, 1, {"su", "ua", "au"}
#: States: nothing yet, after system, after user, after assistant. The role that each wants next, what follows on a role, where a conversation may end.
START, SYSTEM, USER, ASSISTANT = range(4)
WANTED = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ACCEPTING = (START, ASSISTANT)
#: Faults of a row.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
WHITE = " \t\n\x0b\x0c\r"
#: Rows that one walk covers; a longer conversation is composed of blocks.
BLOCK = 256

Row = tuple[str, int]  # the role's initial and the fault
Best = dict[tuple[int, int], tuple[int, str]]  # from state, to state: cost and audit


def fault(text: str, seen: bool) -> int:
    """The first fault of a row: no character but white space, role and text seen before, last such character not an end of a sentence."""
    stripped = text.rstrip(WHITE)
    return BLANK if not stripped else DUPLICATE if seen else SOUND if stripped[-1] in ".!?" else TRUNCATED


def walk(rows: list[Row], entry: int, closing: bool) -> dict[int, tuple[int, str]]:
    """Dijkstra from (0, entry): cost and audit by the state reached after all rows. closing: turns may be inserted at the end, and the first accepting end node stops the walk."""
    heap, done, out = [(0, "", 0, entry)], set(), {}
    n = len(rows)
    while heap:
        cost, audit, i, state = heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n:
            if closing and state in ACCEPTING:
                return {state: (cost, audit)}
            if not closing:
                out[state] = (cost, audit)
                continue
        follows = NEXT[state, WANTED[state][0]]
        heappush(heap, (cost + COSTS[INSERT], audit + INSERT, i, follows))
        if i == n:
            continue
        initial, flaw = rows[i]
        heappush(heap, (cost + COSTS[DELETE], audit + DELETE, i + 1, state))
        if flaw in (SOUND, TRUNCATED):
            more = cost + (TRUNCATED_COST if flaw == TRUNCATED else 0)
            heappush(heap, (more + COSTS[REROLE], audit + REROLE, i + 1, follows))
            if (state, initial) in NEXT:
                heappush(heap, (more + COSTS[KEEP], audit + KEEP, i + 1, NEXT[state, initial]))
    return out


def composed(first: Best, second: Best) -> Best:
    """The best edits of two runs of rows, one after the other."""
    out: Best = {}
    for (a, b), (cost, audit) in first.items():
        for c in range(4):
            if (b, c) in second:
                more, tail = second[b, c]
                if (a, c) not in out or cost + more < out[a, c][0] or (cost + more == out[a, c][0] and audit + tail < out[a, c][1]):
                    out[a, c] = (cost + more, audit + tail)
    return out


def segment_best(rows: list[Row], entries: tuple[int, ...] = (START, SYSTEM, USER, ASSISTANT), block: int = BLOCK) -> Best:
    """From each entry state to each state after the rows."""
    best: Best = {(e, e): (0, "") for e in entries}
    for i in range(0, len(rows), block):
        best = composed(best, {(e, x): found for e in range(4) for x, found in walk(rows[i : i + block], e, closing=False).items()})
    return best


#: What may follow the last row of a conversation in each state.
CLOSE: Best = {(s, end): found for s in range(4) for end, found in walk([], s, closing=True).items()}


def conversation_best(rows: list[Row], block: int = BLOCK) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    if len(rows) <= block:
        return next(iter(walk(rows, START, closing=True).values()))
    return min(composed(segment_best(rows, (START,), block), CLOSE).values())


def edited(audit: str, roles: list[str], texts: list[str], state: int = START) -> str:
    """The repaired lines `role:text` of rows under an audit."""
    lines, i = [], 0
    for edit in audit:
        wanted = WANTED[state]
        if edit == INSERT:
            lines.append(f"{wanted}:")
            state = NEXT[state, wanted[0]]
            continue
        if edit != DELETE:
            role = roles[i] if edit == KEEP else wanted
            lines.append(f"{role}:{texts[i]}")
            state = NEXT[state, role[0]]
        i += 1
    return "\n".join(lines)


class Counts(NamedTuple):
    """What a run of rows adds to the figures of its conversation."""

    low: int | None
    high: int | None
    distinct: int
    first_turn: int | None
    last_turn: int | None
    blank: int
    duplicate: int
    truncated: int
    illegal: int
    first: str
    last: str

    @classmethod
    def of(cls, rows: list[Row], turns: list[int | None]) -> Counts:
        known = [t for t in turns if t is not None]
        faults = [f for _, f in rows]
        illegal = sum(a + b not in LEGAL for (a, _), (b, _) in zip(rows, rows[1:], strict=False))
        return cls(
            min(known, default=None), max(known, default=None), len(set(known)), turns[0], turns[-1], faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal, rows[0][0], rows[-1][0]
        )

    def then(self, after: Counts) -> Counts:
        """Both, for rows in order of turn."""
        known = lambda f, a, b: f(x for x in (a, b) if x is not None) if a is not None or b is not None else None
        shared = self.last_turn is not None and self.last_turn == after.first_turn
        return Counts(
            known(min, self.low, after.low), known(max, self.high, after.high), self.distinct + after.distinct - shared, self.first_turn, after.last_turn, self.blank + after.blank,
            self.duplicate + after.duplicate, self.truncated + after.truncated, self.illegal + after.illegal + (self.last + after.first not in LEGAL), self.first, after.last,
        )

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.distinct


FIGURES = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _figures(counts: Counts, best: tuple[int, str]) -> tuple:
    return counts.gaps, counts.blank, counts.duplicate, counts.truncated, counts.illegal, *best


def _repair_inside(rows: DataFrame, block: int) -> DataFrame:
    """From rows in order: a row with its text for each conversation that begins and ends inside a partition (pos is null), and the rows of the others."""
    id_type = rows.schema["conv_id"].dataType.simpleString()

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, current, begun, held, pos, schema = context.partitionId() if context else 0, None, 0, [], 0, None

        def finished() -> tuple:
            seen, rows_ = set(), []
            for _, role, text in held:
                rows_.append((role[:1], fault(text, (role, text) in seen)))
                seen.add((role, text))
            best = conversation_best(rows_, block)
            counts = Counts.of(rows_, [t for t, _, _ in held])
            repaired = edited(best[1], [r for _, r, _ in held], [t for _, _, t in held])
            return (current, part, None, None, None, repaired, *_figures(counts, best))

        for batch in batches:
            if schema is None:
                kinds = [("conv_id", batch.schema.field("conv_id").type), ("part", pa.int32()), ("pos", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]
                schema = pa.schema([*kinds, *[(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string())])
            out = []
            for conv, turn, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text")), strict=True):
                if conv != current or not begun:
                    if held:
                        out.append(finished())
                    current, held, pos, begun = conv, [], 0, begun + 1
                if begun == 1:
                    out.append((conv, part, pos, turn, role, text, *[None] * 7))
                else:
                    held.append((turn, role, text))
                pos += 1
            if out:
                yield _columns(out, schema)
        if held:
            yield _columns([(current, part, i, *row, *[None] * 7) for i, row in enumerate(held)], schema)

    return rows.select("conv_id", "turn", "role", "text").mapInArrow(passed, f"conv_id {id_type}, part int, pos long, turn long, role string, text string, {FIGURES}")


def _open_segments(rows: DataFrame) -> DataFrame:
    """The open rows with their initial and fault; a row is a repeat if its role and text stand in an earlier row of its conversation, in whatever segment."""
    keyed = rows.withColumn("_same", F.sha2(F.to_json(F.struct("conv_id", "role", "text")).cast("binary"), 256))
    place = F.struct("part", "pos")
    firsts = keyed.groupBy("_same").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    marked = hot_join(keyed, materialize(firsts.drop("_n")), "_same", "left")
    text = F.regexp_replace("text", r"[\x20\x09-\x0D]+$", "")
    flaw = F.when(text == "", BLANK).when(F.coalesce(F.col("_first") < place, F.lit(False)), DUPLICATE).when(F.substring(text, -1, 1).isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)
    return marked.select("conv_id", "part", "pos", "turn", "role", "text", flaw.cast("int").alias("flaw"))


def _segment_summaries(rows: DataFrame, block: int) -> DataFrame:
    """A row for each segment and each way through it: from state, to state, cost and audit, with the segment's counts."""
    id_type = rows.schema["conv_id"].dataType.simpleString()
    counts = "low long, high long, distinct long, first_turn long, last_turn long, blank long, duplicate long, truncated long, illegal long, first string, last string"

    def summed(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        initials = table["initial"].to_pylist()
        rows_ = list(zip(initials, table["flaw"].to_pylist(), strict=True))
        own = Counts.of(rows_, table["turn"].to_pylist())
        ways = [(a, b, cost, audit) for (a, b), (cost, audit) in segment_best(rows_, block=block).items()]
        columns = list(zip(*[(*way, *own) for way in ways], strict=True))
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.string(), *[pa.int64()] * 9, pa.string(), pa.string()]
        names = ["entry", "exit", "cost", "audit", *Counts._fields]
        keys = [table[k].slice(0, 1).combine_chunks().take(pa.array([0] * len(ways))) for k in ("conv_id", "part")]
        return pa.Table.from_arrays([*keys, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["conv_id", "part", *names])

    slim = rows.select("conv_id", "part", "pos", "turn", F.substring("role", 1, 1).alias("initial"), "flaw")
    return slim.groupBy("conv_id", "part").applyInArrow(summed, f"conv_id {id_type}, part int, entry int, exit int, cost long, audit string, {counts}")


def _composed_segments(summaries: DataFrame) -> DataFrame:
    """A row for each open conversation with its figures (part is null), and one for each segment with its entry state and audit. A conversation has at most one segment in a partition."""
    id_type = summaries.schema["conv_id"].dataType.simpleString()

    def put_together(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        conv = table["conv_id"][0].as_py()
        segments: dict[int, tuple[Best, Counts]] = {}
        for r in table.to_pylist():
            segments.setdefault(r["part"], ({}, Counts(*[r[n] for n in Counts._fields])))[0][r["entry"], r["exit"]] = (r["cost"], r["audit"])
        best: Best = {(START, START): (0, "")}
        steps, counts = [], None
        for ways, own in segments.values():
            steps.append(best)
            best = composed(best, ways)
            counts = own if counts is None else counts.then(own)
        cost, audit = min(composed(best, CLOSE).values())
        out = [(conv, None, None, audit, *_figures(counts, (cost, ""))[:-1])]
        at, state = 0, START
        for k, (part, (ways, own)) in enumerate(segments.items()):
            # the way whose audit stands next in the whole: it has as many rows as the segment, so only one fits
            exit_, piece = next((b, found) for (a, b), (_, found) in ways.items() if a == state and audit.startswith(found, at))
            if k == len(segments) - 1:
                piece = audit[at:]
            out.append((conv, part, state, piece, *[None] * 6))
            at, state = at + len(piece), exit_
        names = ["conv_id", "part", "entry", "audit", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
        kinds = [table.schema.field("conv_id").type, pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 6]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return summaries.groupBy("conv_id").applyInArrow(put_together, f"conv_id {id_type}, part int, entry int, audit string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long")


def _segment_texts(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """(conv_id, part, text): each open segment's repaired lines."""
    id_type = rows.schema["conv_id"].dataType.simpleString()

    def written(own: pa.Table, way: pa.Table) -> pa.Table:
        own = own.sort_by("pos")
        text = edited(way["audit"][0].as_py(), own["role"].to_pylist(), own["text"].to_pylist(), way["entry"][0].as_py())
        return pa.table([own["conv_id"].slice(0, 1), own["part"].slice(0, 1), pa.array([text], pa.string())], names=["conv_id", "part", "text"])

    ways = chosen.where("part is not null").select("conv_id", "part", "entry", "audit")
    return rows.groupBy("conv_id", "part").cogroup(ways.groupBy("conv_id", "part")).applyInArrow(written, f"conv_id {id_type}, part int, text string")


def repair(turns: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(figures, parts) of (conv_id, turn, role, text) rows.

    figures: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, one row for each conversation. parts: conv_id, part, text: the repaired lines `role:text`, of most conversations in one part; the
    parts of a conversation join by newlines, empty ones left out.
    Rows stand by turn, nulls first, rows of one turn by role, by the first 64 characters and by a hash of the text; identical rows by their place in the input. A null role or text is one space; null
    conv_ids are one conversation; a role of another initial than s, u and a, or of none, can't be kept. Other columns are not read; an empty table gives no rows. A frequent conversation is dealt to
    several partitions by its turns; repeats are found by a hash of role and text.
    """
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.monotonically_increasing_id().alias("_tie"))
    rows = rows.withColumn("_head", F.substring("text", 1, 64)).withColumn("_hash", F.xxhash64("text"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "_head", "_hash", "_tie"]
    passed = materialize(_repair_inside(rows.repartitionByRange(*order).sortWithinPartitions(*order), block))
    whole = passed.where("pos is null")
    rows = materialize(_open_segments(passed.where("pos is not null").select("conv_id", "part", "pos", "turn", "role", "text")))
    chosen = materialize(_composed_segments(_segment_summaries(rows, block)))
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    figures = whole.select(names).unionByName(chosen.where("part is null").select(names))
    parts = whole.select("conv_id", "part", "text").unionByName(_segment_texts(rows, chosen))
    return figures, parts


def text_digests(parts: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of repair's parts. The digest of one text needs its bytes in order: a conversation's parts pass one task in turn, a part at a time."""
    import hashlib

    id_type = parts.schema["conv_id"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest, empty = None, None, True
        for batch in batches:
            ids, sums = [], []
            for conv, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if digest is None or conv != current:
                    if digest is not None:
                        ids.append(current)
                        sums.append(digest.hexdigest())
                    current, digest, empty = conv, hashlib.sha256(), True
                if text:
                    digest.update(text.encode() if empty else b"\n" + text.encode())
                    empty = False
            kind = batch.schema.field(0).type
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(sums, pa.string())], ["conv_id", "repaired_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], kind), pa.array([digest.hexdigest()], pa.string())], ["conv_id", "repaired_sha256"])

    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(hashed, f"conv_id {id_type}, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """The rows after the damage that crc32(`conv_id:turn`) % 20 deals: 0 drops a row, 1 empties its text, 2 takes out `.!?`, 3 repeats it, 4 makes it the user's. Nulls are one space."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    text = F.when(F.col("_draw") == 1, F.lit("")).when(F.col("_draw") == 2, F.regexp_replace(text_of("text"), "[.!?]", "")).otherwise(text_of("text"))
    role = F.when(F.col("_draw") == 4, F.lit("user")).otherwise(text_of("role"))
    rows = turns.withColumn("_draw", draw).where("_draw <> 0")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("_draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation of turns, damaged and repaired."""
    figures, parts = repair(damaged(turns))
    whole = figures.alias("f").join(text_digests(parts).alias("t"), F.col("f.conv_id").eqNullSafe(F.col("t.conv_id"))).select("f.*", "repaired_sha256")
    every = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_rows"))
    joined = every.alias("e").join(whole.alias("w"), F.col("e.conv_id").eqNullSafe(F.col("w.conv_id")), "left")
    longs = [F.coalesce(F.col(f"w.{n}"), F.lit(0)).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing: Column = F.sha2(F.lit("").cast("binary"), 256)
    return joined.select("e.conv_id", *longs, F.coalesce("w.audit", F.lit("")).alias("audit"), F.coalesce("w.repaired_sha256", nothing).alias("repaired_sha256"))
