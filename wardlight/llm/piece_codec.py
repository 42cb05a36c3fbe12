"""SentencePiece BPE encoding and decoding by a merge-type prefix table.

Merging the best-scored pair first, leftmost of equals, never looks across a boundary that no merge crosses. A sequence of pieces is thus the encoding of its text if and only if each two neighbours encode to
themselves, and every prefix of a text has one last piece: of the pieces that end there (found by an automaton over all pieces), the one that is compatible with the last piece of what stands before it. The
table of these last pieces is filled left to right; the ids are read from it backwards.

A text is first cut between any two characters that no piece holds side by side, which is exact and mostly gives words. Short parts are filled side by side in numpy, one step a character; long ones in a loop.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Characters of the longest part that is filled side by side with others, parts kept with their ids by a worker, characters of texts taken together.
SIDE_BY_SIDE, KEPT_PARTS, TOGETHER = 48, 200_000, 1_000_000
NEVER = np.int32(1 << 30)

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))
_MODELS: dict[str | None, PieceModel] = {}


class PieceModel:
    """A BPE model file of the sentencepiece library (None: the public one): its pieces, their merges, automaton and compatibility test.

    The model must leave the text as it is (identity normaliser, white space kept), and put a space before it; anything else is refused.
    """

    def __init__(self, file: str | None = None):
        import public_tokenizers
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=file or public_tokenizers.path("piece_bpe_32k.model"))
        if sp.normalize(" Ａ  é ") != f"{SPACE}{SPACE}Ａ{SPACE}{SPACE}é{SPACE}":
            raise ValueError("the model changes texts before it encodes them")
        ids = range(sp.get_piece_size())
        if any(sp.is_unused(i) for i in ids):
            raise ValueError("the model has unused pieces")
        self.begin, self.end, self.unknown = sp.bos_id(), sp.eos_id(), sp.unk_id()
        byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in ids if sp.is_byte(i)}
        special = {i for i in ids if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)}
        self.id_of = {sp.id_to_piece(i): i for i in ids if i not in special}
        score = {p: sp.get_score(i) for p, i in self.id_of.items()}
        place = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank_of = {p: place[s] for p, s in score.items()}
        self.bytes_of = [b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in ids]
        for b, i in byte.items():
            self.bytes_of[i] = bytes([b])
        self.byte_ids = [byte.get(b, self.unknown) for b in range(256)]
        self._number_symbols()
        self._build_automaton()
        self._seen_key = np.full(1 << 18, -1, np.int64)
        self._seen_ok = np.zeros(1 << 18, bool)
        self.kept: dict[str, bytes] = {}

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The pieces of a short text by merging itself, and the last merge's two sides."""
        parts, last = list(text), None
        while True:
            best = min(((r, i) for i in range(len(parts) - 1) if (r := self.rank_of.get(parts[i] + parts[i + 1])) is not None), default=None)
            if best is None:
                return parts, last
            i = best[1]
            last = parts[i], parts[i + 1]
            parts[i : i + 2] = ["".join(last)]

    def _number_symbols(self) -> None:
        """Symbols are the pieces that merging can make, and all characters of longer pieces; rank is that of the merge that makes a symbol, -1 of a character."""
        letters = sorted({c for p in self.id_of if len(p) > 1 for c in p})
        sides = {p: last for p in self.id_of if len(p) > 1 for parts, last in [self.merged(p)] if len(parts) == 1}
        self.symbols = letters + list(sides)
        number = self.number = {s: k for k, s in enumerate(self.symbols)}
        if len(number) >= 1 << 16:
            raise ValueError("too many pieces")
        self.length = np.array([len(s) for s in self.symbols], np.int64)
        self.rank = np.array([-1] * len(letters) + [self.rank_of[s] for s in sides], np.int32)
        self.left = np.array([0] * len(letters) + [number[a] for a, _ in sides.values()], np.int64)
        self.right = np.array([0] * len(letters) + [number[b] for _, b in sides.values()], np.int64)
        # merges inside a symbol run in the order of ranks, so that the undoing below is right; symbols for which that fails are merged instead
        orderly = np.ones(len(self.symbols), bool)
        for s in sorted(sides, key=len):
            k = number[s]
            a, b = self.left[k], self.right[k]
            orderly[k] = orderly[a] and orderly[b] and max(self.rank[a], self.rank[b]) < self.rank[k]
        self.orderly = orderly
        pairs = sorted((number[s[:k]] << 16 | number[s[k:]], self.rank_of[s]) for s in self.id_of for k in range(1, len(s)) if s[:k] in number and s[k:] in number)
        self.pair_key = np.array([k for k, _ in pairs] or [-1], np.int64)
        self.pair_rank = np.array([r for _, r in pairs] or [NEVER], np.int32)
        self.ids = [np.array([self.id_of[s]] if s in self.id_of else [self.byte_ids[b] for b in s.encode()], "<u4") for s in self.symbols]
        self.plain = np.array([x[0] if len(x) == 1 else 0 for x in self.ids], "<u4")
        self.one_id = all(len(x) == 1 for x in self.ids)
        self.letter = np.zeros(0x110000, np.uint16)  # of a code point: 1 + its place among the letters, 0 for any other
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.beside = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for p in self.id_of:
            for a, b in zip(p, p[1:], strict=False):
                self.beside[self.letter[ord(a)], self.letter[ord(b)]] = True

    def _build_automaton(self) -> None:
        """move[state, letter]; longest[state]: the longest symbol that ends there; shorter[symbol]: the next one that ends with it."""
        wide, child, prefix = len(self.beside), {"": 0}, [""]
        for s in sorted(self.symbols, key=len):
            for k in range(1, len(s) + 1):
                if s[:k] not in child:
                    child[s[:k]] = len(prefix)
                    prefix.append(s[:k])
        by_depth: dict[int, list[int]] = {}
        for state, p in enumerate(prefix):
            by_depth.setdefault(len(p), []).append(state)
        parent = np.array([child[p[:-1]] for p in prefix])
        through = np.array([0] + [self.letter[ord(p[-1])] for p in prefix[1:]])
        own = np.array([self.number.get(p, -1) for p in prefix])
        move = np.zeros((len(prefix), wide), np.uint16 if len(prefix) < 1 << 16 else np.uint32)
        back, longest, shorter = np.zeros(len(prefix), np.int64), np.full(len(prefix), -1), np.full(len(self.symbols), -1)
        for depth in sorted(by_depth):
            states = np.array(by_depth[depth])
            if depth:
                move[states] = move[back[states]]
                longest[states] = np.where(own[states] >= 0, own[states], longest[back[states]])
                named = states[own[states] >= 0]
                shorter[own[named]] = longest[back[named]]
            below = np.array(by_depth.get(depth + 1, []), np.int64)
            back[below] = move[back[parent[below]], through[below]] if depth else 0
            move[parent[below], through[below]] = below
        self.move, self.longest, self.shorter = move, longest, shorter

    def compatible(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether symbols x, y side by side stay two."""
        key = x << 16 | y
        slot = (key * 0x9E3779B1 >> 13) & (len(self._seen_key) - 1)
        new = self._seen_key[slot] != key
        if not new.any():
            return self._seen_ok[slot]
        out = self._seen_ok[slot]
        asked, where = np.unique(key[new], return_inverse=True)
        ok = self._undone(asked >> 16, asked & 0xFFFF)
        out[new] = ok[where]
        at = (asked * 0x9E3779B1 >> 13) & (len(self._seen_key) - 1)
        self._seen_key[at], self._seen_ok[at] = asked, ok
        return out

    def _undone(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Undo both symbols' merges, the latest first; at no time may the two at the boundary have had a better merge than the one that took either of them."""
        ok = np.ones(len(x), bool)
        for k in np.flatnonzero(~(self.orderly[x] & self.orderly[y])):
            ok[k] = self.merged(self.symbols[x[k]] + self.symbols[y[k]])[0] == [self.symbols[x[k]], self.symbols[y[k]]]
        live = np.flatnonzero(self.orderly[x] & self.orderly[y])
        x, y = x[live], y[live]
        next_x, next_y = np.full(len(x), NEVER), np.full(len(x), NEVER)
        while len(live):
            key = x << 16 | y
            at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            rank = np.where(self.pair_key[at] == key, self.pair_rank[at], NEVER)
            crossed = (rank < next_x) & (rank <= next_y) & (rank < NEVER)  # of equal ranks the leftmost comes first
            ok[live[crossed]] = False
            rx, ry = self.rank[x], self.rank[y]
            on = ~crossed & (np.maximum(rx, ry) >= 0)
            live, x, y, rx, ry, next_x, next_y = live[on], x[on], y[on], rx[on], ry[on], next_x[on], next_y[on]
            of_x = rx > ry
            next_x, next_y = np.where(of_x, rx, next_x), np.where(of_x, next_y, ry)
            x, y = np.where(of_x, self.right[x], x), np.where(of_x, y, self.left[y])
        return ok

    def parts(self, text: str) -> list[str]:
        """The text with its spaces marked, cut where no piece can reach across."""
        marked = SPACE + text.replace(" ", SPACE)
        letters = self.letter[np.frombuffer(marked.encode("utf-32-le"), "<u4")]
        cuts = np.flatnonzero(~self.beside[letters[:-1], letters[1:]]) + 1
        ends = cuts.tolist()
        return [marked[a:b] for a, b in zip([0, *ends], [*ends, len(marked)], strict=True)]

    def _fill_side_by_side(self, words: list[str]) -> None:
        """The prefix tables of short parts, a step a character, and their ids into kept."""
        words = sorted(words, key=len, reverse=True)
        sizes = np.array([len(w) for w in words])
        steps, n = int(sizes[0]), len(words)
        letters = np.zeros((steps, n), np.int64)
        flat = self.letter[np.frombuffer("".join(words).encode("utf-32-le"), "<u4")]
        column = np.repeat(np.arange(n), sizes)
        letters[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), column] = flat
        last = np.full((steps + 1, n), -1, np.int64)  # row j: of the prefixes of j characters
        state = np.zeros(n, np.int64)
        for j in range(steps):
            m = int(np.searchsorted(-sizes, -j, "left"))  # parts longer than j
            state[:m] = self.move[state[:m], letters[j, :m]]
            symbol = self.longest[state[:m]]
            open_ = np.arange(m)
            while len(open_):
                tried = symbol[open_]
                before = last[j + 1 - self.length[tried], open_]
                good = before < 0
                inner = np.flatnonzero(~good)
                good[inner] = self.compatible(before[inner], tried[inner])
                open_ = open_[~good]
                symbol[open_] = self.shorter[symbol[open_]]
            last[j + 1, :m] = symbol
        at, found = sizes.copy(), []
        while True:  # backwards, each part from its end
            on = at > 0
            if not on.any():
                break
            symbol = last[at, np.arange(n)]
            found.append(np.where(on, symbol, -1))
            at = np.where(on, at - self.length[symbol], 0)
        table = np.array(found[::-1]).T  # a row a part, its symbols at the end of the row
        counts = (table >= 0).sum(axis=1).tolist()
        if self.one_id:
            ids = np.where(table >= 0, self.plain[table], 0).astype("<u4")
            self.kept.update((w, row[len(row) - c :].tobytes()) for w, row, c in zip(words, ids, counts, strict=True))
        else:
            self.kept.update((w, b"".join(self.ids[s].tobytes() for s in row[len(row) - c :])) for w, row, c in zip(words, table.tolist(), counts, strict=True))

    def _fill_alone(self, part: str) -> bytes:
        """The ids of one long part."""
        letters = self.letter[np.frombuffer(part.encode("utf-32-le"), "<u4")].tolist()
        move, longest, shorter, length = self.move, self.longest.tolist(), self.shorter.tolist(), self.length.tolist()
        last, state, known = [-1], 0, {}
        for j, c in enumerate(letters, 1):
            state = int(move[state, c])
            symbol = longest[state]
            while True:
                before = last[j - length[symbol]]
                if before < 0:
                    break
                pair = before << 16 | symbol
                if pair not in known:
                    known[pair] = bool(self.compatible(np.array([before]), np.array([symbol]))[0])
                if known[pair]:
                    break
                symbol = shorter[symbol]
            last.append(symbol)
        out, j = [], len(letters)
        while j:
            out.append(last[j])
            j -= length[last[j]]
        return b"".join(self.ids[s].tobytes() for s in reversed(out))

    def encode(self, texts: list[str], begin: bool = True, end: bool = True) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit numbers."""
        cut = [self.parts(t) if t else [] for t in texts]
        new = {p for parts in cut for p in parts}.difference(self.kept)
        short, long_ = [], {}
        for p in new:
            if len(p) == 1 and not self.letter[ord(p)]:
                self.kept[p] = np.array([self.id_of[p]] if p in self.id_of else [self.byte_ids[b] for b in p.encode()], "<u4").tobytes()
            elif len(p) <= SIDE_BY_SIDE:
                short.append(p)
            else:
                long_[p] = self._fill_alone(p)
        if short:
            self._fill_side_by_side(short)
        first = np.array([self.begin] if begin else [], "<u4").tobytes()
        final = np.array([self.end] if end else [], "<u4").tobytes()
        ids_of = self.kept.__getitem__ if not long_ else lambda p: long_[p] if p in long_ else self.kept[p]
        out = [first + b"".join(map(ids_of, parts)) + final for parts in cut]
        if len(self.kept) > KEPT_PARTS:
            self.kept.clear()
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids: control ids are skipped, byte pieces join to characters (a byte that fits none is U+FFFD), the space that encoding puts in front goes."""
        text = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "each_byte")
        return text[1:] if text.startswith(" ") else text


def model(file: str | None) -> PieceModel:
    if file not in _MODELS:
        _MODELS[file] = PieceModel(file)
    return _MODELS[file]


def _together(texts: list[str]) -> Iterator[slice]:
    """Runs of texts of about TOGETHER characters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= TOGETHER:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def round_trip(docs: DataFrame, file: str | None = None, begin: bool = True, end: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) for every row of docs: ids as little-endian unsigned 32-bit numbers, and the text that they decode to.

    A null text counts as empty; an empty text has the begin and end ids alone. Whole texts of any length are read, one task holds a batch of them. Repeated rows and null ids are rows of their own; other columns
    are not read; an empty table gives no rows. file: a model of the sentencepiece library at the same path on every machine; None: the public one.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(file)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for run in _together(texts):
                ids = own.encode(texts[run], begin, end)
                counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                decoded = pa.array([own.decode(x) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(run.start, len(ids)), counts, pa.array(ids, pa.binary()), decoded], ["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select(id_col, text_col).mapInArrow(coded, f"doc_id {id_type}, n_tokens long, ids binary, decoded string")


def digests(coded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of round_trip's rows."""
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
