"""Encoding, fill-in-middle and conversation repair against brute force and the library they must equal."""

import hashlib
import random
import re
import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from wardlight.llm import fill_middle, piece_codec, queries, turn_repair
from wardlight.llm.fill_middle import Checkpoints
from wardlight.llm.turn_repair import Counts, composed, conversation_best, segment_best, walk

WHITE = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


@pytest.fixture(scope="module")
def strange(library):
    """Texts of pieces, of any code points, of runs, and long ones."""
    rnd, pieces = random.Random(9), [library.id_to_piece(i) for i in range(300, 32000)]
    texts = ["", " ", "  a", "a ", "\x00", "▁x", "a▁▁b", "<s></s><unk><0x41>", "�", "é\U0001d518 中文字", "\r\n\t", "x" * 3000, "ab" * 700, " " * 900, "the " * 5000]
    for _ in range(400):
        texts.append("".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 30))).replace("▁", rnd.choice([" ", "", "▁"])))
        texts.append("".join(rnd.choice("aeinst  \n") for _ in range(rnd.randint(0, 200))))
        texts.append("".join(chr(rnd.choice([rnd.randint(1, 0x24F), rnd.randint(0, 0xD7FF), rnd.randint(0x10000, 0x10FFFF)])) for _ in range(rnd.randint(0, 40))))
    return texts


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_ids_and_texts_are_the_librarys(library, strange):
    own = piece_codec.model(None)
    for texts in (strange, strange):  # again with all parts known
        ids = own.encode(texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in ids] == library.encode(texts, add_bos=True, add_eos=True)
        assert [own.decode(x) for x in ids] == [library.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
    assert own.encode(["a b"], begin=False, end=False) == [np.array(library.encode("a b"), "<u4").tobytes()]


def test_decoding_of_any_ids_is_the_librarys(library):
    rnd, own = random.Random(2), piece_codec.model(None)
    for _ in range(300):
        ids = [rnd.choice([rnd.randint(3, 258), rnd.randint(0, 31999)]) for _ in range(rnd.randint(0, 9))]
        if ids and own.bytes_of[ids[0]].startswith(b" ") or 0 in ids or 1 in ids or 2 in ids:
            continue
        assert own.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids)


def test_last_pieces_of_prefixes_are_unique(library):
    """Of the symbols that end at a place, exactly one goes with the last piece of what stands before it: pairs by merging, without the automaton."""
    rnd, own = random.Random(4), piece_codec.model(None)
    for _ in range(30):
        text = "".join(rnd.choice("aeinst") for _ in range(rnd.randint(1, 14)))
        last = [None]
        for j in range(1, len(text) + 1):
            ends = [text[i:j] for i in range(j) if text[i:j] in own.number]
            fits = [s for s in ends if last[j - len(s)] is None or own.merged(last[j - len(s)] + s)[0] == [last[j - len(s)], s]]
            assert len(fits) == 1
            last.append(fits[0])
        assert last[-1] == own.merged(text)[0][-1]


def test_pairs_are_told_as_by_merging():
    rnd, own = random.Random(6), piece_codec.model(None)
    x, y = (np.array([rnd.randrange(len(own.symbols)) for _ in range(4000)]) for _ in range(2))
    odd = np.flatnonzero(~own.orderly)
    x[: len(odd)], y[len(odd) : 2 * len(odd)] = odd, odd
    for _ in range(2):
        assert own.compatible(x, y).tolist() == [own.merged(own.symbols[a] + own.symbols[b])[0] == [own.symbols[a], own.symbols[b]] for a, b in zip(x, y, strict=True)]


def test_round_trip_of_tables(spark, library, strange):
    rows = [(i, t, "x", 1) for i, t in enumerate(strange[:60])] + [(None, "no id", "x", 1), (500, None, "x", 1), (501, "same", "x", 1), (501, "same", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens long")
    found = piece_codec.digests(piece_codec.round_trip(docs)).collect()
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids))))
    order = lambda r: (r[0] is None, r[0], r[2])
    assert sorted(map(tuple, found), key=order) == sorted(want, key=order)
    assert piece_codec.round_trip(docs.limit(0)).count() == 0


def test_checkpoints_cut_where_the_units_end(monkeypatch):
    monkeypatch.setattr(fill_middle, "BLOCK", 50)
    rnd = random.Random(1)
    for _ in range(40):
        text = "".join(rnd.choice(["word", "é", "中", " ", "\n", "7", "\U0001d518", "Zz"]) for _ in range(rnd.randint(0, 300)))
        units, data = re.findall(r"[A-Za-z]+|[^A-Za-z]", text), text.encode()
        index = Checkpoints.of(data)
        assert (index.n_units, index.n_points) == (len(units), len(text))
        assert index.units == list(range(0, len(units), fill_middle.STEP))
        for u in {0, len(units), *(rnd.randint(0, len(units)) for _ in range(20))}:
            head = "".join(units[:u])
            assert index.cut(data, u) == (len(head.encode()), len(head))


def test_fill_in_middle_against_a_plain_version(spark):
    rnd = random.Random(8)
    rows = [(i, "".join(rnd.choice(["ab", "c", "é", "\n", " ", "9", "<", ">", "P", "<M"]) for _ in range(rnd.randint(0, 90)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "a <S> b"), (None, "no id"), (1003, "same same"), (1003, "same same"), (1004, "long words " * 200_000), (1005, "x" * 3_000_000)]
    docs = spark.createDataFrame([(i, t, "f", "o") for i, t in rows], "doc_id long, text string, form string, output string")
    want = []
    for i, t in rows:
        t = t or ""
        h = [int(hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
        n = len(units)
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        if not t or re.search("<[PSM]>", t) or h[2] % 100 >= 90:
            want.append((i, n, "plain", None, None, sha(t), sha(t)))
        elif h[3] % 100 < 20:
            want.append((i, n, "spm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}"), sha(t)))
        else:
            want.append((i, n, "psm", len(p), len(m), sha(f"<P>{p}<S>{s}<M>{m}"), sha(t)))
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    order = lambda r: (r[0] is None, r[0], r[5])
    assert sorted(map(tuple, fill_middle.digests(fill_middle.transform(docs)).collect()), key=order) == sorted(want, key=order)
    assert fill_middle.transform(docs.limit(0)).count() == 0


def cheapest(rows):
    """Cost and audit by recursion from the end, over all edits."""
    @cache
    def rest(i, state, inserted):
        options = [(0, "")] if i == len(rows) and state in "-a" else []
        role = {"-": "u", "s": "u", "u": "a", "a": "u"}[state]
        if inserted < 2:
            cost, audit = rest(i, role, inserted + 1)
            options.append((cost + 2, "I" + audit))
        if i < len(rows):
            initial, flaw = rows[i]
            cost, audit = rest(i + 1, state, 0)
            options.append((cost + 3, "D" + audit))
            if flaw in (0, 3):
                cost, audit = rest(i + 1, role, 0)
                options.append((cost + 2 + (flaw == 3), "R" + audit))
                if initial == role or (initial == "s" and state == "-"):
                    cost, audit = rest(i + 1, initial, 0)
                    options.append((cost + (flaw == 3), "K" + audit))
        return min(options, default=(10**9, ""))
    for i in reversed(range(len(rows) + 1)):  # no deep recursion
        for state in "-sua":
            rest(i, state, 2)
    return rest(0, "-", 0)


def test_walks_find_the_cheapest_edits():
    rnd = random.Random(12)
    for _ in range(1500):
        rows = [(rnd.choice("suaauut"), rnd.choice([0, 0, 0, 1, 2, 3])) for _ in range(rnd.randint(0, 9))]
        want = cheapest(tuple(rows))
        assert conversation_best(rows) == want
        if rows:
            assert conversation_best(rows, block=rnd.randint(1, 3)) == want
            k = rnd.randint(0, len(rows))
            both = composed(segment_best(rows[:k], block=2), segment_best(rows[k:], block=3))
            assert min(composed(both, turn_repair.CLOSE)[e] for e in composed(both, turn_repair.CLOSE) if e[0] == 0) == want
    assert walk([], 0, closing=True) == {0: (0, "")}


def test_counts_of_runs_add_up():
    rnd = random.Random(3)
    for _ in range(200):
        turns = sorted((rnd.choice([None, 1, 2, 3, 5, 9]) for _ in range(rnd.randint(2, 9))), key=lambda t: (t is not None, t or 0))
        rows = [(rnd.choice("sua"), rnd.choice([0, 1, 2, 3])) for _ in turns]
        k = rnd.randint(1, len(rows) - 1)
        assert Counts.of(rows[:k], turns[:k]).then(Counts.of(rows[k:], turns[k:])) == Counts.of(rows, turns)


def plain_repair(table):
    """The contract of op13 on [(conv_id, turn, role, text)], row by row."""
    out, by_conv = [], {}
    for conv, turn, role, text in table:
        rows = by_conv.setdefault(conv, [])
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if draw:
            text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
            rows += [(turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    for conv, rows in by_conv.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, marked = set(), []
        for _, role, text in rows:
            flaw = 1 if not text.strip(WHITE) else 2 if (role, text) in seen else 0 if text.rstrip(WHITE)[-1] in ".!?" else 3
            seen.add((role, text))
            marked.append((role[:1], flaw))
        cost, audit = cheapest(tuple(marked))
        lines, state, i = [], "-", 0
        for edit in audit:
            role = "assistant" if state == "u" else "user"
            if edit == "I":
                lines.append(f"{role}:")
            elif edit == "D":
                i += 1
                continue
            else:
                role = rows[i][1] if edit == "K" else role
                lines.append(f"{role}:{rows[i][2]}")
                i += 1
            state = role[0]
        turns = [t for t, *_ in rows if t is not None]
        flaws = [f for _, f in marked]
        illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(marked, marked[1:], strict=False))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, flaws.count(1), flaws.count(2), flaws.count(3), illegal, cost, audit, sha("\n".join(lines))))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0))


def conversations(seed, hot=0):
    rnd = random.Random(seed)
    texts = ["Yes.", "No!", "well", "", " \n", "Is it so?", "a. b", None, "line one\nline two."]
    rows = []
    for c in [*range(60), None]:
        for t in range(rnd.randint(0, 9)):
            rows.append((c, rnd.choice([t, t, t, t + 3]), rnd.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]) if t else "system", rnd.choice([*texts, f"own {rnd.random()}."])))
        if rnd.random() < 0.3:
            rows.append((c, None, "user", "no turn."))
    rows += [(7, t, rnd.choice(["user", "assistant"]), rnd.choice(["again.", f"text {rnd.randint(0, 80)}."])) for t in range(100, 100 + hot)]
    return [r for r in rows if r[0] != 11] + [rows[5]] * 3


@pytest.mark.parametrize("hot", [0, 400])
def test_repair_against_a_plain_version(spark, hot):
    """One conversation holds most rows in the second case, so it lies in several partitions."""
    rows = conversations(4 + hot, hot)
    table = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, part long")
    ways = []
    for partitions in ("1", "7", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            ways.append(sorted(map(tuple, turn_repair.digests(table).collect()), key=lambda r: (r[0] is None, r[0] or 0)))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = plain_repair(rows)
    for found in ways:
        assert found == want


def test_repair_of_empty_tables_and_wholly_dropped_conversations(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    table = spark.createDataFrame([(dropped, 0, "user", "Hello.")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in turn_repair.digests(table).collect()] == [(dropped, 0, 0, 0, 0, 0, 0, "", sha(""))]
    assert turn_repair.digests(table.limit(0)).count() == 0


def test_queries_are_registered():
    assert {"op11_piece_round_trip", "op12_fill_in_middle", "op13_conversation_repair"} <= set(queries.QUERIES)
