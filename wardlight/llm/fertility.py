"""Quality rules by tokeniser fertility.

Two public vocabularies measure every text: a byte-level BPE gives characters per token and the entropy of the text's tokens, a BPE with byte fallback gives the
share of tokens that are bare bytes. Both read the text whole, its blanks and line ends included. A text outside the wide fixed limits of its main script is rejected, and so is one whose characters per token
lie outside the band of its language: the language's median over all documents, give or take so many robust deviations, wider for short texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import batch_rows, binned_quantiles, materialize, scratch, slices, small
from wardlight.llm.vocab import BytePairs

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
#: White space to str.split() that isn't a word break here.
OTHER_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0  -     　]")
SYMBOLS = re.compile(r"[#*$%&|<>]")
#: Word windows that must not repeat.
WINDOW = 8

#: Fixed values. Outer limits per script: characters per token (lowest, highest), highest share of byte tokens, lowest entropy in bits per token of a text
#: of at least ENTROPY_TOKENS tokens. Scripts are ranges of code points by their first letter's Unicode block.
LIMITS = {
    "latin": (1.2, 9.0, 0.10, 3.5),
    "greek": (0.7, 6.0, 0.40, 3.0),
    "cyrillic": (0.7, 6.0, 0.40, 3.0),
    "arabic": (0.6, 6.0, 0.50, 3.0),
    "indic": (0.3, 6.0, 0.80, 2.5),
    "cjk": (0.3, 4.0, 0.80, 3.0),
    "other": (0.2, 9.0, 0.90, 2.0),
}
SCRIPTS = {"latin": (0x41, 0x24F), "greek": (0x370, 0x3FF), "cyrillic": (0x400, 0x52F), "arabic": (0x600, 0x77F), "indic": (0x900, 0xDFF), "cjk": (0x2E80, 0xFAFF)}
ENTROPY_TOKENS = 64
#: Tokens of a text from which on its band is no wider; below, the width grows as the inverse root of the tokens.
FULL_TOKENS = 400
#: Texts of a language that a band needs; languages with fewer have the script's limits alone.
BAND_TEXTS = 50


def words_of(text: str) -> list[str]:
    return SPLIT.findall(text) if OTHER_SPACE.search(text) else text.split()


def repeated_window_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of so many words that the text has twice or more. Exact: windows are named by doubling."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    names, width = ids, 1
    while width < window:
        step = min(width, window - width)
        pairs = names[: len(names) - step].astype(np.int64) * (len(ids) + 1) + names[step:]
        names = np.unique(pairs, return_inverse=True)[1]
        width += step
    counts = np.bincount(names)
    again = counts[names] > 1
    if not again.any():
        return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if SPLIT.search(x)]
    return len(lines) - len(set(lines))


def script_of(text: str) -> str:
    """The script that most letters of a text belong to; 'other' without letters."""
    if text.isascii():
        return "latin" if any(map(str.isalpha, text[:1000])) or any(map(str.isalpha, text)) else "other"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    found = {name: int(((points >= a) & (points <= b)).sum()) for name, (a, b) in SCRIPTS.items()}
    found["latin"] -= int((((points > 0x5A) & (points < 0x61)) | ((points > 0x7A) & (points < 0xC0))).sum())
    best = max(found, key=found.get)
    others = int((points > 0x24F).sum()) - sum(n for name, n in found.items() if name != "latin")
    return best if found[best] > max(0, others) else "other"


class Vocabularies:
    """A byte-level vocabulary and one with byte fallback."""

    def __init__(self, vocabulary: str | None, piece_file: str | None):
        import public_tokenizers
        import sentencepiece

        self.pairs = BytePairs(vocabulary)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_file or public_tokenizers.path("piece_bpe_32k.model"))
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])

    def bare_bytes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, bare-byte tokens) of each text under byte fallback."""
        found = self.pieces.encode(texts, num_threads=1)
        n = np.fromiter(map(len, found), np.int64, len(found))
        bare = np.concatenate([[0], np.cumsum(self.is_byte[np.fromiter(chain.from_iterable(found), np.int64, n.sum())])])
        ends = np.cumsum(n)
        return n, bare[ends] - bare[ends - n]

    def tokens_and_entropy(self, text: str) -> tuple[int, float]:
        """Byte-level tokens of a text and the entropy of their distribution in bits."""
        ids = self.pairs.ids(text)
        if not len(ids):
            return 0, 0.0
        share = np.unique(ids, return_counts=True)[1] / len(ids)
        return len(ids), float(-(share * np.log2(share)).sum())


_VOCABULARIES: dict[tuple[str | None, str | None], Vocabularies] = {}


def measure(
    docs: DataFrame, limits: dict[str, tuple[float, float, float, float]] | None = None, min_words: int = 20, max_repeat_percent: int = 30,
    vocabulary: str | None = None, piece_file: str | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang",
) -> DataFrame:
    """The columns NAMES for every row: counts, base_failed, within (the script's limits), the three figures (null without a token), and band (language or else script)."""
    limits = limits or LIMITS
    id_type = docs.schema[id_col].dataType.simpleString()

    def rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = vocabulary, piece_file
        if files not in _VOCABULARIES:
            _VOCABULARIES[files] = Vocabularies(*files)
        vocabularies = _VOCABULARIES[files]
        for batch in slices(batches, 300):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = []
            for text, lang, n_pieces, bare in zip(texts, batch.column(2).to_pylist(), *vocabularies.bare_bytes(texts), strict=True):
                words = words_of(text)
                n, chars = len(words), sum(map(len, words))
                tokens, entropy = vocabularies.tokens_and_entropy(text)
                number: dict[str, int] = {}
                repeats = repeated_window_words(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n))
                script = script_of(text)
                low, high, most_bytes, least_entropy = limits[script]
                within = n > 0 and low <= len(text) / tokens <= high and bare <= most_bytes * n_pieces and (tokens < ENTROPY_TOKENS or entropy >= least_entropy)
                figures = (len(text) / tokens, float(bare / n_pieces) if n_pieces else None, entropy) if tokens else (None, None, None)
                failed = n < min_words or 100 * repeats > max_repeat_percent * n
                rows.append((n, chars, len(SYMBOLS.findall(text)), repeated_lines(text), repeats, tokens, failed, bool(within), lang or script, *figures))
            columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 12
            kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.string()] + [pa.float64()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], NAMES)

    counts = ", ".join(f"{c} long" for c in NAMES[1:7])
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    return docs.select(id_col, text_col, lang.alias("_lang")).mapInArrow(rules, f"doc_id {id_type}, {counts}, base_failed boolean, within boolean, band string, chars_per_token double, byte_share double, token_entropy double")


def apply_rules(docs: DataFrame, deviations: float = 4.0, **settings) -> DataFrame:
    """measure()'s columns and kept, for every row of docs; settings as for measure().

    kept is false if base_failed, if the text is outside its script's limits, or if its characters per token are more than so many robust
    deviations (1.4826 times the median absolute one) from the median of its language; both medians are exact to 0.0001. A null text is an empty one: no words, base_failed.
    A null language takes its script for a language. Repeated rows give repeated results; an empty table gives no rows.
    """
    with scratch():
        with batch_rows(docs.sparkSession):
            rows = materialize(measure(docs, **settings), outer=True)
        wide = F.sqrt(F.least(F.col("n_tokens"), F.lit(FULL_TOKENS)) / FULL_TOKENS)
        usual = rows.where("not base_failed and within")
        middle = materialize(binned_quantiles(usual, "band", "chars_per_token", {"middle": 0.5}).where(F.col("texts") >= BAND_TEXTS).select("band", "middle"))
        n_bands = middle.count()
        off = F.abs(F.col("chars_per_token") - F.col("middle")) * wide
        spread = binned_quantiles(usual.join(small(middle, n_bands), "band").withColumn("off", off), "band", "off", {"spread": 0.5}).select("band", "spread")
        spread = materialize(spread.join(small(middle, n_bands), "band"), outer=True)
    inside = F.coalesce(off <= deviations * 1.4826 * F.col("spread") + 1e-9, F.lit(True))
    return rows.join(small(spread, n_bands), "band", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("within") & inside).alias("kept"),
        "band", "n_tokens", "chars_per_token", "byte_share", "token_entropy",
    )


NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "base_failed", "within", "band", "chars_per_token", "byte_share", "token_entropy"]
