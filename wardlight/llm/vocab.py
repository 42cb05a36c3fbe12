"""Token ids of whole texts under a public byte-level BPE vocabulary, taken from its file for the tokenizers library.

The file's merges stand in the order of their tokens' ids, so ids are ranks and the text can be encoded by a faster reader of ranks; added tokens are found in a text before it is split, as that library
does. Tests hold the ids against the tokenizers library's own.
"""

from __future__ import annotations

import json

import numpy as np


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary file stands for: printable Latin-1 for itself, the others in order from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class BytePairs:
    """Ids of a vocabulary file (None: the public one), added tokens included."""

    def __init__(self, file: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(file or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
            given = json.load(f)
        self.added = {t["content"]: t["id"] for t in given.get("added_tokens", [])}
        byte = byte_of()
        ranks = {bytes(byte[c] for c in token): i for token, i in given["model"]["vocab"].items() if token not in self.added}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.added)
        self.size = 1 + max([*ranks.values(), *self.added.values()])

    def ids(self, text: str) -> np.ndarray:
        """Ids of a text as little-endian unsigned 32-bit numbers."""
        if any(t in text for t in self.added):
            return np.asarray(self.encoding.encode(text, allowed_special="all"), "<u4")
        return np.asarray(self.encoding.encode_ordinary(text), "<u4")
