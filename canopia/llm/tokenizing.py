"""Token ids of whole texts by a public byte-level vocabulary."""

from __future__ import annotations

import base64
import json

import numpy as np

#: The vocabulary file; the ids are those of the file byte_bpe_50k.json, which tests compare.
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The same vocabulary for ``tokenizers``; it also holds the added tokens.
ADDED = "byte_bpe_50k.json"


class Encoder:
    """Encodes texts to ids. ``path`` names a vocabulary file of ranks; unset, the public package's own.

    With ``added``, texts are split first at the added tokens of the public package's vocabulary, which have ids of their own, as
    ``tokenizers`` does; a file of ranks under ``path`` has none.
    """

    def __init__(self, path: str | None = None, added: bool = True) -> None:
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self._added: dict[str, int] = {}
        if added and path is None:
            with open(public_tokenizers.path(ADDED), encoding="utf-8") as f:
                self._added = {t["content"]: int(t["id"]) for t in json.load(f)["added_tokens"]}
        self._encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self._added)
        self._bytes = np.zeros(max([*ranks.values(), *self._added.values()]) + 1, np.int64)
        for token, rank in [*ranks.items(), *((t.encode(), i) for t, i in self._added.items())]:
            self._bytes[rank] = len(token)

    def ids(self, text: str | None) -> np.ndarray:
        """Unsigned 32-bit ids of the whole text; without ``added``, the strings of added tokens are ordinary text; null is empty."""
        text = text or ""
        if any(t in text for t in self._added):
            return np.array(self._encoding.encode(text, allowed_special="all"), "<u4")
        return np.array(self._encoding.encode_ordinary(text), "<u4")

    def byte_starts(self, ids: np.ndarray) -> np.ndarray:
        """The byte of the text at which each token starts."""
        ends = np.cumsum(self._bytes[ids])
        return ends - self._bytes[ids]
