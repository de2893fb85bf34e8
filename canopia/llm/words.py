"""Splitting and hashing the words of many texts at once with numpy; used inside Spark tasks."""

from __future__ import annotations

import numpy as np

#: Bytes of text that are split together; longer texts make longer pieces, one text each.
PIECE = 1_000_000
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_random = np.random.default_rng(20_240_611)
_BYTE = _random.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C13)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash's step and of its inverse modulo 2**64."""
    with np.errstate(over="ignore"):
        up = np.full(n, _STEP)
        back = np.full(n, _BACK)
        up[:1] = back[:1] = 1
        return np.cumprod(up), np.cumprod(back)


def pieces(texts: list[str | None]):
    """``(first, count, bytes)``: runs of whole texts of about ``PIECE`` bytes, a line end after each text."""
    at, size, part = 0, 0, []
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass")
        if part and size + len(b) > PIECE:
            yield at, part
            at, size, part = i, 0, []
        part.append(b)
        size += len(b) + 1
    if part:
        yield at, part


class Words:
    """The words (runs of no ASCII white space, A-Z lower-cased) of a run of texts: owner text, place and hash."""

    def __init__(self, part: list[bytes], lower: bool = True) -> None:
        raw = np.frombuffer(b"\n".join(part) + b"\n", np.uint8)
        self.raw = _LOWER[raw] if lower else raw
        space = _SPACE[raw]
        edge = np.diff(space.astype(np.int8), prepend=np.int8(1))
        self.starts, self.ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        ends_of_texts = np.cumsum([len(b) + 1 for b in part])
        self.owner = np.searchsorted(ends_of_texts, self.starts, "right").astype(np.int32)

    def hashes(self, raw: np.ndarray | None = None, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
        """64-bit hashes of the words; equal words have equal hashes, different ones by chance of 2**-64."""
        raw = self.raw if raw is None else raw
        starts, ends = (self.starts, self.ends) if starts is None else (starts, ends)
        global _POWERS
        if len(_POWERS[0]) < len(raw):
            _POWERS = powers(max(len(raw), PIECE + (PIECE >> 2)))
        up, back = _POWERS
        with np.errstate(over="ignore"):
            total = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
            return mixed((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))


_POWERS = powers(1)
