"""Fill-in-the-middle transformation: texts cut at token boundaries that are found and ranked as bits of big integers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopia.plans.shared import bounded_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred documents so many are transformed, and of a hundred transformed ones so many put the suffix first.
RATE, SUFFIX_FIRST = 90, 20
#: Letters become the digit 1, all other bytes 0.
_LETTERS = bytes(0x31 if chr(b).isalpha() and b < 0x80 else 0x30 for b in range(256))


def token_starts(text: str) -> int:
    """A bit for each code point, the first one lowest: whether a token (a run of A-Z and a-z, or one other code point) starts there."""
    if not text:
        return 0
    mask = text.encode("latin-1", "replace").translate(_LETTERS)  # one byte for each code point; those without one become "?"
    letters = int(mask[::-1], 2)
    return ((1 << len(text)) - 1) & ~(letters & (letters << 1))


def select_bit(bits: int, rank: int, size: int) -> int:
    """The place of the set bit with ``rank`` set bits below it among the lowest ``size``, by halving: each step counts one half."""
    at = 0
    while size > 1:
        half = size >> 1
        low = bits & ((1 << half) - 1)
        below = low.bit_count()
        if rank < below:
            bits, size = low, half
        else:
            bits, size, rank, at = bits >> half, size - half, rank - below, at + half
    return at


def cut_places(text: str, first: int, second: int) -> tuple[int, int, int]:
    """Tokens of ``text``, and the code points before the cuts after ``min`` and ``max`` of two hashes modulo their number and one."""
    bits = token_starts(text)
    n = bits.bit_count()
    place = lambda k: len(text) if k == n else select_bit(bits, k, len(text))
    a, b = sorted((first % (n + 1), second % (n + 1)))
    return n, place(a), place(b)


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, rate: int = RATE, suffix_first: int = SUFFIX_FIRST
) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, ``n`` (tokens), ``form``, ``prefix_chars``, ``middle_chars``, ``output``.

    Four numbers, the first four groups of eight digits of the SHA-256 of ``seed:id``, choose the two cuts, whether the text is
    transformed, and the form: ``psm`` (prefix, suffix, middle) or ``spm`` (suffix, prefix, middle), each part behind its mark; or
    ``plain``, the text itself, which empty texts and those that hold a mark always are (their counts of characters are null).
    Only the two named columns are read. A null text is an empty one; a null id stays null and counts as an empty id; repeated rows come
    out as often as they come in; an empty table gives an empty one. One pass without a shuffle; whatever the text's length, each step
    is a few operations on integers of one bit a code point.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for i, digest, text in zip(batch["_id"], batch["_digest"], batch["_text"], strict=True):
                text = text or ""
                h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
                n, a, b = cut_places(text, h[0], h[1])
                if not text or h[2] % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
                    rows.append((i, n, "plain", None, None, text))
                    continue
                prefix, middle, suffix = text[:a], text[a:b], text[b:]
                if h[3] % 100 < suffix_first:
                    rows.append((i, n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"))
                else:
                    rows.append((i, n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"))
            out = pd.DataFrame(rows, columns=["_id", "n", "form", "prefix_chars", "middle_chars", "output"]).astype({"_id": object})
            yield out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    key = F.col(id_col).cast("string")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key, F.lit(""))), 256)
    out = docs.select(key.alias("_id"), digest.alias("_digest"), F.col(text_col).alias("_text")).mapInPandas(
        run, "_id string, n long, form string, prefix_chars long, middle_chars long, output string"
    )
    return out.select(F.col("_id").cast(docs.schema[id_col].dataType).alias(id_col), "n", "form", "prefix_chars", "middle_chars", "output")


def restored(form: Column, output: Column) -> Column:
    """The text that ``output`` was made of: its marks are the only ones in it."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    at = lambda k: F.get(part, F.lit(k))
    return F.when(form == "psm", F.concat(at(1), at(3), at(2))).when(form == "spm", F.concat(at(2), at(3), at(1))).otherwise(output)
