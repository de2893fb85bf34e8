"""Token counts of sections by offset-mapped attribution: each document is encoded once, as a whole."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopia.llm.tokenizing import Encoder
from canopia.plans.shared import bounded_batches


def attribute(raw: bytes, token_starts: np.ndarray, token_ends: np.ndarray, separator: bytes) -> list[tuple[int, int, int, int]]:
    """``(start, end, tokens, crossing)`` of each section of a text, ``start`` and ``end`` in characters.

    Sections end after each separator, which belongs to the section before it; the last is what follows, if anything does.
    A token counts for the section that holds its first character. It is ``crossing`` there if its span reaches into the next section.
    """
    cuts, at = [], raw.find(separator)
    while at >= 0:
        cuts.append(at + len(separator))
        at = raw.find(separator, at + len(separator))
    if not cuts or cuts[-1] < len(raw):
        cuts.append(len(raw))
    ends = np.array(cuts, np.int64)
    data = np.frombuffer(raw, np.uint8)
    # A token may start inside a character of several bytes: its first character starts at the last byte that begins one.
    begins = (data & 0xC0) != 0x80
    head = np.maximum.accumulate(np.where(begins, np.arange(len(data)), 0)) if len(data) else np.zeros(0, np.int64)
    chars = np.concatenate([[0], np.cumsum(begins)])
    own = np.searchsorted(ends, head[token_starts], "right")
    tokens = np.bincount(own, minlength=len(ends))
    crossing = np.bincount(own[token_ends > ends[own]], minlength=len(ends))
    starts = np.concatenate([[0], ends[:-1]])
    return list(zip(chars[starts].tolist(), chars[ends].tolist(), tokens.tolist(), crossing.tolist(), strict=True))


def section_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", separator: str = "\n", path: str | None = None, added: bool = False) -> DataFrame:
    """One row per section of each row of ``docs``: ``id_col``, ``section`` (from 0), ``start``, ``end`` (characters), ``n_tokens``, ``n_crossing``.

    The counts of a document's sections add up to its own number of tokens; ``added`` tells whether the strings of added tokens in a text are such tokens. Only the two named columns are
    read. A null or empty text is one empty section without tokens; a null id stays null; repeated rows come out as often as they
    came in; an empty table gives an empty one. One pass without a shuffle.
    """
    mark = separator.encode()
    if not mark:
        raise ValueError("the separator must not be empty")
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(path, added)
        for batch in batches:
            rows: list[tuple] = []
            for i, text in zip(batch["_id"].tolist(), batch["_text"].tolist(), strict=True):
                ids = encoder.ids(text)
                starts = encoder.byte_starts(ids)
                raw = (text or "").encode()
                ends = np.append(starts[1:], len(raw))[: len(ids)]
                rows += [(i, k, *x) for k, x in enumerate(attribute(raw, starts, ends, mark))]
            yield pd.DataFrame(rows, columns=["_id", "section", "start", "end", "n_tokens", "n_crossing"]).astype({"_id": object})

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    if kind in ("bigint", "int", "smallint", "tinyint"):  # pandas would turn whole numbers beside nulls into floats
        source = source.withColumn("_id", F.col("_id").cast("string"))
    out = source.mapInPandas(run, f"_id {'string' if kind in ('bigint', 'int', 'smallint', 'tinyint') else kind}, section int, start long, end long, n_tokens long, n_crossing long")
    return out.select(F.col("_id").cast(kind).alias(id_col), "section", "start", "end", "n_tokens", "n_crossing")
