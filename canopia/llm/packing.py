"""Best-fit packing of documents into token sequences, after the dominance reduction of Martello and Toth."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopia.llm.tokenizing import Encoder
from canopia.plans.shared import bounded_batches, materialize

CAPACITY, END = 2048, 0
#: Pieces of one length are numbered in so many independent groups.
BUCKETS = 1024

#: Bins of one kind: how many, and what each holds as (length, how often).
Bins = tuple[int, tuple[tuple[int, int], ...]]


def reduce(left: np.ndarray, capacity: int) -> list[Bins]:
    """Fix bins that dominate every other bin of their largest piece; takes what they hold from ``left`` (pieces by length).

    The largest piece s leaves r = capacity - s. If nothing fits beside it, it is alone. If a piece of length r exists, any
    other content of r can be exchanged for it, so {s, r} dominates. If no two pieces fit beside s, the longest that does
    dominates. Whatever an optimal packing puts beside s, such a bin is no worse; repeated until nothing changes.
    """
    fixed: list[Bins] = []
    changed = True
    while changed:
        changed = False
        for s in range(capacity, 0, -1):
            while left[s]:
                r = capacity - s
                left[s] -= 1  # one s is the bin's own; what is left may stand beside it
                fits = np.flatnonzero(left[: r + 1])
                few = fits[:2] if len(fits) else fits
                two = (2 * few[0] if left[few[0]] > 1 else few[0] + few[1] if len(few) > 1 else capacity + 1) if len(few) else 0
                best = int(fits[-1]) if len(fits) else 0
                left[s] += 1
                if not best:
                    fixed.append((int(left[s]), ((s, 1),)))
                    left[s] = 0
                elif best == r or two > r:
                    n = int(left[s]) // 2 if best == s else int(min(left[s], left[best]))
                    fixed.append((n, ((s, 2),) if best == s else ((s, 1), (best, 1))))
                    left[s] -= n
                    left[best] -= n
                else:
                    break
                changed = True
    return fixed


def best_fit(left: np.ndarray, capacity: int) -> list[Bins]:
    """Best-fit decreasing over lengths with multiplicities: equal bins are handled together, with the result of one by one."""
    open_bins: list[Counter] = [Counter() for _ in range(capacity + 1)]  # by room left: contents -> bins
    for s in range(capacity, 0, -1):
        n = int(left[s])
        room = s
        while n:
            while room <= capacity and not open_bins[room]:
                room += 1
            if room > capacity:
                each = capacity // s
                if n // each:
                    open_bins[capacity - each * s][((s, each),)] += n // each
                if n % each:
                    open_bins[capacity - n % each * s][((s, n % each),)] += 1
                break
            content, bins = min(open_bins[room].items())
            each = room // s
            full = min(bins, n // each)
            used, last = (full, 0) if full else (1, n)
            open_bins[room][content] -= used
            if not open_bins[room][content]:
                del open_bins[room][content]
            took = each if full else last
            open_bins[room - took * s][(*content, (s, took))] += used
            n -= took * used
    return [(n, content) for group in open_bins for content, n in sorted(group.items())]


def plan(lengths: dict[int, int], capacity: int = CAPACITY) -> list[Bins]:
    """Bins for so many pieces of each length. Works on counts alone, so its size is bounded by the capacity, not by the data."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in lengths.items():
        left[length] = n
    return [x for x in reduce(left, capacity) + best_fit(left, capacity) if x[0]]


class Slots:
    """Places by length and rank: the pieces of a length fill the bins of a plan in its order."""

    def __init__(self, bins: list[Bins]) -> None:
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        first, taken = 0, Counter()
        for n, content in bins:
            offset = 0
            for length, each in content:
                rows.setdefault(length, []).append((taken[length], first, each, offset))
                taken[length] += n * each
                offset += length * each
            first += n
        self.by_length = {k: np.array(v, np.int64).T for k, v in rows.items()}

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for k in np.unique(length):
            at = np.flatnonzero(length == k)
            start, first, each, place = self.by_length[int(k)]
            g = np.searchsorted(start, rank[at], "right") - 1
            q = rank[at] - start[g]
            sequence[at] = first[g] + q // each[g]
            offset[at] = place[g] + q % each[g] * k
        return sequence, offset


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """``(_id, piece, start, length, ids_crc32)``: each whole text's ids and an end id, cut only if longer than ``capacity``; the first piece is the short one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(path)
        for batch in batches:
            rows: list[tuple] = []
            for i, text in zip(batch["_id"].tolist(), batch["_text"].tolist(), strict=True):
                ids = np.append(encoder.ids(text), np.array([END], "<u4"))
                at, size = 0, (len(ids) - 1) % capacity + 1
                for piece in range(-(-len(ids) // capacity)):
                    rows.append((i, piece, at, size, zlib.crc32(ids[at : at + size].tobytes())))
                    at, size = at + size, capacity
            yield pd.DataFrame(rows, columns=["_id", "piece", "start", "length", "ids_crc32"]).astype({"_id": object})

    source = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text"))
    out = source.mapInPandas(run, "_id string, piece int, start long, length long, ids_crc32 long")
    return out.withColumn("_id", F.col("_id").cast(docs.schema[id_col].dataType))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Per piece of a document: ``id_col``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    Sequences hold at most ``capacity`` tokens, without gaps from offset 0. Only the two named columns are read. Null and empty
    texts are the end id alone; a null id stays null; repeated rows are packed as often as they come; an empty table gives
    an empty one. The driver sees the number of pieces of each length (``capacity`` numbers at most), nothing else.
    """
    bounded_batches(docs.sparkSession)
    pieces = materialize(cut(docs, id_col, text_col, capacity, path), "pieces")
    lengths = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    slots = docs.sparkSession.sparkContext.broadcast(Slots(plan(lengths, capacity)))
    # Ranks among the pieces of a length: a number within a hashed group, and the sizes of the groups before it.
    marked = pieces.withColumn("_bucket", F.pmod(F.xxhash64("_id", "piece", "ids_crc32"), F.lit(BUCKETS)).cast("int"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = marked.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("_id", "piece", "ids_crc32"))
    ranked = marked.withColumn("_within", within).join(sizes, ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_within") - 1)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = slots.value.of(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return ranked.withColumn("_at", place("length", "_rank")).select(
        F.col("_id").alias(id_col), "piece", "start", "length", "ids_crc32", "_at.sequence_id", "_at.offset"
    )
