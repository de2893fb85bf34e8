"""Comparing the members of hash buckets, with large buckets dealt out as pairs of blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopia.plans.shared import materialize


def compare_buckets(
    rows: DataFrame, key: list[str], salt: str, compare: Callable[[pd.DataFrame], Iterator[pd.DataFrame]],
    schema: str, block: int,
) -> DataFrame:
    """Apply ``compare`` to batches of whole buckets.

    A bucket of more than ``block`` rows is cut into blocks by a hash of ``salt``, and each pair of blocks
    becomes a bucket of its own: memory for one comparison is bounded by two blocks, the work of one hot
    bucket spreads over many tasks, and every pair still meets exactly once. ``compare`` gets rows sorted by
    the column ``_bucket`` (equal in a bucket) with ``_side``: 0 or 1 where only rows of different sides are
    to be compared, -1 where all are.
    """
    # At most one row for each ``block`` input rows, so Spark may broadcast it by its known size.
    large = materialize(
        rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block), "large"
    )
    blocks = F.ceil(F.col("_n") / block).cast("int")
    own = F.pmod(F.xxhash64(salt), blocks).cast("int")
    dealt = (
        rows.join(large, key, "left")
        .withColumn("_own", F.when(F.col("_n").isNull(), F.lit(0)).otherwise(own))
        .withColumn("_other", F.explode(F.when(F.col("_n").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), blocks - 1))))
        .withColumn("_lo", F.least("_own", "_other")).withColumn("_hi", F.greatest("_own", "_other"))
        .withColumn("_side", F.when(F.col("_lo") == F.col("_hi"), F.lit(-1)).otherwise((F.col("_own") == F.col("_hi")).cast("int")))
        .drop("_n", "_own", "_other")
    )
    group = [*key, "_lo", "_hi"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            starts = _starts(batch, group)
            last = starts[-1] if len(starts) else 0
            if last:
                yield from compare(_labelled(batch.iloc[:last], group))
            rest = batch.iloc[last:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield from compare(_labelled(rest, group))

    return dealt.repartition(*group).sortWithinPartitions(*group).mapInPandas(run, schema)


def _starts(batch: pd.DataFrame, group: list[str]) -> np.ndarray:
    change = np.zeros(len(batch), bool)
    if len(batch):
        change[0] = True
    for c in group:
        v = batch[c].to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(change)


def _labelled(batch: pd.DataFrame, group: list[str]) -> pd.DataFrame:
    starts = _starts(batch, group)
    label = np.zeros(len(batch), np.int64)
    label[starts] = 1
    return batch.assign(_bucket=np.cumsum(label) - 1)


def runs(label: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal values that hold more than one row."""
    edge = np.flatnonzero(np.diff(label)) + 1
    lo = np.concatenate([[0], edge])
    hi = np.concatenate([edge, [len(label)]])
    several = hi - lo > 1
    return zip(lo[several].tolist(), hi[several].tolist(), strict=True)


def forest(r: np.ndarray, c: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """One edge for each member to the smallest member that these pairs connect it to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[r], root[c])
        new = root.copy()
        np.minimum.at(new, r, low)
        np.minimum.at(new, c, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    s = np.flatnonzero(root != np.arange(n))
    return s, root[s]
