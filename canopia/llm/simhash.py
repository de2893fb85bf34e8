"""SimHash near-duplicates through an inverted index of byte positions with count filtering."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopia.llm.buckets import compare_buckets, forest, runs
from canopia.llm.words import mixed
from canopia.operators.components import connected_components
from canopia.plans.shared import bounded_batches, broadcast_if_small, join_by_key, materialize

#: Two fingerprints of 8 bytes with at most 3 different bits share at least 5 bytes in place.
BYTES, MAX_BITS = 8, 3
#: Bytes of place that one list of the index is about.
LISTED = 4
BLOCK = 4096
SMALL = 24


def listed_places(n: int = BYTES, shared: int = BYTES - MAX_BITS, size: int = LISTED) -> list[tuple[int, ...]]:
    """Sets of ``size`` places, so chosen that any ``shared`` of ``n`` places hold one of them: each pair with so many bytes in common shares a list."""
    left, out = set(combinations(range(n), shared)), []
    while left:
        best = max(combinations(range(n), size), key=lambda c: (sum(set(c) <= set(x) for x in left), c))
        out.append(best)
        left = {x for x in left if not set(best) <= set(x)}
    return out


PLACES = listed_places()


def fingerprint(text: str | None, ngram: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of one text: each bit is 1 if set in over half the shingle hashes.

    Null, empty and blank texts have no words and the fingerprint 0; fewer words than ``ngram`` are one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(ngram)), strict=False)) if len(words) >= ngram else [b" ".join(words)]
    h = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):  # bounds the memory of very long texts
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, text: str = "text", ngram: int = 3, seed: int = 42, to: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint as a signed long; works in Arrow batches, in place, without a shuffle."""

    bounded_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, ngram, seed) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn(to, of(F.col(text)))


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """Places at which the bytes of two fingerprints agree, from their exclusive or."""
    return (x.view(np.uint8).reshape(-1, BYTES) == 0).sum(1)


def linked(a: np.ndarray, b: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Tally the shared positional bytes, keep pairs with the guaranteed count, verify the bits."""
    x = np.ascontiguousarray(a ^ b)
    keep = np.flatnonzero(shared_bytes(x) >= BYTES - max_bits)
    keep = keep[np.bitwise_count(x[keep]) <= max_bits]
    out = np.zeros(len(x), bool)
    out[keep] = True
    return out


def _connecting(fp: np.ndarray, label: np.ndarray, side: np.ndarray, linked: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows whose links connect what is connected in each bucket: never more than one link for each row."""

    def _grown(x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A spanning forest of one large bucket: grow each component, comparing its front with what is left."""
        left, a, b, front = np.arange(len(x)), [], [], []
        while len(left):
            if not front:
                front, left = [int(left[0])], left[1:]
            i = front.pop()
            ok = linked(np.broadcast_to(x[i], x[left].shape), x[left])
            if own[i] >= 0:
                ok &= own[left] != own[i]
            new = left[ok]
            if len(new):
                a.append(np.full(len(new), i))
                b.append(new)
                front.extend(new.tolist())
                left = left[~ok]
        empty = np.zeros(0, np.int64)
        return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)

    found_r, found_c, large = [], [], [(lo, hi) for lo, hi in runs(label) if hi - lo > SMALL]
    small = np.ones(len(fp), bool)
    for lo, hi in large:
        small[lo:hi] = False
    at = np.flatnonzero(small)
    for d in range(1, SMALL):  # all pairs of all small buckets, a distance at a time
        i, j = at[:-d], at[d:]
        if len(i) == 0:
            break
        same = label[i] == label[j]
        if not same.any():
            break
        i, j = i[same], j[same]
        ok = linked(fp[i], fp[j]) & ((side[i] < 0) | (side[i] != side[j]))
        found_r.append(i[ok])
        found_c.append(j[ok])
    for lo, hi in large:
        a, b = _grown(fp[lo:hi], side[lo:hi])
        found_r.append(a + lo)
        found_c.append(b + lo)
    if found_r:
        r, c = forest(np.concatenate(found_r), np.concatenate(found_c), len(fp))
        if len(r):
            yield r, c


def _links(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    fp = batch["fp"].to_numpy().astype(np.int64).view(np.uint64)
    for r, c in _connecting(fp, batch["_bucket"].to_numpy(), batch["_side"].to_numpy(), linked):
        yield pd.DataFrame({"src": fp[r].view(np.int64), "dst": fp[c].view(np.int64)})


def fingerprint_links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links ``(src, dst)`` that connect exactly the different fingerprints ``fp`` that Hamming distance <= 3 connects.

    The inverted index lists a fingerprint under LISTED bytes and their places, for each of PLACES; any linked pair shares a list. With
    2**32 lists for each set of places, a list is short until there are billions of fingerprints. Pairs of a list are tallied for all their
    positional bytes in blocks and never leave the task unless verified.
    """
    byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))
    key = [F.lit(k << 8 * LISTED) + sum((byte(q) * F.lit(1 << 8 * i) for i, q in enumerate(p)), F.lit(0)) for k, p in enumerate(PLACES)]
    index = fps.select("fp", F.explode(F.array(*[k.cast("long") for k in key])).alias("_key"))
    return compare_buckets(index, ["_key"], "fp", _links, "src long, dst long", block)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 3, block: int = BLOCK) -> DataFrame:
    """Per row of ``docs``: ``id_col``, ``fp`` (signed long) and ``component_id``, the smallest id reachable by links.

    Only the two named columns are read. Repeated rows come out as often as they came in, with equal values;
    a null id gets its group's smallest id, or null if the group has none; an empty table gives an empty one.
    Exact copies share a fingerprint and are one node, so no group is ever expanded into its pairs.
    """
    marked = materialize(with_fingerprint(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text", ngram).select("_id", "fp"), "fingerprints")
    nodes = marked.groupBy("fp").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_times"))
    groups = connected_components(fingerprint_links(nodes.select("fp"), block))
    named = nodes.join(groups, nodes["fp"] == groups["node"], "left").select("fp", "_least", "_times", F.coalesce("component", "fp").alias("_root"))
    least = named.groupBy("_root").agg(F.min("_least").alias("component_id"))
    by_fp = materialize(named.join(least, "_root").select("fp", "component_id", "_times"), "groups")
    return join_by_key(marked, by_fp, "fp", "_times").select(F.col("_id").alias(id_col), "fp", "component_id")


# Wide fingerprints: near-duplicates by similarity instead of a few bits.

#: 64-bit words of a wide fingerprint, and words of a shingle.
WIDE, NGRAM, SIMILARITY = 8, 5, 0.8
#: Two texts of just that similarity share a byte in place with probability 0.27, 17 of 64: with fewer than 6 a pair in 10,000 is left out.
LEAST_WIDE = 6
_MIX = [np.uint64(x) for x in np.random.default_rng(17).integers(1, 1 << 63, WIDE, np.uint64) * np.uint64(2) + np.uint64(1)]


def wide_fingerprint(text: str | None, ngram: int = NGRAM) -> bytes:
    """The SimHash of one text in WIDE words of 64 bits, each from an own mix of the hashes of its different shingles.

    Words as in :func:`fingerprint`; null, empty and blank texts have zeros.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return bytes(8 * WIDE)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(ngram)), strict=False)) if len(words) >= ngram else [b" ".join(words)]
    h = np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64))
    ones = np.zeros(64 * WIDE, np.int64)
    for i in range(0, len(h), 1 << 13):  # bounds the memory of very long texts
        part = np.stack([mixed(h[i : i + (1 << 13)] * m) for m in _MIX], 1)
        ones += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return np.packbits(ones * 2 > len(h), bitorder="little").tobytes()


def bits_of(similarity: float) -> int:
    """Differing bits of two wide fingerprints whose texts share this part of their shingles, as expected: angles follow the cosine 2 s / (1 + s)."""
    return round(64 * WIDE * float(np.arccos(2 * similarity / (1 + similarity))) / np.pi)


def _wide_links(most: int):
    def linked_wide(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = a ^ b
        keep = np.flatnonzero((x == 0).sum(1) >= LEAST_WIDE)
        keep = keep[np.bitwise_count(x[keep].view(np.uint64)).sum(1, dtype=np.int64) <= most]
        out = np.zeros(len(x), bool)
        out[keep] = True
        return out

    def run(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        fp = np.frombuffer(b"".join(batch["fp"]), np.uint8).reshape(-1, 8 * WIDE)
        for r, c in _connecting(fp, batch["_bucket"].to_numpy(), batch["_side"].to_numpy(), linked_wide):
            yield pd.DataFrame({"src": batch["fp"].to_numpy()[r], "dst": batch["fp"].to_numpy()[c]})

    return run


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """``(_id, _hash, _first)`` of the different pairs of id and text: whether it is the first, by id and then text, of its group of similar texts.

    Groups are what links connect; two texts link if their wide fingerprints differ in no more bits than those of texts with that part of
    ``ngram``-word shingles in common do on average. The inverted index lists a fingerprint under each two neighbouring bytes, the last with the first;
    two texts of just that similarity share one of the lists with probability 0.99. A null id is in no group.
    """
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([wide_fingerprint(t, ngram) for t in texts], dtype=object)

    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), of(F.col(text_col)).alias("fp"))
    marked = materialize(source, "wide_fingerprints")
    rows = marked.distinct()
    nodes = materialize(rows.groupBy("fp").agg(F.min(F.struct("_id", "_hash")).alias("_least"), F.count(F.lit(1)).alias("_times")), "wide_nodes")
    byte = lambda i: F.conv(F.hex(F.substring("fp", i % (8 * WIDE) + 1, 1)), 16, 10).cast("int")
    keys = F.array(*[F.lit(i << 16) + byte(i) * 256 + byte(i + 1) for i in range(8 * WIDE)])
    index = nodes.select("fp", F.explode(keys).alias("_key"))
    links = compare_buckets(index, ["_key"], "fp", _wide_links(bits_of(similarity)), "src binary, dst binary", block)
    groups = connected_components(links)
    named = nodes.join(groups, nodes["fp"] == groups["node"], "left").select("fp", "_least", "_times", F.coalesce("component", "fp").alias("_root"))
    least = named.groupBy("_root").agg(F.min("_least").alias("_first"))
    by_fp = materialize(named.join(least, "_root").select("fp", "_first", "_times"), "wide_groups")
    first = (F.col("_id") == F.col("_first._id")) & F.col("_hash").eqNullSafe(F.col("_first._hash"))
    return join_by_key(rows, by_fp, "fp", "_times").select("_id", "_hash", first.alias("_first"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM, similarity: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` of each group of similar texts, that with the smallest id; all columns stay, and rows with null ids.

    A document is its id and its text: of rows that repeat both one stays, and different texts under one id are told apart. See :func:`similar_groups`.
    The texts are not shuffled as long as what is to go can be broadcast.
    """
    key, text = "_key_id", "_key_hash"
    while {key, text} & set(docs.columns):
        key, text = f"_{key}", f"_{text}"
    groups = materialize(similar_groups(docs, id_col, text_col, ngram, similarity), "similar")
    same = F.col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(text_col) == F.col(text))
    gone = materialize(groups.where(~F.col("_first")).select(F.col("_id").alias(key), F.col("_hash").alias(text)), "gone")
    kept = docs.join(broadcast_if_small(gone), same, "left_anti")
    several = kept.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(key), F.xxhash64(text_col).alias(text)).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    several = materialize(several, "rows_again")
    if several.isEmpty():
        return kept
    several = broadcast_if_small(several)
    return kept.join(several, same, "left_anti").unionByName(kept.join(several, same, "left_semi").dropDuplicates([id_col, text_col]))
