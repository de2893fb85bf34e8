"""Removal of repeated word sequences: fixed blocks as anchors, probed with every rolling window, extended to maximal repeats."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopia.llm.words import Words, mixed, powers
from canopia.plans.shared import discard, materialize, shared_dir

#: Words of a repeat.
WINDOW = 35
#: Bytes of text that one row of the table of pieces holds; a longer text is a piece of its own.
PIECE = 1 << 20
#: Bytes of text for each bucket of hashes and each file of pieces, and the least and largest number of these.
BUCKET_BYTES, FILE_BYTES, LEAST_BUCKETS, LEAST_FILES, MOST_FILES = 1 << 22, 1 << 26, 1024, 64, 100_000
_OTHER = np.uint64(0xD1B54A32D192ED03)


class Piece:
    """The word hashes of some texts, and rolling hashes of their windows; a window never crosses from one text into the next."""

    def __init__(self, texts: list[str | None]) -> None:
        words = Words([(t or "").encode("utf-8", "surrogatepass") for t in texts], lower=False)
        self.hashes = words.hashes()
        self.counts = np.bincount(words.owner, minlength=len(texts))
        self.first = np.cumsum(self.counts) - self.counts
        #: Of each word, how many words of its text come before it.
        self.place = np.arange(len(self.hashes)) - np.repeat(self.first, self.counts)
        self.left = np.repeat(self.counts, self.counts) - self.place

    def rolling(self, n: int, other: bool = False) -> np.ndarray:
        """Hashes of the windows of ``n`` words that start at each word; those that leave the text are of no use."""
        h = mixed(self.hashes ^ _OTHER) if other else self.hashes
        out = np.zeros(len(h), np.uint64)
        if len(h) >= n:
            up, back = powers(len(h))
            with np.errstate(over="ignore"):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up)])
                out[: len(h) - n + 1] = mixed((total[n:] - total[:-n]) * back[: len(h) - n + 1])
        return out

    def anchors(self, window: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """A key of bucket and 32 bits for the block of half a window that starts at each word, and which of them are there and can stand in a window."""
        block = (window + 1) // 2
        there = (self.left >= block) & (np.repeat(self.counts, self.counts) >= window)
        return (self.rolling(block) >> np.uint64(64 - 32 - (buckets.bit_length() - 1))), there

    def near(self, hit: np.ndarray, window: int) -> np.ndarray:
        """The starts of the windows that hold a block that was hit."""
        reach = window - (window + 1) // 2
        edge = np.zeros(len(hit) + 1, np.int64)
        at = np.flatnonzero(hit)
        np.add.at(edge, np.maximum(at - reach, at - self.place[at]), 1)
        np.add.at(edge, at + 1, -1)
        return np.flatnonzero((np.cumsum(edge[:-1]) > 0) & (self.left >= window))


def _dealt(piece: int, buckets: np.ndarray, **columns: np.ndarray) -> Iterator[dict]:
    """A row for each bucket of sorted ``buckets``, with what the columns have for it as bytes."""
    edge = np.flatnonzero(np.diff(buckets)) + 1
    for lo, hi in zip(np.concatenate([[0], edge]).tolist(), np.concatenate([edge, [len(buckets)]]).tolist(), strict=True):
        if hi > lo:
            yield {"bucket": int(buckets[lo]), "piece": piece} | {c: v[lo:hi].tobytes() for c, v in columns.items()}


def _pieces(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """A written table of ``(piece, ids, texts)`` in files by the hash of ``piece``, so that joins by piece never move a text again; and the number of buckets."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    files = min(max(LEAST_FILES, -(-size // FILE_BYTES)), MOST_FILES)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
        schema = None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"piece": number, "ids": ids, "texts": texts}], schema)

        for batch in batches:
            schema = schema or pa.schema([("piece", pa.int64()), ("ids", pa.list_(batch.schema.field("_id").type)), ("texts", pa.list_(pa.string()))])
            for i, t in zip(batch["_id"].to_pylist(), batch["_text"].to_pylist(), strict=True):
                if texts and held + len(t or "") > PIECE:
                    yield row()
                    number, ids, texts, held = number + 1, [], [], 0
                ids.append(i)
                texts.append(t)
                held += len(t or "")
        if texts:
            yield row()

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"piece long, ids array<{kind}>, texts array<string>")
    name = f"canopia_pieces_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/canopia/{name}"
    writer = rows.repartition(files, "piece").write.bucketBy(files, "piece").option("path", path).option("compression", "zstd").option("parquet.block.size", 1 << 24)
    writer.saveAsTable(name)
    return spark.table(name), 1 << max(LEAST_BUCKETS - 1, size // BUCKET_BYTES).bit_length()


def _anchored(pieces: DataFrame, window: int, buckets: int) -> DataFrame:
    """``(piece, bucket, keys)``: the blocks of each piece that an indexed block somewhere equals, itself not counted.

    Indexed are the blocks that follow each other from the start of each text without overlap; each rolling block of every piece is looked up.
    A piece sends each different block once, with whether it is indexed there and whether it stands there several times.
    """
    block = (window + 1) // 2

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int64()), ("piece", pa.int64()), ("keys", pa.binary()), ("flags", pa.binary())])
        for batch in batches:
            for number, texts in zip(batch["piece"].to_pylist(), batch["texts"], strict=True):
                p = Piece(texts.as_py())
                key, there = p.anchors(window, buckets)
                at = np.flatnonzero(there)
                order = at[np.argsort(key[at], kind="stable")]
                if not len(order):
                    continue
                first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
                several = np.diff(np.append(first, len(order))) > 1
                indexed = np.logical_or.reduceat(p.place[order] % block == 0, first)
                different = key[order[first]]
                flags = indexed.astype(np.uint8) | (several.astype(np.uint8) << 1)
                rows = _dealt(number, different >> np.uint64(32), keys=different.astype("<u4"), flags=flags)
                yield pa.RecordBatch.from_pylist(list(rows), schema)

    def meet(table: pa.Table) -> pa.Table:
        keys, flags = (np.frombuffer(b"".join(table[c].to_pylist()), t) for c, t in (("keys", "<u4"), ("flags", np.uint8)))
        owner = np.repeat(np.arange(table.num_rows), [len(b) for b in table["flags"].to_pylist()])
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
        times = np.diff(np.append(first, len(keys)))
        known = np.bitwise_or.reduceat(flags[order], first)
        hit = np.repeat(((times > 1) | (known > 1)) & (known & 1 > 0), times)
        return _returned(table, owner[order[hit]], keys[order[hit]])

    sent = pieces.select("piece", "texts").mapInArrow(send, "bucket long, piece long, keys binary, flags binary")
    return materialize(sent.groupBy("bucket").applyInArrow(meet, "piece long, bucket long, keys binary"), "anchors")


def _returned(table: pa.Table, owner: np.ndarray, keys: np.ndarray) -> pa.Table:
    """Of each row of ``table``, by its number in ``owner``, its keys, sorted."""
    order = np.lexsort((keys, owner))
    owner, keys = owner[order], keys[order]
    edge = np.flatnonzero(np.diff(owner)) + 1
    bounds = list(zip(np.concatenate([[0], edge]).tolist(), np.concatenate([edge, [len(owner)]]).tolist(), strict=True)) if len(owner) else []
    rows = owner[[lo for lo, _ in bounds]] if bounds else np.zeros(0, np.int64)
    found = pa.array([keys[lo:hi].tobytes() for lo, hi in bounds], pa.binary())
    return pa.table({"piece": table["piece"].take(pa.array(rows)), "bucket": table["bucket"].take(pa.array(rows)), "keys": found})


def _with_keys(pieces: DataFrame, found: DataFrame) -> DataFrame:
    """Each piece with all that was returned to it, as an array of buckets and keys."""
    of_piece = found.groupBy("piece").agg(F.collect_list(F.struct("bucket", "keys")).alias("found"))
    return pieces.join(of_piece.hint("shuffle_hash"), "piece", "left")


def _anchor_starts(p: Piece, found: list[dict] | None, window: int, buckets: int) -> np.ndarray:
    """The starts of the windows of ``p`` that hold one of the anchors found."""
    if not found:
        return np.zeros(0, np.int64)
    key, there = p.anchors(window, buckets)
    known = np.concatenate([(np.uint64(x["bucket"]) << np.uint64(32)) | np.frombuffer(x["keys"], "<u4").astype(np.uint64) for x in found])
    return p.near(there & np.isin(key, known), window)


def _extended(marked: DataFrame, window: int, buckets: int) -> DataFrame:
    """``(piece, bucket, keys)``: the windows about anchors that stand at two places or more, by 64 bits and a bucket of other bits.

    So each anchor is extended over what is equal elsewhere, and windows that follow each other make up a maximal repeat. A piece sends
    each different window once.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int64()), ("piece", pa.int64()), ("keys", pa.binary()), ("several", pa.binary())])
        for batch in batches:
            for number, texts, found in zip(batch["piece"].to_pylist(), batch["texts"], batch["found"].to_pylist(), strict=True):
                if not found:
                    continue
                p = Piece(texts.as_py())
                at = _anchor_starts(p, found, window, buckets)
                bucket, key = _window_keys(p, at, window, buckets)
                order = np.lexsort((key, bucket))
                bucket, key = bucket[order], key[order]
                if not len(key):
                    continue
                first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])]))
                several = (np.diff(np.append(first, len(key))) > 1).astype(np.uint8)
                yield pa.RecordBatch.from_pylist(list(_dealt(number, bucket[first], keys=key[first].astype("<u8"), several=several)), schema)

    def meet(table: pa.Table) -> pa.Table:
        keys, several = (np.frombuffer(b"".join(table[c].to_pylist()), t) for c, t in (("keys", "<u8"), ("several", np.uint8)))
        owner = np.repeat(np.arange(table.num_rows), [len(b) for b in table["several"].to_pylist()])
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
        times = np.diff(np.append(first, len(keys)))
        hit = np.repeat((times > 1) | np.logical_or.reduceat(several[order], first), times)
        return _returned(table, owner[order[hit]], keys[order[hit]])

    sent = marked.mapInArrow(send, "bucket long, piece long, keys binary, several binary")
    return materialize(sent.groupBy("bucket").applyInArrow(meet, "piece long, bucket long, keys binary"), "repeats")


def _window_keys(p: Piece, at: np.ndarray, window: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    other = p.rolling(window, other=True)[at] >> np.uint64(64 - (buckets.bit_length() - 1))
    return other.astype(np.int64), p.rolling(window)[at]


def _repeated_starts(p: Piece, found: list[dict], window: int, buckets: int) -> np.ndarray:
    """The starts of the windows of ``p`` among those found."""
    at = np.flatnonzero(p.left >= window)
    bucket, key = _window_keys(p, at, window, buckets)
    known = np.concatenate([np.frombuffer(x["keys"], "<u8") for x in found])
    owner = np.repeat(np.array([x["bucket"] for x in found]), [len(x["keys"]) // 8 for x in found])
    order = np.lexsort((owner, known))
    known, owner = known[order], owner[order]
    lo, hi = np.searchsorted(known, key, "left"), np.searchsorted(known, key, "right")
    sure = (hi > lo) & (owner[np.minimum(lo, len(known) - 1)] == bucket)
    for k in np.flatnonzero(hi - lo > 1).tolist():  # one key in several buckets: next to never
        sure[k] = bucket[k] in owner[lo[k] : hi[k]]
    return at[sure]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, ``n_words``, ``n_removed``, ``spans`` (first word and the word after the last, of each maximal repeat) and ``text_col``, the kept words joined by one space.

    A word (no ASCII white space) is removed if a window of ``window`` words covers it whose words also start anywhere else, in the same
    row or another; all places of a repeat go, judged on the input. Any such window holds a whole one of the blocks of half a window
    that the text at its other place is cut into: those are indexed, and every rolling block is looked up. Windows about a hit are then
    known by 64 bits and, by their bucket, at least 10 further ones, more with more text. Only the two named columns are read. Null
    and empty texts have no words; a null id stays null; rows that repeat a text repeat each other, whatever their ids; an empty table gives an
    empty one. A piece of text sends each different hash once, so a passage that many documents share is as many rows as there are
    pieces, not pairs; texts of any length are handled whole.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    pieces, buckets = _pieces(docs, id_col, text_col)
    anchors = _anchored(pieces, window, buckets)
    marked = _with_keys(pieces, anchors)
    repeats = _extended(marked.select("piece", "texts", "found"), window, buckets)
    discard(anchors)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for ids, texts, found in zip(batch["ids"], batch["texts"], batch["found"].to_pylist(), strict=True):
                texts = texts.as_py()
                p = Piece(texts)
                gone = np.zeros(len(p.hashes) + 1, bool)
                if found:
                    at = _repeated_starts(p, found, window, buckets)
                    edge = np.zeros(len(p.hashes) + 1, np.int64)
                    edge[at] += 1
                    edge[at + window] -= 1
                    gone = np.cumsum(edge) > 0
                rows = {"n_words": [], "n_removed": [], "spans": [], "text": []}
                for t, lo, n in zip(texts, p.first.tolist(), p.counts.tolist(), strict=True):
                    words = (t or "").encode("utf-8", "surrogatepass").split()
                    out = gone[lo : lo + n]
                    change = np.flatnonzero(np.diff(out.astype(np.int8), prepend=0, append=0))
                    rows["n_words"].append(n)
                    rows["n_removed"].append(int(out.sum()))
                    rows["spans"].append([{"start": a, "end": b} for a, b in change.reshape(-1, 2).tolist()])
                    rows["text"].append(b" ".join(compress(words, (~out).tolist())).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(rows["n_words"], pa.int64()), pa.array(rows["n_removed"], pa.int64()), pa.array(rows["spans"], span), pa.array(rows["text"], pa.string())], ["_id", "n_words", "n_removed", "spans", "_kept"])

    found = _with_keys(pieces, repeats)
    done = found.select("ids", "texts", "found").mapInArrow(cut, f"_id {kind}, n_words long, n_removed long, spans array<struct<start:int,end:int>>, _kept string")
    return done.select(F.col("_id").alias(id_col), "n_words", "n_removed", "spans", F.col("_kept").alias(text_col))
