"""Ranked lexical search: an index in shards of documents, scored term by term with whole numbers."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopia.plans.shared import bounded_batches, broadcast_if_small, materialize

#: A term is a longest run of none of these characters, with A-Z lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Terms of a shard's documents together, from which on a new shard begins: its postings are some 2 MB.
SHARD_TERMS = 1 << 18
#: (item, term) pairs that are sent to all tasks at once; more queries are answered in several passes.
BLOCK_TERMS = 200_000
#: Part of a term's weight that does not depend on the document's length, in hundredths, and the scale of an impact.
FLAT, SCALE = 10, 1_000_000_000

_BREAKS = bytes(b if chr(b).isalnum() and b < 0x80 or b >= 0x80 else 0x20 for b in range(256))


def _terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_BREAKS).split()


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _packed(numbers: np.ndarray) -> bytes:
    """The numbers, none below 0, in as few bytes each as the largest takes."""
    return numbers.astype(np.min_scalar_type(int(numbers.max())).newbyteorder("<")).tobytes()


class Shard:
    """Collects documents and lays their postings out as compressed sparse rows: of each term its documents, in order of their ids, with its times in each."""

    def __init__(self) -> None:
        self._ids: list = []
        self._words: list[np.ndarray] = []
        self._number: defaultdict[bytes, int] = defaultdict()
        self._number.default_factory = self._number.__len__
        self.size = 0

    def add(self, i: object, words: list[bytes]) -> None:
        self._ids.append(i)
        self._words.append(np.fromiter(map(self._number.__getitem__, words), np.int64, len(words)))
        self.size += len(words)

    def row(self) -> dict:
        order = sorted(range(len(self._ids)), key=lambda k: (self._ids[k] is not None, self._ids[k] if self._ids[k] is not None else 0))
        words = [self._words[k] for k in order]
        counts = np.array([len(w) for w in words], np.int64)
        pairs, tf = np.unique(np.concatenate(words) * len(words) + np.repeat(np.arange(len(words)), counts), return_counts=True)
        term, place = np.divmod(pairs, len(words))
        return {
            "ids": [self._ids[k] for k in order], "lengths": counts, "terms": [t.decode("utf-8", "surrogatepass") for t in self._number], "df": np.bincount(term, minlength=len(self._number)),
            "places": _packed(place), "times": _packed(tf),
        }


def impacts(times: np.ndarray, places: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Of each posting ``(SCALE * tf) div (1000 * tf + 8 * m)``, where m is FLAT hundredths and the rest in proportion to the document's length over the mean."""
    m = np.array([FLAT + (100 - FLAT) * n * n_docs // n_terms for n in lengths.tolist()], np.int64)
    tf = times.astype(np.int64)
    return SCALE * tf // (1000 * tf + 8 * m[places])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_terms: int = SHARD_TERMS) -> tuple[DataFrame, int]:
    """The index, a row for each shard, in a written table: ``ids``, ``lengths`` (terms of each document), ``terms``, ``df`` (documents of each term), and as bytes, of equal width in a shard, ``places`` and ``times``; and N.

    One scan of the texts, no shuffle. The documents with terms (N) and their terms are counted from the shards, so impacts are made when
    a shard is searched. Documents without a term are in no shard.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.select(F.col(id_col).alias("ids")).schema["ids"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard()
        schema = None
        for batch in batches:
            schema = schema or pa.schema([("ids", pa.list_(batch.schema.field("_id").type)), ("lengths", pa.list_(pa.int32())), ("terms", pa.list_(pa.string())), ("df", pa.list_(pa.int32())), ("places", pa.binary()), ("times", pa.binary())])
            for i, t in zip(batch["_id"].to_pylist(), batch["_text"].to_pylist(), strict=True):
                if words := _terms(t):
                    shard.add(i, words)
                if shard.size >= shard_terms:
                    yield pa.RecordBatch.from_pylist([shard.row()], schema)
                    shard = Shard()
        if shard.size:
            yield pa.RecordBatch.from_pylist([shard.row()], schema)

    shards = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"ids array<{kind}>, lengths array<int>, terms array<string>, df array<int>, places binary, times binary")
    index = materialize(shards, "search_index")
    return index, index.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]


def top_places(scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` highest scores above 0; of equal scores at the edge the lowest places."""
    if np.count_nonzero(scores) <= k:
        return np.flatnonzero(scores)
    least = scores[np.argpartition(scores, len(scores) - k)[-k:]].min()
    above = np.flatnonzero(scores > least)
    return np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])


def _best(index: DataFrame, n_docs: int, n_terms: int, items: list[list[tuple[str, int]]], k: int) -> DataFrame:
    """``(_item, _id, score)``: of each item, by its number in ``items``, the ``k`` best documents of each shard."""
    sent = index.sparkSession.sparkContext.broadcast(items)
    kind = index.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = {t: j for j, t in enumerate(dict.fromkeys(t for item in sent.value for t, _ in item))}
        of = [(np.array([wanted[t] for t, _ in item], np.int64), [w for _, w in item]) for item in sent.value]
        names = pa.array(list(wanted), pa.string())
        for batch in batches:
            for s in range(batch.num_rows):
                shard = {c: batch.column(c)[s] for c in batch.schema.names}
                ids = shard["ids"].values
                where = pc.fill_null(pc.index_in(names, value_set=shard["terms"].values), -1).to_numpy(zero_copy_only=False)
                ends = np.cumsum(shard["df"].values.to_numpy(), dtype=np.int64)
                starts = ends - shard["df"].values.to_numpy()
                places, times = (np.frombuffer(shard[c].as_buffer(), f"<u{len(shard[c].as_buffer()) // ends[-1]}") for c in ("places", "times"))
                impact = impacts(times, places, shard["lengths"].values.to_numpy(), n_docs, n_terms)
                found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for number, (terms, weights) in enumerate(of):
                    scores = np.zeros(len(ids), np.int64)
                    for t, w in zip(where[terms].tolist(), weights, strict=True):
                        if t >= 0:
                            scores[places[starts[t] : ends[t]]] += w * impact[starts[t] : ends[t]]
                    best = top_places(scores, k)
                    found.append((np.full(len(best), number), best, scores[best]))
                item, place, score = map(np.concatenate, zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), ids.take(pa.array(place)), pa.array(score, pa.int64())], ["_item", "_id", "score"])

    return index.mapInArrow(run, f"_item int, _id {kind}, score long")


def search(index: DataFrame, n_docs: int, queries: DataFrame, k: int = 10, item_col: str = "item_id", text_col: str = "text", id_col: str = "doc_id", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_col``, ``rank`` (from 1), ``id_col``, ``score``: the ``k`` highest-scoring documents above 0 of each item, equal scores by ascending id (nulls first).

    A score adds up weight times impact over the item's terms, once each; the weight is ``floor(1000 * ln((2N + 2) / (2df + 1)))``.
    Texts under one item id are one item; a null id is one, too. Items without terms, or with none that a document holds, have no rows;
    nor has an empty index. Documents that repeat an id are ranked one by one. ``queries`` go to all tasks in blocks of at most ``block_terms``
    different pairs of item and term (an item is never split); each block is one pass over the index. The shards' best meet in
    a window whose rows are cut to ``k`` before they are shuffled.
    """
    bounded_batches(index.sparkSession)
    n_terms = index.agg(F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, n: s + n)), F.lit(0))).first()[0]
    pairs = queries.select(F.col(item_col).alias("_key"), F.explode(F.regexp_extract_all(lower_ascii(F.col(text_col)), F.lit(TERM), F.lit(0))).alias("_term")).distinct()
    pairs = materialize(pairs, "search_terms")
    wanted = broadcast_if_small(materialize(pairs.select("_term").distinct(), "search_words"))
    held = index.select(F.explode(F.arrays_zip("terms", "df")).alias("_x")).select(F.col("_x.terms").alias("_term"), F.col("_x.df").alias("_df")).join(wanted, "_term")
    df = held.groupBy("_term").agg(F.sum("_df").alias("_df"))
    weight = F.floor(F.lit(1000.0) * F.log((2.0 * n_docs + 2) / (2 * F.col("_df") + 1))).cast("long")
    weighed = materialize(pairs.join(df, "_term").select("_key", F.struct(F.col("_term").alias("t"), weight.alias("w")).alias("_x")), "search_weights")
    sizes = weighed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    blocks = -(-weighed.count() // block_terms)
    while True:  # items are dealt to blocks by a hash; more blocks until none is too large, or only by one item
        dealt = sizes.withColumn("_block", F.pmod(F.xxhash64("_key"), F.lit(max(blocks, 1))))
        largest = dealt.groupBy("_block").agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_items")).where((F.col("_all") > block_terms) & (F.col("_items") > 1))
        if largest.isEmpty():
            break
        blocks *= 2
    of_block = weighed.withColumn("_block", F.pmod(F.xxhash64("_key"), F.lit(max(blocks, 1))))
    parts = []
    for b in range(blocks):
        items = of_block.where(F.col("_block") == b).groupBy("_key").agg(F.sort_array(F.collect_list("_x")).alias("_all")).collect()
        if items:
            names = queries.sparkSession.createDataFrame([(number, r["_key"]) for number, r in enumerate(items)], f"_item int, _key {queries.schema[item_col].dataType.simpleString()}")
            parts.append(_best(index, n_docs, n_terms, [[(x["t"], x["w"]) for x in r["_all"]] for r in items], k).join(F.broadcast(names), "_item"))
    if not parts:
        parts = [_best(index.limit(0), 0, 0, [[]], k).withColumn("_key", F.lit(None).cast(queries.schema[item_col].dataType))]
    rank = F.row_number().over(Window.partitionBy("_key").orderBy(F.col("score").desc(), "_id"))
    ranked = reduce(DataFrame.unionByName, parts).withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select(F.col("_key").alias(item_col), "rank", F.col("_id").alias(id_col), "score")


def rank_documents(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """:func:`search` of all ``queries`` (``item_id``, ``text``) over an index of all ``docs`` (``doc_id``, ``text``)."""
    index, n_docs = build_index(docs)
    return search(index, n_docs, queries, k)
