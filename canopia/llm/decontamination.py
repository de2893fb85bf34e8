"""Benchmark decontamination by a hash set of normalised n-grams, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopia.plans.shared import broadcast_if_small, materialize

WINDOW = 10
#: Windows of the benchmark that one broadcast may hold (about 300 bytes each); beyond it the same join is shuffled.
BROADCAST_WINDOWS = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text: A-Z lower-cased, then runs of digits, a-z and everything beyond ASCII; null has none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD), lambda w: w != "")


def _gram_hash(words: Column, at: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(words, at + k) for k in range(n)])


def _windows(items: DataFrame, item_id: str, text: str, n: int) -> DataFrame:
    """Different windows ``(len, gram, items)``: n words in a row, or the whole of a shorter item."""
    w = items.select(F.col(item_id).alias("_item"), words_of(F.col(text)).alias("_w")).where(F.size("_w") > 0)
    length = F.least(F.size("_w"), F.lit(n))
    at = F.explode(F.sequence(F.lit(0), F.size("_w") - length))
    grams = w.select("_item", length.alias("_len"), "_w", at.alias("_at")).select("_item", "_len", F.slice("_w", F.col("_at") + 1, F.col("_len")).alias("_gram"))
    return grams.groupBy("_len", "_gram").agg(F.array_sort(F.collect_set(F.col("_item").cast("string"))).alias("_items"))


def _hits(docs: DataFrame, windows: DataFrame, lengths: list[int], small: bool) -> DataFrame:
    """``(_id, _hash, _at, _len, _items)``: every occurrence of a window in a document."""
    out = None
    for n in lengths:
        known = windows.where(F.col("_len") == n).select(_gram_hash(F.col("_gram"), F.lit(0), n).alias("_key"), F.col("_gram"), "_items")
        known = F.broadcast(known) if small else known
        at = docs.where(F.size("_words") >= n).select("_id", "_hash", "_words", F.posexplode("_words").alias("_at", "_first"))
        at = at.where(F.col("_at") <= F.size("_words") - n).withColumn("_hashed", _gram_hash(F.col("_words"), F.col("_at"), n))
        same = F.col("_hashed") == F.col("_key")
        if small:
            for k in range(n):  # verified word by word: equal hashes are not trusted
                same = same & (F.get("_words", F.col("_at") + k) == F.get("_gram", F.lit(k)))
        else:  # a shuffled row carries its own n words only
            at = at.select("_id", "_hash", "_at", "_hashed", F.slice("_words", F.col("_at") + 1, n).alias("_own"))
            same = same & (F.col("_own") == F.col("_gram"))
        found = at.join(known, same).select("_id", "_hash", "_at", F.lit(n).alias("_len"), "_items")
        out = found if out is None else out.unionByName(found)
    return out


def _hit_documents(base: DataFrame, benchmark: DataFrame, item_col: str, item_text: str, n: int, broadcast_windows: int) -> DataFrame | None:
    """``(_id2, _hash2, _n_hit, _all, _spans)`` of the documents that hold a window; None if the benchmark has no words."""
    windows = _windows(benchmark, item_col, item_text, n)
    sizes = {r["_len"]: r["count"] for r in windows.groupBy("_len").count().collect()}  # n rows at most
    if not sizes:
        return None
    found = _hits(base, windows, sorted(sizes), sum(sizes.values()) <= broadcast_windows)
    # Occurrences that touch become one span; a repeated row adds nothing, as its spans are the same.
    doc = Window.partitionBy("_id", "_hash").orderBy("_at", "_len")
    end = F.col("_at") + F.col("_len")
    before = F.max(end).over(doc.rowsBetween(Window.unboundedPreceding, -1))
    spans = (
        found.withColumn("_new", F.coalesce((F.col("_at") > before).cast("int"), F.lit(1)))
        .withColumn("_span", F.sum("_new").over(doc))
        .groupBy("_id", "_hash", "_span")
        .agg(F.min("_at").alias("start"), F.max(end).alias("end"), F.array_distinct(F.flatten(F.collect_set("_items"))).alias("_items"))
    )
    return spans.groupBy("_id", "_hash").agg(
        F.sum(F.col("end") - F.col("start")).cast("long").alias("_n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_items")))).alias("_all"),
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_spans"),
    ).select(F.col("_id").alias("_id2"), F.col("_hash").alias("_hash2"), "_n_hit", "_all", "_spans")


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", n: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """Per row of ``docs``: ``id_col``, ``n_words``, ``n_hit``, ``n_items``, ``items`` (sorted strings), ``spans`` of hit words.

    ``spans`` are disjoint ``(start, end)`` word positions, end exclusive, in order. Only the named columns are read.
    Null and empty texts have no words; items without words have no windows; null item ids name nothing; with an empty
    benchmark nothing is hit. Repeated rows come out as often as they came in, with equal values. The windows are
    broadcast if there are at most ``broadcast_windows``, counted first; more are joined by a shuffle on their hash.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), words_of(F.col(text_col)).alias("_words"))
    counts = base.select("_id", "_hash", F.size("_words").cast("long").alias("n_words"))
    no_items, no_spans = F.array().cast("array<string>"), F.array().cast("array<struct<start:int,end:int>>")
    per_doc = _hit_documents(base, benchmark, item_col, item_text, n, broadcast_windows)
    if per_doc is None:
        zero = F.lit(0).cast("long")
        return counts.select(F.col("_id").alias(id_col), "n_words", zero.alias("n_hit"), zero.alias("n_items"), no_items.alias("items"), no_spans.alias("spans"))
    joined = counts.join(per_doc, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_hash") == F.col("_hash2")), "left")
    return joined.select(
        F.col("_id").alias(id_col), "n_words", F.coalesce("_n_hit", F.lit(0)).alias("n_hit"),
        F.when(F.col("_all").isNull(), 0).otherwise(F.size("_all")).cast("long").alias("n_items"),
        F.coalesce("_all", no_items).alias("items"), F.coalesce("_spans", no_spans).alias("spans"),
    )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", n: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs, with all their columns; see :func:`contamination`.

    The texts themselves are not shuffled as long as the ids of the hit documents can be broadcast.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), words_of(F.col(text_col)).alias("_words"))
    per_doc = _hit_documents(base, benchmark, item_col, item_text, n, broadcast_windows)
    if per_doc is None:
        return docs
    hit = broadcast_if_small(materialize(per_doc.select("_id2", "_hash2"), "hit"))
    return docs.join(hit, F.col(id_col).eqNullSafe(F.col("_id2")) & (F.xxhash64(text_col) == F.col("_hash2")), "left_anti")
