"""Quality classifier: similarity-weighted votes of the nearest labelled documents in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopia.llm.words import Words, mixed, pieces
from canopia.plans.shared import bounded_batches

#: At most so many labelled documents are fitted and broadcast (their vectors: SAMPLE x RANK numbers).
SAMPLE = 4096
SHAPES, WORDS, RANK, NEIGHBOURS, POWER = 1024, 4096, 32, 15, 8
TERMS = SHAPES + WORDS
#: The latent space of the words counts so much beside that of the shapes in a cosine.
WORD_SHARE = 0.3
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.7
BATCH = 512
#: Labelled rows whose counts are dense at once while the model is fitted: 5 MB.
FITTED = 256
#: Repeats of a word are looked for this far back.
BACK = 8

# Classes of bytes: letters of either case and digits are runs, every other sign stands for itself.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = 48, 65, 97, 97


def terms(texts: list[str | None]) -> np.ndarray:
    """``(texts, TERMS)`` counts of each text's terms, by hash: first SHAPES columns of shapes, pairs of shapes, and words said again shortly before,
    then WORDS columns of the words themselves (A-Z lower-cased) and pairs of words.

    A shape is a word with each run of small letters, capitals or digits as one sign. Null and empty texts count nothing.
    """
    out = np.zeros((len(texts), TERMS), np.float32)
    for first, part in pieces(texts):
        w = Words(part, lower=False)
        if not len(w.starts):
            continue
        kind = _CLASS[w.raw]
        keep = np.ones(len(kind), bool)
        keep[1:] = (kind[1:] != kind[:-1]) | (w.raw[1:] < 48)
        place = np.concatenate([[0], np.cumsum(keep)])
        shape = w.hashes(kind[keep], place[w.starts], place[w.ends])
        word = Words(part).hashes()
        with np.errstate(over="ignore"):
            same = w.owner[1:] == w.owner[:-1]
            pair = (shape[:-1] * np.uint64(3) + shape[1:])[same]
            words = mixed(word[:-1] * np.uint64(3) + word[1:])[same]
        found = [(w.owner, shape), (w.owner[1:][same], pair)]
        for back in range(1, min(BACK, len(word) - 1) + 1):
            again = np.flatnonzero((word[back:] == word[:-back]) & (w.owner[back:] == w.owner[:-back])) + back
            found.append((w.owner[again], np.full(len(again), back, np.uint64)))
        column = [o.astype(np.int64) * TERMS + (h % np.uint64(SHAPES)).astype(np.int64) for o, h in found]
        column += [o.astype(np.int64) * TERMS + SHAPES + (h % np.uint64(WORDS)).astype(np.int64) for o, h in ((w.owner, word), (w.owner[1:][same], words))]
        at = np.concatenate(column)
        out[first : first + len(part)] += np.bincount(at, minlength=len(part) * TERMS).reshape(len(part), TERMS)
    return out


class Counts:
    """Rows of :func:`terms` kept as what occurs in them; a slice is a dense block, so only a block of them is dense at once."""

    def __init__(self, rows: list[bytes]) -> None:
        """``rows`` hold pairs of two bytes each: column and count."""
        self.rows = rows

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, part: slice) -> np.ndarray:
        rows = self.rows[part]
        out = np.zeros((len(rows), TERMS), np.float32)
        for x, r in zip(out, rows, strict=True):
            at, n = np.frombuffer(r, "<u2").reshape(-1, 2).T
            x[at] = n
        return out


def _leading(blocks: Callable[[], Iterator[np.ndarray]], columns: int) -> np.ndarray:
    """The RANK leading right singular vectors of a matrix that comes as blocks of its rows, by subspace iteration."""
    q = np.random.default_rng(1).standard_normal((columns, RANK + 8)).astype(np.float32)
    for _ in range(8):
        q = np.linalg.qr(sum(x.T @ (x @ q) for x in blocks()))[0]
    values, turn = np.linalg.eigh(sum(y.T @ y for y in ((x @ q).astype(np.float64) for x in blocks())))
    return q @ turn[:, np.argsort(-values, kind="stable")[:RANK]].astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 1e-12)


class Model:
    """The labelled vectors of a fitted classifier; small enough to be broadcast by its fixed sizes.

    Shapes and words have a latent space each, fitted on the labelled texts; a text's vector is its place in both.
    """

    def __init__(self, counts: Counts, labels: np.ndarray) -> None:
        dense = lambda: (counts[i : i + FITTED] for i in range(0, len(counts), FITTED))
        self.idf = (np.log((1 + len(counts)) / (1 + sum(((x > 0).sum(0) for x in dense()), np.zeros(TERMS, np.int64)))) + 1).astype(np.float32)
        spaces = [(lambda k=k: (self._weighted(x)[k] for x in dense()), n) for k, n in enumerate((SHAPES, WORDS))]
        self.axes = [_leading(*x) if len(counts) else np.zeros((x[1], RANK), np.float32) for x in spaces]
        self.vectors, self.labels = np.concatenate([np.zeros((0, 2 * RANK)), *(self.latent(x) for x in dense())]), labels.astype(np.float64)
        self.prior = float(labels.mean()) if len(labels) else 0.5

    def _weighted(self, counts: np.ndarray) -> list[np.ndarray]:
        """The rows of both spaces, weighted, of length 1."""
        x = np.log1p(counts) * self.idf
        return [_unit(x[:, :SHAPES]), _unit(x[:, SHAPES:])]

    def latent(self, counts: np.ndarray) -> np.ndarray:
        """Unit vectors: the product of two is (1 - WORD_SHARE) x the cosine of the shapes + WORD_SHARE x that of the words."""
        parts = [_unit((x @ axes).astype(np.float64)) for x, axes in zip(self._weighted(counts), self.axes, strict=True)]
        return _unit(np.concatenate([np.sqrt(1 - WORD_SHARE) * parts[0], np.sqrt(WORD_SHARE) * parts[1]], 1))

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Votes of the NEIGHBOURS most similar labelled vectors, weighted by cosine to a power; without any, the share of label 1."""
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        cosine = self.latent(counts) @ self.vectors.T
        k = min(NEIGHBOURS, cosine.shape[1])
        at = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.clip(np.take_along_axis(cosine, at, 1), 0, 1) ** POWER
        total = weight.sum(1)
        votes = (weight * self.labels[at]).sum(1)
        return np.where(total > 1e-12, votes / np.where(total > 1e-12, total, 1), self.prior)


def held_out(id_col: str) -> Column:
    """Whether a document's fold is the one whose labels are never learnt from; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents outside the held-out fold, chosen by a hash of the id.

    Rows of ``labels`` with a null id or label are left out; of several labels of a document the least counts.
    """
    chosen = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
        .where(F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & ~held_out("_id"))
        .orderBy(F.xxhash64("_id"), "_id", "_label").limit(sample)
        .groupBy("_id").agg(F.min("_label").alias("_label"))
    )
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), BATCH):
                p = b.iloc[i : i + BATCH]
                some = [(np.flatnonzero(x), x) for x in terms(p["_text"].tolist())]
                pairs = [np.stack([at, np.minimum(x[at], 65535)], 1).astype("<u2").tobytes() for at, x in some]
                yield pd.DataFrame({"id": p["_id"].astype(str), "label": p["_label"], "counts": pairs})

    # The terms of each chosen row that occur, as pairs of two bytes each: at most sample x TERMS x 4 bytes reach the driver.
    # Of different texts under one id the one with the least counts is taken.
    each = texts.mapInPandas(count, "id string, label int, counts binary").groupBy("id").agg(F.min(F.struct("counts", "label")).alias("_row"))
    rows = each.select("id", "_row.*").orderBy("id").collect()
    return Model(Counts([bytes(r["counts"]) for r in rows]), np.array([r["label"] for r in rows], np.int64))


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE,
    threshold: float = THRESHOLD, names: tuple[str, str, str] = ("held_out", "score", "predicted"),
) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (1 from ``threshold`` on), or other ``names``.

    Every whole text is compared with all labelled vectors, a block of rows at a time, in one pass without a shuffle.
    Columns of ``docs`` with those names are replaced, all others stay. Texts without words (null, empty, blank) get the share
    of label 1 among the labelled; without any label every score is 0.5. Repeated rows get equal scores.
    """
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col, sample))

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        values = texts.tolist()
        done = [model.value.scores(terms(values[i : i + BATCH])) for i in range(0, len(values), BATCH)]
        return pd.Series(np.concatenate(done) if done else np.zeros(0))

    fold, score, predicted = names
    rest = [c for c in docs.columns if c not in names]
    scored = docs.select(*rest, held_out(id_col).alias(fold), of(F.col(text_col)).alias(score))
    return scored.withColumn(predicted, (F.col(score) >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with the columns they came with.

    Texts without words (null, empty, blank) score the share of label 1 among the labelled, and go if that is below the threshold.
    """
    scored = score_quality(docs, labels, id_col, text_col, names=("__held_out", "__score", "__predicted"))
    return scored.where("__predicted = 1").select(*docs.columns)
