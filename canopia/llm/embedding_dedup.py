"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations, with multiprobe buckets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopia.llm.buckets import compare_buckets, forest, runs
from canopia.operators.components import connected_components
from canopia.plans.shared import materialize

#: Probes of each table, and vertices tried for each hash.
PROBES, RANKS, SEED = 4, 4, 5
#: Vectors of one bucket that the number of hashes aims at, at most; of pairs at just the threshold at least RECALL meet, by trial with TRIALS pairs.
OCCUPANCY, RECALL, TRIALS = 256, 0.995, 2000
BLOCK = 2048
STEP = 512


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal fast Walsh-Hadamard transform of rows whose length is a power of 2."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def probes(unit: np.ndarray, tables: int, hashes: int, n_probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """``(rows, tables, probes)`` bucket codes, the likeliest first: nearest vertices of randomly rotated cross-polytopes."""
    d = 1 << max(1, (unit.shape[1] - 1).bit_length())
    x0 = np.zeros((len(unit), d))
    x0[:, : unit.shape[1]] = unit
    ranks = min(RANKS, d)
    out = []
    for table in range(tables):
        random = np.random.default_rng(seed + table)
        cost, code = np.zeros((len(x0), 1)), np.zeros((len(x0), 1), np.int64)
        for _ in range(hashes):
            x = x0
            for _ in range(3):
                x = hadamard(x * random.choice([-1.0, 1.0], d))
            size = np.abs(x)
            at = np.argsort(-size, 1, kind="stable")[:, :ranks]
            top = np.take_along_axis(size, at, 1)
            vertex = 2 * at + (np.take_along_axis(x, at, 1) < 0)
            cost = (cost[:, :, None] + ((top[:, :1] - top) ** 2)[:, None, :]).reshape(len(x0), -1)
            code = (code[:, :, None] * (2 * d) + vertex[:, None, :]).reshape(len(x0), -1)
            if cost.shape[1] > n_probes:  # no prefix beyond the likeliest can be among the likeliest
                at = np.argsort(cost, 1, kind="stable")[:, :n_probes]
                cost, code = np.take_along_axis(cost, at, 1), np.take_along_axis(code, at, 1)
        best = np.argsort(cost, 1, kind="stable")[:, :n_probes]
        out.append(np.take_along_axis(code, best, 1))
    return np.stack(out, 1)


def plan(vectors: int, dim: int, threshold: float) -> tuple[int, int]:
    """Tables and hashes of each table for so many different vectors.

    A bucket's share of far vectors falls by 2 x dim with each hash, so the hashes grow with the logarithm of the number of
    vectors, and buckets stay short at any size. Random pairs at just the threshold then tell how many tables it takes.
    """
    d = 1 << max(1, (dim - 1).bit_length())
    hashes = 2
    while vectors * PROBES > OCCUPANCY * (2 * d) ** hashes:
        hashes += 1
    r = np.random.default_rng(SEED + 1)
    a, b = r.standard_normal((2, TRIALS, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    n = np.linalg.norm(b, axis=1, keepdims=True)
    b = threshold * a + np.sqrt(max(1 - threshold * threshold, 0)) * np.divide(b, n, out=np.zeros_like(b), where=n > 1e-9)
    apart, tables = np.ones(TRIALS, bool), 0
    while tables < 4 or apart.mean() > 1 - RECALL:
        x, y = (probes(v, 1, hashes, seed=SEED + tables)[:, 0] for v in (a, b))
        apart &= ~(x[:, :, None] == y[:, None, :]).any((1, 2))
        tables += 1
        if tables == 64:
            break
    return tables, hashes


def _scaled(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1)[:, None]  # so that squares of tiny or huge components stay finite
    return x / np.linalg.norm(x, axis=1)[:, None]


def _units(vectors: pd.Series) -> np.ndarray:
    return _scaled(np.array(vectors.tolist(), np.float64))


def _index(plans: dict[int, tuple[int, int]], single: bool):
    """Rows ``(dim, tbl, code, node, mult, vec)`` for each table and probe of each vector; ``vec`` in the precision that it came in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, part in b.groupby(b["vec"].map(len), sort=False):
                for i in range(0, len(part), 4096):
                    p = part.iloc[i : i + 4096]
                    code = probes(_units(p["vec"]), *plans[int(dim)])
                    n, t, k = code.shape
                    vec = p["vec"].map(lambda v: np.asarray(v, np.float32 if single else np.float64).tobytes())
                    yield pd.DataFrame({
                        "dim": np.full(n * t * k, dim), "tbl": np.tile(np.repeat(np.arange(t), k), n), "code": code.reshape(-1),
                        "node": np.repeat(p["node"].to_numpy(), t * k), "mult": np.repeat(p["mult"].to_numpy(), t * k), "vec": np.repeat(vec.to_numpy(), t * k),
                    })

    return run


def _compare(threshold: float, plans: dict[int, tuple[int, int]], single: bool):
    def first_meeting(a: np.ndarray, b: np.ndarray, tbl: int, code: int) -> np.ndarray:
        """Whether pairs of code rows meet in no earlier table and in no smaller bucket of this one."""
        new = np.ones(len(a), bool)
        for t in range(tbl):
            new &= ~(a[:, t, :, None] == b[:, t, None, :]).any((1, 2))
        both = (a[:, tbl, :, None] == b[:, tbl, None, :]).any(2)
        return new & (np.where(both, a[:, tbl], np.iinfo(np.int64).max).min(1) == code)

    def compare(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        label, side = batch["_bucket"].to_numpy(), batch["_side"].to_numpy()
        node, mult = batch["node"].to_numpy(), batch["mult"].to_numpy()
        tbl, code = batch["tbl"].to_numpy(), batch["code"].to_numpy()
        n_src, n_links, e_src, e_dst = [], [], [], []
        for lo, hi in runs(label):
            x = _scaled(np.frombuffer(b"".join(batch["vec"].iloc[lo:hi]), np.float32 if single else np.float64).reshape(hi - lo, -1).astype(np.float64))
            links = np.zeros(hi - lo, np.int64)
            codes: np.ndarray | None = None
            for i in range(0, hi - lo, STEP):
                for j in range(i, hi - lo, STEP):
                    a, b = slice(i, min(i + STEP, hi - lo)), slice(j, min(j + STEP, hi - lo))
                    near = x[a] @ x[b].T >= threshold
                    if side[lo] >= 0:
                        near &= side[lo:hi][a][:, None] != side[lo:hi][b][None, :]
                    if i == j:
                        near = np.triu(near, 1)
                    r, c = np.nonzero(near)
                    if not len(r):
                        continue
                    if codes is None:
                        codes = probes(x, *plans[x.shape[1]])
                    r, c = r + i, c + j
                    new = np.concatenate([first_meeting(codes[r[k : k + 65536]], codes[c[k : k + 65536]], tbl[lo], code[lo]) for k in range(0, len(r), 65536)])
                    r, c = r[new], c[new]
                    np.add.at(links, r, mult[lo:hi][c])
                    np.add.at(links, c, mult[lo:hi][r])
                    s, d = forest(r, c, hi - lo)
                    e_src.append(node[lo:hi][s])
                    e_dst.append(node[lo:hi][d])
            some = np.flatnonzero(links)
            n_src.append(node[lo:hi][some])
            n_links.append(links[some])
        for src, dst, n in ((n_src, None, n_links), (e_src, e_dst, None)):
            if src and len(s := np.concatenate(src)):
                yield pd.DataFrame({"src": s, "dst": np.concatenate(dst) if dst is not None else s, "n": np.concatenate(n) if n is not None else np.zeros(len(s), np.int64)})

    return compare


def embedding_groups(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, block: int = BLOCK
) -> DataFrame:
    """Per row: ``id_col``, ``n_links`` (other vectors at cosine >= threshold), ``component_id`` (smallest id reachable), ``kept``.

    Equal vectors are one node weighted by their number. The node's other links are counted in the buckets where a
    pair first meets, block by block, and only a spanning forest leaves a task. Vectors that are null, empty, zero, hold
    null or non-finite components, or have no id link with nothing: 0 links and their own id as component. Vectors of
    different lengths never link. Ids are taken to name one vector; repeated rows with one id and vector count as vectors.
    """
    v = F.col("vec")
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("vec"))
    valid = F.coalesce(F.col("_id").isNotNull() & finite & F.exists(v, lambda e: e != 0), F.lit(False))
    good = rows.where(valid)
    nodes = materialize(good.groupBy("vec").agg(F.min("_id").alias("node"), F.count(F.lit(1)).alias("mult")), "vectors")
    # Vectors that come in single precision travel in it: their numbers are the same.
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    # As many rows as there are lengths of vectors in use.
    plans = {r["d"]: plan(r["n"], r["d"], threshold) for r in nodes.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    # One vector's codes are made together, so the index is one narrow pass over the different vectors.
    index = nodes.mapInPandas(_index(plans, single), "dim int, tbl int, code long, node long, mult long, vec binary")
    met = materialize(compare_buckets(index, ["dim", "tbl", "code"], "node", _compare(threshold, plans, single), "src long, dst long, n long", block), "met")
    groups = connected_components(met.where("src <> dst").select("src", "dst"))
    others = met.groupBy("src").agg(F.sum("n").alias("n_other"))
    named = (
        nodes.select("vec", "node", "mult").join(others, F.col("node") == F.col("src"), "left").drop("src")
        .join(groups.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
        .select(F.col("vec").alias("_vec"), (F.coalesce("n_other", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    )
    linked = good.join(named, F.col("vec") == F.col("_vec")).select("_id", "n_links", "component_id")
    alone = rows.where(~valid).select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("_id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("_id") == F.col("component_id"), F.lit(False)).alias("kept")
    )
