"""Writing results: one file for each tree as PLY or OBJ, cylinder text tables, CSV summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CYLINDER_COLUMNS = ["radius", "length", "sx", "sy", "sz", "ax", "ay", "az", "parent", "extension", "branch", "branch_order", "position", "added"]


def ply_files(points: DataFrame, by: str = "tree_id") -> DataFrame:
    """``by, content``: each group as a little-endian binary PLY file; x, y, z and other numbers as floats, red, green, blue as ints."""
    names = [c for c in points.columns if c not in (by, "pid")]
    kinds = [(c, "int" if c in ("red", "green", "blue") else "float") for c in names]
    dtype = np.dtype([(c, "<i4" if k == "int" else "<f4") for c, k in kinds])

    def one(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros(len(b), dtype)
        for c in names:
            a[c] = b[c].to_numpy()
        lines = ["ply", "format binary_little_endian 1.0", f"element vertex {len(b)}", *(f"property {k} {c}" for c, k in kinds), "end_header", ""]
        return pd.DataFrame({by: [key[0]], "content": ["\n".join(lines).encode() + a.tobytes()]})

    kind = points.schema[by].dataType.simpleString()
    return points.groupBy(by).applyInPandas(one, f"{by} {kind}, content binary")


def obj_lines(vertices: DataFrame, faces: DataFrame, by: str = "tree_id") -> DataFrame:
    """``by, part, k, line``: lines of an OBJ file, vertices before faces; sorted by part and k they are the file. Vertex numbers count from 1 over the group."""
    v = vertices.select(by, F.lit(0).alias("part"), F.col("vid").cast("long").alias("k"), F.format_string("v %.4f %.4f %.4f", "x", "y", "z").alias("line"))
    f = faces.select(by, F.lit(1).alias("part"), F.col("fid").cast("long").alias("k"), F.format_string("f %d %d %d", "v1", "v2", "v3").alias("line"))
    return v.unionByName(f)


def cylinder_lines(cylinders: DataFrame, by: str = "tree_id", order: str = "cyl") -> DataFrame:
    """``by, order, line``: the 14 columns as tab-separated numbers; none is 0."""
    number = lambda c: F.format_string("%.7g", F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    have = [number(c) if c in cylinders.columns else F.lit("0") for c in CYLINDER_COLUMNS]
    return cylinders.select(by, order, F.concat_ws("\t", *have).alias("line"))


def save_lines(lines: DataFrame, folder: str, by: str, order: list[str]) -> None:
    """A folder ``by=value`` with one text file for each group, its lines in order."""
    lines.repartition(by).sortWithinPartitions(by, *order).select(by, "line").write.mode("overwrite").partitionBy(by).text(folder)


def save_files(files: DataFrame, folder: str, name: Column) -> None:
    """Write each row's ``content`` to a file of its own in a folder that all executors share (a mount, not a store)."""

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        for b in batches:
            for n, content in zip(b["name"], b["content"], strict=True):
                part = os.path.join(folder, f".{n}.part")
                with open(part, "wb") as f:
                    f.write(bytes(content))
                os.replace(part, os.path.join(folder, n))  # a task that runs again leaves one whole file
            yield pd.DataFrame({"n": [len(b)]})

    files.select(name.alias("name"), "content").mapInPandas(put, "n long").agg(F.sum("n")).collect()


def save_table(rows: DataFrame, path: str) -> None:
    """A summary as CSV with a header."""
    rows.write.mode("overwrite").option("header", "true").csv(path)


def save_model(tables: dict[str, DataFrame], folder: str, by: str = "tree_id") -> None:
    """A model's tables (cylinders, branches, tree attributes, distributions) as Parquet, a folder for each with one part a group."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").partitionBy(by).parquet(f"{folder}/{name}")


def number_lines(rows: DataFrame, columns: list[str], by: str = "tree_id", order: str = "k") -> DataFrame:
    """``by, order, line``: any table as tab-separated numbers in ``%g``; none is 0. For branch, tree and height tables as for cylinders."""
    return rows.select(by, order, F.concat_ws("\t", *[F.format_string("%.6g", F.coalesce(F.col(c).cast("double"), F.lit(0.0))) for c in columns]).alias("line"))


def ply_mesh_lines(vertices: DataFrame, faces: DataFrame, by: str = "tree_id", scalar: str | None = None) -> DataFrame:
    """``by, part, k, line``: the lines of an ascii PLY mesh, header, vertices (``vid, x, y, z`` and one number more) and faces (``fid, v1, v2, v3``, from 0)."""
    n = vertices.groupBy(by).agg(F.count(F.lit(1)).alias("_v")).join(faces.groupBy(by).agg(F.count(F.lit(1)).alias("_f")), by, "left")
    text = [F.lit("ply"), F.lit("format ascii 1.0"), F.concat(F.lit("element vertex "), F.col("_v"))] + [F.lit(f"property float {c}") for c in ["x", "y", "z", *([scalar] if scalar else [])]]
    text += [F.concat(F.lit("element face "), F.coalesce("_f", F.lit(0))), F.lit("property list uchar int vertex_indices"), F.lit("end_header")]
    head = n.select(by, F.lit(0).alias("part"), F.posexplode(F.array(*text)).alias("k", "line")).withColumn("k", F.col("k").cast("long"))
    v = vertices.select(by, F.lit(1).alias("part"), F.col("vid").cast("long").alias("k"), F.format_string("%.6f %.6f %.6f" + (" %.6f" if scalar else ""), "x", "y", "z", *([scalar] if scalar else [])).alias("line"))
    f = faces.select(by, F.lit(2).alias("part"), F.col("fid").cast("long").alias("k"), F.format_string("3 %d %d %d", "v1", "v2", "v3").alias("line"))
    return head.unionByName(v).unionByName(f)


def boxed_obj_lines(vertices: DataFrame, faces: DataFrame, by: str = "tree_id", box: str = "box") -> DataFrame:
    """``by, part, k, line``: an OBJ whose faces stand in groups ``g box_<n>`` by their box, as renderers with nested volumes want it."""
    v = vertices.select(by, F.lit(-1).cast("long").alias("part"), F.col("vid").cast("long").alias("k"), F.format_string("v %.4f %.4f %.4f", "x", "y", "z").alias("line"))
    g = faces.select(by, F.col(box).cast("long").alias("part")).distinct().withColumn("k", F.lit(-1).cast("long")).withColumn("line", F.format_string("g box_%d", "part"))
    f = faces.select(by, F.col(box).cast("long").alias("part"), F.col("fid").cast("long").alias("k"), F.format_string("f %d %d %d", "v1", "v2", "v3").alias("line"))
    return v.unionByName(g.select(by, "part", "k", "line")).unionByName(f)
