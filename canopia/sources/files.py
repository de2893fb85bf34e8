"""Reading the file formats of the field: point clouds, meshes, rasters, light-meter logs, model tables."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopia.plans.shared import broadcast_if_small, materialize

# Scalar types of PLY and PCD headers as numpy and Spark know them.
PLY_TYPES = {"float": ("<f4", "float"), "double": ("<f8", "double"), "uchar": ("u1", "int"), "char": ("i1", "int"), "int": ("<i4", "int"), "uint": ("<u4", "long"), "short": ("<i2", "int"), "ushort": ("<u2", "int")}
#: Name that fields without one are read under; they are not returned.
PADDING = "_padding"
PCD_TYPES = {("F", 4): ("<f4", "float"), ("F", 8): ("<f8", "double"), ("U", 1): ("u1", "int"), ("U", 2): ("<u2", "int"), ("U", 4): ("<u4", "long"), ("I", 1): ("i1", "int"), ("I", 2): ("<i2", "int"), ("I", 4): ("<i4", "int")}


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def list_files(spark: SparkSession, folder: str, pattern: str = "*", least_bytes: int = 0) -> DataFrame:
    """``path, file, bytes`` of matching files, without their content."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return f.where(F.col("length") >= least_bytes).select("path", F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"))


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """``file, x, y, z`` and further columns ``v0 ..`` as an array ``rest``, of text clouds separated by commas or white space.

    A first line that names columns (it has an x) is passed over; lines that are no numbers are left out.
    """
    t = spark.read.text(path).select(_stem(F.col("_metadata.file_path")).alias("file"), F.split(F.trim("value"), r"[,\s]+").alias("v"))
    n = t.select("file", F.transform("v", lambda x: x.try_cast("double")).alias("v")).where((F.size("v") >= 3) & F.forall("v", lambda x: x.isNotNull()))
    return n.select("file", *[F.get("v", F.lit(i)).alias(c) for i, c in enumerate("xyz")], F.slice("v", F.lit(4), F.size("v")).alias("rest"))


def read_named_cloud(spark: SparkSession, path: str) -> DataFrame:
    """``file`` and the named columns of text clouds separated by commas or white space, as doubles; columns that a file lacks are null.

    A line with a field ``x`` or ``//x`` (either case) names a file's columns, in small letters; those of a file without one are ``x, y, z, v0 ..``. Fields beyond the names and lines with anything but numbers
    are left out. The names, one row a file, meet the lines by a join; only the different names come to the driver.
    """
    t = spark.read.text(path).select(_stem(F.col("_metadata.file_path")).alias("file"), F.split(F.trim("value"), r"[,\s]+").alias("v"))
    low = F.transform("v", lambda x: F.regexp_replace(F.lower(x), "^//", ""))
    named = t.select("file", low.alias("names")).where(F.array_contains("names", "x")).groupBy("file").agg(F.min("names").alias("names"))
    lines = t.select("file", F.transform("v", lambda x: x.try_cast("double")).alias("v")).where((F.size("v") >= 3) & F.forall("v", lambda x: x.isNotNull()))
    size = lines.groupBy("file").agg(F.max(F.size("v")).alias("_n"))
    own = F.concat(F.array(*map(F.lit, "xyz")), F.when(F.col("_n") > 3, F.transform(F.sequence(F.lit(0), F.col("_n") - 4), lambda i: F.concat(F.lit("v"), i.cast("string")))).otherwise(F.array().cast("array<string>")))
    files = materialize(size.join(named, "file", "left").select("file", F.coalesce("names", own).alias("names")), "file_columns")
    order = files.select(F.posexplode("names").alias("at", "name")).groupBy("name").agg(F.min("at").alias("at")).orderBy("at", "name").collect()
    with_names = lines.join(broadcast_if_small(files), "file")
    return with_names.select("file", *[F.get("v", F.array_position("names", r["name"]).cast("int") - 1).alias(r["name"]) for r in order])


def read_cylinders(spark: SparkSession, path: str) -> DataFrame:
    """The 14 columns of cylinder tables; 0 as parent or extension is none."""
    names = ["radius", "length", "sx", "sy", "sz", "ax", "ay", "az", "parent", "extension", "branch", "branch_order", "position", "added"]
    t = spark.read.text(path).select(_stem(F.col("_metadata.file_path")).alias("file"), F.split(F.trim("value"), r"[,\s]+").alias("v")).where(F.size("v") == 14)
    c = t.select("file", *[F.get("v", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)])
    whole = {n: F.col(n).cast("long") for n in ("branch", "branch_order", "position")}
    return c.withColumns({**whole, **{n: F.nullif(F.col(n).cast("long"), F.lit(0)) for n in ("parent", "extension")}, "added": F.col("added") != 0})


def read_obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices ``file, vid, x, y, z`` and faces ``file, fid, v1, v2, v3`` (numbers from 1) of triangle meshes. A whole file is one row, so lines keep their order."""
    t = spark.read.text(path, wholetext=True).select(_stem(F.col("_metadata.file_path")).alias("file"), F.split("value", r"\r?\n").alias("l"))
    rows = lambda mark: F.posexplode(F.transform(F.filter("l", lambda x: F.startswith(x, F.lit(mark))), lambda x: F.split(F.trim(x), r"\s+")))
    v = t.select("file", rows("v ").alias("k", "p")).select("file", (F.col("k") + 1).alias("vid"), *[F.get("p", F.lit(i + 1)).cast("double").alias(c) for i, c in enumerate("xyz")])
    corner = lambda i: F.substring_index(F.get("p", F.lit(i)), "/", 1).cast("int").alias(f"v{i}")
    return v, t.select("file", rows("f ").alias("k", "p")).select("file", (F.col("k") + 1).alias("fid"), corner(1), corner(2), corner(3))


def read_light_log(spark: SparkSession, path: str, day_format: str = "yyyyMMdd HH:mm:ss") -> DataFrame:
    """``file, seq, kind, ts, r1 .. r5``: the rows A and B of instrument logs, after the mark ``### Observations`` where there is one."""
    t = spark.read.text(path, wholetext=True).select(_stem(F.col("_metadata.file_path")).alias("file"), F.element_at(F.split("value", "### Observations"), -1).alias("body"))
    r = t.select("file", F.posexplode(F.split("body", r"\r?\n")).alias("seq", "line")).select("file", "seq", F.split("line", "\t").alias("c"))
    r = r.where(F.get("c", F.lit(0)).isin("A", "B"))
    return r.select(
        "file", "seq", F.get("c", F.lit(0)).alias("kind"), F.try_to_timestamp(F.get("c", F.lit(2)), F.lit(day_format)).alias("ts"),
        *[F.get("c", F.lit(i + 3)).try_cast("double").alias(f"r{i}") for i in range(1, 6)],
    ).where(F.col("ts").isNotNull())


def _ply_header(raw: bytes) -> tuple[list[tuple[str, str, str]], int, bool, int]:
    """Properties (name, numpy type, Spark type), vertices, whether binary, and where the data start."""
    end = raw.index(b"end_header")
    at = raw.index(b"\n", end) + 1
    props, n, binary, own, big = [], 0, False, False, False
    for line in raw[:end].decode("ascii", "replace").split("\n"):
        w = line.split()
        if w[:1] == ["format"]:
            binary, big = w[1].startswith("binary"), w[1] == "binary_big_endian"
        elif w[:1] == ["element"]:
            own = w[1] == "vertex"
            n = int(w[2]) if own else n
        elif w[:1] == ["property"] and own:
            if w[1] not in PLY_TYPES:
                raise ValueError(f"vertex property {w[-1]} of type {w[1]} cannot be read")
            kind, column = PLY_TYPES[w[1]]
            props.append((w[2], kind.replace("<", ">") if big else kind, column))
    return props, n, binary, at


def _pcd_header(raw: bytes) -> tuple[list[tuple[str, str, str]], int, bool, int]:
    at, found = 0, {}
    while "DATA" not in found:
        end = raw.index(b"\n", at)
        w = raw[at:end].decode("ascii", "replace").split()
        if w and not w[0].startswith("#"):
            found[w[0]] = w[1:]
        at = end + 1
    many = [int(c) for c in found.get("COUNT", ["1"] * len(found["FIELDS"]))]
    props = []
    for k, (n, t, s, c) in enumerate(zip(found["FIELDS"], found["TYPE"], found["SIZE"], many, strict=True)):
        n = f"{PADDING}{k}" if n == "_" else n
        props += [(n if c == 1 else f"{n}_{i}", *PCD_TYPES[(t, int(s))]) for i in range(c)]  # a field of several values is as many columns
    form = found["DATA"][0]
    if form not in ("ascii", "binary", "binary_compressed"):
        raise ValueError(f"PCD data of form {form} cannot be read")
    return props, int(found["POINTS"][0]), {"ascii": False, "binary": True}.get(form, many), at


def _unpacked(raw: bytes, size: int) -> bytes:
    """The bytes that an LZF stream stands for: runs given as they are (a number below 32, less one) and references back (length in the upper three bits, distance in the rest and the next byte)."""
    out, at, end = bytearray(), 0, len(raw)
    while at < end:
        mark = raw[at]
        at += 1
        if mark < 32:
            out += raw[at : at + mark + 1]
            at += mark + 1
            continue
        length = mark >> 5
        if length == 7:
            length += raw[at]
            at += 1
        back = len(out) - ((mark & 31) << 8 | raw[at]) - 1
        at, length = at + 1, length + 2
        if back < 0:
            raise ValueError("compressed data refer to a place before their start")
        piece = out[back : back + length]
        out += (piece * (length // len(piece) + 1))[:length]  # what is referred to may still be being written
    if len(out) != size:
        raise ValueError(f"compressed data hold {len(out)} bytes, {size} are said")
    return bytes(out)


def _cloud(raw: bytes, header) -> pd.DataFrame:
    props, n, binary, at = header(raw)
    if isinstance(binary, list):  # packed: all values of one field after those of another
        packed, size = struct.unpack_from("<II", raw, at)
        data, at, columns, k = _unpacked(raw[at + 8 : at + 8 + packed], size), 0, {}, 0
        for many in binary:
            field = np.frombuffer(data, props[k][1], n * many, at).reshape(n, many)
            columns |= {props[k + i][0]: field[:, i] for i in range(many)}
            at, k = at + field.nbytes, k + many
        return pd.DataFrame(columns)
    if binary:
        a = np.frombuffer(raw, np.dtype([p[:2] for p in props]), n, at)
        return pd.DataFrame({p[0]: a[p[0]].astype(a[p[0]].dtype.newbyteorder("=")) for p in props})
    a = np.array(raw[at:].split()[: n * len(props)], float).reshape(-1, len(props))
    return pd.DataFrame({p[0]: a[:, i] for i, p in enumerate(props)})


def _read_binary_cloud(spark: SparkSession, path: str, header) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)

    def columns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = {(p[0], p[2], i) for h in b["h"] for i, p in enumerate(header(bytes(h))[0]) if not p[0].startswith(PADDING)}
            yield pd.DataFrame(sorted(found), columns=["name", "kind", "at"])

    # The columns of all files, as wide as any has them; there are no more different ones than headers name.
    known = files.select(F.substring("content", 1, 65_536).alias("h")).mapInPandas(columns, "name string, kind string, at int").groupBy("name").agg(F.collect_set("kind").alias("kinds"), F.min("at").alias("at")).orderBy("at", "name").collect()
    if not known:
        return spark.createDataFrame([], "file string, pid long")
    widest = lambda kinds: next(k for k in ("double", "float", "long", "int") if k in kinds) if len({"float", "double"} & set(kinds)) in (0, len(kinds)) else "double"
    names = [r["name"] for r in known]
    schema = ", ".join(["file string", "pid long", *(f"`{r['name']}` {widest(r['kinds'])}" for r in known)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, raw in zip(b["file"], b["content"], strict=True):
                c = _cloud(bytes(raw), header)
                c.insert(0, "pid", np.arange(len(c)))
                c.insert(0, "file", name)
                yield c.reindex(columns=["file", "pid", *names])

    return files.select(_stem(F.col("path")).alias("file"), "content").mapInPandas(run, schema)


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """``file, pid`` and the vertex properties of PLY files, text or binary of either byte order; one task reads a file. Columns that a file lacks are null."""
    return _read_binary_cloud(spark, path, _ply_header)


def read_pcd(spark: SparkSession, path: str) -> DataFrame:
    """``file, pid`` and the fields of PCD files, text, binary or compressed. A field of several values is as many columns (``name_0`` ..), padding is none."""
    return _read_binary_cloud(spark, path, _pcd_header)


def read_raster(spark: SparkSession, path: str) -> DataFrame:
    """``image, band, row, col, value`` of rasters with a text header (mark, bands, columns, rows, format) and a tail of 32-bit floats, band by band."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, raw in zip(b["file"], b["content"], strict=True):
                head = bytes(raw)[:4096].split()
                bands, cols, rows = (int(x) for x in head[1:4])
                a = np.frombuffer(bytes(raw)[-4 * bands * cols * rows :], "<f4").reshape(bands, rows, cols)
                band, row, col = (x.ravel() for x in np.indices(a.shape))
                yield pd.DataFrame({"image": name, "band": band, "row": row, "col": col, "value": a.ravel().astype(float)})

    files = spark.read.format("binaryFile").load(path).select(_stem(F.col("path")).alias("file"), "content")
    return files.mapInPandas(run, "image string, band long, row long, col long, value double")


def _mat_elements(raw: bytes, at: int, end: int) -> Iterator[tuple[int, bytes]]:
    while at + 8 <= end:
        kind, size = struct.unpack_from("<II", raw, at)
        if kind >> 16:  # small element: its data share the tag
            yield kind & 0xFFFF, raw[at + 4 : at + 4 + (kind >> 16)]
            at += 8
        else:
            yield kind, raw[at + 8 : at + 8 + size]
            at += 8 + (size if kind == 15 else -(-size // 8) * 8)


# Numeric storage types of the format.
_MAT_NUMBERS = {1: "i1", 2: "u1", 3: "<i2", 4: "<u2", 5: "<i4", 6: "<u4", 7: "<f4", 9: "<f8", 12: "<i8", 13: "<u8"}


def mat_variables(raw: bytes) -> dict[str, np.ndarray]:
    """The real numeric matrices of a version 5 MAT file, as doubles."""
    out = {}
    for kind, data in _mat_elements(raw, 128, len(raw)):
        if kind == 15:
            data = zlib.decompress(data)
            kind, data = next(_mat_elements(data, 0, len(data)))
        if kind == 14:
            parts = list(_mat_elements(data, 0, len(data)))
            if len(parts) >= 4 and parts[3][0] in _MAT_NUMBERS:
                shape = np.frombuffer(parts[1][1], "<i4")
                out[parts[2][1].decode()] = np.frombuffer(parts[3][1], _MAT_NUMBERS[parts[3][0]]).astype(float).reshape(shape, order="F")
    return out


def read_mat_models(spark: SparkSession, path: str) -> DataFrame:
    """``file, cyl`` and radius, length, start, axis, parent, extension, branch, order and position of the cylinders in model files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, raw in zip(b["file"], b["content"], strict=True):
                m = mat_variables(bytes(raw))
                one = lambda k: m[k].reshape(-1)
                yield pd.DataFrame({
                    "file": name, "cyl": np.arange(1, m["Rad"].size + 1), "radius": one("Rad"), "length": one("Len"), **{f"s{c}": m["Sta"][:, i] for i, c in enumerate("xyz")},
                    **{f"a{c}": m["Axe"][:, i] for i, c in enumerate("xyz")}, "parent": one("CPar").astype(int), "extension": one("CExt").astype(int),
                    **{c: m["BoC"][:, i].astype(int) for i, c in enumerate(("branch", "branch_order", "position"))},
                })

    files = spark.read.format("binaryFile").load(path).select(_stem(F.col("path")).alias("file"), "content")
    number = "double"
    m = files.mapInPandas(run, "file string, cyl long, " + ", ".join(f"{c} {number}" for c in ("radius", "length", "sx", "sy", "sz", "ax", "ay", "az")) + ", parent long, extension long, branch long, branch_order long, position long")
    return m.withColumns({n: F.nullif(F.col(n), F.lit(0)) for n in ("parent", "extension")})


def matching(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """Rows of ``files`` (column ``file``) named by a list of names that may end with ``*`` (column ``pattern``): by equality, and by the prefixes a name has."""
    p = patterns.select(F.regexp_replace("pattern", r"\*$", "").alias("_p"), F.col("pattern").endswith("*").alias("_open")).distinct()
    own = files.withColumn("_p", F.explode(F.transform(F.sequence(F.lit(1), F.length("file")), lambda n: F.substring(F.col("file"), F.lit(1), n))))
    return own.join(p, "_p").where(F.col("_open") | (F.col("_p") == F.col("file"))).select(*files.columns).distinct()


def stream_clouds(spark: SparkSession, folder: str, files_each: int = 16) -> DataFrame:
    """Text clouds as they arrive in a folder, each file once: a stream in place of workers that share lock files."""
    t = spark.readStream.format("text").option("maxFilesPerTrigger", str(files_each)).load(folder)
    v = t.select(_stem(F.col("_metadata.file_path")).alias("file"), F.transform(F.split(F.trim("value"), r"[,\s]+"), lambda x: x.try_cast("double")).alias("v"))
    return v.where((F.size("v") >= 3) & F.forall("v", lambda x: x.isNotNull())).select("file", *[F.get("v", F.lit(i)).alias(c) for i, c in enumerate("xyz")])


def numbered(rows: DataFrame, by: str = "file", order: str = "pid") -> DataFrame:
    """Rows with their place in each file, from 1."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(order)))
