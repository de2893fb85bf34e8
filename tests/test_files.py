"""Round trips of the file formats."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopia.sources import files, sinks


def test_text_clouds(spark, tmp_path):
    (tmp_path / "a_b_7.txt").write_text("//X Y Z v\n1 2 3 9\n4 5 6 8\nbroken\n")
    (tmp_path / "a_b_8.txt").write_text("1,2,3\n")
    rows = files.read_xyz(spark, str(tmp_path)).orderBy("file", "x").collect()
    assert [(r.file, r.x, r.y, r.z, r.rest) for r in rows] == [("a_b_7", 1, 2, 3, [9]), ("a_b_7", 4, 5, 6, [8]), ("a_b_8", 1, 2, 3, [])]
    listed = files.list_files(spark, str(tmp_path), "*.txt", 10)
    assert [r.file for r in listed.collect()] == ["a_b_7.txt"]
    names = spark.createDataFrame([("a_b_7*",), ("a_b_8",), ("a_b_8.txt",)], "pattern string")
    assert sorted(r.file for r in files.matching(files.list_files(spark, str(tmp_path)), names).collect()) == ["a_b_7.txt", "a_b_8.txt"]


def test_ply_round_trip(spark, tmp_path):
    points = spark.createDataFrame([(1, 0, 1.0, 2.0, 3.0, 10, 0.5), (1, 1, 4.0, 5.0, 6.0, 20, 0.25), (2, 0, 7.0, 8.0, 9.0, 30, 1.5)], "tree_id long, pid long, x double, y double, z double, red int, value double")
    sinks.save_files(sinks.ply_files(points), str(tmp_path), F.concat(F.lit("t"), F.col("tree_id"), F.lit(".ply")))
    back = files.read_ply(spark, f"{tmp_path}/*.ply").orderBy("file", "x")
    assert [tuple(r)[0:1] + tuple(r)[2:] for r in back.collect()] == [("t1", 1, 2, 3, 10, 0.5), ("t1", 4, 5, 6, 20, 0.25), ("t2", 7, 8, 9, 30, 1.5)]
    (tmp_path / "ascii").mkdir()
    (tmp_path / "ascii" / "a.ply").write_text("ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty uchar red\nend_header\n1.5 3\n2.5 4\n")
    assert [(r.x, r.red) for r in files.read_ply(spark, f"{tmp_path}/ascii").collect()] == [(1.5, 3), (2.5, 4)]
    head = "ply\nformat binary_big_endian 1.0\nelement vertex 1\nproperty double x\nproperty short level\nend_header\n"
    (tmp_path / "ascii" / "b.ply").write_bytes(head.encode() + struct.pack(">dh", 3.25, -2))
    both = files.read_ply(spark, f"{tmp_path}/ascii").orderBy("file", "pid").collect()
    assert [(r.file, r.x, r.red, r.level) for r in both] == [("a", 1.5, 3, None), ("a", 2.5, 4, None), ("b", 3.25, None, -2)]
    with pytest.raises(ValueError):
        files._ply_header(b"ply\nformat ascii 1.0\nelement vertex 1\nproperty list uchar int v\nend_header\n")


def test_pcd_and_raster_and_obj(spark, tmp_path):
    for d in ("p", "h", "o", "c"):
        (tmp_path / d).mkdir()
    head = "# .PCD\nVERSION 0.7\nFIELDS x y\nSIZE 4 4\nTYPE F F\nCOUNT 1 1\nWIDTH 2\nHEIGHT 1\nPOINTS 2\nDATA binary\n"
    (tmp_path / "p" / "a.pcd").write_bytes(head.encode() + np.array([[1, 2], [3, 4]], "<f4").tobytes())
    assert [(r.x, r.y) for r in files.read_pcd(spark, f"{tmp_path}/p").collect()] == [(1, 2), (3, 4)]
    values = np.arange(2 * 2 * 3, dtype="<f4")
    (tmp_path / "h" / "i.hips").write_bytes(b"HIPS 2 3 2 float\n.\n" + values.tobytes())
    got = files.read_raster(spark, f"{tmp_path}/h").orderBy("band", "row", "col").collect()
    assert [r.value for r in got] == values.tolist() and (got[-1].band, got[-1].row, got[-1].col) == (1, 1, 2)
    (tmp_path / "o" / "m.obj").write_text("v 0 0 0\nvn 1 1 1\nv 1 0 0\nv 0 1 0\nf 1/1 2/1 3/1\n")
    v, f = files.read_obj(spark, f"{tmp_path}/o")
    assert v.count() == 3 and [(r.v1, r.v2, r.v3) for r in f.collect()] == [(1, 2, 3)]
    lines = sinks.obj_lines(v.withColumn("tree_id", F.lit(1)), f.withColumn("tree_id", F.lit(1)))
    sinks.save_lines(lines, f"{tmp_path}/out", "tree_id", ["part", "k"])
    assert spark.read.text(f"{tmp_path}/out/tree_id=1").collect()[-1].value == "f 1 2 3"
    c = spark.createDataFrame([(1, 1, 0.1, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, None, 1, 0, 1)], "tree_id long, cyl long, radius double, length double, sx double, sy double, sz double, ax double, ay double, az double, parent long, branch long, branch_order long, position long")
    sinks.save_lines(sinks.cylinder_lines(c), f"{tmp_path}/c/t", "tree_id", ["cyl"])
    back = files.read_cylinders(spark, f"{tmp_path}/c/t/tree_id=1").first()
    assert back.radius == 0.1 and back.parent is None and back.branch == 1 and back.added is False


def test_light_log(spark, tmp_path):
    rows = ["x", "### Observations", "A\t1\t20160101 10:00:00\tW\t0.1\t0.2\t0.3\t0.4\t0.5", "B\t2\t20160101 10:00:14\tW\t0.1\t0.2\t0.3\t0.4\tbad", "C\t3", "A\t4\tnever"]
    (tmp_path / "log.txt").write_text("\n".join(rows))
    got = files.read_light_log(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.kind, r.r1, r.r5) for r in got] == [("A", 0.1, 0.5), ("B", 0.1, None)]


def _matrix(name, a):
    a = np.asarray(a, "<f8")
    element = lambda kind, data: struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)
    body = element(6, struct.pack("<II", 6, 0)) + element(5, np.array(a.shape, "<i4").tobytes()) + element(1, name.encode()) + element(9, a.tobytes(order="F"))
    packed = zlib.compress(struct.pack("<II", 14, len(body)) + body)
    return struct.pack("<II", 15, len(packed)) + packed


def test_model_files(spark, tmp_path):
    m = {"Rad": [[0.1], [0.05]], "Len": [[1], [2]], "Sta": [[0, 0, 0], [0, 0, 1]], "Axe": [[0, 0, 1], [1, 0, 0]], "CPar": [[0], [1]], "CExt": [[2], [0]], "BoC": [[1, 0, 1], [1, 0, 2]]}
    (tmp_path / "m.mat").write_bytes(b"MATLAB 5.0".ljust(128) + b"".join(_matrix(k, v) for k, v in m.items()))
    got = files.read_mat_models(spark, str(tmp_path)).orderBy("cyl").collect()
    assert [(r.radius, r.length, r.sz, r.ax, r.parent, r.extension, r.position) for r in got] == [(0.1, 1, 0, 0, None, 2, 1), (0.05, 2, 1, 1, 1, None, 2)]


def test_clouds_arrive_once_in_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("1 2 3\n4 5 6\n")
    q = lambda: files.stream_clouds(spark, f"{tmp_path}/in").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
    q()
    (tmp_path / "in" / "b.txt").write_text("7 8 9\n")
    q()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3


@pytest.mark.parametrize("name,want", [("ModelData_plot_winter_714-0.2-0.22-4-0.04-0.044-3-5-1-0.mat", ("ModelData_plot_winter_714", 714, "0.2-0.22-4-0.04-0.044-3-5-1", 0)), ("odd", ("odd", None, None, None))])
def test_run_names(spark, name, want):
    from canopia.operators.runs import named

    r = named(spark.createDataFrame([(name,)], "file string")).first()
    assert (r.tree, r.tree_number, r.parameters, r.iteration) == want


def test_texts_of_models_and_meshes(spark, tmp_path):
    from canopia.sources.sinks import boxed_obj_lines, number_lines, ply_mesh_lines, save_model

    v = spark.createDataFrame([(1, k, float(k), 0.5, 0.25, 7.0) for k in range(3)], "tree_id long, vid long, x double, y double, z double, order double")
    f = spark.createDataFrame([(1, 0, 0, 1, 2, 4)], "tree_id long, fid long, v1 int, v2 int, v3 int, box long")
    lines = [r.line for r in ply_mesh_lines(v, f, scalar="order").orderBy("part", "k").collect()]
    assert lines[:3] == ["ply", "format ascii 1.0", "element vertex 3"] and lines[7:] == ["element face 1", "property list uchar int vertex_indices", "end_header", *[f"{k}.000000 0.500000 0.250000 7.000000" for k in range(3)], "3 0 1 2"]
    assert [r.line for r in boxed_obj_lines(v, f).orderBy("part", "k").collect()] == [*[f"v {k}.0000 0.5000 0.2500" for k in range(3)], "g box_4", "f 0 1 2"]
    assert [r.line for r in number_lines(v, ["x", "y", "vid"], order="vid").orderBy("vid").collect()] == ["0.00000\t0.500000\t0.00000", "1.00000\t0.500000\t1.00000", "2.00000\t0.500000\t2.00000"]
    save_model({"vertices": v, "faces": f}, f"{tmp_path}/model")
    assert spark.read.parquet(f"{tmp_path}/model/vertices").count() == 3 and spark.read.parquet(f"{tmp_path}/model/faces").first()["box"] == 4


def packed(data: bytes) -> bytes:
    """An LZF stream of ``data``: references to the longest earlier piece wherever three bytes repeat, else runs as they are."""
    out, run, at = bytearray(), bytearray(), 0

    def flush():
        for k in range(0, len(run), 32):
            out.append(len(run[k : k + 32]) - 1)
            out.extend(run[k : k + 32])
        run.clear()

    while at < len(data):
        back = data.rfind(data[at : at + 3], max(0, at - 8000), at + 2) if at + 3 <= len(data) else -1
        if back < 0:
            run.append(data[at])
            at += 1
            continue
        n = 3
        while n < 264 and at + n < len(data) and data[back + n] == data[at + n]:
            n += 1
        flush()
        far = at - back - 1
        out.extend([(n - 2) << 5 | far >> 8, far & 255] if n - 2 < 7 else [7 << 5 | far >> 8, n - 9, far & 255])
        at += n
    flush()
    return bytes(out)


def test_packed_bytes_come_back():
    r = np.random.default_rng(2)
    for data in (b"", b"a", b"abc" * 400, b"x" * 5000, r.integers(0, 4, 6000, dtype=np.uint8).tobytes(), r.integers(0, 256, 3000, dtype=np.uint8).tobytes()):
        assert files._unpacked(packed(data), len(data)) == data
    with pytest.raises(ValueError):
        files._unpacked(packed(b"abcdef"), 5)
    with pytest.raises(ValueError):
        files._unpacked(bytes([1 << 5, 9]), 3)


@pytest.mark.parametrize("form", ["ascii", "binary", "binary_compressed"])
def test_pcd_forms(spark, tmp_path, form):
    r = np.random.default_rng(3)
    kinds = np.dtype([("x", "<f4"), ("pad", "u1", 3), ("h", "<f4", 2), ("ring", "<u2")])
    a = np.zeros(50, kinds)
    a["x"], a["h"], a["ring"] = np.round(r.normal(size=50), 2), np.round(r.normal(size=(50, 2)), 2), r.integers(0, 9, 50)
    if form == "ascii":
        body = "\n".join(" ".join(map(str, [p["x"], *p["pad"], *p["h"], p["ring"]])) for p in a).encode()
    elif form == "binary":
        body = a.tobytes()
    else:
        raw = b"".join(np.ascontiguousarray(a[n]).tobytes() for n in kinds.names)
        small = packed(raw)
        body = np.array([len(small), len(raw)], "<u4").tobytes() + small
    head = f"VERSION 0.7\nFIELDS x _ h ring\nSIZE 4 1 4 2\nTYPE F U F U\nCOUNT 1 3 2 1\nWIDTH 50\nHEIGHT 1\nPOINTS 50\nDATA {form}\n"
    (tmp_path / "a.pcd").write_bytes(head.encode() + body)
    got = files.read_pcd(spark, str(tmp_path)).orderBy("pid")
    assert got.columns == ["file", "pid", "x", "h_0", "h_1", "ring"]
    rows = got.collect()
    assert np.allclose([[x.x, x.h_0, x.h_1, x.ring] for x in rows], np.column_stack([a["x"], a["h"], a["ring"]]))


def test_unknown_pcd_form_is_refused():
    with pytest.raises(ValueError, match="zipped"):
        files._pcd_header(b"FIELDS x\nSIZE 4\nTYPE F\nPOINTS 0\nDATA zipped\n")


def test_named_columns_of_text_clouds(spark, tmp_path):
    (tmp_path / "a.txt").write_text("//X Y Z Intensity\n1 2 3 4\n5 6 7 8\nno number here at\n")
    (tmp_path / "b.txt").write_text("y,x,z\n1,2,3\n")
    (tmp_path / "c.txt").write_text("1 2 3 4 5\n1 2 3\n")
    (tmp_path / "d.txt").write_text("")
    got = files.read_named_cloud(spark, str(tmp_path))
    assert set(got.columns) == {"file", "x", "y", "z", "intensity", "v0", "v1"}
    rows = sorted((r.file, r.x, r.y, r.z, r.intensity, r.v0, r.v1) for r in got.where("file <> 'c'").collect())
    assert rows == [("a", 1, 2, 3, 4, None, None), ("a", 5, 6, 7, 8, None, None), ("b", 2, 1, 3, None, None, None)]
    assert sorted((r.z, r.v0 or 0, r.v1 or 0) for r in got.where("file = 'c'").collect()) == [(3, 0, 0), (3, 4, 5)]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "e.txt").write_text("")
    assert files.read_named_cloud(spark, f"{tmp_path}/none").columns == ["file"]
