"""Sources, command line, vocabularies and mesh operators on small fixtures."""

import json
import struct

import pytest

from shardlake.__main__ import main
from shardlake.operators import geometry, governance, raster
from shardlake.sources import config, mesh
from shardlake.sources import records as source

CUBE = [[x, y, z] for x in (0, 1) for y in (0, 1) for z in (0, 1)]
SIDES = [(0, 1, 3), (0, 3, 2), (4, 6, 7), (4, 7, 5), (0, 4, 5), (0, 5, 1), (2, 3, 7), (2, 7, 6), (0, 2, 6), (0, 6, 4), (1, 5, 7), (1, 7, 3)]


def glb(points, faces, uv=None):
    parts = [b"".join(struct.pack("<3f", *p) for p in points), b"".join(struct.pack("<3H", *f) for f in faces)] + ([b"".join(struct.pack("<2f", *p) for p in uv)] if uv else [])
    views, at = [], 0
    for p in parts:
        views.append({"buffer": 0, "byteOffset": at, "byteLength": len(p)})
        at += len(p)
    acc = [{"bufferView": 0, "componentType": 5126, "count": len(points), "type": "VEC3"}, {"bufferView": 1, "componentType": 5123, "count": 3 * len(faces), "type": "SCALAR"}]
    if uv:
        acc.append({"bufferView": 2, "componentType": 5126, "count": len(uv), "type": "VEC2"})
    doc = json.dumps({"accessors": acc, "bufferViews": views, "meshes": [{"primitives": [{"attributes": {"POSITION": 0} | ({"TEXCOORD_0": 2} if uv else {}), "indices": 1}]}]}).encode()
    doc += b" " * (-len(doc) % 4)
    data = b"".join(parts)
    return b"glTF" + struct.pack("<II", 2, 28 + len(doc) + len(data)) + struct.pack("<I4s", len(doc), b"JSON") + doc + struct.pack("<I4s", len(data), b"BIN\0") + data


def test_meshes(spark, tmp_path):
    for name, data in {"A/A.glb": glb(CUBE, SIDES, [[0.25, 0.25]] * 8), "A/A.obj": b"v 0 0 0\nv 2 0 0\nv 2 2 0\nv 0 2 0\nf 1/1 2/2 3 4\nf -4 -3 -2\n", "B/B.obj": b"v 0 0 0\n", "C/other.glb": b"glTFxx", "D/D.ply": b"ply"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    t = mesh.read_meshes(spark, str(tmp_path)).cache()
    assert {r[0].split("/")[-1]: r[1] for r in t.groupBy("path").count().collect()} == {"A.glb": 12, "A.obj": 3}
    cube = t.filter("path like '%glb'")
    m = geometry.totals(cube, "path").first()
    assert (m.faces, m.area, round(m.volume, 9), m.centroid) == (12, 6.0, 1.0, [0.5, 0.5, 0.5])
    assert cube.first().ua == [0.25, 0.75]
    assert [(r.watertight, r.consistent) for r in geometry.closed(t, "path").sort("path").collect()] == [(True, True), (False, False)]  # the second file names a triangle twice
    assert [(r.fragment_id, r.path[-5:]) for r in mesh.sources(spark, str(tmp_path)).collect()] == [("A", "A.glb"), ("B", "B.obj"), ("D", "D.ply")]


def test_ply_files(spark, tmp_path):
    head = "ply\nformat {}\ncomment x\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    square = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0)]
    (tmp_path / "text.ply").write_text(head.format("ascii 1.0") + "".join(f"{x} {y} {z} 7\n" for x, y, z in square) + "4 0 1 2 3\n")
    for name, mark in (("binary_little_endian", "<"), ("binary_big_endian", ">")):
        (tmp_path / f"{name}.ply").write_bytes(head.format(f"{name} 1.0").encode() + b"".join(struct.pack(f"{mark}3fB", *p, 7) for p in square) + struct.pack(f"{mark}B4i", 4, 0, 1, 2, 3))
    (tmp_path / "cloud.ply").write_text("ply\nformat ascii 1.0\nelement vertex 2\nproperty double x\nproperty double y\nproperty double z\nend_header\n1 2 3\n4 5 6\n")
    (tmp_path / "cut.ply").write_text(head.format("ascii 1.0") + "0 0")
    areas = {r.path.split("/")[-1]: (r.faces, r.area) for r in geometry.totals(mesh.read_meshes(spark, str(tmp_path)), "path").collect()}
    assert areas == {n: (2, 1.0) for n in ("text.ply", "binary_little_endian.ply", "binary_big_endian.ply")}
    assert {r[0].split("/")[-1]: r[1] for r in mesh.read_points(spark, str(tmp_path)).groupBy("path").count().collect()} == {**{n: 4 for n in areas}, "cloud.ply": 2}


def test_exemplars_and_config(spark, tmp_path):
    for name in ("rebar/a.png", "_old/b.png", "gone/c.jpg", "rebar/d.txt"):
        (tmp_path / "x" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "x" / name).write_bytes(b"1")
    (tmp_path / "t.json").write_text(json.dumps({"labels": [{"feature_id": 0, "id": "rebar", "group": "steel"}, {"feature_id": 1, "id": "gone", "retired": True}]}))
    tax = config.read_taxonomy(spark, str(tmp_path / "t.json"))
    got = mesh.exemplars(spark, str(tmp_path / "x"), governance.active(tax)).collect()
    assert [(r.label, r.path[-5:]) for r in got] == [("rebar", "a.png")]
    assert config.read_taxonomy(spark, str(tmp_path / "none.json")).count() == 0 and config.read_rules(spark, str(tmp_path / "none.json"), {"a": 1}) == {"a": 1}
    (tmp_path / "s.env").write_text("# note\nA=1\nSHARDLAKE_B='two'\nbroken\n")
    assert config.read_settings(spark, str(tmp_path / "s.env")) == {"A": "1", "SHARDLAKE_B": "two"}
    labels = spark.createDataFrame([("1", ["rebar", "gone"]), ("2", ["gone", "odd"])], "tile string, features array<string>")
    assert {tuple(r) for r in source.unknown_labels(labels, tax).collect()} == {("gone", "retired", 2), ("odd", "unknown", 1)}


def test_vocabulary_changes(spark):
    tax = spark.createDataFrame([(0, "a", "g", "r", False), (1, "b", "g", "r", None), (2, "c", "g", "r", True)], config.TAXONOMY)
    used = spark.createDataFrame([("b",), ("a",)], "label string")
    with pytest.raises(governance.InUse, match="b"):
        governance.remove(tax, "b", used)
    with pytest.raises(ValueError):
        governance.remove(tax, "z", used)
    assert [r.id for r in governance.remove(tax, "c", used).collect()] == ["a", "b"]
    assert [r.retired for r in governance.retire(governance.retire(tax, "a"), "c", undo=True).sort("feature_id").collect()] == [True, False, False]
    new, order = governance.add(tax, ["a", "b"], "d", "g", "r", before="b", after="a")
    assert order == ["a", "d", "b"] and new.filter("id = 'd'").first().feature_id == 3
    with pytest.raises(ValueError):
        governance.add(tax, [], "a", "g", "r")


def test_masks_and_cells(spark):
    px = spark.createDataFrame([("m", x, y) for x, y in ((0, 0), (1, 0), (1, 1), (5, 5), (5, 5))], "k string, x int, y int")
    assert [tuple(r) for r in raster.coherence(px, "k").collect()] == [("m", 4, 0.75)]
    assert raster.coherence(px.filter("x > 9"), "k").count() == 0
    few = spark.createDataFrame([("a", i % 2 * 200, 0, 0) for i in range(64)] + [("b", 1, 1, 1)], "k string, r int, g int, b int")
    assert {tuple(r) for r in raster.colour_entropy(few, "k").collect()} == {("a", 64, 1.0), ("b", 1, None)}


def test_roughness_of_a_plane_and_a_fold(spark):
    flat = [("p", i, float(i % 5), float(i // 5), 0.0, 0.0, 0.0, 1.0) for i in range(25)]
    fold = [("q", i, float(i), 0.0, 0.0, *((0.0, 0.0, 1.0) if i < 3 else (1.0, 0.0, 0.0))) for i in range(6)]
    far = [("r", 0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)]
    got = {(r[0], r.id): (r.neighbours, r.roughness) for r in geometry.roughness(spark.createDataFrame(flat + fold + far, "k string, id int, x double, y double, z double, nx double, ny double, nz double"), "k", 1.5).collect()}
    assert got["p", 12] == (9, 0.0) and got["r", 0] == (1, None) and got["q", 2][0] == 3 and got["q", 2][1] > 0.2


def test_command_line(spark, tmp_path, capsys):
    assert main([str(tmp_path)], spark) == 1
    face = {"surface_label": "cast", "contiguous_area_m2": 1.0, "fit_rms_mm": 1.0}
    (tmp_path / "b_geometry.json").write_text(json.dumps({"fragment_id": "P2", "bounding": {"obb_dims_mm": [2, 1, 1], "mass_kg_est": 3.0}, "planarity": [face]}))
    (tmp_path / "a_geometry.json").write_text("{")
    capsys.readouterr()
    assert main([str(tmp_path), "--label", "cast", "--max-mass", "3", "--rank", "mass"], spark) == 0
    out = capsys.readouterr()
    assert "P2" in out.out and "region 1; 3 kg" in out.out and "a_geometry.json" in out.err
    assert main([str(tmp_path), "--label", "none"], spark) == 0 and "(none)" in capsys.readouterr().out
    assert main([str(tmp_path), "--use", "boat"], spark) == 2 and main([str(tmp_path), "--rank", "colour"], spark) == 2
    assert main([str(tmp_path), "--list-uses"], spark) == 0 and "(none)" in capsys.readouterr().out


def test_binary_faces_are_read_at_once():
    """Triangles as one array, other polygons one by one, with further properties beside the corners; a million faces in seconds."""
    import struct
    import time

    import numpy as np

    head = "ply\nformat binary_little_endian 1.0\nelement vertex 5\nproperty float x\nproperty float y\nproperty float z\nelement face {n}\nproperty list uchar int vertex_indices\nproperty uchar flag\nend_header\n"
    points = np.arange(15, dtype="<f4").reshape(5, 3)
    three = b"".join(struct.pack("<BiiiB", 3, *f, 7) for f in ((0, 1, 2), (2, 3, 4)))
    mixed = three + struct.pack("<BiiiiB", 4, 0, 1, 2, 3, 7)
    for n, body, want in ((2, three, [[0, 1, 2], [2, 3, 4]]), (3, mixed, [[0, 1, 2], [2, 3, 4], [0, 1, 2], [0, 2, 3]])):
        p, f = mesh.parse_ply(head.format(n=n).encode() + points.tobytes() + body)
        assert p.tolist() == points.tolist() and f.tolist() == want
    many = np.zeros(1_000_000, np.dtype([("n", "u1"), ("v", "<i4", 3), ("flag", "u1")]))
    many["n"], many["v"] = 3, [0, 1, 2]
    began = time.time()
    assert mesh.parse_ply(head.format(n=1_000_000).encode() + points.tobytes() + many.tobytes())[1].shape == (1_000_000, 3) and time.time() - began < 5
