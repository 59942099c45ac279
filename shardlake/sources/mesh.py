"""Binary meshes as tables, and discovery of inputs."""

from __future__ import annotations

import json
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {5120: "i1", 5121: "u1", 5122: "<i2", 5123: "<u2", 5125: "<u4", 5126: "<f4"}
WIDTH = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4}
CORNERS = "path string, face long, a array<double>, b array<double>, c array<double>, i long, j long, k long, ua array<double>, ub array<double>, uc array<double>"


def parse_glb(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Points (n x 3), triangles (m x 3) and texture coordinates (n x 2, v counted from below, or none) of all primitives of a binary glTF.

    ValueError if it is none: a header of 12 bytes, a JSON chunk, a binary chunk.
    """
    if len(data) < 20 or data[:4] != b"glTF":
        raise ValueError("not a binary glTF")
    chunks, at = {}, 12
    while at + 8 <= len(data):
        size, kind = struct.unpack_from("<I4s", data, at)
        chunks[kind] = data[at + 8 : at + 8 + size]
        at += 8 + size
    doc = json.loads(chunks[b"JSON"])
    raw = chunks.get(b"BIN\0", b"")

    def values(n: int) -> np.ndarray:
        a = doc["accessors"][n]
        v = doc["bufferViews"][a["bufferView"]]
        kind, width = np.dtype(KINDS[a["componentType"]]), WIDTH[a["type"]]
        start, step = v.get("byteOffset", 0) + a.get("byteOffset", 0), v.get("byteStride") or kind.itemsize * width
        return np.ndarray((a["count"], width), kind, raw, start, (step, kind.itemsize)).copy()

    points, faces, places, mapped, base = [], [], [], True, 0
    for mesh in doc.get("meshes", []):
        for p in mesh["primitives"]:
            xyz = values(p["attributes"]["POSITION"]).astype(float)
            faces.append((values(p["indices"]).ravel() if "indices" in p else np.arange(len(xyz))).astype(np.int64).reshape(-1, 3) + base)
            mapped &= "TEXCOORD_0" in p["attributes"]
            if mapped:
                uv = values(p["attributes"]["TEXCOORD_0"]).astype(float)
                places.append(np.column_stack([uv[:, 0], 1 - uv[:, 1]]))
            points.append(xyz)
            base += len(xyz)
    none = np.zeros((0, 3))
    return np.vstack(points or [none]), np.vstack(faces or [none.astype(np.int64)]), np.vstack(places) if mapped and places else None


def parse_obj(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Points and triangles (polygons as fans) of an OBJ text; negative numbers count from the end."""
    points, faces = [], []
    for line in text.splitlines():
        word = line.split()
        if word[:1] == ["v"]:
            points.append([float(x) for x in word[1:4]])
        elif word[:1] == ["f"]:
            at = [int(x.split("/")[0]) for x in word[1:]]
            at = [x - 1 if x > 0 else len(points) + x for x in at]
            faces += [(at[0], at[n], at[n + 1]) for n in range(1, len(at) - 1)]
    return np.array(points, dtype=float).reshape(-1, 3), np.array(faces, dtype=np.int64).reshape(-1, 3)


PLY = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


def parse_ply(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Points and triangles (polygons as fans; none for a cloud) of a PLY file, text or binary. ValueError if it is none."""
    head, end, body = data.partition(b"end_header\n")
    if not end or not head.startswith(b"ply"):
        raise ValueError("not a PLY file")
    order, elements = "", []
    for word in (line.split() for line in head.decode("ascii", "replace").splitlines()):
        if word[:1] == ["format"]:
            order = {"ascii": "", "binary_little_endian": "<", "binary_big_endian": ">"}[word[1]]
        elif word[:1] == ["element"]:
            elements.append((word[1], int(word[2]), []))
        elif word[:1] == ["property"]:
            elements[-1][2].append(word[1:])
    text, at = iter(body.split()) if not order else None, 0

    def number(kind: str):
        nonlocal at
        if text is not None:
            return float(next(text))
        value = np.frombuffer(body, order + PLY[kind], 1, at)[0]
        at += value.itemsize
        return value

    points, faces = np.zeros((0, 3)), []
    for name, count, fields in elements:
        if name == "face" and order and (three := _triangles(body, at, order, count, fields)) is not None:
            faces.append(three[0])
            at += three[1]
            continue
        plain = [f for f in fields if f[0] != "list"]
        if order and len(plain) == len(fields):  # rows of one size are read at once
            kind = np.dtype([(f[1], order + PLY[f[0]]) for f in fields])
            rows = np.frombuffer(body, kind, count, at)
            at += kind.itemsize * count
        else:
            rows = [{f[-1]: [number(f[2]) for _ in range(int(number(f[1])))] if f[0] == "list" else number(f[0]) for f in fields} for _ in range(count)]
        if name == "vertex":
            points = np.column_stack([[float(r[c]) for r in rows] if isinstance(rows, list) else rows[c].astype(float) for c in "xyz"]).reshape(-1, 3)
        elif name == "face":
            fan = []
            for r in rows:
                v = [int(x) for x in next(iter(x for x in r.values() if isinstance(x, list)))]
                fan += [(v[0], v[n], v[n + 1]) for n in range(1, len(v) - 1)]
            faces.append(np.array(fan, dtype=np.int64).reshape(-1, 3))
    return points, np.concatenate([np.zeros((0, 3), np.int64), *faces])


def _triangles(body: bytes, at: int, order: str, count: int, fields: list) -> tuple[np.ndarray, int] | None:
    """(corners, bytes) of binary faces that are all triangles, read as one array; None if one has another number of corners, or the file ends before."""
    kind = np.dtype([x for f in fields for x in ([(f"n {f[3]}", order + PLY[f[1]]), (f[3], order + PLY[f[2]], 3)] if f[0] == "list" else [(f[1], order + PLY[f[0]])])])
    lists = [f[3] for f in fields if f[0] == "list"]
    if not lists or at + kind.itemsize * count > len(body):
        return None
    rows = np.frombuffer(body, kind, count, at)
    return (rows[lists[0]].astype(np.int64), kind.itemsize * count) if all((rows[f"n {n}"] == 3).all() for n in lists) else None


def _parsed(name: str, data: bytes) -> tuple | None:
    """Points, triangles and texture places of a file by its name; null if it cannot be read."""
    try:
        if name.lower().endswith(".glb"):
            return parse_glb(data)
        return (*(parse_ply(data) if name.lower().endswith(".ply") else parse_obj(data.decode("utf-8", "replace"))), None)
    except (ValueError, KeyError, IndexError, struct.error, TypeError, StopIteration, RuntimeError):
        return None


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """One row a vertex of the PLY, GLB and OBJ files under a path: file, id, x, y, z. Files that cannot be read give no row."""

    def decode(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if (got := _parsed(name, data)) is not None:
                    for at in range(0, len(got[0]), 50000):
                        p = got[0][at : at + 50000]
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(p)), pa.array(np.arange(at, at + len(p))), *(pa.array(p[:, n]) for n in range(3))], names=["path", "id", "x", "y", "z"])

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return raw.filter(F.lower("path").rlike("\\.(ply|glb|obj)$")).mapInArrow(decode, "path string, id long, x double, y double, z double")


def read_meshes(spark: SparkSession, path: str) -> DataFrame:
    """One row a triangle of the PLY, GLB and OBJ files under a path: file, face, corners a, b, c, their vertex numbers, texture places (null without).

    Files are decoded one by one in the tasks that read them; those that cannot be read give no row.
    """

    def decode(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = _parsed(name, data)
                if got is None:
                    continue
                points, faces, uv = got
                for at in range(0, len(faces), 50000):
                    f = faces[at : at + 50000]
                    cols = [pa.array([name] * len(f)), pa.array(np.arange(at, at + len(f)))]
                    cols += [pa.array(points[f[:, n]].tolist(), pa.list_(pa.float64())) for n in range(3)] + [pa.array(f[:, n]) for n in range(3)]
                    cols += [pa.array(uv[f[:, n]].tolist() if uv is not None else [None] * len(f), pa.list_(pa.float64())) for n in range(3)]
                    yield pa.RecordBatch.from_arrays(cols, names=["path", "face", "a", "b", "c", "i", "j", "k", "ua", "ub", "uc"])

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return raw.filter(F.lower("path").rlike("\\.(ply|glb|obj)$")).mapInArrow(decode, CORNERS)


def sources(spark: SparkSession, path: str) -> DataFrame:
    """fragment_id and path of inputs named {id}/{id}.ply, .glb or .obj: the first kind of these that there is, by id."""
    from shardlake.operators.governance import first_source

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    part = lambda n: F.try_element_at(F.split("path", "/"), F.lit(n))
    named = files.select("path", part(-2).alias("fragment_id"), F.regexp_extract(part(-1), "^(.*)\\.[^.]+$", 1).alias("stem")).filter("fragment_id = stem")
    return first_source(named, "fragment_id", "path").orderBy("fragment_id")


def exemplars(spark: SparkSession, path: str, active: DataFrame) -> DataFrame:
    """path and label of exemplar images: the folder is the label; folders that begin with _ or are no active label (id) are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    files = files.filter(F.lower("path").rlike("\\.(png|jpe?g|webp)$")).withColumn("label", F.try_element_at(F.split("path", "/"), F.lit(-2)))
    return files.filter(~F.col("label").startswith("_")).join(active.select(F.col("id").alias("label")).distinct(), "label", "left_semi")
