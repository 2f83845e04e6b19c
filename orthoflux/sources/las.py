"""LAS 1.2 point files, formats 0 to 3, with an optional ``confidence`` extra dimension."""

from __future__ import annotations

import re
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .files import binary, write_file

_BASE = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("flags", "u1"), ("classification", "u1"), ("angle", "i1"), ("user", "u1"), ("source", "<u2")]
_TIME, _RGB = [("time", "<f8")], [("red", "<u2"), ("green", "<u2"), ("blue", "<u2")]
FORMATS = {0: _BASE, 1: _BASE + _TIME, 2: _BASE + _RGB, 3: _BASE + _TIME + _RGB}
SCHEMA = "x double, y double, z double, classification int, confidence float"
#: Named class filters.
CLASSES = {"all": None, "ground": (2,), "water": (9,), "ground_and_water": (2, 9)}


def parse(data: bytes) -> np.ndarray:
    """Structured points: x, y, z scaled, classification, confidence (NaN without the extra dimension)."""
    if data[:4] != b"LASF":
        raise ValueError("not a LAS file")
    offset, n_vlr, kind, size, count = struct.unpack_from("<IIBHI", data, 96)
    if kind & 0x80:
        raise ValueError("compressed LAS (LAZ) is not supported")
    scale, shift = struct.unpack_from("<3d", data, 131), struct.unpack_from("<3d", data, 155)
    fields = list(FORMATS[kind])
    own = np.dtype(fields).itemsize
    if size >= own + 4 and any(d[:2] == (b"LASF_Spec", 4) for d in vlrs(data)):
        fields.append(("confidence", "<f4"))
    packed = np.dtype({"names": [f[0] for f in fields], "formats": [f[1] for f in fields], "offsets": np.cumsum([0, *[np.dtype(f[1]).itemsize for f in fields[:-1]]]).tolist(), "itemsize": size})
    raw = np.frombuffer(data, packed, count, offset)
    out = np.zeros(count, [("x", "f8"), ("y", "f8"), ("z", "f8"), ("classification", "i4"), ("confidence", "f4")])
    for c, s, o in zip("xyz", scale, shift, strict=True):
        out[c] = raw[c.upper()] * s + o
    out["classification"] = raw["classification"] & 0x1F
    out["confidence"] = raw["confidence"] if "confidence" in raw.dtype.names else np.nan
    return out


def vlrs(data: bytes) -> list[tuple[bytes, int, bytes]]:
    """(user id, record id, body) of the variable-length records."""
    head, n = struct.unpack_from("<H", data, 94)[0], struct.unpack_from("<I", data, 100)[0]
    out, at = [], head
    for _ in range(n):
        user, record, length = data[at + 2 : at + 18].rstrip(b"\0"), *struct.unpack_from("<HH", data, at + 18)
        out.append((user, record, data[at + 54 : at + 54 + length]))
        at += 54 + length
    return out


def epsg(data: bytes) -> int | None:
    """The projected code: the last authority in a WKT record (2111, 2112), else GeoKey 3072 of record 34735."""
    found = {r: body for _, r, body in vlrs(data)}
    for r in (2112, 2111):
        if r in found and (codes := re.findall(r'"EPSG"\s*,\s*"?(\d+)', found[r].decode("latin-1"))):
            return int(codes[-1])
    if 34735 in found:
        keys = np.frombuffer(found[34735][: len(found[34735]) // 8 * 8], "<u2").reshape(-1, 4)
        for key, _, _, value in keys[1:]:
            if key == 3072:
                return int(value)
    return None


def encode(x: np.ndarray, y: np.ndarray, z: np.ndarray, classification: np.ndarray, confidence: np.ndarray | None = None, scale: float = 0.001) -> bytes:
    """Point format 3, version 1.2; offsets are the least coordinates."""
    n = len(x)
    lo = [float(v.min()) if n else 0.0 for v in (x, y, z)]
    hi = [float(v.max()) if n else 0.0 for v in (x, y, z)]
    fields = FORMATS[3] + ([("confidence", "<f4")] if confidence is not None else [])
    pts = np.zeros(n, np.dtype(fields))
    for c, v, o in zip("XYZ", (x, y, z), lo, strict=True):
        pts[c] = np.rint((np.asarray(v) - o) / scale)
    pts["classification"] = classification
    extra = b""
    if confidence is not None:
        pts["confidence"] = confidence
        body = struct.pack("<2xBB32s", 9, 0, b"confidence").ljust(192, b"\0")
        extra = struct.pack("<H16sHH32s", 0, b"LASF_Spec", 4, len(body), b"extra bytes") + body
    head = struct.pack("<4sHHIHH8sBB32s32sHHHIIBHI5I", b"LASF", 0, 0, 0, 0, 0, b"", 1, 2, b"", b"orthoflux", 1, 2024, 227, 227 + len(extra), 1 if extra else 0, 3, pts.dtype.itemsize, n, n, 0, 0, 0, 0)
    head += struct.pack("<12d", *[scale] * 3, *lo, hi[0], lo[0], hi[1], lo[1], hi[2], lo[2])
    return head + extra + pts.tobytes()


def read_las(spark: SparkSession, path: str, classes: str | tuple[int, ...] = "all") -> DataFrame:
    """All points of the files at ``path``, class filter applied while reading; one file is one task's row."""
    keep = CLASSES[classes] if isinstance(classes, str) else tuple(classes)

    def run(frames):
        for pdf in frames:
            for data in pdf["content"]:
                pts = parse(data)
                if keep is not None:
                    pts = pts[np.isin(pts["classification"], keep)]
                for at in range(0, len(pts), 100_000):
                    yield pd.DataFrame(pts[at : at + 100_000])

    return binary(spark, path).mapInPandas(run, SCHEMA)


def write_las(points: DataFrame, folder: str, scale: float = 0.001, per_file: int = 5_000_000) -> DataFrame:
    """Files of at most ``per_file`` points, written by the tasks that hold them; returns ``(uri, n)`` (an action runs it).

    Missing columns get their defaults: z 0, classification 0, no confidence.
    """
    has = set(points.columns)

    def run(frames):
        from pyspark import TaskContext

        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            nonlocal held, size, n
            pdf = pd.concat(held)
            uri = f"{folder}/part-{part:05d}-{n:03d}.las"
            zero = np.zeros(len(pdf))
            get = lambda c: pdf[c].to_numpy() if c in has else zero
            write_file(uri, encode(get("x"), get("y"), get("z"), get("classification"), get("confidence") if "confidence" in has else None, scale))
            held, size, n = [], 0, n + 1
            return pd.DataFrame({"uri": [uri], "n": [len(pdf)]})

        for pdf in frames:
            held.append(pdf)
            size += len(pdf)
            if size >= per_file:
                yield flush()
        if size:
            yield flush()

    return points.mapInPandas(run, "uri string, n long")
