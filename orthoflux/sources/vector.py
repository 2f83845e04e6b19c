"""Vector formats: GeoJSON, Shapefile, GeoPackage, CSV and Parquet."""

from __future__ import annotations

import functools
import os
import sqlite3
import struct
import tempfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.geom import buffers
from .files import binary, write_file


def resolve(path: str | None, *defaults: str) -> str | None:
    """The path itself, or the first default name that exists beside it."""
    if path and os.path.exists(path):
        return path
    base = path if path and os.path.isdir(path) else os.path.dirname(path or "")
    return next((p for p in (os.path.join(base, d) for d in defaults) if os.path.exists(p)), None)


def read_geojson_points(spark: SparkSession, path: str, z_field: str = "z") -> DataFrame:
    """``(x, y, z, geom_type)`` of all features: z from the attribute, else from the geometry."""
    schema = f"features array<struct<geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>"
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    at = F.from_json("f.geometry.coordinates", "array<double>")
    return f.select(F.get(at, F.lit(0)).alias("x"), F.get(at, F.lit(1)).alias("y"), F.coalesce(F.try_element_at("f.properties", F.lit(z_field)).cast("double"), F.get(at, F.lit(2))).alias("z"), F.col("f.geometry.type").alias("geom_type"))


def write_geojson(polygons: DataFrame, path: str, columns: tuple[str, ...] = ()) -> None:
    """One feature a line (newline-delimited GeoJSON), rings closed, written in parallel."""
    ring = F.transform("rings", lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    props = F.struct(*columns) if columns else F.struct(F.lit(None).cast("string").alias("none"))
    geom = F.struct(F.lit("Polygon").alias("type"), ring.alias("coordinates"))
    polygons.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geom.alias("geometry"), props.alias("properties"))).alias("value")).write.text(path)


def parse_shp(data: bytes):
    """(type, x, y, z, rings) of every record; points have no rings."""
    at = 100
    while at + 8 <= len(data):
        size = struct.unpack_from(">I", data, at + 4)[0] * 2
        kind = struct.unpack_from("<I", data, at + 8)[0]
        body = at + 12
        if kind in (1, 11, 21):
            x, y = struct.unpack_from("<2d", data, body)
            z = struct.unpack_from("<d", data, body + 16)[0] if kind == 11 else None
            yield "Point", x, y, z, None
        elif kind in (5, 15, 25):
            parts, n = struct.unpack_from("<2I", data, body + 32)
            ends = [*struct.unpack_from(f"<{parts}I", data, body + 40), n]
            pts = list(struct.iter_unpack("<2d", data[body + 40 + 4 * parts : body + 40 + 4 * parts + 16 * n]))
            yield "Polygon", None, None, None, [[{"x": x, "y": y} for x, y in pts[a:b]] for a, b in zip(ends, ends[1:], strict=False)]
        at += 8 + size


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """``(geom_type, x, y, z, rings)`` of the .shp files at ``path``."""
    def run(frames):
        for pdf in frames:
            for data in pdf["content"]:
                rows = list(parse_shp(data))
                yield pd.DataFrame(rows, columns=["geom_type", "x", "y", "z", "rings"])

    return binary(spark, path).mapInPandas(run, "geom_type string, x double, y double, z double, rings array<array<struct<x:double,y:double>>>")


def encode_shp(shapes: list, polygon: bool) -> tuple[bytes, bytes]:
    """(.shp, .shx) bytes of points [(x, y)] or polygons [rings of (x, y)]."""
    kind, body, index, at = (5 if polygon else 1), b"", b"", 50
    flat = [p for s in shapes for p in ([q for r in s for q in r] if polygon else [s])]
    box = (min(p[0] for p in flat), min(p[1] for p in flat), max(p[0] for p in flat), max(p[1] for p in flat)) if flat else (0.0,) * 4
    for i, s in enumerate(shapes, 1):
        if polygon:
            pts = [q for r in s for q in r]
            starts, n = [], 0
            for r in s:
                starts.append(n)
                n += len(r)
            own = (min(p[0] for p in pts), min(p[1] for p in pts), max(p[0] for p in pts), max(p[1] for p in pts))
            rec = struct.pack("<I4d2I", 5, *own, len(s), n) + struct.pack(f"<{len(s)}I", *starts) + b"".join(struct.pack("<2d", *p) for p in pts)
        else:
            rec = struct.pack("<I2d", 1, *s)
        body += struct.pack(">2I", i, len(rec) // 2) + rec
        index += struct.pack(">2I", at, len(rec) // 2)
        at += 4 + len(rec) // 2
    head = lambda n: struct.pack(">7I", 9994, 0, 0, 0, 0, 0, (100 + n) // 2) + struct.pack("<2I8d", 1000, kind, *box, 0, 0, 0, 0)
    return head(len(body)) + body, head(len(index)) + index


def encode_dbf(name: str, values: list[float]) -> bytes:
    """A table of one numeric column."""
    head = struct.pack("<4BIHH20x", 3, 124, 1, 1, len(values), 65, 21) + struct.pack("<11sc4xBB14x", name.encode()[:10], b"N", 20, 6) + b"\r"
    return head + b"".join(b" " + f"{v:20.6f}".encode()[:20] for v in values) + b"\x1a"


def write_shapefile(df: DataFrame, folder: str, value: str | None = None) -> DataFrame:
    """One .shp/.shx/.dbf set per partition, from ``x, y`` or ``rings``; returns ``(uri, n)``."""
    polygon = "rings" in df.columns
    cols = [*(["rings"] if polygon else ["x", "y"]), *([value] if value else [])]

    def run(frames):
        from pyspark import TaskContext

        rows = pd.concat([pd.DataFrame(columns=cols), *frames])
        if len(rows):
            shapes = [[[(p["x"], p["y"]) for p in r] for r in s] for s in rows.rings] if polygon else list(zip(rows.x, rows.y, strict=True))
            shp, shx = encode_shp(shapes, polygon)
            stem = f"{folder}/part-{TaskContext.get().partitionId():05d}"
            for end, data in ((".shp", shp), (".shx", shx), (".dbf", encode_dbf(value or "fid", list(rows[value]) if value else list(range(len(rows)))))):
                write_file(stem + end, data)
            yield pd.DataFrame({"uri": [stem + ".shp"], "n": [len(rows)]})

    return df.select(*cols).mapInPandas(run, "uri string, n long")


def write_training_buffers(points: DataFrame, folder: str, radius: float, classes: tuple[str, ...], by: str = "class") -> DataFrame:
    """Discs around the training points as Shapefiles, a folder ``val_buffer_<class>`` for each of ``classes``; returns ``(class, uri, n)``."""
    parts = [write_shapefile(buffers(points.where(F.col(by) == c), radius), f"{folder}/val_buffer_{c}").select(F.lit(c).alias("class"), "uri", "n") for c in classes]
    return functools.reduce(DataFrame.unionByName, parts)


def _wkb_point(blob: bytes):
    """(x, y, z) of a GeoPackage point."""
    at = 8 + (0, 32, 48, 48, 64)[(blob[3] >> 1) & 7]
    e = "<" if blob[at] else ">"
    kind = struct.unpack_from(e + "I", blob, at + 1)[0]
    if kind % 1000 != 1:
        return None, None, None
    x, y = struct.unpack_from(e + "2d", blob, at + 5)
    return x, y, struct.unpack_from(e + "d", blob, at + 21)[0] if kind // 1000 in (1, 3) else None


def read_gpkg_points(spark: SparkSession, path: str, layer: str | None = None, z_field: str = "z") -> DataFrame:
    """``(x, y, z)`` of a GeoPackage layer (the first one by default)."""
    def run(frames):
        for pdf in frames:
            for data in pdf["content"]:
                with tempfile.NamedTemporaryFile(suffix=".gpkg") as f:  # read by this task only
                    f.write(data)
                    f.flush()
                    con = sqlite3.connect(f.name)
                    table, geom = con.execute("SELECT table_name, column_name FROM gpkg_geometry_columns WHERE table_name = coalesce(?, table_name) LIMIT 1", (layer,)).fetchone()
                    cols = [r[1] for r in con.execute(f'PRAGMA table_info("{table}")')]
                    field = f'"{z_field}"' if z_field in cols else "NULL"
                    rows = [(*_wkb_point(g), v) for g, v in con.execute(f'SELECT "{geom}", {field} FROM "{table}"')]
                    con.close()
                yield pd.DataFrame([(x, y, v if v is not None else z) for x, y, z, v in rows], columns=["x", "y", "z"])

    return binary(spark, path).mapInPandas(run, "x double, y double, z double")


def load_vector(spark: SparkSession, path: str, z_field: str = "z", layer: str | None = None) -> DataFrame:
    """Points ``(x, y, z)`` by file ending; points without any z are an error, as is an unknown ending."""
    end = path.lower().rsplit(".", 1)[-1]
    if end in ("geojson", "json"):
        df = read_geojson_points(spark, path, z_field).where("geom_type = 'Point'").drop("geom_type")
    elif end == "shp":
        df = read_shapefile(spark, path).where("geom_type = 'Point'").select("x", "y", "z")
    elif end == "gpkg":
        df = read_gpkg_points(spark, path, layer, z_field)
    elif end in ("csv", "parquet"):
        df = spark.read.csv(path, header=True, inferSchema=True) if end == "csv" else spark.read.parquet(path)
        if z_field not in df.columns:
            raise ValueError(f"{path} has no column {z_field!r}")
        df = df.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col(z_field).cast("double").alias("z"))
    else:
        raise ValueError(f"no reader for .{end} files")
    if df.where("z IS NOT NULL").isEmpty():
        raise ValueError(f"{path}: neither an attribute {z_field!r} nor a geometry height")
    return df


def load_arrays(spark: SparkSession, xs, ys, zs) -> DataFrame:
    """``(pid, x, y, z)`` from three sequences of one length."""
    if not len(xs) == len(ys) == len(zs):
        raise ValueError("xs, ys and zs differ in length")
    return spark.createDataFrame(pd.DataFrame({"pid": range(len(xs)), "x": xs, "y": ys, "z": zs}).astype({"x": float, "y": float, "z": float}))
