"""GeoTIFF to and from pixel tables: strips or tiles, uncompressed, deflate or LZW."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import GridMeta
from .files import binary, write_file

_TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 11: "f", 12: "d"}
_KINDS = {1: "u", 2: "i", 3: "f"}


def lzw_decode(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, most significant first, early change."""
    out, table, bits, n, width, prev = bytearray(), [], 0, 0, 9, None
    for byte in data:
        bits, n = (bits << 8) | byte, n + 8
        while n >= width:
            code = (bits >> (n - width)) & ((1 << width) - 1)
            n -= width
            bits &= (1 << n) - 1
            if code == 256:
                table, width, prev = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
                continue
            if code == 257:
                return bytes(out)
            if prev is None:
                prev = table[code]
                out += prev
                continue
            entry = table[code] if code < len(table) else prev + prev[:1]
            out += entry
            table.append(prev + entry[:1])
            prev = entry
            width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    out, bits, n = bytearray(), 0, 0

    def put(code, width):
        nonlocal bits, n
        bits, n = (bits << width) | code, n + width
        while n >= 8:
            out.append((bits >> (n - 8)) & 255)
            n -= 8
            bits &= (1 << n) - 1

    start = {bytes([i]): i for i in range(256)}
    table, width, cur = dict(start), 9, b""
    size = 258
    put(256, 9)
    for i in range(len(data)):
        nxt = cur + data[i : i + 1]
        if nxt in table:
            cur = nxt
            continue
        put(table[cur], width)
        table[nxt] = size
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size >= 4094:
            put(256, width)
            table, width, size = dict(start), 9, 258
        cur = data[i : i + 1]
    if cur:
        put(table[cur], width)
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    put(257, width)
    if n:
        out.append((bits << (8 - n)) & 255)
    return bytes(out)


class Tiff:
    """Header, blocks and georeference of the first image in a file's bytes."""

    def __init__(self, data: bytes):
        self.data = data
        self.e = {b"II": "<", b"MM": ">"}[data[:2]]
        magic, at = struct.unpack_from(self.e + "HI", data, 2)
        if magic != 42:
            raise ValueError("not a classic TIFF")
        self.tags: dict[int, tuple] = {}
        for k in range(struct.unpack_from(self.e + "H", data, at)[0]):
            tag, kind, n = struct.unpack_from(self.e + "HHI", data, at + 2 + 12 * k)
            fmt = _TYPES.get(kind)
            if fmt:
                full = f"{self.e}{n}{fmt}" if len(fmt) == 1 else f"{self.e}{2 * n}I"
                size = struct.calcsize(full)
                where = at + 10 + 12 * k if size <= 4 else struct.unpack_from(self.e + "I", data, at + 10 + 12 * k)[0]
                self.tags[tag] = struct.unpack_from(full, data, where)
        one = lambda t, d=None: self.tags.get(t, (d,))[0]
        self.width, self.height, self.bands = one(256), one(257), one(277, 1)
        self.compression, self.planar, self.predictor = one(259, 1), one(284, 1), one(317, 1)
        self.dtype = np.dtype(f"{self.e}{_KINDS[one(339, 1)]}{one(258, 8) // 8}")
        self.tiled = 322 in self.tags
        self.bw, self.bh = (one(322), one(323)) if self.tiled else (self.width, min(one(278, self.height), self.height))
        self.offsets, self.counts = (self.tags[324], self.tags[325]) if self.tiled else (self.tags[273], self.tags[279])
        self.across = -(-self.width // self.bw)
        self.nodata = None
        if 42113 in self.tags:
            self.nodata = float(b"".join(self.tags[42113]).rstrip(b"\0 ") or b"nan")
        self.grid = GridMeta(1.0, 0.0, -1.0, 0.0, self.width, self.height, self.nodata, 0)
        if 33550 in self.tags and 33922 in self.tags:
            sx, sy = self.tags[33550][:2]
            i, j, _, x, y, _ = self.tags[33922][:6]
            code = next((self.tags[34735][k + 3] for k in range(4, len(self.tags.get(34735, ())), 4) if self.tags[34735][k] == 3072), 0)
            self.grid = GridMeta(sx, x - i * sx, -sy, y + j * sy, self.width, self.height, self.nodata, code)

    def block(self, k: int) -> tuple[int, int, int, np.ndarray]:
        """(first row, first column, first band, pixels (rows, columns, bands)) of a block, cut to the image."""
        raw = self.data[self.offsets[k] : self.offsets[k] + self.counts[k]]
        raw = {1: lambda b: b, 5: lzw_decode, 8: zlib.decompress, 32946: zlib.decompress}[self.compression](raw)
        per = -(-self.height // self.bh) * self.across
        band, k = (divmod(k, per)) if self.planar == 2 else (0, k)
        depth = 1 if self.planar == 2 else self.bands
        r, c = k // self.across * self.bh, k % self.across * self.bw
        h = self.bh if self.tiled else min(self.bh, self.height - r)
        px = np.frombuffer(raw, self.dtype, h * self.bw * depth).reshape(h, self.bw, depth)
        if self.predictor == 2:
            px = np.cumsum(px, axis=1, dtype=self.dtype)
        return r, c, band, px[: self.height - r, : self.width - c]


def read_meta(spark: SparkSession, path: str) -> GridMeta:
    """The grid of a single file (its header is parsed on an executor)."""
    def run(frames):
        for pdf in frames:
            for data in pdf["content"]:
                g = Tiff(data).grid
                yield pd.DataFrame({"v": [[g.a, g.c, g.e, g.f, float(g.width), float(g.height), float("nan") if g.nodata is None else g.nodata, float(g.epsg)]]})

    a, c, e, f, w, h, nodata, code = binary(spark, path).mapInPandas(run, "v array<double>").first()["v"]
    return GridMeta(a, c, e, f, int(w), int(h), None if nodata != nodata else nodata, int(code))


def read_geotiff(spark: SparkSession, path: str, names: tuple[str, ...] = ("r", "g", "b", "a")) -> DataFrame:
    """``(prow, pcol, band columns)``: nodata and NaN are null; one block is one Arrow batch.

    Pixel-interleaved bands only for more than one band.  Filters and column choice
    after this read should be written once to Parquet by tile, which prunes both.
    """
    schema = "prow long, pcol long, " + ", ".join(f"{n} double" for n in names)

    def run(frames):
        for pdf in frames:
            for data in pdf["content"]:
                t = Tiff(data)
                if t.planar == 2 and t.bands > 1:
                    raise ValueError("band-separate TIFF is not supported")
                for k in range(len(t.offsets)):
                    r, c, _, px = t.block(k)
                    yy, xx = np.mgrid[r : r + px.shape[0], c : c + px.shape[1]]
                    out = {"prow": yy.ravel(), "pcol": xx.ravel()}
                    for i, n in enumerate(names):
                        v = px[..., i].astype(float).ravel() if i < px.shape[2] else np.full(yy.size, np.nan)
                        out[n] = pd.Series(np.where(v == t.nodata, np.nan, v) if t.nodata is not None else v).astype(object).where(lambda s: s.notna(), None)
                    yield pd.DataFrame(out)

    return binary(spark, path).mapInPandas(run, schema)


def encode(values: np.ndarray, grid: GridMeta, lzw: bool = True, tile: int = 256) -> bytes:
    """A tiled single-band float32 or int32 GeoTIFF; NaN is nodata for floats."""
    h, w = values.shape
    dtype = np.dtype("<f4" if values.dtype.kind == "f" else "<i4")
    blocks = []
    for r in range(0, h, tile):
        for c in range(0, w, tile):
            b = np.full((tile, tile), np.nan if dtype.kind == "f" else 0, dtype)
            part = values[r : r + tile, c : c + tile]
            b[: part.shape[0], : part.shape[1]] = part
            blocks.append(lzw_encode(b.tobytes()) if lzw else zlib.compress(b.tobytes()))
    body, offsets = b"", []
    for b in blocks:
        offsets.append(8 + len(body))
        body += b + b"\0" * (len(b) % 2)
    tags = [(256, "I", [w]), (257, "I", [h]), (258, "H", [32]), (259, "H", [5 if lzw else 8]), (262, "H", [1]), (277, "H", [1]), (284, "H", [1]), (322, "I", [tile]), (323, "I", [tile]), (324, "I", offsets), (325, "I", [len(b) for b in blocks]), (339, "H", [3 if dtype.kind == "f" else 2]), (33550, "d", [grid.a, -grid.e, 0.0]), (33922, "d", [0.0, 0.0, 0.0, grid.c, grid.f, 0.0]), (34735, "H", [1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, grid.epsg])]
    if dtype.kind == "f":
        tags.append((42113, "c", [b"n", b"a", b"n", b"\0"]))
    code = {"H": 3, "I": 4, "d": 12, "c": 2}
    at = 8 + len(body)
    far, entries = b"", b""
    start = at + 2 + 12 * len(tags) + 4
    for tag, fmt, vals in sorted(tags):
        packed = struct.pack(f"<{len(vals)}{fmt}", *vals)
        if len(packed) <= 4:
            entries += struct.pack("<HHI", tag, code[fmt], len(vals)) + packed.ljust(4, b"\0")
        else:
            entries += struct.pack("<HHII", tag, code[fmt], len(vals), start + len(far))
            far += packed + b"\0" * (len(packed) % 2)
    return struct.pack("<2sHI", b"II", 42, at) + body + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0" + far


def write_geotiff(raster: DataFrame, value: str, grid: GridMeta, folder: str, sheet: int = 4096, lzw: bool = True) -> DataFrame:
    """One GeoTIFF per sheet of ``sheet`` x ``sheet`` pixels, written by the tasks; returns ``(uri, n)``.

    A raster up to the sheet's size is one file.  Null cells are NaN.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(pdf.tr.iloc[0]), int(pdf.tc.iloc[0])
        h, w = min(sheet, grid.height - tr * sheet), min(sheet, grid.width - tc * sheet)
        whole = pdf.v.dtype.kind in "iu"
        out = np.zeros((h, w), np.int32) if whole else np.full((h, w), np.nan, np.float32)
        out[pdf.prow - tr * sheet, pdf.pcol - tc * sheet] = pdf.v
        own = GridMeta(grid.a, grid.c + tc * sheet * grid.a, grid.e, grid.f + tr * sheet * grid.e, w, h, None, grid.epsg)
        uri = f"{folder}/{tr:05d}-{tc:05d}.tif"
        write_file(uri, encode(out, own, lzw))
        return pd.DataFrame({"uri": [uri], "n": [len(pdf)]})

    keyed = raster.select("prow", "pcol", F.col(value).alias("v"), F.floor(F.col("prow") / sheet).alias("tr"), F.floor(F.col("pcol") / sheet).alias("tc"))
    return keyed.groupBy("tr", "tc").applyInPandas(run, "uri string, n long")


def write_tiles(raster: DataFrame, path: str, tile: int = 1024) -> None:
    """The primary raster sink: Parquet partitioned by tile, so windowed reads prune files."""
    keyed = raster.withColumns({"tile_r": F.floor(F.col("prow") / tile).cast("int"), "tile_c": F.floor(F.col("pcol") / tile).cast("int")})
    keyed.repartition("tile_r", "tile_c").write.partitionBy("tile_r", "tile_c").option("compression", "zstd").parquet(path)


def read_window(spark: SparkSession, path: str, row0: int, row1: int, col0: int, col1: int, tile: int = 1024) -> DataFrame:
    """Pixels of a half-open window from tiles: partition pruning, then an exact filter."""
    t = spark.read.parquet(path).where(F.col("tile_r").between(row0 // tile, (row1 - 1) // tile) & F.col("tile_c").between(col0 // tile, (col1 - 1) // tile))
    return t.where((F.col("prow") >= row0) & (F.col("prow") < row1) & (F.col("pcol") >= col0) & (F.col("pcol") < col1)).drop("tile_r", "tile_c")
