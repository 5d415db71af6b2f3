"""Baseline TIFF stacks: uncompressed grey volumes of 8 or 16 bit integers or 32 bit floats, one directory a plane, classic or big.

spark.read.format("tessera_tiff") reads planes in parallel. Options x0, nx, y0, ny, z0, nz and images (see sources.read) say what is read: planes and
rows outside are not. spark.readStream takes files as they arrive, see arrivals."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.sources import strips
from tessera.sources.arrivals import Arrivals
from tessera.sources.boxes import Box
from tessera.sources.files import listed, open_in

SCHEMA = "image_id string, x int, y int, z int, v double"
INFO = "image_id string, m int, n int, p int, bits int, format int, compression int, photometric int, x_resolution double, y_resolution double, z_spacing double, description string, software string, supported boolean"
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}


@dataclass
class Plane:
    width: int = 0
    height: int = 0
    bits: int = 1
    format: int = 1
    compression: int = 1
    photometric: int = 1
    samples: int = 1
    rows: int = 0
    offsets: list = field(default_factory=list)
    counts: list = field(default_factory=list)
    x_resolution: float = 0.0
    y_resolution: float = 0.0
    description: str = ""
    software: str = ""


def directories(f) -> tuple[str, list[Plane]]:
    """Byte order and the planes of an open file; pixel data is not read."""
    f.seek(0)
    head = f.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or len(head) < 8:
        raise ValueError("not a TIFF file")
    version = struct.unpack(order + "H", head[2:4])[0]
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    at = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
    planes = []
    while at:
        f.seek(at)
        n = struct.unpack(order + ("Q" if big else "H"), f.read(8 if big else 2))[0]
        width = 20 if big else 12
        raw = f.read(n * width)
        tail = f.read(8 if big else 4)
        p = Plane()
        for k in range(n):
            e = raw[k * width : (k + 1) * width]
            tag, kind = struct.unpack(order + "HH", e[:4])
            count = struct.unpack(order + ("Q" if big else "I"), e[4:12] if big else e[4:8])[0]
            slot = e[12:] if big else e[8:]
            size = _SIZES.get(kind, 1) * count
            if size > len(slot):
                f.seek(struct.unpack(order + ("Q" if big else "I"), slot)[0])
                data = f.read(size)
            else:
                data = slot[:size]
            if kind == 2:
                value = data.rstrip(b"\0").decode("latin-1")
            elif kind in (5, 10):
                pairs = struct.unpack(order + ("I" if kind == 5 else "i") * 2 * count, data)
                value = [a / b if b else 0.0 for a, b in zip(pairs[::2], pairs[1::2])]
            elif kind in _CODES:
                value = list(struct.unpack(order + _CODES[kind] * count, data))
            else:
                value = data
            one = value[0] if isinstance(value, list) and value else value
            for number, name in ((256, "width"), (257, "height"), (258, "bits"), (259, "compression"), (262, "photometric"), (277, "samples"), (278, "rows"), (282, "x_resolution"), (283, "y_resolution"), (339, "format"), (270, "description"), (305, "software")):
                if tag == number:
                    setattr(p, name, one)
            if tag == 273:
                p.offsets = value
            if tag == 279:
                p.counts = value
        planes.append(p)
        at = struct.unpack(order + ("Q" if big else "I"), tail)[0]
    return order, planes


def _dtype(order: str, p: Plane) -> np.dtype:
    kind = {(8, 1): "u1", (16, 1): "u2", (32, 3): "f4"}.get((p.bits, p.format))
    if kind is None or p.compression != 1 or p.samples != 1:
        raise ValueError(f"unsupported TIFF: {p.bits} bits, format {p.format}, compression {p.compression}")
    return np.dtype(order + kind)


def supported(p: Plane) -> bool:
    """Uncompressed, 16 bit integers or floats, black is zero: stricter than what the reader takes."""
    return p.compression == 1 and (p.bits, p.format) in ((16, 1), (32, 3)) and p.photometric == 1 and p.samples == 1


def read_plane(f, order: str, p: Plane, y0: int = 0, ny: int | None = None) -> np.ndarray:
    """Rows y0 to y0 + ny of a plane; of their strips only these rows are read."""
    end = p.height if ny is None else min(y0 + ny, p.height)
    dtype, rows = _dtype(order, p), min(p.rows or p.height, p.height)
    line, parts = p.width * dtype.itemsize, []
    for k in range(y0 // rows, -(-end // rows)):
        first, last = max(y0, k * rows), min(end, (k + 1) * rows)
        f.seek(p.offsets[k] + (first - k * rows) * line)
        parts.append(np.frombuffer(f.read((last - first) * line), dtype))
    return np.concatenate(parts).reshape(-1, p.width).astype(np.float64)


@dataclass
class _Planes(InputPartition):
    """A few planes of a file, with their directory entries."""

    path: str
    order: str
    z0: int
    planes: list[Plane]


def voxel_batch(path: str, z: int, y0: int, x0: int, data: np.ndarray) -> pa.RecordBatch:
    """Rows (image_id, x, y, z, v) of a part of a plane."""
    y, x = np.indices(data.shape, np.int32)
    n = data.size
    return pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(x.ravel() + np.int32(x0)), pa.array(y.ravel() + np.int32(y0)), pa.array(np.full(n, z, np.int32)), pa.array(data.ravel())], ["image_id", "x", "y", "z", "v"])


class _Files:
    """Planes of files as partitions, for tables and for streams."""

    def __init__(self, options):
        self.o, self.box = options, Box.of_options(options)

    def parts(self, paths: list[str]) -> list[_Planes]:
        out, step = [], int(self.o.get("planes", 8))
        for path in filter(self.box.has, paths):
            with open_in(path) as f:
                order, planes = directories(f)
            z0, z1 = self.box.span("z", len(planes))
            out += [_Planes(path, order, z, planes[z : min(z + step, z1)]) for z in range(z0, z1, step)]
        return out

    def read(self, part: _Planes):
        with open_in(part.path) as f:
            for k, plane in enumerate(part.planes):
                (x0, x1), (y0, y1) = self.box.span("x", plane.width), self.box.span("y", plane.height)
                if x0 < x1 and y0 < y1:
                    yield voxel_batch(part.path, part.z0 + k, y0, x0, read_plane(f, part.order, plane, y0, y1 - y0)[:, x0:x1])


class _Reader(_Files, DataSourceReader):
    def partitions(self):
        return self.parts(listed(self.o["path"]))


class _Stream(_Files, Arrivals):
    ending = ".tif"


class TiffSource(DataSource):
    @classmethod
    def name(cls):
        return "tessera_tiff"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)


def info(spark, path: str) -> DataFrame:
    """INFO: one row a file, from the directories alone."""

    def run(batches):
        for batch in batches:
            rows = []
            for p in batch.column("path").to_pylist():
                with open_in(p) as f:
                    _, planes = directories(f)
                a = planes[0]
                spacing = next((float(line[8:]) for line in a.description.split("\n") if line.startswith("spacing=")), 0.0)
                rows.append((p, a.width, a.height, len(planes), a.bits, a.format, a.compression, a.photometric, float(a.x_resolution), float(a.y_resolution), spacing, a.description, a.software, all(map(supported, planes))))
            names = [c.split()[0] for c in INFO.split(", ")]
            kinds = {"int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in INFO.split(", ")]))

    files = listed(path)
    return spark.createDataFrame([(p,) for p in files], "path string").repartition(len(files)).mapInArrow(run, INFO)


def pages(nx: int, ny: int, nz: int, bits: int = 16, description: str = "", resolution: tuple[float, float] = (0.0, 0.0), software: str = "tessera", big: bool | None = None):
    """The pieces of a little-endian stack in the file's order: headers as bytes, planes as their numbers, one strip a plane; big files where offsets
    need it."""
    item, fmt = (2, 1) if bits == 16 else (4, 3)
    big = nx * ny * nz * item + (nz << 10) + (1 << 20) >= 1 << 32 if big is None else big
    word, slot, entry = ("Q", 8, 20) if big else ("I", 4, 12)
    head = struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) if big else struct.pack("<2sHI", b"II", 42, 8)
    yield head
    here, size = len(head), nx * ny * item
    texts = (description.encode("latin-1", "replace") + b"\0", software.encode() + b"\0")
    ratio = lambda r: struct.pack("<II", int(round(r * 1_000_000)), 1_000_000)
    tags = [(256, 4, 1, nx), (257, 4, 1, ny), (258, 3, 1, bits), (259, 3, 1, 1), (262, 3, 1, 1), (270, 2, len(texts[0]), texts[0]), (273, 16 if big else 4, 1, None), (277, 3, 1, 1), (278, 4, 1, ny), (279, 16 if big else 4, 1, size), (282, 5, 1, ratio(resolution[0])), (283, 5, 1, ratio(resolution[1])), (305, 2, len(texts[1]), texts[1]), (339, 3, 1, fmt)]
    for z in range(nz):
        extra_at = here + (8 if big else 2) + entry * len(tags) + slot
        extra, rows = bytearray(), bytearray()
        pixels_at = extra_at + sum(len(t[3]) + len(t[3]) % 2 for t in tags if isinstance(t[3], bytes) and len(t[3]) > slot)
        for tag, kind, count, value in tags:
            value = pixels_at if value is None else value
            if isinstance(value, bytes):
                if len(value) > slot:
                    data = struct.pack("<" + word, extra_at + len(extra))
                    extra += value + b"\0" * (len(value) % 2)
                else:
                    data = value.ljust(slot, b"\0")
            else:
                data = struct.pack("<" + {3: "H", 4: "I", 16: "Q"}[kind], value).ljust(slot, b"\0")
            rows += struct.pack("<HH" + word, tag, kind, count) + data
        here = pixels_at + size + size % 2
        yield struct.pack("<Q" if big else "<H", len(tags)) + bytes(rows) + struct.pack("<" + word, 0 if z == nz - 1 else here) + bytes(extra)
        yield z
        yield b"\0" * (size % 2)


def encode(volume: np.ndarray, bits: int = 16, description: str = "", resolution: tuple[float, float] = (0.0, 0.0), software: str = "tessera", big: bool | None = None) -> bytes:
    """A stack of volume (z, y, x) as one file; see pages."""
    nz, ny, nx = volume.shape
    dtype = "<u2" if bits == 16 else "<f4"
    return b"".join(p if isinstance(p, bytes) else volume[p].astype(dtype).tobytes() for p in pages(nx, ny, nz, bits, description, resolution, software, big))


def write(df: DataFrame, path: str, bits: int = 16, scaling: float = 0.0, overwrite: bool = False, **tags) -> DataFrame:
    """Write images (image_id, x, y, z, v), each as path/<image_id>.tif: (path, written). A file that exists stays unless overwrite.

    16 bit values are scaled by scaling, or 65535 / max where that is not positive, rounded and clamped; what is not finite becomes 0. Images of
    any size: see strips.write."""

    def pixels(v: np.ndarray, top: float) -> np.ndarray:
        if bits != 16:
            return v
        s = scaling if scaling > 0 and np.isfinite(scaling) else 65535 / top if top > 0 else 1.0
        return np.where(np.isfinite(v), np.clip(np.floor(v * s + 0.5), 0, 65535), 0)

    return strips.write(df, path, ".tif", "<u2" if bits == 16 else "<f4", overwrite, pixels, lambda nx, ny, nz: pages(nx, ny, nz, bits, **tags))


def flat_description(text: str) -> str:
    """The description of a plane made of a stack: lines images= and slices= go, if the text says ImageJ=."""
    return "\n".join(line for line in text.split("\n") if not line.startswith(("images=", "slices="))) if "ImageJ=" in text else text
