"""NPY arrays, version 1.0: spark.read.format("tessera_npy") gives (image_id, x, y, z, v); an array's axes are z, y, x.
Options and streams as for tessera_tiff."""

from __future__ import annotations

import ast
import io
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.sources import strips
from tessera.sources.arrivals import Arrivals
from tessera.sources.boxes import Box
from tessera.sources.files import listed, open_in
from tessera.sources.tiff import SCHEMA, voxel_batch

TYPES = ("f8", "f4", "u1", "u2", "u4", "u8", "i1", "i2", "i4", "i8")


def header(f) -> tuple[np.dtype, tuple, bool, int]:
    """(type, shape, Fortran order, offset of the data)."""
    f.seek(0)
    head = f.read(10)
    if head[:6] != b"\x93NUMPY" or head[6:8] != b"\x01\x00":
        raise ValueError("not an NPY file of version 1.0")
    size = struct.unpack("<H", head[8:10])[0]
    said = ast.literal_eval(f.read(size).decode("latin-1"))
    if said["descr"][1:] not in TYPES:
        raise ValueError(f"unsupported type {said['descr']}")
    return np.dtype(said["descr"]), tuple(said["shape"]), said["fortran_order"], 10 + size


#: Voxels of a batch and, of planes larger than it, of a partition: a voxel is some forty bytes as a row.
BATCH, PART = 1 << 18, 1 << 22


@dataclass
class _Slab(InputPartition):
    """Planes z0 to z1 of a file, lines y0 to y1 of each."""

    path: str
    z0: int
    z1: int
    y0: int
    y1: int


class _Files:
    """Slabs of files as partitions, for tables and for streams."""

    def __init__(self, options):
        self.o, self.box = options, Box.of_options(options)

    def parts(self, paths: list[str]) -> list[_Slab]:
        out, step = [], int(self.o.get("planes", 8))
        for path in filter(self.box.has, paths):
            with open_in(path) as f:
                _, shape, fortran, _ = header(f)
            if len(shape) > 3:
                raise ValueError("at most three dimensions")
            nz, ny, nx = (1,) * (3 - len(shape)) + shape
            (z0, z1), (y0, y1) = self.box.span("z", nz), self.box.span("y", ny)
            lines = max(1, PART // max(1, nx))  # a plane of more is cut into partitions of so many lines
            if fortran or y1 - y0 <= lines:
                step_here = max(1, z1 - z0) if fortran else step
                out += [_Slab(path, z, min(z1, z + step_here), y0, y1) for z in range(z0, z1, step_here)]
            else:
                out += [_Slab(path, z, z + 1, y, min(y1, y + lines)) for z in range(z0, z1) for y in range(y0, y1, lines)]
        return out

    def read(self, part: _Slab):
        with open_in(part.path) as f:
            dtype, shape, fortran, at = header(f)
            shape = (1,) * (3 - len(shape)) + shape
            x0, x1 = self.box.span("x", shape[2])
            if x0 == x1 or part.y0 == part.y1:
                return
            if fortran:
                f.seek(at)
                whole = np.frombuffer(f.read(), dtype).reshape(shape, order="F")
            line = shape[2] * dtype.itemsize
            lines = max(1, BATCH // shape[2])
            for z in range(part.z0, part.z1):
                for y in range(part.y0, part.y1, lines):
                    end = min(part.y1, y + lines)
                    if fortran:
                        rows = whole[z, y:end]
                    else:
                        f.seek(at + (z * shape[1] + y) * line)
                        rows = np.frombuffer(f.read((end - y) * line), dtype).reshape(-1, shape[2])
                    yield voxel_batch(part.path, z, y, x0, rows[:, x0:x1].astype(np.float64))


class _Reader(_Files, DataSourceReader):
    def partitions(self):
        return self.parts(listed(self.o["path"]))


class _Stream(_Files, Arrivals):
    ending = ".npy"


class NpySource(DataSource):
    @classmethod
    def name(cls):
        return "tessera_npy"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)


def encode(array: np.ndarray, dtype: str | None = None) -> bytes:
    """The array as it is; another type than its own is refused."""
    if dtype is not None and np.dtype(dtype) != array.dtype:
        raise ValueError("input and output types must match")
    out = io.BytesIO()
    np.lib.format.write_array(out, array, version=(1, 0), allow_pickle=False)
    return out.getvalue()


def head_of(shape: tuple, dtype: str = "<f4") -> bytes:
    buffer = io.BytesIO()
    np.lib.format.write_array_header_1_0(buffer, {"descr": dtype, "fortran_order": False, "shape": shape})
    return buffer.getvalue()


def write(df: DataFrame, path: str, dtype: str = "<f4") -> DataFrame:
    """Each image (image_id, x, y, z, v) as path/<image_id>.npy: (path). Images of any size: see strips.write."""
    return strips.write(df, path, ".npy", dtype, True, lambda v, top: v, lambda nx, ny, nz: iter([head_of((nz, ny, nx), dtype), *range(nz)])).select("path")


def write_table(df: DataFrame, path: str) -> str:
    """A float table, as many rows as it may have, as one two-dimensional array in df's order, written by tasks and joined by one."""
    return strips.write_rows(df, path, lambda rows, columns: head_of((rows, columns)))
