"""Images written strip by strip: tasks write the pixels of bands of rows into part files, a last task for each image joins them behind its headers.

No task holds more than a strip of STRIP bytes, whatever an image's size, and nothing goes through the driver. The place of every strip in the file
follows from the image's size. A task that runs again writes its part again."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.checkpoints import stored
from tessera.model import AXES
from tessera.sources.files import exists, open_in, remove, resolve, write_bytes

#: Bytes of pixels that a task holds; images whose sizes are broadcast.
STRIP, FEW = 8 << 20, 100_000


def copy_into(f, path: str, step: int = 1 << 20) -> int:
    """Append a file to an open stream, a megabyte at a time; how many bytes."""
    n = 0
    with open_in(path) as part:
        while data := part.read(step):
            f.write(data)
            n += len(data)
    return n


def sizes(df: DataFrame) -> DataFrame:
    """(image_id, nx, ny, nz, top): one row an image; top is its largest finite value, 0 at least."""
    finite = F.when(~F.isnan("v") & (F.abs("v") != float("inf")), F.col("v"))
    return df.groupBy("image_id").agg(*[(F.max(a) + 1).cast("int").alias("n" + a) for a in AXES], F.greatest(F.coalesce(F.max(finite), F.lit(0.0)), F.lit(0.0)).alias("top"))


def write(df: DataFrame, path: str, ending: str, dtype: str, overwrite: bool, pixels: Callable, layout: Callable) -> DataFrame:
    """Images (image_id, x, y, z, v) as path/<image_id><ending>: (path, written). A file that exists stays unless overwrite.

    pixels: (values, top) to values of dtype; layout: (nx, ny, nz) to an iterator of headers and planes in the file's order: bytes, or the number
    of a plane. Voxels that are missing are 0."""
    dtype_ = np.dtype(dtype)
    work = f"{path}/.parts-{uuid.uuid4().hex}"
    name = lambda image: f"{path}/{image}{ending}"

    def there(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([not overwrite and exists(name(i)) for i in b.column("image_id").to_pylist()], pa.bool_())], [*b.schema.names, "there"])

    own = stored(sizes(df.withColumn("v", F.col("v").cast("double"))).withColumn("image_id", F.col("image_id").cast("string")).mapInArrow(there, "image_id string, nx int, ny int, nz int, top double, there boolean"))
    todo = own.where("not there").withColumn("band_rows", F.greatest(F.lit(1), F.floor(F.lit(STRIP) / (F.col("nx") * dtype_.itemsize)).cast("int")))
    todo = F.broadcast(todo) if own.limit(FEW + 1).count() <= FEW else todo
    voxels = df.select(F.col("image_id").cast("string").alias("image_id"), *AXES, F.col("v").cast("double").alias("v")).join(todo.drop("there"), "image_id")
    keys = ["image_id", "z", "band", "nx", "ny", "top", "band_rows"]
    voxels = voxels.withColumn("band", F.floor(F.col("y") / F.col("band_rows")).cast("int")).select(*keys, "x", "y", "v")
    # Every strip has a row without value, so strips without voxels are written too.
    every = todo.withColumn("z", F.explode(F.sequence(F.lit(0), F.col("nz") - 1))).withColumn("band", F.explode(F.sequence(F.lit(0), F.floor((F.col("ny") - 1) / F.col("band_rows")).cast("int"))))
    every = every.select(*keys, F.lit(0).alias("x"), (F.col("band") * F.col("band_rows")).alias("y"), F.lit(None).cast("double").alias("v"))

    def strip(table: pa.Table) -> pa.Table:
        image, z, band, nx, ny, top, rows = (table.column(c)[0].as_py() for c in keys)
        given = table.filter(table.column("v").is_valid())
        y0 = band * rows
        out = np.zeros((min(ny, y0 + rows) - y0, nx))
        out[given.column("y").to_numpy() - y0, given.column("x").to_numpy()] = given.column("v").to_numpy()
        part = f"{work}/{image}/{z:08d}-{band:08d}"
        write_bytes(part, pixels(out, top).astype(dtype_).tobytes())
        return pa.table({"image_id": [image], "z": pa.array([z], pa.int32()), "band": pa.array([band], pa.int32()), "part": [part]})

    parts = stored(voxels.unionByName(every).groupBy("image_id", "z", "band").applyInArrow(strip, "image_id string, z int, band int, part string"))

    def join(table: pa.Table, size: pa.Table) -> pa.Table:
        image = size.column("image_id")[0].as_py()
        if size.column("there")[0].as_py():
            return pa.table({"path": [name(image)], "written": [False]})
        found = table.sort_by([("z", "ascending"), ("band", "ascending")])
        by: dict[int, list[str]] = {}
        for z, part in zip(found.column("z").to_pylist(), found.column("part").to_pylist()):
            by.setdefault(z, []).append(part)
        fs, p = resolve(name(image))
        with fs.open_output_stream(p) as f:
            for piece in layout(*(size.column("n" + a)[0].as_py() for a in AXES)):
                if isinstance(piece, bytes):
                    f.write(piece)
                else:
                    for part in by[piece]:
                        copy_into(f, part)
        return pa.table({"path": [name(image)], "written": [True]})

    done = stored(parts.groupBy("image_id").cogroup(own.groupBy("image_id")).applyInArrow(join, "path string, written boolean"))
    remove(work)
    return done


def write_rows(df: DataFrame, path: str, head: Callable[[int, int], bytes], dtype: str = "<f4") -> str:
    """A table of numbers, row by row in df's order, behind head(rows, columns): tasks write the rows of their partitions, one task joins them."""
    columns = df.columns
    work = f"{path}.parts-{uuid.uuid4().hex}"

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n, at = 0, TaskContext.get().partitionId()
        part = f"{work}/{at:08d}"
        write_bytes(part, b"")
        fs, p = resolve(part)
        with fs.open_output_stream(p) as f:
            for b in batches:
                f.write(np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], 1).astype(dtype).tobytes())
                n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([n], pa.int64()), pa.array([part])], ["at", "n", "part"])

    parts = stored(df.mapInArrow(put, "at int, n long, part string"))

    def join(table: pa.Table) -> pa.Table:
        found = table.sort_by("at")
        fs, p = resolve(path)
        with fs.open_output_stream(p) as f:
            f.write(head(sum(found.column("n").to_pylist()), len(columns)))
            for part in found.column("part").to_pylist():
                copy_into(f, part)
        return pa.table({"path": [path]})

    stored(parts.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(join, "path string"))  # one row a partition
    remove(work)
    return path
