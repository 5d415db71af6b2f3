"""Table functions over voxels for SQL: tables in, tables out, a block of an image or a whole small one a call.

    SELECT * FROM tessera_smooth(TABLE(SELECT * FROM tessera_blocks(TABLE(voxels), 128, 64, 8, 4)) PARTITION BY (image_id, block), 1.0D, 0.5D)

tessera_blocks repeats voxels for the blocks that need them; a function then works on the voxels of a block and gives back those of its core. With
PARTITION BY (image_id) alone a whole image is one call. Voxels that a table lacks are 0; columns other than image_id, block, own, x, y, z, v are not
looked at; without image_id it is null."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from tessera.model import AXES, Grid

VOXELS = "image_id string, x int, y int, z int, v double"
#: Blocks an image may have along an axis.
ALONG = 1 << 20


def _column(table, name: str, default, kind: pa.DataType):
    return table.column(name).cast(kind) if name in table.schema.names else pa.array([default] * table.num_rows, kind)


class Blockwise:
    """Gathers the rows of a partition into an array, works on it and gives back what its block owns."""

    def __init__(self):
        self.batches, self.told = [], ()

    def gather(self, batch: pa.RecordBatch, *told: pa.Array) -> list:
        """Keep a batch; rows come when all are there."""
        self.batches.append(pa.RecordBatch.from_arrays([_column(batch, "image_id", None, pa.string()), *[_column(batch, a, 0, pa.int32()) for a in AXES], _column(batch, "v", 0.0, pa.float64()), _column(batch, "own", True, pa.bool_())], ["image_id", *AXES, "v", "own"]))
        self.told = tuple(t[0].as_py() for t in told)
        return []

    def array(self) -> tuple[np.ndarray, np.ndarray, list[int], str | None]:
        """(values, which are owned, first place of x, y and z, image)."""
        table = pa.Table.from_batches(self.batches)
        at = [table.column(a).to_numpy() for a in AXES]
        first = [int(a.min()) for a in at]
        index = tuple((a - f for a, f in zip(at[::-1], first[::-1])))
        values, own = np.zeros([int(a.max()) + 1 for a in index]), np.zeros([int(a.max()) + 1 for a in index], bool)
        values[index] = table.column("v").to_numpy()
        own[index] = table.column("own").to_numpy(zero_copy_only=False)
        return values, own, first, table.column("image_id")[0].as_py()

    def rows(self, values: np.ndarray, keep: np.ndarray, first: list[int], image: str | None) -> pa.Table:
        at = keep.nonzero()
        places = [pa.array((a + f).astype(np.int32)) for a, f in zip(at[::-1], first)]
        return pa.table([pa.array([image] * len(at[0]), pa.string()), *places, pa.array(values[at])], ["image_id", *AXES, "v"])


def blocks():
    @arrow_udtf(returnType="image_id string, block long, own boolean, x int, y int, z int, v double")
    class Blocks:
        """(voxels, side along x and y, side along z, halo along x and y, halo along z)."""

        def eval(self, batch: pa.RecordBatch, side, side_z, halo, halo_z):
            at = {a: batch.column(a).to_numpy(zero_copy_only=False).astype(np.int64) for a in AXES}
            sides = dict(zip(AXES, (side[0].as_py(), side[0].as_py(), side_z[0].as_py())))
            halos = dict(zip(AXES, (halo[0].as_py(), halo[0].as_py(), halo_z[0].as_py())))
            image, v = _column(batch, "image_id", None, pa.string()), _column(batch, "v", 0.0, pa.float64())
            far = {a: -(-halos[a] // sides[a]) for a in AXES}  # how many blocks away a voxel may be asked for
            spans = {a: range(-far[a], far[a] + 1) for a in AXES}
            for i in spans["x"]:
                for j in spans["y"]:
                    for k in spans["z"]:
                        use, numbers, own = np.ones(batch.num_rows, bool), [], np.full(batch.num_rows, (i, j, k) == (0, 0, 0))
                        for a, step in zip(AXES, (i, j, k)):
                            b = at[a] // sides[a] + step
                            use &= (b >= 0) & (at[a] >= b * sides[a] - halos[a]) & (at[a] < (b + 1) * sides[a] + halos[a])
                            numbers.append(b)
                        block = (numbers[2] * ALONG + numbers[1]) * ALONG + numbers[0]
                        yield pa.table([image, pa.array(block), pa.array(own), *[pa.array(at[a].astype(np.int32)) for a in AXES], v], ["image_id", "block", "own", *AXES, "v"]).filter(pa.array(use))

    return Blocks


def smooth():
    @arrow_udtf(returnType=VOXELS)
    class Smooth(Blockwise):
        """(voxels, sigma, sigma along z): see stencil.smooth."""

        def eval(self, batch: pa.RecordBatch, sigma, sigma_z):
            yield from self.gather(batch, sigma, sigma_z)

        def terminate(self):
            from tessera.operators import dense
            from tessera.operators.stencil import gaussian

            if self.batches:
                v, own, first, image = self.array()
                lateral, axial = self.told
                for a, s in zip(AXES, (lateral, lateral, axial)):
                    if s > 0 and (a != "z" or v.shape[0] > 1):
                        v = dense.correlate(v, a, gaussian(s, 2 * v.shape[0] - 1) if a == "z" else gaussian(s), "normalized")
                yield self.rows(v, own, first, image)

    return Smooth


def maxima():
    @arrow_udtf(returnType=VOXELS)
    class Maxima(Blockwise):
        """(voxels, sigma, sigma along z): strict local maxima of the Laplacian of Gaussian; halos need one voxel more than the filter."""

        def eval(self, batch: pa.RecordBatch, sigma, sigma_z):
            yield from self.gather(batch, sigma, sigma_z)

        def terminate(self):
            from tessera.operators import dense
            from tessera.operators.stencil import log_of_gaussian

            if self.batches:
                v, own, first, image = self.array()
                v = log_of_gaussian(v, v.shape[0] > 1, *self.told)
                yield self.rows(v, own & dense.maxima(v, (0, 0, 0), Grid(*v.shape[::-1])), first, image)

    return Maxima


def deconvolve():
    @arrow_udtf(returnType=VOXELS)
    class Deconvolve(Blockwise):
        """(voxels, sigma, sigma along z of a Gaussian point-spread function, iterations): see recon.deconvolve; halos as wide as the function's reach."""

        def eval(self, batch: pa.RecordBatch, sigma, sigma_z, iterations):
            yield from self.gather(batch, sigma, sigma_z, iterations)

        def terminate(self):
            from tessera.operators import recon
            from tessera.operators.stencil import gaussian

            if self.batches:
                v, own, first, image = self.array()
                lateral, axial, iterations = self.told
                g, deep = np.array(gaussian(lateral)), np.array(gaussian(axial)) if v.shape[0] > 1 else np.ones(1)
                o = recon.Options(iterations=iterations)
                yield self.rows(np.maximum(recon.deconvolve(v + o.offset, deep[:, None, None] * g[:, None] * g, o)[0] - o.offset, 0), own, first, image)

    return Deconvolve


def read():
    @arrow_udtf(returnType=VOXELS)
    class Read:
        """(table of path): the voxels of TIFF files, plane by plane."""

        def eval(self, batch: pa.RecordBatch):
            from tessera.sources import tiff
            from tessera.sources.files import open_in

            for path in batch.column("path").to_pylist():
                with open_in(path) as f:
                    order, planes = tiff.directories(f)
                    for z, plane in enumerate(planes):
                        yield pa.Table.from_batches([tiff.voxel_batch(path, z, 0, 0, tiff.read_plane(f, order, plane))])

    return Read


def write():
    @arrow_udtf(returnType="path string, voxels long")
    class Write(Blockwise):
        """(voxels, folder): a TIFF stack of floats an image, which one call holds; sources.tiff.write takes larger ones."""

        def eval(self, batch: pa.RecordBatch, folder):
            yield from self.gather(batch, folder)

        def terminate(self):
            from tessera.sources import tiff
            from tessera.sources.files import write_bytes

            if self.batches:
                v, _, first, image = self.array()
                path = f"{self.told[0]}/{image}.tif"
                write_bytes(path, tiff.encode(np.pad(v, [(f, 0) for f in first[::-1]]), 32))
                yield pa.table([pa.array([path]), pa.array([v.size], pa.int64())], ["path", "voxels"])

    return Write


def register(spark: SparkSession) -> None:
    """tessera_blocks, tessera_smooth, tessera_maxima, tessera_deconvolve, tessera_read and tessera_write."""
    for name, make in (("blocks", blocks), ("smooth", smooth), ("maxima", maxima), ("deconvolve", deconvolve), ("read", read), ("write", write)):
        spark.udtf.register("tessera_" + name, make())
