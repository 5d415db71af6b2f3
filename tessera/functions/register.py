"""Functions for SQL: scalar and table functions under names of their own."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf

from tessera.functions import images


def register(spark: SparkSession) -> None:
    """tessera_j0(x), tessera_lateral_resolution(wavelength, na), tessera_axial_resolution(wavelength, na), and the table functions
    tessera_psf_profile(z, wavelength, na, index, dxy, n) and tessera_grid(nx, ny, nz), besides those of images."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tessera_lateral_resolution(wavelength DOUBLE, na DOUBLE) RETURNS DOUBLE RETURN wavelength / (2 * na)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tessera_axial_resolution(wavelength DOUBLE, na DOUBLE) RETURNS DOUBLE RETURN 2 * wavelength / (na * na)")

    @pandas_udf("double")
    def bessel(x: pd.Series) -> pd.Series:
        from tessera.operators.psf import j0

        return pd.Series(j0(x.to_numpy(float)))

    spark.udf.register("tessera_j0", bessel)

    @udtf(returnType="i int, r double, v double")
    class Profile:
        def eval(self, z: float, wavelength: float, na: float, index: float, dxy: float, n: int):
            from tessera.operators.psf import born_wolf_profile

            r = np.arange(n) * float(dxy)
            for i, (a, v) in enumerate(zip(r, born_wolf_profile(r, float(z), float(wavelength), float(na), float(index)))):
                yield i, float(a), float(v)

    spark.udtf.register("tessera_psf_profile", Profile)

    grid = "CREATE OR REPLACE TEMPORARY FUNCTION tessera_grid(nx INT, ny INT, nz INT) RETURNS TABLE(x INT, y INT, z INT) RETURN "
    spark.sql(grid + "SELECT x, y, z FROM (SELECT explode(sequence(0, nz - 1)) AS z) LATERAL VIEW explode(sequence(0, ny - 1)) b AS y LATERAL VIEW explode(sequence(0, nx - 1)) a AS x WHERE least(nx, ny, nz) > 0")
    images.register(spark)
