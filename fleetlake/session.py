"""Session helpers.

Library code never creates a session on its own; it reads settings from the
session it is given.  ``local_session`` is for tests, the smoke entry and the
bench only.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings the library relies on.  UTC keeps date formatting identical on every
# executor; AQE re-plans joins and coalesces partitions from runtime sizes.
LIBRARY_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

# The views' fused stages compile to methods beyond the 8000 bytes up to which
# HotSpot compiles; such stages run faster unfused.
VIEW_CONF = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session configured like the cluster one (UI off, UTC, AQE)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("fleetlake")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("FLEETLAKE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in LIBRARY_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_code()
    return spark


def ship_code() -> None:
    """Serialise this package's functions by value when Spark sends them to
    Python workers (``mapInPandas`` parsers and scorers), so executors need
    no installed copy of the package.  Installed copies work as well."""
    import fleetlake
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(fleetlake)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    Looks at ``spark.checkpoint.dir`` and at the context's checkpoint folder.
    When neither is set, a session whose tasks all run in the driver's process
    (local master) gets a scratch folder; any other session gets an error, as
    no folder of one machine would do.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="fleetlake-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def table(spark: SparkSession, sf_dir: str, name: str):
    """Read one driver table (parquet) lazily."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
