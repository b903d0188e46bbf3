"""Session helpers: table access and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str | None:
    """The folder that all executors share, as the cluster names it.

    A local session that names none gets one of its own, removed when Python ends; on a cluster nothing takes its place.
    """
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named is None and sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        if not hasattr(sc, "_turfline_folder"):
            sc._turfline_folder = tempfile.mkdtemp(prefix="turfline-shared-")
            atexit.register(shutil.rmtree, sc._turfline_folder, ignore_errors=True)
        named = sc._turfline_folder
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage there."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = shared_folder(df.sparkSession)
        if folder is None:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` to be joined by shuffle, whatever size it is taken for.

    Spark broadcasts what it takes for small, and the driver holds it. Sizes it estimates count neither the rows that an
    explode makes of one nor those of a Python function, so that a table growing with the input may be broadcast.
    """
    return df.hint("merge")


def ship(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once per application; they need not find it on their own path.

    The archive lies in the shared folder. Without one, workers must find the package by themselves.
    """
    sc = spark.sparkContext
    if getattr(sc, "_turfline_shipped", False):
        return
    sc._turfline_shipped = True
    folder = shared_folder(spark)
    if folder is None:
        return
    root, packed = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    hadoop = sc._jvm.org.apache.hadoop.fs
    target = hadoop.Path(folder, f"{sc.applicationId}-package/turfline.zip")
    fs = target.getFileSystem(sc._jsc.hadoopConfiguration())
    stream = fs.create(target, True)
    stream.write(bytearray(packed.getvalue()))
    stream.close()
    sc.addPyFile(fs.makeQualified(target).toString())


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("turfline")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
