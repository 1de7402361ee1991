"""Session settings and scratch space shared by every operator."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def build_session(cpus: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("fluvia")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


@lru_cache(maxsize=4)
def _archive(application: str) -> str:
    """A zip file of this package, made once for each application."""
    return shutil.make_archive(f"{_own_folder()}/fluvia-{application}", "zip", ROOT, "fluvia")


@lru_cache(maxsize=1)
def _own_folder() -> str:
    """A folder of the driver's own, removed when it ends."""
    path = tempfile.mkdtemp(prefix="fluvia-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, wherever they run: Spark sends it to them."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        sc.addPyFile(_archive(sc.applicationId))
        _shipped.add(sc.applicationId)
    return spark


_shipped: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one that spark.checkpoint.dir names.

    Where that is unset, a local session takes a folder of its own; elsewhere executors couldn't read
    one, so it has to be set. What an application leaves there can be removed when it has ended.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{_own_folder()}"
    return f"{path.rstrip('/')}/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared scratch folder and read it back: cuts lineage."""
    path = f"{scratch_dir(ship(df.sparkSession))}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
