"""Session, shared scratch folder and size checks used by every operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a side that is broadcast. The callers' rows are a few numbers wide (at most about 64 bytes), so 300,000
#: of them stay under 20 MB in each executor however large the other tables are; beyond it the join is shuffled.
BROADCAST_ROWS = 300_000

_local_root: str | None = None


def get_spark(app: str = "ledgerfen", cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that don't have its folder on their path; once for each application.

    Nothing is done where the workers' environment names the folder already, as it does when the driver was started with
    PYTHONPATH or from the folder itself.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    app = spark.sparkContext.applicationId
    env = (spark._jvm.System.getenv("PYTHONPATH") or "").split(os.pathsep)
    if app in _shipped or root in map(os.path.abspath, filter(None, env)) or os.path.abspath(os.getcwd()) == root:
        return
    _shipped.add(app)
    with tempfile.TemporaryDirectory(prefix="ledgerfen-package-") as tmp:
        # the driver serves the file to the executors, which read it from there, not from this folder
        shutil.copytree(os.path.join(root, "ledgerfen"), os.path.join(tmp, "in", "ledgerfen"), ignore=shutil.ignore_patterns("__pycache__"))
        archive = shutil.make_archive(os.path.join(tmp, "ledgerfen_package"), "zip", os.path.join(tmp, "in"))
        _kept = os.path.join(tempfile.mkdtemp(prefix="ledgerfen-package-"), "ledgerfen_package.zip")
        shutil.move(archive, _kept)
    atexit.register(shutil.rmtree, os.path.dirname(_kept), True)
    spark.sparkContext.addPyFile(_kept)


def shared_root(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir`` of the session, or, on a local master only, a folder of our own."""
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="ledgerfen-")
        atexit.register(shutil.rmtree, _local_root, True)
    return f"file://{_local_root}"


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/ledgerfen/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in this application's part of the shared folder."""
    return f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Delete what this application has in the shared folder; DataFrames that read from there can't be used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder, which outlives any executor."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))


def if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint when ``rows``, a count that bounds its rows, is within ``limit``; as it is otherwise."""
    return F.broadcast(df) if rows <= limit else df
