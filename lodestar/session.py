"""Session helpers: shared scratch tables that survive a lost executor."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Read one Parquet table of a data directory (any path Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a folder of our own only where it is unset and Spark runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="lodestar-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return f"file://{_OWN[app]}"


def app_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/lodestar/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def sweep(spark: SparkSession) -> None:
    """Delete all tables that :func:`written` made for this application; results that still read them are void from then on."""
    _delete(spark, app_folder(spark))


def written(df: DataFrame, tag: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Cut the lineage of ``df``: write it to the shared folder as Parquet and read it back.

    Unlike an in-memory cache or a local checkpoint this outlives executors, and the
    reader gets column pruning, filter pushdown and size statistics. ``by``: columns that become
    folders, so that a filter on them reads only those.
    """
    spark = df.sparkSession
    path = f"{app_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestar_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written` that no later plan reads."""
    path = getattr(df, "_lodestar_path", None)
    if path:
        _delete(df.sparkSession, path)


def local_session(cores: int | None = None, memory: str = "8g") -> SparkSession:
    """A session for tests and the benchmark."""
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]").appName("lodestar")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
