"""Sessions and shared folders."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_own: dict[str, str] = {}
#: Scratch paths of this process, in the order in which they were made.
made: list[str] = []
#: Bytes of an Arrow batch that goes to a Python worker.
ARROW_BYTES = 4 << 20
#: Bytes of input a core from which file splits are spread well enough by themselves.
SPREAD = 128 << 20


def local_session(cores: int = 8, memory: str = "8g", app: str = "lectern") -> SparkSession:
    """A local session with the settings that the library is tested with."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see.

    It's what the cluster names in spark.checkpoint.dir. Only where that is unset
    on one machine (a local master, as in tests) a local folder is made; elsewhere that is an error.
    """
    named = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not named and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError(f"on a cluster {_KEY} must name a folder that all executors see")
    if not named:
        named = _own.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="lectern-shared-"))
        atexit.register(shutil.rmtree, named.removeprefix("file://"), ignore_errors=True)
    return named.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    made.append(f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}")
    return made[-1]


def sweep(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch paths that nothing reads any more."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(hadoop).delete(p, True)
        made.remove(path)


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    path = scratch(ship(df.sparkSession), what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt to all cores, for costly row-wise work on a few small files: splits of a file with one row group are empty but for one. Inputs of SPREAD bytes a core and more stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df if size >= cores * SPREAD else df.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Make a session ready for Python functions of this package.

    Executors get the package as a zip, once an application, wherever they run; Arrow batches are
    bounded by bytes, so very long texts don't fill a worker.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        top, tmp = Path(__file__).resolve().parent, tempfile.mkdtemp(prefix="lectern-zip-")
        atexit.register(shutil.rmtree, tmp, ignore_errors=True)  # the driver serves it until it ends
        with zipfile.ZipFile(path := os.path.join(tmp, "lectern_package.zip"), "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        sc.addPyFile(path)
        _shipped.add(sc.applicationId)
    return spark
