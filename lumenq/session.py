"""Session set-up, table loading and durable materialisation."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the engine assumes (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lumenq")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once a context, unless it is installed there."""
    sc = spark.sparkContext
    root = Path(__file__).resolve().parent
    if getattr(sc, "_lumenq_shipped", False) or "site-packages" in root.parts:
        return
    sc._lumenq_shipped = True
    folder = tempfile.mkdtemp(prefix="lumenq-code-")
    atexit.register(shutil.rmtree, folder, True)
    archive = f"{folder}/lumenq.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, Path(root.name) / path.relative_to(root))
    sc.addPyFile(archive)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only where a local session names none (tests, a laptop) a temporary folder of this machine is
    used, and set as the session's checkpoint folder. On a cluster it must be named.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="lumenq-")
    atexit.register(shutil.rmtree, own, True)
    spark.sparkContext.setCheckpointDir(own)
    return f"file://{own}"


def task_count(spark: SparkSession) -> int:
    """Tasks for work whose cost isn't its size in bytes: a number of the session, whatever the data.

    An exchange asked for by number isn't coalesced at runtime, so such groups stay spread.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A place for a table in the shared folder, removed when the driver's Python process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/lumenq-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage: an executor that is lost later costs a read, not a recomputation. The
    table is removed when the driver's Python process ends.
    """
    spark = df.sparkSession
    ship(spark)
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
