"""Sessions, table access and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []
_shipped: set[str] = set()
_written: list[str] = []


def local_session(cores: str = "8", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("twinlens")
    base = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    spark = b.config(map=base | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Gives the workers this package, once per application, so that it need not be installed where they run."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        folder = tempfile.mkdtemp(prefix="twinlens-code-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        here = Path(__file__).parent
        with zipfile.ZipFile(f"{folder}/twinlens-code.zip", "w") as out:
            for file in sorted(here.rglob("*.py")):
                out.write(file, file.relative_to(here.parent))
        spark.sparkContext.addPyFile(f"{folder}/twinlens-code.zip")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset (a local test), a folder of our own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="twinlens-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return _own_dir[0]


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Writes a table in the shared folder and reads it back: cuts lineage and survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/twinlens-{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_release_at_exit, spark)
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, keep: int = 0) -> None:
    """Deletes the tables written by materialize(), all but the last ``keep``."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while len(_written) > keep:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop(0))
        path.getFileSystem(conf).delete(path, True)


def _release_at_exit(spark: SparkSession) -> None:
    try:
        release(spark)
    except Exception:  # the JVM is gone already
        _written.clear()


def width(spark: SparkSession) -> int:
    """Number of partitions for explicit repartitioning."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
