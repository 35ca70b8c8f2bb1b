"""Session helpers: a local session for tests and benches, shared-folder tables, size-checked broadcasts."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

#: Largest estimated size, in bytes, of a side that is broadcast by hint.
BROADCAST_BYTES = 8 << 20


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the library expects (UTC, AQE)."""
    os.environ.setdefault("PYSPARK_PYTHON", os.sys.executable)
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lodeframe")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers of a session.

    Nothing is done where they find it anyway, by PYTHONPATH or the working folder.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sc = spark.sparkContext
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if getattr(sc, "_lodeframe_shipped", False) or any(os.path.abspath(p) == root for p in known if p):
        return
    folder = tempfile.mkdtemp(prefix="lodeframe-zip-")
    archive = shutil.make_archive(os.path.join(folder, "lodeframe"), "zip", root, "lodeframe")
    sc.addPyFile(archive)
    sc._lodeframe_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is what the cluster names in ``spark.checkpoint.dir``. Where that is unset, a
    temporary folder serves a local master; on a cluster it is an error, as no machine's own folder is shared.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lodeframe-")
        sc.setCheckpointDir(named)
    return named


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a compressed table in the shared folder and read it back.

    Cuts the lineage and survives the loss of executors. The table is removed
    when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodeframe-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return spark.read.schema(df.schema).parquet(path)


def at_once(*jobs: Callable[[], T]) -> list[T]:
    """Runs independent jobs in threads of their own and returns their results in order; the first failure is raised.

    Short jobs that wait for one another leave most of a cluster idle.
    """
    out: list = [None] * len(jobs)
    failed: list[BaseException] = []

    def run(i: int) -> None:
        try:
            out[i] = jobs[i]()
        except BaseException as e:  # noqa: BLE001 - raised below
            failed.append(e)

    threads = [InheritableThread(target=run, args=(i,)) for i in range(len(jobs))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    if failed:
        raise failed[0]
    return out


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of ``df`` in bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, rows: int | None = None, row_bytes: int = 64, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast of ``df`` only if its size is known to be within ``limit``.

    With ``rows`` (a counted number of rows) the size is rows times row_bytes,
    else Catalyst's estimate. Beyond the limit no hint is given and the join
    shuffles, split by AQE where a key is hot.
    """
    size = rows * row_bytes if rows is not None else estimated_bytes(df)
    return F.broadcast(df) if size <= limit else df
