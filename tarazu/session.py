"""Session factory and the few helpers that touch session state."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: int | str = "*", app: str = "tarazu", **conf: str) -> SparkSession:
    """A local session with the settings that the engine's results rely on."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8" if cores == "*" else str(cores),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    if "spark.checkpoint.dir" not in settings:
        settings["spark.checkpoint.dir"] = _own_folder()
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ship(spark)
    return spark


def _own_folder(use: str = "checkpoints") -> str:
    """A fresh folder that is removed when the driver ends. Only for local masters and for
    what the driver itself serves."""
    where = tempfile.mkdtemp(prefix=f"tarazu-{use}-")
    atexit.register(shutil.rmtree, where, ignore_errors=True)
    return where


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it. Only a local
    master, whose executor is the driver, gets one of its own where none is set."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and current.isDefined():
        return current.get()
    if not where and not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    where = where or _own_folder()
    if current.isEmpty():
        sc.setCheckpointDir(where)
    return where


def materialize(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and cut its lineage, so that what was
    costly to compute is neither repeated nor lost with an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """df with more partitions where a plain scan yields fewer than there are cores, as
    a table in few files does, so that stages bound by Python leave none idle. Only scans
    of files are looked at, by their file list: a plan with a shuffle is returned as it is,
    and nothing is run. As a scan with as many splits as cores is never touched, whole
    texts are shuffled only while they are fewer than cores times the split size."""
    spark = spark or df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    node = df._jdf.queryExecution().sparkPlan()
    while node.nodeName() in ("Project", "Filter"):
        node = node.children().head()
    if "Scan" not in node.nodeName() or df._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application, so that they
    find it although it isn't installed on their machines. The archive is the driver's own;
    Spark serves it to the executors."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    where = os.path.join(_own_folder("package"), "tarazu.zip")
    with zipfile.ZipFile(where, "w") as z:
        for folder, _, names in os.walk(package):
            for n in names:
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(where)
    _SHIPPED.add(app)


def ship_file(spark: SparkSession, path: str) -> str:
    """Sends a file of the driver to the workers, once per application, and returns the
    name under which `shipped` finds it there."""
    mark = f"{spark.sparkContext.applicationId} {path}"
    if mark not in _SHIPPED and os.path.exists(path):
        spark.sparkContext.addFile(path)
        _SHIPPED.add(mark)
    return path


def shipped(path: str) -> str:
    """Where a worker finds a file that the driver sent, or that its machine has at the same path."""
    if os.path.exists(path):
        return path
    from pyspark import SparkFiles

    return SparkFiles.get(os.path.basename(path))
