"""Session helpers.

The library never hard-codes cluster sizing; ``local_session`` is for tests
and the bench only.  Lineage cuts go to the shared folder named by
``spark.checkpoint.dir``; a default is set only when it is unset and the
master is local.
"""

from __future__ import annotations

import atexit
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "cellframe") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("CELLFRAME_DRIVER_MEM", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


ROWS_PER_TASK = 1 << 18  # rows of single genes that one task holds, sorts and groups


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks for a shuffle of ``rows`` rows: as the session sets them, and more where a task would hold too many rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_TASK))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``cellframe`` importable in Python workers (like ``--py-files``).

    Functions run by ``applyInPandas`` / ``mapInPandas`` refer to this
    package's modules, so executors must be able to import it.  The package
    is zipped once per application and added with ``addPyFile``; Spark then
    ships it to every executor.
    """
    try:
        sc = spark.sparkContext
        key = sc.applicationId
    except Exception:  # noqa: BLE001 - no context handle: nothing to ship
        return
    if key in _SHIPPED:
        return
    import zipfile

    import cellframe
    pkg_dir = os.path.dirname(os.path.abspath(cellframe.__file__))
    root = os.path.dirname(pkg_dir)
    fd, path = tempfile.mkstemp(prefix="cellframe-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg_dir):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(key)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; a local scratch one only for local masters.

    The cluster's ``spark.checkpoint.dir`` (or a directory already set on
    the context) always wins.  Where it is unset, a session on a ``local``
    master gets a scratch folder (tests, single machine); any other master
    raises, because executors cannot share a folder of the driver's disk.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - sessions without a SparkContext handle
        sc = None
    current = (sc.getCheckpointDir() if sc is not None else None) or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        master = sc.master if sc is not None else spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="cellframe-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", current)
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    ship_package(spark)
    return (sc.getCheckpointDir() if sc is not None else None) or current


_WRITTEN: dict[str, SparkSession] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for written tables.

    It is removed by ``drop_scratch`` or, at the latest, when the driver ends.
    """
    import uuid
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    if not _WRITTEN:
        atexit.register(drop_all_scratch)
    _WRITTEN[path] = spark
    return path


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a folder made by ``scratch_path`` through the file system that holds it."""
    if _WRITTEN.pop(path, None) is None:
        raise ValueError(f"not a scratch folder of this application: {path}")
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop_all_scratch() -> None:
    """Delete the scratch folders left by this application (nothing if its context has ended)."""
    for path, spark in list(_WRITTEN.items()):
        try:
            drop_scratch(spark, path)
        except Exception:  # noqa: BLE001 - the context is gone; the cluster's own clean-up remains
            _WRITTEN.pop(path, None)


class ScratchScope:
    """Disk of an iterative job: each of its actions frees its own shuffle files when it ends, and written tables
    that no longer matter are deleted by ``keep``.

    Only tables that ``materialize`` wrote inside the scope are ever deleted.  What is left at its end belongs to
    the scope around it, if any.
    """

    _open: list[ScratchScope] = []
    _CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> ScratchScope:
        self._was = self.spark.conf.get(self._CLEAN, None)
        self.spark.conf.set(self._CLEAN, "true")
        self._open.append(self)
        return self

    def __exit__(self, *_) -> None:  # noqa: ANN002
        self._open.remove(self)
        if self._open:
            self._open[-1].paths += self.paths
        if self._was is None:
            self.spark.conf.unset(self._CLEAN)
        else:
            self.spark.conf.set(self._CLEAN, self._was)

    def keep(self, *frames: DataFrame | None) -> None:
        """Delete the scope's tables but those that ``frames`` read."""
        read = {os.path.basename(os.path.dirname(f)) for df in frames if df is not None for f in df.inputFiles()}
        for path in [p for p in self.paths if os.path.basename(p) not in read]:
            self.paths.remove(path)
            drop_scratch(self.spark, path)


def materialize(df: DataFrame, name: str = "state") -> DataFrame:
    """Write ``df`` as parquet under the shared checkpoint folder and read it back.

    Used by iterative jobs: the next round starts from files every executor
    can read, so the lineage (and plan) never grows and a lost executor only
    re-reads files.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    if ScratchScope._open:
        ScratchScope._open[-1].paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
