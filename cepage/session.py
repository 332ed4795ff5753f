"""Session helpers: a local session for tests, and the shared folder for cut lineage."""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()
_folders: dict[str, str] = {}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    if not on_path():
        os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (str(ROOT), os.environ.get("PYTHONPATH")) if x)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cepage")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def on_path() -> bool:
    """Whether Python workers that inherit this environment find the package."""
    return str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep)


def ship(spark: SparkSession) -> None:
    """Give the package to the executors, through the shared folder, unless their environment has it."""
    sc = spark.sparkContext
    if on_path() or sc.applicationId in _shipped:
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted((ROOT / "cepage").rglob("*.py")):
            z.write(f, f.relative_to(ROOT).as_posix())
    path = f"{scratch_path(spark, 'package')}/cepage-package.zip"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(target)
    try:
        out.write(bytearray(packed.getvalue()))
    finally:
        out.close()
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, shared by all executors.

    Only in local mode (tests on one machine) is a temporary folder made where the setting is absent; a cluster
    without it is an error, since a folder of one machine would not do.
    """
    current = spark.sparkContext.getCheckpointDir()
    conf = spark.conf.get("spark.checkpoint.dir", None) or current
    if conf is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="cepage-")
    if current is None:
        spark.sparkContext.setCheckpointDir(conf)
        # The context keeps the folder in one of its own name below; this is where tables of this library go.
        _folders[spark.sparkContext.applicationId] = conf
    return _folders.get(spark.sparkContext.applicationId, conf).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared folder and forget its lineage; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a table written by one run."""
    return f"{shared_dir(spark)}/cepage/{name}-{uuid.uuid4().hex}"


class Rounds:
    """Tables of an iteration, written to the shared folder; a table is dropped once its successor is there.

    Unlike checkpoints, tables that are read again have sizes of their own. The estimates that a checkpoint keeps
    multiply with every join, and after some twenty rounds planning takes longer than running.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.name, self.paths = spark, name, {}

    def table(self, key: str, df: DataFrame) -> DataFrame:
        """Write ``df`` as the table ``key`` of this round, and drop the former one."""
        path = scratch_path(self.spark, f"{self.name}-{key}")
        df.write.parquet(path)
        if key in self.paths:
            remove_path(self.spark, self.paths[key])
        self.paths[key] = path
        return self.spark.read.parquet(path)

    def drop(self, key: str) -> None:
        if key in self.paths:
            remove_path(self.spark, self.paths.pop(key))


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote below the shared folder."""
    if "/cepage/" not in path:
        raise ValueError(f"{path} is no folder of this library")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


class Kept:
    """A table that runs carry on, at a fixed path below the shared folder: one folder per version, the last whole one counts."""

    def __init__(self, spark: SparkSession, name: str, source: str) -> None:
        self.spark = spark
        self.path = f"{shared_dir(spark)}/cepage/kept/{name}-{hashlib.sha256(os.path.abspath(source).encode() if '://' not in source else source.encode()).hexdigest()[:16]}"

    def _versions(self) -> list[int]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not fs.exists(at):
            return []
        whole = (x.getPath() for x in fs.listStatus(at) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS")))
        return sorted(int(x.getName()) for x in whole)

    def read(self) -> DataFrame | None:
        """The table as the last run left it; None before the first."""
        versions = self._versions()
        return self.spark.read.parquet(f"{self.path}/{versions[-1]}") if versions else None

    def read_all(self) -> DataFrame | None:
        """The rows of all versions, for tables that are only added to; None before the first."""
        versions = self._versions()
        return self.spark.read.parquet(*(f"{self.path}/{v}" for v in versions)) if versions else None

    def append(self, df: DataFrame) -> None:
        """Add rows as a version of their own; what is there is neither read nor written again. No rows leave no version,
        unless it is the first."""
        versions = self._versions()
        path = f"{self.path}/{versions[-1] + 1 if versions else 0}"
        df.write.parquet(path)
        if versions and self.spark.read.parquet(path).isEmpty():
            remove_path(self.spark, path)

    def write(self, df: DataFrame) -> None:
        """Write the next version, then drop those before the one it was made from."""
        versions = self._versions()
        df.write.parquet(f"{self.path}/{versions[-1] + 1 if versions else 0}")
        for old in versions[:-1]:
            remove_path(self.spark, f"{self.path}/{old}")


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as tasks can run at once, if a scan gives it fewer (few or small files)."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def parallelism(spark: SparkSession) -> int:
    """Partitions for a shuffle whose number must be given: at least the configured number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
