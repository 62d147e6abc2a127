"""Session helpers that every part of the library shares."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_shipped: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Arrow kernels import it there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="readloom-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, f"readloom_{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    _shipped[app] = path


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and all run on one machine (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="readloom-shared-")
    atexit.register(shutil.rmtree, own, True)
    sc.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/readloom-{label}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: lineage ends there, and lost executors redo nothing before it."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")  # the write's shuffle files go with it
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._readloom_path = path  # noqa: SLF001
    return out


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that an operator wrote and no longer reads."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_written(df: DataFrame) -> None:
    drop_folder(df.sparkSession, df._readloom_path)  # noqa: SLF001
