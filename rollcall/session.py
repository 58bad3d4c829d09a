"""Session set-up and the cutting of lineage."""

from __future__ import annotations

import gc
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "rollcall", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that results depend on (UTC, ANSI) and AQE."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        # Checkpoints that nothing refers to any more are deleted.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    return b.config(map=settings).getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: what the cluster names in
    ``spark.checkpoint.dir``; a temporary one in a single local process only."""
    sc = spark.sparkContext
    there = sc.getCheckpointDir()
    if there:
        return there
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="rollcall-checkpoint-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder; survives the loss of
    executors and ends the plan before it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files that nothing refers to any more; it
    does so only when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let executors import this package, by Spark's own file server; once for
    each application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="rollcall-")) / "rollcall.zip"
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*")):
            if p.is_file() and "__pycache__" not in p.parts:
                z.write(p, str(Path(here.name) / p.relative_to(here)))
    sc.addPyFile(str(at))
    _SHIPPED.add(sc.applicationId)


#: Up to so many narrow rows a side of a join is broadcast.
BROADCAST_ROWS = 1_000_000


def build_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (narrow rows, best checkpointed) as the side of a join that is
    broadcast while it is counted to be small; beyond that, the planner sorts
    or hashes, can spill and splits skewed keys."""
    return df.hint("broadcast") if df.limit(max_rows + 1).count() <= max_rows else df
