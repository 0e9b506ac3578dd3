"""Session construction and lineage cutting.

Everything in the package runs inside a session the caller owns; only tests and
the bench build one here.  ``durable`` is the single place where lineage is cut,
always into reliable storage so that losing an executor never loses the data.
"""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SPREAD = "spark.unitloom.spreadSmallScans"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "unitloom") -> SparkSession:
    """A local session for tests and benches; on a cluster use the cluster's own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(SPREAD, "true")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder the session names for checkpoints.

    On a cluster ``spark.checkpoint.dir`` must name shared storage; a temporary
    folder is only ever made for a local master, where driver and executors are
    one process.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="unitloom-checkpoint-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once per application, so Python jobs find it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_package_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="unitloom-package-")) / "unitloom-package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    sc.addPyFile(str(archive))
    sc._package_shipped = True


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the checkpoint folder and cut its lineage."""
    ship(df.sparkSession)
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Split a scan that has fewer pieces than cores (one small file, one row group).

    Only in sessions of ``local_session``, where the test tables are one file each; elsewhere a scan stays as it is.
    It looks at the planned splits without running anything.
    """
    if df.sparkSession.conf.get(SPREAD, "false") != "true":
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
