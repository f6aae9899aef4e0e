"""Session helpers: a local session for tests/bench and the shared checkpoint folder.

Library operators never create a session; they use the one their input
DataFrames belong to.  Lineage is cut with reliable ``checkpoint()`` into
the folder the cluster names in ``spark.checkpoint.dir``; a private folder is
only created when that setting is missing (local tests, the bench).
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8, app: str = "graphmend") -> SparkSession:
    """Session for tests and the bench: local mode, AQE on, UI off."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder of the session.

    Uses ``spark.checkpoint.dir`` (or a folder already set on the context).
    Only in local mode a private folder is made when neither is set: on a
    cluster every executor would write to its own disk, so that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="graphmend-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder for written tables."""
    base = checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss), never ``localCheckpoint``."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``graphmend`` importable in executor Python workers (like ``--py-files``).

    Arrow UDFs defined in this package are pickled by reference, so workers
    must import it.  The package is zipped once per application and handed to
    ``addPyFile``; Spark distributes it to every executor.
    """
    import shutil

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    staging = tempfile.mkdtemp(prefix="graphmend-pyfiles-")
    archive = shutil.make_archive(
        os.path.join(staging, "graphmend"), "zip", root_dir=os.path.dirname(pkg_dir), base_dir="graphmend"
    )
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)
