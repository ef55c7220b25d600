"""Session helpers: configuration, shipping of this package to workers, shared checkpoints."""

from __future__ import annotations

import os
import sys
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent

#: Settings a session of this engine wants; `build` applies them to new sessions only.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build(master: str = "local[*]", app: str = "webloom", **conf: str) -> SparkSession:
    """A session with the engine's defaults; keyword settings use `_` for `.`-free keys only."""
    b = SparkSession.builder.master(master).appName(app)
    for k, v in {**DEFAULTS, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Make this package importable by Python workers, once for each Spark context.

    Workers that start with the repository on PYTHONPATH need nothing; otherwise the package goes
    out through Spark's own file distribution.
    """
    root = str(PACKAGE.parent)
    sc = spark.sparkContext
    if root in os.environ.get("PYTHONPATH", "").split(":") or getattr(sc, "_webloom_shipped", False):
        return
    target = Path(tempfile.mkdtemp()) / "webloom_pkg.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(PACKAGE.parent))
    sc.addPyFile(str(target))
    if str(target) in sys.path:
        sys.path.remove(str(target))
    sc._webloom_shipped = True


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). On one machine a temporary one stands in; a cluster must name it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="webloom-checkpoints-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` cut from its lineage in the folder all executors share."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
