"""What a session needs before it runs the operators."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED = "factloom.shipped"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once a session, so that Python workers find it whatever their path is."""
    sc = spark.sparkContext
    if sc.getLocalProperty(_SHIPPED):
        return
    here = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="factloom-")) / "factloom_package.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    sc.addPyFile(str(out))
    sc.setLocalProperty(_SHIPPED, "yes")


def checkpoint_dir(spark: SparkSession) -> None:
    """Takes the session's checkpoint folder; makes one only where none is named and all runs on this machine, as in tests.

    On a cluster a machine-local folder would lose what it holds with its machine, so a missing spark.checkpoint.dir is an error there.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the checkpoint folder; they are kept while that is done, because writing takes a second pass."""
    checkpoint_dir(df.sparkSession)
    held = df.persist()
    out = held.checkpoint()
    held.unpersist()
    return out
