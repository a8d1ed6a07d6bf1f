"""Spark session set-up and the shared folder that cuts lineage."""

from __future__ import annotations

import itertools
import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "filigree", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine expects; on a cluster submit with the same keys."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
    } | conf
    return SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=settings).getOrCreate()


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it; clusters without that path ship it by
    --py-files."""
    home = str(Path(__file__).resolve().parent.parent)
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if home not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, home]))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Only where that is unset (tests on one machine) a temporary folder is made and set.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    set_already = sc._jsc.sc().getCheckpointDir()
    if named:
        if not set_already.isDefined():
            sc.setCheckpointDir(named)
        return named
    if set_already.isDefined():
        return set_already.get()
    made = tempfile.mkdtemp(prefix="filigree-")
    sc.setCheckpointDir(made)
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from the files, so that a lost executor costs no lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path inside the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def rounds(most: int | None = None) -> Iterator[int]:
    """The numbers of a loop's rounds, without an end; a loop that needs more than ``most`` is an error."""
    for i in itertools.count():
        if most is not None and i >= most:
            raise RuntimeError(f"the fixed point is not reached within {most} rounds")
        yield i
