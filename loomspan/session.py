"""Session helpers: a local session for tests and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loomspan")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def batch_clock(spark: SparkSession, default: str) -> str:
    """The one time that counts as now for a whole run: the setting loomspan.batch.time, or ``default``."""
    return spark.conf.get("loomspan.batch.time", default)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Only where the setting is absent and the master is local (tests, local runs)
    a temporary folder of this machine is chosen, once per session, and removed
    when the process ends. On a cluster without the setting this is an error.
    """
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None) or spark.conf.get("loomspan.shared.dir", None)
    if not folder:
        if not re.match(r"local(?:\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="loomspan-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("loomspan.shared.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage of df with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{shared_folder(spark)}/{uuid.uuid4().hex}")
    return df.checkpoint(eager=eager)
