"""Spark session helpers.

Library code never builds its own session: every operator takes DataFrames and
returns DataFrames.  ``get_spark`` is only for tests, the bench and scripts.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every session of ours should carry.  AQE re-plans joins and
# coalesces shuffle partitions at run time; skew-join splits hot partitions.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The JVM interprets methods of more bytes than this; over it Spark evaluates
    # the stage by small methods instead of one large one.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app_name: str = "matfold") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    builder = builder.master(master or os.environ.get("MATFOLD_MASTER", "local[*]"))
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("MATFOLD_DRIVER_MEMORY", "8g"))
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder; only set one when none is set.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is.  Only a bare local session (tests, bench) gets a scratch folder.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        spark.sparkContext.setCheckpointDir(conf_dir)
        return conf_dir
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="matfold-ckpt-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(path)
    return path


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``matfold`` importable in the Python workers of this application.

    Arrow UDFs and ``mapInPandas`` functions of the library are pickled by
    reference, so executors must be able to import the package.  It is zipped
    once per application and added with ``addPyFile`` (Spark distributes it
    to every executor, present and future).
    """
    import shutil
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="matfold-pyfiles-")
    archive = shutil.make_archive(os.path.join(out, "matfold"), "zip",
                                  root_dir=os.path.dirname(pkg_dir), base_dir="matfold")
    sc.addPyFile(archive)
    _SHIPPED.add(app)
