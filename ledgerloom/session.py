"""The session that the library expects."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers find the library: where it lies if they share this machine, else as a zip that Spark sends them."""
    context = spark.sparkContext
    if not context.master.startswith("local"):
        if not getattr(context, "_ledgerloom_sent", False):
            folder = tempfile.mkdtemp(prefix="ledgerloom-")  # on the driver; Spark copies the file from here
            context.addPyFile(shutil.make_archive(os.path.join(folder, "ledgerloom"), "zip", ROOT, "ledgerloom"))
            context._ledgerloom_sent = True
        return spark
    known = context.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in known.split(os.pathsep):
        context.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, known]))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A new folder where driver and executors both write; it goes when Spark ends. Only a local master may do without ``spark.checkpoint.dir``."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/ledgerloom-streams"
    path = f"{root}/{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(target)
    system.deleteOnExit(target)
    return path


def staged(rows: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: ``rows`` written to the shared folder and read back."""
    path, schema = f"{shared_dir(rows.sparkSession)}/{label}", rows.schema
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path)


def session(master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution and zstd files; cluster settings come from the cluster."""
    builder = SparkSession.builder.appName("ledgerloom")
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.mapKeyDedupPolicy": "LAST_WIN"} | conf
    return ship(builder.config(map=settings).getOrCreate())
