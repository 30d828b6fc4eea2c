"""Session settings that the library relies on."""

import tempfile

from pyspark.sql import SparkSession


def session(app: str = "tickloom", master: str | None = None, **conf) -> SparkSession:
    """A session in UTC with adaptive execution. On a cluster leave master to spark-submit and partitions to AQE."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"} | conf
    for k, v in settings.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and tables between jobs, as spark.checkpoint.dir names it. A temporary one stands in only
    where driver and executors are one process; on a cluster it would be the driver's own, so there it is an error."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if base:
        return base.rstrip("/")
    if sc.master == "local" or sc.master.startswith("local["):
        return tempfile.mkdtemp(prefix="tickloom-")
    raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
