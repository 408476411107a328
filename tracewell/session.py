"""Session helpers: table access and durable lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "tracewell", cores: str = "8", shuffle: int = 8) -> SparkSession:
    """A session for tests and benches on one machine; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """Reads one table of a data folder; columns and filters are pruned at the scan by Catalyst."""
    return spark.read.parquet(f"{data_dir}/{name}.parquet")


def cut_lineage(df: DataFrame, eager: bool = False) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint, which survives the loss of executors.

    The folder is the one the session names in ``spark.checkpoint.dir``. Where that is unset, a session on one machine
    takes a temporary folder; on a cluster it is an error, since a folder of one machine is lost with it.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tracewell-"))
    return df.checkpoint(eager=eager)
