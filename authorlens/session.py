"""Session settings the operators are tuned for."""

import tempfile
from uuid import uuid4

from pyspark.sql import SparkSession


def build_session(app: str = "authorlens", master: str | None = None, partitions: int | None = None,
                  memory: str | None = None) -> SparkSession:
    """A session with adaptive execution on; on a cluster leave ``master`` and sizes to spark-submit."""
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.python.sql.dataFrameDebugging.enabled", "false")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if master:
        b = b.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    if memory:
        b = b.config("spark.driver.memory", memory)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for cut lineage: the cluster's setting, or a fresh one where none is set."""
    sc = spark.sparkContext
    path = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        path = tempfile.mkdtemp(prefix="authorlens-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def cut_lineage(df):
    """Reliable checkpoint, so that later stages survive the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df):
    """``df`` as a table in the checkpoint folder: columns are compressed there and a reader takes those it needs.

    For tables of many small rows, which a checkpoint writes and reads one by one as objects.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/stored-{uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def dealt(df, partitions: int | None = None):
    """Deal rows out before CPU-heavy row-local work, if the session asks for it.

    A file with one row group is read by one task whatever its size.  ``partitions``, or the
    setting ``authorlens.deal.partitions``, says how many tasks are wanted; without either the
    splits of the scan stay as they are, and nothing is shuffled.
    """
    n = partitions or int(df.sparkSession.conf.get("authorlens.deal.partitions", "0"))
    return df.repartition(n) if n else df
