"""Session defaults and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "rillstone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume: UTC, AQE with skew join, Arrow."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; a temporary one only where it is unset."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="rillstone-")
        sc.setCheckpointDir(found)
    return found


def written(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder and read back: its lineage ends there, and a lost executor costs nothing.

    The files go when the session's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def drop() -> None:
        try:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        except Exception:
            pass

    atexit.register(drop)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """df in at least as many parts as there are cores, for work that costs far more than moving its rows.

    Files are read in parts of 4 MB or more; a table (``of``, or df itself) of
    less than that a core would leave cores idle, so df is dealt out. Larger ones
    stay as they are read. Give the table before its columns are picked: what is
    picked of it is hard to size.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str((of or df)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(2 * cores) if size < cores * (4 << 20) else df
