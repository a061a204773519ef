"""Spark session with the settings the engine expects."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(cores: int | str = "*", app: str = "webloom", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster spark-submit makes the session."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the driver's tables; read by Spark, so any store that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors see. Where that is unset, a temporary one in local mode, as in tests; on a cluster that is
    an error, for a folder of the driver's own machine is no place for executors' tables."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not known:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = tempfile.mkdtemp(prefix="webloom-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once as a table in the shared folder and read again: it cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/webloom-tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written has returned, once all that was made of them is written itself."""
    for df in tables:
        if files := df.inputFiles():
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            if path.getParent().getName() != "webloom-tables":
                raise ValueError(f"not a written table: {path}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remove_tables(spark: SparkSession) -> None:
    """Deletes what written has left in the shared folder; for when every result that reads it has been stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/webloom-tables")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
