"""Written tables that cut a plan's lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a folder of this machine only for local sessions that set none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, "") or _made(spark)


def _made(spark: SparkSession) -> str:
    _OWN[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="fibrelark-")
    return _OWN[spark.sparkContext.applicationId]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session may have ended before the interpreter
        pass


def written(frame: DataFrame, name: str) -> DataFrame:
    """The same rows read from a new table, which stays until the interpreter ends."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
