"""What the operators of this package share: the shared folder, written tables, hashes."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space of the contracts: [\x20\x09-\x0D]. bytes.split() and
# bytes.lower() of Python use just this set and just A-Z.
WHITE = " \t\n\x0b\f\r"
WHITE_CLASS = "[\\x20\\x09-\\x0D]+"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")

MASK64 = (1 << 64) - 1
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; the path may be any that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only where the setting is missing (local tests) a folder of this machine is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = _own_folder(spark)
    return named.rstrip("/")


_OWN: dict[str, str] = {}


def _own_folder(spark: SparkSession) -> str:
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    key = spark.sparkContext.applicationId
    if key not in _OWN:
        _OWN[key] = "file://" + tempfile.mkdtemp(prefix="fibrelark-")
    return _OWN[key]


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _delete_quietly(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # noqa: BLE001 - the session may have ended before the interpreter
        pass


class Scratch:
    """Written tables of one run of an operator, in the shared folder.

    Tables cut the lineage and survive the loss of executors. Those that a
    returned plan still reads stay until the interpreter ends; drop() removes the
    others early.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.written: set[str] = set()
        atexit.register(_delete_quietly, spark, self.path)

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def write(self, df: DataFrame, name: str, batch_rows: int | None = None, **options: str) -> DataFrame:
        """Writes and reads again; ``batch_rows`` bounds the Arrow batches of this plan, where rows are wide."""
        path = self.at(name)
        self.written.add(name)
        before = self.spark.conf.get(BATCH_ROWS)
        if batch_rows:
            self.spark.conf.set(BATCH_ROWS, str(min(batch_rows, int(before) if int(before) > 0 else batch_rows)))
        try:
            df.write.mode("overwrite").options(**options).parquet(path)
        finally:
            self.spark.conf.set(BATCH_ROWS, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        delete(self.spark, self.at(name))
        self.written.discard(name)

    def keep(self, *names: str) -> None:
        """Drops all tables but these."""
        for name in self.written.difference(names):
            self.drop(name)

    def tidy(self) -> None:
        """Lets Spark remove the shuffle files of finished steps, which it does when the driver collects their plans.

        Executors collect their garbage too and give back the heap that steps before left
        grown, as the pages of sorts and aggregates make it grow to its limit.
        """
        gc.collect()
        context = self.spark.sparkContext
        context._jvm.System.gc()
        if not re.fullmatch(r"local(\[.*\])?", context.master):  # there the driver is the executor
            slots = context.defaultParallelism
            self.spark.range(0, slots, 1, slots).selectExpr("java_method('java.lang.System', 'gc')").collect()


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that others of the table cannot clash; a missing one is an error."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def bytes_column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8 bytes; null counts as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return [b"" if x is None else x for x in column.to_pylist()]


def text_column(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column as strings; null counts as empty."""
    return ["" if x is None else x for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same over a partition; when it ends, the worker gives back memory that it does not use, as idle workers stay."""

    def whole(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(parts)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # a matter of the C library in use
        if trim is not None:
            trim(0)

    return whole


def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (part for part in parts if part.num_rows)


def word_count(text: Column) -> Column:
    """Number of words of a text on the JVM side; null has none."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(F.length(trimmed) == 0, F.lit(0)).otherwise(F.size(F.split(trimmed, WHITE_CLASS))).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit mixing hash, for whole arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


