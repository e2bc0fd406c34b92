"""Session settings that the engine relies on."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(app: str = "fibrelark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC timestamps, ANSI arithmetic, AQE and Arrow transfer.

    Settings given as keyword arguments win; dots are written as double underscores.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": (
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        ),
    }
    settings |= {key.replace("__", "."): value for key, value in conf.items()}
    return builder.config(map=settings).getOrCreate()


def local_session(cores: int | None = None, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and benches."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    defaults = {
        "spark__sql__shuffle__partitions": str(cores),
        "spark__driver__memory": memory,
        "spark__ui__enabled": "false",
        "spark__ui__showConsoleProgress": "false",
    }
    return build_session(master=f"local[{cores}]", **(defaults | conf))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives executors this package, once per application, unless their Python path has it anyway."""
    root = Path(__file__).resolve().parent.parent
    paths = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    key = spark.sparkContext.applicationId
    if key in _SHIPPED or any(p and Path(p).resolve() == root for p in paths):
        return
    target = Path(tempfile.mkdtemp(prefix="fibrelark-code-")) / "fibrelark.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted((root / "fibrelark").rglob("*.py")):
            archive.write(file, file.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(key)
