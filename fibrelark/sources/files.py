"""Tables and small files of a run: Parquet, CSV and JSON through Spark's paths, checksums, one-time markers."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Whole or not at all: the job's commit renames the files."""
    writer = df.write.mode("error")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """Columns and filter reach the Parquet scan."""
    df = spark.read.parquet(path)
    df = df.filter(where) if where else df
    return df.select(*columns) if columns else df


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("error").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def write_json(path: Path, value: Any, exclusive: bool = False) -> None:
    """A small file of the driver; ``exclusive`` fails if it is there already."""
    with path.open("x" if exclusive else "w") as file:
        json.dump(value, file, indent=2, default=str, sort_keys=True)


def read_json(path: Path) -> Any:
    return json.loads(path.read_text())


def read_yaml(path: Path) -> dict:
    return yaml.safe_load(path.read_text())


def digest(path: Path) -> str:
    """SHA-256 of a file, or of the names and contents of a table's data files."""
    sha = hashlib.sha256()
    files = [path] if path.is_file() else sorted(p for p in path.rglob("*") if p.is_file() and not p.name.startswith((".", "_")))
    for file in files:
        sha.update(file.name.encode())
        with file.open("rb") as data:
            while block := data.read(1 << 20):
                sha.update(block)
    return sha.hexdigest()


def table_digests(spark: SparkSession, path: str) -> DataFrame:
    """path and SHA-256 of every data file, hashed by the executors."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path", F.sha2("content", 256).alias("sha256"))
