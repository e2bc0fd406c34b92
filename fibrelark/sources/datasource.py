"""The simulated fleet as a Python data source: ``spark.read.format("fibrelark_fleet").option("entities", 4).load()``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fibrelark.sources.simulate import NATIVE, Entity, GeneratorConfig


class _EntityPartition(InputPartition):
    def __init__(self, number: int) -> None:
        self.number = number


class _FleetReader(DataSourceReader):
    def __init__(self, config: GeneratorConfig) -> None:
        self.config = config

    def partitions(self) -> list[InputPartition]:
        return [_EntityPartition(k) for k in range(self.config.entities)]

    def read(self, partition: _EntityPartition) -> Iterator[tuple]:
        frame = Entity(self.config, partition.number).readings()
        for row in frame.itertuples(index=False):
            yield (row[0].to_pydatetime(), row[1], *(None if v != v else float(v) for v in row[2:]))


class FleetSource(DataSource):
    """Options are the fields of GeneratorConfig."""

    @classmethod
    def name(cls) -> str:
        return "fibrelark_fleet"

    def schema(self) -> str:
        return NATIVE

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        kinds = {name.lower(): (name, int if kind in ("int", int) else float) for name, kind in GeneratorConfig.__annotations__.items()}
        given = {kinds[k.lower()][0]: kinds[k.lower()][1](v) for k, v in self.options.items() if k.lower() in kinds}
        return _FleetReader(GeneratorConfig(**given))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FleetSource)
