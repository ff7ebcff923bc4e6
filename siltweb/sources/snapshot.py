"""A snapshot of web pages as a Spark data source, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "url string, status int, content_type string, html string, via string"


def _files(path: str) -> tuple[object, list[str]]:
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return system, [root]
    return system, sorted(i.path for i in system.get_file_info(fs.FileSelector(root)) if i.path.endswith(".parquet"))


@dataclass
class RowGroup(InputPartition):
    path: str
    group: int

    def __init__(self, path: str, group: int):
        super().__init__((path, group))
        self.path, self.group = path, group


def _pages(system, partition: RowGroup) -> Iterator[pa.RecordBatch]:
    import pyarrow.parquet as pq

    with system.open_input_file(partition.path) as f:
        table = pq.ParquetFile(f).read_row_group(partition.group, columns=["url", "html"])
    n = table.num_rows
    columns = {"url": table["url"].cast("string"), "status": pa.array([200] * n, "int32"), "content_type": pa.array(["text/html"] * n), "html": table["html"].cast("string"), "via": pa.array(["request"] * n)}
    yield from pa.table(columns).to_batches(max_chunksize=2048)


def _plan(path: str) -> list[RowGroup]:
    import pyarrow.parquet as pq

    system, files = _files(path)
    out = []
    for name in files:
        with system.open_input_file(name) as f:
            out += [RowGroup(name, g) for g in range(pq.ParquetFile(f).num_row_groups)]
    return out


class SnapshotReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return _plan(self.path)

    def read(self, partition: RowGroup) -> Iterator[pa.RecordBatch]:
        return _pages(_files(self.path)[0], partition)


class SnapshotStream(DataSourceStreamReader):
    """Row groups in order, ``perTrigger`` of them in a batch; the offset is how many have been read, so a restart repeats nothing."""

    def __init__(self, path: str, per_trigger: int):
        self.path, self.per_trigger, self.at = path, per_trigger, 0

    def initialOffset(self) -> dict:
        return {"groups": 0}

    def latestOffset(self) -> dict:
        self.at = min(self.at + self.per_trigger, len(_plan(self.path)))
        return {"groups": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = max(self.at, end["groups"])
        return _plan(self.path)[start["groups"] : end["groups"]]

    def read(self, partition: RowGroup) -> Iterator[pa.RecordBatch]:
        return _pages(_files(self.path)[0], partition)


class WebPages(DataSource):
    """``format("webpages").load(path of a page snapshot)``; no network is used."""

    @classmethod
    def name(cls) -> str:
        return "webpages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SnapshotReader:
        return SnapshotReader(self.options["path"])

    def streamReader(self, schema) -> SnapshotStream:
        return SnapshotStream(self.options["path"], int(self.options.get("perTrigger", 1)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WebPages)
