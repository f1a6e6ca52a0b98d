"""A source of pages: a service that hands out pages of pairs with a token for the next one."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI and the path in it, on the driver and on executors alike."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class PageReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        """One task for each chain of pages."""
        store, path = _store(self.path)
        found = store.get_file_info(pafs.FileSelector(path))
        return [InputPartition(f.base_name) for f in sorted(found, key=lambda f: f.base_name) if f.type == pafs.FileType.Directory]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        store, path = _store(self.path)
        token = "first"
        while token:
            with store.open_input_stream(f"{path}/{partition.value}/{token}.json") as f:
                page = json.loads(f.read())
            yield from ((int(k), v) for k, v in page["pairs"])
            token = page.get("next")


class Pages(DataSource):
    """``spark.read.format("pages").load(folder)``: each subfolder is a chain of JSON pages (``pairs``, ``next``), the first
    of which is first.json; a chain is followed to its end in one task."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "k bigint, v string"

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Pages)


def write_pages(pairs: DataFrame, path: str, chains: int, size: int) -> None:
    """Writes (``k``, ``v``) as chains of pages of at most ``size`` pairs, by ranges of the key, on the executors; ``path`` must be
    on storage they share. A chain that is written again replaces itself."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, at = _store(path)
        chain = f"{at}/chain-{TaskContext.get().partitionId():05d}"
        store.create_dir(chain, recursive=True)
        held: list[tuple] = []
        name, n = "first", 0

        def put(rows: list[tuple], last: bool) -> None:
            nonlocal name, n
            n += 1
            body = {"pairs": rows} if last else {"pairs": rows, "next": f"page-{n}"}
            with store.open_output_stream(f"{chain}/{name}.json") as f:
                f.write(json.dumps(body).encode())
            name = f"page-{n}"

        for batch in batches:
            held += zip(*[c.to_pylist() for c in batch.columns])
            while len(held) > size:
                put(held[:size], False)
                held = held[size:]
        put(held, True)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32())], ["n"])

    rows = pairs.where("k is not null").select(F.col("k").cast("bigint").alias("k"), F.col("v").cast("string").alias("v"))
    rows.repartitionByRange(chains, "k").sortWithinPartitions("k").mapInArrow(write, "n int").collect()
