"""A closed catalogue of tables in one folder: names are declared, others are refused."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from chronolake.sources.store import VersionedTable


class Catalog:
    """Versioned tables by name with a declared schema each. Only deprecated ones may be dropped."""

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, T.StructType], deprecated: Iterable[str] = ()) -> None:
        self.spark, self.path, self.schemas, self.deprecated = spark, path.rstrip("/"), schemas, {*deprecated}

    def _store(self, name: str) -> VersionedTable:
        if name not in self.schemas:
            raise LookupError(f"table {name} isn't declared")
        return VersionedTable(self.spark, f"{self.path}/{name}")

    def names(self) -> list[str]:
        """Tables that exist."""
        return sorted(n for n in self.schemas if self.exists(n))

    def exists(self, name: str) -> bool:
        return bool(self._store(name).versions())

    def create(self, name: str) -> None:
        """An empty table, unless it exists."""
        if not self.exists(name):
            self._store(name).commit(self.spark.createDataFrame([], self.schemas[name]))

    def view(self, name: str, version: int | None = None) -> DataFrame:
        """A table's rows; those of a declared table that was never written are none."""
        store = self._store(name)
        return store.view(version) if store.versions() else self.spark.createDataFrame([], self.schemas[name])

    def write(self, name: str, df: DataFrame) -> int:
        """The next version of a table, with the columns and types it was declared with."""
        return self._store(name).commit(df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in self.schemas[name]]))

    def clear(self, name: str) -> int:
        return self._store(name).commit(self.spark.createDataFrame([], self.schemas[name]))

    def drop(self, name: str) -> None:
        """Removes all versions of a deprecated table."""
        if name not in self.deprecated:
            raise PermissionError(f"table {name} isn't deprecated")
        store = self._store(name)
        store.remove_before((store.versions() or [0])[-1] + 1)
