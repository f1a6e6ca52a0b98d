"""A versioned table in a folder: readers see whole versions, a writer adds the next one or none."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronolake.sources.manifest import Manifests


class VersionedTable:
    """Each version is a folder of Parquet files, made visible by a manifest that names it; older versions stay until they
    are removed."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.manifests = Manifests(spark, self.path, "v")

    def versions(self) -> list[int]:
        return self.manifests.versions()

    def view(self, version: int | None = None) -> DataFrame:
        """A version, by default the last; later commits don't change it."""
        body = self.manifests.last()[1] if version is None else self.manifests.read(version)
        if body is None:
            raise LookupError(f"no version {version if version is not None else ''} of {self.path}")
        return self.spark.read.parquet(body["data"])

    def note(self) -> dict:
        """What was noted with the last version."""
        return (self.manifests.last()[1] or {}).get("note", {})

    def commit(self, df: DataFrame, after: int | None = None, note: dict | None = None) -> int:
        """Writes the version that follows ``after``, by default the last; an error if another writer was first. A run that
        dies leaves only a folder that no manifest names."""
        after = self.manifests.last()[0] if after is None else after
        data = f"{self.path}/data-{uuid.uuid4().hex}"
        df.write.parquet(data)
        try:
            return self.manifests.publish(after, {"data": data, "note": note or {}})
        except RuntimeError:
            self.manifests.delete_folder(data)
            raise

    def update(self, change: Callable[[DataFrame], DataFrame]) -> int:
        """Commits ``change(current)``; an error if the current version isn't the last any more by then."""
        version, body = self.manifests.last()
        if body is None:
            raise LookupError(f"no version of {self.path}")
        return self.commit(change(self.spark.read.parquet(body["data"])), version)

    def remove_before(self, version: int) -> None:
        for v in self.versions():
            if v < version:
                data = self.manifests.read(v)["data"]
                self.manifests.delete(v)
                self.manifests.delete_folder(data)
