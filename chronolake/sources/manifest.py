"""Small files that make a version visible: created whole or not at all, never overwritten."""

from __future__ import annotations

import json
import time

from pyspark.sql import SparkSession

#: Seconds after which a manifest that can't be read is taken for one of a writer that died.
GIVEN_UP = 60.0


class Manifests:
    """Numbered JSON files in a folder that all executors share. The file system refuses to create one that exists, so of
    two writers of one number only the first succeeds."""

    def __init__(self, spark: SparkSession, path: str, name: str) -> None:
        self.path, self.name, self._jvm = path.rstrip("/"), name, spark._jvm
        self._fs = self.at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self.at(self.path))

    def at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _there(self) -> list[tuple[int, str, float]]:
        found = []
        for s in self._fs.listStatus(self.at(self.path)):
            name = s.getPath().getName()
            if name.startswith(f"{self.name}-") and name.endswith(".json"):
                found.append((int(name[len(self.name) + 1 : -5]), name, s.getModificationTime() / 1000))
        return sorted(found)

    def _read(self, name: str) -> dict | None:
        stream = self._fs.open(self.at(f"{self.path}/{name}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None  # its writer is still at it, or died
        finally:
            stream.close()

    def folders(self, path: str) -> list[str]:
        """Names of what lies in a folder; nothing if it isn't there."""
        there = self.at(path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(there)) if self._fs.exists(there) else []

    def versions(self) -> list[int]:
        """Numbers of all whole manifests."""
        return [n for n, name, _ in self._there() if self._read(name) is not None]

    def read(self, version: int) -> dict | None:
        return next((self._read(name) for n, name, _ in self._there() if n == version), None)

    def last(self) -> tuple[int, dict | None]:
        """The last whole manifest with its number; (0, None) if there is none."""
        for n, name, _ in reversed(self._there()):
            if (body := self._read(name)) is not None:
                return n, body
        return 0, None

    def publish(self, after: int, body: dict) -> int:
        """Makes ``body`` the version that follows ``after``; an error if another writer was first. A file that a dead writer
        left unfinished is passed over."""
        version = after + 1
        for n, name, changed in self._there():
            if n > after:
                if self._read(name) is not None or time.time() - changed < GIVEN_UP:
                    raise RuntimeError(f"version {n} was committed by another run")
                version = n + 1
        try:
            out = self._fs.create(self.at(f"{self.path}/{self.name}-{version:010d}.json"), False)
        except Exception as e:
            raise RuntimeError(f"version {version} was committed by another run") from e
        out.write(bytearray(json.dumps(body).encode()))
        out.close()
        return version

    def delete(self, version: int) -> None:
        for n, name, _ in self._there():
            if n == version:
                self._fs.delete(self.at(f"{self.path}/{name}"), False)

    def delete_folder(self, path: str) -> None:
        self._fs.delete(self.at(path), True)
