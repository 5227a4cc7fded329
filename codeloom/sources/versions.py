"""Published versions of a folder of tables: small files that say which folders hold the rows of each part."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has published in between; the change is to be made again on what is there now."""


class Versions:
    """``<root>/versions/<number>.json``; a version is never changed and becomes visible by one rename."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._gateway = spark.sparkContext._gateway
        self.root = root
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def names(self, folder: str) -> list[str]:
        """What lies in a folder; nothing where there is none."""
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def numbers(self) -> list[int]:
        return [int(n[:-5]) for n in self.names("versions") if n.endswith(".json") and n[:-5].isdigit()]

    def read(self, number: int) -> dict:
        stream = self._fs.open(self._path(f"versions/{number:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def latest(self) -> dict | None:
        numbers = self.numbers()
        return self.read(numbers[-1]) if numbers else None

    def publish(self, manifest: dict) -> None:
        target = self._path(f"versions/{manifest['number']:012d}.json")
        staged = self._path(f"versions/.{uuid.uuid4().hex}")
        stream = self._fs.create(staged)
        stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        stream.close()
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(staged.toUri() if staged.toUri().getScheme() else self._fs.getUri(), self._conf)
        try:
            files.rename(self._fs.makeQualified(staged), self._fs.makeQualified(target), self._gateway.new_array(rename, 0))
        except Exception as error:
            self._fs.delete(staged, False)
            if self._fs.exists(target):
                raise Conflict(f"version {manifest['number']} is there already") from error
            raise

    def sweep(self, keep: int) -> None:
        """Remove all versions but the newest ``keep``, and the folders that none of those names.

        Not to be run beside a writer, whose folders no version names yet.
        """
        numbers = self.numbers()
        kept = {f"{table}/{commit}" for n in numbers[-keep:] for table, parts in self.read(n)["tables"].items() for held in parts.values() for commit in held}
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"versions/{n:012d}.json"), False)
        for table in self.names("data"):
            for commit in self.names(f"data/{table}"):
                if f"{table}/{commit}" not in kept:
                    self._fs.delete(self._path(f"data/{table}/{commit}"), True)
