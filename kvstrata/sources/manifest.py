"""The manifest of a store: numbered JSON files, of which the newest counts.

A file is written under another name and then renamed to a number that is not taken yet, so a reader sees the old state or
the new one, and of two writers one fails. Data that no manifest names is never read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

#: Older manifests that stay.
KEEP = 8


class Files:
    """Hadoop's file systems, for what Spark's readers and writers don't do."""

    def __init__(self, spark: SparkSession):
        self.jvm = spark._jvm
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()

    def _of(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._of(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._of(path)
        return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []

    def delete(self, path: str) -> None:
        fs, p = self._of(path)
        fs.delete(p, True)

    def read(self, path: str) -> str:
        fs, p = self._of(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Write a file that is not there yet, whole or not at all; False if it is there."""
        fs, p = self._of(path)
        _, draft = self._of(f"{path}.{uuid.uuid4().hex}.tmp")
        if fs.exists(p):
            return False
        out = fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        done = not fs.exists(p) and fs.rename(draft, p)
        if not done:
            fs.delete(draft, False)
        return done

    def rename(self, source: str, target: str) -> None:
        fs, p = self._of(source)
        fs.rename(p, self._of(target)[1])

    def copy(self, source: str, target: str) -> None:
        (a, p), (b, q) = self._of(source), self._of(target)
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(a, p, b, q, False, True, self.conf)


class Manifest:
    """The parts of a store (folders under its path), its stored state, and what waits to be deleted."""

    EMPTY = {"parts": [], "active": None, "active_lo": 1, "levels": [], "waste": [], "runs": 0}

    def __init__(self, spark: SparkSession, path: str):
        self.files, self.folder = Files(spark), f"{path}/manifest"

    def _numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.files.names(self.folder) if n.endswith(".json"))

    def read(self) -> dict | None:
        """The newest entry with its number, or None if there is no store."""
        numbers = self._numbers()
        return json.loads(self.files.read(f"{self.folder}/{numbers[-1]:020d}.json")) | {"number": numbers[-1]} if numbers else None

    def write(self, entry: dict) -> dict:
        """The entry as the next one after the number it was read under."""
        number = entry.get("number", 0) + 1
        if not self.files.create(f"{self.folder}/{number:020d}.json", json.dumps({k: v for k, v in entry.items() if k != "number"})):
            raise RuntimeError(f"another writer has changed {self.folder}")
        for old in self._numbers()[:-KEEP]:
            self.files.delete(f"{self.folder}/{old:020d}.json")
        return entry | {"number": number}
