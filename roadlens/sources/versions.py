"""Versioned tables: each version is a folder of its own, and a numbered commit file that appears by one rename makes it current.

A write that fails leaves no commit, so readers keep the version before. Of two writers that start from one version, one commits and the
other raises. Versions stay until `vacuum` removes them, so a reader of an older one is not disturbed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession


class ConflictError(RuntimeError):
    """Another writer has committed the version first."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self._jvm = spark, path.rstrip("/"), spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _files(self):
        return self._at().getFileSystem(self._conf)

    def versions(self) -> list[int]:
        """Numbers of the committed versions, rising."""
        fs, log = self._files(), self._at("_commits")
        names = [s.getPath().getName() for s in fs.listStatus(log)] if fs.exists(log) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def commit_info(self, version: int) -> dict:
        stream = self._files().open(self._at("_commits", f"{version:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, df: DataFrame, how: Callable[[DataFrameWriter], DataFrameWriter] = lambda w: w, base: int | None = None, **info: object) -> int:
        """Write df as the version after `base` (the current one, unless given) and return its number; info is kept with the commit."""
        before = base if base is not None else max(self.versions(), default=0)
        folder = f"data-{uuid.uuid4().hex}"
        how(df.write).parquet(f"{self.path}/{folder}")
        self._publish(before + 1, {"folder": folder, "schema": df.schema.json(), **info})
        return before + 1

    def _publish(self, version: int, content: dict) -> None:
        fs, made = self._files(), self._at("_commits", f"{version:012d}.json")
        draft = self._at("_commits", f".draft-{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(made.toUri(), self._conf)
        no_overwrite = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(made), no_overwrite)
        except Exception as error:
            fs.delete(draft, False)
            if fs.exists(made):
                raise ConflictError(f"version {version} of {self.path} is another writer's") from error
            raise

    def read(self, version: int | None = None) -> DataFrame:
        """The current version or an older one; raises if nothing is committed."""
        from pyspark.sql.types import StructType

        known = self.versions()
        if not known or (version is not None and version not in known):
            raise FileNotFoundError(f"{self.path} has no version {version or ''}".rstrip())
        info = self.commit_info(version or known[-1])
        return self.spark.read.schema(StructType.fromJson(json.loads(info["schema"]))).parquet(f"{self.path}/{info['folder']}")

    def vacuum(self, keep: int = 2) -> list[int]:
        """Remove all but the newest `keep` versions and what failed writes have left; not to be run beside a writer. Returns what went."""
        fs, known = self._files(), self.versions()
        gone, held = known[:-keep], {self.commit_info(v)["folder"] for v in known[-keep:]}
        for version in gone:
            fs.delete(self._at("_commits", f"{version:012d}.json"), False)
        for status in fs.listStatus(self._at()):
            name = status.getPath().getName()
            if name.startswith("data-") and name not in held:
                fs.delete(status.getPath(), True)
        return gone
